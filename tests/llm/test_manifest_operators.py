"""Token links, hash trees and winnowed fingerprints against brute-force versions, and odd input."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import merkle, token_links, winnowing
from tidemark.session import ship

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, bucket string, pair string"
ODD = [
    (1, "s", None, 3, None), (2, "s", "", 0, ""), (3, None, "en", None, " \n\t "), (None, "s", "en", 1, "a b"), (4, "s", "en", 5, "Xa▁b"), (4, "s", "en", 5, "Xa▁b"),
    (5, "s", "de", 9, "<|endoftext|> <s> </s> <unk> <0x41>"), (6, "s", "de", 9, "  x\n\n\ty\u0000  "), (7, "s", "fr", 9, "é😀 日本語 ﬁ é \x1c"),
    (8, "s", "fr", 9, "A" * 5000), (9, "s", "en", 9, "ab Ab " * 60_000), (10, "s", "en", 0, "İ ß ſ"),
]


@pytest.fixture(autouse=True)
def sent(spark):
    ship(spark)


def odd_docs(spark, rows=ODD):
    return spark.createDataFrame([(*r, "t", "b", "p") for r in rows], DOCS)


def real_docs():
    return duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{SF}/documents.parquet'").fetchall()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- token links ----------------------------------------------------------------------------------------------------


def token_files():
    import public_tokenizers as P

    return P.path(token_links.BYTE_TOKENIZER), P.PATTERN, P.path(token_links.PIECE_TOKENIZER)


def brute_links(docs):
    """Rows as contracted, by walking both lists of tokens, with the tokenizer file's own library."""
    import sentencepiece
    from tokenizers import Tokenizer

    byte_file, _, piece_file = token_files()
    first = Tokenizer.from_file(byte_file)
    first.encode_special_tokens = True
    letters = token_links.byte_level_letters()
    of_a = {k: bytes(letters[c] for c in entry) for entry, k in first.get_vocab().items()}
    second = sentencepiece.SentencePieceProcessor(model_file=piece_file)

    def of_b(k):
        piece = second.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()

    def spans(ids, spell):
        out, at = [], 0
        for k in ids:
            out.append((at, at + len(spell(k)), k))
            at += len(spell(k))
        return out

    made, count = [], collections.Counter()
    for name, text in docs:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(of_a[k] for k in a) != whole or b"".join(map(of_b, b)) != whole:
            made.append((name, 0, 0, 0, [], ""))
            continue
        left, right, links, low = spans(a, of_a.__getitem__), spans(b, of_b), [], 0
        for start, end, k in left:
            while right[low][1] <= start:
                low += 1
            for other in right[low:]:
                if other[0] >= end:
                    break
                links.append((k, other[2]))
        groups, i, j = [], 0, 0
        for cut in sorted({e for _, e, _ in left} & {e for _, e, _ in right}):
            mine, theirs = [], []
            while i < len(left) and left[i][1] <= cut:
                mine.append(str(left[i][2]))
                i += 1
            while j < len(right) and right[j][1] <= cut:
                theirs.append(str(right[j][2]))
                j += 1
            groups.append(f"{','.join(mine)}|{','.join(theirs)}")
        count.update(links)
        made.append((name, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted(
        ((i, n_a, n_b, n, len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), digest) for i, n_a, n_b, n, x, digest in made), key=repr
    ), count


def test_token_links_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    got = rows_of(token_links.token_links(docs, f"file:{tmp_path}/index", *token_files()))
    want, count = brute_links([(r[0], r[4]) for r in real_docs()])
    assert got == want
    pairs = token_links.pair_counts(token_links.read_postings(spark, f"file:{tmp_path}/index"))
    held = {(r.a, r.b): r.n_links for r in pairs.collect()}
    assert held == dict(count)
    assert pairs.filter("n_docs > n_links OR n_docs < 1").isEmpty()


def test_token_links_of_odd_texts(spark, tmp_path):
    want, _ = brute_links([(r[0], r[4]) for r in ODD])
    for parts in (1, 4):
        docs = odd_docs(spark).repartition(parts)
        assert rows_of(token_links.token_links(docs, f"file:{tmp_path}/odd{parts}", *token_files())) == want
    assert token_links.token_links(odd_docs(spark).limit(0), f"file:{tmp_path}/none", *token_files()).count() == 0


def test_both_libraries_give_the_same_ids():
    from tokenizers import Tokenizer

    pair = token_links.Pair(*token_files())
    plain = Tokenizer.from_file(token_files()[0])
    plain.encode_special_tokens = True
    rng = np.random.default_rng(5)
    signs = list("aZé ñ\n\t 0'’sStTlLvV.,!?<|>_-") + ["́", " ", " ", "日", "😀", "<|endoftext|>", "\x00", "\x85", "İ", "'re", "  ", "²", "٣"]
    texts = [" " + "".join(rng.choice(signs, rng.integers(1, 30))) for _ in range(20_000)]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [pair.byte_encoder.encode_ordinary(t) for t in texts] == want


@pytest.mark.parametrize("room", [1, 9, 700, 65_536])
def test_bitmaps_round_trip(room):
    rng = np.random.default_rng(room)
    sets = [np.unique(rng.integers(0, room, rng.integers(0, n + 1))) for n in (0, 1, 5, room, room // 2, 3)]
    container = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    packed = token_links.bitmaps(container, np.concatenate(sets), len(sets), room)
    row, place = token_links.unpack(packed)
    assert {(int(r), int(p)) for r, p in zip(row, place)} == {(r, int(p)) for r, s in enumerate(sets) for p in s}
    row, place = token_links.unpack(packed.slice(2, 3))
    assert {(int(r) + 2, int(p)) for r, p in zip(row, place)} == {(r, int(p)) for r in (2, 3, 4) for p in sets[r]}


def test_blocks_do_not_change_the_result(spark, tmp_path, monkeypatch):
    """A block per few documents: a pair's documents then lie in many bitmaps."""
    docs = [(r[0], r[4]) for r in real_docs()[:200]] + [(i, "the same words again and again the same") for i in range(5000, 5300)]
    want, _ = brute_links(docs)
    monkeypatch.setattr(token_links, "BLOCK_LINKS", 3000)
    monkeypatch.setattr(token_links, "BATCH_BYTES", 2000)
    import pyarrow as pa

    run = token_links._index(token_files())
    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})()))
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs])], ["doc_id", "text"])
    table = pa.Table.from_batches(list(run([batch])))
    monkeypatch.undo()
    import pyarrow.parquet as pq

    for kind in (0, 1):
        folder = tmp_path / "index" / f"kind={kind}"
        folder.mkdir(parents=True)
        pq.write_table(table.filter(pa.compute.equal(table["kind"], kind)).drop_columns(["kind"]), folder / "part.parquet")
    found = token_links.read_postings(spark, f"file:{tmp_path}/index")
    assert found.select("block").distinct().count() > 50
    got = token_links.scored(token_links.read_documents(spark, f"file:{tmp_path}/index"), found, token_links.pair_counts(found))
    assert rows_of(got) == want


# -- hash trees -----------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    doc_id, source, lang, n_chars, text = row
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def brute_level(nodes):
    return [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]


def brute_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append(brute_level(levels[-1]))
    return levels


def brute_manifest(docs):
    groups = collections.defaultdict(list)
    for row in docs:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        rows = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[name] = rows, brute_tree([brute_leaf(r) for r in rows])
    upper = brute_tree([trees[n][1][-1][0] for n in names])
    out = []
    for g, name in enumerate(names):
        rows, levels = trees[name]
        for k, row in enumerate(rows):
            now, siblings, at = brute_leaf(row), [], k
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                now = brute_leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for tree, start in ((levels, k), (upper, g)):
                at = start
                for level in tree[:-1]:
                    low = at - at % 8
                    run = level[low : low + 8]
                    siblings += run[: at - low] + run[at - low + 1 :]
                    now = sha("".join(run[: at - low] + [now] + run[at - low + 1 :]))
                    at //= 8
            root = upper[-1][0]
            out.append((row[0], brute_leaf(row), levels[-1][0], root, sha("".join(siblings)), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (8, 9, 64, 65), (4096, 4097, 9000, 2)])
def test_manifest_equals_brute_force(spark, tmp_path, sizes):
    """Groups of one chunk, of just more than one, and of several."""
    rows = [(g * 100_000 + i, "s", None if g == 1 else f"l{g}", i, f"Text {i}") for g, n in enumerate(sizes) for i in range(n)]
    got = merkle.tampered_proofs(odd_docs(spark, rows).repartition(7), f"file:{tmp_path}/m")
    assert rows_of(got) == brute_manifest(rows)


def test_manifest_of_odd_rows(spark, tmp_path):
    got = rows_of(merkle.tampered_proofs(odd_docs(spark), f"file:{tmp_path}/m"))
    assert got == brute_manifest(ODD)
    assert {r[-1] for r in got} == {True, False}
    assert merkle.tampered_proofs(odd_docs(spark).limit(0), f"file:{tmp_path}/none").count() == 0


def test_states_are_those_of_sha256():
    for n in (1, 7, 8, 9, 100):
        nodes = [sha(str(k)) for k in range(n)]
        up, before = merkle.parents(merkle._numbers(bytes.fromhex("".join(nodes))))
        assert merkle._hex(up) == brute_level(nodes)
        # A kept state goes on where it was copied: with other children behind it, other digests follow.
        k = n - 1
        slot = np.array([k % 8])
        other = merkle._numbers(bytes.fromhex(sha("other")))
        now = merkle.resume(before[[k]], other, slot, slot + 1, None)
        assert merkle._hex(now) == [sha("".join(nodes[k - k % 8 : k] + [sha("other")]))]


# -- fingerprints ---------------------------------------------------------------------------------------------------


def brute_places(text, gram=winnowing.GRAM, window=winnowing.WINDOW):
    points = winnowing.code_points(text)
    if len(points) < gram:
        return [0] if len(points) else []
    each = [int(x) for x in winnowing.mix(points.astype(winnowing.U) + winnowing.U(winnowing.BASE))]
    hashes = []
    for i in range(len(points) - gram + 1):
        h = 0
        for x in each[i : i + gram]:
            h = (h * winnowing.BASE + x) % (1 << 64)
        hashes.append(int(winnowing.mix(np.array([h], dtype=winnowing.U))[0]))
    out = []
    for i in range(max(1, len(hashes) - window + 1)):
        held = hashes[i : i + window]
        k = i + max(j for j, x in enumerate(held) if x == min(held))
        if not out or out[-1] != k:
            out.append(k)
    return out


def test_winnow_equals_brute_force():
    rng = np.random.default_rng(3)
    for n in (*range(0, 70), 150, 400):
        for signs in ("a", "ab", "abcdefgh é😀"):
            text = "".join(rng.choice(list(signs), n))
            want = brute_places(text)
            assert winnowing.winnow(text)[0].tolist() == want
            assert winnowing.winnow(text, piece=40)[0].tolist() == want
            place, value = winnowing.winnow(text)
            again, short = winnowing.places(winnowing.written(place, value))
            assert again.tolist() == want and (short == value & winnowing.U((1 << 48) - 1)).all()
            assert not len(place) or place[0] < winnowing.WINDOW and (np.diff(place) <= winnowing.WINDOW).all()


def test_shared_passages_share_a_hash():
    """What is as long as the guarantee is found wherever it stands; what is shorter than a run never is."""
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnop "))
    for _ in range(200):
        passage = "".join(rng.choice(letters, winnowing.GRAM + winnowing.WINDOW - 1))
        one, two = ("".join(rng.choice(letters, rng.integers(0, 90))) + passage + "".join(rng.choice(letters, rng.integers(0, 90))) for _ in range(2))
        assert len(np.intersect1d(winnowing.winnow(one)[1], winnowing.winnow(two)[1]))
        short = passage[: winnowing.GRAM - 1]
        assert not len(np.intersect1d(winnowing.winnow("0" * 80 + short + "1" * 80)[1], winnowing.winnow("2" * 80 + short + "3" * 80)[1]))


def brute_fingerprints(docs):
    docs = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (name, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        prints = [winnowing.winnow(x) for x in (text, edited, after)]
        own, changed, other = (set(p[1].tolist()) for p in prints)

        def like(a, b):
            return float(a == b) if not a or not b else len(a & b) / len(a | b)

        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((name, len(text), digest, winnowing.written(*prints[0]), winnowing.written(*prints[1]), like(own, changed), like(own, other)))
    return sorted(out, key=repr)


def test_fingerprints_equal_brute_force(spark):
    docs = [(r[0], r[4]) for r in real_docs()]
    got = rows_of(winnowing.fingerprints(spark.read.parquet(f"{SF}/documents.parquet").repartition(9)))
    assert got == brute_fingerprints(docs)
    same = collections.defaultdict(set)
    for _, _, _, mark, *_ in got:
        same[mark].add(mark)
    assert sum(r[5] for r in got) > 0.4 * len(got) and sum(r[6] for r in got) < 0.01 * len(got)


def test_fingerprints_of_odd_rows(spark):
    want = brute_fingerprints([(r[0], r[4]) for r in ODD])
    for parts in (1, 5):
        assert rows_of(winnowing.fingerprints(odd_docs(spark).repartition(parts))) == want
    alone = odd_docs(spark, [(3, "s", "en", 1, " ".join(f"word{k * k}" for k in range(200)))])
    assert [(r.near_next, r.near_edited < 1) for r in winnowing.fingerprints(alone).collect()] == [(1.0, True)]
    assert winnowing.fingerprints(odd_docs(spark).limit(0)).count() == 0
    ids = [(None, "s", "en", 1, f"text {k}") for k in range(40)]
    assert rows_of(winnowing.fingerprints(odd_docs(spark, ids).repartition(6))) == brute_fingerprints([(r[0], r[4]) for r in ids])
