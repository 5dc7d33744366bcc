"""Operators over the whole corpus against brute-force versions, and odd input."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import chat_trees, components, decontaminate, line_dedup, link_trust, mixing, near_dup, token_files
from tidemark.llm import text as text_module
from tidemark.llm.queries import tokenizer_path
from tidemark.session import ship

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, node string, label string"


@pytest.fixture(autouse=True)
def sent(spark):
    ship(spark)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "h", "n", "l") for i, t, s in rows], DOCS)


def real(table, sf=SF):
    return duckdb.sql(f"select * from '{sf}/{table}.parquet'").fetchall()


def shingle_set(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_components(rows):
    sets, holders, root = {}, collections.defaultdict(list), {}
    for i, t in rows:
        sets[i] = shingle_set(t)
        root[i] = i
        for s in sets[i]:
            holders[s].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(n):
    """Groups of edited copies of long and short texts, and texts that share a passage only."""
    rng, rows = np.random.default_rng(5), []
    for g in range(4):
        base = [f"w{g}_{k}" for k in range((30, 60, 200, 12)[g])]
        for _ in range(n):
            words = list(base)
            for _ in range(rng.integers(0, 3)):
                words[rng.integers(len(words))] = f"x{rng.integers(1000)}"
            rows.append(" ".join(words))
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [passage + " " + " ".join(f"u{g}_{k}" for k in range(50)) for g in range(n)]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = [(i, t) for i, t, *_ in real("documents")] + [(5000 + k, t) for k, t in enumerate(near_copies(60))]
    want = brute_components(rows)
    got = near_dup.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(spark):
    words = " ".join(f"w{k}" for k in range(20))
    rows = [(1, None), (2, ""), (3, " \t"), (None, words), (9, words), (7, words), (7, words), (8, "A b"), (12, "a B"), (13, "a b c"), (20, "q " * 50_000), (21, "q"), (30, "one two three four five six"), (31, "x y z u v w"), (30, "x y z u v w")]
    docs = docs_of(spark, [(i, t, None) for i, t in rows])
    got = collections.Counter(tuple(r) for r in near_dup.near_duplicates(docs).collect())
    assert got[(7, 16, 7, True)] == 2 and got[(9, 16, 7, False)] == 1 and got[(None, 16, None, True)] == 1
    assert got[(1, 0, 1, True)] == got[(2, 0, 2, True)] == got[(3, 0, 3, True)] == 1
    assert got[(12, 1, 8, False)] == got[(13, 1, 13, True)] == got[(20, 1, 20, True)] == got[(21, 1, 21, True)] == 1
    assert got[(31, 2, 30, False)] == 1  # by way of the two texts of 30
    kept = near_dup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 7, 8, 13, 20, 21, 30]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_agrees_with_similarity():
    for n in (1, 3, 40, 2000):
        a = text_module.seeds(n, 1)
        assert (near_dup.sketch(a) != near_dup.EMPTY).all()
    both, own = text_module.seeds(300, 2), text_module.seeds(100, 3)
    share = (near_dup.sketch(both) == near_dup.sketch(np.concatenate((both, own)))).mean()
    assert abs(share - 0.75) < 0.12


def test_word_hashes_of_long_texts_do_not_depend_on_segments(monkeypatch):
    data = ("Ab\tcdé  \x0bx " * 3000).encode()
    whole = text_module.word_hashes(data)
    monkeypatch.setattr(text_module, "SEGMENT", 100)
    assert (text_module.word_hashes(data) == whole).all() and len(whole) == 9000


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 150)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and all(got[k] == 100 for k in range(101, 160)) and got[200] == 100


def test_decontamination_equals_sql(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.execute(decontaminate.contaminated_sql()).fetchall())
    got = sorted(tuple(r) for r in decontaminate.contaminated(docs, items).collect())
    assert got == want and want


def test_decontamination_odd_rows(spark):
    item = " ".join(f"w{k}" for k in range(24))
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, "a b c d e f"), (4, "Short one"), (5, "g h i j k l m n")], "item_id long, text string")
    fill = " ".join(f"z{k % 700}" for k in range(90_000))
    scattered = " ".join(f"g h i j k {fill[:200]}" if k else "i j k l m n" for k in (1, 0)) + " h i j k l m"
    rows = [(1, item.upper()), (1, item), (2, fill + " " + item + " " + fill), (3, " ".join(item.split()[:21])), (4, " ".join(item.split()[:16])), (None, item), (5, None), (6, ""), (7, "short ONE"), (8, "short one x"), (9, scattered), (10, "a b c d e f")]
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_common) for r in decontaminate.contaminated(docs_of(spark, [(i, t, None) for i, t in rows]), items).collect()}
    assert got == {(1, 1): (20, 20), (2, 1): (20, 20), (3, 1): (20, 17), (7, 4): (1, 1), (9, 5): (4, 4)}
    empty = docs_of(spark, [(1, "a", None)]).limit(0)
    assert decontaminate.contaminated(empty, items).count() == decontaminate.contaminated(docs_of(spark, [(1, item, None)]), items.limit(0)).count() == 0


def test_a_common_sentence_makes_no_pair_of_every_document_and_item(spark):
    """Items that open alike, and documents that hold that opening and little else: no pair is counted; real copies are."""
    import glob

    opening = " ".join(f"open{k}" for k in range(12))
    items = [(i, opening + " " + " ".join(f"i{i}w{k}" for k in range(40))) for i in range(60)]
    docs = [(d, opening + " " + " ".join(f"d{d}w{k}" for k in range(60)), "s") for d in range(400)] + [(1000 + i, "x " + t + " y", "s") for i, t in items[:5]]
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(glob.glob(f"{root}/contained-candidates-*"))
    found = decontaminate.contaminated(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1000 + i, i) for i in range(5)}
    made = set(glob.glob(f"{root}/contained-candidates-*")) - before
    assert spark.read.parquet(*[f"file:{p}" for p in made]).count() <= 5 * len(items)


def test_line_dedup_odd_rows(spark):
    rows = [(2, "a\nb\nc\nd\nx"), (1, "z\na\nb\nc\nd"), (3, "a\nb\nc"), (4, "a\nb"), (5, None), (6, "\n\n\n\n"), (7, "q\nq\nq\nq\nq\nq"), (None, "m\nn\no"), (8, "m\nn\no"), (9, "k\nl\nm"), (9, "k\nl\nm"), (10, "y\n" * 20_000)]
    got = collections.defaultdict(list)
    for r in line_dedup.without_repeated_lines(docs_of(spark, [(i, t, None) for i, t in rows])).collect():
        got[r.doc_id].append((r.text, r.n_lines, r.n_removed))
    assert got[1] == [("z\na\nb\nc\nd", 5, 0)] and got[2] == [("x", 5, 4)] and got[3] == [("", 3, 3)] and got[4] == [("a\nb", 2, 0)]
    assert got[5] == [("", 1, 0)] and got[6] == [("\n\n\n\n", 5, 0)] and got[7] == [("q", 6, 5)]
    assert got[None] == [("m\nn\no", 3, 0)] and got[8] == [("", 3, 3)] and got[9] == [("k\nl\nm", 3, 0)] * 2
    assert got[10][0][1:] == (20_001, 19_999)
    assert line_dedup.without_repeated_lines(docs_of(spark, [(1, "a", None)]).limit(0)).count() == 0


def test_mixing(spark):
    rows = [(k, "w " * (k % 7 + 1), "big" if k % 3 else f"s{k % 9}") for k in range(2000)] + [(None, "a b", None), (None, "a b", None), (5000, None, "empty"), (5001, "", "empty")]
    docs = docs_of(spark, rows)
    got = mixing.schedule(docs).collect()
    used = collections.Counter(r.doc_id for r in got)
    assert set(used) == {i for i, *_ in rows} and used[5000] == used[5001] == 1
    tokens = collections.Counter()
    whole = collections.Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
    for i, t, s in rows:
        whole[s] += len((t or "").split())
    rates = {s: tokens[s] / n for s, n in whole.items() if n}
    assert 0.97 < rates["big"] <= 1 and max(rates.values()) <= mixing.REPETITION + 1e-9
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == len(got)
    assert mixing.schedule(docs.limit(0)).count() == 0
    totals = spark.createDataFrame([("a", 900), ("b", 50), ("c", 50)], "_mix_source string, tokens long")
    power, _ = mixing.exponent(totals, repetition=None, entropy=1.0)
    w = np.array([0.9, 0.05, 0.05]) ** power
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-6
    half = mixing.schedule(docs, repetition=4.0, budget=2000).collect()
    assert 1500 < sum(r.n_tokens for r in half) <= 2000 + 2


ODD_TEXTS = [(3, "b c"), (1, None), (2, ""), (None, "x"), (3, "a"), (3, "a"), (-5, '<|endoftext|> "it\'s" É\u0301. İ, Ab,'), (9, "long " * 40_000), (10, "y" * 3000)]


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t, *_ in real("documents")] + ODD_TEXTS
    folder = f"file:{tmp_path}/tokens"
    token_files.write_tokens(docs_of(spark, [(i, t, None) for i, t in rows]), folder, tokenizer_path(), block_ids=50_000)
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter((i, tuple([*e.ids, 1])) for (i, _), e in zip(rows, tok.encode_batch([t or "" for _, t in rows], add_special_tokens=False)))
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in got) == want
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens


def test_blocks_decode_from_checkpoints_and_find_damage(monkeypatch):
    monkeypatch.setattr(token_files, "CHECKPOINT_IDS", 4096)
    ids = (np.random.default_rng(3).zipf(1.3, 40_000) % 5000).astype(np.uint16)
    model = token_files.Model(token_files.frequencies(np.bincount(ids, minlength=token_files.VOCABULARY)))
    payload = token_files.encode_block(ids, model)
    assert (token_files.decode_block(payload, model) == ids).all()
    assert (token_files.decode_block(payload, model, 3, 5) == ids[3 * 4096 : 5 * 4096]).all()
    monkeypatch.undo()
    assert len(token_files.encode_block(ids, model)) < 1.5 * len(ids)
    with pytest.raises(ValueError):
        token_files.decode_block(payload[:-1] + bytes([payload[-1] ^ 1]), model)
    for n in (0, 1, 2, 31, 33, 1000):
        assert (token_files.decode_block(token_files.encode_block(ids[:n], model), model) == ids[:n]).all()


def test_short_ways_to_ids_equal_the_tokenizer(monkeypatch):
    """Random odd texts: controls, ligatures, contractions, combining marks, special tokens, signs behind letters."""
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "false")
    words = token_files.Words(tokenizer_path())
    rng = np.random.default_rng(17)
    plain = list("aZQtsrve 0'.,!?<|>_-$%*#&;:()\"/\\~`^@[]{}=+\t\r\n") + ["<|endoftext|>", "<|STARTOFTEXT|>", "\x00", "\x0b", "\x1c", "'re", "'S", "  ", "word", "The", "..."]
    signs = plain + list("éÑßœŒ’²٣ſﬁΣς日😀İ") + ["\u0301", "\u0308", "\xa0", "\u2009", "\x85"]
    texts = ["".join(rng.choice(some, rng.integers(1, 25))) for some in (plain, signs) for _ in range(20_000)]
    want = [np.array(e.ids, dtype="<u2").tobytes() for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [words.ids(t) for t in texts] == want


def test_token_files_of_an_empty_table(spark, tmp_path):
    token_files.write_tokens(docs_of(spark, [(1, "a", None)]).limit(0), f"file:{tmp_path}/none", tokenizer_path())
    assert token_files.read_tokens(spark, f"file:{tmp_path}/none").count() == 0


def test_frequencies_sum_up():
    for counts in ([1], [10**12, 1, 0, 1], [1] * 49_408, list(range(49_000))):
        freq = token_files.frequencies(np.array(counts))
        assert freq.sum() == 1 << token_files.SCALE and ((freq > 0) == (np.array(counts) > 0)).all()


CHATS = "conv_id long, turn long, role string, text string, path string, keys string"


def chats_of(spark, rows):
    return spark.createDataFrame([(*r, "p", "k") for r in rows], CHATS)


def test_chat_trees_share_turns_and_read_back(spark, tmp_path):
    rows = []
    for k in range(300):
        rows += [(k, 0, "system", "be <kind>"), (k, 1, "user", f"q{k % 5}"), (k, 2, "assistant", f"a\\{k % 50} </turn>")]
    rows += [(400, 0, "system", "be <kind>"), (401, 0, None, None), (402, 1, "assistant", "x"), (402, 1, "assistant", "x"), (None, 0, "user", "é" * 10), (403, None, "assistant", "")]
    folder = f"file:{tmp_path}/trees"
    chat_trees.write_trees(chats_of(spark, rows), folder, pack_chars=500)
    want = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want[c].append((r or "", x or ""))
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in chat_trees.read_digests(spark, folder).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        formatted = sum(len(chat_trees.format_turn(r, x)[0]) for r, x in turns)
        assert tuple(got[c])[1:] == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), formatted)
    for pack in spark.read.parquet(f"{folder}/packs").collect():
        siblings = collections.Counter((n.parent, pack.sequence[n.start : n.start + n.length]) for n in pack.nodes)
        assert max(siblings.values()) == 1  # no turn is written twice below the same parent
        for n in pack.nodes:
            up, reach = n.parent, set()
            while up >= 0:
                reach |= set(range(pack.nodes[up].start, pack.nodes[up].start + pack.nodes[up].length))
                up = pack.nodes[up].parent
            assert reach == {i for s in n.attends for i in range(s["from"], s["to"])} and n.position == len(reach)
    chat_trees.write_trees(chats_of(spark, rows).limit(0), f"file:{tmp_path}/none")
    assert chat_trees.read_digests(spark, f"file:{tmp_path}/none").count() == 0


def test_rows_without_a_conversation_and_very_long_turns(spark, tmp_path):
    long = [(1, 0, "user", "<x>" * 150_000), (1, 1, "assistant", "é\\" * 150_000)]
    folder = f"file:{tmp_path}/trees"
    chat_trees.write_trees(chats_of(spark, [(None, 0, "assistant", f"a{k % 3}") for k in range(60)] + long), folder, pack_chars=500)
    got = chat_trees.read_digests(spark, folder).collect()
    alone = collections.Counter((r.n_turns, r.loss_chars, r.turns_sha256) for r in got if r.conv_id is None)
    assert len(got) == 61 and sorted(alone.values()) == [20, 20, 20] and {k[:2] for k in alone} == {(1, 2)}
    whole = next(r for r in got if r.conv_id == 1)
    import hashlib

    assert whole.loss_sha256 == hashlib.sha256(long[1][3].encode()).hexdigest() and whole.n_turns == 2


def test_long_shared_turns_are_not_written_for_every_conversation(spark, tmp_path):
    prompt = "p" * 2000
    rows = [(k, t, r, x) for k in range(40) for t, (r, x) in enumerate((("system", prompt), ("user", f"question {k}")))]
    folder = f"file:{tmp_path}/long"
    chat_trees.write_trees(chats_of(spark, rows), folder, pack_chars=500)
    packs = spark.read.parquet(f"{folder}/packs").collect()
    assert sum(p.sequence.count(prompt) for p in packs) == len(packs) <= 12
    got = chat_trees.read_digests(spark, folder).collect()
    assert sorted(r.conv_id for r in got) == list(range(40))
    assert all(r.formatted_chars == sum(len(chat_trees.format_turn(g, x)[0]) for c, _, g, x in rows if c == r.conv_id) for r in got)


PAGES = "page_id long, url string, html string, host string, rule string, trust string"


def test_url_rules(spark):
    urls = ["http://A.example.ORG/es/1", "x://example.org/en/12?q", "https://example.org/en/2#t", "http://notexample.org/es/", "http://a.com/fr/", "http://a.com/de/x", "http://a.com", "http://org", "http://b.org/", None, "nothing", "://?x", "http://h.net?://z/fr/", "http://com.net/fr/"]
    pages = spark.createDataFrame([(k, u, None, "h", "r", "t") for k, u in enumerate(urls)], PAGES)
    got = [(r.host, r.path, r.rule, r.verdict) for r in sorted(link_trust.url_verdicts(pages).collect(), key=lambda r: r.page_id)]
    assert got[:6] == [("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("notexample.org", "/es/", "org/", "allow"), ("a.com", "/fr/", "com/fr/", "allow"), ("a.com", "/de/x", "com/de/", "block")]
    assert got[6][:3] == ("a.com", "", None) and got[7][:3] == ("org", "", None) and got[8] == ("b.org", "/", "org/", "allow")
    assert [g[:2] for g in got[9:13]] == [("", ""), ("", ""), ("", ""), ("h.net", "")] and got[13][2] is None
    assert link_trust.url_verdicts(pages.limit(0)).count() == 0


def test_link_trust_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    hosts = [f"h{k}.net" for k in range(30)] + ["good.org", "bad.com"]
    pages, links = [], collections.Counter()
    for k in range(400):
        src, dst = hosts[rng.integers(len(hosts))], hosts[rng.integers(len(hosts))]
        pages.append((k, f"http://{src}/" + ("de/" if src == "bad.com" else ""), f"<a class=x HREF='https://{dst.upper()}/p'>x</a><a href=\"/local\">", "h", "r", "t"))
        if src != dst:
            links[src, dst] += 1
    got = {r.host: (r.trust, r.distrust, r.verdict) for r in link_trust.url_verdicts(spark.createDataFrame(pages, PAGES)).collect()}

    def rank(edges, seed):
        out = collections.Counter()
        for (s, _), w in edges.items():
            out[s] += w
        score = {seed: 1 - link_trust.DAMPING}
        for _ in range(link_trust.ROUNDS):
            new = collections.Counter({seed: 1 - link_trust.DAMPING})
            for (s, d), w in edges.items():
                new[d] += link_trust.DAMPING * score.get(s, 0) * w / out[s]
            score = new
        return score

    trust, distrust = rank(links, "good.org"), rank(collections.Counter({(d, s): w for (s, d), w in links.items()}), "bad.com")
    for h, (t, d, verdict) in got.items():
        assert abs(t - trust[h]) < 1e-9 and abs(d - distrust[h]) < 1e-9
        if h.endswith(".net"):
            assert verdict == ("block" if d >= link_trust.MARGIN * t and d > link_trust.FLOOR * (1 - link_trust.DAMPING) else "allow")


def test_distrust_reaches_the_end_of_a_chain(spark):
    hosts = ["bad.com", *(f"c{k}.net" for k in range(1, 21))]
    pages = [(k, f"http://{h}/" + ("" if k else "de/"), f"<a href='http://{hosts[k - 1]}/'>" if k else None, "h", "r", "t") for k, h in enumerate(hosts)]
    got = {r.host: (r.distrust, r.verdict) for r in link_trust.url_verdicts(spark.createDataFrame(pages, PAGES)).collect()}
    for k, h in enumerate(hosts):
        assert abs(got[h][0] - 0.15 * 0.85**k) < 1e-9 and got[h][1] == ("block" if k <= 14 else "allow")


def test_trust_in_a_cycle_is_the_fixed_point(spark):
    pages = [(1, "http://good.org/", "<a href='http://a.net'>", "h", "r", "t"), (2, "http://a.net/", "<a href='http://good.org'>", "h", "r", "t")]
    got = {r.host: r.trust for r in link_trust.url_verdicts(spark.createDataFrame(pages, PAGES)).collect()}
    good = 0.15 / (1 - 0.85**2)
    assert abs(got["good.org"] - good) < 1e-9 and abs(got["a.net"] - 0.85 * good) < 1e-9
