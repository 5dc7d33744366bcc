"""Operators that look at one document at a time, and the models trained for them, against plain versions."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii, quality, toxicity
from tidemark.session import ship

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, base string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b"), (4, "x"), (4, "x"), (5, "w " * 60_000), (6, "ü\x1c<|>"), (7, "a\nb\n\na\nb b b b b b b")]


@pytest.fixture(autouse=True)
def sent(spark):
    ship(spark)


def odd_docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, None, None, None, "s", "k", "b") for i, t in rows], DOCS)


def real(table, sf=SF):
    return duckdb.sql(f"select * from '{sf}/{table}.parquet'").fetchall()


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {w: windows.count(w) for w in set(windows)} if len(windows) < 3000 else None
    marked = set()
    if seen is None:
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
    for i, w in enumerate(windows):
        if seen[w] > 1:
            marked |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_quality_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality_verdicts(docs, labels).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = sorted(((i, *plain_counts(t)) for i, t in texts), key=repr)
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_on_held_out_labels():
    labels = {i: q for i, q, _ in real("labels", "/root/testdata/sf0.1")}
    docs = [(i, t) for i, t, *_ in real("documents", "/root/testdata/sf0.1") if i in labels]
    stats = [quality.statistics(t.encode())[1] for _, t in docs]
    rows, good = np.array(stats), np.array([float(labels[i]) for i, _ in docs])
    held = np.array([i % 3 == 0 for i, _ in docs])
    forest = quality.fit(rows[~held], good[~held], list(quality.FEATURES.values()))
    assert ((forest.score(rows[held]) >= 0.5) == (good[held] == 1)).mean() > 0.98


def test_forest_is_monotonic():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(800, 3))
    good = ((rows[:, 0] + rows[:, 1] ** 2 + rng.normal(size=800)) < 1).astype(float)
    forest = quality.fit(rows, good, [-1, 0, 1])
    for f, sign in ((0, -1), (2, 1)):
        base = np.repeat(rows[:50], 20, axis=0)
        base[:, f] = np.tile(np.linspace(-3, 3, 20), 50)
        steps = np.diff(forest.score(base).reshape(50, 20), axis=1)
        assert (sign * steps >= -1e-12).all()


def test_quality_without_labels_and_rows(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_verdicts(docs, none)
    assert got.count() == len(ODD) and got.filter("kept").count() == 0
    assert quality.quality_verdicts(docs.limit(0), none).count() == 0
    assert quality.accepted(docs, quality.train(docs, none)).columns == docs.columns


def test_toxicity_folding():
    words = toxicity.folded_words("1d10t! ІDIOT i.d.i.o.t $tupid 1234 'clown', tra$$h$$")
    assert words[:4] == ["idiot", "idiot", "idiot", "stupid"] and words[4] == "clown"
    lexicon = toxicity.Lexicon({"clown": 5.0, "tras": 1.0, "trash": 4.0}, (-3.0, 1.0, 0.1, 0.1))
    automaton = lexicon.automaton()
    assert toxicity.measures(["a", "clown", "fish"], automaton)[2] == 0
    assert toxicity.measures(["trashy"], automaton)[2] == 4.0
    assert toxicity.measures(["xtrash"], automaton)[2] == 0


def test_toxicity_in_words_joined_by_signs():
    words = lambda s: toxicity.folded_words(s)
    assert words("you-idiot") == ["youidiot", "idiot"] and words("fool/1d!ot") == ["foolidiot", "idiot"]
    assert words("“fool|idiot”") == ["foollidiot", "idiot"] and words("well\u2014you_stupid,fool2idiot") == ["wellyoustupidfoolidiot", "you", "stupid", "fool", "idiot"]
    assert words("don't i.d.i.o.t tra$$h 12-1234 ab-1234") == ["dont", "idiot", "trassh", "abiea"] and words("nai\u0308ve 22-idiot") == ["naive", "idiot"]
    lexicon = toxicity.Lexicon({"idio": 4.0, "fool": 2.0}, (-3.0, 1.0, 0.1, 0.1))
    automaton = lexicon.automaton()
    assert toxicity.measures(words("you-idiot"), automaton)[2] == 4.0
    assert toxicity.measures(words("fool/idiot"), automaton)[0] == pytest.approx(np.log1p(6.0))
    assert toxicity.measures(words("idiot-like"), automaton)[0] == pytest.approx(np.log1p(4.0))
    sample = [(words(f"you-idiot {k}x"), 1) for k in range(40)] + [(words(f"you-there {k}x"), 0) for k in range(40)]
    assert any("idiot".startswith(s) for s in toxicity.learn_weights(sample))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in held)
    assert hit / sum(r.toxic for r in held) > 0.9 and hit / sum(r.predicted for r in held) > 0.9


def test_toxicity_odd_rows(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == len(ODD) and all(0 <= r.score < 0.3 and r.predicted == 0 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(pii.digits_of(s)) <= 19 and pii.luhn(pii.digits_of(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(pii.digits_of(s)) <= 15),
]
PERSONAL = [
    (10010, "a@b@c.d e@@f.g x@y.z@w.v, ..@a..a@q.r-s.t"), (10011, "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.4"), (10012, "4111 1111-1111 1111 and 4111111111111112, 1-2"),
    (10013, "ß +1 (826) 555-4081 190. +12 +1 234567890123456"), (10014, "9" * 5000 + "." + "a" * 5000), (10015, 'token = "' + "ab12" * 10 + '"'),
]


def plain_base(text):
    found = [(k, *m.span()) for k, p, ok in PATTERNS for m in re.finditer(p, text) if ok(m.group())]
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(found, key=lambda s: (s[1], pii.ORDER[s[0]])))


def test_personal_data(spark):
    rows = [(i, t) for i, t, *_ in real("documents")] + ODD + PERSONAL
    got = pii.personal_data(odd_docs(spark, rows)).collect()
    want = sorted((str(i), hashlib.sha256(plain_base(t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    for i, text in rows:
        if i is not None and i > 1000:
            assert set(filter(None, plain_base(text or "").split(","))) <= set(by_id[i].spans.split(","))
    assert "secret:9:49" in by_id[10015].spans
    added = [s for r in got for s in r.spans.split(",") if s.startswith("secret")]
    assert added
    assert pii.personal_data(odd_docs(spark).limit(0)).count() == 0


def test_keys_that_hold_a_run_of_card_digits_are_found_whole(spark):
    key = "deadbeef4111111111111111cafebabedeadbeef"
    rows = [(k, f'token = "{hashlib.sha1(str(k).encode()).hexdigest()}"') for k in range(60)] + [(100, f'token = "{key}"'), (101, "pay 4111 1111 1111 1111 now")]
    got = {r.doc_id: r for r in pii.personal_data(odd_docs(spark, rows)).collect()}
    assert pii.base_spans(rows[60][1]) == [("card", 17, 33)]
    assert got[100].spans == "secret:9:49,card:17:33" and got[100].n_card == 1
    assert got[100].base_sha256 == hashlib.sha256(b"card:17:33").hexdigest()
    assert got[101].spans == "card:4:23"
    assert [(k, a, z) for k, a, z, _ in pii.candidates(rows[60][1], pii.base_spans(rows[60][1]))] == [("secret", 9, 49)]


def test_reliabilities_find_the_better_labeler():
    counts = {("secret", "+0++hl"): 90, ("secret", "-000ws"): 900, ("secret", "0000ws"): 500, ("secret", "+000hl"): 5, ("secret", "-0+0ws"): 3}
    post = pii.reliabilities(counts)
    assert post["secret", "+0++hl"] > 0.95 and post["secret", "-000ws"] < 0.05


def test_crc_of_text_is_that_of_spark(spark):
    assert spark.range(3).select(F.crc32(F.col("id").cast("string").cast("binary"))).collect()[2][0] == zlib.crc32(b"2")
