"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Method
    Texts are lower-cased and characters that look like Latin letters are folded to those; in words of letters mixed
    with digits or signs, these are read as the letters they stand for and other signs are dropped; what stands after a
    sign inside such a word is a word of its own besides (its first part begins the whole already). The lexicon holds
    beginnings of words with weights: the log-odds of documents with a word of that beginning, toxic against other,
    learned from labelled documents; of beginnings that occur in the same documents the longest is kept. One automaton
    finds all of them and the exception phrases; a match inside an exception phrase counts nothing. Three numbers of a
    text (the sum of weights, that sum by length, the largest weight) go through a logistic curve, fitted on halves of
    the sample that the other half's lexicon is matched with.

Bounds
    Lexicon and curve are fitted on at most ``SAMPLE_ROWS`` labelled documents, those with the smallest hash of their
    id among those not held out. Every whole text is scored.

Defined cases
    A null or empty text has no match and the curve's lowest score. Null labels are left out, several labels of a
    document count as their largest. Without labels of both kinds the lexicon is empty and every score is 0.
    Rows without ``doc_id`` are scored and not held out; repeated rows get equal scores. Very long texts are matched
    whole. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import string
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import texts

SAMPLE_ROWS = 6000
THRESHOLD = 0.3
LEAST_DOCUMENTS, LEAST_WEIGHT, SHORTEST, LONGEST = 4, 2.5, 3, 14

# Letters of other scripts that look like Latin ones, and signs used in place of letters.
LOOKS_LIKE = {
    "a": "аαａ", "b": "Ьｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ", "g": "ɡｇ", "h": "һｈ", "i": "іιıｉ", "j": "јｊ", "k": "κкｋ", "l": "ⅼӏｌ", "m": "мｍ",
    "n": "ոｎ", "o": "оοσｏ", "p": "рρｐ", "q": "ԛｑ", "r": "ｒг", "s": "ѕｓ", "t": "τтｔ", "u": "υսｕ", "v": "ѵνｖ", "w": "ԝｗ", "x": "хχｘ", "y": "уγｙ", "z": "ｚ",
}
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
EXCEPTIONS = ["clown fish", "trash can", "trash bin", "sore loser", "worthless check", "idiot light", "scum line"]

FOLD = {ord(c): latin for latin, others in LOOKS_LIKE.items() for c in others}
LEET = {ord(c): latin for c, latin in STANDS_FOR.items()}
EDGE = string.punctuation + "“”«»„…’"
LEADING = EDGE.replace("$", "").replace("@", "")
RUN, LETTERS = re.compile(r"[^\W_]+"), re.compile(r"[^\W\d_]+")


def later_parts(inner: str) -> list[str]:
    """Words that begin after a sign inside a token; none is shorter than what the lexicon can hold."""
    if not inner.isascii():
        inner = "".join(c for c in inner if unicodedata.category(c)[0] != "M")
    read = inner.translate(LEET)
    letters = [m.start() for m in LETTERS.finditer(read)]
    starts = {*letters, *(m.start() for m in list(RUN.finditer(inner))[1:])} - {*letters[:1]}
    found = [m for at in sorted(starts) if (m := LETTERS.match(read, at))]
    return [m.group() for m in found if m.end() - m.start() >= SHORTEST and any(c.isalpha() for c in inner[m.start() : m.end()])]


def folded_words(text: str) -> list[str]:
    out = []
    text = text.lower()
    if not text.isascii():
        text = text.translate(FOLD)
    for word in text.split():
        parts = []
        if not word.isalpha():
            inner = word.lstrip(LEADING).rstrip(EDGE)
            if not inner.isalpha():
                parts = later_parts(inner)
                inner = "".join(c for c in inner.translate(LEET) if c.isalpha()) if any(c.isalpha() for c in inner) else ""
            word = inner
        if word:
            out.append(word)
            out += parts
    return out


@dataclass
class Lexicon:
    """Beginnings of words with weights, and the curve over what they add up to."""

    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-30.0, 0.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = tuple(EXCEPTIONS)

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for stem, weight in self.weights.items():
            made.add_word(" " + stem, (len(stem), weight))
        for phrase in self.exceptions:
            made.add_word(f" {phrase} ", (len(phrase), None))
        made.make_automaton()
        return made


def measures(words: list[str], automaton) -> list[float]:
    """Sum of weights, sum by length, largest weight; of the beginnings of one word the heaviest counts."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (size, weight) in automaton.iter(" " + " ".join(words) + " "):
            if weight is None:
                spared.append((end - size - 1, end))
            else:
                best[end - size] = max(weight, best.get(end - size, 0.0))
    found = [w for at, w in best.items() if not any(a <= at < z for a, z in spared)]
    total = sum(found)
    return [math.log1p(total), 100 * total / (len(words) + 30), max(found, default=0.0)]


def learn_weights(sample: list[tuple[list[str], int]]) -> dict[str, float]:
    bad, rest = Counter(), Counter()
    number = [sum(1 - t for _, t in sample), sum(t for _, t in sample)]
    for count, label in ((bad, 1), (rest, 0)):
        for words in (words for words, toxic in sample if toxic == label):
            stems = {w[:k] for w in set(words) for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}
            count.update(stems if label else stems & bad.keys())
        if label:
            bad = count = Counter({s: n for s, n in bad.items() if n >= LEAST_DOCUMENTS})
    chosen = {}
    for stem, n in bad.items():
        weight = math.log((n + 0.5) / (number[1] + 1)) - math.log((rest[stem] + 0.5) / (number[0] + 1))
        if weight >= LEAST_WEIGHT:
            chosen[stem] = weight
    shorter = {s[:-1] for s in chosen if len(s) > SHORTEST and bad[s] == bad[s[:-1]] and rest[s] == rest[s[:-1]]}
    return {s: w for s, w in sorted(chosen.items()) if s not in shorter}


def fit_curve(rows: np.ndarray, toxic: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Logistic regression by Newton steps; the measures may only raise the score."""
    x = np.hstack([np.ones((len(rows), 1)), rows])
    use = np.ones(x.shape[1], dtype=bool)
    while True:
        beta = np.zeros(x.shape[1])
        xs = x[:, use]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(xs @ beta[use], -30, 30)))
            h = (xs * (p * (1 - p))[:, None]).T @ xs + ridge * np.eye(use.sum())
            beta[use] += np.clip(np.linalg.solve(h, xs.T @ (toxic - p) - ridge * beta[use]), -3, 3)
        wrong = use & (beta < 0) & (np.arange(len(beta)) > 0)
        if not wrong.any():
            return tuple(float(b) for b in beta)
        use &= ~wrong


def learn(sample: list[tuple[list[str], int]]) -> Lexicon:
    if len({t for _, t in sample}) < 2:
        return Lexicon()
    halves = [sample[::2], sample[1::2]]
    rows, marks = [], []
    for own, other in (halves, halves[::-1]):
        automaton = Lexicon(learn_weights(other)).automaton()
        rows += [measures(words, automaton) for words, _ in own]
        marks += [t for _, t in own]
    return Lexicon(learn_weights(sample), fit_curve(np.array(rows), np.array(marks, dtype=float)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    named = named.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    sample = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def fold(batches):
        for batch in batches:
            whole = [" ".join(folded_words(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(whole, pa.string())], ["doc_id", "toxic", "words"])

    joined = texts(docs).join(F.broadcast(sample), "doc_id").mapInArrow(fold, "doc_id long, toxic int, words string")
    found = sorted((r.doc_id, r.words, r.toxic) for r in joined.toLocalIterator())
    return learn([(words.split(), min(1, max(0, toxic))) for _, words, toxic in found])


OUT = "doc_id long, held_out boolean, score double, predicted int, hits double"


def scores(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the sum of weights per row of ``docs``."""

    def run(batches):
        automaton, curve = lexicon.automaton(), np.array(lexicon.curve)
        for batch in batches:
            rows = np.array([measures(folded_words(t), automaton) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, 3)
            score = 1 / (1 + np.exp(-np.clip(curve[0] + rows @ curve[1:], -40, 40)))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(np.expm1(rows[:, 0]))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")])

    return texts(docs).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, OUT)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, train(docs, labels))
