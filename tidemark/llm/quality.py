"""Quality rules: fixed limits, then gradient-boosted trees over document statistics.

Method
    Trees are grown on binned statistics of labelled documents with logistic loss. A split on a constrained
    statistic is taken only if its children's values keep the order asked for, and both sides pass their midpoint on
    as a bound, so the whole score is monotonic in it. The grown trees are flattened into numpy arrays of nodes
    (statistic, threshold, children, value) and all rows of a batch walk all trees at once.

Bounds
    The trees are fitted on at most ``SAMPLE_ROWS`` labelled documents, those with the smallest hash of their id.
    Statistics and verdicts cover every row and its whole text.

Defined cases
    A null text is an empty one. A document fails the fixed limits if it has under ``MIN_WORDS`` words or more than
    ``MAX_REPEAT`` percent of its words in repeated windows; such a document is not kept whatever the trees say.
    Labels that are null are left out, several labels of one document count as their largest, and without labels of
    both kinds the trees accept everything. Other columns are not looked at; repeated rows get equal verdicts. Very
    long texts are counted whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import as_bytes, texts

SAMPLE_ROWS = 6000
MIN_WORDS, MAX_REPEAT = 50, 50
REJECT_BELOW = 0.5
SYMBOLS = b"#*$%&|<>"
CAPITALS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))

# Statistic and the direction in which it may move the score: -1 only down, 1 only up, 0 either way.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "repeated_lines": -1,
    "repeated_words": -1,
    "capitals": -1,
    "exclamations": -1,
    "digits": 0,
    "distinct_words": 0,
    "top_word": -1,
    "words_per_line": 0,
    "stops_per_word": 0,
}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which occurs at least twice, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    marked = bytearray(len(words))
    for i, window in enumerate(windows):
        if count[window] > 1:
            marked[i] = marked[i + 1] = marked[i + 2] = 1
    return sum(marked)


def statistics(data: bytes) -> tuple[tuple[int, ...], list[float]]:
    """The counts of the fixed rules, and the statistics that the trees look at."""
    words = data.split()
    n = len(words)
    joined = b"".join(words)
    word_chars = len(joined.decode("utf-8"))
    n_symbols = sum(data.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS)))
    lines = [line for line in data.split(b"\n") if line.strip()]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    counts = (n, word_chars, n_symbols, n_dup_lines, n_repeat)
    if not n:
        return counts, [0.0] * len(FEATURES)
    kinds = Counter(words)
    chars = max(1, len(joined))
    return counts, [
        float(np.log1p(n)),
        word_chars / n,
        n_symbols / n,
        n_dup_lines / max(1, len(lines)),
        n_repeat / n,
        1 - len(joined.translate(None, CAPITALS)) / chars,
        joined.count(b"!") / n,
        1 - len(joined.translate(None, DIGITS)) / chars,
        len(kinds) / n,
        max(kinds.values()) / n,
        n / max(1, len(lines)),
        (joined.count(b".") + joined.count(b",")) / n,
    ]


@dataclass(frozen=True)
class Forest:
    """All trees' nodes one after the other; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The probability of good quality per row."""
        total = np.full(len(rows), self.base)
        if len(self.roots) and len(rows):
            at = np.repeat(self.roots[None, :], len(rows), axis=0)
            pick = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                at = np.where(rows[pick, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total = total + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, good: np.ndarray, directions, trees=40, depth=3, rate=0.2, bins=32, least=8, ridge=1.0) -> Forest:
    """Boosts trees on rows of statistics and 0/1 labels, in the order of the rows given."""
    share = float(good.mean()) if len(good) else 1.0
    if share in (0.0, 1.0):
        return Forest(*(np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int)), depth, 20.0)
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    nodes: list[list] = []
    roots, base = [], float(np.log(share / (1 - share)))
    margin = np.full(len(rows), base)

    def leaf_value(g: float, h: float, low: float, high: float) -> float:
        return min(max(-g / (h + ridge), low), high)

    def best_split(at: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        total_g, total_h, best = g[at].sum(), h[at].sum(), None
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            bin_g = np.cumsum(np.bincount(binned[at, f], g[at], len(cut) + 1))[:-1]
            bin_h = np.cumsum(np.bincount(binned[at, f], h[at], len(cut) + 1))[:-1]
            number = np.cumsum(np.bincount(binned[at, f], minlength=len(cut) + 1))[:-1]
            left = np.clip(-bin_g / (bin_h + ridge), low, high)
            right = np.clip(-(total_g - bin_g) / (total_h - bin_h + ridge), low, high)
            gain = bin_g**2 / (bin_h + ridge) + (total_g - bin_g) ** 2 / (total_h - bin_h + ridge) - total_g**2 / (total_h + ridge)
            gain[(number < least) | (len(at) - number < least) | (directions[f] * (right - left) < 0)] = 0
            k = int(gain.argmax())
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), f, k, float(left[k]), float(right[k]))
        return best

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        here = len(nodes)
        value = leaf_value(g[at].sum(), h[at].sum(), low, high)
        nodes.append([0, np.inf, here, here, rate * value])
        split = best_split(at, g, h, low, high) if level < depth and len(at) >= 2 * least else None
        if split is None:
            margin[at] += rate * value
            return here
        _, f, k, left, right = split
        middle = (left + right) / 2
        go_left = binned[at, f] <= k
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[directions[f]]
        nodes[here][:2] = [f, float(cuts[f][k])]
        nodes[here][2] = grow(at[go_left], g, h, level + 1, *bounds[0])
        nodes[here][3] = grow(at[~go_left], g, h, level + 1, *bounds[1])
        return here

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(rows)), p - good, p * (1 - p), 0, -np.inf, np.inf))
    feature, threshold, left, right, value = zip(*nodes)
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)


def _stats_only(batches):
    for batch in batches:
        rows = [statistics(x)[1] for x in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "good", "stats"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fits the trees on at most ``sample_rows`` labelled documents."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
    named = named.filter("doc_id IS NOT NULL AND good IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"))
    sample = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    joined = texts(docs).join(F.broadcast(sample), "doc_id")
    found = joined.mapInArrow(_stats_only, "doc_id long, good int, stats array<double>").collect()
    found.sort(key=lambda r: (r.doc_id, r.stats))
    rows = np.array([r.stats for r in found]).reshape(len(found), len(FEATURES))
    return fit(rows, np.array([r.good for r in found], dtype=float), list(FEATURES.values()))


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """Counts, the fixed rules' verdict, the trees' score and the final verdict per row of ``docs``."""

    def run(batches):
        for batch in batches:
            made = [statistics(x) for x in as_bytes(batch.column("text"))]
            counts = np.array([m[0] for m in made], dtype=np.int64).reshape(len(made), 5)
            score = forest.score(np.array([m[1] for m in made]).reshape(len(made), len(FEATURES)))
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT * counts[:, 0])
            columns = [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(5))]
            columns += [pa.array(failed), pa.array(~failed & (score >= REJECT_BELOW)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")])

    return texts(docs).mapInArrow(run, OUT)


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, train(docs, labels))


def accepted(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; the verdict is taken beside the row, without a join."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def passes(text):
        made = [statistics(x.encode()) for x in text]
        counts = np.array([m[0] for m in made], dtype=np.int64).reshape(len(made), 5)
        score = forest.score(np.array([m[1] for m in made]).reshape(len(made), len(FEATURES)))
        import pandas as pd

        return pd.Series((counts[:, 0] >= MIN_WORDS) & (100 * counts[:, 4] <= MAX_REPEAT * counts[:, 0]) & (score >= REJECT_BELOW))

    return docs.filter(passes(F.coalesce("text", F.lit(""))))
