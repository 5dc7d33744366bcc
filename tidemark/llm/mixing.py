"""Mixing sources to target weights by temperature, realised as block permutations under a token budget.

Method
    A source's token share is raised to an exponent between 0 and 1 and normalised. The exponent is bisected: for a
    repetition limit to the smallest one (flattest mix) whose most repeated source stays within it, for an entropy
    to the one whose weights have it. Without a budget the mix is as large as it must be for every document to be
    used at least once. Each source is cut into 16^3 blocks by a hash of ``doc_id``; in every epoch the blocks are
    permuted anew. Whole epochs take every document; the last, partial epoch takes blocks in their permuted order
    until the source's budget is used, and within the block at the boundary documents in hash order while they fit.

Results
    One row per use of a document: ``epoch``, ``block`` and ``place``, by which the uses of an epoch are ordered.

Defined cases
    A token is a word. A null source is a source of its own; a null text has no words; documents without ``doc_id``
    share one hash. Equal rows get equal places and are taken or left together. A source without words has no
    weight; its documents are used once. An empty table gives an empty result. Other columns pass through ``mixed``.
    Very long texts are counted whole.

Scale
    Only ids and counts are shuffled: per source and per (source, block). The boundary of a source is a hash value
    that each document compares itself with, so no source is ever sorted or gathered. The shares of all sources
    are one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import WORD
from tidemark.workspace import materialize

REPETITION = 1.25
STEPS = 60


def _keyed(docs: DataFrame) -> DataFrame:
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.withColumns({"_mix_source": name, "_mix_digest": digest, "_mix_words": words})


def _place(epoch) -> F.Column:
    """Where the block of a row stands in the permutation of an epoch."""
    return F.md5(F.concat_ws("|", F.col("_mix_source"), F.substring("_mix_digest", 1, 3), epoch.cast("string")).cast("binary"))


def exponent(totals: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: float | None = None) -> tuple[float, float]:
    """The bisected exponent, and the factor by which ``share ^ (exponent - 1)`` gives a source's repetitions."""
    if (repetition is None) == (entropy is None):
        raise ValueError("give either a repetition limit or an entropy")
    shares = totals.filter("tokens > 0").agg(F.sort_array(F.collect_list("tokens")).alias("t"), F.sum("tokens").alias("total"))
    shares = shares.selectExpr("transform(t, x -> x / total) AS p", "total")
    most = "array_max(transform(p, x -> pow(x, m - 1)))"
    weights = "aggregate(p, 0D, (a, x) -> a + pow(x, m))"
    scale = "1 / array_min(transform(p, x -> pow(x, m - 1)))" if budget is None else f"({float(budget)!r} / total) / {weights}"
    if entropy is None:
        flat_enough = f"{most} * {scale} > {float(repetition)!r}"
    else:
        flat_enough = f"ln({weights}) - m * aggregate(p, 0D, (a, x) -> a + pow(x, m) * ln(x)) / {weights} > {float(entropy)!r}"
    # Beyond the limit the exponent has to grow; each step halves the interval that holds it.
    step = f"""aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (s, i) -> transform(array((s.lo + s.hi) / 2),
               m -> CASE WHEN {flat_enough} THEN named_struct('lo', m, 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', m) END)[0]).hi"""
    row = shares.filter("size(p) > 0").selectExpr("p", "total", f"{step} AS e").selectExpr("e", f"transform(array(e), m -> {scale})[0] AS f").first()
    return (row.e, row.f) if row else (1.0, 1.0)


def decisions(keyed: DataFrame, **target) -> DataFrame:
    """Per source: tokens, whole epochs, and up to which block and which document the partial epoch goes."""
    light = keyed.select("_mix_source", "_mix_digest", "_mix_words")
    totals = materialize(light.groupBy("_mix_source").agg(F.sum("_mix_words").alias("tokens")), "source-tokens")
    power, factor = exponent(totals, **target)
    total = totals.agg(F.sum("tokens")).first()[0] or 1
    goal = F.round(F.col("tokens") * F.pow(F.col("tokens") / F.lit(total), F.lit(power - 1)) * F.lit(factor)).cast("long")
    plan = totals.withColumn("goal", F.when(F.col("tokens") > 0, goal).otherwise(F.lit(0)))
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("goal div tokens")).otherwise(F.lit(1)))
    plan = materialize(plan.withColumn("rest", F.col("goal") - F.when(F.col("tokens") > 0, F.col("whole") * F.col("tokens")).otherwise(F.lit(0))), "mix-plan")

    sized = light.join(plan.filter("rest > 0").select("_mix_source", "whole", "rest"), "_mix_source").withColumn("at", _place(F.col("whole")))
    blocks = sized.groupBy("_mix_source", "at", "rest").agg(F.sum("_mix_words").alias("words"))
    run = Window.partitionBy("_mix_source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("upto", F.sum("words").over(run)).filter("upto >= rest AND upto - words < rest")
    edge = materialize(blocks.groupBy("_mix_source").agg(F.min("at").alias("at"), F.min(F.expr("rest - upto + words")).alias("left")), "mix-edges")
    inside = sized.select("_mix_source", "at", "_mix_digest", "_mix_words").join(edge, ["_mix_source", "at"])
    peers = Window.partitionBy("_mix_source").orderBy("_mix_digest").rangeBetween(Window.unboundedPreceding, 0)
    cut = inside.withColumn("upto", F.sum("_mix_words").over(peers)).filter("upto <= left").groupBy("_mix_source").agg(F.max("_mix_digest").alias("cut"))
    out = plan.select("_mix_source", "whole").join(edge.select("_mix_source", F.col("at").alias("edge")), "_mix_source", "left").join(cut, "_mix_source", "left")
    return materialize(out, "mix-decisions")


def _uses(docs: DataFrame, target: dict) -> DataFrame:
    keyed = _keyed(docs)
    chosen = keyed.join(decisions(keyed, **target), "_mix_source")
    last = _place(F.col("whole"))
    partial = F.coalesce((last < F.col("edge")) | ((last == F.col("edge")) & (F.col("_mix_digest") <= F.col("cut"))), F.lit(False))
    times = F.col("whole") + partial.cast("long")
    epochs = F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>"))
    return chosen.withColumn("_mix_epoch", F.explode(epochs))


def schedule(docs: DataFrame, **target) -> DataFrame:
    """``doc_id, source, n_tokens, epoch, block, place``, a row per use of a document."""
    target = target or {"repetition": REPETITION}
    used = _uses(docs.select("doc_id", "text", "source"), target)
    block = F.conv(F.substring("_mix_digest", 1, 3), 16, 10).cast("long")
    return used.select("doc_id", "source", F.col("_mix_words").alias("n_tokens"), F.col("_mix_epoch").alias("epoch"), block.alias("block"),
                       F.concat(_place(F.col("_mix_epoch")), F.col("_mix_digest")).alias("place"))


def mixed(docs: DataFrame, **target) -> DataFrame:
    """The rows of ``docs`` as often as the mix uses them, with their columns."""
    return _uses(docs, target or {"repetition": REPETITION}).select(*docs.columns)


def schedule_sql(documents: str = "documents") -> str:
    """DuckDB's version of ``schedule`` with the default target."""
    return f"""
WITH RECURSIVE k AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS s, md5(coalesce(CAST(doc_id AS varchar), 'null')) AS d,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM {documents}),
t AS (SELECT s, sum(n)::BIGINT AS tokens FROM k GROUP BY s),
p AS (SELECT list(tokens / tot) AS p FROM t, (SELECT sum(tokens)::DOUBLE AS tot FROM t) WHERE tokens > 0),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
  SELECT i + 1, CASE WHEN list_max(list_transform(p, lambda x: pow(x, (lo + hi) / 2 - 1))) / list_min(list_transform(p, lambda x: pow(x, (lo + hi) / 2 - 1))) > {REPETITION}
    THEN (lo + hi) / 2 ELSE lo END,
  CASE WHEN list_max(list_transform(p, lambda x: pow(x, (lo + hi) / 2 - 1))) / list_min(list_transform(p, lambda x: pow(x, (lo + hi) / 2 - 1))) > {REPETITION}
    THEN hi ELSE (lo + hi) / 2 END FROM b, p WHERE i < {STEPS}),
e AS (SELECT hi AS e, list_min(list_transform(p, lambda x: pow(x, hi - 1))) AS f FROM b, p WHERE i = {STEPS}),
g AS (SELECT s, tokens, CASE WHEN tokens > 0 THEN CAST(round(tokens * pow(tokens / (SELECT sum(tokens) FROM t), e - 1) / f) AS BIGINT) ELSE 0 END AS goal FROM t, e),
w AS (SELECT s, CASE WHEN tokens > 0 THEN goal // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN goal % tokens ELSE 0 END AS rest FROM g),
x AS (SELECT k.*, whole, rest, md5(k.s || '|' || substr(d, 1, 3) || '|' || whole) AS spot FROM k JOIN w USING (s)),
o AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY spot, d RANGE UNBOUNDED PRECEDING) AS upto FROM x),
u AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM o)
SELECT doc_id, source, n AS n_tokens, epoch, CAST('0x' || substr(d, 1, 3) AS BIGINT) AS block,
  md5(s || '|' || substr(d, 1, 3) || '|' || epoch) || d AS place
FROM (SELECT *, unnest(range(0, times)) AS epoch FROM u)"""
