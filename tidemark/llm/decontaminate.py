"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Method
    A document that holds ``PERCENT`` of an item's five-word shingles is contaminated by it. Containment of an item in
    a document does not change if the document is reduced to shingles that some item has, so long documents are
    first reduced, by a join, to those and their positions. Items are partitioned by size into classes
    ``(L/2, L]``; for each class a reduced document is looked at in windows of ``4 L`` positions that overlap by half,
    which bounds the size of what is compared with the item, and so the number of coordinates that are needed.
    Windows and items of a class are candidates if they agree in at least one of ``COORDINATES`` MinHash
    coordinates and the document has enough shingles for the item. Each candidate pair is then counted exactly over
    the whole document, by its two sets; no shared shingle is a row per document and item.

Recall of the search
    An item that lies within ``2 L`` positions is inside one window. There its similarity is at least
    ``.375 / (.5 + 4 - .375)``, even if all other places of the window hold shingles of other items; the chance that no
    coordinate agrees is then under 1e-5, and under 1e-40 for a window that holds the item alone.

Defined cases
    Null and empty texts, and rows without ``doc_id`` or ``item_id``, contaminate nothing and are not found. An item or
    document of fewer than five words has its whole sequence as its only shingle. Rows that share an id, repeated ones
    too, are one document or item. Very long texts are looked at whole, window by window. Other columns are not looked at. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.workspace import materialize

PERCENT, COORDINATES = 75, 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles(table: DataFrame, key: str) -> DataFrame:
    """``key, pos, h``: the hashed five-word shingles of whole texts, with their positions."""
    words = f"filter(split(translate(text, '{UPPER}', '{LOWER}'), r'[\\x20\\x09-\\x0D]+'), x -> x <> '')"
    five = ", ".join(f"w[i + {k}]" for k in range(5))
    # The word array is bound to a lambda variable, so it is made once per text.
    made = f"""transform(array({words}), w -> CASE WHEN size(w) >= 5 THEN transform(sequence(0, size(w) - 5), i -> xxhash64({five}))
               WHEN size(w) > 0 THEN array(xxhash64(array_join(w, ' '), size(w))) ELSE array() END)[0]"""
    held = table.filter(F.col(key).isNotNull() & F.col("text").isNotNull())
    return held.select(F.col(key).cast("long").alias(key), F.posexplode(F.expr(made)).alias("pos", "h"))


def _signature(sets: str) -> str:
    return f"transform(sequence(0, {COORDINATES - 1}), j -> array_min(transform({sets}, h -> xxhash64(h, j))))"


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, n_item, n_common, containment`` for every pair that reaches ``percent``."""
    of_item = shingles(items, "item_id").select("item_id", "h").distinct()
    sizes = of_item.groupBy("item_id").agg(F.count("*").alias("n_item"))
    of_item = of_item.join(sizes, "item_id").withColumn("class", F.expr("shiftleft(1, int(ceil(log2(n_item))))"))
    of_item = materialize(of_item, "item-shingles")
    universe = materialize(of_item.groupBy("h", "class").agg(F.min("n_item").alias("least")), "universe")
    least = of_item.groupBy("class").agg(F.min("n_item").alias("least"))

    hits = shingles(docs, "doc_id").join(universe.select("h").distinct(), "h").select("doc_id", "pos", "h")
    hits = materialize(hits, "reduced-documents")
    classed = hits.join(universe.select("h", "class"), "h")
    enough = classed.groupBy("doc_id", "class").agg(F.countDistinct("h").alias("n")).join(least, "class")
    enough = enough.filter(f"100 * n >= {percent} * least").select("doc_id", "class", "n")
    at = F.expr("pos div (2 * class)")
    placed = classed.join(enough, ["doc_id", "class"]).select("doc_id", "class", "n", F.explode(F.array(at, at - 1)).alias("window"), "h")
    windows = placed.groupBy("doc_id", "class", "window").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("h")).alias("hs"))
    windows = materialize(windows.select("doc_id", "class", "n", "hs").distinct(), "windows")

    def coordinates(sets: DataFrame, *keys: str) -> DataFrame:
        return sets.select(*keys, "class", F.posexplode(F.expr(_signature("hs"))).alias("j", "m"))

    # An item can't be in a document that has fewer of all items' shingles than it needs.
    kinds = windows.groupBy("class", "hs").agg(F.max("n").alias("most")).withColumn("set_key", F.xxhash64("class", "hs"))
    item_sets = materialize(of_item.groupBy("item_id", "class", "n_item").agg(F.collect_list("h").alias("hs")), "item-sets")
    found = coordinates(kinds, "set_key", "most").join(coordinates(item_sets, "item_id", "n_item"), ["class", "j", "m"])
    found = found.filter(f"100 * most >= {percent} * n_item").select("set_key", "item_id", "n_item").distinct()
    pairs = windows.select("doc_id", "n", F.xxhash64("class", "hs").alias("set_key")).join(found, "set_key")
    pairs = pairs.filter(f"100 * n >= {percent} * n_item").select("doc_id", "item_id").distinct()
    pairs = materialize(pairs, "contained-candidates")

    # Pairs come first: only their documents' sets are gathered, and a pair is a row with both sets in it.
    whole = hits.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("of_doc"))
    both = pairs.join(item_sets.select("item_id", "n_item", "hs"), "item_id").join(whole, "doc_id")
    counted = both.select("doc_id", "item_id", "n_item", F.size(F.array_intersect("hs", "of_doc")).cast("long").alias("n_common"))
    return counted.filter(f"100 * n_common >= {percent} * n_item").withColumn("containment", F.col("n_common") / F.col("n_item"))


def contaminated_sql(documents: str = "documents", percent: int = PERCENT) -> str:
    """DuckDB's version, by counting all common shingles."""

    def grams(table: str, key: str) -> str:
        return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM (SELECT {key},
  list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL)"""

    return f"""
WITH d AS ({grams(documents, "doc_id")}), b AS ({grams("benchmark", "item_id")}),
s AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_common, count(*) / n_item AS containment
FROM b JOIN d USING (g) JOIN s USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= {percent} * n_item"""
