"""Benchmark items inside documents: MinHash containment search by item size, verified exactly.

Words are runs of letters and digits, lower-cased. A set holds all distinct shingles of five words; with fewer words the
whole sequence is the one shingle; without words it is empty and never found. An item is found in a document that holds 80 %
or more of its shingles.

Items are partitioned by size, in powers of two. An item's sketch holds its least shingle hashes, as many as the largest size
of its partition needs: a document with 80 % of an item of n shingles lacks at most n / 5, so it holds at least one
of any n / 5 + 1. Every document shingle is looked up among the sketches, whatever the document's length; hits are candidates
and are verified by counting all shared shingles. All of it is DataFrame functions.

Defined results: NULL texts are empty; items with equal ids and different sets are looked for separately, each giving a row of its
own, those with equal ids and sets are one item; rows with equal ids are one document; documents or items with a NULL id are not
reported; an empty table on either side gives an empty result; texts of any length are searched whole; other columns, whatever
their names, are not read; ties cannot arise, as every item found is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.operators.joins import lookup
from staffmart.session import materialise

WORDS = 5
PERCENT = 80


def shingles(words: str) -> Column:
    """Distinct hashes of the shingles of an array of words."""
    hashed = lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(WORDS)])
    last = F.greatest(F.size(words) - WORDS, F.lit(0))
    return F.when(F.size(words) > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), hashed)))


def shingled(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = F.array_remove(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"), "")
    rows = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), words.alias("words"))
    return rows.select("id", shingles("words").alias("shingles"))


def sketches(items: DataFrame) -> DataFrame:
    """(shingle, item_id): the least hashes of each item, by its size partition."""
    size = F.size("shingles")
    largest = F.pow(F.lit(2.0), F.floor(F.log2(size)) + 1) - 1
    kept = F.least(F.floor(largest * (100 - PERCENT) / 100) + 1, size).cast("int")
    least = F.slice(F.sort_array("shingles"), F.lit(1), kept)
    return items.where(size > 0).select(F.explode(least).alias("shingle"), F.col("id").alias("item_id"))


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) of every item found in a document."""
    known = shingled(items, item_col, item_text).select("id", F.sort_array("shingles").alias("shingles"))
    known = known.where(F.size("shingles") > 0).dropDuplicates().withColumnRenamed("id", "item_id")
    known = materialise(known.withColumn("id", F.monotonically_increasing_id()), "items")  # stored, so the numbers stay
    sketch = materialise(sketches(known), "sketches")
    every = materialise(known.select(F.explode("shingles").alias("shingle"), F.col("id").alias("item_id")), "item-shingles")

    def hits(rows: DataFrame, table: DataFrame) -> DataFrame:
        """(doc_id, item_id, shingle): shingles of ``rows`` that are in ``table``."""
        # explode would have its array computed a second time, in a filter below it
        probes = shingled(rows, id_col, text_col).select(F.col("id").alias("doc_id"), F.explode_outer("shingles").alias("probe"))
        single = materialise(table.select("shingle").distinct(), "probes")
        met = lookup(probes, single, [("probe", "shingle")], how="left_semi")
        return met.join(table, F.col("probe") == F.col("shingle")).select("doc_id", "item_id", "shingle")

    candidates = materialise(hits(docs, sketch).select("doc_id", "item_id").distinct(), "candidates")
    suspects = materialise(candidates.select(F.col("doc_id").alias("suspect")).distinct(), "suspects")
    read_again = lookup(docs.select(id_col, text_col), suspects, [(id_col, "suspect")], how="left_semi")
    shared = hits(read_again, every).join(candidates, ["doc_id", "item_id"], "left_semi")
    counted = shared.groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("n_shared"))
    sizes = known.select("id", F.col("item_id").alias("named"), F.size("shingles").cast("long").alias("n_shingles"))
    found = counted.join(sizes, F.col("item_id") == F.col("id")).where(F.col("n_shared") * 100 >= F.col("n_shingles") * PERCENT)
    return found.select("doc_id", F.col("named").alias("item_id"), "n_shingles", "n_shared")


ORACLE = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), split AS (
  SELECT kind, id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM texts WHERE id IS NOT NULL
), sets AS (
  SELECT DISTINCT kind, id, list_sort(list_distinct(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingles
  FROM split
), found AS (SELECT DISTINCT id AS doc_id, unnest(shingles) AS s FROM sets WHERE kind = 'd'
), items AS (
  SELECT row_number() OVER () AS item, id AS item_id, len(shingles) AS n_shingles, unnest(shingles) AS s FROM sets WHERE kind = 'i'
)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared
FROM found JOIN items ON found.s = items.s
GROUP BY doc_id, item, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
"""
