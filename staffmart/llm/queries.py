"""The named queries of this folder; each applies one operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffmart.llm import (
    bpe,
    decontamination,
    licenses,
    line_dedup,
    merkle,
    ngram_join,
    packing,
    perplexity,
    quality,
    secrets,
    suffix_dedup,
    toxicity,
    whitening,
)
from staffmart.llm.text import fold, table


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), toxicity.FOLDS) == 0).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), packing.tokenizer_path())
    return packed.withColumnRenamed("id", "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        F.col("id").alias("doc_id"),
        (fold(F.col("id"), quality.FOLDS) == quality.HELD_OUT).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), *perplexity.COUNTS, "base_failed", "kept", "log_perplexity")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets.*")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "pair")
    white = white.select(F.col("id").alias("vec_id"), "n", "deviation", "identity_error", pairs)
    return white.select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "pair.whitened", "pair.explained", "identity_error"
    )


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.vocabulary_path(), columns).withColumnRenamed("id", "doc_id")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    def leaf(added: Column) -> Column:
        return merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + added, F.col("text")])

    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    digests = {"leaf": leaf(F.lit(0)), "claimed": F.when(tampered, leaf(F.lit(1)))}
    proofs = merkle.manifest(table(spark, sf_dir, "documents"), "lang", "doc_id", digests)
    folded = merkle.folded(F.coalesce("claimed", "leaf"), F.col("path"))
    proof = F.sha2(F.array_join("path.digest", ""), 256).alias("proof_sha256")
    proofs = proofs.select("doc_id", "leaf", "subroot", "root", proof, folded.alias("folded_root"))
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


# The same trees, proofs and walks by recursion over whole levels; crc32 of a decimal number bit by bit.
MERKLE_ORACLE = """
WITH RECURSIVE marked AS (
  SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 7 = 0 AS tampered
  FROM documents
), hashed AS (
  SELECT doc_id, lang, tampered,
    sha256(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')
      || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-')
      || coalesce(strlen(text) || ':' || text, '-')) AS changed
  FROM marked
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
), nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS width FROM leaves
  UNION ALL
  SELECT lang, level, pos, node, width FROM (
    SELECT lang, level + 1 AS level, pos // 2 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node, (width + 1) // 2 AS width
    FROM nodes WHERE width > 1 GROUP BY lang, level, pos // 2, width)
), subroots AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE width = 1
), tops AS (
  SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS width FROM subroots
  UNION ALL
  SELECT level, pos, node, width FROM (
    SELECT level + 1 AS level, pos // 2 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node, (width + 1) // 2 AS width
    FROM tops WHERE width > 1 GROUP BY level, pos // 2, width)
), steps AS (
  SELECT l.lang, l.pos, n.level AS step, (l.pos >> n.level) & 1 AS is_right, s.node AS sibling
  FROM leaves l JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.width > 1 AND n.pos = l.pos >> n.level
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = n.level AND s.pos = xor(n.pos, 1)
  UNION ALL
  SELECT l.lang, l.pos, 1000 + n.level, (r.pos >> n.level) & 1, s.node
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN tops n ON n.width > 1 AND n.pos = r.pos >> n.level
  LEFT JOIN tops s ON s.level = n.level AND s.pos = xor(n.pos, 1)
), proofs AS (
  SELECT lang, pos, string_agg(coalesce(sibling, ''), '' ORDER BY step) AS proof,
    list({'r': is_right, 's': coalesce(sibling, '')} ORDER BY step) AS path
  FROM steps GROUP BY lang, pos
), walks AS (
  SELECT l.lang, l.pos, 1 AS step, coalesce(path, []) AS path, CASE WHEN tampered THEN changed ELSE leaf END AS node
  FROM leaves l LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos
  UNION ALL
  SELECT lang, pos, step + 1, path, sha256(CASE WHEN path[step].r = 1 THEN path[step].s || node ELSE node || path[step].s END)
  FROM walks WHERE step <= len(path)
)
SELECT l.doc_id, l.leaf, r.subroot, (SELECT node FROM tops WHERE width = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
  w.node AS folded_root, w.node = (SELECT node FROM tops WHERE width = 1) AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos
JOIN walks w ON w.lang IS NOT DISTINCT FROM l.lang AND w.pos = l.pos AND w.step = len(w.path) + 1
"""

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_join": op2_ngram_join,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_perplexity": op6_perplexity,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": op8_licenses,
    "op9_secrets": op9_secrets,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_bpe": op12_bpe,
    "op13_merkle": op13_merkle,
}
ORACLES = {"op1_decontamination": decontamination.ORACLE, "op8_licenses": licenses.oracle(), "op13_merkle": MERKLE_ORACLE}
