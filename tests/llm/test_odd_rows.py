"""NULLs in any column, empty and very long texts, repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from staffmart.llm import decontamination, licenses, line_dedup, ngram_join, packing, perplexity, quality, secrets, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boxed up five dozen liquor jugs tonight"
ROWS = [
    (1, PROSE, "en", "a", 10),
    (2, PROSE, None, None, None),
    (3, None, "en", "a", None),
    (4, "", "en", "a", 0),
    (4, "", "en", "a", 0),
    (None, PROSE + " again", "en", "a", 1),
    (6, LONG, "de", "b", 1),
    (7, " \n\t\n ", "en", "a", 5),
    (8, "one", "en", "a", 3),
    (8, "one", "en", "a", 3),
    (9, "Ünïcode ... \U0001f600 %41%42 line\n\nline\nline", "fr", "b", 3),
]
CLASHES = ("id", "node", "key", "band", "component", "score", "shingles", "n_removed", "toxic_score", "cls", "length")


@pytest.fixture(scope="module", params=["odd", "empty"])
def docs(request, spark):
    rows = spark.createDataFrame(ROWS if request.param == "odd" else [], SCHEMA)
    return rows.withColumns({name: F.lit(name) for name in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, None), (3, None, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (None, "x"), (4, "one"), (1, PROSE)], "item_id long, text string")


def test_decontamination(docs, items):
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contained_items(docs, items).collect()}
    assert found == (set() if docs.isEmpty() else {(1, 1), (2, 1), (8, 4)})


def test_near_duplicates(docs):
    found = [tuple(r) for r in ngram_join.near_duplicates(docs).collect()]
    assert len(found) == docs.count()
    if found:
        by_id = {r[0]: r[1:] for r in found}
        assert by_id[1][1] == by_id[2][1] == 1 and by_id[3] == (0, 3) and by_id[4] == (0, 4) and by_id[7] == (0, 7)
        assert by_id[8] == (1, 8) and by_id[None][1] is None


def test_packing(docs):
    found = packing.pack(docs, packing.tokenizer_path()).collect()
    assert {r["id"] for r in found} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    for r in found:
        assert 0 < r["length"] <= 2048 and r["offset"] + r["length"] <= 2048


def test_scores_without_usable_labels(docs, labels):
    scored = quality.score(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r["quality_score"] <= 1 for r in scored)
    none = toxicity.train(docs, labels.where("doc_id is null"))
    assert [r["toxic_score"] for r in toxicity.score(docs, none).collect()] == [0.0] * docs.count()


def test_perplexity_rules(docs):
    found = [r.asDict() for r in perplexity.judge(docs).collect()]
    assert len(found) == docs.count()
    for r in found:
        assert r["base_failed"] or r["n_words"] >= 50
        if r["id"] in (3, 4, 7):
            assert r["n_words"] == r["word_chars"] == 0 and r["base_failed"] and not r["kept"]


def test_scans(docs):
    assert licenses.license_scan(docs).count() == 0
    found = secrets.find_secrets(docs).select("doc_id", "secrets.*").collect()
    assert len(found) == docs.count() and all(r["n_assign"] == 0 for r in found)


def test_suffix_dedup(docs):
    found = [r.asDict() for r in suffix_dedup.remove_repeats(docs).collect()]
    assert len(found) == docs.count()
    for r in found:
        if r["id"] in (3, 4, 7, 8, 9, 1):
            assert r["n_removed"] == 0


def test_line_dedup(docs):
    kept = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    if kept:
        assert kept[3]["text"] is None and kept[4]["text"] == "" and kept[7]["text"] == " \n\t\n "
        assert kept[1]["text"] == PROSE and kept[2]["text"] == "" and kept[None]["text"] == PROSE + " again"
        assert kept[9]["n_removed"] == 1 and kept[6]["text"] == LONG


def test_pipeline_stages(spark, docs, labels, items, tmp_path):
    labels.withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        after.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r[0] for r in now.select("doc_id").collect()} == (set() if docs.isEmpty() else {3, 4, 6, 7, 9, None})
