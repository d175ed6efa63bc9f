"""Items with equal ids, nulls and repeated rows: Spark against the checking SQL."""

import duckdb

from staffmart.llm import decontamination

DOCS = [(1, "a b c d e f zz"), (2, "g h i j k l"), (2, "x"), (3, "A b, c d E f g h i j k l"), (4, None), (None, "a b c d e f"), (5, "one"), (5, "one")]
ITEMS = [(1, "a b c d e f"), (1, "g h i j k l"), (1, "a b  c d e f"), (2, "one"), (3, None), (4, ""), (None, "one"), (5, "g h i j k l")]


def test_items_with_equal_ids_are_found_apart(spark):
    documents = spark.createDataFrame(DOCS, "doc_id long, text string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = sorted(tuple(r) for r in decontamination.contained_items(documents, benchmark).collect())
    db = duckdb.connect()
    db.register("documents", documents.toArrow())
    db.register("benchmark", benchmark.toArrow())
    assert found == sorted(db.sql(decontamination.ORACLE).fetchall())
    assert found == [(1, 1, 2, 2), (2, 1, 2, 2), (2, 5, 2, 2), (3, 1, 2, 2), (3, 1, 2, 2), (3, 5, 2, 2), (5, 2, 1, 1)]
