"""The Merkle manifest against a plain construction, over several stored levels, odd rows and empty tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from staffmart.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, added=0):
    values = dict(row, n_chars=None if row["n_chars"] is None else row["n_chars"] + added)
    return sha(*["-" if values[f] is None else f"{len(str(values[f]).encode())}:{values[f]}" for f in FIELDS])


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, at):
    path = []
    for level in levels[:-1]:
        path.append((at % 2 == 1, level[at ^ 1] if at ^ 1 < len(level) else None))
        at //= 2
    return path


def plain(rows):
    """(doc_id, leaf, subroot, root, path, folded root of the changed leaf), sorted."""
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for g in names}
    trees = {g: plain_levels([leaf_of(r) for r in ordered[g]]) for g in names}
    top = plain_levels([trees[g][-1][0] for g in names])
    out = []
    for place, group in enumerate(names):
        for at, row in enumerate(ordered[group]):
            path = plain_path(trees[group], at) + plain_path(top, place)
            tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node = leaf_of(row, 1) if tampered else leaf_of(row)
            for left, sibling in path:
                node = sha(sibling, node) if left else sha(node, sibling or "")
            out.append((str(row["doc_id"]), leaf_of(row), trees[group][-1][0], top[-1][0], path, node))
    return sorted(out, key=str)


def built(docs):
    def leaf(added):
        return merkle.leaf([F.col("n_chars") + added if f == "n_chars" else F.col(f) for f in FIELDS])

    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    found = merkle.manifest(docs, "lang", "doc_id", {"leaf": leaf(F.lit(0)), "claimed": F.when(tampered, leaf(F.lit(1)))})
    found = found.withColumn("folded", merkle.folded(F.coalesce("claimed", "leaf"), F.col("path")))
    return sorted(
        ((str(r.doc_id), r.leaf, r.subroot, r.root, [(s.left, s.digest) for s in r.path], r.folded) for r in found.collect()), key=str
    )


@pytest.mark.parametrize("step", [1, 2, 8])
def test_equals_a_plain_tree(spark, monkeypatch, step):
    monkeypatch.setattr(merkle, "STEP", step)  # several stored levels on few rows
    sizes = {"en": 77, None: 1, "": 2, "de": 5, "ü": 16, "z": 17}
    rows = [
        {"doc_id": i * 13 % 101 + 1000 * k, "source": "s" if i % 3 else None, "lang": g, "n_chars": i if i % 4 else None, "text": f"tëxt {i}"}
        for k, (g, n) in enumerate(sizes.items())
        for i in range(n)
    ]
    rows += [dict(rows[0]), dict(rows[0], text="same id"), dict(rows[1], doc_id=None, text=None), dict(rows[1], text="", doc_id=10**12)]
    rows.append(dict(rows[2], text="long " * 200_000, doc_id=5_000_000))
    docs = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], SCHEMA).repartition(5)
    docs = docs.withColumns({c: F.lit(c) for c in ("tree", "key", "digest", "pos", "path", "leaf", "root")})
    assert built(docs) == plain(rows)


def test_no_rows_and_one_row(spark):
    assert built(spark.createDataFrame([], SCHEMA)) == []
    row = {"doc_id": 3, "source": None, "lang": None, "n_chars": None, "text": None}
    found = built(spark.createDataFrame([tuple(row[f] for f in FIELDS)], SCHEMA))
    assert found == plain([row]) and found[0][1] == found[0][3]


def test_equal_rows_are_spread(spark):
    """A third of all rows equal: their leaves share no task, and all have valid proofs."""
    docs = spark.range(3000).selectExpr("if(id < 1000, 7, id) AS doc_id", "'s' AS source", "'en' AS lang", "1L AS n_chars", "if(id < 1000, 'copy', string(id)) AS text")
    placed = merkle.numbered(docs.selectExpr("'=en' AS tree", "doc_id AS key", "sha2(text, 256) AS digest"), ["key"])
    assert sorted(r.pos for r in placed.select("pos").collect()) == list(range(3000))
    rows = [r.asDict() for r in docs.collect()]
    assert [r[:4] for r in built(docs)] == [r[:4] for r in plain(rows)]
