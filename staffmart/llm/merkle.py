"""A Merkle manifest of a dataset whose tree is stored only every few levels.

Every row is a leaf, every group a tree over its leaves in key order, and the groups' roots are the leaves of one tree more. A node is
the SHA-256 of its two children's digests as text; a last child without a neighbour is hashed alone. Only every ``STEP``-th level is
written. A proof (the siblings from a leaf up to the root) is extracted from the top down: the stored nodes below one stored
node are one aligned subtree, whose missing interior levels are computed again, give the siblings of its nodes and are
dropped. Each subtree is one row of at most 2 ** ``STEP`` digests, so no task holds a level, however large a group is.

Leaves are numbered without a sort in one task: rows are range-partitioned by group and key, and each partition's rows count on
from those before it. A group that holds most rows is spread over many partitions.

Defined results: a NULL field is written as ``-``; a NULL group is a group of its own, before all others; NULL keys come first; rows with
equal keys are leaves of their own, ordered by their digests (equal rows are interchangeable); texts of any length are hashed whole; a table
without rows has no leaves and no root; only the columns asked for are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.operators.joins import lookup
from staffmart.session import materialise

STEP = 8  # levels between two stored ones
PATH = "array<struct<left: boolean, digest: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's values: each as its length in bytes, a colon and its text; NULL as a dash."""
    texts = [value.cast("string") for value in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def level_above(nodes: Column) -> Column:
    parents = F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1))
    return F.transform(parents, lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def rounds(levels: Column) -> Column:
    """0, 1, ... below ``levels``."""
    return F.slice(F.sequence(F.lit(0), F.lit(STEP - 1)), F.lit(1), levels)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its siblings."""

    def step(node: Column, sibling: Column) -> Column:
        other = F.coalesce(sibling["digest"], F.lit(""))
        return F.when(sibling["left"], digest(other, node)).otherwise(digest(node, other))

    return F.aggregate(path, start, step)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (tree, digest, ...) with their place in the tree, ``pos`` from 0, and the tree's ``height``."""
    ties = F.xxhash64("digest", F.monotonically_increasing_id())  # spreads equal rows over partitions
    keys = ["tree", *order, "digest", "_tie"]
    placed = rows.withColumn("_tie", ties).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    placed = materialise(placed.withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy("tree", part.alias("part")).agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    # One row for each tree and partition, however many leaves there are.
    counts = counts.selectExpr(
        "tree AS in_tree", "part AS in_part", "first",
        "sum(n) OVER (PARTITION BY tree ORDER BY part) - n AS before", "sum(n) OVER (PARTITION BY tree) AS leaves",
    )
    counts = materialise(counts, "merkle-offsets")
    found = lookup(placed.withColumn("_part", part), counts, [("tree", "in_tree"), ("_part", "in_part")], how="inner")
    height = F.when(F.col("leaves") > 1, F.length(F.bin(F.col("leaves") - 1))).otherwise(0)
    found = found.withColumns({"pos": F.col("before") + F.col("_at") - F.col("first"), "height": height.cast("int")})
    return found.drop("_at", "_part", "first", "before", "leaves")


def subtrees(nodes: DataFrame, level: int) -> DataFrame:
    """(tree, above, height, levels, nodes): the stored nodes of ``level`` below each node of the next stored level."""
    carried = [c for c in nodes.columns if c not in ("tree", "height")]
    members = F.sort_array(F.collect_list(F.struct("pos", *[c for c in carried if c != "pos"])))
    grouped = nodes.groupBy("tree", F.shiftright("pos", STEP).alias("above")).agg(members.alias("nodes"), F.first("height").alias("height"))
    return grouped.withColumn("levels", F.least(F.lit(STEP), F.col("height") - level))


def stored_levels(leaves: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels, from the leaves (tree, pos, height, digest, ...) up, and (tree, root) of all trees."""
    levels, roots = [leaves], None
    for level in range(0, max(height, 1), STEP):
        below = levels[-1].where(F.col("height") > level) if level else levels[-1]
        top = F.aggregate(rounds(F.col("levels")), F.col("nodes.digest"), lambda nodes, _: level_above(nodes))
        made = subtrees(below, level).select("tree", F.col("above").alias("pos"), "height", F.get(top, F.lit(0)).alias("digest"))
        made = materialise(made, f"merkle-{level + STEP}")
        levels.append(made)
        done = made.where(F.col("height") <= level + STEP).select("tree", F.col("digest").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
    return levels, roots


def paths(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The leaves with their ``path`` of siblings and what ``ends`` (tree, end) holds for their tree.

    ``end.path`` goes on from the tree's root. Level by level each subtree is joined to the path of the node above it.
    """
    kept, end = None, ends.select("tree", F.lit(0).cast("long").alias("above"), F.col("end.path").alias("upper"), "end")
    for number in range(len(levels) - 2, -1, -1):
        level = number * STEP
        nodes = levels[number].where(F.col("height") > level) if number else levels[number]
        trees = subtrees(nodes, level)
        ending = F.col("height") <= level + STEP
        known = trees.where(ending).join(end, ["tree", "above"])
        if kept is not None:
            known = known.unionByName(trees.where(~ending).join(kept, ["tree", "above"]))
        columns = [c for c in nodes.columns if c not in ("tree", "height")]

        def siblings(made: Column, place: Column) -> Column:
            def sibling(k: Column) -> Column:
                at = F.call_function("shiftright", place, k)
                other = F.get(F.get(made, k), at.bitwiseXOR(F.lit(1)))
                return F.struct((at.bitwiseAND(F.lit(1)) == 1).alias("left"), other.alias("digest"))

            return F.transform(rounds(F.col("levels")), sibling)

        def member(node: Column, own: Column, columns=tuple(columns)) -> Column:
            return F.struct(*[node[c].alias(c) for c in columns], F.concat(own, F.col("upper")).alias("path"))

        # All levels of the subtree, from its stored nodes up; only the siblings taken from them are kept.
        inner = F.aggregate(
            rounds(F.col("levels")), F.array(F.col("nodes.digest")), lambda made, _: F.concat(made, F.array(level_above(F.element_at(made, -1))))
        )
        members = F.transform(F.array(inner), lambda made: F.transform("nodes", lambda node, place: member(node, siblings(made, place))))
        rows = known.select("tree", "end", F.explode(F.get(members, F.lit(0))).alias("m"))
        rows = rows.select("tree", "end", *[F.col(f"m.{c}") for c in columns], "m.path")
        if number:
            kept = materialise(rows.select("tree", F.col("pos").alias("above"), F.col("path").alias("upper"), "end"), f"merkle-paths-{level}")
    return rows


def highest(rows: DataFrame) -> int:
    return rows.agg(F.max("height")).first()[0] or 0


def manifest(docs: DataFrame, group: str, key: str, digests: Mapping[str, Column]) -> DataFrame:
    """(key, group, the columns of ``digests``, subroot, root, path) of every row.

    ``digests["leaf"]`` is the digest that the tree is built from; other columns named there travel with the row.
    ``path`` holds the siblings up to the root, the lowest first: whether each stands left, and its digest, NULL if there is none.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # NULL first, then bytewise
    others = [column.alias(f"x_{name}") for name, column in digests.items() if name != "leaf"]
    rows = docs.select(tree.alias("tree"), F.col(key).alias("key"), digests["leaf"].alias("digest"), *others)
    leaves = materialise(numbered(rows, ["key"]), "merkle-leaves")
    levels, roots = stored_levels(leaves, highest(leaves))

    tops = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    tops = materialise(numbered(tops, ["name"]), "merkle-tops")
    top_levels, whole = stored_levels(tops, highest(tops))
    whole = whole.select("root").first()
    root = F.lit(whole[0] if whole else None).cast("string")
    nothing = F.struct(F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"))
    above = paths(top_levels, tops.select("tree").distinct().withColumn("end", nothing))
    ends = materialise(above.select(F.col("name").alias("tree"), F.struct("path", F.col("digest").alias("subroot")).alias("end")), "merkle-ends")

    found = paths(levels, ends)
    named = F.when(F.col("tree") == "", F.lit(None)).otherwise(F.expr("substring(tree, 2)")).alias(group)
    extra = [F.col(f"x_{name}").alias(name) for name in digests if name != "leaf"]
    return found.select(F.col("key").alias(key), named, F.col("digest").alias("leaf"), *extra, F.col("end.subroot").alias("subroot"), root.alias("root"), "path")
