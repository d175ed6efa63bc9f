"""Near-duplicate texts by an n-gram Jaccard self-join with adaptive multi-match prefixes.

A text is its set of distinct shingles of some words, three if not said otherwise (fewer words: the whole sequence as one; none: empty,
linked with nothing). Two texts link when their sets have a Jaccard similarity of 0.9 or what the rule says, in whole numbers:
100 * intersection >= 90 * union.

1. Shingles are ordered by an estimate of their frequency, rare ones first. The estimate is a table of fixed size, summed from what
   repeats within pieces of the corpus; it steers the work and never the result.
2. A text's prefix is long enough that a linked partner shares a token of it. Where the estimated number of candidates is
   high the prefix is lengthened by l - 1 tokens and l shared tokens are asked for; a pair uses the smaller l of its two texts.
3. Equal sets are one node. In a posting list of more than a few texts all are first compared with one of them, in several rounds:
   first with that of most fame, then with others that the links so far leave in another component. Then all lists give
   the pairs that pass length filter, bit tables and match count, but only of texts that are still in different components.
4. Candidates first pass a bit table of their sets, which bounds from below how much the sets differ; those not ruled out
   are verified on their whole sets. Links are joined into components.

Sets and shingles are told apart by 64-bit hashes. Defined results: a NULL or empty text has no shingles and is its own
component; rows with equal ids are one document whose sets are joined by id; a NULL id is a component of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staffmart.llm.components import connected
from staffmart.llm.text import CHUNK_BYTES, chunks, encode_words, mix, sums, word_hashes
from staffmart.operators.joins import lookup
from staffmart.session import arrow_batches, materialise, settings


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the least Jaccard similarity in percent."""

    words: int = 3
    percent: int = 90


SLOTS = 1 << 20  # of the frequency table
CHEAP = 64  # candidates that cost no longer prefix
LONGEST = 8  # the largest number of shared tokens asked for
LEAST_BITS = 9  # a bit table has 2 ** 9 bits or more
LIST = 8  # a posting list of more texts is first compared with some of them, one after another
ROUNDS = 5  # such comparisons at most
BATCH_BYTES = 2 * CHUNK_BYTES  # of texts or bit tables sent to a task at once
PIECE_BYTES = 1 << 20  # of text whose shingles a task holds at once, where no frequencies are estimated
WORTHWHILE = 20  # another one follows if this one found one in so many of the links so far


class Sets:
    """Shingle sets of some texts: ``keys`` by text and order, ``bounds`` of each text, a hash of each set."""

    def __init__(self, texts: pa.Array, words: int, frequency: np.ndarray | None = None):
        known, ids, bounds = encode_words(pc.ascii_lower(texts))
        hashes = mix(word_hashes(known))[ids] if len(known) else np.zeros(0, np.uint64)
        count = np.diff(bounds)
        doc = np.repeat(np.arange(len(texts)), count)
        factors = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(words)]
        starts = max(len(doc) - words + 1, 0)
        full = doc[:starts] == doc[len(doc) - starts :]
        keys = np.zeros(starts, np.uint64)
        for k, factor in enumerate(factors):
            keys += hashes[k : k + starts] * factor
        short = np.flatnonzero((count > 0) & (count < words))
        whole = count[short].astype(np.uint64)
        for k, factor in enumerate(factors):
            has = count[short] > k
            whole[has] += hashes[bounds[:-1][short][has] + k] * factor
        keys = mix(np.concatenate((keys[full], whole)))
        doc = np.concatenate((doc[:starts][full], short))

        order = np.argsort(keys)
        if frequency is not None:
            weight = frequency[keys[order] % np.uint64(SLOTS)]
            order = order[np.argsort(np.log2(weight + 1.0).astype(np.uint8), kind="stable")]
        narrow = np.uint16 if len(texts) < 1 << 16 else np.int64
        order = order[np.argsort(doc[order].astype(narrow), kind="stable")]
        keys, doc = keys[order], doc[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        self.keys, self.doc = keys[new], doc[new]
        self.bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.size = np.diff(self.bounds)
        self.hash = mix(sums(mix(self.keys), self.bounds) + self.size.astype(np.uint64)).astype(np.int64)

    def parities(self) -> list[bytes]:
        """Per text a bit table, at least as many bits as shingles: every shingle flips the bit its hash names.

        Tables of two sets differ in at most as many bits as the sets have shingles not in common.
        """
        bits = np.left_shift(np.int64(1), np.maximum(np.ceil(np.log2(np.maximum(self.size, 1))).astype(np.int64), LEAST_BITS))
        ends = np.cumsum(bits)
        place = (ends - bits)[self.doc] + ((self.keys >> np.uint64(20)).astype(np.int64) & (bits[self.doc] - 1))
        flipped = np.bincount(place, minlength=int(ends[-1]) if len(ends) else 0) & 1
        packed = np.packbits(flipped.astype(np.uint8), bitorder="little").tobytes()
        return [packed[(e - b) // 8 : e // 8] for b, e in zip(bits.tolist(), ends.tolist())]

    def first_of_each(self) -> np.ndarray:
        """Of texts with the same set one each, without empty ones."""
        _, first = np.unique(self.hash, return_index=True)
        return np.sort(first[self.size[first] > 0])


def halved(table: np.ndarray, size: int) -> np.ndarray:
    """A bit table folded to ``size`` bytes."""
    while len(table) > size:
        table = table[: len(table) // 2] ^ table[len(table) // 2 :]
    return table


def folded(parity: bytes) -> list[int]:
    """A bit table folded to the least size, as numbers."""
    return halved(np.frombuffer(parity, np.uint8), 1 << (LEAST_BITS - 3)).view(np.int64).tolist()


def facts_and_frequencies(docs: DataFrame, rule: Rule) -> tuple[DataFrame, np.ndarray]:
    """(id, node, size, parity, fold) of every text, and the estimated number of texts per shingle slot.

    Shingles met once in a piece of the corpus do not count towards the estimate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for first, texts in chunks(batch.column("text")):
                met, different = [], np.zeros(0, np.int64)
                for at, piece in chunks(texts, PIECE_BYTES):
                    sets = Sets(piece, rule.words)
                    chosen = sets.first_of_each()
                    chosen = chosen[~np.isin(sets.hash[chosen], different)]
                    different = np.concatenate((different, sets.hash[chosen]))
                    met.append(sets.keys[np.isin(sets.doc, chosen)])
                    rows, parities = len(piece), sets.parities()
                    yield pa.RecordBatch.from_pydict({
                        "id": ids.slice(first + at, rows), "node": pa.array(sets.hash), "size": pa.array(sets.size.astype(np.int64)),
                        "parity": pa.array(parities, pa.binary()), "fold": pa.array([folded(p) for p in parities], pa.list_(pa.int64())),
                        "slot": pa.nulls(rows, pa.int32()), "n": pa.nulls(rows, pa.int64()),
                    })
                keys, count = np.unique(np.concatenate(met), return_counts=True)
                slots = (keys[count > 1] % np.uint64(SLOTS)).astype(np.int64)
                total = np.bincount(slots, weights=count[count > 1], minlength=1).astype(np.int64)
                used = np.flatnonzero(total)
                none = len(used)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.nulls(none, ids.type), "node": pa.nulls(none, pa.int64()), "size": pa.nulls(none, pa.int64()),
                    "parity": pa.nulls(none, pa.binary()), "fold": pa.nulls(none, pa.list_(pa.int64())),
                    "slot": pa.array(used.astype(np.int32)), "n": pa.array(total[used]),
                })

    schema = f"id {docs.schema['id'].dataType.simpleString()}, node long, size long, parity binary, fold array<long>, slot int, n long"
    both = materialise(docs.mapInArrow(run, schema), "join-facts")
    found = both.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(SLOTS, np.int64)
    table[found["slot"].to_numpy()] = found["n"].to_numpy()
    return both.where("slot IS NULL").select("id", "node", "size", "parity", "fold"), table


def prefixes(sets: Sets, frequency: np.ndarray, rule: Rule) -> dict[str, np.ndarray]:
    """Prefix tokens of each different set, with the match count from which a token belongs to the prefix."""
    size = sets.size
    needed = (rule.percent * size + 99) // 100
    base = size - needed + 1
    rank = np.arange(len(sets.keys)) - sets.bounds[:-1][sets.doc]
    cost = np.where(rank < base[sets.doc], frequency[sets.keys % np.uint64(SLOTS)], 0)
    total = np.maximum(sums(cost, sets.bounds) / CHEAP, 1)
    matches = np.minimum(np.minimum(1 + np.floor(np.log2(total)).astype(np.int64), LONGEST), np.maximum(needed, 1))
    chosen = np.zeros(len(size), bool)
    chosen[sets.first_of_each()] = True
    take = chosen[sets.doc] & (rank < (base + matches - 1)[sets.doc])
    doc = sets.doc[take]
    level = np.maximum(rank[take] - base[doc] + 2, 1)
    return {"token": sets.keys[take].astype(np.int64), "node": sets.hash[doc], "size": size[doc], "level": level, "matches": matches[doc]}


def postings(docs: DataFrame, frequency: np.ndarray, rule: Rule) -> DataFrame:
    """(token, node, size, level, matches, texts): prefix tokens that several different sets share."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column(0), PIECE_BYTES):
                found = prefixes(Sets(texts, rule.words, shared.value), shared.value, rule)
                packed = found["size"] << 8 | found["level"] << 4 | found["matches"]
                yield pa.RecordBatch.from_pydict({"token": pa.array(found["token"]), "node": pa.array(found["node"]), "packed": pa.array(packed)})

    rows = docs.select("text").mapInArrow(run, "token long, node long, packed long").repartition("token")
    rows = rows.groupBy("token", "node").agg(F.min("packed").alias("packed"))
    rows = rows.withColumn("texts", F.expr("count(*) OVER (PARTITION BY token)")).where("texts > 1")
    rows = rows.select(
        "token", "node", "texts", F.shiftright("packed", 8).alias("size"),
        F.expr("(packed >> 4) & 15").alias("level"), F.expr("packed & 15").alias("matches"),
    )
    return materialise(rows, "join-postings")


def candidates(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of texts in different components that pass the length filter and the folded bit tables, and share
    enough prefix tokens."""
    a = posts.select("token", *[F.col(c).alias(f"{c}_a") for c in posts.columns if c != "token"])
    b = posts.select("token", *[F.col(c).alias(f"{c}_b") for c in posts.columns if c != "token"])
    near = "node_a < node_b AND 100 * least(size_a, size_b) >= {0} * greatest(size_a, size_b)".format(percent)
    differ = " + ".join(f"bit_count(fold_a[{k}] ^ fold_b[{k}])" for k in range(1 << (LEAST_BITS - 6)))
    total = "(size_a + size_b)"
    near += f" AND {differ} <= {total} - 2 * (({percent} * {total} + {99 + percent}) div {100 + percent})"
    near += " AND greatest(level_a, level_b) <= least(matches_a, matches_b) AND component_a <> component_b"
    pairs = a.join(b, "token").where(near)
    counted = pairs.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(
        F.count("*").alias("n"), F.first(F.least("matches_a", "matches_b")).alias("least_n")
    )
    return counted.where("n >= least_n").select("a", "b")


def not_ruled_out(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bit tables allow the similarity asked for."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    tables = facts.join(nodes, "node", "left_semi").dropDuplicates(["node"]).select("node", "size", "parity")
    tables = materialise(tables, "join-parities")
    a, b = (tables.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("parity").alias(f"parity_{s}")) for s in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(batch.column(f"size_{s}").to_numpy(zero_copy_only=False) for s in "ab")
            # A link shares at least percent / (100 + percent) of the two sizes' sum.
            allowed = size - 2 * (-(-percent * size // (100 + percent)))
            keep = np.zeros(len(size), bool)
            for i, (x, y) in enumerate(zip(batch.column("parity_a").to_pylist(), batch.column("parity_b").to_pylist())):
                least = min(len(x), len(y))
                differ = halved(np.frombuffer(x, np.uint8), least) ^ halved(np.frombuffer(y, np.uint8), least)
                keep[i] = int(np.bitwise_count(differ).sum()) <= allowed[i]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def whole_sets(docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """(node, shingles) of the texts behind ``nodes`` (node, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column("text"), PIECE_BYTES):
                sets = Sets(texts, rule.words)
                lists = pa.ListArray.from_arrays(pa.array(sets.bounds.astype(np.int32)), pa.array(sets.keys.astype(np.int64)))
                yield pa.RecordBatch.from_pydict({"node": pa.array(sets.hash), "shingles": lists})

    wanted = materialise(nodes.select("id", F.col("node").alias("wanted")), "join-wanted")
    found = lookup(docs, wanted, [("id", "id")], how="inner").select("text")
    sets = found.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])
    return materialise(sets, "join-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    linked = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
    return pairs.join(left, "a").join(right, "b").where(linked).select("a", "b")


def links(docs: DataFrame, facts: DataFrame, frequency: np.ndarray, rule: Rule) -> DataFrame:
    """Verified links (a, b) between different sets: all that components need."""
    posts = postings(docs, frequency, rule)
    ids = facts.where("size > 0 AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"))

    def check(pairs: DataFrame, name: str) -> DataFrame:
        pairs = materialise(not_ruled_out(materialise(pairs, f"join-{name}"), facts, rule.percent), f"join-{name}-near")
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        return materialise(verified(pairs, whole_sets(docs, ids.join(nodes, "node"), rule), rule.percent), f"join-{name}-links")

    folds = facts.groupBy("node").agg(F.first("fold").alias("fold"))
    # The text behind a group of near copies has no shingles of its own, so it is in more and longer lists than its copies.
    fame = posts.groupBy("node").agg(F.sum("texts").alias("fame"))
    posts = materialise(posts.join(folds, "node").join(fame, "node"), "join-posts")
    found, groups, total = None, None, 0
    for turn in range(ROUNDS):
        starred = check(stars(in_components(posts.where(F.col("texts") > LIST), groups), turn, rule.percent), f"stars-{turn}")
        fresh = starred.count()
        if turn and not fresh:
            break
        found, total = starred if found is None else found.unionByName(starred), total + fresh
        groups = materialise(neighbours(found), "join-neighbours")
        if fresh * WORTHWHILE < total:
            break
    groups = connected(found)
    apart = materialise(in_components(posts, groups).drop("texts", "fame"), "join-apart")
    mixed = apart.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    apart = apart.join(mixed.select("token"), "token", "left_semi")
    rest = check(candidates(apart, rule.percent), "pairs")
    return found.unionByName(rest)


def neighbours(links: DataFrame) -> DataFrame:
    """(node, component): the least of the texts asked that a text is linked to, itself included if it was asked.

    Texts of one such component are connected through it, which is all that comparing fewer of them takes.
    """
    ends = links.select(F.col("b").alias("node"), "a").unionByName(links.select(F.col("a").alias("node"), "a"))
    return ends.groupBy("node").agg(F.min("a").alias("component"))


def in_components(posts: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``posts`` with the component that the links so far give each text."""
    if groups is None:
        return posts.withColumn("component", F.col("node"))
    return posts.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))


def stars(posts: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of one text of each posting list and those of the list that are not in its component.

    The first text asked is that of most fame. Later ones are others, by a hash, that are not in its component yet.
    """
    texts, token = F.struct("node", "size", "component", "fold"), Window.partitionBy("token")
    asked = F.struct("fame", "node")
    if turn:
        posts = posts.withColumn("first_component", F.max_by("component", asked).over(token))
        asked = F.when(F.col("component") != F.col("first_component"), F.xxhash64(F.lit(turn), F.col("node")))
    # The text asked travels along its list, so the postings are dealt by token once and joined with nothing.
    met = posts.withColumn("p", F.max_by(texts, asked).over(token))
    near = f"component <> p.component AND 100 * least(size, p.size) >= {percent} * greatest(size, p.size)"
    differ = " + ".join(f"bit_count(fold[{k}] ^ p.fold[{k}])" for k in range(1 << (LEAST_BITS - 6)))
    near += f" AND {differ} <= size + p.size - 2 * (({percent} * (size + p.size) + {99 + percent}) div {100 + percent})"
    return met.where(near).select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(id, n_shingles, component_id): the size of each text's set and the least id its links reach, itself included."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with settings(docs.sparkSession, arrow_batches(BATCH_BYTES)):
        facts, frequency = facts_and_frequencies(docs, rule)
        found = links(docs, facts, frequency, rule)
    groups = connected(found)
    nodes = facts.where("size > 0").groupBy("node").agg(F.min("id").alias("least")).join(groups, "node", "left")
    nodes = materialise(nodes.withColumn("component", F.coalesce("component", "node")), "join-nodes")
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(nodes.join(least, "component").select("node", "component_id"), "join-components")
    found = lookup(facts, named, [("node", "node")])
    own = F.when((F.col("size") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select("id", F.col("size").alias("n_shingles"), own.alias("component_id"))
