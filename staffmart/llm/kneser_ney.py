"""Modified Kneser-Ney models over the characters of running text, counted by Spark.

A text is read as its lower-cased words with one blank between them and a line break at either end, so contexts reach from
word to word, not from text to text. An n-gram is a run of at most ``order`` such characters. Counts are kept for two classes
(a single-class model leaves the second empty). The highest order uses raw counts, lower orders the number of distinct left
neighbours. N-grams of two and more characters that begin before a word or text have raw counts in all orders: what stands left
of a blank is the end of another word, and how many ends a word follows says little about how often it is used. Orders up to ``shared`` pool both classes.

No n-gram is left out. Discounts, contexts and interpolated probabilities are joins of n-gram tables on Spark. The logarithm
of a probability is a sum over the orders: each context met adds the logarithm of its backoff weight, each n-gram met adds what it
has above its backoff. So the model is one table of (hash, addend) in which an unknown hash counts as zero, and can be cut
anywhere: it travels as sorted hash arrays in blocks of some ``BLOCK`` entries, as many as it takes, and neither the driver
nor a task holds more than one of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmart.llm.text import chunks, mix, split_words
from staffmart.session import materialise

ORDER = 6
BLOCK = 1 << 22  # hashes and addends of so many entries take 48 MB
SCORED_BYTES = 1 << 20  # texts scored at once: the tables of their n-grams take a hundred times as much
EDGE, BLANK = 10, 32  # the line break and the blank: no word contains them
FACTOR = 0x9E3779B97F4A7C15
CONTEXT = np.uint64(0xD1B54A32D192ED03)  # tells a context's hash from that of the same n-gram
CLASSES = (0, 1)


def factor(power: int) -> np.uint64:
    return np.uint64(pow(FACTOR, power, 1 << 64))


@dataclass
class Running:
    """Characters of all texts between edges; the edge before each; where words end; the symbols that each text with words has."""

    points: np.ndarray
    start: np.ndarray
    separators: np.ndarray
    lengths: np.ndarray


def running(words: pa.Array, bounds: np.ndarray) -> Running:
    """Texts of ``words`` within neighbouring ``bounds``; those without words are passed over."""
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pc.utf8_lower(words))
    texts = pc.binary_join(lists.filter(pa.array(np.diff(bounds) > 0)), " ")
    joined = "\n" + "".join(text + "\n" for text in texts.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    edges = points == EDGE
    last = np.maximum.accumulate(np.where(edges, np.arange(len(points)), 0))
    start = np.concatenate(([0], last[:-1]))
    points = np.where(points == 0, np.uint64(0xFFFD), points)
    return Running(points, start, np.flatnonzero(edges | (points == BLANK)), np.diff(np.flatnonzero(edges)))


def longest(text: Running, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character after an edge: hash and length of the longest n-gram that ends there; their positions."""
    at = np.arange(1, len(text.points))
    length = np.minimum(at - text.start[1:] + 1, order)
    key = text.points[1:].copy()
    for back in range(1, order):
        part = text.points[: len(text.points) - back] * factor(back)
        key[back - 1 :] += np.where(back < length[back - 1 :], part, np.uint64(0))
    return key, length, at


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's number among the distinct ones, and where each distinct one stands first."""
    codes, unique = pd.factorize(keys)
    first = np.empty(len(unique), np.int64)
    first[codes[::-1]] = np.arange(len(keys))[::-1]
    return codes, first


def count_chunk(texts: pa.Array, classes: np.ndarray, order: int) -> pa.RecordBatch:
    words, bounds = split_words(texts)
    text = running(words, bounds)
    key, length, at = longest(text, order)
    of = np.repeat(classes[np.diff(bounds) > 0], text.lengths)
    codes, first = distinct(key)
    matrix = np.zeros((len(first), order), "<u4")
    begin, size = at[first] - length[first] + 1, length[first]
    for j in range(order):
        matrix[j < size, j] = text.points[begin[j < size] + j]
    columns = {"gram": pa.array(matrix.view(f"<U{order}").ravel().tolist(), pa.string())}
    for c in CLASSES:
        columns[f"n{c}"] = pa.array(np.bincount(codes[of == c], minlength=len(first)).astype(np.int64))
    return pa.RecordBatch.from_pydict(columns)


def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n0, n1) over all ``rows`` (text, cls 0 or 1): grams of ``order`` characters and shorter ones at text starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = batch.column("cls").to_numpy(zero_copy_only=False)
            for first, texts in chunks(batch.column("text")):
                yield count_chunk(texts, classes[first : first + len(texts)], order)

    counted = rows.select("text", "cls").mapInArrow(run, "gram string, n0 long, n1 long")
    return counted.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def all_lengths(top: DataFrame, order: int, shared: int) -> dict[int, DataFrame]:
    """Tables (gram, n0, n1) by length, with Kneser-Ney counts below the highest."""
    top = materialise(top, "kn-counts")
    level = top.where(F.length("gram") == order)
    levels = {order: level}
    pooled = {n: F.col("n0") + F.col("n1") for n in ("n0", "n1")}
    begins = F.expr("filter(sequence(1, length(gram) - 1), i -> (i > 1 or length(gram) < %d) and substring(gram, i, 1) in (' ', '\n'))" % order)
    starts = top.where(F.length("gram") > 1).select(F.explode(begins).alias("i"), "gram", "n0", "n1")
    starts = starts.groupBy(F.expr("substring(gram, i)").alias("gram")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    starts = materialise(starts, "kn-starts")
    for length in range(order - 1, 0, -1):
        left = level.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(
            *[F.sum((F.col(n) > 0).cast("long")).alias(n) for n in ("n0", "n1")]
        )
        if length > 1:
            left = left.where("substring(gram, 1, 1) <> ' '")
        raw = starts.where(F.length("gram") == length)
        if length <= shared:
            raw = raw.withColumns(pooled)
        if length == shared:  # shorter lengths are derived from what is pooled here
            left = left.withColumns(pooled)
        level = levels[length] = materialise(left.unionByName(raw), f"kn-{length}")
    return levels


def discounts(counts: list[int]) -> list[float]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams seen once to four times."""
    one, two, three, four = (max(c, 1) for c in counts)
    y = one / (one + 2 * two)
    raw = (1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three)
    return [min(max(d, 0.1 * (i + 1)), 0.95 * (i + 1)) for i, d in enumerate(raw)]


@dataclass
class Model:
    """Blocks of (sorted hashes, addends); ``base`` is the addend of every character, known or not."""

    order: int
    base: float
    blocks: list[Broadcast]


def rated(level: DataFrame, shorter: DataFrame | None, alphabet: int) -> DataFrame:
    """(gram, context, per class l: log-probability, g: log backoff weight of the context, d: what the n-gram adds to its backoff)."""
    facts = level.agg(*[F.count_if(F.col(f"n{c}") == k).alias(f"k{c}{k}") for c in CLASSES for k in (1, 2, 3, 4)]).first()
    level = level.withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)"))
    cut = {}
    for c in CLASSES:
        n = F.col(f"n{c}")
        one, two, more = discounts([facts[f"k{c}{k}"] for k in (1, 2, 3, 4)])
        cut[c] = F.when(n >= 3, more).when(n == 2, two).when(n == 1, one).otherwise(0.0)
    totals = level.groupBy("context").agg(
        *[F.sum(f"n{c}").alias(f"c{c}") for c in CLASSES], *[F.sum(cut[c]).alias(f"cut{c}") for c in CLASSES]
    )
    joined = level.join(totals, "context")
    if shorter is not None:
        shorter = shorter.select(F.col("gram").alias("suffix"), *[F.col(f"l{c}").alias(f"s{c}") for c in CLASSES])
        joined = joined.withColumn("suffix", F.expr("substring(gram, 2)")).join(shorter, "suffix")
    columns: list[Column] = [F.col("gram"), F.col("context")]
    for c in CLASSES:
        total, known = F.col(f"c{c}"), F.col(f"c{c}") > 0
        share = F.when(known, (F.col(f"n{c}") - cut[c]) / total).otherwise(0.0)
        weight = F.when(known, F.col(f"cut{c}") / total).otherwise(1.0)
        below = F.lit(float(-np.log(alphabet))) if shorter is None else F.col(f"s{c}")
        log = F.log(share + weight * F.exp(below))
        columns += [log.alias(f"l{c}"), F.log(weight).alias(f"g{c}"), (log - F.log(weight) - below).alias(f"d{c}")]
    return joined.select(*columns)


def hashed(grams: pa.Array) -> np.ndarray:
    """The polynomial hash of each n-gram, as ``longest`` has it."""
    joined = "".join(grams.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    size = pc.utf8_length(grams).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    key = np.zeros(len(size), np.uint64)
    for back in range(int(size.max()) if len(size) else 0):
        inside = back < size
        key[inside] += points[ends[inside] - 1 - back] * factor(back)
    return key


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, is_context, value) to (key, value)."""
    for batch in batches:
        key = hashed(batch.column("gram"))
        context = batch.column("is_context").to_numpy(zero_copy_only=False)
        key = mix(np.where(context, key ^ CONTEXT, key))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("value")], names=["key", "value"])


def fit(rows: DataFrame, order: int = ORDER, shared: int = 0, weights: tuple[float, float] = (1.0, 0.0)) -> Model:
    """Count ``rows`` (text, cls) and build the model of the classes' log-probabilities, times ``weights`` and summed.

    Without any words every character has the same probability in both classes.
    """
    levels = all_lengths(count_grams(rows, order), order, shared)
    alphabet = 1 + levels[1].count()
    weigh = lambda name: sum(F.lit(w) * F.col(f"{name}{c}") for c, w in zip(CLASSES, weights))
    table, shorter, base = None, None, sum(weights) * float(-np.log(alphabet))
    for length in range(1, order + 1):
        shorter = materialise(rated(levels[length], shorter, alphabet), f"kn-rated-{length}")
        part = shorter.select("gram", F.lit(False).alias("is_context"), weigh("d").alias("value"))
        table = part if table is None else table.unionByName(part)
        met = shorter.groupBy(F.col("context").alias("gram")).agg(*[F.first(f"g{c}").alias(f"g{c}") for c in CLASSES])
        if length > 1:
            table = table.unionByName(met.select("gram", F.lit(True).alias("is_context"), weigh("g").alias("value")))
        elif (first := met.first()) is not None:
            base += sum(w * first[f"g{c}"] for c, w in zip(CLASSES, weights))
    table = table.withColumn("value", F.col("value").cast("float")).where("value <> 0").mapInArrow(keyed, "key long, value float")
    table = materialise(table, "kn-table")
    count = max(1, -(-table.count() // BLOCK))
    if count > 1:
        table = table.withColumn("block", F.pmod(F.col("key"), F.lit(count)).cast("int"))
        table = materialise(table.repartition(count, "block").sortWithinPartitions("block"), "kn-blocks")
    blocks = []
    for b in range(count):
        own = (table.where(F.col("block") == b) if count > 1 else table).select("key", "value").toArrow()
        keys = own["key"].to_numpy().view(np.uint64)
        sort = np.argsort(keys)
        blocks.append(rows.sparkSession.sparkContext.broadcast((keys[sort], own["value"].to_numpy()[sort])))
    return Model(order, base, blocks)


def release(model: Model) -> None:
    """Take the model off the executors; results that depend on it must have been stored."""
    for block in model.blocks:
        block.destroy()


def addends(model: Model, text: Running, at: np.ndarray, length: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The sum of the addends of each n-gram that ends ``at`` a character and of their contexts; the same up to length ``word`` only."""
    wanted = []
    gram, context = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for n in range(1, model.order + 1):
        rows = np.flatnonzero(n <= length)
        added = text.points[at[rows] - n + 1]
        gram[rows] += added * factor(n - 1)
        wanted.append((n, rows, mix(gram[rows])))
        if n > 1:  # the context lacks the last character, so its powers are one lower
            context[rows] += added * factor(n - 2)
            wanted.append((n, rows, mix(context[rows] ^ CONTEXT)))
    value = np.full((2, len(at)), model.base)
    wanted = [(n, rows[sort], keys[sort]) for n, rows, keys in wanted for sort in [np.argsort(keys)]]  # neighbours are found close together
    for block in model.blocks:
        known, add = block.value
        for n, rows, keys in wanted:
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[place] == keys
                rows, found = rows[hit], add[place[hit]]
                value[0, rows] += found
                within = n <= word[rows]
                value[1, rows[within]] += found[within]
        if len(model.blocks) > 1:  # the next one is read from disk in its place
            del known, add
            vars(block).pop("_value", None)
    return value


def word_values(model: Model, words: pa.Array, bounds: np.ndarray, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """For each word the sum over its characters and the separator after it, in the context of the words before and alone
    (contexts reach to the separator before it), shape (2, words); and the number of those characters.

    A character counts at most ``most`` either way."""
    text = running(words, bounds)
    key, length, at = longest(text, model.order)
    if not len(at):
        return np.zeros((2, 0)), np.zeros(0)
    codes, first = distinct(key)
    at, length = at[first], length[first]
    word = np.minimum(length, at - text.separators[np.searchsorted(text.separators, at) - 1] + 1)
    value = np.clip(addends(model, text, at, length, word), -most, most)[:, codes]
    total = np.concatenate((np.zeros((2, 1)), np.cumsum(value, axis=1)), axis=1)
    return np.diff(total[:, text.separators]), np.diff(text.separators).astype(np.float64)
