"""Removal of repeated byte strings by sorted suffixes at anchors.

A byte goes if a string of 200 bytes that covers it starts anywhere else too. Matches do not cross texts.

1. Filter. Every string of 200 bytes has a least hash among its 32-byte pieces; equal strings have equal ones at the same
   place. The pieces with these hashes are anchors, about one in 85 bytes. Hashes that occur at two or more places are set in a
   bit table of fixed size; only strings around such anchors can repeat.
2. Contexts. An anchor travels with the bytes that a string around it can reach: up to 168 before it, and 200 from it on. Equal
   contexts within a piece of the corpus are settled there and travel once, so even thousands of copies send one a piece.
3. Matches. Anchors are dealt by hash. Each task sorts the suffixes at its anchors, and the reversed texts before them, and takes
   the common prefixes of neighbours. Strings that begin k bytes before their anchors are equal if the suffixes share 200 - k
   bytes and the texts before them k, for k from 0 to 168. All strings around an anchor overlap, so the least and
   largest k that repeat tell which of its bytes go.
4. Pieces at more than ``RANGE`` places would make a task too large. The strings around them are sorted one by one instead, in runs
   of suffixes cut at 200 bytes: front-coded, exchanged by ranges of the suffix order that are split at quantiles, and merged by loser
   trees whose contenders carry the length of their common prefix with the last winner. A winner that shares 200 bytes with
   the winner before repeats.
5. The spans that go are joined to their text and cut out.

Defined results: NULL is an empty text; rows are told apart by a hash of id and text, and two equal rows repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.llm.text import chunks, mix
from staffmart.operators.joins import lookup
from staffmart.session import materialise

LENGTH = 200
PIECE = 32
BITS = 1 << 27  # of the filter
BLOCK_BITS = 1 << 16
CHUNK = 512 << 10  # bytes of text in one run, and hashed at once
RANGE = 200_000  # suffixes merged by one task, or places of a piece
DEALT = 50_000  # anchors matched by one task
REACH = LENGTH - PIECE  # bytes before an anchor that a string around it can hold
SAMPLED = 8192  # one in so many suffixes helps to find the ranges
ROWS = 1 << 14  # suffixes laid out as rows at a time
PART = 1 << 14  # suffixes in a row of the run table at most


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or largest of every ``width`` neighbours."""
    pick, fill = (np.minimum, np.uint64(2**64 - 1)) if least else (np.maximum, np.uint64(0))
    padded = np.concatenate((values, np.full(-len(values) % width, fill))).reshape(-1, width)
    forward = pick.accumulate(padded, axis=1).ravel()
    backward = pick.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return pick(backward[:n], forward[width - 1 : width - 1 + n])


def piece_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of every ``PIECE`` bytes, by doubling."""
    hashes, factor, width = raw.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    while width < PIECE:
        hashes = hashes[:-width] * factor + hashes[width:]
        factor, width = np.uint64(int(factor) ** 2 % (1 << 64)), 2 * width
    return mix(hashes)


def stretches(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(rows, first bytes, bytes) of some texts, a bounded number of bytes at a time.

    A long text is cut into stretches that overlap by one byte less than a string, so every string starts in just one of them.
    """
    texts = pc.fill_null(texts, "").cast(pa.binary())
    rows, bases = np.arange(len(texts)), np.zeros(len(texts), np.int64)
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    if len(texts) and lengths.max() > CHUNK + LENGTH - 1:
        cuts = [(row, base) for row, n in enumerate(lengths.tolist()) for base in range(0, max(n - LENGTH + 1, 1), CHUNK)]
        rows, bases = (np.array(column, np.int64) for column in zip(*cuts))
        views = [memoryview(text.as_buffer()) for text in texts]
        texts = pa.array([views[row][base : base + CHUNK + LENGTH - 1].tobytes() for row, base in cuts], pa.binary())
    for first, part in chunks(texts, CHUNK):
        yield rows[first : first + len(part)], bases[first : first + len(part)], part


class Strings:
    """The strings of ``LENGTH`` bytes of some texts laid end to end."""

    def __init__(self, texts: pa.Array):
        texts = pa.concat_arrays([texts])
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        size = np.diff(self.offsets)
        first = self.offsets[:-1]
        count = np.maximum(size - LENGTH + 1, 0)
        # Within a chunk 32 bits are enough; a longer text is a chunk of its own.
        narrow = np.int32 if self.offsets[-1] < 1 << 31 else np.int64
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), count)
        self.start = np.arange(len(self.doc), dtype=narrow) - np.repeat((np.cumsum(count) - count).astype(narrow), count)
        self.at = first.astype(narrow)[self.doc] + self.start
        self.least = np.zeros(0, np.uint64)
        if len(self.at):
            self.pieces = piece_hashes(self.raw)
            self.windows = sliding(self.pieces, LENGTH - PIECE + 1, True)
            self.least = self.windows[self.at]

    def anchors(self) -> np.ndarray:
        """The places that hold the least hash for some string."""
        if not len(self.at):
            return np.zeros(0, np.int64)
        width = LENGTH - PIECE + 1
        valid = np.zeros(len(self.windows), bool)
        valid[self.at] = True
        own = np.where(valid, self.windows, np.uint64(0))
        pad = np.zeros(width - 1, np.uint64)
        largest = sliding(np.concatenate((pad, own, pad)), width, False)
        held = (self.pieces <= largest[: len(self.pieces)]) & (largest[: len(self.pieces)] > 0)
        return np.flatnonzero(held)


def bit_of(hashes: np.ndarray) -> np.ndarray:
    """The place of each hash in the bit table."""
    return (hashes.view(np.int64) % BITS).astype(np.int64)


def repeated_pieces(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The filter (bits of the least hashes found at two or more places), the hashes found at more than ``RANGE``, and the number of all such places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in stretches(batch.column("text")):
                strings = Strings(texts)
                places = strings.anchors()
                hashes, count = np.unique(strings.pieces[places] if len(places) else strings.least, return_counts=True)
                yield pa.RecordBatch.from_pydict({"hash": pa.array(hashes.view(np.int64)), "n": pa.array(count.astype(np.int64))})

    def block(key, table):
        bits = np.zeros(BLOCK_BITS, bool)
        bits[table["bit"].to_numpy() % BLOCK_BITS] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()])})

    counted = docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")
    counted = materialise(counted, "suffix-pieces")
    found = counted.select(F.pmod("hash", F.lit(BITS)).alias("bit")).distinct()
    found = found.withColumn("block", F.floor(F.col("bit") / F.lit(BLOCK_BITS)))
    # At most BITS / 8 bytes come out, whatever the corpus.
    blocks = found.groupBy("block").applyInArrow(block, "block long, bits binary").toArrow()
    bits = np.zeros(BITS // 8, np.uint8)
    for number, packed in zip(blocks["block"].to_pylist(), blocks["bits"].to_pylist()):
        bits[number * BLOCK_BITS // 8 :][: BLOCK_BITS // 8] = np.frombuffer(packed, np.uint8)
    # One in RANGE places at most.
    crowded = counted.where(F.col("n") > RANGE).select("hash").toArrow()["hash"].to_numpy()
    return bits, np.sort(crowded).view(np.uint64), counted.agg(F.sum("n")).first()[0] or 0


def candidates(strings: Strings, bits: np.ndarray) -> np.ndarray:
    """The numbers of the strings whose bit is set."""
    return np.flatnonzero(is_set(bits, strings.least))


def is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = bit_of(hashes)
    return bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1


def laid_out(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first, rows of ``LENGTH`` bytes) for the suffixes at some places, a bounded number at a time."""
    matrix = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    for first in range(0, len(at), ROWS):
        yield first, matrix[at[first : first + ROWS]]


def range_of(raw: np.ndarray, at: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The range of the suffix order that each suffix belongs to, by all its bytes."""
    place = np.zeros(len(at), np.int64)
    for first, rows in laid_out(raw, at):
        place[first : first + len(rows)] = np.searchsorted(splitters, rows.view(f"S{LENGTH}").ravel(), side="right")
    return place


def front_coded(rows: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> dict:
    """Sorted different suffixes (one a row) as shared prefix lengths, rests, row keys and starts."""
    shared = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        shared[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
    rests = rows[np.arange(LENGTH) >= shared[:, None]].tobytes()
    return {"shared": shared.astype(np.uint8).tobytes(), "rests": rests, "keys": keys, "starts": starts}


RUNS = "range int, shared binary, rests binary, keys array<long>, starts array<int>"


def sorted_runs(batch: pa.RecordBatch, bits: np.ndarray, splitters: np.ndarray) -> Iterator[dict]:
    """Parts of sorted runs by range; range -1 holds the starts that a run has settled as repeated."""
    row_keys = batch.column("key").to_numpy(zero_copy_only=False)
    for rows_of, bases, texts in stretches(batch.column("text")):
        strings = Strings(texts)
        chosen = candidates(strings, bits)
        if not len(chosen):
            continue
        doc, at, raw = strings.doc[chosen], strings.at[chosen], strings.raw
        key, start = row_keys[rows_of[doc]], (bases[doc] + strings.start[chosen]).astype(np.int32)
        del strings, chosen
        order = suffix_order(raw, at)
        same = np.zeros(len(order), bool)
        before = None
        for begin, rows in laid_out(raw, at[order]):
            if before is not None:
                same[begin] = (rows[0] == before).all()
            same[begin + 1 : begin + len(rows)] = (rows[1:] == rows[:-1]).all(axis=1)
            before = rows[-1]
        repeated = same.copy()
        repeated[:-1] |= same[1:]
        settled = order[repeated]
        for begin in range(0, len(settled), PART):
            part = settled[begin : begin + PART]
            yield {"range": -1, "shared": None, "rests": None, "keys": key[part], "starts": start[part]}
        order = order[~same]
        place = range_of(raw, at[order], splitters)
        edges = np.flatnonzero(np.diff(place, prepend=-1, append=place[-1] + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            for begin in range(a, b, PART):
                part = order[begin : min(begin + PART, b)]
                rows = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[at[part]]
                yield {"range": int(place[a]), **front_coded(rows, key[part], start[part])}


def suffix_order(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order of the suffixes at some places, from ranks of their first 8, 16, ... bytes.

    Ranks are known for all places that a suffix can reach; a place near the end counts as if zeros followed.
    """
    padded = np.concatenate((raw, np.zeros(2 * LENGTH, np.uint8)))
    key = np.zeros(len(raw) + LENGTH, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + len(key)]
    covered = np.bincount(at, minlength=len(key)) - np.bincount(at + LENGTH, minlength=len(key))
    places = np.flatnonzero(np.cumsum(covered) > 0)
    rank = np.zeros(len(key), np.int64)
    rank[places] = np.unique(key[places], return_inverse=True)[1]
    del key, covered
    width = 8
    while width < LENGTH:
        step = min(width, LENGTH - width)
        # Of overlapping halves the first comes first: ranks of both together order twice the width, or all of it at last.
        both = rank[places] << 32 | rank[np.minimum(places + step, len(rank) - 1)]
        rank[places] = np.unique(both, return_inverse=True)[1]
        width += step
    return np.argsort(rank[at], kind="stable")


class Run:
    """A front-coded run being read: the current suffix and the prefix it shares with the last winner."""

    def __init__(self, shared: bytes, rests: bytes, keys: Sequence[int], starts: Sequence[int]):
        self.shared, self.rests, self.keys, self.starts = shared, rests, keys, starts
        self.number, self.at, self.suffix, self.common = -1, 0, b"", 0
        self.advance()

    def advance(self) -> None:
        """The next suffix; what it shares with the one before, just the winner, is in the run."""
        self.number += 1
        if self.number == len(self.shared):
            self.suffix, self.common = None, -1
            return
        self.common = self.shared[self.number]
        rest = LENGTH - self.common
        self.suffix = self.suffix[: self.common] + self.rests[self.at : self.at + rest]
        self.at += rest


def beats(a: Run, b: Run) -> bool:
    """Whether ``a`` comes before ``b``; the loser's common length becomes that with the winner."""
    if a.common != b.common:
        return a.common > b.common
    if a.suffix is None:
        return True
    x, y, i = a.suffix, b.suffix, a.common
    while i < LENGTH and x[i] == y[i]:
        step = 16  # equal stretches are passed in slices
        while i + step <= LENGTH and x[i : i + step] == y[i : i + step]:
            i += step
        while i < LENGTH and x[i] == y[i]:
            i += 1
    if i == LENGTH or x[i] < y[i]:
        b.common = i
        return True
    a.common = i
    return False


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(common prefix with the winner before, row key, start) of all suffixes in order, by a loser tree."""
    size = 1
    while size < len(runs):
        size *= 2
    leaves = runs + [Run(b"", b"", [], []) for _ in range(size - len(runs))]
    losers: list[Run | None] = [None] * size

    def play(node: int) -> Run:
        if node >= size:
            return leaves[node - size]
        a, b = play(2 * node), play(2 * node + 1)
        winner, losers[node] = (a, b) if beats(a, b) else (b, a)
        return winner

    place = {id(run): size + i for i, run in enumerate(leaves)}
    for run in leaves:
        run.common = min(run.common, 0)  # nothing has won yet
    winner = play(1)
    while winner.suffix is not None:
        yield winner.common, winner.keys[winner.number], winner.starts[winner.number]
        node = place[id(winner)] // 2
        winner.advance()
        while node:
            other = losers[node]
            if not beats(winner, other):
                winner, losers[node] = other, winner
            node //= 2


def merged_range(table: pa.Table) -> pa.Table:
    """(key, start) of the suffixes of a range that repeat across runs."""
    columns = {name: table[name].combine_chunks() for name in ("keys", "starts")}
    lists = {name: [column[i].values.to_numpy() for i in range(table.num_rows)] for name, column in columns.items()}
    runs = [
        Run(shared.as_py(), rests.as_py(), keys, starts)
        for shared, rests, keys, starts in zip(table["shared"], table["rests"], lists["keys"], lists["starts"])
    ]
    keys, starts, before = [], [], None
    for common, key, start in merge(runs):
        if common == LENGTH:
            keys += [before[0], key]
            starts += [before[1], start]
        before = (key, start)
    return pa.table({"key": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int32())})


def padded_rows(raw: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The bytes around some places, ``REACH`` before and ``LENGTH`` from each on; zeros beyond left and right."""
    around = np.concatenate((np.zeros(REACH, np.uint8), raw, np.zeros(LENGTH, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(around, REACH + LENGTH)[at]
    place = np.arange(-REACH, LENGTH)
    rows[(place < -left[:, None]) | (place >= right[:, None])] = 0
    return rows


def contexts(batch: pa.RecordBatch, bits: np.ndarray, crowded: np.ndarray, dealt: int) -> Iterator[pa.RecordBatch]:
    """(bucket, key, at, left, right, settled, context) of the anchors whose bit is set: their place in the row's text and the bytes around it.

    A context is sent once a chunk; spans of copies have none. Settled rows need no match with another to go.
    """
    row_keys = batch.column("key").to_numpy(zero_copy_only=False)
    for rows_of, bases, texts in stretches(batch.column("text")):
        strings = Strings(texts)
        at = strings.anchors()
        hashes = strings.pieces[at] if len(at) else strings.least
        chosen = is_set(bits, hashes).astype(bool) & ~np.isin(hashes, crowded)
        at, hashes, raw = at[chosen], hashes[chosen], strings.raw
        if not len(at):
            continue
        doc = np.searchsorted(strings.offsets, at, side="right") - 1
        first, last = strings.offsets[doc], strings.offsets[doc + 1]
        del strings
        left, right = np.minimum(at - first, REACH), np.minimum(last - at, LENGTH)
        bucket = ((hashes >> np.uint64(16)) % np.uint64(dealt)).astype(np.int32)
        key, start = row_keys[rows_of[doc]], (bases[doc] + at - first).astype(np.int32)
        rows = padded_rows(raw, at, left, right)
        order = np.argsort(rows.view(f"S{REACH + LENGTH}").ravel(), kind="stable")
        same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1) & (left[order[1:]] == left[order[:-1]]) & (right[order[1:]] == right[order[:-1]])
        copy, settled = np.zeros(len(at), bool), np.zeros(len(at), bool)
        copy[order[1:][same]] = True
        settled[order[1:][same]] = settled[order[:-1][same]] = True
        # Neighbouring copies of one text go as one span; contexts come in order of their places.
        where = np.flatnonzero(copy)
        begin, end = (start - left)[where], (start + right)[where]
        new = np.ones(len(where), bool)
        new[1:] = (begin[1:] > end[:-1]) | (doc[where][1:] != doc[where][:-1])
        heads = np.flatnonzero(new)
        ends = np.maximum.reduceat(end, heads) if len(heads) else end
        kept = np.flatnonzero(~copy)
        place = np.arange(-REACH, LENGTH)
        flat = rows[kept][(place >= -left[kept][:, None]) & (place < right[kept][:, None])]
        offsets = np.concatenate(([0], np.cumsum((left + right)[kept]))).astype(np.int32)
        sent = pa.BinaryArray.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        some = where[heads]
        both = lambda a, b, kind: pa.array(np.concatenate((a, b)), kind)
        yield pa.RecordBatch.from_pydict({
            "bucket": both(bucket[kept], bucket[some], pa.int32()),
            "key": both(key[kept], key[some], pa.int64()),
            "at": both(start[kept], begin[heads], pa.int32()),
            "left": both(left[kept], np.zeros(len(some), np.int64), pa.int32()),
            "right": both(right[kept], ends - begin[heads], pa.int32()),
            "settled": both(settled[kept], np.ones(len(some), bool), pa.bool_()),
            "context": pa.concat_arrays([sent, pa.nulls(len(some), pa.binary())]),
        })


CONTEXTS = "bucket int, key long, at int, left int, right int, settled boolean, context binary"


def ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's place in their order, and what the rows in order share with the one before."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    shared = np.zeros(len(rows), np.int64)
    for first in range(1, len(rows), ROWS):
        part = order[first - 1 : first + ROWS]
        differ = rows[part[1:]] != rows[part[:-1]]
        shared[first : first + ROWS] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return place, shared


def most_shared(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """What each row shares with any other at most."""
    return np.maximum(shared, np.append(shared[1:], 0))[place]


def repeated_reach(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes before its anchor the last and the first repeated string around it begin; (``LENGTH``, -1) without any."""
    least, most = np.full(len(rows), LENGTH), np.full(len(rows), -1)
    if len(rows) < 2:
        return least, most
    after, shared_after = ranked(rows[:, REACH:])
    before, shared_before = ranked(rows[:, REACH - 1 :: -1])
    near_after = np.minimum(most_shared(after, shared_after), right)
    near_before = np.minimum(most_shared(before, shared_before), left)
    for k in range(REACH + 1):
        some = np.flatnonzero((near_after >= LENGTH - k) & (near_before >= k))
        if len(some) < 2:
            continue
        # Neighbours in order that share enough are of one class, and strings of equal classes on both sides are equal.
        classes = np.cumsum(shared_after < LENGTH - k)[after[some]] * len(rows) + np.cumsum(shared_before < k)[before[some]]
        order = np.argsort(classes, kind="stable")
        same = classes[order[1:]] == classes[order[:-1]]
        found = some[np.unique(np.concatenate((order[1:][same], order[:-1][same])))]
        least[found] = np.minimum(least[found], k)
        most[found] = k
    return least, most


def matched(table: pa.Table) -> pa.Table:
    """(key, begin, end) of the bytes that go among the contexts of a bucket."""
    whole = {name: table[name].to_numpy() for name in ("key", "at", "left", "right", "settled")}
    begin, end = whole["at"] - whole["left"], whole["at"] + whole["right"]
    sent = table["context"].combine_chunks()
    texts = np.flatnonzero(pc.is_valid(sent).to_numpy(zero_copy_only=False))
    left, right = whole["left"][texts].astype(np.int64), whole["right"][texts].astype(np.int64)
    ends = np.cumsum(left + right)
    joined = b"".join(sent.drop_null().to_pylist())
    rows = padded_rows(np.frombuffer(joined, np.uint8), ends - right, left, right)
    least, most = repeated_reach(rows, left, right)
    goes = whole["settled"].copy()
    goes[texts] |= most >= 0
    own = ~whole["settled"][texts] & (most >= 0)
    begin[texts[own]] = whole["at"][texts[own]] - most[own]
    end[texts[own]] = whole["at"][texts[own]] - least[own] + LENGTH
    return pa.table({"key": pa.array(whole["key"][goes]), "begin": pa.array(begin[goes], pa.int32()), "end": pa.array(end[goes], pa.int32())})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, found): the spans (begin, end) that repeated strings cover in rows (key, text)."""
    repeated, crowded, places = repeated_pieces(docs)
    bits, dealt = docs.sparkSession.sparkContext.broadcast(repeated), -(-places // DEALT) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from contexts(batch, bits.value, crowded, dealt)

    spans = docs.select("key", "text").mapInArrow(run, CONTEXTS).repartition(dealt, "bucket")
    spans = spans.groupBy("bucket").applyInArrow(lambda table: matched(table), "key long, begin int, end int")
    if len(crowded):
        own = np.zeros(BITS, bool)
        own[bit_of(crowded)] = True
        spans = spans.unionByName(repeated_starts(docs, np.packbits(own)).selectExpr("key", "start AS begin", f"start + {LENGTH} AS end"))
    return spans.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("found"))


def repeated_starts(docs: DataFrame, repeated: np.ndarray) -> DataFrame:
    """(key, start): the starts of repeated strings of rows (key, text) whose bit is set."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(repeated)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in stretches(batch.column("text")):
                strings = Strings(texts)
                chosen = candidates(strings, bits.value)
                some = chosen[mix(strings.least[chosen] + strings.start[chosen].astype(np.uint64)) % np.uint64(SAMPLED) == 0]
                rows = [r.tobytes() for _, part in laid_out(strings.raw, strings.at[some]) for r in part] if len(some) else []
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(chosen)], pa.int64()), "order": pa.array([rows], pa.list_(pa.binary()))})

    sampled = materialise(docs.select("text").mapInArrow(sample, "n long, order array<binary>"), "suffix-sample")
    total = sampled.agg(F.sum("n")).first()[0] or 0
    picked = sampled.select(F.explode("order").alias("o"))
    # One sampled suffix in so many ends a range; a suffix sampled often ends one only.
    every = max(1, RANGE // SAMPLED)
    numbered = picked.withColumn("nth", F.expr("row_number() OVER (ORDER BY o)")) if total > RANGE else picked.limit(0).withColumn("nth", F.lit(0))
    splitters = numbered.where(F.col("nth") % every == 0).select("o").distinct().toArrow()["o"].to_pylist()
    splitters = np.sort(np.array(splitters, f"S{LENGTH}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("range", pa.int32()), ("shared", pa.binary()), ("rests", pa.binary()), ("keys", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32()))])
        for batch in batches:
            for row in sorted_runs(batch, bits.value, splitters):
                yield pa.RecordBatch.from_pydict({name: pa.array([row[name]], schema.field(name).type) for name in schema.names}, schema)

    parts = materialise(docs.select("key", "text").mapInArrow(run, RUNS), "suffix-runs")
    within = parts.where("range = -1").select(F.explode(F.arrays_zip("keys", "starts")).alias("s")).select("s.keys", "s.starts").toDF("key", "start")
    across = parts.where("range >= 0").groupBy("range").applyInArrow(lambda table: merged_range(table), "key long, start int")
    return within.unionByName(across)


def cut(data: bytes, found: list[dict] | None) -> dict:
    """What is left of a text after the spans found in it go."""
    gone = np.zeros(len(data) + 1, np.int64)
    np.add.at(gone, np.array([s["begin"] for s in found or []], np.int64), 1)
    np.add.at(gone, np.array([s["end"] for s in found or []], np.int64), -1)
    covered = np.cumsum(gone)[:-1] > 0
    kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
    spans = int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum())
    return {"n_bytes": len(data), "n_removed": int(covered.sum()), "n_spans": spans, "kept": kept}


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans) and the SHA-256 of what is left, or the bytes themselves."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    found = materialise(repeated_spans(rows).withColumnRenamed("key", "found_key"), "suffix-found")
    # Spans grow with the texts, so both are dealt by key whatever their size.
    joined = lookup(rows, found, [("key", "found_key")], small=False).select("id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column("text")):
                found = batch.column("found").slice(first, len(texts))
                out = [cut(t.as_py().encode(), s.as_py()) for t, s in zip(texts, found)]
                for row in out if digest else []:
                    row["kept"] = hashlib.sha256(row["kept"]).hexdigest()
                columns = {"id": batch.column("id").slice(first, len(texts))}
                columns |= {c: pa.array([r[c] for r in out], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}
                name = "kept_sha256" if digest else "kept"
                columns[name] = pa.array([r["kept"] for r in out], pa.string() if digest else pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    last = "kept_sha256 string" if digest else "kept binary"
    return joined.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, {last}")
