"""Byte-level BPE encoding and decoding as a tree reduction.

Encoded strings form a monoid: the halves of a string are encoded on their own, and neighbours are joined by encoding again a window around
the seam. The window grows until the tokens at both its ends fit those outside. Two neighbouring tokens fit if their bytes alone
encode to just these two. A sequence in which all neighbours fit is the encoding of its bytes: if the merges of the whole
string ever crossed a token's edge, then the first that does would, as the merges inside the two tokens come in the same order when
they stand alone, also happen to the two alone. The converse holds for the same reason, so neighbours inside a window
fit, only its ends need a test, and the result is exact for any table of ranks.

A text's top levels are cut before single spaces between other characters. There the pattern always begins a new match, whatever is on
the left, so these seams need no window; neither do those between matches. Decoding looks up the tokens' bytes and concatenates
neighbours level by level.

Defined results: a NULL text is an empty one and has no tokens; repeated rows and rows with equal or NULL ids are encoded each for
itself; a very long text is worked through in segments, a match without any break by halves, in time that is nearly proportional to its length;
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF = 8  # bytes merged directly
SHORT = 12  # bytes of strings whose tokens are remembered: leaves and most windows
REMEMBERED = 1 << 18  # such strings, and pairs of tokens
SMALL = 128  # bytes of a window in which every merge may look at all pairs
SEGMENT = 1 << 18  # characters of a text handled at once, if it has a space
KNOWN_BYTES = 8 << 20  # of matches a task remembers
KNOWN_MATCH = 256  # characters of the longest match remembered
NEVER = 1 << 62
COLUMNS = {"n_tokens": "long", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """A table of ranks: per line a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoding of byte strings by ranked merges, and decoding."""

    def __init__(self, ranks: Mapping[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.fitting: dict[tuple[int, int], bool] = {}
        self.short: dict[bytes, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a string without cutting it; short strings are remembered."""
        if len(data) > SHORT:
            return self.merged_by_heap(data) if len(data) > SMALL else self.merged_by_scan(data)
        known = self.short.get(data)
        if known is None:
            if len(self.short) > REMEMBERED:
                self.short.clear()
            known = self.short[data] = self.merged_by_scan(data)
        return known

    def merged_by_scan(self, data: bytes) -> list[int]:
        """The lowest-ranked pair is merged, the leftmost of equals, until none is left."""
        rank = self.ranks.get
        edges = list(range(len(data) + 1))
        pairs = [rank(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while pairs:
            least = min(pairs)
            if least == NEVER:
                break
            at = pairs.index(least)
            del edges[at + 1], pairs[at]
            if at:
                pairs[at - 1] = rank(data[edges[at - 1] : edges[at + 1]], NEVER)
            if at < len(pairs):
                pairs[at] = rank(data[edges[at] : edges[at + 2]], NEVER)
        return [self.ranks[data[a:b]] for a, b in zip(edges, edges[1:])]

    def merged_by_heap(self, data: bytes) -> list[int]:
        """The same for a long window: pairs wait in a heap, merged parts are linked to their neighbours."""
        parts: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
        after, before = list(range(1, len(data) + 1)), list(range(-1, len(data) - 1))
        waiting = [(self.ranks.get(a + b, NEVER), i, 2) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        waiting = [w for w in waiting if w[0] < NEVER]
        heapq.heapify(waiting)
        while waiting:
            _, at, size = heapq.heappop(waiting)
            right = after[at]
            if parts[at] is None or right >= len(parts) or len(parts[at]) + len(parts[right]) != size:
                continue  # a part of this pair was merged otherwise meanwhile
            parts[at], parts[right] = parts[at] + parts[right], None
            after[at] = after[right]
            if after[at] < len(parts):
                before[after[at]] = at
            for first in (before[at], at):
                if first >= 0 and after[first] < len(parts):
                    pair = parts[first] + parts[after[first]]
                    rank = self.ranks.get(pair)
                    if rank is not None:
                        heapq.heappush(waiting, (rank, first, len(pair)))
        return [self.ranks[part] for part in parts if part is not None]

    def fit(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay as they are."""
        known = self.fitting.get((left, right))
        if known is None:
            if len(self.fitting) > REMEMBERED:
                self.fitting.clear()
            known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.fitting[left, right] = known
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbouring strings together."""
        if not left or not right or self.fit(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            i, j = max(len(left) - width, 0), min(width, len(right))
            window = self.merged(self.decoded(left[i:]) + self.decoded(right[:j]))
            if (i == 0 or self.fit(left[i - 1], window[0])) and (j == len(right) or self.fit(window[-1], right[j])):
                return left[:i] + window + right[j:]
            width *= 2

    def encoded(self, data: bytes) -> list[int]:
        """The tokens of a string of any length, by halves. Lists are shared, so callers don't change them."""
        if len(data) <= LEAF:
            return self.merged(data)
        leaves = -(-len(data) // LEAF)
        middle = LEAF << (leaves - 1).bit_length() - 1  # whole leaves, so that runs of one byte are cut alike
        return self.joined(self.encoded(data[:middle]), self.encoded(data[middle:]))

    def decoded(self, ids: Sequence[int]) -> bytes:
        """The bytes of tokens, neighbours concatenated level by level."""
        parts = [self.bytes_of[i] for i in ids]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 16]) for i in range(0, len(parts), 16)]
        return parts[0] if parts else b""


class TextCodec:
    """Encoding of texts whose matches of a pattern are encoded each for itself; matches met before are remembered."""

    def __init__(self, ranks: Mapping[bytes, int], pattern: str):
        import regex

        self.codec = Codec(ranks)
        self.find = regex.compile(pattern).findall
        self.seam = regex.compile(r"(?<=\S) (?=\S)").search
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.held = 0
        self.long: list[str] = []  # forgotten after their segment

    def match_ids(self, match: str) -> list[int]:
        data = match.encode()
        whole = self.codec.ranks.get(data)
        return self.codec.encoded(data) if whole is None else [whole]

    def segments(self, text: str) -> Iterator[str]:
        """Pieces of a text between which no match reaches over."""
        first = 0
        while len(text) - first > SEGMENT:
            found = self.seam(text, first + SEGMENT)
            if not found:
                break
            yield text[first : found.start()]
            first = found.start()
        yield text[first:] if first else text

    def learn(self, matches: Iterable[str]) -> None:
        """Remember the token count, the tokens as text and the bytes they decode to."""
        for match in matches:
            ids = self.match_ids(match)
            self.known[match] = (len(ids), ",".join(map(str, ids)), self.codec.decoded(ids))
            self.held += len(match)
            if len(match) > KNOWN_MATCH:
                self.long.append(match)

    def pieces(self, text: str) -> Iterator[tuple[int, str, bytes]]:
        """Per segment the number of tokens, the tokens as text, and the bytes they decode to."""
        for segment in self.segments(text):
            matches = self.find(segment)
            if not matches:
                continue
            found = list(map(self.known.get, matches))
            if None in found:
                if self.held > KNOWN_BYTES:
                    self.known.clear()
                    self.held = 0
                self.learn({m for m in matches if m not in self.known})
                found = list(map(self.known.get, matches))
            counts, ids, data = zip(*found)
            yield sum(counts), ",".join(ids), b"".join(data)
            for match in self.long:
                self.held -= len(match)
                del self.known[match]
            self.long.clear()

    def row(self, text: str, columns: Sequence[str]) -> dict:
        out: dict = {"n_tokens": 0, "ids": [], "decoded": [], "ids_sha256": hashlib.sha256(), "decoded_sha256": hashlib.sha256()}
        for n, ids, data in self.pieces(text):
            if "ids_sha256" in columns:
                out["ids_sha256"].update(("," if out["n_tokens"] else "").encode() + ids.encode())
            out["n_tokens"] += n
            if "decoded_sha256" in columns:
                out["decoded_sha256"].update(data)
            if "ids" in columns:
                out["ids"] += map(int, ids.split(","))
            if "decoded" in columns:
                out["decoded"].append(data)
        out["decoded"] = b"".join(out["decoded"])
        for name in ("ids_sha256", "decoded_sha256"):
            out[name] = out[name].hexdigest()
        return {name: out[name] for name in columns}


# A Python worker keeps what it has learnt for its next tasks.
_codecs: dict[str, TextCodec] = {}


def text_codec(path: str) -> TextCodec:
    if path not in _codecs:
        import public_tokenizers

        _codecs.clear()
        _codecs[path] = TextCodec(read_ranks(path), public_tokenizers.PATTERN)
    return _codecs[path]


def encode(docs: DataFrame, path: str, columns: Sequence[str] = ("n_tokens", "ids"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the ``columns`` asked for) of every text: n_tokens, ids, the bytes the ids decode to, and the SHA-256 of the ids, as
    decimal text with commas, and of the decoded bytes."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    types = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = text_codec(path)
        for batch in batches:
            for first in range(0, len(batch), 256):
                texts = batch.column("text").slice(first, 256)
                found = [codec.row(text.as_py() or "", columns) for text in texts]
                made = {c: pa.array([row[c] for row in found], types[COLUMNS[c]]) for c in columns}
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(first, 256), **made})

    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns)
    return rows.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of every list of token ids; a NULL list is an empty one."""
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = text_codec(path).codec
        for batch in batches:
            decoded = [codec.decoded(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "decoded": pa.array(decoded, pa.binary())})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, decoded binary")
