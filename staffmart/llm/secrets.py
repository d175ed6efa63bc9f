"""Secrets in texts, also below layers of encoding.

Base patterns run over the text itself. A worklist then unwraps what is encoded: URL escapes, Unicode and hex escapes, runs of base64, and compressed data inside base64 or hex. Every decoded layer is scanned with the same patterns and goes
back on the list, until no new layer appears; a layer seen before at the same place is dropped, so cycles end. Spans in
a layer are mapped to the characters of the text that produced them: exactly through escapes, to the whole run through base64 and compression.

Compressed data is read to its end, with all its members, and held by the task. Bytes that are no UTF-8 stand as replacement
characters and cost no layer. Base64 wrapped in lines is decoded as one run. Positions are code points, ends exclusive.

Defined results: a NULL text is empty and has none; rows are scanned each for itself.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.llm.text import text_column

# The base patterns and their least lengths, in the order of the kinds.
BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
KINDS = [kind for kind, *_ in BASE] + [f"decoded_{kind}" for kind, *_ in BASE]
HEX = re.compile(r"[0-9a-f]{32,}")
# No text without one of these has a base match or an encoded run.
SIGNS = r"password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{32}|%[0-9a-f]{2}|\\[ux][0-9a-f]{2}|&#|[A-Za-z0-9+/_-]{15}|[A-Za-z0-9+/_-]\r?\n[ \t]*[A-Za-z0-9+/_-]"
SIGN = re.compile(SIGNS, re.I | re.A)
ESCAPE = re.compile(r"((?:%[0-9A-Fa-f]{2})+)|((?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]+;|&#x[0-9A-Fa-f]+;)+)")
ONE_CODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#x([0-9A-Fa-f]+);")
# The least data with a secret: 11 bytes, 32 equal hex digits under zlib.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{15,}={0,2}")
HEX_BYTES = re.compile(r"(?:[0-9A-Fa-f]{2}){11,}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*[A-Za-z0-9+/_-]++)+={0,2}")
PIECE = 1 << 16  # compressed bytes unpacked at a time
OUT = "struct<n_assign: bigint, n_access: bigint, n_hex: bigint, base_sha256: string, spans: string>"

Span = tuple[int, int]
Layer = tuple[str, list[Span]]  # text, and for each of its characters what it stands for


def base_matches(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns."""
    found = []
    for kind, pattern, group, least in BASE:
        pattern = HEX if kind == "hex" else pattern  # the same matches: a run is taken whole
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), kind, m.end()))
    return found


def joined(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in sorted(found, key=lambda f: (f[0], KINDS.index(f[1]), f[2])))


class Whole(list):
    """Places of a layer whose characters all stand for one span."""

    def __getitem__(self, at):
        return [super().__getitem__(0)] if isinstance(at, slice) else super().__getitem__(0)


def unpacked(data: bytes) -> bytes:
    """``data``, or what it compresses: all members, and what follows them as it is."""
    makers = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"\x78", lambda: zlib.decompressobj(15)), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ", lzma.LZMADecompressor))
    for magic, maker in makers:
        if data.startswith(magic):
            out, rest = [], data
            while rest.startswith(magic):
                member, at = maker(), 0
                try:
                    while at < len(rest) and not member.eof:
                        out.append(member.decompress(rest[at : at + PIECE]))
                        at += PIECE
                except (zlib.error, OSError, lzma.LZMAError, EOFError):
                    return b"".join(out) + rest if any(out) else data
                rest = member.unused_data + rest[at:] if member.eof else b""
            return b"".join(out) + rest
    return data


def as_text(data: bytes) -> str:
    return unpacked(data).decode("utf-8", "replace")


def unescaped(text: str) -> Layer:
    """A text with all its escapes resolved."""
    out: list[str] = []
    places: list[Span] = []
    here = 0
    for m in ESCAPE.finditer(text):
        out.extend(text[here : m.start()])
        places.extend((i, i + 1) for i in range(here, m.start()))
        if m[1]:
            data, step = bytes.fromhex(m[1].replace("%", "")), 3
            try:
                decoded = data.decode("utf-8")
            except UnicodeDecodeError:
                decoded = data.decode("latin-1")
            offset = m.start()
            for c in decoded:
                width = step * (len(c.encode("utf-8")) if len(decoded) != len(data) else 1)
                out.append(c)
                places.append((offset, offset + width))
                offset += width
        else:
            for one in ONE_CODE.finditer(text, m.start(), m.end()):
                code = int(one[1] or one[2] or one[4], 16) if one[3] is None else int(one[3])
                out.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�")
                places.append((one.start(), one.end()))
        here = m.end()
    out.extend(text[here:])
    places.extend((i, i + 1) for i in range(here, len(text)))
    return "".join(out), places


def inner_layers(text: str) -> list[Layer]:
    """What the encoded runs of a text hold, with places in that text."""
    found = []
    if ESCAPE.search(text):
        found.append(unescaped(text))
    for run, span in [(m[0], m.span()) for m in BASE64.finditer(text)] + wrapped_runs(text):
        run = run.rstrip("=").replace("-", "+").replace("_", "/")
        for cut in (run, run[: len(run) - len(run) % 4]):
            try:
                found.append((as_text(base64.b64decode(cut + "=" * (-len(cut) % 4), validate=True)), Whole([span])))
                break
            except (binascii.Error, ValueError):
                continue
    for m in HEX_BYTES.finditer(text):
        found.append((as_text(bytes.fromhex(m[0])), Whole([m.span()])))
    return [(inner, places) for inner, places in found if SIGN.search(inner)]


def wrapped_runs(text: str) -> list[tuple[str, Span]]:
    """Runs of base64 over several lines, joined, with their spans.

    Lines of one width and a shorter last one make a run; a shorter first line may start behind other text. Words beside the run
    can look like lines of it, so it is read with and without the first line, and the whole block once more.
    """
    runs = set()
    for block in WRAPPED.finditer(text):
        lines = [m.span() for m in LINE.finditer(text, *block.span())]
        width = [end - start for start, end in lines]
        first = 0
        wanted = {(0, len(lines))}
        while first < len(lines):
            last = first + 1
            while last < len(lines) and width[last] == width[first]:
                last += 1
            stop = last + (last < len(lines) and width[last] < width[first])
            wanted |= {(first, stop), (first - (first > 0 and width[first - 1] < width[first]), stop)}
            first = last
        runs |= {tuple(lines[a:b]) for a, b in wanted if b - a > 1}
    joined_runs = [("".join(text[a:b] for a, b in lines), (lines[0][0], lines[-1][1])) for lines in sorted(runs)]
    return [(run, span) for run, span in joined_runs if BASE64.match(run)]


def decoded_matches(text: str) -> set[tuple[int, str, int]]:
    """Base matches of all layers below the text, as places in the text."""
    found: set[tuple[int, str, int]] = set()
    seen: set[tuple[bytes, int, int]] = set()
    work: list[Layer] = [(inner, places) for inner, places in inner_layers(text)]
    while work:
        inner, places = work.pop()
        whole = isinstance(places, Whole)
        start, end = min(p[0] for p in places), max(p[1] for p in places)
        mark = (hashlib.sha256(inner.encode("utf-8", "surrogatepass")).digest(), start, end)
        if mark in seen or text[start:end] == inner:
            continue
        seen.add(mark)
        for at, kind, to in base_matches(inner):
            found.add((min(p[0] for p in places[at:to]), f"decoded_{kind}", max(p[1] for p in places[at:to])))
        for deeper, own in inner_layers(inner):
            if deeper != inner:
                kind_of = Whole if whole or isinstance(own, Whole) else list
                work.append((deeper, kind_of((places[a][0], places[b - 1][1]) for a, b in (own[:1] if whole else own))))
    return found


def scan(text: str) -> tuple[int, int, int, str, str]:
    base = base_matches(text)
    count = [sum(f[1] == kind for f in base) for kind, *_ in BASE]
    plain = {(start, end) for start, _, end in base}
    more = {f for f in decoded_matches(text) if (f[0], f[2]) not in plain}
    return (*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *more]))


def scan_texts(texts: pa.Array) -> pa.Array:
    nothing = scan("")
    rows = [nothing] * len(texts)
    suspect = pc.match_substring_regex(texts, SIGNS, ignore_case=True).to_numpy(zero_copy_only=False).nonzero()[0]
    for i in suspect:
        rows[i] = scan(texts[int(i)].as_py())
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the column secrets: counts, a digest of the base spans, and all spans."""
    return docs.withColumn("secrets", text_column(scan_texts, OUT, F.col(text_col)))
