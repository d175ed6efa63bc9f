"""Shared helpers: words of whole texts in Arrow batches, hashes, and the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

# Texts handled at once by a task; a longer text is handled alone.
CHUNK_BYTES = 3 << 20
# Columns of the documents table; every pipeline stage but the last returns them.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL ids count as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % folds


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) pieces of a text array, each of at most ``max_bytes`` or one text; NULL becomes empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        base = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield first, texts.slice(first, stop - first)
        first = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs of other than space and \\t to \\r) and each text's bounds among them."""
    lists = pc.ascii_split_whitespace(texts)
    flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
    return flat.filter(full), before[bounds - bounds[0]]


def encode_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, each word's place among them, and each text's bounds among the words."""
    flat, bounds = split_words(texts)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each pair of neighbouring bounds."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def mix(keys: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys (multiply and shift, twice)."""
    keys = keys.astype(np.uint64)
    for factor in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        keys = (keys ^ (keys >> np.uint64(31))) * factor
    return keys ^ (keys >> np.uint64(32))


def word_hashes(words: pa.Array) -> np.ndarray:
    """One 64-bit hash per word, the same in every task."""
    import pandas as pd

    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64)


def text_column(function: Callable[[pa.Array], pa.Array], returns: DataType | str, text: Column, max_bytes: int = CHUNK_BYTES) -> Column:
    """A column made from whole texts by ``function``, called on pieces of each Arrow batch: of ``max_bytes`` at most, or one text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [function(piece) for _, piece in chunks(batch, max_bytes)]
            yield pa.concat_arrays(parts) if parts else pa.nulls(0, arrow_type)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow_type = to_arrow_type(_parse_datatype_string(returns) if isinstance(returns, str) else returns)
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)(text)
