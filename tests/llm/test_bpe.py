"""Tree encoding against the tiktoken library, exact round trips, odd rows."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from staffmart.llm import bpe

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(bpe.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    import public_tokenizers

    return bpe.TextCodec(bpe.read_ranks(bpe.vocabulary_path()), public_tokenizers.PATTERN)


def ids(codec, text):
    row = codec.row(text, ("n_tokens", "ids", "decoded"))
    assert row["decoded"] == text.encode() and row["n_tokens"] == len(row["ids"])
    return row["ids"]


def test_query_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = entry_points.queries()["op12_bpe"](spark, SF_DIR).collect()
    assert len(found) == len(texts)
    for r in found:
        wanted = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(wanted)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, wanted)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aAb' s\n\t1é日", max_size=200))
def test_any_text(text):
    import public_tokenizers
    import tiktoken

    if not hasattr(test_any_text, "pair"):
        ranks = bpe.read_ranks(bpe.vocabulary_path())
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        test_any_text.pair = library, bpe.TextCodec(ranks, public_tokenizers.PATTERN)
    library, codec = test_any_text.pair
    assert ids(codec, text) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 100_003, "ab" * 30_001, " " * 50_001, "日本語文字列" * 5_000, "x" + "\n" * 999 + "y"])
def test_long_unbroken_matches(library, ours, text):
    assert ids(ours, text) == library.encode_ordinary(text)


def test_segments_do_not_change_tokens(library, ours, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 20)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "'s", "7", "é", ".", " it's ", "\t x"]) for _ in range(60))
        assert "".join(ours.segments(text)) == text
        assert ids(ours, text) == library.encode_ordinary(text)


def test_windows_grow_until_tokens_fit():
    """Joins against whole merges on a table where a merge on one side moves all tokens on the other."""
    ranks = {bytes([b]): i for i, b in enumerate(b"abc")} | {b"ab": 3, b"ba": 4, b"aba": 5, b"bab": 6, b"abab": 7, b"cab": 8, b"aa": 9}
    codec = bpe.Codec(ranks)
    rng = random.Random(5)
    for _ in range(2000):
        data = bytes(rng.choice(b"abc" if rng.random() < 0.5 else b"ab") for _ in range(rng.randrange(40)))
        cut = rng.randrange(len(data) + 1)
        assert codec.joined(codec.merged_by_scan(data[:cut]), codec.merged_by_scan(data[cut:])) == codec.merged_by_scan(data)
        assert codec.encoded(data) == codec.merged_by_scan(data) == codec.merged_by_heap(data)


def test_odd_rows_and_round_trip(spark):
    rows = [(1, "one two"), (1, "one two"), (None, "x"), (2, None), (3, ""), (4, "word " * 100_000), (5, " \x00é\U0001f600")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("id", "ids", "n_tokens", "decoded")})
    encoded = bpe.encode(docs, bpe.vocabulary_path())
    back = bpe.decode(encoded, bpe.vocabulary_path())
    assert sorted((str(r.id), bytes(r.decoded).decode()) for r in back.collect()) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.encode(docs.limit(0), bpe.vocabulary_path(), ("ids_sha256",)).collect() == []
