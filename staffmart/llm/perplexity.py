"""Quality rules: base counts of every text and its perplexity under a Kneser-Ney model of the corpus.

Spark counts the character n-grams of all running texts; the modified Kneser-Ney model travels as sorted hash arrays. A text's
log-perplexity is its mean negative log-likelihood per character, blanks between words included. Per language, texts whose log-perplexity lies outside a band around
the middle half of its texts are rejected: below it are repetitive ones, above it garbled ones. The band reaches three times
the quartile distance beyond the quartiles, so ordinary texts stay inside whatever their language.

Defined results: a NULL or empty text has no words and fails the base rules; rows without a language form a language of
their own; repeated rows are judged each for itself; a language without any text that passes the base rules rejects none by perplexity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.llm import kneser_ney
from staffmart.llm.text import mix, split_words, sums, text_column
from staffmart.operators.joins import lookup
from staffmart.session import materialise

ORDER = 5
REACH = 3.0  # quartile distances beyond the quartiles
SYMBOLS = b"#*$%&|<>"  # fixed values
FEWEST_WORDS, MOST_REPEATED = 50, 50  # words, percent
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(texts: pa.Array, ids: np.ndarray, bounds: np.ndarray, words: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of every text, given its words as places among distinct ``words``."""
    n, count = len(texts), np.diff(bounds)
    doc = np.repeat(np.arange(n), count)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)

    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    symbols = sums(is_symbol[raw[offsets[0] : offsets[-1]]].astype(np.int64), offsets - offsets[0])

    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    line_doc = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    codes = flat.filter(pa.array(full)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_doc = line_doc[full]
    same = line_doc * (int(codes.max()) + 1 if len(codes) else 1) + codes
    _, first = np.unique(same, return_index=True)
    repeated = np.ones(len(same), np.int64)
    repeated[first] = 0

    covered = np.zeros(len(ids), bool)
    if len(ids) > 2:
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        place = mix(ids.astype(np.uint64))
        key = mix(place[:-2] + mix(place[1:-1] + mix(place[2:] + doc[2:].astype(np.uint64))))[whole]
        order = np.argsort(key)
        equal = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        for k in range(3):
            covered[whole[twice] + k] = True
    return {
        "n_words": count,
        "word_chars": sums(chars[ids], bounds),
        "n_symbols": symbols,
        "n_dup_lines": np.bincount(line_doc, weights=repeated, minlength=n).astype(np.int64),
        "n_repeat_words": sums(covered.astype(np.int64), bounds),
    }


def measure(texts: pa.Array, model: kneser_ney.Model) -> pa.Array:
    texts = pa.concat_arrays([texts])
    flat, bounds = split_words(texts)
    coded = flat.dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    columns = base_counts(texts, ids, bounds, words)
    logs, lengths = kneser_ney.word_values(model, flat, bounds)
    total = sums(lengths, bounds)
    columns["log_perplexity"] = np.where(total > 0, -sums(logs[0], bounds) / np.maximum(total, 1), np.nan)
    return pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, the base counts, log_perplexity, base_failed, kept) of every text."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    model = kneser_ney.fit(docs.select("text", F.lit(0).alias("cls")), ORDER)
    out = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ", log_perplexity: double>"
    measured = docs.select("id", "lang", text_column(lambda texts: measure(texts, model), out, F.col("text")).alias("m"))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = materialise(measured.select("id", "lang", "m.*").withColumn("base_failed", failed), "measured")
    kneser_ney.release(model)
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000)
    bands = measured.where(~F.col("base_failed")).groupBy("lang").agg(quartiles.alias("q"))
    reach = REACH * (F.col("q")[1] - F.col("q")[0])
    bands = materialise(bands.select("lang", (F.col("q")[0] - reach).alias("lower"), (F.col("q")[1] + reach).alias("upper")), "bands")
    joined = lookup(measured, bands.withColumnRenamed("lang", "band_lang"), [("lang", "band_lang")])
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
