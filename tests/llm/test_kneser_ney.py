"""The model against one made with dictionaries, cut into blocks, and on texts where only the order of words tells."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from staffmart.llm import kneser_ney, perplexity, toxicity
from staffmart.llm.text import split_words, text_column

ORDER = 4


def characters(text):
    words = (text or "").lower().split()
    return ["\n"] + list(" ".join(words)) + ["\n"] if words else []


def grams(points, order):
    return ["".join(points[max(0, i - order + 1) : i + 1]) for i in range(1, len(points))]


def by_dictionaries(rows, order, shared):
    """Per class a function from n-gram to its probability; ``shared`` is 0 or 1."""
    raw = [collections.Counter(), collections.Counter()]
    for text, cls in rows:
        raw[cls].update(grams(characters(text), order))
    levels = {order: [{g: n for g, n in raw[c].items() if len(g) == order} for c in (0, 1)]}
    for length in range(order - 1, 0, -1):
        level = []
        for c in (0, 1):
            left = {(g[0], g[1:]) for g in levels[length + 1][c]}
            counts = collections.Counter(g for _, g in left if length == 1 or g[0] not in " \n")
            if length > 1:
                for g, n in raw[c].items():
                    for i in range(len(g) - 1):
                        if len(g) - i == length and g[i] in " \n" and (i or len(g) < order):
                            counts[g[i:]] += n
            level.append(counts)
        if length == shared:
            level = [level[0] + level[1]] * 2
        levels[length] = level
    alphabet = 1 + len(set(levels[1][0]) | set(levels[1][1]))
    tables = []
    for c in (0, 1):
        contexts, cuts = {}, {}
        for length in levels:
            seen = collections.Counter(levels[length][c].values())
            cuts[length] = kneser_ney.discounts([seen[k] for k in (1, 2, 3, 4)])
            for g, n in levels[length][c].items():
                total, cut = contexts.get((length, g[:-1]), (0, 0.0))
                contexts[length, g[:-1]] = total + n, cut + cuts[length][min(n, 3) - 1]
        tables.append((levels, contexts, cuts, alphabet, c))

    def probability(table, gram):
        levels, contexts, cuts, alphabet, c = table
        if not gram:
            return 1 / alphabet
        total, cut = contexts.get((len(gram), gram[:-1]), (0, 0.0))
        below = probability(table, gram[1:])
        if not total:
            return below
        n = levels[len(gram)][c].get(gram, 0)
        return ((n - cuts[len(gram)][min(n, 3) - 1]) / total if n else 0.0) + cut / total * below

    return [lambda g, t=t: probability(t, g) for t in tables]


def expected(tables, text, order, cls):
    return sum(math.log(tables[cls](g)) for g in grams(characters(text), order))


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").orderBy("doc_id")
    return [(r["text"], r["doc_id"] % 3 // 2) for r in docs.limit(60).collect()] + [(None, 0), ("", 1)]


@pytest.mark.parametrize("weights, block", [((1.0, 0.0), 1 << 22), ((0.0, 1.0), 1000), ((-1.0, 1.0), 3000)])
def test_likelihoods_equal_those_by_dictionaries(spark, monkeypatch, labelled, weights, block):
    monkeypatch.setattr(kneser_ney, "BLOCK", block)
    tables = by_dictionaries(labelled, ORDER, 1)
    model = kneser_ney.fit(spark.createDataFrame(labelled, "text string, cls int"), ORDER, 1, weights)
    assert (len(model.blocks) > 1) == (block < 1 << 22)
    texts = [text or "" for text, _ in labelled] + ["never met: ÿ ☃ words", "a"]
    words, bounds = split_words(pa.array(texts))
    values, lengths = kneser_ney.word_values(model, words, bounds)
    total = np.concatenate(([0.0], np.cumsum(values[0])))
    symbols = np.concatenate(([0.0], np.cumsum(lengths)))
    for i, text in enumerate(texts):
        true = sum(w * expected(tables, text, ORDER, c) for c, w in enumerate(weights))
        assert total[bounds[i + 1]] - total[bounds[i]] == pytest.approx(true, abs=1e-3, rel=1e-4)
        assert symbols[bounds[i + 1]] - symbols[bounds[i]] == max(0, len(characters(text)) - 1)


def test_probabilities_of_next_characters_sum_to_one(labelled):
    for table in by_dictionaries(labelled, ORDER, 1):
        alphabet = {c for text, _ in labelled for c in characters(text)[1:]}
        for context in ("", "e", " th", "the", "\nz"):
            assert sum(table(context + c) for c in alphabet) <= 1 + 1e-9


def test_shuffled_words_have_a_higher_perplexity(spark):
    random.seed(5)
    subjects, verbs, objects = ("anna bert carla dieter emil".split(), "sees hears finds takes".split(), "apples pears bridges towns".split())
    sentences = lambda n: [w for _ in range(n) for w in (random.choice(subjects), random.choice(verbs), random.choice(objects))]
    rows = [(i, " ".join(sentences(60)), "en") for i in range(200)]
    for i in range(200, 210):
        words = sentences(60)
        rows += [(i, " ".join(words), "en"), (i + 100, " ".join(random.sample(words, len(words))), "en")]
    judged = {r["id"]: r["log_perplexity"] for r in perplexity.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()}
    assert all(judged[i + 100] > judged[i] for i in range(200, 210))


def test_two_words_are_toxic_only_side_by_side(spark):
    random.seed(6)
    syllables = "ba de ki lo mu na po ra si tu".split()
    word = lambda: "".join(random.choice(syllables) for _ in range(3))
    rows = []
    for i in range(1200):
        words = [word() for _ in range(30)]
        at = random.randrange(4, 20)
        words[at:at] = ["green", "onion"] if i % 2 else ["green", word(), word(), "onion"]
        rows.append((i, " ".join(words), i % 2))
    table = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    scored = toxicity.score(table, toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic")))
    held = scored.where(toxicity.fold(F.col("doc_id"), toxicity.FOLDS) == 0)
    right = held.agg(F.avg(((F.col("toxic_score") >= 0.5).cast("int") == F.col("toxic")).cast("int"))).first()[0]
    assert right >= 0.9


def test_without_words_every_character_is_equally_likely(spark):
    model = kneser_ney.fit(spark.createDataFrame([(None, 0), ("  \n", 1)], "text string, cls int"), 3, 1, (-1.0, 1.0))
    values, _ = kneser_ney.word_values(model, *split_words(pa.array(["some words", ""])))
    assert not values.any()


def test_texts_are_scored_in_pieces_that_take_little_memory(spark, monkeypatch):
    import tracemalloc

    from staffmart.llm import text

    rng = random.Random(3)
    texts = pa.array(["".join(rng.choice("abcdefghij   ") for _ in range(2000)) for _ in range(1500)])
    block = np.sort(np.arange(1000, dtype=np.uint64)), np.ones(1000, np.float32)
    model = kneser_ney.Model(5, -1.0, [type("Block", (), {"value": block})()])
    given = []
    monkeypatch.setattr(toxicity, "text_column", lambda function, returns, column, max_bytes=text.CHUNK_BYTES: given.append((function, max_bytes)))
    toxicity.evidence_column(model, F.lit(""))
    (function, max_bytes), = given
    tracemalloc.start()
    found = [row for _, piece in text.chunks(texts, max_bytes) for row in function(piece).to_pylist()]
    assert tracemalloc.get_traced_memory()[1] < 220 << 20
    tracemalloc.stop()
    assert np.allclose(found, toxicity.evidence(model, texts).to_pylist())


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_pieces_of_a_text_column_keep_to_their_bound(spark, most):
    rows = spark.createDataFrame([(i, "x" * (i % 9)) for i in range(200)] + [(200, None)], "id long, text string").coalesce(1)
    sized = text_column(lambda t: pa.array([sum(len(x) for x in t.to_pylist())] * len(t)), "long", F.col("text"), most)
    for row in rows.select("text", sized.alias("size")).collect():
        assert row["size"] <= max(most, len(row["text"] or ""))
