import collections
import glob
import math
import re
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from staffmart.operators import documents as docs
from staffmart.operators import lexical, similar
from staffmart.operators import vectors as vec
from staffmart.session import DROP_SHUFFLES, fresh_dir, materialise


def plain_split(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """Recursive splitting written with lists of pieces, as a check on the span arithmetic."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        marked = re.split(f"({re.escape(separator)})", text)
        pieces = [marked[0]] + [a + b for a, b in zip(marked[1::2], marked[2::2])]
    else:
        pieces = list(text)
    out, small = [], []

    def flush():
        held = []
        for piece in small:
            if sum(map(len, held)) + len(piece) > size:
                if held:
                    out.append("".join(held))
                while held and (
                    sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size
                ):
                    held.pop(0)
            held.append(piece)
        if held:
            out.append("".join(held))
        small.clear()

    for piece in filter(None, pieces):
        if len(piece) < size or not separator:
            small.append(piece)
        else:
            flush()
            out.extend(plain_split(piece, size, overlap, finer))
    flush()
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(2, 20), st.integers(0, 10))
def test_chunks_equal_plain_splitting(text, size, overlap):
    overlap = min(overlap, size - 1)
    expected = [c.strip() for c in plain_split(text, size, overlap)] if text else []
    found = docs.split_text(text, size, overlap)
    assert found == [c for c in expected if c]
    assert all(len(c) <= size for c in found)


def test_chunk_modes(spark):
    texts = spark.createDataFrame(
        [(1, "x" * 2600), (2, ""), (3, None), (4, "short"), (5, "é\n" * 900)], "doc_id int, text string"
    )
    fixed = docs.chunk(texts, mode="fixed").orderBy("doc_id", "chunk_no").collect()
    assert [(r["chunk_no"], len(r["chunk"])) for r in fixed if r["doc_id"] == 1] == [
        (0, 1000), (1, 1000), (2, 1000),
    ]
    assert [r["chunk"] for r in fixed if r["doc_id"] == 4] == ["short"]
    assert [len(r["chunk"]) for r in fixed if r["doc_id"] == 5] == [1000, 1000]
    recursive = docs.chunk(texts).collect()
    assert {r["doc_id"] for r in recursive} == {1, 4, 5}
    assert max(len(r["chunk"]) for r in recursive) <= 1000


@pytest.mark.parametrize("n", [1, 199, 200, 999, 1000, 1001, 1800, 1801, 2600, 2601])
def test_number_of_fixed_chunks(spark, n):
    df = spark.range(1).select(F.size(docs.fixed_chunks(F.lit("y" * n))).alias("n"))
    assert df.first()["n"] == (1 if n <= 1000 else -(-(n - 200) // 800))


def test_pages_join_in_order_without_empty_ones(spark):
    pages = spark.createDataFrame([(1, 10, "b"), (1, 2, ""), (1, 3, None), (1, 1, "a")], "d int, p int, t string")
    assert [tuple(r) for r in docs.assemble_text(pages, "d", "p", "t").collect()] == [(1, "ab")]


def test_long_documents_come_in_parts(spark):
    pages = spark.range(25).selectExpr("1 d", "id p", "string(id % 10) t")
    parts = docs.assemble_text(pages, "d", "p", "t", rows_per_part=10).orderBy("part_no").collect()
    assert [r["part_no"] for r in parts] == [0, 1, 2]
    assert "".join(r["text"] for r in parts) == "".join(str(i % 10) for i in range(25))


def test_history_is_in_turn_order(spark):
    turns = spark.createDataFrame([(1, 10, "u", "c"), (1, 2, "a", "b"), (1, 1, "u", "a")], "c int, n int, r string, t string")
    row = docs.assemble_conversation(turns, "c", "n", ["r", "t"]).first()
    assert [tuple(x) for x in row["history"]] == [(1, "u", "a"), (2, "a", "b"), (10, "u", "c")]


def test_context_and_prompt(spark):
    hits = spark.createDataFrame([(1, 10, "z"), (1, 2, "a")], "query_id int, rank int, chunk string")
    row = docs.build_context(hits).select("context", docs.prompt(F.col("context"), F.lit("Q?")).alias("p")).first()
    assert row["context"] == "a\n\nz"
    assert row["p"] == "Answer based ONLY on context: a\n\nz\n\nQuestion: Q?"


def test_changed_content_is_new(spark):
    now = spark.createDataFrame([(1, "same"), (2, "changed"), (3, "new")], "doc_id int, text string")
    before = spark.createDataFrame([(1, "same"), (2, "old")], "doc_id int, text string").select(
        "doc_id", docs.content_hash(F.col("text")).alias("content_hash")
    )
    assert sorted(r["doc_id"] for r in docs.new_documents(now, before).collect()) == [2, 3]


def brute_force(queries, vectors, k):
    out = []
    for qid, q in queries:
        far = sorted((float(np.linalg.norm(np.subtract(q, v))), vid) for vid, v in vectors)
        out += [(qid, vid, round(d, 6), i + 1) for i, (d, vid) in enumerate(far[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def crowd(spark):
    """Vectors of which a third are copies of one point; queries near and far."""
    rng = np.random.default_rng(1)
    spread = rng.normal(size=(200, 4)).astype("float32").tolist()
    vectors = list(enumerate([[1.0, 1.0, 1.0, 1.0]] * 100 + spread))
    queries = [(i, q) for i, q in enumerate(rng.normal(size=(40, 4)).astype("float32").tolist() + [[1.0] * 4, [50.0] * 4])]
    return (
        queries,
        vectors,
        spark.createDataFrame(queries, "query_id long, embedding array<float>"),
        spark.createDataFrame(vectors, "vec_id long, embedding array<float>"),
    )


def hit_rows(df):
    return sorted((r["query_id"], r["vec_id"], round(r["distance"], 6), r["rank"]) for r in df.collect())


def test_nearest_neighbours(crowd):
    queries, vectors, query_df, vector_df = crowd
    assert hit_rows(vec.knn(query_df, vector_df, 3)) == brute_force(queries, vectors, 3)


@pytest.mark.parametrize("k", [1, 3, 400])
def test_blocks_of_queries_are_exact(crowd, k):
    queries, vectors, query_df, vector_df = crowd
    found = vec.knn(query_df, vector_df, k, block_bytes=8 * 4 * 15)
    assert hit_rows(found) == brute_force(queries, vectors, k)


def test_slices_of_vectors_are_exact(crowd, monkeypatch):
    queries, vectors, _, _ = crowd
    best = vec.Nearest(np.array([i for i, _ in queries]), np.array([q for _, q in queries], float), 5)
    rng = np.random.default_rng(3)
    for part in np.array_split(rng.permutation(len(vectors)), 40):
        best.add(np.array([vectors[i][0] for i in part]), np.array([vectors[i][1] for i in part], float))
    found = best.hits()
    found = sorted((int(r.query_id), int(r.vec_id), round(r.distance, 6)) for r in found.itertuples())
    assert found == sorted(r[:3] for r in brute_force(queries, vectors, 5))


def test_rows_without_a_vector_take_no_part(spark):
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (9, None)], "query_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in vec.knn(queries, vectors, 2).collect()] == [(1, 1)]
    assert vec.knn(queries.limit(0), vectors).collect() == []


def test_equal_distances_rank_by_id(spark):
    vectors = spark.createDataFrame([(5, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    query = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["vec_id"] for r in vec.knn(query, vectors, 2).orderBy("rank").collect()] == [2, 5]


def plain_search(texts, queries, k):
    """Cosines from dictionaries."""
    counts = {i: collections.Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in texts}
    holding = collections.Counter(term for c in counts.values() for term in c)
    rarity = {t: math.log((len(texts) + 1) / (n + 1)) for t, n in holding.items()}

    def unit(words):
        raw = {t: n * rarity[t] for t, n in words.items() if t in rarity}
        length = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / length if length else 0.0 for t, x in raw.items()}

    vectors, out = {i: unit(c) for i, c in counts.items()}, []
    for qid, text in queries:
        asked = unit(collections.Counter(re.findall(r"[^\W_]+", (text or "").lower())))
        scores = [(-round(sum(x * v[t] for t, x in asked.items() if t in v), 9), i) for i, v in vectors.items() if set(asked) & set(v)]
        out += [(qid, i, -s, rank + 1) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


TEXTS = [(0, "Annual leave policy"), (1, "travel expense policy; policy"), (2, "parental leave and pay"), (3, None), (4, ""), (5, "Annual leave policy")]
TEXTS += [(10 + i, f"policy number {i} of {i % 7}") for i in range(60)]


@pytest.mark.parametrize("large", [False, True])
def test_lexical_search(spark, monkeypatch, large):
    chunks = spark.createDataFrame(TEXTS, "doc_id long, chunk string")
    index = lexical.build_index(chunks, fresh_dir(spark, "index"), ["doc_id"])
    assert index.texts == len(TEXTS) and index.vocabulary.where("term = 'policy'").first()["texts"] == 63
    for row in index.postings.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect():
        assert row["s"] == pytest.approx(1.0)
    if large:
        monkeypatch.setattr(lexical, "fits_broadcast", lambda df: False)
    queries = [(1, "leave POLICY policy"), (2, "number 3"), (3, "unheard words"), (4, None), (5, "expense and pay")]
    found = lexical.search(index, spark.createDataFrame(queries, "query_id long, text string"), 3)
    assert sorted((r["query_id"], r["doc_id"], round(r["score"], 9), r["rank"]) for r in found.collect()) == plain_search(TEXTS, queries, 3)


def test_no_two_terms_share_a_place(spark):
    """A vocabulary far larger than any fixed number of slots would keep apart."""
    chunks = spark.createDataFrame([(i, f"word{i}") for i in range(5000)], "doc_id long, chunk string")
    index = lexical.build_index(chunks, fresh_dir(spark, "index"), ["doc_id"])
    found = lexical.search(index, spark.createDataFrame([(7, "word7"), (8, "word4999")], "query_id long, text string"), 3)
    assert sorted((r["query_id"], r["doc_id"], r["score"]) for r in found.collect()) == [(7, 7, 1.0), (8, 4999, 1.0)]


def test_length_of_a_vector_is_summed_once(spark):
    """Not once for every entry of it."""
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "doc_id long, term string, count long")
    vocabulary = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "term string, rarity double")
    found = lexical.weighted(counts, vocabulary, ["doc_id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.index("array(SQRT(aggregate(") > 0
    assert [(e["term"], round(e["weight"], 6)) for e in found.first()["vector"]] == [("a", 0.83205), ("b", 0.5547)]


def test_postings_are_dealt_before_queries_multiply_them(spark):
    """The sums per query and text happen where the text's postings lie."""
    index = lexical.build_index(spark.createDataFrame(TEXTS, "doc_id long, chunk string"), fresh_dir(spark, "index"), ["doc_id"])
    found = lexical.search(index, spark.createDataFrame([(1, "leave policy"), (2, "policy")], "query_id long, text string"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(query_id#" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning(query_id" in line and "doc_id" in line]


def plain_postings(rows):
    """(key, term): count and weight; texts of one key, NULL too, are one text, and every row counts as a text."""
    words = collections.defaultdict(collections.Counter)
    for key, text in rows:
        words[key].update(t for t in re.split(r"[\W_]+", (text or "").lower()) if t)
    held = collections.Counter(t for found in words.values() for t in found)
    rarity = {t: math.log((len(rows) + 1) / (n + 1)) for t, n in held.items()}
    length = {k: math.sqrt(sum((n * rarity[t]) ** 2 for t, n in found.items())) for k, found in words.items()}
    return {(k, t): (n, round(n * rarity[t] / length[k], 9) if length[k] else 0.0) for k, found in words.items() for t, n in found.items()}


@pytest.mark.parametrize("most", [0, 400, 1 << 20])
@pytest.mark.parametrize("copies", [1, 2])
def test_postings_whatever_the_size_of_the_vocabulary(spark, monkeypatch, most, copies):
    """No term, the common ones or all of them are sent to the texts."""
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", most)
    rows = [(i, " ".join(f"w{i % k}É {i % k}" for k in range(1, 9)) + " w0é, W0É w" + "x" * (i % 3)) for i in range(60)]
    rows = (rows + [(None, "w0é of none"), (77, None), (78, ""), (79, "?")]) * copies
    index = lexical.build_index(spark.createDataFrame(rows, "doc_id long, chunk string").repartition(3), fresh_dir(spark, "index"), ["doc_id"])
    found = {(r["doc_id"], r["term"]): (r["count"], round(r["weight"], 9)) for r in index.postings.collect()}
    assert index.texts == len(rows) and found == plain_postings(rows)
    assert index.postings.count() == len(found)


def test_a_segment_names_each_length_once(spark):
    """Each text's postings lie in one file, and a length of eight bytes is an entry of its dictionary."""
    texts = spark.range(2000).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 40), i -> concat('w', hash(id, i) % 500))) chunk")
    path = fresh_dir(spark, "index")
    lexical.build_index(texts, path, ["doc_id"])
    stored = spark.read.parquet(f"{path}/postings")
    lying = stored.select("doc_id", F.input_file_name().alias("file")).distinct()
    assert lying.groupBy("doc_id").count().where("count > 1").count() == 0
    for file in glob.glob(f"{path}/postings/*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i).encodings for i in range(group.num_columns)}
        assert "PLAIN" not in columns["length"] and "PLAIN" not in columns["doc_id"]


def test_shuffles_go_with_the_write_that_made_them(spark):
    """Else all intermediate tables' shuffles lie on the disks until the driver collects garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = {f for f in map(str, disk.getAllFiles().mkString("\n").splitlines()) if "shuffle_" in f}
    materialise(spark.range(1000).repartition(3, "id"), "dealt")
    left = before
    for _ in range(50):
        left = {f for f in map(str, disk.getAllFiles().mkString("\n").splitlines()) if "shuffle_" in f} - before
        if not left:
            break
        time.sleep(0.2)
    assert not [f for f in left if f.endswith(".data")]
    assert spark.conf.get(DROP_SHUFFLES) == "false"


def test_writes_of_several_threads_leave_the_setting_as_it_was(spark):
    with ThreadPoolExecutor(6) as threads:
        list(threads.map(lambda n: materialise(spark.range(n).repartition(2, "id"), "dealt"), range(1, 25)))
    assert spark.conf.get(DROP_SHUFFLES) == "false"


@pytest.mark.parametrize("crowd", [0, 64])
def test_similar_vectors_are_found(spark, crowd):
    """Against the exact search: pairs of any distance up to the radius, hundreds of near copies, and exact copies."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 16))
    step = rng.normal(size=(60, 5, 16))
    near = centres[:, None] + step / np.linalg.norm(step, axis=2, keepdims=True) * rng.uniform(0, 0.6, size=(60, 5, 1))
    crowded = rng.normal(size=16) + 0.01 * rng.normal(size=(300, 16))
    points = np.concatenate((centres, near.reshape(-1, 16), crowded, np.repeat(centres[:1], 200, axis=0))).astype("float32")
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    vectors = spark.createDataFrame(rows + [(9000, None)], "vec_id long, embedding array<float>").repartition(4)
    queries = vectors.where("vec_id % 2 = 0 OR vec_id < 60").withColumnRenamed("vec_id", "query_id")
    exact = {(r["query_id"], r["vec_id"], r["rank"]) for r in vec.knn(queries, vectors, 4).collect() if r["distance"] <= 0.5}
    found = {(r["query_id"], r["vec_id"], r["rank"]) for r in similar.similar(queries, vectors, 0.5, 4, crowd=crowd).collect()}
    pairs, kept = {e[:2] for e in exact}, {f[:2] for f in found}
    assert len(pairs & kept) >= 0.9 * len(pairs) and len(pairs) > 1000
    copies = {e for e in exact if e[0] >= 660}  # one distance for all: ids decide
    assert copies <= found


def test_recall_formula():
    assert similar.keys_needed(0.95) < similar.keys_needed(0.99) and similar.keys_needed(0.5, projections=1) == 1


def test_no_vectors_are_similar(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert similar.similar(none.withColumnRenamed("vec_id", "query_id"), none, 1.0).collect() == []
