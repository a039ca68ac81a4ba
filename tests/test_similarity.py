from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagweave.functions import vectors as v
from tagweave.operators import search as s
from tagweave.operators.encoding import encode, fit_idf, merge_idf
from tagweave.operators.similarity import knn, knn_join, knn_lsh, pivots, top_k_per_cell


def table(spark, key, vectors, ids=None):
    ids = ids if ids is not None else range(len(vectors))
    kind = "string" if isinstance(list(ids)[0], str) else "bigint"
    rows = [(i, [float(x) for x in vec]) for i, vec in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"{key} {kind}, vector array<float>").repartition(3)


def brute(queries, corpus, k, metric="l2", ids=None):
    ids = list(ids if ids is not None else range(len(corpus)))
    q, c = np.float32(queries).astype(float), np.float32(corpus).astype(float)
    found = set()
    for i, query in enumerate(q):
        gaps = -(c @ query) if metric == "dot" else ((c - query) ** 2).sum(axis=1)
        order = sorted(range(len(c)), key=lambda j: (round(gaps[j], 9), ids[j]))[:k]
        found |= {(i, ids[j], place) for place, j in enumerate(order, 1)}
    return found


def hits(df):
    return {(r.query_id, r.id, r["rank"]) for r in df.collect()}


def random_vectors(seed, n, width=6, copies=0):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, width))
    made[:copies] = made[0]
    return made


@pytest.mark.parametrize("k", [1, 4, 500])
def test_scan_is_exact(spark, k):
    queries, corpus = random_vectors(1, 9), random_vectors(2, 120, copies=40)
    found = knn(table(spark, "query_id", queries), table(spark, "id", corpus), k)
    assert hits(found) == brute(queries, corpus, k)


def test_string_ids(spark):
    queries, corpus = random_vectors(1, 3), random_vectors(2, 30, copies=12)
    ids = [f"item-{i:02d}" for i in range(30)]
    both = table(spark, "query_id", queries), table(spark, "id", corpus, ids)
    assert hits(knn(*both, 5)) == brute(queries, corpus, 5, ids=ids)
    assert hits(knn_join(*both, 5, 2)) == brute(queries, corpus, 5, ids=ids)


@pytest.mark.parametrize("tile_rows", [7, 1000])
def test_blocks_are_exact_with_a_third_of_copies(spark, tile_rows):
    queries, corpus = random_vectors(3, 90, copies=30), random_vectors(3, 150, copies=50)
    both = table(spark, "query_id", queries), table(spark, "id", corpus)
    assert hits(knn_join(*both, 4, tile_rows)) == brute(queries, corpus, 4)
    assert hits(knn_join(*both, 4, tile_rows, 6, 0)) == brute(queries, corpus, 4)


def test_cells_that_cannot_hold_a_neighbour_are_skipped(spark, monkeypatch):
    from tagweave.operators import similarity

    rng = np.random.default_rng(3)
    corpus = np.repeat(rng.normal(size=(12, 5)) * 50, 30, axis=0) + rng.normal(size=(360, 5))
    routed = []
    plain = similarity._routed
    monkeypatch.setattr(similarity, "_routed", lambda *a: routed.append(plain(*a)) or routed[-1])
    both = table(spark, "query_id", corpus[::9]), table(spark, "id", corpus)
    assert hits(knn_join(*both, 4, 100, 24, 0)) == brute(corpus[::9], corpus, 4)
    assert sum(r.count() for r in routed) < 0.5 * 40 * 24


def test_repeated_query_ids_are_answered_row_by_row(spark):
    asked = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (1, [5.0, 0.0]), (2, [5.0, 0.0])]
    queries = spark.createDataFrame(asked, "query_id bigint, vector array<float>").repartition(3)
    corpus = table(spark, "id", [[0, 0], [4, 0], [5, 1]])
    best = lambda **o: sorted((r.query_id, r.id, r.distance) for r in knn(queries, corpus, 1, **o).collect())
    assert best() == best(max_queries=1) == [(1, 0, 0.0), (1, 0, 0.0), (1, 1, 1.0), (2, 1, 1.0)]


def test_a_noisy_encoder_runs_once_for_a_text(spark):
    """Last bits that depend on the batch neither lose a query nor change the answers' number."""
    calls = spark.sparkContext.accumulator(0)

    def make():
        noise = np.random.default_rng()

        def encode_texts(texts):
            calls.add(len(texts))
            exact = np.array([[float(t), 1.0, -1.0] for t in texts])
            return exact + noise.normal(size=exact.shape) * 1e-6

        return encode_texts

    texts = spark.createDataFrame([(i, str(i % 20)) for i in range(60)], "query_id bigint, s string")
    corpus = table(spark, "id", [[i, 1, -1] for i in range(20)])
    for n, most in enumerate((1000, 16), 1):
        queries = encode(texts.repartition(3), "s", make).select("query_id", "vector")
        found = knn(queries, corpus, 2, most).collect()
        assert calls.value == 60 * n
        assert len(found) == 120
        assert {(r.query_id, r.id) for r in found if r["rank"] == 1} == {(i, i % 20) for i in range(60)}


def test_missing_vectors_and_empty_sides(spark):
    corpus = table(spark, "id", random_vectors(2, 8))
    gaps = spark.createDataFrame([(1, None)], "query_id bigint, vector array<float>")
    assert knn(gaps, corpus, 3).count() == 0
    nobody = table(spark, "query_id", random_vectors(1, 2))
    assert knn(nobody, corpus.limit(0), 3).count() == 0
    assert knn_join(nobody, corpus.limit(0), 3).count() == 0


@settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    grid=st.lists(st.tuples(*[st.integers(-2, 2)] * 3), min_size=4, max_size=40),
    k=st.integers(1, 5),
    block=st.integers(1, 9),
)
def test_ties_go_to_the_smallest_id(spark, grid, k, block):
    vectors = np.array(grid, dtype=float)
    both = table(spark, "query_id", vectors), table(spark, "id", vectors)
    assert hits(knn_join(*both, k, block)) == brute(vectors, vectors, k)


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_top_k_per_cell(spark, metric):
    queries, corpus = random_vectors(1, 20), random_vectors(2, 90)
    hot = lambda n: ["hot" if i % 3 else f"cell {i % 4}" for i in range(n)]
    cell_of = lambda n: F.element_at(F.array(*[F.lit(c) for c in hot(n)]), F.col("i") + 1)
    asked = table(spark, "query_id", queries).withColumn("i", F.col("query_id").cast("int"))
    members = table(spark, "id", corpus).withColumn("i", F.col("id").cast("int"))
    found = top_k_per_cell(
        members.withColumn("cell", cell_of(90)), asked.withColumn("cell", cell_of(20)), 3, metric, 8
    )
    expected = set()
    for cell in {*hot(20)}:
        mine = [i for i, c in enumerate(hot(90)) if c == cell]
        asking = [i for i, c in enumerate(hot(20)) if c == cell]
        for q, i, place in brute(queries[asking], corpus[mine], 3, metric, mine):
            expected.add((cell, asking[q], i, place))
    assert {(r.cell, r.query_id, r.id, r["rank"]) for r in found.collect()} == expected


def compared(spark, queries, corpus, cells, probes):
    """The share of all pairs that the cells let through, and the recall of the five nearest."""
    ids = sorted(r.id for r in pivots(table(spark, "id", corpus), cells).collect())
    centres = np.float32(corpus)[ids].astype(float)
    gaps = lambda v: np.round(((np.float32(v).astype(float)[:, None] - centres) ** 2).sum(axis=2), 9)
    cell = gaps(corpus).argmin(axis=1)
    visited = gaps(queries).argsort(axis=1, kind="stable")[:, :probes]
    size = np.bincount(cell, minlength=cells)
    both = table(spark, "query_id", queries), table(spark, "id", corpus)
    exact, near = hits(knn(*both, 5)), hits(knn_lsh(*both, 5, cells, probes))
    pairs = lambda found: {(q, i) for q, i, _ in found}
    assert all(cell[i] in visited[q] for q, i in pairs(near))
    return size[visited].sum() / (len(queries) * len(corpus)), len(pairs(exact) & pairs(near)) / len(exact)


def test_lsh_compares_few_pairs_of_a_clustered_corpus(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    vectors = np.repeat(centres, 25, axis=0) + rng.normal(size=(1000, 16)) * 0.2
    share, recall = compared(spark, vectors[::5], vectors, 64, 8)
    assert share <= 0.2 and recall >= 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the given tables are absent")
def test_lsh_compares_half_the_pairs_of_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    vectors = np.array([r.embedding for r in rows])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    share, recall = compared(spark, vectors[::4], vectors, 64, 28)
    assert share <= 0.5 and recall >= 0.8


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    row = df.select(
        v.unit(a).alias("u"), v.unit(b).alias("z"), v.squared_l2(a, b).alias("d"), v.dot(a, a).alias("p")
    ).first()
    assert row.u == pytest.approx([0.6, 0.8])
    assert row.z is None
    assert (row.d, row.p) == (25.0, 25.0)


ITEMS = [
    (1, "x", None, ["a"]), (2, "x", "it", ["b"]), (3, "y", None, ["c"]), (4, "y", "it", None),
    (5, "z", "it", ["a", "b"]),
]


@pytest.fixture
def shop(spark):
    items = spark.createDataFrame(
        ITEMS, "vacancy_id bigint, title string, industry string, skills array<string>"
    )
    index = table(spark, "id", [[i, 0] for i in range(1, 6)], range(1, 6))
    queries = table(spark, "query_id", [[0, 0]], [9])
    return queries, index, items


def test_search_scores_and_order(shop):
    found = s.search(*shop, top_n=2).orderBy("rank").collect()
    assert [r.vacancy_id for r in found] == [1, 2]
    assert [r.similarity_score for r in found] == [0.5, 0.2]


def test_post_filter_may_return_fewer(shop):
    assert [r.vacancy_id for r in s.search(*shop, 1, {"title": "z"}).collect()] == []
    assert [r.vacancy_id for r in s.search(*shop, 1, {"title": "z"}, "pre").collect()] == [5]
    assert [r.vacancy_id for r in s.search(*shop, 1, {"industry": None}).collect()] == [1]
    assert s.search(*shop, 1, {"no such field": 3}).count() == 1


def test_post_filter_is_a_subset_of_candidates(shop):
    kept = {r.vacancy_id for r in s.search(*shop, 5, {"industry": "it"}).collect()}
    assert kept <= {r.vacancy_id for r in s.search(*shop, 5).collect()}


def test_search_needs_an_index(shop):
    queries, _, items = shop
    with pytest.raises(ValueError, match="no index"):
        s.search(queries, None, items)
    with pytest.raises(ValueError, match="unknown mode"):
        s.search(*shop, mode="sideways")


def test_caller_encoder_runs_once_per_task(spark):
    def make():
        return lambda texts: np.array([[len(text), 1.0] for text in texts])

    df = spark.createDataFrame([("abc",), (None,)], "s string")
    found = encode(df, "s", make).collect()
    assert [r.vector for r in found] == [[3.0, 1.0], [0.0, 1.0]]


def test_hashing_encoder(spark):
    df = spark.createDataFrame([("Data data",), ("data",), ("...",), (None,)], "s string")
    same, single, blank, missing = [r.vector for r in encode(df, "s").collect()]
    assert same == single
    assert np.linalg.norm(same) == pytest.approx(1.0)
    assert not any(blank)
    assert not any(missing)
    assert len(blank) == 64


def test_rare_words_weigh_more(spark):
    texts = ["common rare", "common", "common common", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(3)
    fit = fit_idf(df, "s")
    counts = {r.bucket: r.docs for r in fit.collect()}
    assert sorted(counts.values()) == [1, 3, 5] and counts[-1] == 5
    halves = [fit_idf(df.where(F.col("i") % 2 == rest), "s") for rest in (0, 1)]
    assert {r.bucket: r.docs for r in merge_idf(*halves).collect()} == counts
    vectors = {r.i: np.array(r.vector) for r in encode(df, "s", idf=fit).collect()}
    weight = {n: np.log(6 / (1 + n)) + 1 for n in (1, 3)}
    sizes = sorted(abs(x) for x in vectors[0] if x)
    norm = np.hypot(weight[1], weight[3])
    assert sizes == pytest.approx([weight[3] / norm, weight[1] / norm], abs=1e-6)
    assert np.allclose(vectors[1], vectors[2]) and not vectors[3].any() and not vectors[4].any()
    nothing = encode(df, "s", idf=fit_idf(df.limit(0), "s")).collect()
    assert len(nothing) == 5


def test_pieces_of_a_block_bound_each_other(monkeypatch):
    from tagweave.operators import similarity

    queries, block = random_vectors(4, 30).astype(np.float32), random_vectors(5, 700).astype(np.float32)
    codes = np.arange(700)[::-1]
    whole = similarity._nearest(codes, block.astype(float), queries.astype(float), 3, "l2")
    monkeypatch.setattr(similarity, "TILE_ROWS", 64)
    monkeypatch.setattr(similarity, "_WORKING_VALUES", 1000)
    compared = []
    plain = similarity._exact
    monkeypatch.setattr(similarity, "_exact", lambda *a: compared.append(len(a[1])) or plain(*a))
    cut = similarity._nearest(codes, block.astype(float), queries.astype(float), 3, "l2")
    assert all((a == b).all() for a, b in zip(whole, cut))
    # 11 pieces that each gave their own three best would be 990 exact distances at least
    assert sum(compared) < 700


def test_members_beyond_the_bound_of_a_query_are_not_handed_on(spark):
    corpus = table(spark, "id", [[x, 0] for x in range(20)]).withColumn("cell", F.lit(0))
    asked = spark.createDataFrame([(0, 0, [0.0, 0.0], 4.0), (0, 1, [0.0, 0.0], None)], "cell int, query_id int, vector array<float>, bound double")
    found = top_k_per_cell(corpus, asked, 6, tile_rows=5, merged=False).collect()
    assert sorted(r.id for r in found if r.query_id == 0) == [0, 1, 2]
    assert len(found) > 3 + 6


def test_tiles_of_exact_search_are_as_large_as_a_task_can_hold(spark, monkeypatch):
    """The queries are shuffled once for every tile of the corpus."""
    from tagweave.operators import similarity

    asked = []
    plain = similarity.top_k_per_cell
    monkeypatch.setattr(similarity, "top_k_per_cell", lambda *a, **o: asked.append((a[1], o["tile_rows"])) or plain(*a, **o))
    corpus, queries = random_vectors(2, 300, 4), random_vectors(1, 20, 4)
    found = knn_join(table(spark, "query_id", queries), table(spark, "id", corpus), 3, None, 4, 0)
    assert hits(found) == brute(queries, corpus, 3)
    assert [rows for _, rows in asked] == [similarity.BLOCK_VALUES // 4] * 2
    assert "bound" in asked[1][0].columns


def test_long_texts_are_encoded_a_run_at_a_time(spark):
    import pyarrow as pa

    from tagweave.operators import encoding

    texts = pa.array(["a b", None, "c " * 300_000, "", "d", "e " * 900_000, "f"])
    runs = list(encoding.slices(texts))
    assert pa.concat_arrays(runs).equals(texts)
    assert len(runs) >= 2 and all(sum(len(t or "") for t in r.to_pylist()[1:]) <= 1 << 20 for r in runs)
    assert [len(r) for r in encoding.slices(texts.slice(0, 0))] == [0]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist())], "id int, s string")
    together, alone = (encode(rows.repartition(n), "s").collect() for n in (1, 7))
    assert {r.id: r.vector for r in together} == {r.id: r.vector for r in alone}
    assert sorted(map(tuple, fit_idf(rows.repartition(1), "s").collect())) == sorted(map(tuple, fit_idf(rows.repartition(7), "s").collect()))
