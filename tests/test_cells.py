"""Trained cells and codes: training, recall, and the saved layout."""

from __future__ import annotations

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import cells as c
from tagweave.operators.similarity import knn
from tagweave.session import stage
from tagweave.sources import embeddings
from tagweave.sources.tables import add_version, publish, published, versions, write_table

GIVEN = "/root/testdata/sf0.1/embeddings.parquet"


def table(spark, vectors, key="id"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{key} bigint, vector array<float>").repartition(4)


def clustered(n=1200, width=10, seed=7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, width))
    return np.float32(np.repeat(centres, n // 20, axis=0) + rng.normal(size=(n, width)) * 0.3)


def test_lloyd_is_the_plain_iteration_at_any_partitioning(spark):
    vectors = clustered(200, 6)
    start = np.stack([vectors[:7, :3], vectors[:7, 3:]]).astype(float)
    want = start.copy()
    for _ in range(3):
        for s in range(2):
            cut = vectors[:, 3 * s : 3 * s + 3].astype(float)
            nearest = np.round(((cut[:, None] - want[s]) ** 2).sum(axis=2), 9).argmin(axis=1)
            want[s] = [cut[nearest == i].mean(axis=0) if (nearest == i).any() else want[s][i] for i in range(7)]
    got = [c.lloyd(table(spark, vectors).repartition(n), [start, np.zeros((1, 2, 6))], 3) for n in (1, 5)]
    assert all(map(np.array_equal, *got)) and np.allclose(got[0][0], want, atol=1e-6)


def test_recall_shortlist_and_rows(spark):
    vectors = clustered()
    queries = table(spark, vectors[::3], "query_id")
    index = c.train_cells(table(spark, vectors), cells=16, parts=5, rounds=4)
    index = index._replace(members=stage(index.members, "members"))
    exact = {(r.query_id, r.id, round(r.distance, 6)) for r in knn(queries, table(spark, vectors), 5).collect()}
    rows = c.search_cells(queries, index, 5, probes=4, shortlist=40).collect()
    found = {(r.query_id, r.id, round(r.distance, 6)) for r in rows}
    assert sorted(r["rank"] for r in rows) == sorted([1, 2, 3, 4, 5] * 400)
    assert len(found & exact) >= 0.95 * len(exact)
    every = c.search_cells(queries, index, 5, probes=16, shortlist=len(vectors))
    assert {(r.query_id, r.id, round(r.distance, 6)) for r in every.collect()} == exact


def test_tiles_change_nothing(spark, monkeypatch):
    vectors = clustered(400)
    queries = table(spark, vectors[:60], "query_id")
    index = c.train_cells(table(spark, vectors), cells=4, parts=5, rounds=2)
    index = index._replace(members=stage(index.members, "members"))
    rows = lambda: sorted(tuple(r) for r in c.search_cells(queries, index, 3, 2, 30).collect())
    whole = rows()
    monkeypatch.setattr(c, "_CUTS", (("n", 32, "member_parts"), ("m", 9, "asker_parts")))
    assert rows() == whole


def test_many_queries_in_blocks_find_what_few_in_tiles_find(spark, monkeypatch):
    vectors = clustered(400)
    rows = [(None if i % 50 == 7 else i // 2 if i < 40 else i, [float(x) for x in vectors[i // 2 if i < 40 else i]]) for i in range(400)]
    corpus = spark.createDataFrame(rows, "id bigint, vector array<float>").repartition(4)
    words = corpus.withColumn("id", F.concat(F.lit("w"), "id")).where("id IS NOT NULL")
    queries = table(spark, np.concatenate([vectors[::4], vectors[:9]]), "query_id")
    queries = queries.unionByName(spark.createDataFrame([(None, rows[3][1]), (5, None)], "query_id bigint, vector array<float>"))
    for known in (corpus, words):
        index = c.train_cells(known.where("id IS NOT NULL"), cells=6, parts=5, rounds=2)
        index = index._replace(members=stage(c.placed(known, index.centres, index.values), "members"))

        def found(few, shortlist, probes):
            monkeypatch.setattr(c, "FEW_ASKERS", few)
            hits = c.search_cells(queries, index, 4, probes, shortlist)
            return sorted((tuple(r) for r in hits.collect()), key=repr)

        for shortlist, probes, working in ((30, 3, 64), (400, 6, 4_000_000)) if known is corpus else ((3, 1, 64),):
            want = found(1_024, shortlist, probes)
            monkeypatch.setattr(c, "_WORKING_VALUES", working)
            monkeypatch.setattr(c, "ASKER_BLOCKS", 3)
            monkeypatch.setattr(c, "PACK_MEMBERS", 17)
            assert want and found(0, shortlist, probes) == want
            monkeypatch.undo()


class Counted(np.ndarray):
    """An array that counts the values that are looked up in it."""

    looked_up = 0

    def __getitem__(self, at):
        out = super().__getitem__(at)
        Counted.looked_up += np.size(out)
        return out


@pytest.mark.parametrize("scale", [1, 1e20])
def test_only_codes_that_may_count_are_looked_up(monkeypatch, scale):
    """The shortlist is that of all tables, with equal codes by id, also beyond single precision."""
    monkeypatch.setattr(c, "_ROUGH_VALUES", 1_600, raising=False)
    vectors = clustered(2_000, 16).astype(float) * scale
    queries, values = vectors[::40], c._sliced(vectors[:1_600:100], 8).transpose(1, 0, 2)
    cells, packed = c._places(vectors, vectors[:1600:400], values)
    code = np.frombuffer(b"".join(packed), np.uint8).reshape(2_000, 8)
    chosen = np.ones((50, 4), dtype=bool)
    chosen[:, 3] = False
    block = c._Block(np.arange(50), queries, chosen, values, 20, 3)
    plain = [np.asarray(t) for t in block.tables]
    Counted.looked_up, block.tables = 0, [t.view(Counted) for t in block.tables]
    ids = np.random.default_rng(3).permutation(2_000)
    order = np.random.default_rng(4).permutation(2_000)
    for at in range(0, 2_000, 100):
        some = order[at : at + 100]
        block.codes(cells[some], ids[some], np.ones(100, bool), code[some])
    block._cut()
    row, gap, _, found, _ = block.found[0]
    for query in range(50):
        every = sum(t[query][code[:, s]] for s, t in enumerate(plain))
        want = [i for i in np.lexsort((ids, np.round(every, 9))) if cells[i] < 3][:20]
        assert set(found[row == query]) == set(ids[want])
        assert np.array_equal(np.sort(gap[row == query]), np.sort(every[want]))
    if scale == 1:
        assert Counted.looked_up < 0.4 * 8 * 50 * (cells < 3).sum()


def test_first_of_rows_with_many_ties():
    rng = np.random.default_rng(5)
    row, gap = rng.integers(0, 30, 3_000), rng.integers(0, 6, 3_000) / 3 + 1e-12
    for ids in (rng.integers(0, 500, 3_000), rng.permutation(3_000).astype(str).astype(object)):
        for kind in (gap, np.where(rng.random(3_000) < 0.9, np.nan, gap)):
            want = sorted(range(3_000), key=lambda i: (row[i], np.isnan(kind[i]), np.nan_to_num(round(kind[i], 9)), ids[i]))
            want = [i for at, i in enumerate(want) if at < 7 or row[want[at - 7]] != row[i]]
            got = c._first_of(row, kind, ids, 7)
            key = lambda i: (row[i], repr(round(kind[i], 9)), ids[i])
            assert sorted(map(key, got)) == sorted(map(key, want))
            assert np.array_equal(row[got], np.sort(row[got]))


def test_a_shortlist_of_many_queries_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(c, "FEW_ASKERS", 0)
    vectors = clustered(200)
    index = c.train_cells(table(spark, vectors), cells=4, parts=5, rounds=1)
    hits = c.search_cells(table(spark, vectors, "query_id"), index, 3, 2, 30)
    assert "FlatMapCoGroups" not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_no_vectors_few_vectors_and_copies(spark):
    nothing = table(spark, clustered(20)).limit(0)
    queries = table(spark, clustered(20)[:2], "query_id")
    assert c.search_cells(queries, c.train_cells(nothing), 3).collect() == []
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0])], "id bigint, vector array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.5]), (8, None)], "query_id bigint, vector array<float>")
    found = c.search_cells(asked, c.train_cells(few), 3).collect()
    assert [(r.query_id, r.id, r.distance, r["rank"]) for r in found] == [(9, 1, 0.25, 1), (9, 3, 0.25, 2)]


def test_saved_by_cell_and_read_by_visited_cells(spark, tmp_path):
    vectors = clustered(400)
    path = str(tmp_path / "index")
    made = c.train_cells(table(spark, vectors), cells=8, parts=5, rounds=2)
    c.save_cells(c.train_cells(table(spark, vectors[:40]), cells=2, parts=5, rounds=1), path)
    c.save_cells(made, path)
    index = c.load_cells(spark, path)
    assert np.array_equal(index.centres, made.centres) and np.array_equal(index.values, made.values)
    columns = ["id", "cell", "code", "vector"]
    assert sorted(index.members.select(columns).collect()) == sorted(made.members.select(columns).collect())

    routes = stage(spark.createDataFrame([(3, 1)], "cell int, query_id long"), "routes")
    visited = c.visited_members(index.members, routes)
    text = visited._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruningexpression\(cell", text)
    scanned = index.members.select("cell", F.col("_metadata.file_path").alias("f"))
    read = c.visited_members(scanned, routes).distinct().collect()
    assert {r.cell for r in read} == {3} and all("/cell=3/" in r.f for r in read)
    assert visited.count() == made.members.where("cell = 3").count() > 0


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="the given tables are absent")
def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet(GIVEN).orderBy("vec_id").collect()
    vectors = np.array([r.embedding for r in rows])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    queries, corpus = table(spark, vectors[::4], "query_id"), table(spark, vectors)
    index = c.train_cells(corpus)
    index = index._replace(members=stage(index.members, "members"))
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    exact = pairs(knn(queries, corpus, 5))
    found = pairs(c.search_cells(queries, index, 5))
    assert c.SHORTLIST / len(vectors) <= 0.25
    print("recall", len(found & exact) / len(exact))
    assert len(found & exact) / len(exact) >= 0.9


def test_a_failed_writer_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5)
    write_table(df, path)
    broken = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("half way"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="half way"):
        write_table(broken, path)
    assert spark.read.parquet(path).count() == 5
    write_table(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]

    many = str(tmp_path / "v")
    publish({"a": df, "b": df}, many)
    with pytest.raises(Exception, match="half way"):
        publish({"a": spark.range(2), "b": broken}, many)
    assert published(spark, many, "a").count() == 5 and len(versions(spark, many)) == 1
    add_version(spark, many, lambda folder: spark.range(3).write.parquet(f"{folder}/a"))
    assert published(spark, many, "a").count() == 3


def test_items_whose_text_changed_are_embedded_again(spark, tmp_path):
    path, asked = str(tmp_path / "index"), []

    def embed(items):
        asked.append(sorted(r.k for r in items.collect()))
        return items.select(F.col("k").alias("id"), F.array(F.length("t").cast("float")).alias("vector"))

    def refresh(*rows):
        items = spark.createDataFrame(list(rows), "k long, t string")
        found = embeddings.refresh_index(items, "k", F.col("t"), embed, path)
        return sorted((r.id, r.vector[0]) for r in found.collect())

    assert refresh((1, "a"), (2, "bb"), (None, "x")) == [(1, 1.0), (2, 2.0)]
    assert refresh((1, "a"), (2, "cccc"), (3, "ddd")) == [(1, 1.0), (2, 4.0), (3, 3.0)]
    assert refresh((2, "cccc"), (3, "ddd")) == [(2, 4.0), (3, 3.0)]
    assert refresh((1, "aaaaa"), (2, "e")) == [(1, 5.0), (2, 1.0)]
    assert asked == [[1, 2], [2, 3], [1, 2]] and len(versions(spark, path)) == 3
    assert sorted((r.id, r.vector[0]) for r in embeddings.read_layers(spark, path).collect()) == [(1, 5.0), (2, 1.0), (3, 3.0)]


def test_filters_inside_the_search(spark):
    """One value is rare and far from most queries, one is in no cell, one is null."""
    vectors = clustered(600)
    kinds = [None if i % 7 == 0 else "rare" if 590 <= i < 594 else "common" for i in range(600)]
    items = spark.createDataFrame([(i, kind, i % 2) for i, kind in enumerate(kinds)], "k long, kind string, half int")
    index = c.train_cells(table(spark, vectors), cells=12, parts=5, rounds=3)
    index = index._replace(members=stage(index.members, "members"))
    summary = stage(c.summarise(index.members, items, "k", ["kind", "half"]), "summary")
    queries = table(spark, vectors[:25], "query_id")

    def compare(filters, probes, shortlist=600):
        kept = [i for i in range(600) if all({"kind": kinds[i], "half": i % 2}.get(f, v) == v for f, v in filters.items())]
        found = c.search_cells_filtered(queries, index, items, summary, filters, 5, "k", probes, shortlist)
        rows = {(r.query_id, r.id) for r in found.collect()}
        exact = set()
        for q, v in enumerate(vectors[:25].astype(float)):
            gaps = ((vectors[kept].astype(float) - v) ** 2).sum(axis=1)
            exact |= {(q, kept[j]) for j in sorted(range(len(kept)), key=lambda j: (round(gaps[j], 9), kept[j]))[:5]}
        return rows, exact

    for filters in ({"kind": "common"}, {"kind": None, "half": 1}, {"kind": "rare"}, {"kind": "absent"}, {"nope": 1}):
        rows, exact = compare(filters, 12)
        assert rows == exact
        few, _ = compare(filters, 2, 60)
        assert len(few) == len(exact) and len(few & exact) >= 0.7 * len(exact)
    assert len(compare({"kind": "rare"}, 1)[0]) == 4 * 25
    possible = c.possible_members(summary, {"kind": "rare", "half": 0}, 12)
    assert possible.sum() <= 4 and (possible > 0).sum() <= 2
