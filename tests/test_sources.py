from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tagweave import schemas, session
from tagweave.sources import embeddings, landing
from tagweave.sources.tables import write_table
from tagweave.streaming.ingest import append_items, keep_refused, stream_ingest, stream_refused


def items(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "vacancy_id bigint")


def embed(df):
    return df.select(
        F.col("vacancy_id").alias("id"), F.array(F.col("vacancy_id").cast("float")).alias("vector")
    )


def test_index_is_built_then_grown(spark, tmp_path):
    path, asked = str(tmp_path / "index"), []

    def counting(df):
        asked.append(sorted(r.vacancy_id for r in df.collect()))
        return embed(df)

    first = embeddings.build_or_load_index(items(spark, 1, 2), "vacancy_id", counting, path)
    assert first.count() == 2
    grown = embeddings.build_or_load_index(items(spark, 2, 3), "vacancy_id", counting, path)
    assert sorted((r.id, r.vector) for r in grown.collect()) == [(2, [2.0]), (3, [3.0])]
    assert asked == [[1, 2], [3]]
    assert spark.read.parquet(path).count() == 3


def test_saving_needs_an_index(tmp_path):
    with pytest.raises(ValueError, match="no index"):
        embeddings.save_index(None, str(tmp_path))


def test_sink_overwrites(spark, tmp_path):
    path = str(tmp_path / "items")
    write_table(items(spark, 1, 2), path)
    write_table(items(spark, 3), path)
    assert [r.vacancy_id for r in spark.read.parquet(path).collect()] == [3]


def test_stage_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None)], "a int, b array<string>")
    assert session.stage(df, "t").collect() == df.collect()
    assert session.stage(df.limit(0), "t").columns == ["a", "b"]


def page(number, *ids, **more):
    items = [{"id": str(i), "name": f"t{i}"} for i in ids]
    return {"keyword": "k", "page": number, "pages": 9, "items": items, **more}


def test_documents_over_several_lines(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.json").write_text(json.dumps(page(i, i), indent=1 if i == 1 else None))
    found = landing.crawled_pages(landing.scan_pages(spark, str(tmp_path), multi_line=True))
    assert sorted(r.page for r in found.collect()) == [0, 1, 2]
    assert landing.refused(spark, str(tmp_path), "page", multi_line=True).count() == 0
    lost = landing.refused(spark, str(tmp_path), "page").collect()
    assert len(lost) > 1 and all(r.kind == "page" for r in lost)


def test_refused_documents_are_told(spark, tmp_path):
    lines = [json.dumps(page(0, 1)), json.dumps(page(1, 2))[:-4], json.dumps({"keyword": "k"}), json.dumps(page(2, 3))]
    (tmp_path / "pages.json").write_text("\n".join(lines))
    assert sorted(r.page for r in landing.scan_pages(spark, str(tmp_path)).collect()) == [0, 2]
    assert sorted((r.refused or "") for r in landing.refused(spark, str(tmp_path), "page").collect()) == ["", lines[1]]


def test_details_as_they_come(spark, tmp_path):
    docs = [{"id": "1", "key_skills": [{"name": "a"}]}, {"id": "2", "key_skills": ["b"]}, {"id": "3"}, {"id": "4", "key_skills": []}]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, docs)))
    found = {r.id: r.skills for r in landing.scan_details(spark, str(tmp_path)).collect()}
    assert found == {"1": ["a"], "2": ["b"], "3": [], "4": []}


def test_stream_ingest_grows_and_repeats_nothing(spark, tmp_path):
    pages, details, employers = (tmp_path / n for n in ("pages", "details", "employers"))
    for folder in (pages, details, employers):
        folder.mkdir()
    (details / "d.json").write_text('{"id":"1","key_skills":["go"]}')
    (employers / "e.json").write_text('{"id":"9","industries":[{"name":"IT"}]}')
    items_path, index_path = str(tmp_path / "items"), str(tmp_path / "index")

    def arrive(name, *documents):
        (pages / name).write_text("\n".join(map(json.dumps, documents)))
        found = stream_ingest(spark, str(pages), str(details), str(employers), items_path, index_path, ["k"])
        assert sorted(r.id for r in spark.read.parquet(index_path).collect()) == sorted(r.vacancy_id for r in found.collect())
        return {r.vacancy_id: (r.title, r.skills) for r in found.collect()}

    assert arrive("a.json", page(0, 1, 2), page(1, 2)) == {1: ("t1", ["go"]), 2: ("t2", [])}
    assert set(arrive("b.json", page(2, 2, 3))) == {1, 2, 3}
    # the same batch again, as after a failure between the two tables
    listed = landing.page_items(landing.scan_pages(spark, str(pages)))
    append_items(listed, str(details), str(employers), items_path, index_path, ["k"])
    assert spark.read.parquet(items_path).count() == spark.read.parquet(index_path).count() == 3


def test_scratch_is_the_named_folder(spark, tmp_path):
    class Conf:
        def get(self, key, default):
            return {"spark.checkpoint.dir": f"{tmp_path}/shared/"}.get(key, default)

    class Named:
        conf = Conf()

    assert session.scratch_root(Named()) == f"{tmp_path}/shared"


def test_no_machine_local_scratch_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(Session())


def test_the_stream_keeps_what_it_cannot_read(spark, tmp_path):
    pages, details, employers = (tmp_path / n for n in ("pages", "details", "employers"))
    for folder in (pages, details, employers):
        folder.mkdir()
    (details / "d.json").write_text('{"id":"1","key_skills":["go"]}')
    (employers / "e.json").write_text('{"id":"9","industries":[{"name":"IT"}]}')
    items_path, index_path = str(tmp_path / "items"), str(tmp_path / "index")
    cut = json.dumps(page(7, 7))[:-4]

    def arrive(name, text, **options):
        (pages / name).write_text(text)
        stream_ingest(spark, str(pages), str(details), str(employers), items_path, index_path, ["k"], **options)
        return sorted((r.batch, r.refused or "") for r in stream_refused(spark, items_path).collect())

    assert arrive("a.json", "\n".join([json.dumps(page(0, 1)), cut, json.dumps({"keyword": "k"})])) == [(0, ""), (0, cut)]
    landed = spark.read.schema(f"{schemas.LISTING_PAGE}, {landing.REFUSED} string")
    again = landed.option("columnNameOfCorruptRecord", landing.REFUSED).json(str(pages))
    keep_refused(again, 0, f"{items_path}-refused")
    assert arrive("b.json", json.dumps(page(1, 2))) == [(0, ""), (0, cut)]
    assert arrive("c.json", json.dumps(page(2, 3), indent=1), multi_line=True) == [(0, ""), (0, cut)]
    assert sorted(r.vacancy_id for r in spark.read.parquet(items_path).collect()) == [1, 2, 3]
    by_scan = landing.refused(spark, str(pages / "a.json"), "page")
    assert sorted((r.refused or "") for r in by_scan.collect()) == ["", cut]
