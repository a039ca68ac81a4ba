from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tagweave import wording as w
from tagweave.operators import items as ops
from tagweave.operators.ingest import ingest
from tagweave.operators.search import RECOMMENDED_FIELDS
from tagweave.sources import landing
from tagweave.sources.tables import to_table


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tag_counts_count_empty_and_missing_lists(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), ([],), (None,)], "skills array<string>")
    assert rows(ops.tag_counts(df)) == [("a", 2), ("b", 1), (None, 2)]


def test_top_tags_break_ties_by_name(spark):
    df = spark.createDataFrame([(["c", "b", "a"],), (["c"],)], "skills array<string>")
    assert [r.tag for r in ops.top_tags(df, 2).collect()] == ["c", "a"]


def test_filter_equal(spark):
    df = spark.createDataFrame(
        [(1, None, ["x"]), (2, "v", ["x"]), (3, None, ["y"])], "id int, f string, l array<string>"
    )
    keep = lambda filters: [r.id for r in ops.filter_equal(df, filters).collect()]
    assert keep({"f": None}) == [1, 3]
    assert keep({"f": "v"}) == [2]
    assert keep({"f": None, "l": ["x"]}) == [1]
    assert keep({"nope": 1}) == [1, 2, 3]
    assert keep(None) == [1, 2, 3]


def test_keep_first_and_any(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, o int, v string")
    assert rows(ops.keep_first(df, "k", "o")) == [(1, 1, "a"), (2, 5, "c")]
    assert [r[0] for r in rows(ops.keep_any(df, "k"))] == [1, 2]


def test_with_defaults_keeps_present_nulls(spark):
    df = spark.createDataFrame([("t", None)], "title string, company string")
    row = ops.with_defaults(df, RECOMMENDED_FIELDS).first()
    assert (row.title, row.company, row.experience, row.skills, row.similarity_score) == (
        "t", None, "", [], 0.0,
    )


def test_types_strict_and_lenient(spark):
    schema = "vacancy_id string, salary_from string, salary_to string, published_at string"
    good = spark.createDataFrame([("7", "1", None, "2025-09-08T12:34:56+0300")], schema)
    typed = ops.type_items(good).select("vacancy_id", F.unix_seconds("published_at").alias("s")).first()
    assert typed.vacancy_id == 7
    when = dt.datetime(2025, 9, 8, 9, 34, 56, tzinfo=dt.timezone.utc)
    assert typed.s == when.timestamp()
    bad = spark.createDataFrame([("7", "x", None, "yesterday")], schema)
    with pytest.raises(PySparkException):
        ops.type_items(bad).collect()
    lenient = ops.type_items(bad, strict=False).first()
    assert (lenient.vacancy_id, lenient.salary_from, lenient.published_at) == (7, None, None)


def test_empty_table_keeps_its_schema(spark):
    table = to_table(spark, [], "id bigint, tags array<string>")
    assert table.columns == ["id", "tags"]
    assert table.count() == 0


def test_request_grid(spark):
    grid = landing.request_grid(landing.default_keywords(spark)).collect()
    assert len(grid) == len(w.KEYWORDS) == 22
    assert {(r.city, r.city_id) for r in grid} == {("Москва", 1)}


def write(folder, name, documents):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [d if isinstance(d, str) else json.dumps(d, ensure_ascii=False) for d in documents]
    (folder / name).write_text("\n".join(lines))


def listed(number, **more):
    return {
        "id": str(number),
        "name": f"title {number}",
        "area": {"name": "Москва"},
        "snippet": {"requirement": "r", "responsibility": None},
        "employer": {"id": "e1", "name": "Acme"},
        "experience": {"name": "Нет опыта"},
        "alternate_url": f"u/{number}",
        "published_at": "2025-09-08T12:34:56+0300",
        **more,
    }


def page(keyword, number, pages, *found):
    return {"keyword": keyword, "page": number, "pages": pages, "items": list(found)}


def test_crawl_stops(spark, tmp_path):
    one = listed(1)
    write(
        tmp_path,
        "pages.json",
        [
            page("ML", 0, 9, one), page("ML", 1, 9), page("ML", 2, 9, one),
            page("AI", 0, 1, one), page("AI", 1, 1, one), page("AI", 2, 1, one),
            page("NLP", 0, 9, one), page("NLP", 2, 9, one),
            page("LLM", 1, 9, one),
            '{"keyword": "broken',
        ],
    )
    kept = landing.crawled_pages(landing.scan_pages(spark, str(tmp_path)))
    assert rows(kept.select("keyword", "page")) == [("AI", 0), ("AI", 1), ("ML", 0), ("NLP", 0)]


def test_keyword_and_page_from_folders(spark, tmp_path):
    body = {"pages": 1, "items": [listed(1), listed(2)]}
    write(tmp_path / "keyword=ML" / "page=0", "a.json", [body])
    found = landing.page_items(landing.scan_pages(spark, str(tmp_path)))
    assert rows(found.select("keyword", "page", "position", "item.id")) == [
        ("ML", 0, 0, "1"), ("ML", 0, 1, "2"),
    ]


def test_ingest(spark, tmp_path):
    formats = [{"id": "R", "name": "Remote"}]
    write(
        tmp_path / "pages",
        "p.json",
        [
            page("NLP", 0, 0, listed(2), listed(1)),
            page("ML", 0, 0, listed(1, work_format=formats, salary={"from": 0, "to": 5, "currency": "RUR"})),
            page("LLM", 0, 0, listed(3, employer={"id": None, "name": "Anon"}, experience={})),
            page("unknown keyword", 0, 0, listed(4)),
        ],
    )
    write(
        tmp_path / "details",
        "d.json",
        [{"id": "1", "key_skills": [{"name": "a"}]}, {"id": "2", "key_skills": ["b"]}],
    )
    write(
        tmp_path / "employers",
        "e.json",
        [{"id": "e1", "industries": [{"name": "IT"}, {"name": "Other"}]}, {"id": "e2", "industries": []}],
    )
    table = ingest(spark, *[str(tmp_path / n) for n in ("pages", "details", "employers")])
    found = {r.vacancy_id: r for r in table.collect()}
    assert sorted(found) == [1, 2, 3]
    assert found[1].source_vacancy == "ML"
    assert found[1].salary_str == "-5 RUR"
    assert found[1].work_format_names == ["Remote"]
    assert found[1].industry == "IT"
    assert found[1].skills == ["a"]
    assert found[2].skills == ["b"]
    assert found[2].salary_str == w.NO_SALARY
    assert found[2].work_format_ids == []
    assert found[2].responsibility == ""
    assert (found[3].skills, found[3].industry, found[3].experience) == (
        [], w.UNKNOWN_INDUSTRY, w.NO_EXPERIENCE_LABEL,
    )


def test_rows_are_counted_on_the_way(spark, tmp_path):
    items, seen = ops.observed(spark.range(7), "ingested")
    items.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"rows": 7}
