from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagweave import wording as w
from tagweave.functions import text as t


def one(spark, column, **values):
    types = ", ".join(
        f"{name} {'array<string>' if isinstance(v, list) else 'string'}" for name, v in values.items()
    )
    return spark.createDataFrame([tuple(values.values())], types).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "normal"),
    [
        ("Учёт C++ ", "уч т c "),
        (None, ""),
        ("  A  b\n", "a b"),
        ("x y", "x y"),
        ("---", " "),
        ("", ""),
        ("\U0001f600a", " a"),
    ],
)
def test_normalise(spark, raw, normal):
    assert one(spark, t.normalise_text(F.col("s")), s=raw) == normal


def test_normalise_long_run_of_dropped_characters(spark):
    assert one(spark, t.normalise_text(F.col("s")), s="a" + "漢" * 200_000 + "b") == "a b"


@settings(
    max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(texts=st.lists(st.text(max_size=30), min_size=20, max_size=40))
def test_normalise_twice_changes_edges_only(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    once = t.normalise_text(F.col("s"))
    rows = df.select(once.alias("a"), t.normalise_text(once).alias("b")).collect()
    assert all(r.a.strip() == r.b for r in rows)


@settings(
    max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(texts=st.lists(st.text(max_size=20), min_size=20, max_size=40))
def test_strip_is_the_python_strip(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    rows = df.select("s", t.strip(F.col("s")).alias("x")).collect()
    assert all(r.x == r.s.strip() for r in rows)


@pytest.mark.parametrize(
    ("label", "level"),
    [
        ("От 1 года до 3 лет", w.ONE_TO_THREE),
        ("От 3 до 6 лет", w.THREE_TO_SIX),
        ("Более 6 лет", w.MORE_THAN_SIX),
        ("БОЛЕЕ чем", w.MORE_THAN_SIX),
        ("Нет опыта", w.NO_EXPERIENCE),
        ("", w.NO_EXPERIENCE),
        (None, w.NO_EXPERIENCE),
    ],
)
def test_level_from_label(spark, label, level):
    assert one(spark, t.level_from_label(F.col("s")), s=label) == level


@pytest.mark.parametrize(
    ("said", "level"),
    [
        ("0 лет", w.NO_EXPERIENCE),
        ("3 года", w.ONE_TO_THREE),
        ("6 лет", w.THREE_TO_SIX),
        ("7 лет", w.MORE_THAN_SIX),
        ("99999999999999999999 лет", w.MORE_THAN_SIX),
        ("000 лет", w.NO_EXPERIENCE),
        ("1год, потом 9 лет", w.ONE_TO_THREE),
        ("без числа", w.NO_EXPERIENCE),
        ("7 ЛЕТ", w.NO_EXPERIENCE),
    ],
)
def test_level_from_years(spark, said, level):
    assert one(spark, t.level_from_years(t.year_digits(F.col("s"))), s=said) == level


@pytest.mark.parametrize(
    ("said", "tags"),
    [
        ("ЗНАЮ Python, SQL. знаю Go", ["Go", "Python", "SQL"]),
        ("Skills: a, bb; cc!", ["bb", "cc"]),
        (f"навыки - {'x' * 39}, {'y' * 40}", ["x" * 39]),
        ("знаю\nPython", ["Python"]),
        ("владею Git, git, Git", ["Git", "git"]),
        ("ничего", []),
        (None, []),
    ],
)
def test_extract_tags(spark, said, tags):
    assert one(spark, t.extract_tags(F.col("s")), s=said) == tags


def test_profile_text(spark):
    level = F.lit(w.NO_EXPERIENCE)
    full = t.profile_text(F.col("a"), F.col("b"), level)
    assert one(spark, full, a="x", b=["p", "q"]) == (
        "Опыт и обязанности: x. Навыки: p, q. Опыт: нет опыта"
    )
    assert one(spark, full, a="x", b=[]) == "Опыт и обязанности: x. Опыт: нет опыта"


def test_work_text_skips_empty_parts(spark):
    work = t.work_text(F.col("a"), F.col("b"))
    assert one(spark, work, a="Ab", b="CD") == "ab cd"
    assert one(spark, work, a="", b="CD") == "cd"
    assert one(spark, work, a=None, b=None) == ""


def test_salary_text(spark):
    df = spark.createDataFrame(
        [(0, 5, "RUR", False), (None, 7, None, False), (10, None, "USD", False), (None, None, None, True)],
        "a bigint, b bigint, c string, missing boolean",
    )
    text = t.salary_text(F.col("a"), F.col("b"), F.col("c"), F.col("missing"))
    assert [r.x for r in df.select(text.alias("x")).collect()] == [
        "-5 RUR", "-7 ", "10- USD", "з/п не указана",
    ]


@pytest.mark.parametrize(
    ("verdict", "yes"), [("Да.", True), ("Нет", False), ("123456789012да", False), ("  ДА", True), (None, False)]
)
def test_says_yes(spark, verdict, yes):
    assert one(spark, t.says_yes(F.col("s")), s=verdict) is yes


@pytest.mark.parametrize(
    ("answer", "short"), [(None, True), ("", True), (" ab \n", True), ("abc", False), (" ab", True)]
)
def test_too_short(spark, answer, short):
    assert one(spark, t.too_short(F.col("s")), s=answer) is short


def test_split_tags(spark):
    assert one(spark, t.split_tags(F.col("s")), s=" a, b ,,c") == ["a", "b", "", "c"]
    assert one(spark, t.split_tags(F.col("s")), s="") == []
    assert one(spark, t.split_tags(F.col("s")), s=None) == []


def test_path_label(spark):
    label = t.path_label(F.col("a"), F.col("b"))
    assert one(spark, label, a="x", b="y") == "x в y"
    assert one(spark, label, a="", b="y") is None
    assert one(spark, label, a="x", b=None) is None


def test_fill_does_not_scan_filled_text(spark):
    filled = t.fill("{a}-{b}", a=F.col("a"), b=F.col("b"))
    assert one(spark, filled, a="{b}", b="z") == "{b}-z"


def test_index_text(spark):
    text = t.index_text(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("e"))
    assert one(spark, text, a="Dev", b="Acme", c=["C#", "Go"], d="1-3", e=None) == "dev acme c go 1 3"
