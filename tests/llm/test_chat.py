"""Chat formatting: exact round trips and digests."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tagweave.llm.chat import formatted, report

MARKS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE dG8=]", "[/ROLE]", "\\", "[", "<", "/", "]", ">", " ", "\n", "é", "s", "$1", "ok"]


def made(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 6)):
            text = "".join(rng.choice(MARKS) for _ in range(rng.randrange(8)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool ]x", "", "a" * 90]), text))
    return rows


def schema():
    return "conv_id long, turn int, role string, text string"


def test_round_trip(spark):
    rows = made(400)
    out = {r.conv_id: r for r in formatted(spark.createDataFrame(rows, schema())).collect()}
    assert any(r.escaped for r in out.values()) and any(not r.escaped for r in out.values())
    for conv, r in out.items():
        want = [(role, text) for c, _, role, text in rows if c == conv]
        assert [tuple(t) for t in r.recovered] == want
        assert "".join(r.split) == r.formatted
        assert sum(run.length for run in r.loss_mask) == len(r.formatted)


def test_escaped_texts_hold_no_control_strings(spark):
    out = formatted(spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]")], schema())).first()
    assert out.formatted == "[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]"
    assert out.escaped
    plain = formatted(spark.createDataFrame([(1, 0, "assistant", "a [b] <c>")], schema())).first()
    assert plain.formatted == "<s> a [b] <c> </s>" and not plain.escaped


def test_report(spark):
    rows = [*made(100, 2), (900, 1, "assistant", None), (900, None, "user", "first"), (900, 0, None, "x"), (None, 0, "user", ""), (901, 0, "user", "q"), (901, 0, "user", "q"), (902, 0, "assistant", "long " * 50_000)]
    frame = spark.createDataFrame(rows, schema()).withColumn("turns", F.lit(1)).withColumn("formatted", F.lit("x"))
    got = {r.conv_id: r for r in report(formatted(frame)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv)
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars) == (len(turns), digest, len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_empty(spark):
    assert report(formatted(spark.createDataFrame([], schema()))).collect() == []


def test_no_python_in_the_plan(spark):
    plan = report(formatted(spark.createDataFrame(made(3), schema())))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
