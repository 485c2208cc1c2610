import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat


def test_round_trip_with_control_strings(spark):
    rng = random.Random(4)
    bits = ["\\", "0", "01", "<turn role=", "</turn>", "</tur", "n>", ">\n", "<", "a", "é", "\n", "$1", "\\02"]
    rows = [(c, t, rng.choice(["user", "assistant", ">\n", "\\</turn>", "", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))])) for c in range(60) for t in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.formatted(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("under", chat.loss_text(F.col("segments"))).collect()}
    for c in {r[0] for r in rows}:
        own = [(r or "", t or "") for i, _, r, t in rows if i == c]
        assert [tuple(x) for x in got[c].back] == own
        assert got[c].under == "".join(t for r, t in own if r == "assistant")
        assert "".join(s.text for s in got[c].segments) == got[c].formatted


def test_machine(spark):
    cases = {1: "ua", 2: "sua", 3: "uaua", 4: "u", 5: "au", 6: "uu", 7: "usa", 8: "suaus", 9: "xa"}
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    df = spark.createDataFrame([(c, i, names[x], "t") for c, s in cases.items() for i, x in enumerate(s)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.bad_turn) for r in chat.formatted(df).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (True, None), 4: (False, None), 5: (False, 0), 6: (False, 1), 7: (False, 1), 8: (False, 4), 9: (False, 0)}


def test_edge_rows(spark):
    long = "x" * 500_000
    df = spark.createDataFrame(
        [(None, 1, "user", "a", 1), (None, None, "system", "b", 1), (2, 1, "user", "b", 1), (2, 1, "user", "a", 1), (2, 1, "user", "a", 1), (3, 0, "assistant", long, 1), (3, 1, None, None, 1)],
        "conv_id long, turn long, role string, text string, segments int",
    )
    got = {r.conv_id: r for r in chat.formatted(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert [t.text for t in got[None].back] == ["b", "a"] and [t.text for t in got[2].back] == ["a", "a", "b"]
    assert [tuple(t) for t in got[3].back] == [("assistant", long), ("", "")]
    assert chat.formatted(df.where("false")).count() == 0


def test_plan_is_native(spark):
    plan = chat.op2_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_query(spark):
    rows = {r.conv_id: r for r in chat.op2_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    said = r"\### Assistant: </turn> ok"
    r = rows[-7]
    assert (r.n_turns, r.loss_chars, r.valid) == (2, len(said), True)
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template(closing="a\\b")
    with pytest.raises(ValueError):
        chat.Template(closing="1x")
    with pytest.raises(ValueError):
        chat.Template(closing="aba")


def test_sql(spark):
    from tests.llm.oracle import same

    assert same(spark, chat.op2_chat_formatting, chat.OP2_SQL, "/root/testdata/sf0.01").num_rows == 101
