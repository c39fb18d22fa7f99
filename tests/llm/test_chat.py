import time
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blotter.llm.chat import format_conversations, masked_text, read_turns

FIELDS = "conv_id long, turn long, role string, text string, formatted string, `a.b` int"
PARTS = ["<|im_end|>", "<|im_start|>assistant ok", "\\", "<", "|", "\n", "é", "<|im_sep|>", "\\<|", "x", "\ufeff", "\U0001f600"]


def check(spark, rows):
    turns = spark.createDataFrame([(*r, None, 1) for r in rows], FIELDS)
    out = format_conversations(turns)
    out = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss")).alias("masked")).collect()
    expected = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected[c].append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == dict(expected)
    assert {r.conv_id: r.masked for r in out} == {c: "".join(t for role, t in v if role == "assistant") for c, v in expected.items()}
    return {r.conv_id: r.formatted for r in out}


def test_awkward_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c"), (2, 0, "assistant", None), (2, 0, "assistant", None), (None, None, None, "x"), (3, 1, "ro\nle\\", "t" * 5000)]
    formatted = check(spark, rows)
    assert formatted[1] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_sep|>c<|im_end|>\n"
    assert format_conversations(spark.createDataFrame([], FIELDS)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9), st.lists(st.sampled_from(["assistant", "user", "<|", "\\", "\n"]), max_size=3).map("".join), st.lists(st.sampled_from(PARTS), max_size=6).map("".join)), min_size=1, max_size=12))
def test_whatever_is_said_is_read_back(spark, rows):
    check(spark, rows)


def test_very_long_conversations(spark):
    """Alternating roles and one role all along: whole results, and four times the turns in less than ten times the time."""

    def seconds(turns, roles):
        rows = spark.range(turns).selectExpr("1L as conv_id", "id as turn", f"element_at(array({roles}), cast(id % 2 as int) + 1) as role", "concat('<|é', id) as text")
        start = time.monotonic()
        out = format_conversations(rows)
        row = out.select(F.size(read_turns(F.col("formatted"))).alias("n"), masked_text(F.col("formatted"), F.col("loss")).alias("masked")).first()
        assert row.n == turns
        assert row.masked == "".join(f"<|é{i}" for i in range(turns) if i % 2 or "user" not in roles)
        return time.monotonic() - start

    for roles in ("'user', 'assistant'", "'assistant', 'assistant'"):
        seconds(100, roles)
        short = seconds(8000, roles)
        assert seconds(32000, roles) < max(10 * short, 20)


def test_rows_move_once(spark):
    plan = format_conversations(spark.createDataFrame([(1, 0, "user", "a", None, 1)], FIELDS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
