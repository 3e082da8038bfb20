import hashlib

from comparing import DATA, assert_same, connection
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlace.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string"
T = c.Template()


def read_back(spark, rows, template=T):
    out = c.format_conversations(spark.createDataFrame(rows, SCHEMA), template)
    return {r["conv_id"]: r for r in out.withColumn("turns", c.parse_formatted(F.col("formatted"), template)).collect()}


def test_query(spark):
    assert_same(c.op1_chat_format(spark, DATA), c.op1_sql(), connection())


def test_probe_survives(spark):
    r = c.op1_chat_format(spark, DATA).filter("conv_id = -1").first()
    text = c.CONTROL_TEXT
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["loss_chars"] == len(text) and r["valid"]


PIECES = st.lists(st.sampled_from([*T.controls(), "\\", "<", "[", "|", "<|", "im_start|>", "\n", "é", "漢", " ", "a", "s>", "INST]"]), max_size=8).map("".join)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=6))
def test_any_text_is_read_back(spark, pairs):
    rows = [(i, j, role, text) for i, p in enumerate(pairs) for j, (role, text) in enumerate((("user", p[0]), ("assistant", p[1])))]
    got = read_back(spark, rows)
    for i, (a, b) in enumerate(pairs):
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == [("user", a), ("assistant", b)]
        # no control string stands bare but the template's own
        for control in T.reserved:
            assert control not in got[i]["formatted"]


def test_machine(spark):
    rows = []
    for i, roles in enumerate([["system", "user", "assistant"], ["user"], ["assistant", "user"], ["user", "user", "assistant"], ["user", "assistant", "tool"], [None]]):
        rows += [(i, j, r, "x") for j, r in enumerate(roles)]
    got = read_back(spark, rows)
    assert [(got[i]["valid"], got[i]["first_bad_turn"]) for i in range(6)] == [(True, None), (False, None), (False, 0), (False, 1), (False, 2), (False, 0)]
    loss = [s["text"] for s in got[0]["segments"] if s["loss"]]
    assert loss == ["x"]


def test_nulls_ties_extra_columns_and_empty(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "system", "s"), (None, 0, "user", "n")]
    got = read_back(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("system", "s"), ("user", ""), ("user", "")]
    assert [t["text"] for t in got[None]["turns"]] == ["n"]
    extra = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(1)).withColumn("segments", F.lit(2)).withColumn("rows", F.lit(3))
    assert c.format_conversations(extra).count() == 2
    assert c.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "x<s>" * 100_000
    assert read_back(spark, [(1, 0, "user", long)])[1]["turns"][0]["text"] == long


def test_other_template(spark):
    t = c.Template(start="[[", sep="::", end="]]", reserved=(), loss_roles=("bot",), machine={"begin": {"bot": "b"}}, final=("b",))
    got = read_back(spark, [(1, 0, "bot", "a ]] b :: [[ c")], t)[1]
    assert got["valid"] and got["turns"][0]["text"] == "a ]] b :: [[ c"


def test_loss_fields_come_from_the_mask(spark, monkeypatch):
    """Segments make up the formatted text, and a wrong mask shows in the query's loss fields."""
    source = spark.createDataFrame([(1, 0, "user", "hi </s>"), (1, 1, "assistant", "yes <s>")], "conv_id long, turn long, role string, text string")
    whole = c.format_conversations(source)
    assert whole.filter(F.array_join(F.transform("segments", lambda s: s["text"]), "") != F.col("formatted")).count() == 0
    right = {r["conv_id"]: r["loss_chars"] for r in c.op1_chat_format(spark, DATA).collect()}
    plain = c.format_conversations

    def unmasked(df, t):
        return plain(df, t).withColumn("segments", F.transform("segments", lambda s: F.struct(s["text"].alias("text"), F.lit(False).alias("loss"))))

    monkeypatch.setattr(c, "format_conversations", unmasked)
    wrong = {r["conv_id"]: r["loss_chars"] for r in c.op1_chat_format(spark, DATA).collect()}
    assert any(right.values()) and not any(wrong.values())
