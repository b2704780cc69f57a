import json

import duckdb
import pytest
from conftest import SF_SMALL
from keelson.llm import chat, queries
from pyspark.sql import functions as F


def formatted(df) -> dict:
    out = chat.format_turns(df).select("*", chat.read_turns(F.col("formatted")).alias("back"),
                                       chat.read_masked(F.col("formatted"), F.col("loss_mask")).alias("learned"))
    return {r["conv_id"]: r for r in out.collect()}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_SMALL}/conversations.parquet'")
    rel = con.execute(queries.OP10_SQL)
    names = [d[0] for d in rel.description]
    want = sorted(rel.fetchall())
    got = sorted(tuple(r[n] for n in names) for r in queries.op10_chat_format(spark, SF_SMALL).collect())
    assert got == want and any(r[0] == -7 for r in got)


SLY = ["", "\\", "\\s\\l\\g", "<", "</turn>\n", "<turn assistant>", "a\\</turn>\n<turn user>b", "\\\\l", "é😀 <>\\>", "\n", "x" * 50_000 + "<"]


def test_round_trip_of_control_strings(spark):
    rows = [(i, k, role, t) for i, role in enumerate(["assistant", "user", "as<s>\\istant", "", "a\nb"]) for k, t in enumerate(SLY)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for i, r in formatted(chat.canonical_turns(df)).items():
        assert [(t["role"], t["text"]) for t in r["back"]] == [(x[2], x[3]) for x in rows if x[0] == i]
        assert r["learned"] == ("".join(SLY) if i == 0 else "")
        for m in r["loss_mask"]:
            assert r["formatted"][m["start"] - 1] == ">" and r["formatted"][m["end"]:].startswith("</turn>\n")


def test_order_nulls_and_extra_columns(spark):
    rows = [(1, 2, "assistant", "c"), (1, 1, "user", "b"), (1, None, None, None), (1, 1, "user", "a"), (1, 1, "user", "a"),
            (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .selectExpr("*", "'x' AS layout", "'y' AS turns", "'z' AS formatted", "'r' AS rows")
    got = formatted(chat.canonical_turns(df))
    assert [t["text"] for t in got[1]["back"]] == ["", "a", "a", "b", "c"] and got[1]["layout"] == "turn_rows"
    assert [t["text"] for t in got[None]["back"]] == ["lost"]
    assert formatted(chat.canonical_turns(df.limit(0))) == {}


U, A = ("user", "q"), ("assistant", "a")
RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7}, "messages", [U, A]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "speakers", [U, A]),
    ({"prompt": "q", "response": "a", "source": "x"}, "prompt_response", [U, A]),
    ({"completion": "a", "prompt": "q"}, "prompt_completion", [U, A]),
    ({"system": "s", "prompt": "q", "response": None}, "system_prompt_response", [("system", "s"), U, ("assistant", "")]),
    ({"instruction": "q", "output": "a"}, "instruction", [U, A]),
    ({"instruction": "q", "input": "", "output": "a"}, "instruction_input", [U, A]),
    ({"instruction": "q", "input": "i", "output": "a"}, "instruction_input", [("user", "q\n\ni"), A]),
    ({"question": "q", "answer": "a"}, "question_answer", [U, A]),
    ({"prompt": "q"}, None, []), ({"messages": []}, None, []), ([1], None, []), ("text", None, []),
]


def test_json_layout_by_the_fields_of_all_elements(spark):
    records = [{"messages": [{"role": "system"}, {"role": "user", "content": "q"}]}, {"messages": [{}, {"content": "q", "role": "user", "name": {"a": [1]}}]},
               {"conversations": [{"from": "human"}, {"value": "q", "from": "human"}]},
               {"messages": [None, 3, "x"]}, {"messages": []}, {"messages": {"role": "user", "content": "q"}}]
    got = {r["conv_id"]: r for r in chat.canonical_turns_json(
        spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")).collect()}
    for i in range(3):
        assert got[i]["layout"] and len(got[i]["turns"]) == 2 and got[i]["turns"][1]["text"] == "q"
    assert all(got[i]["layout"] is None and got[i]["turns"] == [] for i in (3, 4, 5))


def test_json_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(90, None), (91, "{broken"), (92, "")]
    got = {r["conv_id"]: r for r in chat.canonical_turns_json(
        spark.createDataFrame(rows, "conv_id long, record string").selectExpr("*", "1 AS layout", "2 AS turns")).collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert (got[i]["layout"], [tuple(t) for t in got[i]["turns"]]) == (layout, turns), RECORDS[i]
    assert all(got[i]["layout"] is None and got[i]["turns"] == [] for i in (90, 91, 92))


@pytest.mark.parametrize("record,layout,turns", [r for r in RECORDS if isinstance(r[0], dict) and r[1]])
def test_typed_tables_choose_the_same_mapping(spark, record, layout, turns):
    ddl = next(m.fields for m in chat.MAPPINGS if m.name == layout)
    df = spark.createDataFrame([(1, json.dumps(record))], "conv_id long, j string") \
        .select("conv_id", F.from_json("j", ddl).alias("s")).select("conv_id", "s.*", F.lit(1).alias("extra"))
    r = chat.canonical_turns(df).first()
    assert (r["layout"], [tuple(t) for t in r["turns"]]) == (layout, turns)


def test_unknown_typed_table(spark):
    r = chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, other string")).first()
    assert r["layout"] is None and r["turns"] == []
