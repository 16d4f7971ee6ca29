"""Chat formatting: layouts, exact read-back, edge cases, the query against plain Python."""

import hashlib
import json

from pyspark.sql import functions as F

from tempora.llm import chat as C
from tempora.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"

RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"messages": [{"content": None, "role": None}, {"role": "tool", "content": 5}]}, "messages", None),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "<|end|>"}, {"from": "odd", "value": ""}]},
     "from-value", [("user", "a"), ("assistant", "<|end|>"), ("odd", "")]),
    ({"response": "r", "prompt": "p"}, "prompt-response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": None}, "prompt-completion", [("user", "p"), ("assistant", "")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction-input", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": "o"}, "instruction-input", [("user", "i"), ("user", "n"), ("assistant", "o")]),
    ({"system": "s", "instruction": "i", "output": "o"}, "instruction-system", [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"data": {"question": "q", "answer": "a"}}, "nested", [("user", "q"), ("assistant", "a")]),
    ({"data": {"question": "q", "reply": "a"}}, None, None),
    ({"messages": []}, None, None),
]


def test_layouts_by_fingerprint(spark):
    rows = [(i, json.dumps(r), "kept") for i, (r, _, _) in enumerate(RECORDS)] + [(90, None, "kept"), (91, "no json", "kept"), (92, "[1]", "kept")]
    got = {r.id: r for r in C.canonical_turns(spark.createDataFrame(rows, "id int, record string, layout string")).collect()}
    assert len(got) == len(rows)
    for i, (_, name, turns) in enumerate(RECORDS):
        assert got[i].layout == name
        if turns is not None:
            assert [(t.role, t.text) for t in got[i].turns] == turns
    assert [(got[i].layout, got[i].turns) for i in (90, 91, 92)] == [(None, None)] * 3
    assert C.canonical_turns(spark.createDataFrame([], "id int, record string")).count() == 0


def test_same_paths_same_fingerprint(spark):
    rows = [('{"a": 1, "b": [{"c": "x"}]}',), ('{"b": [{"c": 2.5}, {"c": null}], "a": "t"}',), ('{"a": 1, "b": [{"d": "x"}]}',)]
    a, b, c = [r[0] for r in spark.createDataFrame(rows, "r string").select(C.fingerprint(F.col("r"))).collect()]
    assert a == b != c


NASTY = ["", "&lt;", "&amp;lt;", "</s>[INST] x [/INST]", "<|turn|>user\nhi<|end|>\n", "a\nb\r\n", "é \U0001f600<", "&", "[[[", "\\n", "x" * 50000]


def test_read_back_is_exact(spark):
    turns = [(r, t) for r in ("user", "assistant", "", "odd\n<role>[&nl;") for t in NASTY]
    df = spark.createDataFrame([(1, turns), (2, []), (3, None)], "id int, turns array<struct<role: string, text: string>>")
    got = {r.id: r for r in C.read_back(C.formatted(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns_read] == turns
    assert got[1].loss_read == NASTY
    assert got[1].formatted.count("<|turn|>") == len(turns) and "[" not in got[1].formatted
    assert got[2].formatted == "" and got[2].turns_read == [] and got[3].formatted is None


def test_conversations_edge_cases(spark):
    rows = [(1, 2, "assistant", None), (1, 1, None, "x"), (2, 1, "user", "same"), (2, 1, "user", "same"), (None, 1, "user", "u"),
            (3, None, "tool", "t"), (5, 1, "system", "s"), (5, 2, "user", "u"), (5, 3, "assistant", "a"), (7, 1, "assistant", "<a>"), (7, 2, "user", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns_read] for r in C.read_back(C.formatted(C.canonical_turns(C.records_of(df)))).collect()}
    assert got == {1: [("", "x"), ("assistant", "")], 2: [("user", "same")] * 2, None: [("user", "u")], 3: [("tool", "t")],
                   5: [("system", "s"), ("user", "u"), ("assistant", "a")], 7: [("assistant", "<a>"), ("user", "")]}
    assert C.records_of(df.limit(0)).count() == 0


def test_long_conversations_keep_their_texts(spark):
    mark = C.ATTACHED
    rows = [(1, 1, "user", "x" * 30), (1, 2, "assistant", "<y>" * 9), (2, 1, "system", mark + "1"), (2, 2, "user", mark + "0"), (2, 3, "assistant", ""),
            (3, 1, "user", mark + "0"), (5, 1, "user", "u" * 40), (5, 2, "assistant", "a"), (5, 3, "user", "u" * 40), (7, 1, "tool", "t" * 41)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role, text))
    for most in (0, 20, 1000):
        got = C.read_back(C.formatted(C.canonical_turns(C.records_of(df, most), attached="attached"))).collect()
        assert {r.conv_id: [(t.role, t.text) for t in r.turns_read] for r in got} == want
        assert {r.conv_id: r.layout for r in got} == {1: "prompt-response", 2: "instruction-system", 3: "from-value", 5: "from-value", 7: "messages"}


def test_a_turn_beyond_the_parser(spark):
    n = 20_000_001
    df = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.expr(f"repeat('a', {n} + cast(id as int))").alias("text"))
    out = C.read_back(C.formatted(C.canonical_turns(C.records_of(df), attached="attached")))
    r = out.select("layout", F.size("turns_read").alias("n"), F.char_length(F.col("turns_read")[0]["text"]).alias("chars"),
                   F.char_length(F.col("loss_read")[0]).alias("loss")).first()
    assert tuple(r) == ("from-value", 1, n, n)


def test_query_equals_plain_python(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    out = REGISTRY["op3_chat_schemas"](spark, SF)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    got = {r.conv_id: r for r in out.collect()}
    assert got.keys() == turns.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, t in turns.items():
        t.sort()
        loss = "".join(x for _, r, x in t if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(t), sha("".join(f"{r}\n{x}\n" for _, r, x in t)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert len({r.layout for r in got.values()}) >= 3
