"""Chat formatting: layouts by fingerprint, reversible marks, loss masks, reading back."""

import hashlib
import json
import random

import pytest

from forumloom.llm import chat

RECORDS = [
    {"id": 0, "messages": [{"role": "system", "content": "be kind"}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
    {"id": 1, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": None}]},
    {"id": 2, "instruction": "add", "input": "1 2", "output": "3"},
    {"id": 3, "instruction": "sing", "input": "", "output": "la"},
    {"id": 4, "instruction": "go"},
    {"id": 5, "prompt": "once", "completion": " upon"},
    {"id": 6, "prompt": "what", "response": "that", "system": "s"},
    {"id": 7, "question": "why", "answer": None},
    {"id": 8, "role": "user", "text": "turn"},
    {"id": 9, "messages": []},
    {"id": 10, "messages": [{"role": "user", "content": "x"}], "prompt": "y"},
    {"id": 11, "title": "no layout at all", "messages": None},
]
WANT = {
    0: ("messages", [("system", "be kind"), ("user", "hi"), ("assistant", "yo")]),
    1: ("shared", [("user", "q"), ("assistant", "a"), ("tool", "")]),
    2: ("instruction", [("user", "add\n\n1 2"), ("assistant", "3")]),
    3: ("instruction", [("user", "sing"), ("assistant", "la")]),
    4: ("instruction", [("user", "go")]),
    5: ("completion", [("user", "once"), ("assistant", " upon")]),
    6: ("response", [("system", "s"), ("user", "what"), ("assistant", "that")]),
    7: ("question", [("user", "why")]),
    8: ("turn", [("user", "turn")]),
    9: ("turn", [("", "")]),  # nothing of any layout: an empty turn row
    10: (None, []),  # fields of two layouts
    11: ("turn", [("", "")]),
}


def test_fingerprints_select_layouts(spark):
    lines = spark.createDataFrame([(json.dumps(r),) for r in RECORDS], "value string")
    schema = """id long, title string, messages array<struct<role:string,content:string>>, prompt string, completion string,
      conversations array<struct<`from`:string,value:string>>, instruction string, input string, output string, response string,
      system string, question string, answer string, role string, text string, layout string, position string"""
    from pyspark.sql import functions as F

    wide = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    found = {}
    for r in chat.canonical_turns(wide, ["id"]).orderBy("id", "position").collect():
        layout, turns = found.setdefault(r.id, (r.layout, []))
        if r.role is not None:
            turns.append((r.role, r.text))
    assert found == WANT
    narrow = chat.canonical_turns(wide.select("id", "messages"), ["id"]).where("id IN (0, 9)").collect()
    assert [(r.layout, r.role) for r in narrow if r.id == 0][0] == ("messages", "system")
    assert [(r.layout, r.role) for r in narrow if r.id == 9] == [(None, None)]  # an empty list has no paths


def test_unknown_schema_and_clashing_keep(spark):
    df = spark.createDataFrame([(1, "x")], "id long, other string")
    assert [tuple(r) for r in chat.canonical_turns(df, ["id"]).collect()] == [(1, None, None, None, None)]
    with pytest.raises(ValueError):
        chat.canonical_turns(df.withColumnRenamed("other", "role"), ["role"])


CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>", chat.JOINER, "<", "[", "/", "s>",
            " ", "\n", "é", "INST]", "|end|>", "SYS>>", "$1", "\\", "x" ]


def test_any_role_and_text_comes_back(spark):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice(CONTROLS) for _ in range(rng.randrange(9)))
    rows = [(i, rng.choice(["user", "assistant", "system", "", text()]), text()) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, role string, text string")
    pieces = {r.i: r for r in chat.render(df).collect()}
    whole = ""
    for i, role, said in rows:
        r = pieces[i]
        assert chat.parse(r.piece) == [(role, said)], (role, said, r.piece)
        assert [chat.unescape(r.piece[s.start : s.end]) for s in r.loss] == ([said] if role == "assistant" else [])
        whole += r.piece
    assert chat.parse(whole) == [(role, said) for _, role, said in rows]  # marks alone separate the turns


TURNS = [
    (1, 0, "user", "hi </s> there"), (1, 1, "assistant", "[INST] no [/INST]"), (1, 2, "assistant", "é" * 10), (1, None, "system", None),
    (2, 0, None, "no role"), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (3, 0, "assistant", "y" * 400_000), (3, 5, "user", None),
    (None, 0, "user", "lost"), (None, 1, "assistant", "found"), (4, 0, "critic\n", "hm"),
]


def brute(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        found[conv] = (len(own), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return found


def test_read_back_equals_brute_force(spark):
    schema = "conv_id long, turn long, role string, text string, piece string, loss string, layout string, position long"
    df = spark.createDataFrame([(*r, "p", "l", "y", 9) for r in TURNS], schema).repartition(3)
    formatted = chat.format_conversations(df)
    back = chat.read_back(formatted, "conv_id", ["turn", "position", "role", "piece"])
    found = {r.conv_id: tuple(r)[1:] for r in back.collect()}
    assert {k: v[:-1] for k, v in found.items()} == brute(TURNS)
    assert {k: v[-1] for k, v in found.items()} == {
        k: sum(len(r.piece) for r in formatted.collect() if r.conv_id == k) for k in found
    }
    assert chat.read_back(chat.format_conversations(df.limit(0)), "conv_id", ["turn"]).count() == 0
