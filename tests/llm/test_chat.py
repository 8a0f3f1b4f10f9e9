import hashlib
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from quire.llm import chat

OK = "</s>[INST] ok [/INST]"
MESSAGES = {"messages": [{"role": "system", "content": "S"}, {"role": "user", "content": OK}, {"role": "assistant", "content": OK}]}
RECORDS = [
    (1, json.dumps(MESSAGES)),
    (2, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a\\"}]})),
    (3, json.dumps({"prompt": "p", "response": "r", "system": "be brief"})),
    (4, json.dumps({"prompt": "p", "completion": "c"})),
    (5, json.dumps({"instruction": "do", "input": "it", "output": "done"})),
    (6, json.dumps({"instruction": "do", "output": ""})),
    (7, json.dumps({"question": "q?", "answer": "a!", "system": None})),
    (8, "{broken"), (9, None), (10, json.dumps({"unknown": 1})), (11, json.dumps([1])),
    (None, json.dumps({"prompt": "p", "response": "r"})),
]


def turns(spark, records):
    return chat.canonical_turns(spark.createDataFrame(records, "conv_id long, record string"))


def test_layouts(spark):
    got = {}
    for r in turns(spark, RECORDS).collect():
        got.setdefault(r.conv_id, []).append((r.layout, r.turn, r.role, r.text))
    assert [x[2:] for x in sorted(got[1])] == [("system", "S"), ("user", OK), ("assistant", OK)]
    assert sorted(got[2]) == [("from value", 0, "user", "q"), ("from value", 1, "assistant", "a\\")]
    assert [x[2:] for x in sorted(got[3])] == [("system", "be brief"), ("user", "p"), ("assistant", "r")]
    assert [x[2:] for x in sorted(got[5])] == [("user", "do\nit"), ("assistant", "done")]
    assert [x[2:] for x in sorted(got[6])] == [("user", "do"), ("assistant", "")]
    assert got[7][0][0] == "question answer" and len(got[7]) == 2
    assert [got[i][0][0] for i in (8, 9, 10, 11)] == [None] * 4
    assert {r.conv_id for r in chat.unmapped(turns(spark, RECORDS)).collect()} == {8, 9, 10, 11}


def test_fingerprint_ignores_order_nulls_and_list_length():
    a = {"messages": [{"role": "u", "content": "x"}] * 3, "conv_id": None}
    b = {"messages": [{"content": "y", "role": "v"}]}
    assert chat.fingerprint(chat.paths(a)) == chat.fingerprint(chat.paths(b))
    assert chat.fingerprint(chat.paths({"a": {"b": 1}})) != chat.fingerprint(chat.paths({"a.c": 1}))


def expected(rows):
    by = {}
    for c, n, role, text in rows:
        by.setdefault(c, []).append(((n is not None, n), role or "", text or ""))
    out = set()
    for c, v in by.items():
        v.sort(key=lambda x: (x[0][0], x[0][1] or 0, x[1] + "\n" + x[2]))
        all_, loss = "".join(f"{r}\n{t}\n" for _, r, t in v), "".join(t for _, r, t in v if r == "assistant")
        out.add((c, len(v), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def read_back(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS record", "2 AS layout")
    t = chat.canonical_turns(chat.rows_as_records(df)).where("layout is not null")
    s = chat.formatted(t)
    return {tuple(r)[:5] for r in chat.digests(s).collect()}, s


HARD = ["", None, "plain", OK, "\\", "\\\\", "\\[INST]", "\\\\</s>", "[[INST]INST]", "<</s>s>", "[ROLE:41] x [/ROLE]", " </s>", "a </s> b",
        "</s>\\", "é🌍 [/SYS]", "[ASST] x", "\n\r\t\u2028", "x" * 200_000, '"quote" {json}']


def test_reversible_rows(spark):
    rows = [(i % 7, i, role, t) for i, (role, t) in enumerate((r, t) for r in ("user", "assistant", "system", "tool [INST]", "", None) for t in HARD)]
    rows += [(None, 1, "user", "no id"), (None, None, "assistant", "no turn"), (3, 5, "user", "tie b"), (3, 5, "user", "tie a"), (3, 5, "user", "tie a")]
    got, s = read_back(spark, rows)
    assert got == expected(rows)
    whole = {r.conv_id: r for r in chat.assembled(s).collect()}
    assert len(whole) == 8 and "".join(whole[None].text) == "[ASST] no turn </s>[INST] no id [/INST]"
    assert whole[None].text[whole[None].loss[0].a:whole[None].loss[0].z] == "no turn"


def test_empty_table(spark):
    assert read_back(spark, [])[0] == set()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["\\", "[", "]", "/", "<", ">", "s", "INST", "</s>", "[INST]", "[/ROLE]", " ", "x"]), max_size=9), max_size=30))
def test_random_control_strings(spark, texts):
    rows = [(0, i, ("assistant", "user", "odd")[i % 3], "".join(t)) for i, t in enumerate(texts)]
    assert read_back(spark, rows)[0] == expected(rows)


def test_long_runs_of_backslashes(spark):
    import time
    texts = ["\\" * 5_000_000, "\\" * 5_000_000 + "</s>", ("\\" * 99 + "[INST]") * 2000, "</s>" * 3 + "\\</s>\\\\</s>"]
    rows = [(i, 1, "assistant", t) for i, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.time()
    got = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat.digests(chat.formatted(turns)).collect()}
    assert got == {i: (len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)}
    assert time.time() - began < 60
