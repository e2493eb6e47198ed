"""Linked tool calls on hand-made conversations, generated ones against plain Python, and the whole table."""

import json
import random

from ledgerlens.llm import chat_format as C
from tests.conftest import DATA

SCHEMA = "conv_id bigint, turn bigint, role string, text string, status string"
TOOLS = {"tools": [{"name": "add", "parameters": {"required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "additionalProperties": False}}], "content": "Use tools."}


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def run(spark, rows):
    df = C.format_chats(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    return sorted([tuple(r) for r in df.collect()], key=repr)


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "system", json.dumps(TOOLS)),
        (1, 1, "tool", json.dumps({"tool_call_id": "c2", "content": {"z": 1, "a": [True, None]}})),  # logged before its call
        (1, 2, "assistant", call(("c1", "add", {"b": 2.5, "a": 1}), ("c2", "add", {"a": "1", "x": 0}), content="Adding.")),
        (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "3.5"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "c9", "content": "lost", "failed": True})),
        (1, 5, "assistant", call(("c1", "mul", {}), ("c3", "add", [1]))),
    ]
    got = {(r[1], r[2], r[3], r[4]): r[5:] for r in run(spark, rows)}
    assert list(sorted(got)) == [(0, -2, 0, 0), (0, -1, 0, 0), (2, -1, 0, 2), (2, 0, 1, 2), (2, 0, 2, 3), (2, 1, 1, 2), (2, 1, 2, 1), (4, -1, 2, 4), (5, -1, 0, 5), (5, 0, 1, 5), (5, 1, 1, 5)]
    assert got[0, -2, 0, 0] == ("tool_definition", None, "defined", [], '{"definition":' + canonical(TOOLS["tools"][0]) + ',"type":"tool_definition"}')
    assert got[0, -1, 0, 0] == ("message", None, None, [], '{"content":"Use tools.","role":"system"}')
    assert got[2, 0, 1, 2] == ("tool_call", "c1", "linked", [], '{"arguments":{"a":1,"b":2.5},"id":"c1","name":"add","type":"tool_call"}')
    assert got[2, 1, 1, 2][2:4] == ("linked", ["missing b", "type a", "unknown x"])
    assert got[2, 1, 2, 1] == ("tool_result", "c2", "linked", [], '{"content":{"a":[true,null],"z":1},"tool_call_id":"c2","type":"tool_result"}')
    assert got[2, 0, 2, 3][-1] == '{"content":"3.5","tool_call_id":"c1","type":"tool_result"}'
    assert got[4, -1, 2, 4][2] == "orphan" and got[4, -1, 2, 4][-1] == '{"content":"lost","extra":{"failed":true},"tool_call_id":"c9","type":"tool_result"}'
    assert got[5, 0, 1, 5][2:4] == ("repeated", ["undefined tool"]) and got[5, 1, 1, 5][2:4] == ("open", ["arguments are no object"])


def test_cases(spark):
    plain = ['{"b":1, "a":2}', '{"content":"hi","other":1}', '{"tools":5}', "{no json", 'q"\\\n é', "", "long " * 100_000, '{"tool_call_id":"c"}']
    rows = [(1, 0, "user", None), (1, 1, "user", ""), (1, 1, "user", ""), (None, None, None, "x"), (2, 0, "tool", "plain")]
    rows += [(3, k, "user", text) for k, text in enumerate(plain)]
    got = run(spark, rows)
    assert len(got) == len(rows) and all(r[5] == "message" for r in got)
    texts = {(r[0], r[4]): json.loads(r[-1])["content"] for r in got}
    assert texts[1, 0] is None and texts[1, 1] == "" and texts[2, 0] == "plain" and texts[None, None] == "x"
    assert [texts[3, k] for k in range(len(plain))] == plain
    assert C.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_odd_entries_stay(spark):
    twice = {"tools": [{"name": "t", "parameters": {"type": "object"}}, {"name": "t", "parameters": 3}, 7], "tool_calls": [7, {"id": "a", "name": "t", "arguments": {}}], "content": [1], "more": {"k": None}}
    got = run(spark, [(1, 0, "assistant", json.dumps(twice))] * 2 + [(None, 0, "assistant", json.dumps(twice))])
    assert len(got) == 3 * 6
    mine = sorted({(r[2], r[5], r[7], tuple(r[8])) for r in got if r[0] == 1}, key=repr)
    assert mine == sorted(
        [
            (-4, "tool_definition", "replaced", ()), (-3, "tool_definition", "defined", ("parameters are no object",)), (-2, "tool_definition", "defined", ("no name",)),
            (-1, "message", None, ()), (0, "tool_call", "open", ("no name",)), (1, "tool_call", "open", ()),
        ],
        key=repr,
    )
    assert '{"content":[1],"extra":{"more":{"k":null}},"role":"assistant"}' in {r[-1] for r in got}


# -- plain Python ----------------------------------------------------------------------------


def kind(v):
    if v is None or isinstance(v, bool):
        return "null" if v is None else "boolean"
    if isinstance(v, (int, float)):
        return "integer" if v == int(v) else "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def broken(rule, v, path=""):
    found, k = [], kind(v)
    number, same = k in ("integer", "number"), lambda a: canonical(a) == canonical(v) or (number and kind(a) in ("integer", "number") and a == v)
    types = rule.get("type", [k])
    types = types if isinstance(types, list) else [types]
    if k not in types and not (k == "integer" and "number" in types):
        found.append(f"type {path}")
    if "enum" in rule and not any(same(a) for a in rule["enum"]):
        found.append(f"enum {path}")
    if "const" in rule and not same(rule["const"]):
        found.append(f"const {path}")
    bounds = {"minimum": lambda x, y: x < y, "maximum": lambda x, y: x > y, "exclusiveMinimum": lambda x, y: x <= y, "exclusiveMaximum": lambda x, y: x >= y}
    found += [f"{b} {path}" for b, bad in bounds.items() if number and b in rule and bad(v, rule[b])]
    for least, most, of in (("minLength", "maxLength", "string"), ("minItems", "maxItems", "array")):
        if k == of:
            found += [f"{least} {path}"] * (len(v) < rule.get(least, 0)) + [f"{most} {path}"] * (len(v) > rule.get(most, 10**9))
    if k == "array":
        if rule.get("uniqueItems") and len({canonical(x) for x in v}) < len(v):
            found.append(f"uniqueItems {path}")
        for i, x in enumerate(v):
            found += broken(rule.get("items", {}), x, f"{path}[{i}]")
    if k == "object":
        at = lambda name: f"{path}.{name}" if path else name
        known, other = rule.get("properties", {}), rule.get("additionalProperties", {})
        found += [f"missing {at(x)}" for x in rule.get("required", []) if x not in v]
        for x in v:
            if x not in known and other is False:
                found.append(f"unknown {at(x)}")
            else:
                found += broken(known.get(x, other if isinstance(other, dict) else {}), v[x], at(x))
    return found


def some_rule(rng, depth):
    rule = {}
    if rng.random() < 0.7:
        rule["type"] = rng.choice(["integer", "number", "string", "array", "object", "boolean", ["string", "null"], ["object", "integer"]])
    for name, values in {"enum": [[1, "a", None], [[1], {"a": 1}]], "const": [1, "ab"], "minimum": [1], "maximum": [1.5], "exclusiveMinimum": [1], "exclusiveMaximum": [2], "minLength": [2], "maxLength": [1], "minItems": [1], "maxItems": [1], "uniqueItems": [True, False]}.items():
        if rng.random() < 0.12:
            rule[name] = rng.choice(values)
    if depth:
        if rng.random() < 0.7:
            rule["properties"] = {k: some_rule(rng, depth - 1) for k in rng.sample("abc", rng.randint(0, 3))}
        if rng.random() < 0.3:
            rule["required"] = rng.sample("abcd", rng.randint(0, 2))
        if rng.random() < 0.5:
            rule["additionalProperties"] = rng.choice([False, True, some_rule(rng, depth - 1)])
        if rng.random() < 0.6:
            rule["items"] = some_rule(rng, depth - 1)
    return rule


def some_value(rng, depth):
    pick = rng.random()
    if depth and pick < 0.35:
        return {k: some_value(rng, depth - 1) for k in rng.sample("abcd", rng.randint(0, 3))}
    if depth and pick < 0.6:
        return [some_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([0, 1, 2, 1.5, "", "a", "ab", "é😀", None, True, False])


def test_generated_schemas_against_plain_python(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(150):
        rules = [some_rule(rng, 3) for _ in range(3)]
        rows.append((conv, 0, "system", json.dumps({"tools": [{"name": f"t{i}", "parameters": r} for i, r in enumerate(rules)]})))
        for turn in range(1, 4):
            calls = []
            for i in range(3):
                value = {k: some_value(rng, 3) for k in rng.sample("abcd", rng.randint(0, 4))}
                calls.append((f"c{turn}-{i}", f"t{i}", value))
                want[conv, turn, i] = sorted({e.rstrip() for e in broken(rules[i], value)})
            rows.append((conv, turn, "assistant", call(*calls)))
    got = {(r[0], r[1], r[2]): r[8] for r in run(spark, rows) if r[5] == "tool_call"}
    assert got == want and sum(map(bool, want.values())) > 500 and sum(not e for e in want.values()) > 50
    assert {e.split(" ")[0] for errors in want.values() for e in errors} >= {"type", "enum", "const", "missing", "unknown", "minimum", "maxItems", "minLength"}


def test_whole_table_and_plan(spark):
    table = spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet")
    df = C.format_chats(table)
    got = sorted((r["conv_id"], r["turn"], r["json"]) for r in df.collect())
    want = sorted((r["conv_id"], r["turn"], json.dumps({"content": r["text"], "role": r["role"]}, ensure_ascii=False, separators=(",", ":"))) for r in table.collect())
    assert got == want
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_dialogues_keep_every_turn(spark):
    table = spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet")
    assert table.where("role = 'tool' OR ltrim(text) LIKE '{%'").isEmpty()  # the SQL of the plain query rests on it
    kinds = {(r["kind"], r["status"]): r["count"] for r in C.format_chats(C.tool_dialogues(table)).groupBy("kind", "status").count().collect()}
    turns = {r["role"]: r["count"] for r in table.groupBy("role").count().collect()}
    conversations = table.where("turn = 0").count()
    assert kinds["tool_definition", "defined"] == conversations and kinds["message", None] == table.count() + conversations
    assert kinds["tool_call", "linked"] + kinds["tool_call", "open"] == turns["assistant"]
    assert kinds["tool_result", "linked"] + kinds["tool_result", "orphan"] == turns["user"] and kinds["tool_result", "linked"] > 0
