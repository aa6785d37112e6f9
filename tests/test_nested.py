import json

import pytest

from lumenry.operators.nested import _parse_deep, flat_rows, flat_table, json_triples, object_rows, parse_json


def rows(spark, records):
    df = spark.createDataFrame(records, "id string, f string, path string, shape string")
    return {(r.record_id, r.path, r.parent, r.table) for r in object_rows(df, "id", ("f",)).collect()}


def test_paths_lone_objects_and_text(spark):
    records = [
        ("1", json.dumps({"a": [{"b": {"c": 1}}, "x", {"b": [{"c": 2}, {}]}]}), "", ""),
        ("2", json.dumps({"a": {"b": [{"c": 3}]}, "z": {"y": {}}}), "", ""),
        ("3", json.dumps({"a": json.dumps([{"b": json.dumps({"c": 4})}])}), "", ""),
        ("4", json.dumps(json.dumps([{"k": 1}, [{"k": 2}]])), "", ""),
        ("5", '{"a": [', "", ""), ("6", None, "", ""), ("7", "", "", ""), ("8", "NaN", "", ""), ("9", "[]", "", ""),
        ("1", json.dumps({"a": [{"b": {"c": 1}}, "x", {"b": [{"c": 2}, {}]}]}), "", ""),
    ]
    assert rows(spark, records) == {
        ("1", "a[0]", "", "a"), ("1", "a[0].b[0]", "a[0]", "a.b"), ("1", "a[2]", "", "a"), ("1", "a[2].b[0]", "a[2]", "a.b"), ("1", "a[2].b[1]", "a[2]", "a.b"),
        ("2", "a[0]", "", "a"), ("2", "a[0].b[0]", "a[0]", "a.b"),
        ("3", "a[0]", "", "a"), ("3", "a[0].b[0]", "a[0]", "a.b"),
        ("4", "[0]", "", ""), ("4", "[1][0]", "[1]", ""),
    }


def test_keys_with_dots_and_brackets(spark):
    got = rows(spark, [("1", json.dumps({"a.b": [{"c[]": [{}]}]}), "", ""), ("2", json.dumps({"a.b": {"c[]": {}}}), "", ""), ("3", json.dumps({"a": {"b": {}}}), "", "")])
    assert {(i, p) for i, p, *_ in got} == {("1", "a.b[0]"), ("1", "a.b[0].c[][0]"), ("2", "a.b[0]"), ("2", "a.b[0].c[][0]")}


def test_depth_and_empty_table(spark):
    deep = '{"a":[' * 20_000 + "{}" + "]}" * 20_000
    assert len(rows(spark, [("1", deep[: 6 * 300] + "{}" + "]}" * 300, "", "")])) == 300
    assert isinstance(parse_json(deep), dict)
    assert rows(spark, []) == set()


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, "x\\u00e9", true, false, null, {}, []]}', " [ ] ", '"x"', "[[[]]]"])
def test_deep_parser_agrees(text):
    norm = lambda v: json.loads(json.dumps(v), parse_float=str, parse_int=str)
    assert str(norm(_parse_deep(text))) == str(json.loads(text, parse_float=str, parse_int=str))


@pytest.mark.parametrize("text", ["", "{", '{"a"}', "[1,]", "[1 2]", '{"a":1,}', "nul", "1 2", "{'a':1}"])
def test_deep_parser_refuses(text):
    with pytest.raises(ValueError):
        _parse_deep(text)


def test_triples_pivot_to_a_table(spark):
    df = spark.createDataFrame([("1", json.dumps({"t": [{"n": "x", "d": ["p", "q"]}, {"n": None}]}))], "id string, f string")
    got = {tuple(r) for r in flat_table(json_triples(df, "id", ("f",)), "f", "t", ("n", "d")).collect()}
    assert got == {("1", "t[0]", "", "x", "p\nq"), ("1", "t[1]", "", "", None)}


def test_rows_of_every_chain_with_all_keys(spark):
    records = [
        ("1", json.dumps({"s": 5, "t": [{"n": "x", "o": {"k": "p", "c": [{"v": 1}]}}, {"n": None, "d": [["q"], "r"]}, {}], "h": {"u": True}})),
        ("2", json.dumps({"s": "6", "t": {"n": "y"}})),
        ("3", json.dumps([7, {"s": 8}])),
    ]
    df = spark.createDataFrame(records, "id string, f string")
    got = {(r.record_id, r.path): (r.table, r.parent, r.cells) for r in flat_rows(json_triples(df, "id", ("f",))).collect()}
    task = {"n": None, "o.k": None, "d": None}
    root = {"": None, "h.u": None, "s": None}
    assert got == {
        ("1", ""): ("", "", root | {"s": ["5"], "h.u": ["true"]}),
        ("1", "t[0]"): ("t", "", task | {"n": ["x"], "o.k": ["p"]}),
        ("1", "t[0].o.c[0]"): ("t.o.c", "t[0]", {"v": ["1"]}),
        ("1", "t[1]"): ("t", "", task | {"n": [None], "d": ["q", "r"]}),
        ("1", "t[2]"): ("t", "", task),
        ("2", ""): ("", "", root | {"s": ["6"]}),
        ("2", "t[0]"): ("t", "", task | {"n": ["y"]}),
        ("3", ""): ("", "", root | {"": ["7"]}),
        ("3", "[1]"): ("", "", root | {"s": ["8"]}),
    }
