"""Deeply nested JSON as related flat tables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stands in a raw path after a key that holds a lone object; no JSON text of ours uses it (private use).
LONE = "\ue000"
#: Joins the keys of a chain.
STEP = "\ue001"
#: A list position in a shape.
ITEM = "\ue002"
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_SPACE = re.compile(r"[ \t\n\r]*")


def _refuse(name: str) -> None:
    raise ValueError(name)


def _parse_deep(text: str) -> object:
    """JSON of any depth, without recursion; ValueError where it is not valid."""
    stack: list[tuple[object, str | None]] = []
    pos, end = _SPACE.match(text, 0).end(), len(text)

    def key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError("key")
        name, at = scanstring(text, at + 1)
        at = _SPACE.match(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError("colon")
        return name, _SPACE.match(text, at + 1).end()

    name: str | None = None
    while True:
        mark = text[pos : pos + 1]
        if mark in ("{", "["):
            box: object = {} if mark == "{" else []
            stack.append((box, name))
            pos = _SPACE.match(text, pos + 1).end()
            if text[pos : pos + 1] != ("}" if mark == "{" else "]"):
                name = None
                if mark == "{":
                    name, pos = key(pos)
                continue
            value, name = stack.pop()
            pos += 1
        elif mark == '"':
            value, pos = scanstring(text, pos + 1)
        elif m := _NUMBER.match(text, pos):
            value, pos = m.group(), m.end()
        else:
            for word, value in (("true", True), ("false", False), ("null", None)):
                if text.startswith(word, pos):
                    pos += len(word)
                    break
            else:
                raise ValueError("value")
        while stack:  # put the value into its container, and close what ends here
            pos = _SPACE.match(text, pos).end()
            box = stack[-1][0]
            if isinstance(box, dict):
                box[name] = value
            else:
                box.append(value)
            if text[pos : pos + 1] == ",":
                pos, name = _SPACE.match(text, pos + 1).end(), None
                if isinstance(box, dict):
                    name, pos = key(pos)
                break
            if text[pos : pos + 1] != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("end")
            value, name = stack.pop()
            pos += 1
        else:
            if _SPACE.match(text, pos).end() != end:
                raise ValueError("more")
            return value


def parse_json(text: str) -> object:
    """The value of a JSON text; ValueError where it is not valid (also for NaN and Infinity)."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _parse_deep(text)


def _unwrap(value: object) -> object:
    """What a text holds, if it is JSON of an object, a list or such a text again."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            inner = parse_json(value)
        except ValueError:
            return value
        if not isinstance(inner, (dict, list, str)):
            return value
        value = inner
    return value


_RESERVED = dict.fromkeys(map(ord, LONE + STEP + ITEM + "\0"))


def _clean(key: str) -> str:
    return key.encode("utf-8", "replace").decode("utf-8").translate(_RESERVED)


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return None if value is None else value.encode("utf-8", "replace").decode("utf-8").replace("\0", "")
    return json.dumps(value, ensure_ascii=False) if not isinstance(value, float) else repr(value)


def _scalars(values: list) -> Iterator[object]:
    """What lists hold at any depth that is neither object nor list, in order, without recursion."""
    todo = [iter(values)]
    while todo:
        for x in todo[-1]:
            x = _unwrap(x)
            if isinstance(x, list):
                todo.append(iter(x))
                break
            if not isinstance(x, dict):
                yield x
        else:
            todo.pop()


def _walk(root: object, on_object: Callable, on_list: Callable, on_value: Callable | None) -> None:
    """Visits a record without recursion.

    on_object(raw path, shape, chain) for each object, on_list(chain) for each list that holds
    objects, on_value(raw path, shape, chain, ordinal, key, value) for each member of an object that is
    neither object nor list, and for each such element of a list (of the object that holds the list;
    the key is '' where the record itself is a list).
    """
    todo: list[tuple[object, str, str, str, bool]] = [(root, "", "", "", False)]
    if on_value and isinstance(root, list):
        for i, x in enumerate(_scalars(root)):
            on_value("", "", "", i, "", x)
    while todo:
        node, path, shape, chain, element = todo.pop()
        if isinstance(node, dict):
            on_object(path, shape, chain)
            dot = "." if path else ""
            for ordinal, (key, value) in enumerate(node.items()):
                name, value = _clean(key), _unwrap(value)
                at, form, names = f"{path}{dot}{name}", f"{shape}{STEP if shape else ''}{name}", f"{chain}{STEP}{name}" if chain else name
                if isinstance(value, dict):
                    todo.append((value, at + LONE, form + LONE, names, False))
                elif isinstance(value, list):
                    todo.append((value, at, form, names, False))
                    if on_value:
                        for i, x in enumerate(_scalars(value)):
                            on_value(path, shape, chain, i, name, x)
                elif on_value:
                    on_value(path, shape, chain, ordinal, name, value)
        elif isinstance(node, list):
            some = False
            for i, value in enumerate(node):
                value = _unwrap(value)
                some |= isinstance(value, dict)
                if isinstance(value, (dict, list)):
                    todo.append((value, f"{path}[{i}]", shape + ITEM, chain, True))
            if some:
                on_list(chain)


def _chains(shape: str) -> list[str]:
    """The key chain at each lone object of a shape, outermost first."""
    parts = shape.replace(ITEM, "").split(LONE)
    return ["".join(parts[: i + 1]) for i in range(len(parts) - 1)]


def _batches(fields: Sequence[str], each: Callable) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield each(pdf, fields)

    return run


def _roots(pdf: pd.DataFrame, fields: Sequence[str]) -> Iterator[tuple[str, str, object]]:
    for field in fields:
        for record, text in zip(pdf["record_id"], pdf[field], strict=True):
            if text is not None:
                try:
                    root = _unwrap(parse_json(text))
                except ValueError:
                    continue
                if isinstance(root, (dict, list)):
                    yield field, record, root


def _patterns(pdf: pd.DataFrame, fields: Sequence[str]) -> pd.DataFrame:
    seen: set[tuple[str, str, str]] = set()
    for field, _, root in _roots(pdf, fields):
        _walk(root, lambda _p, shape, _c, f=field: seen.add((f, "shape", shape)) if LONE in shape else None, lambda chain, f=field: seen.add((f, "list", chain)), None)
    return pd.DataFrame(sorted(seen), columns=["field", "what", "pattern"])


def _triples(pdf: pd.DataFrame, fields: Sequence[str]) -> pd.DataFrame:
    rows: list[tuple] = []
    for field, record, root in _roots(pdf, fields):
        _walk(root, lambda path, shape, chain, f=field, r=record: rows.append((f, r, path, shape, chain, -1, None, None)), lambda chain: None, lambda path, shape, chain, i, key, value, f=field, r=record: rows.append((f, r, path, shape, chain, i, key, _text(value))))
    return pd.DataFrame(rows, columns=["field", "record_id", "raw", "shape", "chain", "ordinal", "key", "value"])


def _lone_flags(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, shape, flags): per lone object of a shape `[0]` where other records hold a list of objects there, else ''.

    Shapes and chains are distinct within a batch before they leave it, and follow the schema's
    variety, not the number of records; Spark broadcasts them only if they are small.
    """
    patterns = records.mapInPandas(_batches(fields, _patterns), "field string, what string, pattern string").distinct()
    @F.pandas_udf("array<string>")
    def chains(shape: pd.Series) -> pd.Series:
        return shape.map(_chains)

    at_chains = F.posexplode(F.when(F.col("what") == "shape", chains("pattern")).otherwise(F.array("pattern"))).alias("at", "chain")
    listed = F.max(F.col("what") == "list").over(Window.partitionBy("field", "chain"))
    flagged = patterns.select("field", "what", "pattern", at_chains).withColumn("flag", F.when(listed, "[0]").otherwise("")).where("what = 'shape'")
    return flagged.groupBy("field", F.col("pattern").alias("shape")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "flag"))), lambda x: x["flag"]).alias("flags"))


def _resolve(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds `path`, with `[0]` at lone objects that count as lists of one, and `is_row`: an element of a list."""
    out = rows.join(flags, ["field", "shape"], "left")
    parts = F.split("raw", LONE)
    marks = F.concat(F.coalesce(F.col("flags"), F.array().cast("array<string>")), F.array(F.lit("")))
    path = F.when(F.col("flags").isNull(), F.col("raw")).otherwise(F.array_join(F.zip_with(parts, marks, lambda p, m: F.concat(p, m)), ""))
    return out.withColumn("path", path).withColumn("is_row", F.when(F.col("raw").endswith("]"), True).otherwise(F.col("raw").endswith(LONE) & (F.element_at(F.coalesce("flags", F.array(F.lit(""))), -1) == "[0]")))


def _records(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("record_id"), *[F.col(c).cast("string").alias(c) for c in fields])


def object_rows(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """One row per JSON object that is an element of a list, at any depth: field, record_id, path, parent, table.

    path names keys joined by `.` with list positions from 0 in brackets. A lone object under a key
    chain that holds a list of objects in any record of the field counts as a list of one; text that
    holds JSON counts as what it holds; null, blank or invalid fields give no rows. parent is the
    path of the nearest enclosing list element ('' for the record), table the key chain. Repeated
    records give one row per object. Depth and length of a record are not limited.
    """
    found = json_triples(df, id_col, fields).where("is_row and ordinal = -1")
    return found.select("field", "record_id", "path", parent_path(F.col("path")).alias("parent"), "table").distinct()


def parent_path(path: Column) -> Column:
    """Path of the list element that encloses the element at `path`, '' for the record itself."""
    return F.regexp_extract(path, r"^(.*\])(?:\.[^\]]*)?\[\d+\]$", 1)


def json_triples(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """Path, key and value with their ordinal, for every object of the fields.

    Columns field, table (key chain), record_id, path (of the object that holds the value), ordinal,
    key, value, is_row (the object is an element of a list). Every object also gives one row with a
    null key and ordinal -1, so that empty objects stay. Repeated records give repeated triples;
    hand in one row per id.
    """
    records = _records(df, id_col, fields)
    rows = records.mapInPandas(_batches(fields, _triples), "field string, record_id string, raw string, shape string, chain string, ordinal int, key string, value string")
    out = _resolve(rows, _lone_flags(records, fields))
    return out.select("field", F.replace("chain", F.lit(STEP), F.lit(".")).alias("table"), "record_id", "path", "ordinal", "key", "value", "is_row")


def row_triples(triples: DataFrame) -> DataFrame:
    """The triples of the rows of the flat tables: field, table, record_id, path, ordinal, key, value.

    A row is an element of a list, or the record itself (path and table ''). A lone object that is
    no row lends its values to the row around it, under keys led by its own (`owner.name`).
    """
    own = F.when(F.col("is_row"), F.col("path")).otherwise(F.regexp_extract("path", r"^(.*\[\d+\])\.", 1))
    inner = F.when(F.length("own") == F.length("path"), "").otherwise(F.expr("substr(path, if(own = '', 1, length(own) + 2))"))
    table = F.when(F.col("inner") == "", F.col("table")).otherwise(F.expr("left(table, greatest(0, length(table) - length(inner) - 1))"))
    key = F.when(F.col("inner") == "", F.col("key")).otherwise(F.concat("inner", F.lit("."), F.col("key")))
    return triples.withColumn("own", own).withColumn("inner", inner).select("field", table.alias("table"), "record_id", F.col("own").alias("path"), "ordinal", key.alias("key"), "value")


def chain_keys(triples: DataFrame) -> DataFrame:
    """(field, table, keys): every key of each table, sorted; as few rows as the schema has chains."""
    return triples.select("field", "table", "key").distinct().groupBy("field", "table").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def flat_rows(triples: DataFrame) -> DataFrame:
    """The rows of the flat tables of all chains: field, table, record_id, path, parent, cells.

    cells maps every key of the table to its values in order: one for a scalar (null for a JSON
    null), all of them for a list of scalars, and null where the row lacks the key. All chains are
    pivoted in one pass.
    """
    rows = row_triples(triples)
    held = rows.groupBy("field", "table", "record_id", "path").agg(F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "ordinal", "value")))).alias("held"))
    values = lambda k: F.transform(F.filter("held", lambda x: x["key"] == k), lambda x: x["value"])
    cells = F.map_from_arrays("keys", F.transform("keys", lambda k: F.when(F.exists("held", lambda x: x["key"] == k), values(k))))
    return held.join(chain_keys(rows), ["field", "table"]).select("field", "table", "record_id", "path", parent_path(F.col("path")).alias("parent"), cells.alias("cells"))


def flat_table(triples: DataFrame, field: str, table: str, keys: Sequence[str]) -> DataFrame:
    """One flat table of a key chain: record_id, path, parent and a column per key.

    A key that holds a list of scalars gives its elements in order, joined by a line feed; an absent
    key gives null. The triples of one object are pivoted in one pass, without a list of values.
    """
    own = triples.where((F.col("field") == field) & (F.col("table") == table))
    cells = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == k, F.struct("ordinal", "value")))), lambda x: x["value"]), "\n").alias(f"c{i}") for i, k in enumerate(keys)]
    has = [F.count_if(F.col("key") == k).alias(f"_{i}") for i, k in enumerate(keys)]
    rows = own.groupBy("record_id", "path").agg(*cells, *has)
    return rows.select("record_id", "path", parent_path(F.col("path")).alias("parent"), *[F.when(F.col(f"_{i}") > 0, F.col(f"c{i}")).alias(k) for i, k in enumerate(keys)])
