import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from lumenry.operators import records as X
from lumenry.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_find_by_identifier(spark):
    df = spark.createDataFrame([("1", "abcde", "one"), ("2", "one", "two"), ("3", None, "two")], "id string, path string, slug string")
    asked = spark.createDataFrame([("ABCDE",), ("one",), ("two",), ("none",), (None,), ("two",)], "identifier string")
    assert rows(X.find_by_identifier(asked, df, {"path": F.col("path"), "slug": F.col("slug")})) == [("ABCDE", "1"), ("one", "2"), ("two", "2")]
    assert X.find_by_identifier(asked, df.limit(0), {"path": F.col("path")}).count() == 0


def test_json_lists(spark):
    cases = {'["a", " ", {"company_id": "b"}]': ["a", "b"], '{"items": [{"company_id": "c"}, {"x": 1}]}': ["c"], "[]": [], "{bad": [], "5": [], None: []}
    got = spark.createDataFrame([(k,) for k in cases], "j string").select("j", X.item_refs(F.col("j"))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_generated_items(spark):
    raw = '[{"kw": " Solar  roof ", "rec": 120, "biz": "x", "reason": "  "}, {"keyword": "Solar roof", "rec": 50}, {"keyword": "b2b lead"}, {"keyword": null}, {"keyword": "' + "k" * 100 + '", "recommendation_score": 10, "business_score": 77, "reason": "' + "r" * 200 + '"}]'
    df = spark.createDataFrame([("p", "d", "s", raw), ("p", "e", "s", "{bad"), ("p", "f", "s", None)], "pack string, dimension string, seed string, raw string")
    got = X.sanitized_items(df, ["b2b"]).orderBy("rank").collect()
    assert [(r.keyword, r.recommendation) for r in got] == [("Solar roof", 99), ("k" * 80, 35)] and 35 <= got[0].business <= 99 and got[1].business == 77 and got[0].reason is None and len(got[1].reason) == 120


def test_page_choice_and_pages(spark):
    links = spark.createDataFrame([("h", "h/a"), ("h", "h/b"), ("h", "h/c"), ("g", "g/a")], "base_url string, url string")
    choices = spark.createDataFrame([("h", 1, "h/b", "about"), ("h", 2, "h/b", "x"), ("h", 3, "evil", "team"), ("h", 4, "h/a", None), ("h", 5, "h/c", "faq"), ("g", 1, "none", "x")], "base_url string, at int, url string, role string")
    assert rows(X.checked_choice(choices, links)) == [("h", 1, "h", "homepage"), ("h", 2, "h/b", "about"), ("h", 3, "h/a", "supporting")]
    pages = spark.createDataFrame([([("homepage", "", "T", "u", "captured"), ("homepage", "k", "unknown", "https://x", "captured"), ("about", "k2", "--", "ftp://x", "captured"), ("about", "k3", "T", None, "failed")],), (None,)], "p array<struct<role:string,key:string,title:string,url:string,status:string>>")
    assert [r[0] for r in pages.select(X.homepage_key(F.col("p"), F.lit("raw"))).collect()] == ["k", "raw"] and [[x.key for x in r[0] or []] for r in pages.select(X.public_pages(F.col("p"))).collect()] == [["k"], []]


def test_text_of_json_and_redaction(spark):
    deep = '{"a": ["x", "", {"b": [1, 0, null, "y"]}], "c": 2.5}'
    df = spark.createDataFrame([(deep,), ("{bad",), (None,)], "j string")
    assert [r[0] for r in df.select(X.stringified(F.col("j"))).collect()] == ["x 1 y 2.5", "", ""]
    secret = spark.createDataFrame([('{"user": {"API-Key": "k", "list": [{"accessToken": {"a": 1}, "n": 1}]}}',), ("[1]",), ("bad",), (None,)], "j string")
    assert [r[0] for r in secret.select(X.redacted(F.col("j"))).collect()] == ['{"user": {"API-Key": "[REDACTED]", "list": [{"accessToken": "[REDACTED]", "n": 1}]}}', "[1]", None, None]


def test_settings_rotation_names(spark):
    df = spark.createDataFrame([("site", "x", True), ("smtp_password", "y", True), ("hidden", "z", False)], "key string, value string, is_public boolean")
    assert X.settings_map(df).first()[0] == {"site": "x"}
    one = spark.range(1).select(X.rotated(F.array(F.lit(1), F.lit(2), F.lit(3)), 4).alias("r"), X.rotated(F.array().cast("array<int>"), 2).alias("e"), X.name_uuid(F.lit("company:é:0")).alias("u")).first()
    assert (one.r, one.e) == ([2, 3, 1], []) and one.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "company:é:0"))


def test_graph(spark):
    node = "company_id string, name string, type string"
    old, new = spark.createDataFrame([("a", "x", "Person"), ("b", "y", "Person")], node), spark.createDataFrame([("a", "z", "Product"), ("a", "z", "Person"), ("a", "w", "Person")], node)
    merged = X.merge_nodes(old, new)
    assert rows(merged) == [("a", "w", "Person"), ("a", "z", "Person"), ("b", "y", "Person")]
    edges = spark.createDataFrame([("a", "w", "HAS_PRODUCT", "z"), ("a", "w", "HAS_PRODUCT", "gone")], "company_id string, src string, type string, dst string")
    assert X.merge_edges(edges, edges).count() == 2 and rows(X.graph_pattern(merged, edges)) == [("a", "w", "Person", "HAS_PRODUCT", "z", "Person")]


def test_ledger_and_deletes(spark):
    daily = spark.createDataFrame([("u", "d1", 5, 1)], "user string, day string, tokens long, requests long")
    events = spark.createDataFrame([("u", "d1", 7), ("v", "d1", 1), ("u", "d1", 1)], "user string, day string, tokens long")
    assert rows(X.accumulate(daily, events, ["user", "day"], "tokens")) == [("u", "d1", 13, 3), ("v", "d1", 1, 1)]
    t = {"votes": spark.createDataFrame([(1, "a"), (2, "b")], "n int, company string"), "messages": spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, report string")}
    out = X.without_records(t, spark.createDataFrame([("a",), ("a",)], "id string"), {"votes": "company"}, {"messages": "report"})
    assert rows(out["votes"]) == [(2, "b")] and rows(out["messages"]) == [(1, None), (2, None), (3, "b")]
    counts = spark.createDataFrame([("a", 1), ("b", None), ("c", 5)], "k string, upvotes int")
    assert rows(X.decremented(counts, spark.createDataFrame([("a",), ("a",), ("c",)], "k string"), "k", "upvotes")) == [("a", 0), ("b", 0), ("c", 4)]
    at = dt.datetime(2024, 1, 1)
    held = spark.createDataFrame([(1, "pending", at, 9), (2, "pending", at, None), (3, "pending", at + dt.timedelta(1), 5), (4, "settled", at, 5)], "id int, status string, expires_at timestamp_ntz, used int")
    assert rows(X.swept(held, F.lit(at).cast("timestamp_ntz"))) == [(1, "charged", 9), (2, "released", 0)]
    wallets = spark.createDataFrame([("a", 5, 1), ("b", 7, 2), ("c", 1, 3)], "k string, granted int, t int")
    groups = spark.createDataFrame([("a", "a"), ("b", "a")], "node string, component string")
    assert rows(X.merged_rows(wallets, groups, "k", ["granted"], "t")) == [("a", 12, 2, "b"), ("c", 1, 1, "c")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"slug": "a", "n": 1}, {"slug": "b"}]')
    (tmp_path / "log.jsonl").write_text('{"timestamp": "t", "level": "INFO", "event": "e", "context": {"k": 5}}\nnot json\n')
    assert rows(tables.read_json_list(spark, str(tmp_path / "list.json"), "slug string, n int")) == [("a", 1), ("b", None)]
    assert rows(tables.read_log(spark, str(tmp_path / "log.jsonl"))) == [("t", "INFO", "e", {"k": "5"})]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_json_list(spark, str(tmp_path / "bad.json"), "slug string").collect()
