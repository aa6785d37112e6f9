import pytest
from pyspark.sql import functions as F

from lumenry.functions import scores, text, urls


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("Example.COM/", "https://example.com"), ("http://A.example/x/?q=1#f", "http://a.example/x"), ("//b.example", "https://b.example"), ("ftp://c.example", None), ("https://u:p@d.example", None), ("localhost:80", None), ("http://127.0.0.1/", None), ("http://169.254.1.1", None), ("http://[::1]/", None), ("", None), (None, None), ("x y.example", None)])
def test_urls(spark, raw, want):
    assert one(spark, raw, urls.normalize_url) == want


@pytest.mark.parametrize(("host", "want"), [("example.com", True), ("10.0.0.1", False), ("8.8.8.8", True), ("::1", False), ("a.local", False), (None, False)])
def test_public_hosts(spark, host, want):
    assert one(spark, host, urls.is_public_host) is want


@pytest.mark.parametrize(("c", "n"), [(None, 0), ("", 0), ("a", 1), ("abcde", 2), ("你好", 2), ("你好abcd", 3), ("😀", 1)])
def test_token_estimate(spark, c, n):
    assert one(spark, c, text.token_estimate) == n


def test_text_expressions(spark):
    assert one(spark, "  a　 b ", text.clean_text) == "a b" and one(spark, " ", text.clean_text) is None
    assert one(spark, "C++ and c++ 你好世界 x", text.query_terms) == ["c++", "and", "你好世界"]
    assert one(spark, "Über Ünits! 2", text.slug) == "ber-nits-2" and one(spark, None, text.slug) == "page"
    assert one(spark, "a\n\n \n\nb  c", text.paragraphs) == ["a", "b c"]
    assert one(spark, ["b", " b", None, "", "c" * 50], lambda c: text.ordered_list(c, 8, 40), "array<string>") == ["b", "c" * 40]
    assert one(spark, "Acme Works | Home - x", lambda c: text.company_name(c, F.lit("f"))) == "Acme Works"
    assert one(spark, "首页", lambda c: text.company_name(c, F.lit(" f "))) == "f"
    assert one(spark, "N/A", text.without_placeholder) == "" and one(spark, None, text.without_placeholder) == ""
    assert one(spark, "```x```[ab](u)" + "c" * 640, lambda c: text.reading_minutes_markdown(c, F.lit(1))) == 2


def test_scores(spark):
    got = spark.range(1).select(scores.stable_score(F.lit("s"), F.lit("d"), F.lit("k"), 60, 28), scores.band(F.lit(85.0), ((85, "a"), (70, "b")), "c"), scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), scores.clamp_percent(F.lit("140")), scores.clamp_percent(F.lit("x"))).first()
    assert 35 <= got[0] <= 99 and got[1] == "a" and abs(got[2] - 0.5**0.5) < 1e-12 and got[3] == 100 and got[4] is None
    strong = dict(name=F.lit("brand watch"), category=F.lit("analytics"), tags=F.array(F.lit("brand")), blob=F.lit("brand watch analytics"), certified=F.lit(True), geo=F.lit(0.0))
    assert spark.range(1).select(scores.lexical_score(F.array(F.lit("brand")), **strong)).first()[0] == 34 + 20 + 5 + 2


def test_similar_organisations_meet_all_others(spark):
    from lumenry.plans.lists import similar_organisations

    row = lambda i, category, tags, ok, geo, text: (i, f"n{i}", category, tags, text, None, None, ok, geo, 0)
    rows = [row("a", "x", '["T", "u"]', True, 50.0, "solar"), row("b", "x", '["t"]', True, 45.0, ""), row("c", "y", '["t", "U", "u"]', False, None, ""), row("d", "", "[]", None, float("nan"), "solar"), row("e", None, None, None, 0.0, "")]
    df = spark.createDataFrame(rows, "id string, name string, category string, tags string, short_description string, description string, funding_stage string, is_geo_certified boolean, geo_score double, upvotes int")
    got = [tuple(r) for r in similar_organisations(df, F.col("id") == "a").orderBy("rank").collect()]
    assert got == [("a", 1, "b", 57.0), ("a", 2, "c", 28.0), ("a", 3, "d", 1.2)]
    assert similar_organisations(df, F.lit(True), 9).count() == 20
