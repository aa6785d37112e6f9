import datetime as dt

from pyspark.sql import functions as F

from lumenry.functions import html
from lumenry.operators import ingest


def test_links_and_page_choice(spark):
    rows = [("site.example", i, u, t) for i, (u, t) in enumerate([("https://site.example/", "home"), ("/about", "x"), ("https://SITE.example/about?x=1", " About  us "), ("https://site.example/about/", "again"), ("https://site.example/a/b", "deep"), ("https://other.example/about", "other"), ("https://site.example/logo.png", "l"), ("https://site.example/team", None), ("https://site.example/blog", "Blog"), ("ftp://site.example/x", "f"), (None, None)])]
    links = ingest.candidate_links(spark.createDataFrame(rows, "base_url string, pos int, url string, title string"))
    assert [(r.url, r.title) for r in links.orderBy("rank").collect()] == [("https://site.example/about", "About us"), ("https://site.example/team", "team"), ("https://site.example/blog", "Blog")]
    got = [(r.place, r.url, r.role) for r in ingest.chosen_pages(links, {"about": 40, "team": 30, "blog": -20}).orderBy("place").collect()]
    assert got == [(1, "https://site.example", "homepage"), (2, "https://site.example/about", "about"), (3, "https://site.example/team", "team")]


def test_source_text(spark):
    rows = [("s", 2, "k2", None, None, None, None, "<p>two</p><nav>n</nav>"), ("s", 1, "k1", "homepage", "T", "u", "captured", "<p>one</p>"), ("s", 3, "k1", "x", "x", "x", "captured", "<p>again</p>"), ("s", 4, "k4", "x", "x", "x", "failed", "<p>no</p>"), ("s", 5, "k5", "x", "x", "x", "ok", "")]
    df = spark.createDataFrame(rows, "site string, pos int, key string, role string, title string, url string, status string, html string")
    assert ingest.source_text(df, "site").first().text == "[页面 homepage | T | u]\none\n\n[页面 supporting | 未命名页面 | 未知地址]\ntwo"


def test_profiles_dates_recommendations(spark):
    old = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string")
    new = spark.createDataFrame([(1, " ", "n")], "id int, x string, y string")
    assert sorted(map(tuple, ingest.merged_profile(old, new, "id", ["x", "y"], False).collect())) == [(1, "a", "n"), (2, "c", "d")]
    assert sorted(map(tuple, ingest.merged_profile(old, new, "id", ["x", "y"], True).collect()), key=str) == [(1, None, "n"), (2, "c", "d")]
    assert spark.range(1).select(ingest.founded_on(F.lit("2020-05")), ingest.founded_on(F.lit("2020-05-07")), ingest.founded_on(F.lit("soon"))).first() == (dt.date(2020, 5, 1), dt.date(2020, 5, 7), None)
    page = spark.createDataFrame([("u", "<h2>x</h2>")], "u string, h string").select(html.page_signals(F.col("u"), F.col("h")).alias("s"))
    assert page.select(ingest.rule_recommendations(F.col("s"))).first()[0] == ["add structured data", "add a title", "add a description"]


def test_curated_order_and_markers(spark):
    articles = spark.createDataFrame([("a", "c1", 3), ("b", "c1", 1), ("z", "c1", 2)], "slug string, chapter string, at int")
    got = ingest.curated_order(articles, spark.createDataFrame([("c1", 0)], "chapter string, idx int"), spark.createDataFrame([("a", 0)], "slug string, idx int"))
    assert {r.slug: (r.article_index, r.previous, r.next) for r in got.collect()} == {"a": (0, None, "b"), "b": (999, "a", "z"), "z": (999, "b", None)}
    assert spark.range(1).select(ingest.without_chapter_links(F.lit("x\n 下一篇《y》\nz"))).first()[0] == "x\nz"
