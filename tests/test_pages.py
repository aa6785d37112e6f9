from pyspark.sql import functions as F

from lumenry.functions import html
from lumenry.functions.scores import weighted_score
from lumenry.functions.text import company_name
from lumenry.functions.urls import is_public_host, is_safe_link

GARDEN = """<html lang="fr"><head><title> Serres  du Val </title><meta name="Description" content="serres"><meta name="robots" content=" "><link rel="apple-touch-icon" href="/i.png"><meta property="og:image" content="x">
<script type="Application/LD+JSON">[{"@type": " WebSite "}, {"@graph": {"@type": ["Store", null, "Store"], "@graph": [{"@type": "FAQPage"}]}}, 5]</script><script type="application/ld+json">{"@type":</script></head>
<body><h1>Serres</h1><h3>Questions, FAQ</h3><p>Un<p>Deux <ol><li>x</ol><img alt=" "><img alt="v"><img alt="w"><button>Demo!</button>"""
LINKS = ["https://shop.val.example/a", "HTTPS://Doi.org/10", "http://en.wikipedia.org/x", "https://x.com/y", "/near", "mailto:a@b.c", "ftp://val.example", "https://other.example"]


def signals(spark, page, url="https://val.example/start"):
    df = spark.createDataFrame([(url, page)], "url string, html string")
    return df.select(html.page_signals(F.col("url"), F.col("html")).alias("s")).first().s


def test_one_page(spark):
    s = signals(spark, GARDEN)
    assert (s.found_types, s.schema_count, s.coverage_ratio, s.schema_score, s.has_faq, s.has_org) == (["WebSite", "Store", "FAQPage"], 2, 40, 48, True, True)
    assert s.missing_recommended == ["Organization", "Article", "BreadcrumbList"]
    assert s.meta_missing == ["canonical", "viewport", "robots", "og_title", "og_description", "og_type", "og_locale", "twitter_card"] and (s.title_length, s.description_length, s.meta_score, s.preview_score) == (13, 6, 38, 50)
    assert (s.h1_count, s.h2_count, s.h3_count, s.paragraph_count, s.list_count, s.image_count, s.image_with_alt_count, s.image_alt_ratio, s.faq_sections, s.cta_count, s.content_score) == (1, 0, 1, 2, 1, 3, 2, 67, 1, 1, 40)


def test_links(spark):
    s = signals(spark, "".join(f'<a href="{x}">t</a>' for x in LINKS) + "<a>none</a>")
    assert (s.internal_links, s.external_links, s.authority_link_count, s.social_link_count, s.citation_score) == (1, 4, 2, 1, 80)
    assert s.authority_links == LINKS[1:3] and s.social_links == [LINKS[3]]
    many = signals(spark, '<a href="https://a.example">x</a>' * 10)
    assert (many.external_links, many.citation_score) == (10, 60) and signals(spark, LINKS[0], None).external_links == 0


def test_empty_and_broken_pages(spark):
    for page in (None, "", "<<<", "<p><b>x</p></i>" * 50, "<div>" * 5000):
        s = signals(spark, page)
        assert s.image_alt_ratio == 100 and s.schema_score == 0


def test_weights(spark):
    names = ("schema", "content", "meta", "citation")
    default = {"schema": 0.3, "content": 0.3, "meta": 0.2, "citation": 0.2}
    score = lambda values, weights: spark.range(1).select(weighted_score({k: F.lit(v) for k, v in zip(names, values, strict=True)}, weights, default)).first()[0]
    # Two weighted scores that must come out.
    assert score((90, 60, 80, 50), {"schema": 0.5, "content": 0.2, "meta": 0.2, "citation": 0.1}) == 78 and score((100, 50, 50, 50), dict.fromkeys(names, 0)) == 65
    assert score((10, 20, 30, 40), {"schema": -5, "content": 1}) == 20


def test_cleaning(spark):
    page = '<dl class="k" onclick="e"><dt id="i" style="s">T</dt></dl><details><summary>S</summary></details><center><kbd>x</kbd></center><form><p>gone</p></form><a name="n">no</a><a href="/x" rel="me">y</a><img src="data:image/svg+xml;base64,AA" onload="z"><a href=" java script:1">j</a><td colspan="2" scope="row">c</td>'
    df = spark.createDataFrame([(page,)], "h string")
    assert df.select(html.sanitized(F.col("h"))).first()[0] == '<dl class="k"><dt id="i">T</dt></dl><details><summary>S</summary></details><kbd>x</kbd><a>no</a><a href="/x" rel="noopener noreferrer">y</a><img src="data:image/svg+xml;base64,AA"><a>j</a><td colspan="2">c</td>'
    cases = {"/a": (True, True), "mailto:x": (True, True), "ftp://a": (False, False), "HTTPS://a": (True, True), "data:image/png;base64,A": (False, True), "vbscript:x": (False, False), "": (False, False), "java\tscript:1": (False, False)}
    rows = spark.createDataFrame(list(cases), "string").select("value", is_safe_link(F.col("value"), "href"), is_safe_link(F.col("value"), "src")).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == cases and all((html._safe(k, "href"), html._safe(k, "src")) == v for k, v in cases.items())


def test_headings_summary_profile(spark):
    page = "<h2>A b</h2><h2>A b</h2><script>x</script><p>t<a>l</a></p><nav>menu</nav><meta name='keywords' content='k1, k2/k1 |'>"
    df = spark.createDataFrame([(page,)], "h string")
    r = df.select(html.headings(F.col("h")).alias("t"), html.article_summary(F.col("h")).alias("s"), html.visible_text(F.col("h")).alias("v"), html.profile_from_page(F.col("h")).alias("p")).first()
    assert [x.anchor for x in r.t] == ["a-b", "a-b-2"] and r.s == "t l" and r.v == "A b A b t l" and r.p.tags == ["k1", "k2"]


def test_names_and_hosts(spark):
    cases = {"首页 | Torvex 官网首页": "Torvex", "关于我们丨Kirdud": "Kirdud", "About us — Baldud - Shop": "Baldud", "X": "fall back", None: "fall back", "官网": "fall back", "A-B Torvex": "A-B Torvex", "Torvex·官方网站": "Torvex"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", company_name(F.col("t"), F.lit(" fall  back "))).collect()
    assert {r[0]: r[1] for r in rows} == cases
    hosts = {"a.example": True, "LOCALHOST.": False, "10.1.2.3": False, "8.8.8.8": True, "::1": False, "[fe80::1]": False, "x.internal": False, "": False, None: False}
    assert {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in hosts], "h string").select("h", is_public_host(F.col("h"))).collect()} == hosts


def test_whole_texts(spark, tmp_path):
    from lumenry.plans.analysis import chunks, document_windows

    df = spark.createDataFrame([("<p>" + "ab " * 6000 + "</p>",)], "h string")
    assert df.select(html.visible_text(F.col("h")).alias("v"), html.visible_text(F.col("h"), 8000).alias("c")).select(F.length("v"), F.length("c")).first()[:] == (17999, 8000)
    spark.createDataFrame([("d", "w " * 9000)], "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert document_windows(spark, str(tmp_path)).agg(F.count("digest"), F.max("chunk_index")).first()[:] == (26, 25) and chunks(spark, str(tmp_path)).count() == 20
