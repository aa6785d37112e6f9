"""Text, page, search, vector, keyword, JSON and export queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenry.functions import html, scores, text, urls
from lumenry.functions.refs import ref_key
from lumenry.operators import ingest
from lumenry.operators import relational as R
from lumenry.operators.components import components
from lumenry.operators.keywords import expand_keywords, keyword_summary
from lumenry.operators.vectors import centroids, cosine_search
from lumenry.plans.lists import companies, distinct_rows
from lumenry.sources import writers
from lumenry.sources.tables import read_table

DEFAULT_WEIGHTS = {"schema": 0.3, "content": 0.3, "meta": 0.2, "citation": 0.2}
#: Search texts of the lexical queries.
SEARCHES = ("brand monitoring software", "analytics for a museum shop", "geo_agency structured_data")
#: (dimension, at, template, base of the recommendation score, of the business score) of the keyword queries.
TEMPLATES = tuple((dim, i, t, a, b) for dim, a, b, ts in (("semantic", 62, 54, ("{s}", "{s} tools", "{s} services", "managed {s}")), ("question", 59, 52, ("what is {s}", "how to start with {s}", "is {s} worth it")), ("review", 61, 63, ("{s} review", "{s} compared", "{s} in practice"))) for i, t in enumerate(ts))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Reviews as web pages: the title as heading, each line as a paragraph."""
    body = F.concat_ws("", F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))))
    page = F.concat(F.lit('<html lang="'), F.lower(F.coalesce("lang", F.lit(""))), F.lit('"><head><title>'), F.coalesce("title", F.lit("")), F.lit("</title></head><body><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1>"), body, F.lit("</body></html>"))
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://reviews.example/"), F.col("doc_id")).alias("url"), page.alias("html"))


def page_diagnostics(spark, d):
    """All four checks and the weighted score of each page, from one parse."""
    s = pages(spark, d).select("page_id", html.page_signals(F.col("url"), F.col("html")).alias("s"))
    overall = scores.weighted_score({k: F.col(f"s.{k}_score") for k in DEFAULT_WEIGHTS}, DEFAULT_WEIGHTS, DEFAULT_WEIGHTS)
    return s.select("page_id", "s.schema_score", "s.meta_score", "s.content_score", "s.citation_score", "s.paragraph_count", "s.character_count", "s.reading_minutes", overall.alias("overall"))


def page_tag_counts(spark, d):
    """Elements per page by counting tags, without a parse."""
    count = lambda tag: F.regexp_count("html", F.lit(f"<{tag}[ >]")).alias(f"{tag}_count")
    return pages(spark, d).select("page_id", *[count(t) for t in ("h1", "h2", "p", "a", "img")])


def page_visible_text(spark, d):
    return pages(spark, d).select("page_id", F.length(html.visible_text(F.col("html"))).alias("n_chars"))


def report_overall(spark, d):
    """The weighted score of each report from the scores of its parts; a missing part counts 0."""
    part = lambda c: F.coalesce(scores.clamp_percent(F.get_json_object(c, "$.score")), F.lit(0))
    rows = distinct_rows(spark, d, "diagnostic_reports", "schema_analysis", "content_analysis").where("schema_analysis is not null and content_analysis is not null")
    return rows.select("id", scores.weighted_score({"schema": part("schema_analysis"), "content": part("content_analysis")}, {"schema": 3, "content": 1}, DEFAULT_WEIGHTS).alias("overall"))


def text_measures(spark, d):
    """Estimated tokens and the three reading times of each review."""
    rows = read_table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.reading_minutes_floor(F.col("text")).alias("minutes_floor"), text.reading_minutes_round(F.length(F.regexp_replace("text", "[ \t\n\r]", ""))).alias("minutes_round"))


def search_terms(spark, d):
    rows = companies(spark, d, "description").where("description is not null")
    return rows.select("id", F.array_join(F.array_sort(text.query_terms(F.col("description"))), "|").alias("terms"))


def slugs(spark, d):
    return companies(spark, d, "name").select("id", text.slug(F.col("name")).alias("slug"))


def normalized_urls(spark, d):
    rows = companies(spark, d, "url").withColumn("u", urls.normalize_url(F.col("url")))
    return rows.select("id", F.col("u").alias("url"), urls.path_depth(urls.url_path(F.col("u"))).alias("depth"), urls.page_role(F.coalesce("u", F.lit("")), F.lit("")).alias("role"))


def firm_titles(spark, d):
    return read_table(spark, d, "documents").select("doc_id", text.company_name(F.col("title"), F.col("item_name")).alias("name"))


def profile_labels(spark, d):
    rows = companies(spark, d, "headquarters", "short_description", "description", "founded_date")
    return rows.select("id", text.without_placeholder(F.col("headquarters")).alias("place"), text.pick_first(F.col("short_description"), F.col("description"), limit=40).alias("teaser"), F.date_format("founded_date", "yyyy/MM").alias("founded"))


def stable_scores(spark, d):
    tags = companies(spark, d, "tags").select(F.explode(R.string_list(F.col("tags"))).alias("tag")).distinct()
    return tags.select("tag", scores.stable_score(F.col("tag"), F.lit("semantic"), F.col("tag"), 62, 28).alias("score"))


def keyword_packs(spark, d):
    return expand_keywords(_seeds(spark, d), spark.createDataFrame(TEMPLATES, "dimension string, at int, template string, recommend_base int, business_base int"), ["managed"])


def _seeds(spark, d):
    tags = companies(spark, d, "category", "tags").select(F.coalesce("category", F.lit("")).alias("pack"), F.explode(R.string_list(F.col("tags"))).alias("seed")).distinct()
    return tags.withColumn("pos", F.row_number().over(Window.partitionBy("pack").orderBy("seed"))).where("pos <= 8")


def keyword_pack_summary(spark, d):
    return keyword_summary(keyword_packs(spark, d))


def document_windows(spark, d, most: int | None = None):
    """Windows of 400 words, 50 of them shared, of whole texts or at most `most` of each."""
    rows = read_table(spark, d, "documents").select("doc_id", F.posexplode(text_windows("text")).alias("chunk_index", "text"))
    kept = rows if most is None else rows.where(F.col("chunk_index") < most)
    return kept.select("doc_id", "chunk_index", F.md5("text").alias("digest"))


def chunks(spark, d):
    """The windows of a text that are indexed, at most 20 as its SQL has it; document_windows has all."""
    return document_windows(spark, d, 20)


def text_windows(column: str):
    return R.word_windows(F.col(column))


def lexical_recommend(spark, d):
    """The five organisations that match each search text best; 1 + 3 fields of scores, ties by score, votes and id."""
    asked = F.array(*[F.struct(F.lit(q).alias("query"), text.query_terms(F.lit(q)).alias("terms")) for q in SEARCHES])
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    rows = companies(spark, d, "publish_status", "name", "category", "tags", "short_description", "description", "funding_stage", "is_geo_certified", "geo_score", "upvotes").where("publish_status = 'published'").withColumn("tag_list", F.transform(R.string_list(F.col("tags")), F.lower))
    blob = F.concat_ws(" ", low("name"), low("category"), F.array_join("tag_list", " "), low("short_description"), low("description"), low("funding_stage"))
    asked_rows = rows.withColumn("blob", blob).select("id", "name", "category", "tag_list", "blob", "is_geo_certified", "geo_score", "upvotes", F.inline(asked))
    scored = asked_rows.withColumn("score", F.round(scores.lexical_score(F.col("terms"), low("name"), low("category"), F.col("tag_list"), F.col("blob"), F.col("is_geo_certified"), F.col("geo_score")), 6))
    return R.top_per_group(scored, ["query"], [F.desc("score"), F.desc(F.coalesce("geo_score", F.lit(0.0))), F.desc(F.coalesce("upvotes", F.lit(0))), F.col("id")], 5).select("query", "rank", "id", "score")


def cosine_top(spark, d):
    """The five nearest vectors of every hundredth vector, among all."""
    rows = read_table(spark, d, "embeddings")
    return cosine_search(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 5).select("query", "item", F.round("similarity", 6).alias("similarity"), "rank")


def label_centroids(spark, d):
    rows = centroids(read_table(spark, d, "embeddings"), "label", "embedding")
    return rows.select("label", F.size("centroid").alias("width"), F.round(F.sqrt(scores.dot(F.col("centroid"), F.col("centroid"))), 6).alias("norm"))


def backfilled_neighbours(spark, d):
    """For every hundredth vector three items: the two nearest, then those of its label with the least keys."""
    rows = read_table(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0")
    near = cosine_search(asked, rows, "vec_id", "embedding", 2).select("query", "item", F.col("rank").cast("long").alias("o"))
    label = R.top_per_group(rows.select("label", "vec_id"), ["label"], [F.col("vec_id")], 6).select("label", F.col("vec_id").alias("item"))
    same = asked.select(F.col("vec_id").alias("query"), "label").join(label, "label").where("query <> item").select("query", "item", F.col("item").alias("o"))
    return R.backfill(near, same, ["query"], "item", "o", 3)


def structured_data(spark, d):
    """JSON-LD of each organisation, safe inside a script element."""
    node = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Organization").alias("@type"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("url", F.lit("")).alias("url"))
    return companies(spark, d, "name", "url").select("id", writers.script_safe(F.to_json(node)).alias("jsonld"))


def csv_rows(spark, d):
    rows = companies(spark, d, "name", "category", "upvotes")
    return rows.select("id", writers.csv_line([F.col("name"), F.col("category"), F.col("upvotes")]).alias("line"))


def report_markdown(spark, d):
    rows = distinct_rows(spark, d, "diagnostic_reports", "url", "status", "recommendations").where("recommendations is not null")
    strengths = F.from_json(F.get_json_object("recommendations", "$.gaps"), "array<string>")
    return rows.select("id", F.md5(writers.markdown_report(F.col("url"), {"status": F.col("status")}, {"Gaps": F.filter(strengths, lambda x: x.isNotNull())})).alias("digest"))


def outermost_json(spark, d):
    """The outermost JSON object in a message, if it is valid."""
    rows = distinct_rows(spark, d, "messages", "content").select("id", F.nullif(F.regexp_extract("content", r"(?s)(\{.*\})", 1), F.lit("")).alias("j")).where("j is not null")
    return rows.select("id", F.try_parse_json("j").isNotNull().alias("valid"))


def geo_dimensions(spark, d):
    """The four scores of each organisation as whole numbers in 0..100, with the strongest and weakest."""
    dims = ("schema", "content", "meta", "citation")
    rows = companies(spark, d, "geo_details").where(F.try_parse_json("geo_details").isNotNull()).select("id", *[scores.clamp_percent(F.get_json_object("geo_details", f"$.{k}")).alias(k) for k in dims])
    each = F.filter(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("v"), F.lit(-i).alias("o"), F.lit(k).alias("k"))) for i, k in enumerate(dims)]), lambda x: x.isNotNull())
    low = F.filter(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("v"), F.lit(i).alias("o"), F.lit(k).alias("k"))) for i, k in enumerate(dims)]), lambda x: x.isNotNull())
    return rows.select("id", *dims, F.array_max(each)["k"].alias("strongest"), F.array_min(low)["k"].alias("weakest"))


def order_chain_roots(spark, d):
    """The first order of each order's chain of predecessors, by doubling pointers."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return R.follow_pointers(read_table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before")), "o_orderkey", "before")


def order_components(spark, d):
    """Orders linked to their predecessors, as connected components."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.lag("o_orderkey").over(w).alias("b"))
    return components(edges)


def user_groups(spark, d):
    """Users of reports about the same organisation, as connected components."""
    rows = distinct_rows(spark, d, "diagnostic_reports", "user_id", "company_id").select(F.concat(F.lit("u:"), F.col("user_id")).alias("a"), F.concat(F.lit("c:"), ref_key(F.col("company_id"))).alias("b"))
    return components(rows).where("node like 'u:%'").select(F.expr("substring(node, 3)").alias("user_id"), "component")


# Words that raise or lower the rank of a page in the page choice.
PAGE_WEIGHTS = {
    "about": 90, "about-us": 90, "company": 84, "team": 80, "leadership": 72, "founders": 68, "story": 64, "mission": 60, "platform": 58, "product": 56, "products": 56, "solution": 52, "solutions": 52, "technology": 48, "ai": 44, "overview": 42,
    "login": -120, "signin": -120, "sign-in": -120, "signup": -120, "sign-up": -120, "register": -120, "privacy": -70, "terms": -70, "cookie": -70, "careers": -20, "career": -20, "blog": -18, "news": -14, "press": -12, "docs": -18,
}


def _anchors(spark, d):
    """Links between an organisation's home page and the pages its details name."""
    named = F.from_json(F.get_json_object("geo_details", "$.pages"), "array<struct<url:string,title:string>>")
    return companies(spark, d, "geo_details", "url").where("geo_details is not null").select(F.col("url").alias("base_url"), F.posexplode(named).alias("pos", "p")).select("base_url", "pos", "p.url", "p.title")


def site_links(spark, d):
    return ingest.candidate_links(_anchors(spark, d))


def site_pages(spark, d):
    return ingest.chosen_pages(ingest.candidate_links(_anchors(spark, d)), PAGE_WEIGHTS)


def page_recommendations(spark, d):
    rows = pages(spark, d).select("page_id", html.page_signals(F.col("url"), F.col("html")).alias("s"))
    return rows.select("page_id", F.array_join(ingest.rule_recommendations(F.col("s")), "; ").alias("first_steps"))


QUERIES = {f.__name__: f for f in (
    page_diagnostics, page_tag_counts, page_visible_text, report_overall, text_measures, search_terms, slugs, normalized_urls, firm_titles, profile_labels, stable_scores, keyword_packs, keyword_pack_summary, document_windows, chunks, lexical_recommend, cosine_top, label_centroids, backfilled_neighbours,
    structured_data, csv_rows, report_markdown, outermost_json, geo_dimensions, order_chain_roots, order_components, user_groups, site_links, site_pages, page_recommendations,
)}

_C = "(SELECT * FROM companies QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)"
_D = lambda t: f"(SELECT DISTINCT * FROM {t})"
_T = "(CASE WHEN json_valid(tags) AND json_type(tags) = 'ARRAY' THEN from_json(tags, '[\"VARCHAR\"]') ELSE [] END)"
_WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_SCORE = lambda seed, dim, kw, base, spread: f"greatest(35, least(99, {base} + (('0x' || substr(md5({seed} || '|' || {dim} || '|' || {kw}), 1, 8))::bigint % {spread})))::int"
_NUM = lambda c, p: f"(CASE WHEN try_cast(json_extract_string({c}, '$.{p}') AS double) IS NOT NULL THEN greatest(0, least(100, round_even(try_cast(json_extract_string({c}, '$.{p}') AS double), 0)))::int END)"
_VALUES = ", ".join(f"('{d}', {i}, '{t}', {a}, {b})" for d, i, t, a, b in TEMPLATES)
_PACKS = f"""
WITH seeds AS (SELECT pack, seed, row_number() OVER (PARTITION BY pack ORDER BY seed) AS pos FROM (SELECT DISTINCT coalesce(category, '') AS pack, unnest({_T}) AS seed FROM {_C}) QUALIFY pos <= 8),
made AS (SELECT pack, dim, pos, at_, seed, rb, bb, trim(replace(tpl, '{{s}}', seed)) AS keyword FROM seeds, (VALUES {_VALUES}) t(dim, at_, tpl, rb, bb)),
once AS (SELECT * FROM made WHERE NOT contains(lower(keyword), 'managed') QUALIFY row_number() OVER (PARTITION BY pack, dim, keyword ORDER BY pos, at_) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pack, dim ORDER BY pos, at_) AS rank FROM once QUALIFY rank <= 10),
packs AS (SELECT pack, dim AS dimension, rank::int AS rank, keyword, {_SCORE("seed", "dim", "keyword", "rb", 28)} AS recommendation, {_SCORE("seed", "dim || '-biz'", "keyword", "bb", 26)} AS business FROM ranked)
"""
_SIM = "WITH s AS (SELECT q.vec_id AS query, c.vec_id AS item, list_cosine_similarity(q.embedding::double[], c.embedding::double[]) AS sim FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 12) DESC, item) AS rank FROM s)"
_PREV = "SELECT o_orderkey AS node, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS root FROM orders"
_LIT = lambda q: "['" + "', '".join(w for w in q.replace("_", " ").split() if len(w) > 1) + "']"

SQL = {
    "page_tag_counts": "SELECT doc_id AS page_id, (1 + 0)::int AS h1_count, len(regexp_extract_all(x, '<h2[ >]'))::int AS h2_count, len(regexp_extract_all(x, '<p[ >]'))::int AS p_count, len(regexp_extract_all(x, '<a[ >]'))::int AS a_count, len(regexp_extract_all(x, '<img[ >]'))::int AS img_count FROM (SELECT doc_id, coalesce(title, '') || list_aggregate(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, ' ') <> ''), lambda l: '<p>' || l || '</p>') || [''], 'string_agg', '') AS x FROM documents)",
    "report_overall": f"SELECT id, round_even(0.75 * coalesce({_NUM('schema_analysis', 'score')}, 0) + 0.25 * coalesce({_NUM('content_analysis', 'score')}, 0), 0)::int AS overall FROM (SELECT id, CASE WHEN json_valid(schema_analysis) THEN schema_analysis END AS schema_analysis, CASE WHEN json_valid(content_analysis) THEN content_analysis END AS content_analysis FROM {_D('diagnostic_reports')} WHERE schema_analysis IS NOT NULL AND content_analysis IS NOT NULL)",
    "text_measures": "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, w + ceil((length(text) - w) / 4))::int END AS tokens, greatest(1, length(text) // 400)::int AS minutes_floor, greatest(1, round_even(greatest(length(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')), 1) / 450, 0))::int AS minutes_round FROM (SELECT doc_id, text, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS w FROM documents WHERE text IS NOT NULL)",
    "search_terms": f"SELECT id, coalesce(list_aggregate(list_sort(list_distinct(regexp_extract_all(lower(description), '[a-z0-9][a-z0-9#+.\\-]+') || regexp_extract_all(description, '[\\x{{4e00}}-\\x{{9fff}}]{{2,8}}'))), 'string_agg', '|'), '') AS terms FROM {_C} WHERE description IS NOT NULL",
    "slugs": f"SELECT id, coalesce(nullif(substring(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), ''), 'page') AS slug FROM {_C}",
    "stable_scores": f"SELECT tag, {_SCORE('tag', chr(39) + 'semantic' + chr(39), 'tag', 62, 28)} AS score FROM (SELECT DISTINCT unnest({_T}) AS tag FROM {_C})",
    "keyword_packs": _PACKS + "SELECT * FROM packs",
    "keyword_pack_summary": _PACKS + "SELECT pack, count(*) AS total, round_even(avg(recommendation), 0)::int AS mean_recommendation, round_even(avg(business), 0)::int AS mean_business, round_even(count(*) FILTER (recommendation >= 80) * 100.0 / count(*), 0)::int AS high_recommendation, round_even(count(*) FILTER (business >= 80) * 100.0 / count(*), 0)::int AS high_business FROM packs GROUP BY pack",
    "chunks": f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> '') AS ws FROM documents), i AS (SELECT doc_id, ws, unnest(range(0, len(ws), 350)) AS s FROM w) SELECT doc_id, (s // 350)::int AS chunk_index, md5(list_aggregate(ws[s + 1 : s + 400], 'string_agg', ' ')) AS digest FROM i WHERE s // 350 < 20",
    "lexical_recommend": "WITH c AS (SELECT id, lower(coalesce(name, '')) AS name, lower(coalesce(category, '')) AS category, list_transform(" + _T + ", lambda x: lower(x)) AS tags, lower(coalesce(short_description, '')) AS sd, lower(coalesce(description, '')) AS de, lower(coalesce(funding_stage, '')) AS fs, is_geo_certified, geo_score, upvotes FROM " + _C + " WHERE publish_status = 'published'), b AS (SELECT *, concat_ws(' ', name, category, coalesce(list_aggregate(tags, 'string_agg', ' '), ''), sd, de, fs) AS blob FROM c), q AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {_LIT(s)})" for s in SEARCHES) + ") v(query, terms)), t AS (SELECT query, b.*, unnest(terms) AS term FROM q, b), g AS (SELECT query, id, any_value(geo_score) AS geo, any_value(upvotes) AS up, any_value(is_geo_certified) AS cert, sum(CASE WHEN term = name THEN 60 WHEN contains(name, term) THEN 34 ELSE 0 END + CASE WHEN term = category THEN 26 WHEN contains(category, term) THEN 18 ELSE 0 END + coalesce(list_sum(list_transform(tags, lambda x: CASE WHEN x = term THEN 20 WHEN contains(x, term) OR contains(term, x) THEN 12 ELSE 0 END)), 0) + CASE WHEN contains(blob, term) THEN 5 ELSE 0 END) AS s FROM t GROUP BY query, id), f AS (SELECT query, id, geo, up, round(s + CASE WHEN cert THEN 2 ELSE 0 END + CASE WHEN geo IS NOT NULL AND geo <> 0 THEN least(geo / 25.0, 4.0) ELSE 0 END, 6)::double AS score FROM g) SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, coalesce(geo, 0) DESC, coalesce(up, 0) DESC, id) AS rank, id, score FROM f QUALIFY rank <= 5",
    "cosine_top": _SIM + " SELECT query, item, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 5",
    "label_centroids": "WITH e AS (SELECT label, unnest(embedding::double[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL) SELECT label, count(*)::int AS width, round(sqrt(sum(x * x)), 6) AS norm FROM m GROUP BY label",
    "backfilled_neighbours": _SIM + ", l AS (SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 6), a AS (SELECT query, item, 0 AS source, rank AS o FROM r WHERE rank <= 2 UNION ALL SELECT q.vec_id, l.vec_id, 1, l.vec_id FROM embeddings q JOIN l ON l.label = q.label AND l.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0), o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query, item ORDER BY source, o) = 1) SELECT query, item, source, row_number() OVER (PARTITION BY query ORDER BY source, o, item) AS rank FROM o QUALIFY rank <= 3",
    "structured_data": f"SELECT id, replace(replace(replace(json_object('@context', 'https://schema.org', '@type', 'Organization', 'name', coalesce(name, ''), 'url', coalesce(url, ''))::varchar, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS jsonld FROM {_C}",
    "csv_rows": "SELECT id, " + " || ',' || ".join(f"'\"' || replace(coalesce({c}::varchar, ''), '\"', '\"\"') || '\"'" for c in ("name", "category", "upvotes")) + f" AS line FROM {_C}",
    "order_chain_roots": _PREV,
    "order_components": "SELECT node, min(node) OVER (PARTITION BY c) AS component FROM (SELECT o_orderkey AS node, o_custkey AS c, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1",
    "geo_dimensions": "WITH g AS (SELECT id, " + ", ".join(f"{_NUM('geo_details', k)} AS {chr(34)}{k}{chr(34)}" for k in ("schema", "content", "meta", "citation")) + f" FROM {_C} WHERE json_valid(geo_details)), l AS (SELECT *, list_filter([{{'v': \"schema\", 'i': 0, 'k': 'schema'}}, {{'v': content, 'i': 1, 'k': 'content'}}, {{'v': meta, 'i': 2, 'k': 'meta'}}, {{'v': citation, 'i': 3, 'k': 'citation'}}], lambda x: x.v IS NOT NULL) AS d FROM g) SELECT id, \"schema\", content, meta, citation, list_sort(list_transform(d, lambda x: {{'v': -x.v, 'i': x.i, 'k': x.k}}))[1].k AS strongest, list_sort(d)[1].k AS weakest FROM l",
}

_FOLD = lambda c: f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'), ' ')"
_HOLES = ", ".join(f"'{x}'" for x in text.PLACEHOLDERS)
_PRIVATE = r"^(0|10|127)(\.\d{1,3}){3}$|^(169\.254|192\.168|172\.(1[6-9]|2\d|3[01])|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7]))(\.\d{1,3}){2}$|^(22[4-9]|23\d|24\d|25[0-5])(\.\d{1,3}){3}$|\.(localhost|local|internal)$|^localhost$|^localhost\.localdomain$"
_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(lower(u), '{'|'.join(words)}') THEN '{name}'" for name, words in urls.ROLES) + " ELSE 'supporting' END"
SQL |= {
    "outermost_json": f"SELECT id, json_valid(j) AS valid FROM (SELECT id, regexp_extract(content, '(?s)(\\{{.*\\}})', 1) AS j FROM {_D('messages')}) WHERE j <> ''",
    "profile_labels": f"SELECT id, CASE WHEN lower(trim(coalesce(headquarters, ''), ' ')) IN ({_HOLES}) THEN '' ELSE trim(coalesce(headquarters, ''), ' ') END AS place, coalesce(nullif(substring({_FOLD('short_description')}, 1, 40), ''), nullif(substring({_FOLD('description')}, 1, 40), '')) AS teaser, strftime(founded_date, '%Y/%m') AS founded FROM {_C}",
    "normalized_urls": f"""
WITH f AS (SELECT id, trim(coalesce(url, ''), ' ') AS t FROM {_C}),
g AS (SELECT id, t, CASE WHEN starts_with(t, '//') THEN 'https:' || t WHEN contains(t, '://') THEN t ELSE 'https://' || t END AS x FROM f),
h AS (SELECT id, t, lower(regexp_extract(x, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) AS s, lower(regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) AS a, regexp_replace(regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#;]*)', 1), '/+$', '') AS p FROM g),
k AS (SELECT id, p, CASE WHEN t <> '' AND s IN ('http', 'https') AND regexp_replace(a, ':\\d*$', '') <> '' AND NOT contains(a, '@') AND NOT regexp_matches(a, '\\s') AND NOT regexp_matches(regexp_replace(regexp_replace(a, ':\\d*$', ''), '\\.+$', ''), '{_PRIVATE}') THEN s || '://' || a || p END AS u FROM h)
SELECT id, u AS url, CASE WHEN u IS NULL THEN NULL ELSE len(list_filter(string_split(p, '/'), lambda x: x <> ''))::int END AS depth, {_ROLE.replace('lower(u)', "lower(coalesce(u, '') || ' ')")} AS role FROM k""",
    "report_markdown": f"SELECT id, md5(concat_ws(chr(10), '# ' || coalesce(url, ''), '', '- status: ' || coalesce(status, '-'), '', '## Gaps', CASE WHEN len(g) = 0 THEN '- none' ELSE list_aggregate(list_transform(g, lambda x: '- ' || x), 'string_agg', chr(10)) END)) AS digest FROM (SELECT id, url, status, CASE WHEN json_valid(src) AND json_type(src) = 'ARRAY' THEN list_filter(list_transform(json_extract(src, '$[*]'), lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') WHEN json_type(x) = 'NULL' THEN NULL ELSE x::varchar END), lambda x: x IS NOT NULL) ELSE [] END AS g FROM (SELECT id, url, status, CASE WHEN json_valid(recommendations) THEN CASE WHEN json_type(recommendations, '$.gaps') = 'VARCHAR' THEN json_extract_string(recommendations, '$.gaps') ELSE json_extract(recommendations, '$.gaps')::varchar END END AS src FROM {_D('diagnostic_reports')} WHERE recommendations IS NOT NULL))",
}
