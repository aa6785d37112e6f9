"""Lookups, filters, sorts, counts, profile signals, payloads and JSON items, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenry.functions import text
from lumenry.functions.refs import ref_key
from lumenry.operators import records
from lumenry.operators import relational as R
from lumenry.operators.vectors import cosine_search
from lumenry.plans import analysis, lists
from lumenry.plans.analysis import geo_dimensions, keyword_packs, lexical_recommend
from lumenry.plans.lists import companies, distinct_rows
from lumenry.sources import writers
from lumenry.sources.tables import read_table

DIMS = ("schema", "content", "meta", "citation")
# Percents of progress of the pipeline's states, as the interface and as the page shows them.
STATES = ("pending", "crawling", "cleaning", "graph_building", "vectorizing", "completed", "failed")
PROGRESS = dict(zip(STATES, (0, 20, 40, 65, 85, 100, 0), strict=True))
PAGE_PROGRESS = dict(zip(STATES, (10, 25, 45, 65, 85, 100, 0), strict=True))
#: Name and address of the site that JSON-LD nodes belong to.
SITE = ("Lumenry", "https://lumenry.example")


def _tags(c: str = "tags"):
    return R.string_list(F.col(c))


def find_company(spark, d):
    """Organisations by identifier: the id, in any of its spellings, comes before the path key."""
    rows = companies(spark, d, "path_key").select("id", "path_key", ref_key(F.col("id")).alias("k"))
    asked = rows.select(F.upper("path_key").alias("identifier")).unionByName(rows.select(F.col("k").alias("identifier"))).where("identifier is not null")
    return records.find_by_identifier(asked, rows, {"id": F.col("k"), "path": F.lower("path_key")})


def find_content(spark, d):
    """Documents by identifier: one of five letters names an item's path, any other a slug of the title."""
    rows = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower(F.substring("item_id", 1, 5)).alias("path"), text.content_slug(F.col("title")).alias("slug"))
    asked = rows.select(F.col("slug").alias("identifier")).unionByName(rows.select(F.upper("path").alias("identifier"))).where("identifier is not null and identifier <> ''")
    return records.find_by_identifier(asked, rows, {"path": F.when(F.col("path").rlike("^[a-z]{5}$"), F.col("path")), "slug": F.col("slug")})


def praised_reviews(spark, d):
    """Documents by two predicates that reach the scan."""
    return read_table(spark, d, "documents").where("verified and rating >= 4").select("doc_id", "item_id")


def viewable_companies(spark, d, user: str | None = None, admin: bool = False):
    """Organisations a user may see: published ones and their own; an administrator sees all."""
    rows = companies(spark, d, "publish_status", "submitted_by")
    own = rows.agg(F.min("submitted_by").alias("u")) if user is None else spark.range(1).select(F.lit(user).alias("u"))
    seen = F.lit(admin) | (F.col("publish_status") == "published") | (F.col("submitted_by") == F.col("u"))
    return rows.join(F.broadcast(own)).where(F.coalesce(seen, F.lit(False))).select("id", "publish_status")  # one row


def own_or_public(spark, d):
    """Conversations without an owner, and those of one user; others are as if they were not."""
    rows = distinct_rows(spark, d, "conversations", "user_id")
    user = rows.agg(F.min("user_id").alias("u"))
    return rows.join(F.broadcast(user)).where("user_id is null or user_id = u").select("id", F.col("user_id").isNull().alias("is_public"))  # one row


def public_conversations(spark, d):
    return distinct_rows(spark, d, "conversations", "user_id").where("user_id is null").select("id")


def filter_tristate(spark, d):
    """Organisations in each of three lists: drafts, published ones, and those of them that are certified."""
    rows = companies(spark, d, "publish_status", "is_geo_certified")
    published = F.col("publish_status") == "published"
    lists = F.array_compact(F.array(F.when(~published, "draft"), F.when(published, "published"), F.when(published & F.col("is_geo_certified"), "featured")))
    return rows.select("id", F.explode(lists).alias("list"))


def filter_contents(spark, d):
    """Documents of one language and state that match a search in any of four columns."""
    rows = R.where_equal(read_table(spark, d, "documents").where("verified"), lang="en", source=None)
    return rows.where(R.matches_any("kettle", [F.col(c) for c in ("title", "text", "item_name", "source")])).select("doc_id")


def filter_customers(spark, d):
    """Customers of a segment with a positive balance that match a search in any of three columns."""
    rows = R.where_equal(read_table(spark, d, "customer").where("c_acctbal > 0"), c_mktsegment="BUILDING")
    return rows.where(R.matches_any("7", [F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")])).select("c_custkey", "c_name")


def search_packs(spark, d):
    """Organisations whose name, tags or JSON details hold a text."""
    rows = companies(spark, d, "name", "tags", "geo_details")
    return rows.where(R.matches_any("canonical", [F.col("name"), F.col("geo_details")], [_tags()])).select("id")


def progress_percents(spark, d):
    """Two percents of progress for each organisation's state, by two maps; 0 for other states."""
    of = lambda m: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.coalesce(F.lower("pipeline_status"), F.lit(""))), F.lit(0))
    return companies(spark, d, "pipeline_status").select("id", of(PROGRESS).alias("progress"), of(PAGE_PROGRESS).alias("page_progress"))


def category_tag_top(spark, d):
    """The eight most frequent pairs of category and first tag."""
    rows = companies(spark, d, "category", "tags").select(F.coalesce("category", F.lit("")).alias("category"), F.coalesce(F.try_element_at(_tags(), F.lit(1)), F.lit("other")).alias("tag"))
    return rows.groupBy("category", "tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category", "tag").limit(8)


def content_summary(spark, d):
    """Counts and votes of all documents in one pass, whatever a list shows."""
    return read_table(spark, d, "documents").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("verified").alias("verified"), F.count_if(~F.coalesce("verified", F.lit(False))).alias("others"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("empty"), F.coalesce(F.sum("helpful_votes"), F.lit(0)).alias("votes")
    )


def accumulated_usage(spark, d):
    """Daily totals of purchases until a day, with those of later events added."""
    events = read_table(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.bround(F.col("value") * 100, 0).cast("long").alias("cents"))
    daily = events.where("day < '2024-01-15'").groupBy("user_id", "day").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("requests"))
    return records.accumulate(daily, events.where("day >= '2024-01-15'"), ["user_id", "day"], "cents")


def linked_counts(spark, d):
    """Per organisation with a report or a vote: how many users of either kind."""
    count = lambda t, c: distinct_rows(spark, d, t, "company_id", "user_id").select(ref_key(F.col("company_id")).alias("company"), "user_id").where("company is not null").groupBy("company").agg(F.count_distinct("user_id").alias(c))
    both = count("company_votes", "voters").join(count("diagnostic_reports", "reporters"), "company", "full")
    return both.select("company", F.coalesce("voters", F.lit(0)).alias("voters"), F.coalesce("reporters", F.lit(0)).alias("reporters"))


def total_sums(spark, d):
    """Sums over whole lists: reviews, their reading minutes, and recommended organisations."""
    docs = read_table(spark, d, "documents").agg(F.count(F.lit(1)).alias("articles"), F.sum(text.reading_minutes_floor(F.col("text"))).alias("minutes"))
    recommended = distinct_rows(spark, d, "messages", "recommended_companies").agg(F.coalesce(F.sum(F.size(records.object_list(F.col("recommended_companies")))), F.lit(0)).alias("recommended"))
    return docs.crossJoin(F.broadcast(recommended))  # one row each


def usage_of_users(spark, d):
    """One day's totals of the users of a list, zeros for those without a row; the list is every owner of a conversation."""
    asked = distinct_rows(spark, d, "conversations", "user_id").where("user_id is not null").select("user_id").distinct()
    usage = R.latest(read_table(spark, d, "user_daily_usage").where("usage_date = date'2025-03-01'"), ["user_id"], ["updated_at", "total_tokens", "request_count"], ["total_tokens", "request_count"])
    return asked.join(usage, "user_id", "left").select("user_id", F.coalesce("total_tokens", F.lit(0)).alias("tokens"), F.coalesce("request_count", F.lit(0)).alias("requests"))


def sort_upvotes(spark, d):
    return R.page(companies(spark, d, "upvotes"), [F.desc_nulls_last("upvotes"), F.col("id")], 1, 30).select("id", "upvotes")


def sort_newest(spark, d):
    return R.page(companies(spark, d, "created_at"), [F.desc_nulls_last("created_at"), F.col("id")], 1, 30).select("id")


def oldest_pending(spark, d):
    """The oldest unfinished reports, a batch of at most 100."""
    rows = distinct_rows(spark, d, "diagnostic_reports", "status", "created_at").where("status in ('pending', 'crawling', 'analyzing')")
    return R.page(rows, [F.asc_nulls_last("created_at"), F.col("id")], 1, 100).select("id", "status")


def recent_events(spark, d):
    return R.page(read_table(spark, d, "events").select("event_id", "ts"), [F.desc("ts"), F.col("event_id")], 1, 20).select("event_id")


def capped_list(spark, d):
    """Suppliers by nation, the richest first, the first 100; the total counts all."""
    rows = read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return R.page(rows, [F.col("s_nationkey"), F.desc("s_acctbal"), F.col("s_suppkey")], 1, 100).select("s_suppkey").join(F.broadcast(total))  # one row


def provider_order(spark, d):
    """Suppliers in order of priority (999 where none is set, then key), in each nation, and the order in which a rotated list begins at the second."""
    rows = read_table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.coalesce(F.nullif(F.col("s_suppkey") % 5, F.lit(0)), F.lit(999)).alias("priority"))
    w = Window.partitionBy("s_nationkey")
    placed = rows.select("s_nationkey", "s_suppkey", F.row_number().over(w.orderBy("priority", "s_suppkey")).alias("place"), F.count(F.lit(1)).over(w).alias("n"))
    return placed.select("s_nationkey", "s_suppkey", "place", (F.pmod(F.col("place") - 2, F.col("n")) + 1).cast("int").alias("rotated_place"))


def own_history(spark, d):
    """One user's conversations, the newest first, the second page of ten."""
    rows = distinct_rows(spark, d, "conversations", "user_id", "created_at")
    user = rows.where("user_id is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(1).select("user_id")
    return R.page(rows.join(F.broadcast(user), "user_id", "left_semi"), [F.desc_nulls_last("created_at"), F.col("id")], 2, 10).select("id")  # one row


def roadmap(spark, d):
    """The phase in which each of the four scores of an organisation is to be worked on: the two least first, then the third, then the best; a missing score is 0."""
    scored = geo_dimensions(spark, d).select("id", F.array(*[F.struct(F.coalesce(k, F.lit(0)).alias("v"), F.lit(i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(DIMS)]).alias("all"))
    each = scored.select("id", F.posexplode(F.array_sort("all")).alias("at", "x"))
    return each.select("id", F.col("x.k").alias("dimension"), F.when(F.col("at") < 2, 1).otherwise(F.col("at")).cast("int").alias("phase"))


def company_keywords(spark, d):
    """Up to 20 keywords of each organisation: name, category, teaser, place and tags, without placeholders."""
    rows = companies(spark, d, "name", "category", "short_description", "headquarters", "tags")
    words = records.keyword_union(F.array(text.company_name(F.col("name"), F.col("name")), "category", "short_description", "headquarters"), F.transform(_tags(), lambda t: F.trim(F.regexp_replace(t, r"(?U)\s+", " "))))
    return rows.select("id", F.array_join(words, "|").alias("keywords"))


def unknown_keys(spark, d):
    """Keys of the details that no score or list has, with the organisations that use them."""
    keys = companies(spark, d, "geo_details").where(F.try_parse_json("geo_details").isNotNull()).select("id", F.explode(F.array_except(F.json_object_keys("geo_details"), F.array(*map(F.lit, (*DIMS, "pages"))))).alias("key"))
    return keys.groupBy("key").agg(F.count_distinct("id").alias("n"))


def semantic_nodes(spark, d):
    """Up to eight nodes around each organisation: category, place, stage and five tags, without placeholders and its own name."""
    rows = companies(spark, d, "name", "category", "headquarters", "funding_stage", "tags")
    nodes = records.keyword_union(F.array("category", "headquarters", "funding_stage"), F.slice(_tags(), 1, 5), limit=8, without=text.company_name(F.col("name"), F.col("name")))
    return rows.select("id", F.array_join(nodes, "|").alias("nodes"))


def completeness(spark, d):
    """How many of six parts of a profile an organisation has, of six."""
    rows = companies(spark, d, "description", "short_description", "tags", "category", "geo_details", "founded_date", "headquarters")
    told = lambda c: text.clean_text(F.col(c)).isNotNull()
    has = [told("description") | told("short_description"), F.size(_tags()) > 0, told("category"), F.size(records.object_list(F.get_json_object("geo_details", "$.pages"))) > 0, F.col("founded_date").isNotNull(), told("headquarters")]
    n = sum((F.coalesce(x, F.lit(False)).cast("int") for x in has), F.lit(0))
    return rows.select("id", n.alias("n_parts"), F.round(n / 6, 6).alias("share"))


def coverage_signals(spark, d):
    """How widely an organisation is covered (24 a page, 6 a tag, at most 100), beside its progress."""
    rows = companies(spark, d, "tags", "geo_details", "pipeline_status")
    n_pages = F.size(records.object_list(F.get_json_object("geo_details", "$.pages")))
    progress = progress_percents(spark, d).select("id", "page_progress")
    return rows.select("id", F.least(F.lit(100), 24 * n_pages + 6 * F.size(_tags())).alias("coverage")).join(progress, "id")


def source_weights(spark, d):
    """Weights of an organisation's first four pages: by role (the last step of the address), else falling with the place."""
    # Weights by role.
    weights = {"homepage": 100, "about": 86, "team": 82, "product": 78, "faq": 70, "case": 74}
    pages = companies(spark, d, "geo_details").select("id", F.posexplode(F.slice(records.object_list(F.get_json_object("geo_details", "$.pages")), 1, 4)).alias("at", "page"))
    role = F.lower(F.regexp_extract(F.coalesce(F.get_json_object("page", "$.url"), F.lit("")), "([^/]*)$", 1))
    by_role = F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), role)
    return pages.select("id", F.col("at").alias("place"), role.alias("role"), F.coalesce(by_role, F.greatest(F.lit(48), 80 - 8 * F.col("at"))).alias("weight"))


def conversation_titles(spark, d):
    """The title of each conversation: the first 30 characters of its first message."""
    rows = distinct_rows(spark, d, "messages", "conversation_id", "content", "created_at").select(ref_key(F.col("conversation_id")).alias("conversation"), "created_at", "id", "content").where("conversation is not null and created_at is not null")
    return rows.groupBy("conversation").agg(F.min_by(F.substring("content", 1, 30), F.struct("created_at", "id")).alias("title"))


def pack_titles(spark, d):
    """The first three tags of each organisation, joined, as the title of its pack."""
    return companies(spark, d, "tags").select("id", F.array_join(F.slice(_tags(), 1, 3), " / ").alias("title"))


def dedupe_keys(spark, d):
    """The key under which a keyword is unique in its pack."""
    return keyword_packs(spark, d).select("pack", F.substring(F.concat_ws(":", "dimension", F.lower("keyword")), 1, 500).alias("dedupe_key"))


def device_hashes(spark, d):
    """Hashes of device ids (here users' ids) of at least 16 characters; null for shorter ones."""
    users = read_table(spark, d, "user_daily_usage").select("user_id").distinct()
    return users.select("user_id", F.when(F.length(F.trim("user_id")) >= 16, F.sha2(F.trim("user_id"), 256)).alias("device"))


def recommended_items(spark, d):
    """Organisations recommended in messages, item by item, from a list or an object with a list."""
    rows = distinct_rows(spark, d, "messages", "recommended_companies").select("id", F.posexplode(records.object_list(F.col("recommended_companies"))).alias("nth", "x"))
    return rows.select("id", "nth", F.get_json_object("x", "$.company_id").alias("company_id"), F.round(F.get_json_object("x", "$.match_score").try_cast("double"), 6).alias("score"))


def sanitized_keywords(spark, d):
    """Keywords as a generator might give them, two of each and with loose white space, brought into shape."""
    packs = keyword_packs(spark, d)
    raw = lambda kw, rec: F.concat(F.lit("[{"), F.lit('"keyword":'), F.to_json(F.array(kw)).substr(F.lit(2), F.length(F.to_json(F.array(kw))) - 2), F.lit(',"rec":'), rec, F.lit("}]"))
    items = packs.select("pack", F.concat_ws("-", "dimension", "rank").alias("dimension"), F.col("keyword").alias("seed"), raw(F.concat(F.lit("  "), "keyword"), F.col("rank") * 20).alias("raw"))
    return records.sanitized_items(items, ["review"])


def expired_orders(spark, d):
    """Open orders before a day, as pending reservations past due: charged with their price, or released if it is small."""
    rows = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("settled").alias("status"), F.col("o_orderdate").alias("expires_at"), F.when(F.col("o_totalprice") > 50000, F.floor("o_totalprice")).alias("used"))
    return records.swept(rows, F.lit("1996-01-01").cast("timestamp_ntz"))


def prompt_context(spark, d):
    """The context of a question's prompt: the organisations found for each search, in order, one line each."""
    found = lexical_recommend(spark, d).join(companies(spark, d, "name", "category").select("id", "name", "category"), "id")
    lines = F.struct("rank", F.concat(F.col("rank").cast("string"), F.lit(". "), F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce("category", F.lit("-")), F.lit(")")).alias("line"))
    return found.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(lines)), lambda x: x["line"]), "\n").alias("context"))  # five lines a query


def votes_left(spark, d):
    """Votes per organisation after those that failed were deleted with their votes, and the messages that lost their report."""
    gone = companies(spark, d, "pipeline_status").where("pipeline_status = 'failed'").select(ref_key(F.col("id")).alias("id"))
    votes = distinct_rows(spark, d, "company_votes", "company_id").select("id", ref_key(F.col("company_id")).alias("company")).where("company is not null")
    left = records.without_records({"votes": votes}, gone, {"votes": "company"}, {})["votes"]
    return left.groupBy("company").agg(F.count(F.lit(1)).alias("votes"))


def detached_messages(spark, d):
    """Messages with the report they refer to, taken out where the report failed."""
    gone = distinct_rows(spark, d, "diagnostic_reports", "status").where("status = 'failed'").select(ref_key(F.col("id")).alias("id"))
    rows = distinct_rows(spark, d, "messages", "diagnostic_context_id").select("id", ref_key(F.col("diagnostic_context_id")).alias("report"))
    return records.without_records({"messages": rows}, gone, {}, {"messages": "report"})["messages"]


def upvotes_left(spark, d):
    """Upvotes of organisations without the votes of users who never used the service, never below 0."""
    known = read_table(spark, d, "user_daily_usage").select("user_id").distinct()
    votes = distinct_rows(spark, d, "company_votes", "company_id", "user_id").join(known, "user_id", "left_anti").select(ref_key(F.col("company_id")).alias("k"))
    rows = companies(spark, d, "upvotes").select("id", ref_key(F.col("id")).alias("k"), "upvotes")
    return records.decremented(rows, votes, "k", "upvotes").select("id", "upvotes")


def vector_points(spark, d):
    """The points under which the windows of an organisation's description are stored: id, payload and text."""
    windows = companies(spark, d, "description", "category").select(F.col("id").alias("company_id"), "category", F.posexplode(R.word_windows(F.col("description"), 40, 5)).alias("chunk_index", "text"))
    return windows.select(records.name_uuid(F.concat_ws(":", F.lit("company"), "company_id", "chunk_index")).alias("point_id"), "company_id", "chunk_index", "category", F.md5("text").alias("digest"))


def entity_graph(spark, d):
    """Nodes of the organisations' newest tags in place of older ones, and edges between tags that follow each other, each with both nodes."""
    nodes = lambda rows: rows.select(F.col("id").alias("company_id"), F.explode(_tags()).alias("name"), F.lit("Technology").alias("type"))
    newest = companies(spark, d, "tags")
    merged = records.merge_nodes(nodes(read_table(spark, d, "companies").select("id", "tags")), nodes(newest))
    steps = newest.select(F.col("id").alias("company_id"), F.posexplode(_tags()).alias("at", "src"))
    edges = steps.join(steps.select("company_id", (F.col("at") - 1).alias("at"), F.col("src").alias("dst")), ["company_id", "at"]).select("company_id", "src", F.lit("USES_TECH").alias("type"), "dst")
    return records.graph_pattern(merged, records.merge_edges(edges, edges)).select("company_id", "src", "dst")


def cosine_of_label(spark, d):
    """The three nearest vectors of each label's vectors whose key is divisible by 100, among those of the same label, with the parts they stand for."""
    rows, out = read_table(spark, d, "embeddings"), None
    for label in (0, 1, 2):
        own = rows.where(F.col("label") == label)
        found = cosine_search(own.where("vec_id % 100 = 0"), own, "vec_id", "embedding", 3)
        out = found if out is None else out.unionByName(found)
    parts = read_table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("item"), "p_name")
    return out.join(parts, "item").select("query", "rank", "item", "p_name")


def breadcrumbs(spark, d):
    """JSON-LD of the way to each organisation's page, and of the page."""
    name, url = F.coalesce(text.company_name(F.col("name"), F.col("name")), F.lit("")), F.concat(F.lit(SITE[1] + "/companies/"), "path_key")
    step = lambda n, label, item: F.struct(F.lit("ListItem").alias("@type"), F.lit(n).alias("position"), label.alias("name"), item.alias("item"))
    path = F.array(step(1, F.lit("Home"), F.lit(SITE[1] + "/")), step(2, F.lit("Companies"), F.lit(SITE[1] + "/companies")), step(3, name, url))
    crumbs = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), path.alias("itemListElement")))
    page = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("WebPage").alias("@type"), F.concat(name, F.lit(" - " + SITE[0])).alias("name"), url.alias("url")))
    return companies(spark, d, "name", "path_key").where("path_key is not null").select("id", writers.script_safe(crumbs).alias("breadcrumbs"), writers.script_safe(page).alias("page"))


def article_data(spark, d):
    """JSON-LD of each review as an article, without empty members."""
    none = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    node = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("TechArticle").alias("@type"), none(F.col("title")).alias("headline"), F.date_format("review_date", "yyyy-MM-dd").alias("datePublished"), none(F.col("item_name")).alias("articleSection"), F.concat(F.lit("PT"), text.reading_minutes_floor(F.col("text")), F.lit("M")).alias("timeRequired"))
    return read_table(spark, d, "documents").select("doc_id", writers.script_safe(F.to_json(node)).alias("jsonld"))


QUERIES = {f.__name__: f for f in (
    find_company, find_content, praised_reviews, viewable_companies, own_or_public, public_conversations, filter_tristate, filter_contents, filter_customers, search_packs, progress_percents, category_tag_top, content_summary, accumulated_usage, linked_counts, total_sums, usage_of_users, sort_upvotes, sort_newest, oldest_pending,
    recent_events, capped_list, provider_order, own_history, roadmap, company_keywords, unknown_keys, semantic_nodes, completeness, coverage_signals, source_weights, conversation_titles, pack_titles, dedupe_keys, device_hashes, recommended_items, sanitized_keywords, expired_orders, prompt_context, votes_left, detached_messages,
    upvotes_left, vector_points, entity_graph, cosine_of_label, breadcrumbs, article_data,
)}

_C, _D, _K, _T, _WS = lists._C, lists._D, lists._k, lists._T, analysis._WS
_JSON = lambda c: f"(CASE WHEN json_valid({c}) THEN {c} END)"
_G = _JSON("geo_details")
_HELD = f"(CASE WHEN json_type({_G}, '$.pages') = 'VARCHAR' THEN json_extract_string({_G}, '$.pages') ELSE json_extract({_G}, '$.pages')::varchar END)"  # a list kept as text counts as the list
_PAGES = f"coalesce(CASE WHEN json_type({_JSON(_HELD)}) = 'ARRAY' THEN json_extract({_JSON(_HELD)}, '$[*]') WHEN json_type({_JSON(_HELD)}, '$.items') = 'ARRAY' THEN json_extract({_JSON(_HELD)}, '$.items[*]') END, [])"
_CLEAN = lambda c: f"nullif(trim(regexp_replace(coalesce({c}, ''), '{_WS}', ' ', 'g'), ' '), '')"
_HOLES = ", ".join(f"'{x}'" for x in text.PLACEHOLDERS)
_SIGNS = text._NAME_SIGNS
_TITLE = lambda c: f"substring({_CLEAN(c)}, 1, 200)"
_FIRM = lambda c: f"coalesce(list_filter(list_transform(regexp_split_to_array({_TITLE(c)}, '\\s*[|｜丨]\\s*|\\s+[—–-]\\s+'), lambda p: trim(p, '{_SIGNS}')), lambda x: length(x) BETWEEN 2 AND 60)[1], {_TITLE(c)})"


def _union(parts: str, limit: int, without: str = "NULL", columns: str = "") -> str:
    """Distinct texts in order, without placeholders."""
    return f"""SELECT id, coalesce((SELECT string_agg(x, '|' ORDER BY nth) FROM (SELECT x, nth FROM (SELECT x, min(nth) AS nth FROM (SELECT trim(coalesce(v, ''), ' ') AS x, nth FROM (SELECT unnest(vs) AS v, generate_subscripts(vs, 1) AS nth)) WHERE x <> '' AND lower(x) NOT IN ({_HOLES}) AND x IS DISTINCT FROM own GROUP BY x) ORDER BY nth LIMIT {limit})), '') AS {columns} FROM (SELECT id, {without} AS own, {parts} AS vs FROM {_C})"""


_PACKS = analysis._PACKS
_PROGRESS = lambda m: "CASE lower(pipeline_status) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + " ELSE 0 END"
_NEAR = "WITH s AS (SELECT q.vec_id AS query, c.vec_id AS item, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 12) DESC, c.vec_id) AS rank FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 AND q.label IN (0, 1, 2))"
_SAFE = lambda c: f"replace(replace(replace({c}, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"

SQL = {
    "find_company": f"WITH r AS (SELECT id, path_key, {_K('id')} AS k FROM {_C}), a AS (SELECT upper(path_key) AS identifier FROM r UNION SELECT k FROM r) SELECT identifier, coalesce((SELECT min(id) FROM r WHERE k = lower(identifier)), (SELECT min(id) FROM r WHERE lower(path_key) = lower(identifier))) AS id FROM a WHERE identifier IS NOT NULL",
    "find_content": r"WITH r AS (SELECT doc_id AS id, lower(substring(item_id, 1, 5)) AS path, substring(regexp_replace(lower(trim(title, ' ')), '[^\p{L}\p{M}\p{Nd}\p{Pc}\-]', '-', 'g'), 1, 280) AS slug FROM documents), k AS (SELECT path AS key, 0 AS o, min(id) AS id FROM r WHERE regexp_full_match(path, '[a-z]{5}') GROUP BY 1 UNION ALL SELECT slug, 1, min(id) FROM r GROUP BY 1), a AS (SELECT slug AS identifier FROM r UNION SELECT upper(path) FROM r) SELECT identifier, arg_min(k.id, k.o) AS id FROM a JOIN k ON k.key = lower(identifier) WHERE identifier <> '' GROUP BY 1",
    "praised_reviews": "SELECT doc_id, item_id FROM documents WHERE verified AND rating >= 4",
    "viewable_companies": f"SELECT id, publish_status FROM {_C} WHERE publish_status = 'published' OR submitted_by = (SELECT min(submitted_by) FROM {_C})",
    "own_or_public": f"SELECT id, user_id IS NULL AS is_public FROM {_D('conversations')} WHERE user_id IS NULL OR user_id = (SELECT min(user_id) FROM conversations)",
    "public_conversations": f"SELECT id FROM {_D('conversations')} WHERE user_id IS NULL",
    "filter_tristate": f"SELECT id, 'draft' AS list FROM {_C} WHERE publish_status <> 'published' UNION ALL SELECT id, 'published' FROM {_C} WHERE publish_status = 'published' UNION ALL SELECT id, 'featured' FROM {_C} WHERE publish_status = 'published' AND is_geo_certified",
    "filter_contents": "SELECT doc_id FROM documents WHERE verified AND lang = 'en' AND (title ILIKE '%kettle%' OR text ILIKE '%kettle%' OR item_name ILIKE '%kettle%' OR source ILIKE '%kettle%')",
    "filter_customers": "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' AND (c_name ILIKE '%7%' OR c_mktsegment ILIKE '%7%' OR c_custkey::varchar ILIKE '%7%')",
    "search_packs": f"SELECT id FROM {_C} WHERE name ILIKE '%canonical%' OR geo_details ILIKE '%canonical%' OR len(list_filter({_T}, lambda x: x ILIKE '%canonical%')) > 0",
    "progress_percents": f"SELECT id, {_PROGRESS(PROGRESS)} AS progress, {_PROGRESS(PAGE_PROGRESS)} AS page_progress FROM {_C}",
    "category_tag_top": f"SELECT coalesce(category, '') AS category, coalesce({_T}[1], 'other') AS tag, count(*) AS n FROM {_C} GROUP BY 1, 2 ORDER BY n DESC, category, tag LIMIT 8",
    "content_summary": "SELECT count(*) AS total, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT coalesce(verified, false)) AS others, count(*) FILTER (coalesce(text, '') = '') AS empty, coalesce(sum(helpful_votes), 0)::bigint AS votes FROM documents",
    "accumulated_usage": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, sum(round_even(value * 100, 0)::bigint)::bigint AS cents, count(*) AS requests FROM events WHERE event_type = 'purchase' GROUP BY ALL",
    "linked_counts": f"WITH v AS (SELECT {_K('company_id')} AS company, count(DISTINCT user_id) AS voters FROM company_votes GROUP BY 1), r AS (SELECT {_K('company_id')} AS company, count(DISTINCT user_id) AS reporters FROM diagnostic_reports GROUP BY 1) SELECT company, coalesce(voters, 0) AS voters, coalesce(reporters, 0) AS reporters FROM (SELECT * FROM v WHERE company IS NOT NULL) FULL JOIN (SELECT * FROM r WHERE company IS NOT NULL) USING (company)",
    "total_sums": f"SELECT (SELECT count(*) FROM documents) AS articles, (SELECT sum(greatest(1, length(coalesce(text, '')) // 400)) FROM documents)::bigint AS minutes, (SELECT sum(json_array_length(recommended_companies)) FROM {_D('messages')} WHERE json_valid(recommended_companies) AND json_type(recommended_companies) = 'ARRAY')::bigint AS recommended",
    "usage_of_users": "WITH u AS (SELECT * FROM user_daily_usage WHERE usage_date = DATE '2025-03-01' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC NULLS LAST, total_tokens DESC NULLS LAST, request_count DESC NULLS LAST) = 1) SELECT c.user_id, coalesce(u.total_tokens, 0) AS tokens, coalesce(u.request_count, 0) AS requests FROM (SELECT DISTINCT user_id FROM conversations WHERE user_id IS NOT NULL) c LEFT JOIN u USING (user_id)",
    "sort_upvotes": f"SELECT id, upvotes FROM {_C} ORDER BY upvotes DESC NULLS LAST, id LIMIT 30",
    "sort_newest": f"SELECT id FROM {_C} ORDER BY created_at DESC NULLS LAST, id LIMIT 30",
    "oldest_pending": f"SELECT id, status FROM {_D('diagnostic_reports')} WHERE status IN ('pending', 'crawling', 'analyzing') ORDER BY created_at NULLS LAST, id LIMIT 100",
    "recent_events": "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 20",
    "capped_list": "SELECT s_suppkey, (SELECT count(*) FROM supplier) AS total FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey LIMIT 100",
    "provider_order": "WITH p AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 5 = 0 THEN 999 ELSE s_suppkey % 5 END, s_suppkey)::int AS place, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_nationkey, s_suppkey, place, (CASE WHEN place = 1 THEN n ELSE place - 1 END)::int AS rotated_place FROM p",
    "own_history": f"SELECT id FROM {_D('conversations')} WHERE user_id = (SELECT user_id FROM {_D('conversations')} WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1) ORDER BY created_at DESC NULLS LAST, id LIMIT 10 OFFSET 10",
    "roadmap": "WITH g AS (" + analysis.SQL["geo_dimensions"] + "), e AS (SELECT id, k AS dimension, row_number() OVER (PARTITION BY id ORDER BY v, o) AS nth FROM (" + " UNION ALL ".join(f"SELECT id, '{k}' AS k, {i} AS o, coalesce(\"{k}\", 0) AS v FROM g" for i, k in enumerate(DIMS)) + ")) SELECT id, dimension, (CASE WHEN nth <= 2 THEN 1 ELSE nth - 1 END)::int AS phase FROM e",
    "unknown_keys": f"SELECT key, count(DISTINCT id) AS n FROM (SELECT id, unnest(json_keys(geo_details)) AS key FROM {_C} WHERE json_valid(geo_details) AND json_type(geo_details) = 'OBJECT') WHERE key NOT IN ('schema', 'content', 'meta', 'citation', 'pages') GROUP BY 1",
    "completeness": f"SELECT id, n::int AS n_parts, round(n / 6, 6) AS share FROM (SELECT id, (({_CLEAN('description')} IS NOT NULL OR {_CLEAN('short_description')} IS NOT NULL)::int + (len({_T}) > 0)::int + ({_CLEAN('category')} IS NOT NULL)::int + (len({_PAGES}) > 0)::int + (founded_date IS NOT NULL)::int + ({_CLEAN('headquarters')} IS NOT NULL)::int) AS n FROM {_C})",
    "coverage_signals": f"SELECT id, least(100, 24 * len({_PAGES}) + 6 * len({_T}))::int AS coverage, {_PROGRESS(PAGE_PROGRESS)} AS page_progress FROM {_C}",
    "source_weights": f"SELECT id, nth::int AS place, role, (CASE role WHEN 'homepage' THEN 100 WHEN 'about' THEN 86 WHEN 'team' THEN 82 WHEN 'product' THEN 78 WHEN 'faq' THEN 70 WHEN 'case' THEN 74 ELSE greatest(48, 80 - 8 * nth) END)::int AS weight FROM (SELECT id, nth, lower(regexp_extract(coalesce(json_extract_string(p, '$.url'), ''), '([^/]*)$', 1)) AS role FROM (SELECT id, unnest(ps[1:4]) AS p, generate_subscripts(ps[1:4], 1) - 1 AS nth FROM (SELECT id, {_PAGES} AS ps FROM {_C})))",
    "conversation_titles": f"SELECT {_K('conversation_id')} AS conversation, arg_min(coalesce(substring(content, 1, 30), chr(0)), {{'a': created_at, 'b': id}}) AS title FROM {_D('messages')} WHERE {_K('conversation_id')} IS NOT NULL AND created_at IS NOT NULL GROUP BY 1",
    "pack_titles": f"SELECT id, array_to_string({_T}[1:3], ' / ') AS title FROM {_C}",
    "dedupe_keys": _PACKS + "SELECT pack, substring(dimension || ':' || lower(keyword), 1, 500) AS dedupe_key FROM packs",
    "device_hashes": "SELECT DISTINCT user_id, CASE WHEN length(trim(user_id)) >= 16 THEN sha256(trim(user_id)) END AS device FROM user_daily_usage",
    "recommended_items": f"SELECT id, nth::int AS nth, json_extract_string(x, '$.company_id') AS company_id, round(try_cast(json_extract_string(x, '$.match_score') AS double), 6) AS score FROM (SELECT id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS nth FROM (SELECT id, json_extract(CASE WHEN json_valid(recommended_companies) AND json_type(recommended_companies) = 'ARRAY' THEN recommended_companies ELSE '[]' END, '$[*]') AS xs FROM {_D('messages')}))",
    "sanitized_keywords": _PACKS + f"SELECT pack, dimension || '-' || rank AS dimension, 1 AS rank, keyword, greatest(35, least(99, rank * 20))::int AS recommendation, {analysis._SCORE('keyword', chr(40) + 'dimension || ' + chr(39) + '-' + chr(39) + ' || rank || ' + chr(39) + '-biz' + chr(39) + chr(41), 'keyword', 58, 26)} AS business, NULL::varchar AS reason FROM packs WHERE NOT contains(lower(keyword), 'review')",
    "expired_orders": "SELECT o_orderkey AS id, CASE WHEN o_totalprice > 50000 THEN 'charged' ELSE 'released' END AS status, (CASE WHEN o_totalprice > 50000 THEN floor(o_totalprice) ELSE 0 END)::bigint AS charged FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-01-01'",
    "prompt_context": "WITH l AS (" + analysis.SQL["lexical_recommend"] + f") SELECT query, string_agg(rank || '. ' || coalesce(name, '') || ' (' || coalesce(category, '-') || ')', chr(10) ORDER BY rank) AS context FROM l JOIN {_C} c USING (id) GROUP BY query",
    "votes_left": f"SELECT company, count(*) AS votes FROM (SELECT DISTINCT id, {_K('company_id')} AS company FROM company_votes) WHERE company IS NOT NULL AND company NOT IN (SELECT {_K('id')} FROM {_C} WHERE pipeline_status = 'failed') GROUP BY 1",
    "detached_messages": f"SELECT id, CASE WHEN r IN (SELECT {_K('id')} FROM diagnostic_reports WHERE status = 'failed') THEN NULL ELSE r END AS report FROM (SELECT DISTINCT id, {_K('diagnostic_context_id')} AS r FROM messages)",
    "upvotes_left": f"WITH v AS (SELECT {_K('company_id')} AS k, count(*) AS n FROM {_D('company_votes')} WHERE user_id NOT IN (SELECT user_id FROM user_daily_usage WHERE user_id IS NOT NULL) GROUP BY 1) SELECT id, greatest(0, coalesce(upvotes, 0) - coalesce(n, 0))::bigint AS upvotes FROM (SELECT id, upvotes, {_K('id')} AS k FROM {_C}) LEFT JOIN v USING (k)",
    "entity_graph": f"WITH t AS (SELECT id, unnest({_T}) AS tag, generate_subscripts({_T}, 1) AS nth FROM {_C}) SELECT DISTINCT a.id AS company_id, a.tag AS src, b.tag AS dst FROM t a JOIN t b ON a.id = b.id AND b.nth = a.nth + 1",
    "cosine_of_label": _NEAR + " SELECT query, rank, item, p_name FROM s JOIN part ON p_partkey = item WHERE rank <= 3 AND p_size > 5",
    "company_keywords": _union(f"list_concat([{_FIRM('name')}, category, short_description, headquarters], list_transform({_T}, lambda t: {_CLEAN('t')}))", 20, columns="keywords"),
    "semantic_nodes": _union(f"list_concat([category, headquarters, funding_stage], {_T}[1:5])", 8, _FIRM("name"), "nodes"),
    "article_data": f"SELECT doc_id, {_SAFE('x')} AS jsonld FROM (SELECT doc_id, '{{\"@context\":\"https://schema.org\",\"@type\":\"TechArticle\"' || coalesce(',\"headline\":' || to_json(nullif(title, ''))::varchar, '') || coalesce(',\"datePublished\":' || to_json(strftime(review_date, '%Y-%m-%d'))::varchar, '') || coalesce(',\"articleSection\":' || to_json(nullif(item_name, ''))::varchar, '') || ',\"timeRequired\":\"PT' || greatest(1, length(coalesce(text, '')) // 400) || 'M\"}}' AS x FROM documents)",
    "vector_points": f"WITH w AS (SELECT id, category, list_filter(regexp_split_to_array(coalesce(description, ''), '{_WS}'), lambda x: x <> '') AS ws FROM {_C}), i AS (SELECT id, category, ws, unnest(range(0, len(ws), 35)) AS s FROM w), h AS (SELECT id, category, (s // 35)::int AS n, md5(array_to_string(ws[s + 1 : s + 40], ' ')) AS digest, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('company:' || id || ':' || (s // 35))) AS x FROM i) SELECT substring(x, 1, 8) || '-' || substring(x, 9, 4) || '-5' || substring(x, 14, 3) || '-' || substring('89ab89ab89ab89ab', ('0x' || substring(x, 17, 1))::int + 1, 1) || substring(x, 18, 3) || '-' || substring(x, 21, 12) AS point_id, id AS company_id, n AS chunk_index, category, digest FROM h",
    "breadcrumbs": f"""WITH c AS (SELECT id, to_json({_FIRM('name')})::varchar AS n, to_json({_FIRM('name')} || ' - {SITE[0]}')::varchar AS pn, to_json('{SITE[1]}/companies/' || path_key)::varchar AS u
  FROM (SELECT id, path_key, coalesce({_FIRM('name')}, '') AS name FROM {_C} WHERE path_key IS NOT NULL)),
j AS (SELECT id, '{{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{{"@type":"ListItem","position":1,"name":"Home","item":"{SITE[1]}/"}},{{"@type":"ListItem","position":2,"name":"Companies","item":"{SITE[1]}/companies"}},{{"@type":"ListItem","position":3,"name":' || coalesce(n, '""') || ',"item":' || u || '}}]}}' AS crumbs,
  '{{"@context":"https://schema.org","@type":"WebPage","name":' || coalesce(pn, '" - {SITE[0]}"') || ',"url":' || u || '}}' AS page FROM c)
SELECT id, {_SAFE('crumbs')} AS breadcrumbs, {_SAFE('page')} AS page FROM j""",
}
