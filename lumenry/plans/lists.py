"""List, search, lookup and roll-up queries over organisations, reports, conversations and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenry.functions.refs import ref_key
from lumenry.functions.scores import band
from lumenry.functions.text import excerpt, query_terms
from lumenry.operators import relational as R
from lumenry.operators.records import item_refs
from lumenry.operators.rolling import latest_per_day
from lumenry.sources.tables import read_table

#: Time zone whose days usage is added up by.
DAY_ZONE = "Asia/Shanghai"
PUBLISH = ("draft", "pending_review", "published", "archived")


def companies(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The newest state of each organisation: id, updated_at and the columns asked for, which alone are read; the greatest values win among equal times."""
    return R.latest(read_table(spark, d, "companies").select("id", "updated_at", *columns), ["id"], ["updated_at"], ["updated_at", *columns])


def distinct_rows(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    """The rows of a table whose repeats are exact, each once: its id and the columns asked for, which alone are read and shuffled."""
    return read_table(spark, d, table).select("id", *columns).distinct()


def published_scan(spark, d):
    return companies(spark, d, "publish_status", "name", "category").where("publish_status = 'published'").select("id", "name", "category")


def ids_semi_scan(spark, d):
    """Published organisations among the ids votes refer to; malformed ids drop out."""
    ids = read_table(spark, d, "company_votes").select(ref_key(F.col("company_id")).alias("k")).where("k is not null").distinct()
    return companies(spark, d, "publish_status", "name").where("publish_status = 'published'").withColumn("k", ref_key(F.col("id"))).join(ids, "k", "left_semi").select("id", "name")


def lookup_by_path_key(spark, d):
    """Organisations found by a lower-cased path key, the least id of equal keys."""
    rows = companies(spark, d, "path_key").where(F.length("path_key") == 5)
    return rows.groupBy(F.lower("path_key").alias("path_key")).agg(F.min("id").alias("id"))


def filter_equal_optional(spark, d):
    return R.where_equal(companies(spark, d, "publish_status", "category"), publish_status="published", category="analytics", funding_stage=None).select("id", "category", "publish_status")


def search_two_columns(spark, d):
    return companies(spark, d, "name", "short_description").where(R.matches_any("pilot", [F.col("name"), F.col("short_description")])).select("id", "name")


def search_tags(spark, d):
    return companies(spark, d, "name", "tags").where(R.matches_any("brand", [F.col("name")], [R.string_list(F.col("tags"))])).select("id", "name")


def search_many_columns(spark, d):
    cols = [F.col(c) for c in ("name", "url", "category", "headquarters", "short_description", "description", "funding_stage", "employee_count")]
    return companies(spark, d, "name", "url", "category", "headquarters", "short_description", "description", "funding_stage", "employee_count", "tags").where(R.matches_any("gu", cols, [R.string_list(F.col("tags"))])).select("id")


def filter_tag_contained(spark, d):
    return companies(spark, d, "tags", "name").where(F.array_contains(R.string_list(F.col("tags")), "analytics")).select("id", "name")


def filter_visibility(spark, d):
    rows = distinct_rows(spark, d, "conversations", "user_id")
    return rows.select("id", F.when(F.col("user_id").isNull(), "public").otherwise("owned").alias("visibility"))


def filter_has_recommendations(spark, d):
    linked = distinct_rows(spark, d, "messages", "conversation_id", "recommended_companies").where(F.size(R.string_list(F.col("recommended_companies"))) > 0).select(ref_key(F.col("conversation_id")).alias("k"))
    return distinct_rows(spark, d, "conversations").withColumn("k", ref_key(F.col("id"))).join(linked, "k", "left_semi").select("id")


def filter_enum(spark, d):
    return companies(spark, d, "publish_status").where(R.one_of("publish_status", "draft", PUBLISH)).select("id", "publish_status")


def filter_half_open_day(spark, d):
    return distinct_rows(spark, d, "company_votes", "created_at", "company_id").where("created_at >= timestamp_ntz'2025-06-01 00:00:00' and created_at < timestamp_ntz'2025-06-02 00:00:00'").select("id", "company_id")


def filter_score_present(spark, d):
    return companies(spark, d, "geo_score", "publish_status").where("geo_score is not null and publish_status = 'published'").select("id", "geo_score")


def profile_missing_fields(spark, d):
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    dims = reduce(Column.__and__, [F.get_json_object("geo_details", f"$.{k}").isNotNull() for k in ("schema", "content", "meta", "citation")])
    required = {"description": ~(blank("short_description") & blank("description")), "category": F.trim(F.coalesce("category", F.lit(""))) != "", "tags": F.size(R.string_list(F.col("tags"))) > 0, "geo_score": F.col("geo_score").isNotNull(), "geo_details": (F.try_parse_json("geo_details").isNotNull()) & dims}
    return companies(spark, d, "description", "short_description", "category", "tags", "geo_score", "geo_details").select("id", F.array_join(R.missing_fields(required), ",").alias("missing"))


def project_brief(spark, d):
    return companies(spark, d, "name", "tags", "upvotes").select("id", "name", F.size(R.string_list(F.col("tags"))).alias("n_tags"), F.coalesce("upvotes", F.lit(0)).alias("upvotes"))


def project_excerpt(spark, d):
    return distinct_rows(spark, d, "messages", "content").select("id", excerpt(F.col("content")).alias("excerpt"))


def search_conversations(spark, d):
    """Conversations whose title matches, any of whose messages does, or whose owner is a user (with usage) that does: one semi-join per branch, unioned by key."""
    conv = distinct_rows(spark, d, "conversations", "title", "user_id").withColumn("k", ref_key(F.col("id")))
    by_title = conv.where(R.matches_any("budget", [F.col("title")])).select("k")
    by_message = read_table(spark, d, "messages").where(R.matches_any("budget", [F.col("content")])).select(ref_key(F.col("conversation_id")).alias("k")).where("k is not null")
    users = read_table(spark, d, "user_daily_usage").where(R.matches_any("b9", [F.col("user_id")])).select("user_id")
    by_user = conv.join(users, "user_id", "left_semi").select("k")
    hits = R.tagged_union({"title": by_title, "message": by_message, "user": by_user}, "k")
    return conv.join(hits, "k").select("id", F.array_join("match_types", ",").alias("match_types"))


def search_reports(spark, d):
    """Reports whose address matches, whose organisation's name or address does, or whose user (with usage) does."""
    reports = distinct_rows(spark, d, "diagnostic_reports", "url", "company_id", "user_id").select("id", "url", "user_id", ref_key(F.col("company_id")).alias("k"))
    firms = companies(spark, d, "name", "url").where(R.matches_any("software", [F.col("name"), F.col("url")])).select(ref_key(F.col("id")).alias("k"))
    users = read_table(spark, d, "user_daily_usage").where(R.matches_any("b9", [F.col("user_id")])).select("user_id")
    by_url = reports.where(R.matches_any("hub.", [F.col("url")])).select("id")
    return reports.join(firms, "k", "left_semi").select("id").union(by_url).union(reports.join(users, "user_id", "left_semi").select("id")).distinct()


def semi_diagnostic_messages(spark, d):
    linked = read_table(spark, d, "messages").where(ref_key(F.col("diagnostic_context_id")).isNotNull()).select(ref_key(F.col("conversation_id")).alias("k"))
    return distinct_rows(spark, d, "conversations").withColumn("k", ref_key(F.col("id"))).join(linked, "k", "left_semi").select("id")


def lookup_report_company(spark, d):
    firms = companies(spark, d, "name").select(ref_key(F.col("id")).alias("k"), F.col("name").alias("company_name"))
    return distinct_rows(spark, d, "diagnostic_reports", "status", "company_id").withColumn("k", ref_key(F.col("company_id"))).join(firms, "k", "left").select("id", "status", "company_name")


def lookup_message_report(spark, d):
    reports = distinct_rows(spark, d, "diagnostic_reports", "url", "overall_score").select(ref_key(F.col("id")).alias("k"), F.col("url").alias("report_url"), F.col("overall_score").alias("report_score"))
    rows = distinct_rows(spark, d, "messages", "diagnostic_context_id").withColumn("k", ref_key(F.col("diagnostic_context_id"))).where("k is not null")
    return rows.join(reports, "k", "left").select("id", "report_url", "report_score")


def conversation_rollup(spark, d):
    """Per conversation: messages, assistant messages, recommendations, distinct reports, last time; combinable aggregates only."""
    recs = F.size(R.string_list(F.col("recommended_companies")))
    rows = distinct_rows(spark, d, "messages", "conversation_id", "role", "recommended_companies", "diagnostic_context_id", "created_at").withColumn("k", ref_key(F.col("conversation_id"))).where("k is not null")
    return rows.groupBy(F.col("k").alias("conversation")).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.lower(F.trim("role")) == "assistant").alias("n_assistant"),
        F.bool_or(recs > 0).alias("has_recommendations"),
        F.sum(recs).cast("long").alias("n_recommendations"),
        F.count_distinct(ref_key(F.col("diagnostic_context_id"))).alias("n_reports"),
        F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("last_at"),
    )


def related_conversations(spark, d):
    """Conversations related to an organisation by recommendation or by its reports, with the kinds of relation."""
    rows = distinct_rows(spark, d, "messages", "conversation_id", "recommended_companies", "diagnostic_context_id").withColumn("conv", ref_key(F.col("conversation_id"))).where("conv is not null")
    recommended = rows.select("conv", F.explode(item_refs(F.col("recommended_companies"))).alias("ref")).select(F.struct(ref_key(F.col("ref")).alias("company"), "conv").alias("p")).where("p.company is not null")
    reports = distinct_rows(spark, d, "diagnostic_reports", "company_id").select(ref_key(F.col("id")).alias("r"), ref_key(F.col("company_id")).alias("company"))
    diagnosed = rows.withColumn("r", ref_key(F.col("diagnostic_context_id"))).join(reports, "r").select(F.struct("company", "conv").alias("p")).where("p.company is not null")
    return R.tagged_union({"recommended": recommended, "diagnosed": diagnosed}, "p").select("p.company", "p.conv", F.array_join("match_types", ",").alias("match_types"))


def trend_calendar(spark, d):
    parts = [read_table(spark, d, t).select("id", F.to_date("created_at").alias("day")).distinct().select(F.lit(s).alias("series"), "day") for t, s in (("company_votes", "votes"), ("diagnostic_reports", "reports"), ("conversations", "conversations"), ("messages", "messages"), ("companies", "companies"))]
    out = R.calendar(reduce(DataFrame.unionByName, parts), "day", "2025-06-01", 14, ("votes", "reports", "conversations", "messages", "companies"))
    return out.withColumn("day", F.date_format("day", "MM-dd"))


def graph_pairs(spark, d):
    """Tag pairs that follow each other in an organisation's list, with the number of organisations."""
    tags = companies(spark, d, "tags").select("id", F.posexplode(R.string_list(F.col("tags"))).alias("at", "tag"))
    after = tags.select("id", (F.col("at") - 1).alias("at"), F.col("tag").alias("to_tag"))
    return tags.join(after, ["id", "at"]).groupBy(F.col("tag").alias("from_tag"), "to_tag").agg(F.count_distinct("id").alias("n_companies"))


def table_counts(spark, d):
    out = None
    for t in ("companies", "company_votes", "diagnostic_reports", "conversations", "messages"):
        one = read_table(spark, d, t).agg(F.count_distinct("id").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def conditional_counts(spark, d):
    return companies(spark, d, "publish_status", "is_geo_certified", "pipeline_status").agg(F.count_if(F.col("publish_status") == "published").alias("published"), F.count_if(F.col("publish_status") == "draft").alias("draft"), F.count_if(F.col("is_geo_certified")).alias("certified"), F.count_if(F.col("pipeline_status") == "failed").alias("failed"), F.count(F.lit(1)).alias("total"))


def enum_counts_zero(spark, d):
    return R.enum_counts(companies(spark, d, "pipeline_status"), "pipeline_status", ("pending", "crawling", "cleaning", "graph_building", "vectorizing", "completed", "failed"))


def score_bands(spark, d):
    """Shares of the score bands in whole percents, the number scored, and the mean."""
    s = F.col("geo_score")
    rows = companies(spark, d, "geo_score", "publish_status").where("geo_score is not null and publish_status = 'published'")
    share = lambda c: F.bround(F.count_if(c) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), 0).cast("int")
    return rows.agg(share(s >= 80).alias("excellent"), share((s >= 60) & (s < 80)).alias("good"), share((s >= 40) & (s < 60)).alias("fair"), share(s < 40).alias("poor"), F.count(F.lit(1)).alias("total_scored"), F.bround(F.avg("geo_score"), 1).alias("mean_score"))


def public_score_bands(spark, d):
    return companies(spark, d, "geo_score").groupBy(band(F.col("geo_score"), ((85, "leading"), (70, "solid"), (50, "developing")), "early").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def votes_by_day(spark, d):
    return distinct_rows(spark, d, "company_votes", "created_at").where("created_at >= timestamp_ntz'2025-01-01 00:00:00'").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def view_totals(spark, d):
    return companies(spark, d, "view_count", "upvotes").agg(F.coalesce(F.sum("view_count"), F.lit(0)).alias("views"), F.coalesce(F.sum("upvotes"), F.lit(0)).cast("long").alias("upvotes"))


def type_tokens_top(spark, d):
    """The eight event types with the greatest summed value, by name among equals."""
    sums = read_table(spark, d, "events").groupBy("event_type").agg(F.bround(F.sum("value"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    return sums.orderBy(F.desc("total"), "event_type").limit(8)


def usage_groups_filtered(spark, d):
    rows = read_table(spark, d, "events").where("event_type in ('click', 'view', 'purchase') and value > 10 and ts >= timestamp_ntz'2024-01-05 00:00:00'")
    return rows.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum("value"), 2).alias("total"))


def users_history(spark, d):
    """Tokens, requests and days of each user, from the row of each day that replaces the others."""
    rows = latest_per_day(read_table(spark, d, "user_daily_usage"), "user_id", "usage_date", "updated_at", ("total_tokens", "request_count"))
    return rows.groupBy(F.col("entity").alias("user_id")).agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("request_count"), F.lit(0)).alias("requests"), F.count(F.lit(1)).alias("days"))


def usage_day_totals(spark, d, zone: str = DAY_ZONE):
    """Events added up per user and day of a time zone; an unknown zone counts as DAY_ZONE."""
    day = F.date_format(R.local_time(F.col("ts"), zone, DAY_ZONE), "yyyy-MM-dd")
    return read_table(spark, d, "events").groupBy("user_id", day.alias("usage_day")).agg(F.count(F.lit(1)).alias("requests"), F.bround(F.sum("value"), 2).alias("total"))


def category_counts(spark, d):
    return companies(spark, d, "category", "geo_score").groupBy(F.lower(F.trim(F.coalesce("category", F.lit("")))).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.bround(F.coalesce(F.avg("geo_score"), F.lit(0.0)), 1).alias("mean_score"))


def group_by_first_tag(spark, d):
    rows = companies(spark, d, "tags", "created_at").withColumn("first_tag", F.coalesce(F.try_element_at(R.string_list(F.col("tags")), F.lit(1)), F.lit("other")))
    return rows.groupBy("first_tag").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.struct("created_at", "id")).alias("first_id"))


def role_times(spark, d):
    rows = distinct_rows(spark, d, "messages", "conversation_id", "role", "created_at").where("created_at is not null")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.groupBy(ref_key(F.col("conversation_id")).alias("conversation")).agg(at(F.min("created_at")).alias("first_at"), at(F.max(F.when(F.lower(F.trim("role")) == "assistant", F.col("created_at")))).alias("last_assistant_at"))


def latest_message(spark, d):
    rows = distinct_rows(spark, d, "messages", "conversation_id", "created_at", "role").where("created_at is not null").withColumn("conversation", ref_key(F.col("conversation_id"))).where("conversation is not null")
    return R.latest(rows, ["conversation"], ["created_at", "id"], ["id", "role"])


def latest_report(spark, d):
    rows = distinct_rows(spark, d, "diagnostic_reports", "company_id", "created_at", "status", "overall_score").withColumn("company", ref_key(F.col("company_id"))).where("company is not null and created_at is not null")
    return R.latest(rows, ["company"], ["created_at", "id"], ["id", "status", "overall_score"])


def order_neighbours(spark, d):
    """Each order's previous and next order of the customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read_table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"))


def latest_in_category(spark, d):
    rows = companies(spark, d, "category", "name", "created_at").select(F.coalesce("category", F.lit("")).alias("category"), "id", "name", F.coalesce("updated_at", "created_at").alias("at"))
    return R.latest(rows, ["category"], ["at", "id"], ["id", "name"])


def keep_first_vote(spark, d):
    """The first vote of each user for each organisation; later ones are repeats."""
    votes = distinct_rows(spark, d, "company_votes", "company_id", "user_id", "created_at").withColumn("company", ref_key(F.col("company_id"))).where("company is not null")
    return votes.groupBy("company", "user_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


def vote_counts(spark, d):
    """Votes per organisation, each user once."""
    votes = read_table(spark, d, "company_votes").select(ref_key(F.col("company_id")).alias("company"), "user_id").where("company is not null").distinct()
    return votes.groupBy("company").agg(F.count(F.lit(1)).alias("votes"))


def first_n_lines(spark, d):
    """The three dearest lines of each order."""
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return R.top_per_group(lines, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 3)


def sort_score_nulls_last(spark, d):
    return R.page(companies(spark, d, "geo_score").select("id", "geo_score"), [F.desc_nulls_last("geo_score"), F.col("id")], 2, 20)


def sort_views(spark, d):
    return R.page(companies(spark, d, "view_count", "created_at").select("id", "view_count", "created_at"), [F.desc_nulls_last("view_count"), F.desc_nulls_last("created_at"), F.col("id")], 1, 50).select("id", "view_count")


def sort_status_priority(spark, d):
    rank = F.when(F.col("publish_status") == "pending_review", 0).when(F.col("publish_status") == "draft", 1).otherwise(2)
    return R.page(companies(spark, d, "publish_status").select("id", "publish_status", "updated_at"), [rank, F.desc_nulls_last("updated_at"), F.col("id")], 1, 40).select("id", "publish_status")


def recent_failures(spark, d):
    firms = companies(spark, d, "pipeline_status").where("pipeline_status = 'failed'").select(F.lit("company").alias("kind"), "id", F.col("updated_at").alias("at"))
    reports = distinct_rows(spark, d, "diagnostic_reports", "status", "created_at").where("status = 'failed'").select(F.lit("report").alias("kind"), "id", F.col("created_at").alias("at"))
    return firms.unionByName(reports).orderBy(F.desc_nulls_last("at"), "id").limit(50).select("kind", "id")


def page_summary(spark, d):
    """Totals over one page of reports, not over the whole list."""
    reports = distinct_rows(spark, d, "diagnostic_reports", "status", "overall_score", "created_at").select("id", "status", "overall_score", "created_at")
    shown = R.page(reports, [F.desc_nulls_last("created_at"), F.col("id")], 1, 50)
    return shown.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.bround(F.avg(F.nanvl("overall_score", F.lit(None).cast("double"))), 1).alias("mean_score"))


def page_totals(spark, d):
    rows = companies(spark, d, "publish_status").where("publish_status = 'published'").agg(F.count(F.lit(1)).alias("total"))
    return rows.select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / 20)).alias("pages"))


def tag_classes(spark, d):
    """Each organisation with its class: its set of tags, sorted."""
    rows = companies(spark, d, "tags").select("id", F.array_sort(F.array_distinct(R.string_list(F.col("tags")))).alias("tags"))
    return rows.where("size(tags) > 0").select("id", F.array_join("tags", "|").alias("tag_class"))


def shared_tags(spark, d):
    """How many tags organisations share, pair by pair of their classes (tag_classes has the members): every two classes with a tag in common, and the numbers of their organisations.

    Organisations with the same tags are one class, so that no pairs of organisations are made; classes
    meet by tag, in an inverted index over the distinct sets.
    """
    sets = tag_classes(spark, d).groupBy("tag_class").agg(F.count(F.lit(1)).alias("n"))
    index = sets.select("tag_class", "n", F.explode(F.split("tag_class", r"\|")).alias("tag"))
    other = index.select(F.col("tag_class").alias("other_class"), F.col("n").alias("n_other"), "tag")
    return index.join(other, "tag").where("tag_class < other_class").groupBy("tag_class", "other_class", "n", "n_other").agg(F.count(F.lit(1)).alias("n_shared"))


def structural_score(a: str, b: str) -> Column:
    """How much organisation b resembles a (column prefixes): category 28, a shared tag 14, both certified 4, near scores up to 12, and 1.2 for each search term of a found in b."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    category = F.when((x("category") == y("category")) & (x("category") != ""), 28.0).otherwise(0.0)
    tags = 14.0 * F.size(F.array_intersect(x("tag_list"), y("tag_list")))
    certified = F.when(x("is_geo_certified") & y("is_geo_certified"), 4.0).otherwise(0.0)
    near = F.when((x("geo") != 0) & (y("geo") != 0), F.greatest(F.lit(0.0), 12.0 - F.abs(x("geo") - y("geo")) / 5.0)).otherwise(0.0)
    return category + tags + certified + near + 1.2 * F.size(F.filter(x("terms"), lambda t: F.contains(y("blob"), t)))


def similar_organisations(rows: DataFrame, asked: Column, k: int = 3) -> DataFrame:
    """The k organisations most like each asked one, among all others: query, rank, id, score; ties by geo score, votes and id."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    tagged = rows.withColumn("tag_list", F.array_distinct(F.filter(F.transform(R.string_list(F.col("tags")), lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != "")))).withColumn("geo", F.nanvl(F.coalesce("geo_score", F.lit(0.0)), F.lit(0.0)))
    blob = F.concat_ws(" ", low("name"), low("category"), F.array_join("tag_list", " "), low("short_description"), low("description"), low("funding_stage"))
    every = tagged.withColumn("blob", blob).select("id", "category", "tag_list", "is_geo_certified", "geo", "upvotes", "blob")
    base = every.where(asked).withColumn("terms", query_terms(F.col("blob"))).select(*[F.col(c).alias(f"q_{c}") for c in ("id", "category", "tag_list", "is_geo_certified", "geo", "terms")])
    pairs = base.join(every, F.col("q_id") != F.col("id"))
    scored = pairs.select(F.col("q_id").alias("query"), "id", "geo", "upvotes", F.round(structural_score("q_", ""), 6).alias("score"))
    return R.top_per_group(scored, ["query"], [F.desc("score"), F.desc("geo"), F.desc(F.coalesce("upvotes", F.lit(0))), F.col("id")], k).select("query", "rank", "id", "score")


def similar_companies(spark, d):
    """The three published organisations most like each of about every hundredth one, picked by id, among all published ones."""
    rows = companies(spark, d, "publish_status", "name", "category", "tags", "short_description", "description", "funding_stage", "is_geo_certified", "geo_score", "upvotes").where("publish_status = 'published'")
    return similar_organisations(rows, F.pmod(F.crc32("id"), F.lit(100)) == 0)


def missing_types(spark, d):
    wanted = F.array(*map(F.lit, ("WebSite", "Organization", "FAQPage", "Article", "BreadcrumbList")))
    found = F.coalesce(F.from_json(F.get_json_object("schema_analysis", "$.found_types"), "array<string>"), F.array().cast("array<string>"))
    reports = distinct_rows(spark, d, "diagnostic_reports", "schema_analysis").where("schema_analysis is not null")
    return reports.select("id", F.array_join(F.array_except(wanted, found), ",").alias("missing"))


def upsert_usage(spark, d):
    """The newest row of each user and day."""
    usage = read_table(spark, d, "user_daily_usage")
    return R.latest(usage, ["user_id", "usage_date"], ["updated_at", "id"], ["id", "total_tokens", "request_count"]).withColumn("usage_date", F.date_format("usage_date", "yyyy-MM-dd"))


def insert_absent(spark, d):
    """Nations and those regions whose key no nation has as its own, as an insert of missing keys."""
    nation = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).where("key > 2")
    region = read_table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return R.insert_missing(nation, region, ["key"])


def replaced_groups(spark, d):
    """Parts with those of one brand replaced by copies at half the price."""
    part = read_table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    new = part.where("p_brand = 'Brand#11'").withColumn("p_retailprice", F.bround(F.col("p_retailprice") / 2, 2))
    return R.replace_group(part, new, "p_brand")


def anonymised_conversations(spark, d):
    """Conversations with the days and last day of their owner's usage, and the owner taken out where that user has none."""
    users = read_table(spark, d, "user_daily_usage").groupBy("user_id").agg(F.count_distinct("usage_date").alias("days"), F.date_format(F.max("usage_date"), "yyyy-MM-dd").alias("last_day"))
    return distinct_rows(spark, d, "conversations", "user_id").join(users, "user_id", "left").select("id", F.when(F.col("days").isNotNull(), F.col("user_id")).alias("user_id"), "days", "last_day")


def customer_nation_lookup(spark, d):
    """Orders per nation and status over three lookups; the small sides are joined as Spark sizes them."""
    o, c, n = (read_table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), F.bround(F.sum("o_totalprice"), 2).alias("total"))


def duplicate_fields(spark, d):
    """Values of fields meant to be unique (name, address, path key) that more than one organisation has, in lower case, with their number and least id."""
    rows = companies(spark, d, "name", "url", "path_key")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.lower(F.trim(c)).alias("value")) for c in ("name", "url", "path_key")])
    each = rows.select("id", F.inline(fields)).where("value is not null and value <> ''")
    return each.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id")).where("n > 1")


QUERIES = {f.__name__: f for f in (
    published_scan, ids_semi_scan, lookup_by_path_key, filter_equal_optional, search_two_columns, search_tags, search_many_columns, filter_tag_contained, filter_visibility, filter_has_recommendations, filter_enum, filter_half_open_day, filter_score_present, profile_missing_fields,
    project_brief, project_excerpt, search_conversations, search_reports, semi_diagnostic_messages, lookup_report_company, lookup_message_report, conversation_rollup, related_conversations, trend_calendar, graph_pairs, table_counts, conditional_counts, enum_counts_zero, score_bands, public_score_bands,
    votes_by_day, view_totals, type_tokens_top, usage_groups_filtered, users_history, usage_day_totals, category_counts, group_by_first_tag, role_times, latest_message, latest_report, order_neighbours, latest_in_category, keep_first_vote, vote_counts, first_n_lines, sort_score_nulls_last, sort_views,
    sort_status_priority, recent_failures, page_summary, page_totals, tag_classes, shared_tags, similar_companies, missing_types, upsert_usage, insert_absent, replaced_groups, anonymised_conversations, customer_nation_lookup, duplicate_fields,
)}

def _k(c: str) -> str:
    bare = f"lower(translate(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '{{}}-', ''))"
    return f"(CASE WHEN {bare} = '' OR regexp_full_match({bare}, '0+') THEN NULL ELSE {bare} END)"


_C = "(SELECT * FROM companies QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)"
_D = lambda t: f"(SELECT DISTINCT * FROM {t})"
_TAGS = lambda c: f"(CASE WHEN json_valid({c}) AND json_type({c}) = 'ARRAY' THEN from_json({c}, '[\"VARCHAR\"]') ELSE [] END)"
_T = _TAGS("tags")
_RECS = _TAGS("recommended_companies")

SQL = {
    "published_scan": f"SELECT id, name, category FROM {_C} WHERE publish_status = 'published'",
    "ids_semi_scan": f"SELECT id, name FROM {_C} WHERE publish_status = 'published' AND {_k('id')} IN (SELECT {_k('company_id')} FROM company_votes WHERE company_id IS NOT NULL)",
    "lookup_by_path_key": f"SELECT lower(path_key) AS path_key, min(id) AS id FROM {_C} WHERE length(path_key) = 5 GROUP BY 1",
    "filter_equal_optional": f"SELECT id, category, publish_status FROM {_C} WHERE publish_status = 'published' AND category = 'analytics'",
    "search_two_columns": f"SELECT id, name FROM {_C} WHERE name ILIKE '%pilot%' OR short_description ILIKE '%pilot%'",
    "search_tags": f"SELECT id, name FROM {_C} WHERE name ILIKE '%brand%' OR len(list_filter({_T}, lambda x: x ILIKE '%brand%')) > 0",
    "search_many_columns": f"SELECT id FROM {_C} WHERE concat_ws('|', name, url, category, headquarters, short_description, description, funding_stage, employee_count) ILIKE '%gu%' OR len(list_filter({_T}, lambda x: x ILIKE '%gu%')) > 0",
    "filter_tag_contained": f"SELECT id, name FROM {_C} WHERE list_contains({_T}, 'analytics')",
    "filter_visibility": f"SELECT id, CASE WHEN user_id IS NULL THEN 'public' ELSE 'owned' END AS visibility FROM {_D('conversations')}",
    "filter_has_recommendations": f"SELECT id FROM {_D('conversations')} WHERE {_k('id')} IN (SELECT {_k('conversation_id')} FROM messages WHERE len({_RECS}) > 0)",
    "filter_enum": f"SELECT id, publish_status FROM {_C} WHERE publish_status = 'draft'",
    "filter_half_open_day": f"SELECT id, company_id FROM {_D('company_votes')} WHERE created_at >= TIMESTAMP '2025-06-01' AND created_at < TIMESTAMP '2025-06-02'",
    "filter_score_present": f"SELECT id, geo_score FROM {_C} WHERE geo_score IS NOT NULL AND publish_status = 'published'",
    "profile_missing_fields": f"SELECT id, concat_ws(',', CASE WHEN trim(coalesce(description, '')) = '' AND trim(coalesce(short_description, '')) = '' THEN 'description' END, CASE WHEN trim(coalesce(category, '')) = '' THEN 'category' END, CASE WHEN len({_T}) = 0 THEN 'tags' END, CASE WHEN geo_score IS NULL THEN 'geo_score' END, CASE WHEN NOT coalesce(json_valid(geo_details), false) OR {' OR '.join(f"json_extract_string(CASE WHEN json_valid(geo_details) THEN geo_details END, '$.{k}') IS NULL" for k in ('schema', 'content', 'meta', 'citation'))} THEN 'geo_details' END) AS missing FROM {_C}",
    "project_brief": f"SELECT id, name, len({_T})::int AS n_tags, coalesce(upvotes, 0) AS upvotes FROM {_C}",
    "project_excerpt": f"SELECT id, substring(replace(regexp_replace(content, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), chr(10), ' '), 1, 120) AS excerpt FROM {_D('messages')}",
    "search_conversations": f"SELECT id, concat_ws(',', CASE WHEN m THEN 'message' END, CASE WHEN t THEN 'title' END, CASE WHEN u THEN 'user' END) AS match_types FROM (SELECT id, coalesce(title ILIKE '%budget%', false) AS t, coalesce({_k('id')} IN (SELECT {_k('conversation_id')} FROM messages WHERE content ILIKE '%budget%' AND {_k('conversation_id')} IS NOT NULL), false) AS m, coalesce(user_id IN (SELECT user_id FROM user_daily_usage WHERE user_id ILIKE '%b9%'), false) AS u FROM {_D('conversations')}) WHERE t OR m OR u",
    "search_reports": f"SELECT DISTINCT id FROM diagnostic_reports WHERE url ILIKE '%hub.%' OR {_k('company_id')} IN (SELECT {_k('id')} FROM {_C} WHERE name ILIKE '%software%' OR url ILIKE '%software%') OR user_id IN (SELECT user_id FROM user_daily_usage WHERE user_id ILIKE '%b9%')",
    "semi_diagnostic_messages": f"SELECT id FROM {_D('conversations')} WHERE {_k('id')} IN (SELECT {_k('conversation_id')} FROM messages WHERE {_k('diagnostic_context_id')} IS NOT NULL)",
    "lookup_report_company": f"SELECT r.id, r.status, c.name AS company_name FROM {_D('diagnostic_reports')} r LEFT JOIN {_C} c ON {_k('c.id')} = {_k('r.company_id')}",
    "lookup_message_report": f"SELECT m.id, r.url AS report_url, r.overall_score AS report_score FROM {_D('messages')} m LEFT JOIN {_D('diagnostic_reports')} r ON {_k('r.id')} = {_k('m.diagnostic_context_id')} WHERE {_k('m.diagnostic_context_id')} IS NOT NULL",
    "conversation_rollup": f"SELECT {_k('conversation_id')} AS conversation, count(*) AS n_messages, count(*) FILTER (lower(trim(role)) = 'assistant') AS n_assistant, bool_or(len({_RECS}) > 0) AS has_recommendations, sum(len({_RECS}))::bigint AS n_recommendations, count(DISTINCT {_k('diagnostic_context_id')}) AS n_reports, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM {_D('messages')} WHERE {_k('conversation_id')} IS NOT NULL GROUP BY 1",
    "related_conversations": f"""WITH m AS (SELECT *, {_k('conversation_id')} AS conv FROM {_D('messages')} WHERE {_k('conversation_id')} IS NOT NULL),
  p AS (SELECT {_k('ref')} AS company, conv, 'recommended' AS kind FROM (SELECT conv, json_extract_string(unnest(json_extract(CASE WHEN json_valid(recommended_companies) THEN recommended_companies ELSE '[]' END, '$[*]')), '$.company_id') AS ref FROM m) WHERE {_k('ref')} IS NOT NULL
    UNION SELECT {_k('r.company_id')}, m.conv, 'diagnosed' FROM m JOIN {_D('diagnostic_reports')} r ON {_k('r.id')} = {_k('m.diagnostic_context_id')} WHERE {_k('r.company_id')} IS NOT NULL)
  SELECT company, conv, string_agg(kind, ',' ORDER BY kind) AS match_types FROM p GROUP BY ALL""",
    "trend_calendar": "WITH g AS (SELECT unnest(generate_series(TIMESTAMP '2025-06-01', TIMESTAMP '2025-06-14', INTERVAL 1 DAY))::date AS day) SELECT strftime(day, '%m-%d') AS day, " + ", ".join(f"(SELECT count(DISTINCT id) FROM {t} x WHERE x.created_at::date = g.day) AS {s}" for t, s in (("company_votes", "votes"), ("diagnostic_reports", "reports"), ("conversations", "conversations"), ("messages", "messages"), ("companies", "companies"))) + " FROM g",
    "graph_pairs": f"WITH t AS (SELECT id, unnest({_T}) AS tag, generate_subscripts({_T}, 1) AS at FROM {_C}) SELECT a.tag AS from_tag, b.tag AS to_tag, count(DISTINCT a.id) AS n_companies FROM t a JOIN t b ON a.id = b.id AND b.at = a.at + 1 GROUP BY ALL",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(DISTINCT id) AS n FROM {t}" for t in ("companies", "company_votes", "diagnostic_reports", "conversations", "messages")),
    "conditional_counts": f"SELECT count(*) FILTER (publish_status = 'published') AS published, count(*) FILTER (publish_status = 'draft') AS draft, count(*) FILTER (is_geo_certified) AS certified, count(*) FILTER (pipeline_status = 'failed') AS failed, count(*) AS total FROM {_C}",
    "enum_counts_zero": f"SELECT v.value, count(c.id) AS n FROM (VALUES ('pending'), ('crawling'), ('cleaning'), ('graph_building'), ('vectorizing'), ('completed'), ('failed')) v(value) LEFT JOIN {_C} c ON c.pipeline_status = v.value GROUP BY 1",
    "score_bands": "SELECT " + ", ".join(f"round_even(count(*) FILTER ({c}) * 100.0 / nullif(count(*), 0), 0)::int AS {n}" for c, n in (("geo_score >= 80", "excellent"), ("geo_score >= 60 AND geo_score < 80", "good"), ("geo_score >= 40 AND geo_score < 60", "fair"), ("geo_score < 40", "poor"))) + f", count(*) AS total_scored, round_even(avg(geo_score), 1) AS mean_score FROM {_C} WHERE geo_score IS NOT NULL AND publish_status = 'published'",
    "public_score_bands": f"SELECT CASE WHEN geo_score >= 85 THEN 'leading' WHEN geo_score >= 70 THEN 'solid' WHEN geo_score >= 50 THEN 'developing' WHEN geo_score IS NOT NULL THEN 'early' END AS band, count(*) AS n FROM {_C} GROUP BY 1",
    "votes_by_day": f"SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM {_D('company_votes')} WHERE created_at >= TIMESTAMP '2025-01-01' GROUP BY 1",
    "view_totals": f"SELECT coalesce(sum(view_count), 0)::bigint AS views, coalesce(sum(upvotes), 0)::bigint AS upvotes FROM {_C}",
    "type_tokens_top": "SELECT event_type, round_even(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1 ORDER BY total DESC, event_type LIMIT 8",
    "usage_groups_filtered": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round_even(sum(value), 2) AS total FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value > 10 AND ts >= TIMESTAMP '2024-01-05' GROUP BY ALL",
    "users_history": "SELECT user_id, coalesce(sum(total_tokens), 0)::bigint AS tokens, coalesce(sum(request_count), 0)::bigint AS requests, count(*) AS days FROM (SELECT * FROM user_daily_usage WHERE user_id IS NOT NULL AND usage_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, usage_date ORDER BY updated_at DESC NULLS LAST, total_tokens DESC NULLS LAST, request_count DESC NULLS LAST) = 1) GROUP BY 1",
    "usage_day_totals": "SELECT user_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS usage_day, count(*) AS requests, round_even(sum(value), 2) AS total FROM events GROUP BY ALL",
    "category_counts": f"SELECT lower(trim(coalesce(category, ''))) AS category, count(*) AS n, round_even(coalesce(avg(geo_score), 0.0), 1) AS mean_score FROM {_C} GROUP BY 1",
    "group_by_first_tag": f"SELECT coalesce({_T}[1], 'other') AS first_tag, count(*) AS n, arg_min(id, {{'a': created_at, 'b': id}}) AS first_id FROM {_C} GROUP BY 1",
    "role_times": f"SELECT {_k('conversation_id')} AS conversation, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(created_at) FILTER (lower(trim(role)) = 'assistant'), '%Y-%m-%d %H:%M:%S') AS last_assistant_at FROM {_D('messages')} WHERE created_at IS NOT NULL GROUP BY 1",
    "latest_message": f"SELECT {_k('conversation_id')} AS conversation, id, role FROM {_D('messages')} WHERE created_at IS NOT NULL AND {_k('conversation_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_k('conversation_id')} ORDER BY created_at DESC, id DESC) = 1",
    "latest_report": f"SELECT {_k('company_id')} AS company, id, status, overall_score FROM {_D('diagnostic_reports')} WHERE created_at IS NOT NULL AND {_k('company_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_k('company_id')} ORDER BY created_at DESC, id DESC) = 1",
    "order_neighbours": "SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "latest_in_category": f"SELECT coalesce(category, '') AS category, id, name FROM {_C} QUALIFY row_number() OVER (PARTITION BY coalesce(category, '') ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST, id DESC) = 1",
    "keep_first_vote": f"SELECT {_k('company_id')} AS company, user_id, arg_min(id, {{'a': created_at, 'b': id}}) AS id FROM {_D('company_votes')} WHERE {_k('company_id')} IS NOT NULL GROUP BY 1, 2",
    "vote_counts": f"SELECT company, count(*) AS votes FROM (SELECT DISTINCT {_k('company_id')} AS company, user_id FROM company_votes) WHERE company IS NOT NULL GROUP BY 1",
    "first_n_lines": "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3",
    "sort_score_nulls_last": f"SELECT id, geo_score FROM {_C} ORDER BY geo_score DESC NULLS LAST, id LIMIT 20 OFFSET 20",
    "sort_views": f"SELECT id, view_count FROM {_C} ORDER BY view_count DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 50",
    "sort_status_priority": f"SELECT id, publish_status FROM {_C} ORDER BY CASE publish_status WHEN 'pending_review' THEN 0 WHEN 'draft' THEN 1 ELSE 2 END, updated_at DESC NULLS LAST, id LIMIT 40",
    "recent_failures": f"SELECT kind, id FROM (SELECT 'company' AS kind, id, updated_at AS at_ FROM {_C} WHERE pipeline_status = 'failed' UNION ALL SELECT 'report', id, created_at FROM {_D('diagnostic_reports')} WHERE status = 'failed') ORDER BY at_ DESC NULLS LAST, id LIMIT 50",
    "page_summary": f"SELECT count(*) AS n, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round_even(avg(CASE WHEN isnan(overall_score) THEN NULL ELSE overall_score END), 1) AS mean_score FROM (SELECT * FROM {_D('diagnostic_reports')} ORDER BY created_at DESC NULLS LAST, id LIMIT 50)",
    "page_totals": f"SELECT count(*) AS total, greatest(1, ceil(count(*) / 20))::bigint AS pages FROM {_C} WHERE publish_status = 'published'",
    "tag_classes": f"SELECT id, list_aggregate(list_sort(list_distinct({_T})), 'string_agg', '|') AS tag_class FROM {_C} WHERE len({_T}) > 0",
    "shared_tags": f"WITH s AS (SELECT list_sort(list_distinct({_T})) AS t, count(*) AS n FROM {_C} WHERE len({_T}) > 0 GROUP BY 1) SELECT list_aggregate(a.t, 'string_agg', '|') AS tag_class, list_aggregate(b.t, 'string_agg', '|') AS other_class, a.n, b.n AS n_other, len(list_intersect(a.t, b.t))::bigint AS n_shared FROM s a JOIN s b ON list_aggregate(a.t, 'string_agg', '|') < list_aggregate(b.t, 'string_agg', '|') AND list_has_any(a.t, b.t)",
    "missing_types": f"WITH r AS (SELECT id, CASE WHEN json_valid(schema_analysis) THEN coalesce(from_json(json_extract(schema_analysis, '$.found_types'), '[\"VARCHAR\"]'), []) ELSE [] END AS f FROM {_D('diagnostic_reports')} WHERE schema_analysis IS NOT NULL) SELECT id, coalesce(list_aggregate(list_filter(['WebSite', 'Organization', 'FAQPage', 'Article', 'BreadcrumbList'], lambda x: NOT list_contains(f, x)), 'string_agg', ','), '') AS missing FROM r",
    "upsert_usage": "SELECT user_id, strftime(usage_date, '%Y-%m-%d') AS usage_date, id, total_tokens, request_count FROM (SELECT DISTINCT * FROM user_daily_usage) QUALIFY row_number() OVER (PARTITION BY user_id, usage_date ORDER BY updated_at DESC NULLS LAST, id DESC) = 1",
    "insert_absent": "SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_nationkey > 2 UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey > 2)",
    "replaced_groups": "SELECT p_partkey, p_brand, CASE WHEN p_brand = 'Brand#11' THEN round_even(p_retailprice / 2, 2) ELSE p_retailprice END AS p_retailprice FROM part",
    "anonymised_conversations": f"SELECT c.id, u.user_id, u.days, u.last_day FROM {_D('conversations')} c LEFT JOIN (SELECT user_id, count(DISTINCT usage_date) AS days, strftime(max(usage_date), '%Y-%m-%d') AS last_day FROM user_daily_usage GROUP BY 1) u ON u.user_id = c.user_id",
    "customer_nation_lookup": "SELECT n_name, o_orderstatus, count(*) AS n_orders, round_even(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "duplicate_fields": f"SELECT field, value, count(*) AS n, min(id) AS least_id FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, lower(trim({c})) AS value, id FROM {_C}" for c in ("name", "url", "path_key")) + ") WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2 HAVING count(*) > 1",
}
