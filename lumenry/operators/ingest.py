"""From a site's pages to candidate links, page choice, text and profile."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenry.functions import urls
from lumenry.functions.html import visible_text
from lumenry.functions.text import clean_text
from lumenry.operators.relational import top_per_group

# Endings of addresses that are no pages.
ASSETS = ("jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "pdf", "zip", "xml", "json", "txt", "css", "js")


def candidate_links(anchors: DataFrame, limit: int = 12) -> DataFrame:
    """(base_url, rank, url, title, path) of a site's shallow pages from its anchors (base_url, pos, url, title).

    Addresses are normalised; kept are those of the base's host, other than the base, no deeper than
    one step and no asset, each once, the first `limit` by position. Anchors whose base or address
    is not valid drop out.
    """
    rows = anchors.select(urls.normalize_url(F.col("base_url")).alias("base_url"), "pos", urls.normalize_url(F.col("url")).alias("url"), "title").where("base_url is not null and url is not null and url <> base_url")
    path = urls.url_path(F.col("url"))
    near = rows.where(urls.same_host(F.col("base_url"), F.col("url")) & (urls.path_depth(path) <= 1) & ~F.lower(path).rlike(r"\.(" + "|".join(ASSETS) + ")$"))
    first = near.groupBy("base_url", "url").agg(F.min(F.struct("pos", "title")).alias("m"))
    ranked = top_per_group(first, ["base_url"], [F.col("m.pos"), F.col("url")], limit)
    return ranked.select("base_url", "rank", "url", urls.anchor_title(F.col("m.title"), F.col("url")).alias("title"), F.coalesce(F.nullif(urls.url_path(F.col("url")), F.lit("")), F.lit("/")).alias("path"))


def chosen_pages(links: DataFrame, weights: Mapping[str, float], limit: int = 3) -> DataFrame:
    """(base_url, place, url, role): the home page, then the links with the greatest weight, at most `limit` together.

    A link's weight adds those of the words in its address and title, less four per step of its
    path; the earlier link wins a tie. weights is a bounded parameter.
    """
    text = F.lower(F.concat_ws(" ", "url", "title"))
    score = sum((F.when(F.contains(text, F.lit(w)), float(v)).otherwise(0.0) for w, v in weights.items()), F.lit(0.0)) - 4.0 * urls.path_depth(F.col("path"))
    best = top_per_group(links.withColumn("score", score), ["base_url"], [F.desc("score"), F.col("rank")], limit - 1, "place")
    pages = best.select("base_url", (F.col("place") + 1).alias("place"), "url", urls.page_role(F.col("url"), F.col("title")).alias("role"))
    home = links.select("base_url").distinct().select("base_url", F.lit(1).alias("place"), F.col("base_url").alias("url"), F.lit("homepage").alias("role"))
    return home.unionByName(pages)


def source_text(pages: DataFrame, site: str, limit: int = 8000) -> DataFrame:
    """(site, text): the visible text of a site's pages (site, pos, key, role, title, url, status, html) in order, each under a line that names it.

    Failed pages, repeated keys and pages without text are left out. A site has few pages by the
    choice made before.
    """
    fine = pages.where(F.coalesce(F.col("status") != "failed", F.lit(True)) & F.col("key").isNotNull())
    first = fine.groupBy(site, "key").agg(F.min(F.struct("pos", "role", "title", "url", "html")).alias("p"))
    body = first.select(site, F.col("p.pos").alias("pos"), "p.role", "p.title", "p.url", visible_text(F.col("p.html"), limit).alias("body")).where("body <> ''")
    head = F.concat(F.lit("[页面 "), F.coalesce(clean_text(F.col("role")), F.lit("supporting")), F.lit(" | "), F.coalesce(clean_text(F.col("title")), F.lit("未命名页面")), F.lit(" | "), F.coalesce(clean_text(F.col("url")), F.lit("未知地址")), F.lit("]\n"))
    parts = body.select(site, "pos", F.concat(head, F.col("body")).alias("part"))
    return parts.groupBy(site).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n\n").alias("text"))


def founded_on(text: Column) -> Column:
    """A date from `YYYY-MM-DD` or `YYYY-MM` (its first day); null for other text."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd"))


def merged_profile(old: DataFrame, new: DataFrame, key: str, fields: list[str], replace: bool) -> DataFrame:
    """Profiles with the fields of new filled in: everywhere if `replace` (missing ones become null), else where new has a value."""
    fresh = new.select(key, *[clean_text(F.col(c)).alias(f"_{c}") for c in fields], F.lit(True).alias("_new"))
    joined = old.join(fresh, key, "left")
    return joined.select(key, *[(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) if replace else F.coalesce(f"_{c}", c)).alias(c) if c in fields else F.col(c) for c in old.columns if c != key])


def rule_recommendations(s: Column) -> Column:
    """What to mend first in a page, from its signals: at most three lines, the most urgent first."""
    lines = F.array(
        F.when(s["schema_score"] < 40, "add structured data"), F.when(F.array_contains(s["meta_missing"], "title"), "add a title"), F.when(F.array_contains(s["meta_missing"], "meta_description"), "add a description"),
        F.when(s["h1_count"] != 1, "use one main heading"), F.when(s["h2_count"] < 2, "add subheadings"), F.when(s["citation_score"] < 40, "link to sources"), F.when(s["image_alt_ratio"] < 60, "describe the images"),
    )
    return F.slice(F.filter(lines, lambda x: x.isNotNull()), 1, 3)


def curated_order(articles: DataFrame, chapters: DataFrame, listed: DataFrame) -> DataFrame:
    """Articles (slug, chapter, at) with chapter_index and article_index from two order tables (chapter, idx) and (slug, idx), 999 where unlisted, and their neighbours.

    previous and next follow (chapter_index, article_index, at, slug) within a chapter.
    """
    rows = articles.join(chapters.select("chapter", F.col("idx").alias("c")), "chapter", "left").join(listed.select("slug", F.col("idx").alias("a")), "slug", "left")
    rows = rows.select("slug", "chapter", F.coalesce("c", F.lit(999)).alias("chapter_index"), F.coalesce("a", F.lit(999)).alias("article_index"), "at")
    w = Window.partitionBy("chapter").orderBy("article_index", "at", "slug")
    return rows.withColumns({"previous": F.lag("slug").over(w), "next": F.lead("slug").over(w)})


def without_chapter_links(markdown: Column) -> Column:
    """Markdown without the lines that name the previous or next article."""
    lines = F.split(F.trim(F.coalesce(markdown, F.lit(""))), "\n")
    return F.trim(F.array_join(F.filter(lines, lambda x: ~F.trim(x).rlike("^(下一篇|上一篇)《")), "\n"))
