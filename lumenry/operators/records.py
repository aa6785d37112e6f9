"""Operators on records: lookups by identifier, JSON items and redaction, graph and vector payloads, deletes, batches."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.functions.scores import stable_score
from lumenry.functions.text import clean_text, without_placeholder
from lumenry.operators.relational import latest, string_list, top_per_group

# Parts of names of keys whose values are secret.
SECRETS = ("password", "secret", "token", "apikey", "authorization", "cookie", "credential", "privatekey")


def find_by_identifier(asked: DataFrame, rows: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """(identifier, id): the row that an identifier names by the first of several keys, in order; the least id among equal ones.

    asked has `identifier`, rows `id` and whatever the keys use, each a column or null. One join by
    the key's text serves all keys. Null identifiers find nothing.
    """
    forms = F.array(*[F.struct(F.lit(i).alias("nth"), k.cast("string").alias("key")) for i, k in enumerate(keys.values())])
    index = rows.select("id", F.inline(forms)).where("key is not null").groupBy("nth", "key").agg(F.min("id").alias("id"))
    found = asked.select("identifier").distinct().join(index, F.lower("identifier") == F.col("key"))
    return found.groupBy("identifier").agg(F.min(F.struct("nth", "id")).alias("m")).select("identifier", "m.id")


def object_list(c: Column) -> Column:
    """The items of a JSON list, or of the list `items` of an object, as text; empty for null, invalid or other JSON."""
    return string_list(F.when(F.ltrim(c).startswith("{"), F.get_json_object(c, "$.items")).otherwise(c))


def item_refs(c: Column, key: str = "company_id") -> Column:
    """The references in a list of object_list: the key's value of an object, or the text itself; items without one are left out."""
    return F.filter(F.transform(object_list(c), lambda x: F.when(x.startswith("{"), F.get_json_object(x, f"$.{key}")).otherwise(x)), lambda x: x.isNotNull() & (F.trim(x) != ""))


def keyword_union(*values: Column, limit: int = 20, without: Column | None = None) -> Column:
    """Texts and lists of texts in one list: without placeholders and repeats, in order, cut to a count."""
    each = F.flatten(F.array(*values))
    kept = F.filter(F.transform(each, without_placeholder), lambda x: (x != "") & (F.lit(True) if without is None else ~F.coalesce(x == without, F.lit(False))))
    return F.slice(F.array_distinct(kept), 1, limit)


def sanitized_items(items: DataFrame, blocked: Sequence[str], limit: int = 10) -> DataFrame:
    """(pack, dimension, rank, keyword, recommendation, business, reason) of generated items (pack, dimension, seed, raw), where raw is a JSON list of objects.

    Keywords (`keyword` or `kw`) have their white space collapsed; blank, repeated and blocked ones
    drop out. Scores are whole numbers brought into 35..99; a missing, zero or bad one becomes the
    stable score. Keywords are cut to 80 characters, reasons to 120, a dimension to `limit` items.
    """
    raw = items.select("pack", "dimension", "seed", F.posexplode(object_list(F.col("raw"))).alias("at", "x"))
    get = lambda *names: F.coalesce(*[F.get_json_object("x", f"$.{n}") for n in names])
    rows = raw.withColumn("keyword", clean_text(get("keyword", "kw"))).where("keyword is not null")
    for term in blocked:
        rows = rows.where(~F.contains(F.lower("keyword"), F.lit(term)))
    first = rows.withColumn("rec", get("recommendation_score", "rec")).withColumn("biz", get("business_score", "biz")).withColumn("reason", F.substring(F.nullif(F.trim(get("reason")), F.lit("")), 1, 120))
    once = first.groupBy("pack", "dimension", "keyword").agg(F.min(F.struct("at", "seed", "rec", "biz", "reason")).alias("m"))
    score = lambda c, suffix, base, spread: F.greatest(F.lit(35), F.least(F.lit(99), F.coalesce(F.nullif(F.col(f"m.{c}").try_cast("int"), F.lit(0)), stable_score(F.col("m.seed"), F.concat("dimension", F.lit(suffix)), F.col("keyword"), base, spread))))
    ranked = top_per_group(once, ["pack", "dimension"], [F.col("m.at")], limit)
    return ranked.select("pack", "dimension", "rank", F.substring("keyword", 1, 80).alias("keyword"), score("rec", "", 60, 28).alias("recommendation"), score("biz", "-biz", 58, 26).alias("business"), F.col("m.reason").alias("reason"))


def checked_choice(choices: DataFrame, links: DataFrame, limit: int = 3) -> DataFrame:
    """(base_url, place, url, role): chosen pages (base_url, at, url, role) that are the home page or among a site's links (base_url, url), each once.

    At most `limit` by position; the home page is put first where it was not chosen, and a site none
    of whose choices holds has no rows.
    """
    allowed = links.select("base_url", "url").unionByName(links.select("base_url", F.col("base_url").alias("url"))).distinct()
    once = choices.where("url is not null").join(allowed, ["base_url", "url"], "left_semi").groupBy("base_url", "url").agg(F.min(F.struct("at", "role")).alias("m"))
    kept = top_per_group(once, ["base_url"], [F.col("m.at"), F.col("url")], limit, "nth").select("base_url", "nth", "url", F.coalesce("m.role", F.lit("supporting")).alias("role"))
    missing = kept.groupBy("base_url").agg(F.bool_or(F.col("url") == F.col("base_url")).alias("has")).where("not has").select("base_url", F.lit(0).alias("nth"), F.col("base_url").alias("url"), F.lit("homepage").alias("role"))
    return top_per_group(kept.unionByName(missing), ["base_url"], [F.col("nth")], limit, "place").select("base_url", "place", "url", "role")


def homepage_key(pages: Column, fallback: Column) -> Column:
    """The key of the first page (array of role, key) that is the home page and has one, else the fallback."""
    return F.coalesce(F.try_element_at(F.filter(pages, lambda p: (p["role"] == "homepage") & (F.coalesce(p["key"], F.lit("")) != "")), F.lit(1))["key"], fallback)


def public_pages(pages: Column) -> Column:
    """Pages (array of title, url, key, status) that were captured, have a key, and a title that is no placeholder or a web address."""
    told = lambda c: without_placeholder(c) != ""
    return F.filter(pages, lambda p: F.coalesce((p["status"] == "captured") & told(p["key"]) & (told(p["title"]) | without_placeholder(p["url"]).rlike("^https?://")), F.lit(False)))


def _stringify(value: object) -> str:
    todo, out = [value], []
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            v = list(v.values())
        if isinstance(v, list):
            todo += [x for x in reversed(v) if x]
        elif v is not None:
            out.append(v if isinstance(v, str) else str(v))
    return " ".join(out)


def _from_json(text: str | None) -> object:
    try:
        return json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None


def stringified(c: Column) -> Column:
    """All texts and numbers in a JSON value, at any depth, joined by blanks; empty and zero values are left out. '' for null or invalid JSON."""
    run = lambda s: s.map(lambda t: _stringify(_from_json(t)))
    return F.pandas_udf(run, "string")(c)


def _redact(value: object) -> object:
    holder = [value]
    todo: list = [holder]
    while todo:
        box = todo.pop()
        for k in list(box) if isinstance(box, dict) else range(len(box)):
            if isinstance(k, str) and any(s in "".join(filter(str.isalnum, k.casefold())) for s in SECRETS):
                box[k] = "[REDACTED]"
            elif isinstance(box[k], (dict, list)):
                todo.append(box[k])
    return holder[0]


def redacted(c: Column) -> Column:
    """JSON with the values of keys that name a secret, at any depth, replaced; null for null or invalid JSON."""

    def run(s: pd.Series) -> pd.Series:
        parsed = s.map(_from_json)
        return pd.Series([None if v is None else json.dumps(_redact(v), ensure_ascii=False) for v in parsed], dtype=object)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(c)


def settings_map(settings: DataFrame) -> DataFrame:
    """One row with a map of the public settings (key, value, is_public) whose key names no secret; settings are a bounded table of the configuration."""
    bare = F.regexp_replace(F.lower("key"), "[^a-z0-9]", "")
    open_ = settings.where(F.col("is_public") & ~reduce(Column.__or__, [F.contains(bare, F.lit(s)) for s in SECRETS]))
    return open_.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))


def rotated(items: Column, start: Column | int) -> Column:
    """A list that begins at another element (counted from 0, modulo its length) and goes on from the front."""
    at = F.pmod(F.lit(start) if isinstance(start, int) else start, F.greatest(F.size(items), F.lit(1)))
    return F.concat(F.slice(items, at + 1, F.greatest(F.size(items), F.lit(1))), F.slice(items, F.lit(1), at))


def name_uuid(name: Column) -> Column:
    """The name-based UUID (version 5, URL namespace) of a text."""
    # Fixed value: the namespace of addresses.
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (company_id, name, type): those of new, each name of an organisation once (its least type), in place of all that old has of its organisations."""
    fresh = new.groupBy("company_id", "name").agg(F.min("type").alias("type"))
    return old.join(fresh.select("company_id").distinct(), "company_id", "left_anti").select("company_id", "name", "type").unionByName(fresh)


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (company_id, src, type, dst) of both, each once."""
    return old.select("company_id", "src", "type", "dst").unionByName(new.select("company_id", "src", "type", "dst")).distinct()


def graph_pattern(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(company_id, src, src_type, type, dst, dst_type): edges with both their nodes; edges without one drop out."""
    of = lambda end: nodes.select("company_id", F.col("name").alias(end), F.col("type").alias(f"{end}_type"))
    return edges.join(of("src"), ["company_id", "src"]).join(of("dst"), ["company_id", "dst"]).select("company_id", "src", "src_type", "type", "dst", "dst_type")


def accumulate(daily: DataFrame, events: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Daily totals (keys, amount, requests) with the events (keys, amount) added, one request each; combined before the shuffle."""
    both = daily.select(*keys, amount, "requests").unionByName(events.select(*keys, amount, F.lit(1).cast("long").alias("requests")))
    return both.groupBy(*keys).agg(F.sum(amount).alias(amount), F.sum("requests").alias("requests"))


def without_records(tables: Mapping[str, DataFrame], gone: DataFrame, dropped: Mapping[str, str], detached: Mapping[str, str]) -> dict[str, DataFrame]:
    """Tables after a delete: rows that refer to a gone id (one column, `id`) by a column of `dropped` are removed, those by a column of `detached` lose the reference."""
    out = dict(tables)
    for name, c in dropped.items():
        out[name] = out[name].join(gone.select(F.col("id").alias(c)).distinct(), c, "left_anti").select(*tables[name].columns)
    for name, c in detached.items():
        marked = out[name].join(gone.select(F.col("id").alias(c), F.lit(True).alias("_gone")).distinct(), c, "left")
        out[name] = marked.withColumn(c, F.when(F.col("_gone").isNull(), F.col(c))).select(*tables[name].columns)
    return out


def decremented(counts: DataFrame, removed: DataFrame, key: str, column: str) -> DataFrame:
    """counts with its column lessened by the rows of removed (key), never below 0."""
    less = removed.groupBy(key).agg(F.count(F.lit(1)).alias("_less"))
    return counts.join(less, key, "left").withColumn(column, F.greatest(F.lit(0), F.coalesce(column, F.lit(0)) - F.coalesce("_less", F.lit(0)))).select(*counts.columns)


def swept(reservations: DataFrame, as_of: Column) -> DataFrame:
    """Pending reservations (id, status, expires_at, used) that are past due: `charged` with what was used, or `released`."""
    due = reservations.where((F.col("status") == "pending") & (F.col("expires_at") <= as_of))
    used = F.coalesce("used", F.lit(0))
    return due.select("id", F.when(used > 0, "charged").otherwise("released").alias("status"), used.alias("charged"))


def merged_rows(rows: DataFrame, groups: DataFrame, key: str, sums: Sequence[str], order: str) -> DataFrame:
    """Rows of equal class (groups: node, component) as one: its component, summed columns, and the key of the row with the greatest order value."""
    classed = rows.join(groups.select(F.col("node").alias(key), "component"), key, "left").withColumn("component", F.coalesce("component", key))
    newest = latest(classed, ["component"], [order, key], [key]).withColumnRenamed(key, "newest")
    return classed.groupBy("component").agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("n")).join(newest, "component")
