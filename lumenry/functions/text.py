"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script.
_SPACE = r"(?U)\s+"


def clean_text(c: Column, limit: int | None = None) -> Column:
    """White space collapsed and trimmed, optionally cut to a length; null where nothing is left."""
    bare = F.trim(F.regexp_replace(c, _SPACE, " "))
    return F.nullif(F.substring(bare, 1, limit) if limit else bare, F.lit(""))


def pick_first(*cs: Column, limit: int | None = None) -> Column:
    """The first of several texts that is not blank."""
    return F.coalesce(*[clean_text(c, limit) for c in cs])


def query_terms(c: Column) -> Column:
    """Search terms in order, once each: Latin words of two or more signs, then runs of 2 to 8 Chinese characters."""
    latin = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9][a-z0-9#+.\-]+)"), F.lit(1))
    wide = F.regexp_extract_all(c, F.lit(r"([\x{4e00}-\x{9fff}]{2,8})"), F.lit(1))
    return F.array_distinct(F.concat(latin, wide))


def token_estimate(c: Column) -> Column:
    """Estimated tokens: one per non-ASCII character and one per four ASCII characters begun; 0 for no text, else at least 1."""
    text = F.coalesce(c, F.lit(""))
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), wide + F.ceil((F.length(text) - wide) / 4).cast("int"))).cast("int")


def reading_minutes_round(characters: Column) -> Column:
    """Minutes at 450 characters each, rounded half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(F.greatest(characters, F.lit(1)) / 450).cast("int"))


def reading_minutes_floor(c: Column) -> Column:
    """Minutes at 400 characters each, rounded down, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 400).cast("int"))


# What is no prose in Markdown: code, images, links, marks and white space.
_NO_PROSE = (r"(?s)```.*?```", r"!\[[^\]]*\]\([^)]+\)", r"\[[^\]]+\]\([^)]+\)", r"[#>*`|_\-]", _SPACE)


def reading_minutes_markdown(c: Column, least: Column) -> Column:
    """Minutes at 320 characters of prose each, rounded up; code, images, links and marks are no prose. At least `least` and one."""
    prose = F.coalesce(c, F.lit(""))
    for pattern in _NO_PROSE:
        prose = F.regexp_replace(prose, pattern, "")
    return F.greatest(F.coalesce(least, F.lit(1)), F.lit(1), F.ceil(F.length(prose) / 320).cast("int"))


def slug(c: Column, limit: int = 40, default: str = "page") -> Column:
    """Lower-case ASCII letters and digits joined by hyphens, cut to a length; a default where none is left."""
    bare = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(bare, 1, limit), F.lit("")), F.lit(default))


def content_slug(c: Column, limit: int = 280) -> Column:
    """Word characters of any script kept, others replaced by hyphens, cut to a length."""
    return F.substring(F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\-]", "-"), 1, limit)


def excerpt(c: Column, limit: int = 120) -> Column:
    """Trimmed text on one line, cut to a length."""
    return F.substring(F.replace(F.regexp_replace(c, r"^[ \t\n\r]+|[ \t\n\r]+$", ""), F.lit("\n"), F.lit(" ")), 1, limit)


def paragraphs(c: Column) -> Column:
    """Paragraphs parted by blank lines, white space collapsed, empty ones left out."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\n"), lambda p: F.trim(F.regexp_replace(p, _SPACE, " ")))
    return F.filter(parts, lambda p: p != "")


def ordered_list(c: Column, limit: int, item_limit: int) -> Column:
    """Trimmed, non-empty items, each once in the order met, cut to a count and a length; repeats are told apart before they are cut."""
    items = F.filter(F.transform(c, lambda x: F.trim(F.regexp_replace(x, _SPACE, " "))), lambda x: x.isNotNull() & (x != ""))
    return F.transform(F.slice(F.array_distinct(items), 1, limit), lambda x: F.substring(x, 1, item_limit))


# Texts that stand for an unknown value.
PLACEHOLDERS = ("--", "-", "n/a", "na", "none", "null", "unknown", "待补充", "未知", "暂无")


def without_placeholder(c: Column) -> Column:
    """The trimmed text, '' if it is missing or stands for an unknown value."""
    bare = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(bare).isin(*PLACEHOLDERS), "").otherwise(bare)


# Endings and whole names that tell no firm, and signs taken off the ends of a name.
_NAME_ENDINGS = ("官方网站", "官网首页", "官网", "首页", "主页")
_NO_NAMES = ("官网", "官方网站", "首页", "主页", "关于我们", "about us")
_NAME_SIGNS = " -_|｜丨—–·•:："


def company_name(c: Column, fallback: Column) -> Column:
    """The firm's name in a page title: of its parts between bars or spaced dashes, without endings that tell no firm, the first of 2 to 60 characters; else the fallback, else the title."""
    title, other = clean_text(c, 200), clean_text(fallback, 200)

    def bare(part: Column) -> Column:
        name = F.btrim(part, F.lit(_NAME_SIGNS))
        for ending in _NAME_ENDINGS:
            name = F.when(name.endswith(ending) & (F.length(name) > len(ending)), F.rtrim(F.substring(name, F.lit(1), F.length(name) - len(ending)))).otherwise(name)
        return F.btrim(name, F.lit(_NAME_SIGNS))

    parts = F.transform(F.split(title, r"\s*[|｜丨]\s*|\s+[—–-]\s+"), bare)
    good = F.filter(parts, lambda x: F.length(x).between(2, 60) & ~F.lower(x).isin(*_NO_NAMES))
    return F.coalesce(F.try_element_at(good, F.lit(1)), other, title)


def masked(key: Column, value: Column) -> Column:
    """`***` instead of a non-empty value whose key names a secret."""
    return F.when(F.lower(key).rlike("(secret|password|passwd|token|api_?key|credential|private)") & (F.coalesce(value, F.lit("")) != ""), "***").otherwise(value)
