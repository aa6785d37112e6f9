"""Page signals from HTML: one tolerant parse per page, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenry.functions.text import reading_minutes_round

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "template"))
_CHROME = frozenset("script style nav footer noscript svg".split())
# Structured-data types that are recommended, sites that count as authorities or social, and words of calls to action.
RECOMMENDED = ("WebSite", "Organization", "FAQPage", "Article", "BreadcrumbList")
AUTHORITIES = ("arxiv.org", "scholar.google.com", "pubmed.ncbi.nlm.nih.gov", "doi.org", "ieee.org", "acm.org", "nature.com", "science.org", "wikipedia.org", "gov", "edu")
SOCIAL = ("linkedin.com", "x.com", "twitter.com", "github.com", "youtube.com", "wechat.com", "weixin.qq.com", "zhihu.com", "bilibili.com")
CALLS = ("联系", "咨询", "预约", "试用", "联系销售", "立即开始", "demo", "contact", "pricing")
_QUESTION = re.compile(r"faq|常见问题|问题|q&a", re.IGNORECASE)
META_FLAGS = ("title", "html_lang", "meta_description", "canonical", "viewport", "robots", "favicon", "og_title", "og_description", "og_image", "og_type", "og_locale", "twitter_card")
PREVIEW_FLAGS = ("title", "meta_description", "og_title", "og_description", "og_image", "twitter_card")


class _Page(HTMLParser):
    """Elements with their texts. A paragraph ends where another block begins; unclosed elements end with the page."""

    _ENDS_P = frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 section article header footer nav form blockquote pre".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, dict[str, str], list[str]]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.texts: list[tuple[str, frozenset[str]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self._ENDS_P and any(t == "p" for t, _ in self.open):
            self._close("p")
        own: list[str] = []
        self.found.append((tag, {k: v or "" for k, v in reversed(attrs)}, own))
        if tag not in _VOID:
            self.open.append((tag, own))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close(tag)

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        inside = frozenset(t for t, _ in self.open)
        if inside & _SILENT:
            self.open[-1][1].append(data)
            return
        self.texts.append((data, inside))
        for _, own in self.open:
            own.append(data)


def _parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _joined(parts: list[str]) -> str:
    return " ".join(x for x in (" ".join(p.split()) for p in parts) if x)


def _nodes(value: object) -> list[dict]:
    out, todo = [], [value]
    while todo:
        v = todo.pop(0)
        if isinstance(v, list):
            todo[:0] = v
        elif isinstance(v, dict):
            out.append(v)
            if isinstance(v.get("@graph"), (dict, list)):
                todo.insert(0, v["@graph"])
    return out


def _declared(page: _Page) -> dict:
    """Raw facts of structured data: the types of all nodes in order, and the number of blocks."""
    types, blocks = [], 0
    for tag, attrs, own in page.found:
        if (tag, attrs.get("type", "").lower()) != ("script", "application/ld+json"):
            continue
        blocks += 1
        try:
            nodes = _nodes(json.loads("".join(own)))
        except (ValueError, RecursionError):
            nodes = []
        types += [named.strip() for node in nodes for named in np.ravel(np.array(node.get("@type"), dtype=object)) if isinstance(named, str) and named.strip()]
    return {"types": types, "blocks": blocks}


def _present(page: _Page) -> dict:
    """Raw facts of the head: which of META_FLAGS the page has, and lengths of its title and description."""
    have: dict[str, str] = {}
    title, described = None, None
    names = {"description": "meta_description", "viewport": "viewport", "robots": "robots", "twitter:card": "twitter_card"} | {f"og:{k}": f"og_{k}" for k in ("title", "description", "image", "type", "locale")}
    for tag, attrs, own in page.found:
        if tag == "title" and title is None:
            title = _joined(own)
            have["title"] = title
        elif tag == "html":
            have.setdefault("html_lang", attrs.get("lang", ""))
        elif tag == "meta":
            for kind in ("name", "property"):
                flag = names.get(attrs.get(kind, "").lower())
                if flag and flag.startswith("og_") == (kind == "property") and flag not in have:
                    have[flag] = attrs.get("content", "")
                    described = have[flag] if flag == "meta_description" else described
        elif tag == "link":
            for word in attrs.get("rel", "").lower().split():
                if word == "canonical" or "icon" in word:
                    have.setdefault("canonical" if word == "canonical" else "favicon", attrs.get("href", ""))
    return {"present": [k for k in META_FLAGS if have.get(k, "").strip()], "title_length": len(title or ""), "description_length": len(described or "")}


def _body(page: _Page) -> dict:
    """Raw facts of the body: how often each element occurs, and lengths and texts that scores need."""
    count = Counter(tag for tag, _, _ in page.found)
    text = _joined([d for d, _ in page.texts])
    images = [bool(a.get("alt", "").strip()) for tag, a, _ in page.found if tag == "img"]
    said = [(tag, _joined(own)) for tag, _, own in page.found if tag in ("p", "h1", "h2", "h3", "h4", "a", "button")]
    return {
        **{f"{t}_count": count[t] for t in ("h1", "h2", "h3")}, "paragraph_count": count["p"], "list_count": count["ul"] + count["ol"], "table_count": count["table"], "image_count": len(images), "image_with_alt_count": sum(images),
        "word_count": len(text.split()), "character_count": len("".join(text.split())), "first_paragraph": next((len(t) for tag, t in said if tag == "p"), 0),
        "faq_sections": sum(bool(_QUESTION.search(t)) for tag, t in said if tag[0] == "h"), "cta_count": sum(any(w in t.lower() for w in CALLS) for tag, t in said if tag in ("a", "button")),
        "hrefs": [a["href"] for tag, a, _ in page.found if tag == "a" and "href" in a],
    }


FACTS = (
    "types array<string>, blocks int, present array<string>, title_length int, description_length int, h1_count int, h2_count int, h3_count int, paragraph_count int, list_count int, table_count int, image_count int, image_with_alt_count int, "
    "word_count int, character_count int, first_paragraph int, faq_sections int, cta_count int, hrefs array<string>"
)


def page_facts(html: Column) -> Column:
    """What a page holds, as one struct (FACTS), from one tolerant parse; null and empty pages give the facts of an empty page."""

    def run(pages: pd.Series) -> pd.DataFrame:
        parsed = map(_parse, pages)
        return pd.DataFrame([_declared(p) | _present(p) | _body(p) for p in parsed], columns=[x.split()[0] for x in FACTS.split(", ")])

    run.__annotations__ = {"pages": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, FACTS)(html)


def _percent(part: Column, whole: Column | int) -> Column:
    """A whole number of percents, rounded half to even."""
    return F.bround(100.0 * part / whole, 0).cast("int")


def _steps(value: Column, *steps: tuple[int, int]) -> Column:
    """The points of the highest step that a value reaches, 0 below all."""
    out = F.lit(0)
    for least, points in sorted(steps):
        out = F.when(value >= least, points).otherwise(out)
    return out


def page_signals(url: Column, html: Column) -> Column:
    """All signals of a page as one struct: structured data, metadata, content, citations, each with its score in 0..100.

    Every page is parsed once in Python for its facts; scores are JVM expressions over them. Null
    and empty pages give the signals of an empty page; markup is taken as tolerantly as it comes, a
    paragraph ending where another block begins. Only absolute links count, as internal if the
    page's host is part of theirs.
    """
    f = page_facts(html)
    words = lambda values: F.array(*map(F.lit, values))
    types = F.array_distinct(f["types"])
    coverage = _percent(F.size(F.array_intersect(types, words(RECOMMENDED))), len(RECOMMENDED))
    alt = F.when(f["image_count"] > 0, _percent(f["image_with_alt_count"], F.greatest(f["image_count"], F.lit(1)))).otherwise(100)
    points = lambda ok, n: F.when(ok, n).otherwise(0)
    content = (
        points(f["h1_count"] == 1, 20) + points(f["h2_count"] >= 2, 20) + points(f["first_paragraph"] > 80, 20) + points(f["character_count"] > 800, 20)
        + points(alt >= 60, 10) + points((f["faq_sections"] >= 1) | (f["list_count"] >= 2), 10)
    )
    host = lambda link: F.lower(F.regexp_extract(link, r"^(?i:https?)://([^/?#]+)", 1))
    base = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    absolute = F.filter(f["hrefs"], lambda x: host(x) != "")
    own = lambda x: (base != "") & F.contains(host(x), base)
    outer = F.filter(absolute, lambda x: ~own(x))
    of = lambda sites: F.filter(outer, lambda x: F.exists(words(sites), lambda s: F.contains(host(x), s)))
    n_outer, n_inner, authority, social = F.size(outer), F.size(absolute) - F.size(outer), of(AUTHORITIES), of(SOCIAL)
    citation = F.least(F.lit(100), _steps(n_outer, (1, 20), (3, 40)) + _steps(F.size(authority), (1, 20), (2, 40)) + points((n_outer >= 10) | (n_inner >= 12), 20))
    preview = F.size(F.array_intersect(f["present"], words(PREVIEW_FLAGS)))
    signals = {
        "found_types": types, "missing_recommended": F.array_except(words(RECOMMENDED), types), "schema_count": f["blocks"], "coverage_ratio": coverage, "schema_score": F.least(F.lit(100), F.greatest(16 * F.size(types), coverage)),
        "has_faq": F.array_contains(types, "FAQPage"), "has_org": F.arrays_overlap(types, words(("Organization", "WebSite"))),
        "meta_missing": F.array_except(words(META_FLAGS), f["present"]), "title_length": f["title_length"], "description_length": f["description_length"], "meta_score": _percent(F.size(f["present"]), len(META_FLAGS)), "preview_score": _percent(preview, len(PREVIEW_FLAGS)),
        **{c: f[c] for c in ("h1_count", "h2_count", "h3_count", "paragraph_count", "list_count", "table_count", "image_count", "image_with_alt_count")}, "image_alt_ratio": alt,
        "word_count": f["word_count"], "character_count": f["character_count"], "reading_minutes": reading_minutes_round(f["character_count"]), "faq_sections": f["faq_sections"], "cta_count": f["cta_count"], "first_paragraph": f["first_paragraph"], "content_score": content,
        "external_links": n_outer, "internal_links": n_inner, "authority_link_count": F.size(authority), "social_link_count": F.size(social), "authority_links": F.slice(authority, 1, 5), "social_links": F.slice(social, 1, 5), "citation_score": citation,
    }
    return F.struct(*[c.alias(name) for name, c in signals.items()])


def visible_text(html: Column, limit: int | None = None) -> Column:
    """Text outside scripts, styles, navigation and footers on one line, whole or cut to `limit` characters."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: _joined([d for d, inside in _parse(h).texts if not inside & _CHROME])[:limit])

    run.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(html)


def profile_from_page(html: Column) -> Column:
    """title, description and tags (meta keywords, parted at commas, slashes and bars, 24 characters, 6 at most) of a page."""

    def run(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for h in pages:
            page = _parse(h)
            meta = {a.get("name", "").lower(): a.get("content", "") for t, a, _ in reversed(page.found) if t == "meta"}
            tags = [t.strip()[:24] for t in re.split(r"[,，/|]", meta.get("keywords", "")) if t.strip()]
            rows.append({"title": next((_joined(own) for t, _, own in page.found if t == "title"), ""), "description": " ".join(meta.get("description", "").split()), "tags": list(dict.fromkeys(tags))[:6]})
        return pd.DataFrame(rows, columns=["title", "description", "tags"])

    run.__annotations__ = {"pages": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "title string, description string, tags array<string>")(html)


# Elements that are removed with all they hold, elements and attributes that are kept, and kinds of images that may stand in an address.
_DROPPED = frozenset("script style iframe object embed link meta base form input button textarea select".split())
_ALLOWED = frozenset("a abbr blockquote br code dd del details div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr img ins kbd li ol p pre s span strong sub summary sup table tbody td th thead tr ul".split())
_ANYWHERE = frozenset("class id title aria-label aria-hidden".split())
_KEPT = {"a": frozenset("href target rel".split()), "img": frozenset("src alt width height loading".split()), "td": frozenset("colspan rowspan align".split()), "th": frozenset("colspan rowspan align scope".split())}
_IMAGES = "png jpeg jpg gif webp svg+xml x-icon vnd.microsoft.icon".split()
_INLINE = re.compile("data:image/(?:" + "|".join(map(re.escape, _IMAGES)) + ");")


class _Cleaner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.dropped = 0
        self.open: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _DROPPED:
            self.dropped += tag not in _VOID
        elif not self.dropped and tag in _ALLOWED:
            kept = {k: v or "" for k, v in attrs if k in _ANYWHERE | _KEPT.get(tag, frozenset()) and (k not in ("href", "src") or _safe(v or "", k))}
            if tag == "a" and kept.get("href"):
                kept["rel"] = "noopener noreferrer"
            self.out.append("<" + tag + "".join(f' {k}="{_escaped(v)}"' for k, v in kept.items()) + ">")
            if tag not in _VOID:
                self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROPPED:
            self.dropped = max(0, self.dropped - (tag not in _VOID))
        elif not self.dropped and tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.out.append(_escaped(data))


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _safe(value: str, attribute: str) -> bool:
    """Whether an address may stay: a relative one, one for the web, mail or telephone, or, as a source, an image."""
    bare = re.sub(r"\s+", "", value).lower()
    kind = bare.partition(":")[0]
    if kind == "data":
        return attribute == "src" and bool(_INLINE.match(bare))
    if not bare or kind in ("javascript", "vbscript"):
        return False
    return "://" not in bare or kind in ("http", "https", "mailto", "tel")


def _sanitized(html: str | None) -> str:
    cleaner = _Cleaner()
    cleaner.feed(html or "")
    cleaner.close()
    return "".join(cleaner.out) + "".join(f"</{t}>" for t in reversed(cleaner.open))


def sanitized(html: Column) -> Column:
    """HTML without dangerous elements and their content, unknown elements and attributes, and unsafe addresses; links get a fixed rel."""
    run = lambda pages: pages.map(_sanitized)
    return F.pandas_udf(run, "string")(html)


def _headings(html: str | None) -> list[dict]:
    seen: dict[str, int] = {}
    out = []
    for tag, _, own in _parse(html).found:
        if tag in ("h2", "h3"):
            text = _joined(own)
            base = re.sub(r"[\s_]+", "-", re.sub(r"[^\w\s-]", "", text.lower()).strip()) or "section"
            seen[base] = seen.get(base, 0) + 1
            out.append({"level": int(tag[1]), "text": text, "anchor": base if seen[base] == 1 else f"{base}-{seen[base]}"})
    return out


def headings(html: Column) -> Column:
    """Level, text and anchor of the second- and third-level headings; equal anchors get -2, -3 and so on."""
    run = lambda pages: pages.map(_headings)
    return F.pandas_udf(run, "array<struct<level:int,text:string,anchor:string>>")(html)


def article_summary(html: Column, limit: int = 140) -> Column:
    """Text of the first paragraph or list item that has one, else all text, cut to a length."""

    def summary(h: str | None) -> str:
        page = _parse(h)
        return (next((t for tag, _, own in page.found if tag in ("p", "li") and (t := _joined(own))), "") or _joined([d for d, _ in page.texts]))[:limit]

    return F.pandas_udf(lambda pages: pages.map(summary), "string")(html)
