"""Evaluation texts inside a training corpus, found by winnowed fingerprints and extended to passages."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.sources.stage import staged

#: Tokens of a fingerprinted sequence, and sequences of a window: a shared run of GRAM + WINDOW - 1 tokens is never missed.
GRAM, WINDOW = 4, 2
#: Texts of fewer tokens than this are looked for as a whole, since a window may drop their only sequence.
SHORT = GRAM + WINDOW - 1
#: Least passage, in words and in Chinese characters.
WORDS, CHARS = 15, 25
#: Tokens of a run that a passage is put together from, and of a change within it.
RUN, CHANGE = 3, 4
#: Least share of a passage's tokens, of those of a passage under twice the least length, and of their weight, that must be there:
#: about one word in eight may be changed, but phrases that many items share fill much of a short passage.
SHARE, SHORT_SHARE, WEIGHT = 0.8, 0.88, 0.7
#: Least share of a passage's rare tokens that must be there.
RARE = 0.6
#: Fingerprints of the evaluation side up to which they are sent to all tasks, 16 bytes each; beyond that they are joined.
SENT = 2_000_000
_TOKEN = re.compile(r"[一-鿿぀-ヿ가-힯]|[^\W_一-鿿぀-ヿ가-힯]+(?:['’][^\W_]+)?")
_MARKUP = re.compile(r"<[^<>]{0,200}>|&[a-zA-Z]{2,8};|&#\d{1,6};")


def tokens(text: str) -> list[str]:
    """Words and single Chinese, Japanese or Korean characters in lower case, without markup and layout."""
    return _TOKEN.findall(unicodedata.normalize("NFKC", _MARKUP.sub(" ", text)).lower())


@lru_cache(maxsize=200_000)
def _token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token)


def _sequences(words: list[str], n: int) -> np.ndarray:
    """The hash of every sequence of n tokens."""
    h = np.fromiter(map(_token_hash, words), np.uint64, len(words))
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + count]
        out ^= out >> np.uint64(29)
    return out


def fingerprints(words: list[str]) -> np.ndarray:
    """Distinct winnowed hashes: of each window of sequences the least, as signed 64-bit numbers.

    A text shorter than a sequence has none; one shorter than a window has its least sequence.
    """
    grams = _sequences(words, GRAM)
    if len(grams) > WINDOW:
        grams = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).min(axis=1)
    return np.unique(grams).view(np.int64)


def whole_prints(words: list[str], lengths: Iterable[int]) -> np.ndarray:
    """Distinct hashes of all sequences of the given lengths, apart from those of fingerprints."""
    parts = [_sequences(words, n) ^ np.uint64(0xD6E8FEB86659FD93 * n % 2**64) for n in lengths]
    return np.unique(np.concatenate(parts)).view(np.int64) if parts else np.empty(0, np.int64)


def item_prints(words: list[str]) -> np.ndarray:
    """Hashes of an evaluation text: its fingerprints, or the one of the whole text if that is shorter than SHORT."""
    return fingerprints(words) if len(words) >= SHORT else whole_prints(words, (len(words),))


def _runs(doc: list[str], item: list[str]) -> list[tuple[int, int, int]]:
    """Maximal common runs (place in doc, place in item, length) of at least RUN tokens."""
    at: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for i in range(len(item) - RUN + 1):
        at[tuple(item[i : i + RUN])].append(i)
    open_: dict[int, list[int]] = {}
    runs = []
    for j in range(len(doc) - RUN + 1):
        for i in at.get((doc[j], doc[j + 1], doc[j + 2]), ()):
            r = open_.get(j - i)
            if r is not None and r[0] + r[2] - RUN + 1 == j:
                r[2] += 1
            else:
                r = open_[j - i] = [j, i, RUN]
                runs.append(r)
    return [tuple(r) for r in runs]


def _between(doc: list[str], item: list[str], d0: int, d1: int, i0: int, i1: int) -> list[int]:
    """Places of item[i0:i1] whose tokens also stand, in order, in doc[d0:d1]."""
    out = []
    for i in range(i0, i1):
        for j in range(d0, d1):
            if doc[j] == item[i]:
                out.append(i)
                d0 = j + 1
                break
    return out


def best_passage(doc: list[str], item: list[str], weights: list[float], rare: list[bool]) -> tuple[int, float]:
    """(length, share) of the item's longest passage that the document holds well enough; (0, 0) if none.

    Runs are chained in the order of both texts; at most CHANGE item tokens may differ between two
    runs, while any text of the document may come between. A passage must have the least length (or
    be the item), SHARE of its tokens, WEIGHT of their weight, and RARE of its rare tokens, so that
    phrases which many items share make no case; without a rare token it must be complete. An item
    of fewer than SHORT tokens must stand in the document as it is.
    """
    if len(item) < SHORT:
        return (len(item), 1.0) if any(doc[j : j + len(item)] == item for j in range(len(doc) - len(item) + 1)) else (0, 0.0)
    cjk = sum("一" <= t <= "鿿" for t in item)
    need = min(len(item), CHARS if 2 * cjk > len(item) else WORDS)
    runs = sorted(_runs(doc, item), key=lambda r: (r[1], r[0]))
    best = (0, 0.0)
    if sum(r[2] for r in runs) < SHARE * need * 0.6:
        return best
    total, scarce = [0.0], [0]
    for w, r in zip(weights, rare, strict=True):
        total.append(total[-1] + w)
        scarce.append(scarce[-1] + r)
    # of the best chain that ends in a run: (merit, first place in the item, matched tokens, their weight, rare ones)
    ends: list[tuple[float, int, int, float, int]] = []
    longest = max((r[2] for r in runs), default=0)
    for n, (d, i, length) in enumerate(runs):
        chosen = (float(length), i, length, total[i + length] - total[i], scarce[i + length] - scarce[i])
        for m in range(n - 1, -1, -1):
            before, start, size = runs[m]
            gap = i - (start + size)
            if i - start > longest + CHANGE:
                break
            over = max(0, -gap, before + size - d)
            if gap > CHANGE or over >= length - 1 or d < before:
                continue
            merit, first, matched, weight, few = ends[m]
            lo = i + over
            extra = _between(doc, item, before + size, min(d + over, before + size + CHANGE + 2), start + size, lo) if gap > 0 else []
            got = length - over + len(extra)
            worth = merit + got - 1.5 * max(0, gap - len(extra)) - (d - (before + size) > CHANGE + 4)
            if worth > chosen[0]:
                chosen = (worth, first, matched + got, weight + total[i + length] - total[lo] + sum(weights[x] for x in extra), few + scarce[i + length] - scarce[lo] + sum(rare[x] for x in extra))
        ends.append(chosen)
        _, first, matched, weight, few = chosen
        span, all_rare = i + length - first, scarce[i + length] - scarce[first]
        if span >= need and span > best[0]:
            enough = few >= RARE * all_rare if all_rare else matched == span
            if matched >= (SHARE if span >= 2 * need else SHORT_SHARE) * span and weight >= WEIGHT * (total[i + length] - total[first]) and enough:
                best = (span, matched / span)
    return best


def evaluation_side(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, words, weights, rare): tokens of each evaluation text with their weight among these texts.

    The weight falls with the number of texts of the same script (Chinese, Japanese and Korean, or
    another) that hold the token; rare ones are in at most 6 in a hundred of them, or in two. Null and empty texts are left out; of repeated keys one text counts.
    """
    split = F.pandas_udf(lambda s: s.map(lambda t: tokens(t or "")), "array<string>")
    rows = items.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("item")).agg(F.max(text).alias("text")).select("item", split("text").alias("words")).where("size(words) > 0")
    rows = rows.withColumn("wide", F.size(F.filter("words", lambda w: w.rlike("^[一-鿿぀-ヿ가-힯]$"))) * 2 > F.size("words"))
    all_ = rows.groupBy("wide").agg(F.count(F.lit(1)).alias("of"))
    each = rows.select("item", "wide", F.posexplode("words").alias("at", "word"))
    known = each.groupBy("wide", "word").agg(F.count_distinct("item").alias("n")).join(all_, "wide")
    weight, rare = F.log((F.col("of") + 1) / F.col("n")) + 0.05, F.col("n") <= F.greatest(F.lit(2), F.floor(F.col("of") * 0.06))
    weighed = each.join(known, ["wide", "word"]).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "word", weight.alias("weight"), rare.alias("rare")))).alias("w"))
    return weighed.select("item", F.col("w.word").alias("words"), F.col("w.weight").alias("weights"), F.col("w.rare").alias("rare"))


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows, last, words = [], None, []
        for doc, text, item, own, weights, rare in zip(pdf["doc"], pdf["text"], pdf["item"], pdf["words"], pdf["weights"], pdf["rare"], strict=True):
            if last != doc:
                last, words = doc, tokens(text)
            length, share = best_passage(words, list(own), list(weights), list(rare))
            if length:
                rows.append((doc, item, length, share))
        yield pd.DataFrame(rows, columns=["doc", "item", "length", "share"])


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, item, length, share): each document that holds an evaluation text or a passage of it, whatever its layout or case.

    Both sides are fingerprinted by winnowing, so that every shared run of GRAM + WINDOW - 1 tokens
    is met, and documents and items with a common fingerprint are held against each other word by
    word, over their whole texts; items shorter than that are met by the hash of all their tokens. If the evaluation side has at most SENT fingerprints they go to
    every task, so that the corpus is read once and not shuffled; otherwise both sides are joined
    by fingerprint, and the document texts by key. Null and empty texts hold nothing.
    """
    side = staged(evaluation_side(items, item_key, text))
    prints = side.select("item", F.explode(F.pandas_udf(lambda s: s.map(lambda w: item_prints(list(w)).tolist()), "array<long>")("words")).alias("print"))
    short = F.size("words")
    lengths = sorted(r.n for r in side.where(short < SHORT).select(short.alias("n")).distinct().collect())  # at most SHORT - 1 numbers
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_key).cast("long").alias("doc"), F.col(text).alias("text"))
    sent = prints.limit(SENT + 1).toPandas()
    if len(sent) <= SENT:
        sent = sent.sort_values("print")
        table = docs.sparkSession.sparkContext.broadcast((sent["print"].to_numpy(), sent["item"].to_numpy()))

        def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, of = table.value
            for pdf in frames:
                hits = []
                for t in pdf["text"]:
                    words = tokens(t)
                    own = np.concatenate([fingerprints(words), whole_prints(words, lengths)])
                    low, high = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
                    some = np.flatnonzero(high > low)
                    hits.append(np.unique(np.concatenate([of[low[i] : high[i]] for i in some])).tolist() if len(some) else [])
                found = pdf.assign(items=hits)
                yield found[found["items"].str.len() > 0]

        pairs = texts.mapInPandas(met, "doc long, text string, items array<long>").select("doc", "text", F.explode("items").alias("item"))
    else:
        def prints_of(text: str) -> list[int]:
            words = tokens(text)
            return np.concatenate([fingerprints(words), whole_prints(words, lengths)]).tolist()

        own = F.pandas_udf(lambda s: s.map(prints_of), "array<long>")
        met_ = texts.select("doc", F.explode(own("text")).alias("print")).join(prints, "print").select("doc", "item").distinct()
        pairs = met_.join(texts, "doc")
    return pairs.join(side, "item").select("doc", "text", "item", "words", "weights", "rare").mapInPandas(_verified, "doc long, item long, length int, share double")
