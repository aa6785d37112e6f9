"""Whether a text stops where sentences stop: counts of word sequences at ends and in the middle of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word, a number, one Chinese character, the end of a sentence or line, or another mark.
_TOKEN = re.compile(r"\x1d|<br\s*/?>|[^\W\d_一-鿿]+(?:['’-][^\W\d_]+)*|\d+|[一-鿿]|[.!?…]+(?=\s|$|[\"”»)<'])|[。！？]|\n|[^\w\s]")
_STOP = re.compile(r"<br|[.!?…。！？\n]")
_TAGS = re.compile(r"(?:\s|<[^<>]{0,40}>|​)+$")
#: Signs that stand for text left out.
_CUT_SIGNS = re.compile(r"(?:\s*(?:…|\.{2,}|\[(?:more|\.\.\.|…)\]|�|(?:…|\.{3})\s*(?:read more|show more|see more|more|mehr lesen|mehr anzeigen|mehr|weiterlesen|leer más|ver más|lire la suite|voir plus|更多|查看更多|阅读全文|展开|全文)))+$", re.IGNORECASE)
_MARKED = re.compile(r"(?:[.!?…。！？;:][\"'”’»」』)\]）*_~`]*|[)\]）”»」』]|[:;]-?[()DP])$")
# Words with which people close a text, without a mark.
_SIGN_OFF = re.compile(r"(?:^|[.!?…。！？)\]>]\s*|\n\s*)(?:greetings|(?:best |kind |warm )?regards|cheers|(?:many )?thanks|thank you|saludos|un saludo|gracias|(?:viele |liebe |beste )?grüße|gruß|danke|cordialement|salutations|merci|谢谢|此致|祝好)$", re.IGNORECASE)
_EMOJI = re.compile(r"[☀-➿⭐️\U0001f000-\U0001faff]$")
#: Counter entries a task keeps before it sends them on.
FLUSH = 300_000
#: Weight, in occurrences, of what the shorter sequences say about a longer one, and the share of ends assumed of a word never seen.
BACKING, PRIOR = 2.0, 0.1
#: Lengths of the counted sequences, in words and in Chinese characters.
WORDS, CHARS = (3, 2, 1), (6, 4, 2)


_SEAM = "\x1d"
_MIX, _BOS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)
_WORD, _STOPS, _OTHER, _END, _DOTS = 0, 1, 2, 3, 4
#: What follows a word: the end of a sentence or line, something else, the end of a text of one sentence, or of another text, or dots
#: (which may stand for text left out, so that they prove neither).
ENDS, GOES_ON, WHOLE, BARE, DOTTED = 0, 1, 2, 3, 4
_LEFT_OUT = re.compile(r"…|\.{2,}")


def _kind(token: str) -> int:
    return _END if token == _SEAM else _DOTS if _LEFT_OUT.match(token) else _STOPS if _STOP.match(token) else _WORD if token[0].isalnum() else _OTHER


def scan(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word of the texts: number of its text, what follows, its three sequences' hashes, whether each is a whole sentence.

    The texts are split in one go and hashed as arrays. Sequences that would reach over the
    beginning of a sentence start with a mark for it.
    """
    found = _TOKEN.findall((_SEAM.join(t.replace(_SEAM, " ") for t in texts) + _SEAM).lower())
    codes, names = pd.factorize(np.array(found, dtype=object))
    kinds = np.fromiter(map(_kind, names), np.int8, len(names))[codes]
    hashes = np.fromiter((xxhash.xxh64_intdigest("0" if t.isdigit() else t.encode("utf-8", "replace")) for t in names), np.uint64, len(names))
    chinese = np.fromiter(("一" <= t <= "鿿" for t in names), bool, len(names))
    at = np.flatnonzero(kinds == _WORD)
    text = np.cumsum(kinds == _END)[at]
    sentence = np.cumsum((kinds == _STOPS) | (kinds == _END) | (kinds == _DOTS))[at]
    first = np.r_[True, sentence[1:] != sentence[:-1]] if len(at) else np.zeros(0, bool)
    place = np.arange(len(at))
    place = place - np.maximum.accumulate(np.where(first, place, 0)) if len(at) else place
    # the next token that is a word, a stop or the end of the text; other marks in between change nothing but the middle
    marks = np.flatnonzero(kinds != _OTHER)
    after = kinds[marks[np.searchsorted(marks, at, side="right")]] if len(at) else at
    opening = np.r_[True, text[1:] != text[:-1]] if len(at) else first
    only = (sentence == sentence[np.maximum.accumulate(np.where(opening, np.arange(len(at)), 0))]) if len(at) else first
    follows = np.select([after == _STOPS, after == _WORD, after == _DOTS, only], [ENDS, GOES_ON, DOTTED, WHOLE], BARE)
    h = hashes[codes[at]]

    def sequences(n: int) -> np.ndarray:
        out = np.full(len(h), np.uint64(n))
        for back in reversed(range(n)):
            term = np.r_[np.zeros(min(back, len(h)), np.uint64), h[: max(0, len(h) - back)]]
            mixed = (out ^ term) * _MIX
            mixed ^= mixed >> np.uint64(31)
            begun = (out ^ _BOS) * _MIX
            out = np.where(place >= back, mixed, np.where(place == back - 1, begun, out))
        return out

    wide = chinese[codes[at]]
    grams = np.stack([np.where(wide, sequences(c), sequences(w)) for c, w in zip(CHARS, WORDS, strict=True)], axis=1).view(np.int64) if len(at) else np.zeros((0, 3), np.int64)
    whole = np.stack([place < np.where(wide, c, w) - 1 for c, w in zip(CHARS, WORDS, strict=True)], axis=1) if len(at) else np.zeros((0, 3), bool)
    return text, follows, grams, whole


def ending_counts(texts: DataFrame, column: str) -> DataFrame:
    """(gram, n_end, n_mid, n_last): how often each word sequence precedes an end of sentence or line, another word, or the bare end of a text.

    Bare ends are counted only for sequences that are a whole text, such as
    short titles, since a limit that cuts many texts would make the pieces it leaves look like ends;
    dots prove neither an end nor a middle. All texts count in full. Tasks add up their counts before
    the shuffle, so frequent sequences cost one row per task and batch of counts. Null and empty
    texts add nothing.
    """
    names = ("n_end", "n_mid", "n_last")

    def merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts, ignore_index=True).groupby("gram", as_index=False, sort=False).sum()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []
        for pdf in frames:
            _, follows, grams, whole = scan(pdf["text"].tolist())
            kept = ((follows == ENDS) | (follows == GOES_ON))[:, None] | ((follows == WHOLE)[:, None] & whole)
            what = np.broadcast_to(follows[:, None], grams.shape)[kept]
            codes, found = pd.factorize(grams[kept])
            parts.append(pd.DataFrame({"gram": found} | {c: np.bincount(codes[what == w], minlength=len(found)) for c, w in zip(names, (ENDS, GOES_ON, WHOLE), strict=True)}))
            if sum(map(len, parts)) > FLUSH:
                parts = [merged(parts)]
                if len(parts[0]) > FLUSH:
                    yield parts.pop()
        if parts:
            yield merged(parts)

    rows = texts.where(F.col(column).isNotNull()).select(F.col(column).alias("text")).mapInPandas(count, "gram long, n_end long, n_mid long, n_last long")
    return rows.groupBy("gram").agg(*[F.sum(c).alias(c) for c in names])


_BROKEN = re.compile(r"(?:<[^<>\s]{0,12}|&[a-z#0-9]{0,6})$", re.IGNORECASE)


def is_short(bare: str) -> bool:
    """Whether a text is no longer than a title of four words or eight Chinese characters."""
    return len(bare) <= 40 and len(re.findall(r"[^\W\d_一-鿿]+|\d+", bare)) + len(re.findall(r"[一-鿿]", bare)) / 2 <= 4


def _stripped(text: str) -> str:
    """The text without white space and markup at its end."""
    bare = text.rstrip()
    while bare[-1:] in (">", "\u200b"):
        cut = _TAGS.sub("", bare[-200:])
        if len(cut) == len(bare[-200:]):
            break
        bare = (bare[:-200] + cut).rstrip()
    return bare


def bare_end(text: str) -> tuple[str, bool, str]:
    """(text without trailing markup and signs of omission, whether that ends with a final mark, the signs)."""
    bare, signs = _stripped(text), ""
    tail = bare[-120:]
    if m := _BROKEN.search(tail):
        return bare[: len(bare) - len(m.group())], False, m.group()
    if m := _CUT_SIGNS.search(tail):
        signs, bare = m.group().strip(), _stripped(bare[: len(bare) - len(m.group())])
        tail = bare[-120:]
    return bare, bool(_MARKED.search(tail) or _EMOJI.search(tail) or _SIGN_OFF.search(tail)), signs


def last_grams(bares: Sequence[str]) -> list[list[int]]:
    """For each text the hashes of the sequences at its end, longest first; none if it holds no word at its end."""
    tails = [b if len(b) <= 400 else b[-400:].partition(" ")[2] or b[-400:] for b in bares]
    text, follows, grams, _ = scan(tails)
    out: list[list[int]] = [[] for _ in bares]
    for i in np.flatnonzero((follows == WHOLE) | (follows == BARE)):
        out[text[i]] = grams[i].tolist()
    return out


def end_likelihood(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, likelihood) for rows (key, grams) of texts that end in the sequences: the share of ends among the occurrences of the last words.

    The share starts from that of the next shorter sequence, which weighs as much as BACKING
    occurrences, and the shortest one's from PRIOR, so that no number of occurrences is a threshold.
    The text's own bare end does not count. AQE splits frequent sequences; `counts` has one row for
    each.
    """
    each = candidates.select("key", F.posexplode("grams").alias("level", "gram"))
    joined = each.join(counts, "gram", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    ends = n("n_end") + F.greatest(n("n_last") - 1, F.lit(0))
    scored = joined.select("key", "level", ends.alias("ends"), (ends + n("n_mid")).alias("total"))
    at = scored.groupBy("key").agg(*[F.max(F.when(F.col("level") == i, F.struct("ends", "total"))).alias(f"l{i}") for i in range(len(WORDS))])
    q = F.lit(PRIOR)
    for i in reversed(range(len(WORDS))):
        q = (F.col(f"l{i}.ends") + BACKING * q) / (F.col(f"l{i}.total") + BACKING)
    return at.select("key", q.alias("likelihood"))
