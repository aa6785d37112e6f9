"""Defects of prompt-response pairs."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.llm.dialog import is_empty_text, ordered_messages, with_previous
from lumenry.llm.endings import bare_end, end_likelihood, ending_counts, last_grams
from lumenry.sources.stage import staged

#: Defects, the first of which names a pair that shows several.
DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
#: An unmarked end less likely than this is abrupt.
UNLIKELY = 0.15

# Phrases with which answers decline, by language.
_REFUSALS = {
    "en": r"(?:i(?:'m| am) (?:very |so |really )?sorry,? but i|i (?:can(?:'t|not| not)|could not|won't|will not|am not able to|am unable to|must not|may not|do not want to|don't want to|prefer not to|would prefer not|have to (?:decline|refuse|pass)|must (?:decline|refuse|pass)))\b|\b(?:won't|not) be able to (?:assist|help|answer|comply|discuss)|rather not (?:comment|say|discuss|answer)|guidelines do not (?:let|allow|permit)|policy (?:does not|doesn't|forbids)|must not (?:give|provide|offer)|not able to (?:answer|help|assist|discuss|comply)|nothing i can (?:share|say|offer|do)|not be appropriate|requests like this|no comment on|told not to|(?:have|has) to decline|not (?:allowed|permitted) to|can(?:'t|not) (?:say|help|assist|discuss|comply|answer|provide|share|talk|comment|support)|unable to (?:help|assist|answer|comply|provide|discuss)|against (?:my|our) (?:rules|policy|guidelines)|refuse to (?:answer|help)|not something (?:i|we)(?:'m| am| are| can)|outside what (?:i|we)(?:'m| am| are| can)|is off limits|blocked for me",
    "de": r"leider (?:muss|kann|darf)|(?:kann|darf|möchte|werde|will) ich (?:\w+ ){0,4}(?:nicht|keine)|darf ich nicht|muss ich passen|nicht gestattet|nicht erlaubt|sage ich nichts|gebe ich (?:\w+ )?keine|keine auskunft|ablehnen|gesperrt|nicht (?:helfen|beantworten|äußern|weiterhelfen|behandeln|besprechen)|außerhalb meiner vorgaben|(?:meine )?(?:richtlinien|vorgaben) (?:erlauben|lassen|verbieten)|untersagt|verboten|kein kommentar|nichts,? (?:sagen|mitteilen|was ich)|unpassend|steht mir nicht zu",
    "es": r"no (?:puedo|debo|podré|podemos|me es posible|quiero|doy|ofrezco|voy a)|no me está permitido|no tengo permiso|(?:debo|tengo que) (?:negarme|rechazar|declinar)|vedad[oa]|prefiero no|sin comentarios|no sería (?:apropiado|adecuado|correcto)|mis normas|queda fuera|me (?:han pedido|piden) que no|no hay nada que|prohibid[oa]|no (?:está|estoy) (?:permitido|autorizad)|bloquead[oa]s? para mí|nada (?:que decir|que pueda|puedo)",
    "fr": r"je ne (?:peux|puis|donne|donnerai|dois|veux|suis|saurais|pourrai|fournis|commente)|il m'est (?:interdit|impossible)|m'est (?:fermé|interdit|impossible)|m'est pas (?:permis|possible)|préfère ne pas|dois (?:\w+ )?(?:refuser|décliner)|rien le droit|pas le droit|de mon cadre|mes (?:règles|consignes)|aucun commentaire|pas de commentaire|ne serait pas (?:approprié|convenable|correct)|rien (?:à|que je puisse) (?:dire|partager)|on m'a demandé de ne pas|pas autorisé|bloquées? pour moi",
    "zh": r"无法|不能(?:回答|讨论|提供|协助|帮助|评论|谈)|不便|不予|不提供|没有权限|拒绝|无权|被限制|已被限制|受限|恕|不可以(?:回答|讨论|提供)|不允许|超出了允许|不合适|不方便|不宜|不适合|谢绝|不作(?:评论|回答)|没有(?:什么)?(?:可以|能|可)",
}
#: The phrases, for texts in lower case.
_REFUSAL = {lang: re.compile(p) for lang, p in _REFUSALS.items()} | {"": re.compile("|".join(f"(?:{p})" for p in _REFUSALS.values()))}
#: Sentences that decline often add, which give no help either.
_CLOSER = re.compile(r"please (?:contact|consult|ask|see)|qualified|adviser|advisor|professional|anything else|something else|other topic|another question|sorry|apolog|fachperson|sonst (?:etwas|noch)|wenden sie sich|etwas anderes|tut mir leid|profesional|otra cosa|otro tema|lo siento|spécialiste|professionnel|autre chose|autre sujet|désolé|专业|别的|其他问题|抱歉|对不起", re.IGNORECASE)
#: Signs that a sentence goes on to help after all.
_BUT = re.compile(r"\b(?:but the|still,? the|however|nevertheless|even so|instead|here is|here are|the following|aber der|aber die|trotzdem|dennoch|hier ist|folgende|pero el|pero la|sin embargo|aquí tienes|mais le|mais la|cependant|toutefois|voici)\b|但是?(?:报告|下面|以下)|不过|下面是|以下是", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+")
#: Margin of words by which a language counts as known.
KNOWN = 2.5
#: Least share of characters that a copy has in common with the question, and lengths up to which two texts are aligned character by character at once.
COPIED, ALIGNED = 0.88, 2000

# Frequent words that tell the languages apart.
_WORDS = {
    "en": "the of to and for is in that with it our should which how what can you are was on not by every if or before your this an from at least so be has would we who does there any will about when why",
    "de": "der die das und für ist ein eine einen wir unsere unser unserer unseren nicht mit den dem auf sie was wie bei von zu sich kann alle jede so oder aber noch wird werden haben ihre ihnen warum welche uns lohnt dazu zum zur im am bitte als ich gut sind",
    "es": "el los las de que y para una un con en por del al qué cómo nuestra nuestro más se lo es son sin como pero su sus está bien sí cuánto cada muy hay al tenemos escribe cuesta porque primero",
    "fr": "le les des et pour est une un avec dans que du nous notre sur quel quelle comment au aux il faut vous ce cette qui pas plus chaque en la toutes combien pourquoi rédige merci doit doivent ne je mais ou où c'est d'un d'une",
}
_SETS = {lang: frozenset(ws.split()) for lang, ws in _WORDS.items()}
_MARKS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "ñ": "es", "¿": "es", "¡": "es", "í": "es", "ó": "es", "ú": "es", "ç": "fr", "è": "fr", "ê": "fr", "à": "fr", "œ": "fr", "ù": "fr", "â": "fr", "î": "fr", "ô": "fr", "û": "fr"}
_LATIN = re.compile(r"[a-zà-öø-ÿœ]+(?:['’][a-zà-öø-ÿœ]+)?")
_SCRIPTS = (("zh", re.compile(r"[一-鿿]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힯]")))
# Language names in requests for a language.
_NAMES = {
    "en": r"english|englisch|inglés|anglais|英语|英文",
    "de": r"german|deutsch|alemán|allemand|德语|德文",
    "es": r"spanish|spanisch|español|espagnol|castellano|西班牙语|西班牙文",
    "fr": r"french|französisch|francés|français|法语|法文",
    "zh": r"chinese|mandarin|chinesisch|chino|chinois|中文|汉语|华语",
}
_ASKS = {lang: re.compile(rf"(?:answer|reply|respond|write|translate|response|in|auf|ins|übersetz\w*|antwort\w*|en|al|responde\w*|contesta\w*|traduc\w*|répond\w*|traduis\w*|用|以|译成|翻译成|成)\s*(?:the |in |into |auf |ins |en |al |à |, )?(?:{p})", re.IGNORECASE) for lang, p in _NAMES.items()}
_QUOTE = re.compile(r"^[\s\"'“”„«»‘’「」『』>*_]*(?:(?:so )?(?:your|the|my)?\s*question(?: is| was)?|you (?:asked|ask)|question|frage|ihre frage|pregunta|tu pregunta|votre question|问题|您的问题|你的问题|q)\s*(?:is|ist|es|est|是)?\s*[:：]\s*", re.IGNORECASE)
_KEEP = re.compile(r"[^\w]+|_+")
_SOLID = re.compile(r"[^\W_]")
_URL_END = re.compile(r"https?://[^\s/]+\.[^\s]+$")
_ITEM_ONLY = re.compile(r"\n\s*(?:[-*•]|\d+[.)]|\(?[a-z][.)])\s*$")


def language(text: str) -> tuple[str, float]:
    """(language, margin over the next one) by script, else by frequent words and letters; ('', 0) if nothing tells."""
    low = text.lower()
    if not low.isascii():
        letters = sum(map(str.isalpha, low))
        for lang, script in _SCRIPTS:
            n = len(low) - len(script.sub("", low))
            if n and n >= 0.25 * letters:
                return lang, float(n)
    words = _LATIN.findall(low)
    score = {lang: float(sum(map(own.__contains__, words))) for lang, own in _SETS.items()}
    if not low.isascii():
        for c, lang in _MARKS.items():
            score[lang] += 0.7 * low.count(c)
    first, second = sorted(score.values(), reverse=True)[:2]
    return (max(score, key=score.get), first - second) if first > second else ("", 0.0)


def _anchors(a: str, b: str) -> list[tuple[int, int, int]]:
    """Places (in a, in b, length) of short sequences that each text holds once, in rising order in both."""
    best: list[tuple[int, int, int]] = []
    for k in (6, 12, 24):
        once: dict[str, int] = {}
        for i in range(len(a) - k + 1):
            once[a[i : i + k]] = -1 if a[i : i + k] in once else i
        there: dict[str, int] = {}
        for j in range(len(b) - k + 1):
            there[b[j : j + k]] = -1 if b[j : j + k] in there else j
        met = sorted((i, there[g], k) for g, i in once.items() if i >= 0 and there.get(g, -1) >= 0)
        tails: list[int] = []
        at: list[int] = []
        back: list[int] = []
        for n, (_, j, _) in enumerate(met):  # longest rising run of places in b
            p = bisect_left(tails, j)
            tails[p : p + 1], at[p : p + 1] = [j], [n]
            back.append(at[p - 1] if p else -1)
        run, n = [], at[-1] if at else -1
        while n >= 0:
            run.append(met[n])
            n = back[n]
        if len(run) > len(best):
            best = run[::-1]
    return best


def _common(a: str, b: str) -> int:
    """Characters two texts have in common, in order; long texts are parted at sequences that each holds once."""
    if min(len(a), len(b)) == 0:
        return 0
    if max(len(a), len(b)) <= ALIGNED:
        return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    found, i0, j0 = 0, 0, 0
    for i, j, k in _anchors(a, b):
        if i < i0 or j < j0:  # overlaps the one before
            over = max(i0 - i, j0 - j)
            if i0 - i == j0 - j and over < k:
                found, i0, j0 = found + k - over, i + k, j + k
            continue
        if max(i - i0, j - j0) <= ALIGNED:
            found += _common(a[i0:i], b[j0:j])
        found, i0, j0 = found + k, i + k, j + k
    return found + (_common(a[i0:], b[j0:]) if max(len(a) - i0, len(b) - j0) <= ALIGNED else 0)


def _same(question: str, answer: str) -> bool:
    """Whether the answer is the question again, once or more, perhaps quoted, in other case or with small slips."""
    if 3 * len(answer) < len(question):
        return False
    if len(answer) > 2 * len(question) + 60 and len(set(answer.lower().split())) > 2 * len(question.split()) + 8:
        return False  # the question over and over would have few words of its own
    q, a = _KEEP.sub("", question.lower()), _KEEP.sub("", _QUOTE.sub("", answer).lower())
    if len(q) < 4 or not a:
        return False
    times = max(1, round(len(a) / len(q)))
    if not 0.85 * len(q) * times <= len(a) <= 1.15 * len(q) * times + 2:
        return False
    q = q * times
    if a == q:
        return True
    # no more can be in common than the characters both have, wherever they stand
    if 2 * sum((Counter(q) & Counter(a)).values()) < COPIED * (len(q) + len(a)):
        return False
    return 2 * _common(q, a) >= COPIED * (len(q) + len(a))


def _refuses(answer: str, lang: str) -> bool:
    """Whether the answer, in a language (or '' if unknown), only declines.

    One sentence may stand before the one that declines; every later one must decline, too, or be one that refusals often add.
    """
    refusal = _REFUSAL.get(lang) or _REFUSAL[""]
    text = answer.strip().lower()
    first = _SENTENCE.split(text, maxsplit=3)[:3]  # two sentences tell most answers
    if sum(map(bool, map(_SOLID.search, first))) >= 2 and not any(map(refusal.search, first)):
        return False
    parts = [p for p in _SENTENCE.split(text) if _KEEP.sub("", p)]
    declines = [bool(refusal.search(p)) and not _BUT.search(p) for p in parts]
    first = next((i for i, x in enumerate(declines) if x), len(parts))
    return first < len(parts) and first <= 1 and all(d or _CLOSER.search(p) for d, p in zip(declines[first:], parts[first:], strict=True))


def _other_language(question: str, lang: str, margin: float) -> bool:
    """Whether an answer in a language, known by a margin, is in another one than the question, which did not ask for it."""
    if not lang or margin < KNOWN:
        return False
    ql, qm = language(question)
    return bool(ql) and ql != lang and qm >= 0.9 and not (lang in _ASKS and _ASKS[lang].search(question))


# Delimiters that come in pairs.
_PAIRS = {")": "(", "）": "（", "]": "[", "】": "【", "}": "{", "」": "「", "』": "『", "》": "《", "”": "“"}
_OPENERS = re.compile(r"[(（\[【{「『《“]")
_DELIMITER = re.compile(r"[:;]-?[()]|[(（\[【{「『《“)）\]】}」』》”]")


def _open(answer: str) -> bool:
    """Whether a code fence, list item, bracket or typographic quote is left open, wherever it begins.

    Delimiters are matched by a stack; a closing one without an opening one, as in `1)`, counts for
    nothing, and one that closes an outer pair closes what is open inside.
    """
    prose = answer
    if "```" in answer:
        if answer.count("```") % 2:
            return True
        prose = re.sub(r"```.*?```", "", answer, flags=re.DOTALL)
    last = prose.rstrip().rfind("\n")
    if last > 0 and _ITEM_ONLY.match(prose[last:]):
        return True
    if not _OPENERS.search(prose):
        return False
    german = prose.count("„")
    stack: list[str] = []
    for mark in _DELIMITER.findall(prose):
        if mark in _PAIRS:
            if _PAIRS[mark] in stack:
                while stack.pop() != _PAIRS[mark]:
                    pass
        elif len(mark) == 1 and not (mark == "“" and german):
            stack.append(mark)
    return bool(stack)


def _rules(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows, bares = [], []
        for key, question, answer, empty in zip(pdf["id"], pdf["prev_content"], pdf["content"], pdf["empty"], strict=True):
            found, bare = [], ""
            if empty:
                found.append("empty")
            else:
                question = question or ""
                if _same(question, answer):
                    found.append("copy")
                lang, margin = language(answer)
                if _refuses(answer, lang if margin >= KNOWN else ""):
                    found.append("refusal")
                if _other_language(question, lang, margin):
                    found.append("language")
                text, marked, signs = bare_end(answer)
                if _open(answer) or "�" in signs or "[" in signs or signs[:1] in ("<", "&"):
                    found.append("truncated")
                elif not marked and not _URL_END.search(text[-400:]) and not text.endswith("```"):
                    bare = text
            rows.append((key, found))
            bares.append(bare)
        out = pd.DataFrame(rows, columns=["key", "found"])
        yield out.assign(grams=last_grams(bares))


def prompt_response_pairs(messages: DataFrame) -> DataFrame:
    """(id, content, prev_content): each assistant message directly after a user message, by the order of ordered_messages.

    Rows with a null or blank role, or without a time or conversation, are left out; repeats count once.
    """
    rows = ordered_messages(messages, "content").where("role is not null and at is not null")
    return with_previous(rows, ("role", "content")).where("role = 'assistant' and prev_role = 'user'").select("id", "content", "prev_content")


def pair_defects(messages: DataFrame) -> DataFrame:
    """(response_id, defects): every defect of each defective pair, in the order of DEFECTS.

    Rules: `empty` for nothing, punctuation, markup or stand-ins; `copy` for the question alone
    again; `refusal` for a short answer of declining phrases only; `language` for an answer in
    another language or script than the question, which named none; `truncated` for an open code
    fence, list item or bracket, a sign of omission, or an unmarked end where the corpus's sentences
    hardly ever end. An empty answer shows no other defect. Null contents are empty; an empty table
    gives no rows.
    """
    pairs = prompt_response_pairs(messages).withColumn("empty", is_empty_text(F.col("content")))
    ruled = staged(pairs.mapInPandas(_rules, "key string, found array<string>, grams array<long>").where("size(found) > 0 or size(grams) > 0"))
    likely = end_likelihood(ruled.where("size(grams) > 0").select("key", "grams"), ending_counts(messages, "content"))
    abrupt = likely.where(F.col("likelihood") < UNLIKELY).select("key", F.lit(True).alias("abrupt"))
    joined = ruled.join(abrupt, "key", "left")
    all_ = F.concat("found", F.when(F.col("abrupt"), F.array(F.lit("truncated"))).otherwise(F.array().cast("array<string>")))
    return joined.select(F.col("key").alias("response_id"), F.filter(F.array(*map(F.lit, DEFECTS)), lambda x: F.array_contains(all_, x)).alias("defects")).where("size(defects) > 0")
