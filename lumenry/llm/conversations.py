"""Conversations rebuilt from message rows."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenry.functions.refs import ref_key, uuid_text
from lumenry.llm.dialog import is_empty_text, ordered_messages, with_previous
from lumenry.operators.relational import follow_pointers
from lumenry.sources.stage import staged

#: Weights of a reply link: the other speaker, nearness in time, naming the candidate's speaker, shared words.
OTHER_SPEAKER, NEARNESS, MENTION, OVERLAP = 2.0, 1.0, 0.5, 1.0
#: Seconds after which nearness has fallen to about a third.
PACE = 600.0
#: Seconds within which a message is a candidate, long after nearness is nothing; windows of a stretch of time that is worked on at once.
WINDOW, STRETCH = 14_400, 12
#: Nearness, mention and shared words that a user's message needs together to go on with a thread.
LEAST_TIE = 0.1


def _terms(content: Column) -> Column:
    """Hashes of the distinct words of three or more letters, and of Chinese characters in pairs of neighbours."""
    low = F.lower(F.coalesce(content, F.lit("")))
    words = F.concat(F.regexp_extract_all(low, F.lit(r"[\p{L}&&[^一-鿿]]{3,}"), F.lit(0)), F.regexp_extract_all(low, F.lit(r"[一-鿿]{2}"), F.lit(0)))
    return F.array_distinct(F.transform(words, lambda w: F.hash(w)))


def _calls(content: Column) -> Column:
    """The speakers that a message names with an @."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(content, F.lit(""))), F.lit(r"@(\w+)"), F.lit(1)))


def _likeliest(window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over rows sorted by conversation, stretch and order: each own row with its likeliest parent among those of the window before it.

    Only the messages of the last window are held. From the nearest candidate on, the rest are left
    as soon as even a full likeness could not reach the best.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: tuple = ()
        recent: deque = deque()
        for pdf in frames:
            found = []
            for conv, stretch, own, us, rank, mid, role, terms, calls in zip(*[pdf[c].tolist() for c in ("conv", "stretch", "own", "us", "rank", "id", "role", "terms", "calls")], strict=True):
                if (conv, stretch) != group:
                    group = (conv, stretch)
                    recent.clear()
                while recent and recent[0][0] < us - window * 1_000_000:
                    recent.popleft()
                words, best = set(terms), None
                free = role == "assistant" or not words
                most = OTHER_SPEAKER + OVERLAP + (MENTION if len(calls) else 0.0)
                for at, nth, cid, speaker, theirs in reversed(recent) if own else ():
                    if (at, nth, cid) == (us, rank, mid):
                        continue
                    near = NEARNESS * math.exp((at - us) / 1e6 / PACE)
                    if best is not None and near + most < best[0]:
                        break
                    tie = near + (MENTION if speaker in calls else 0.0) + OVERLAP * len(words & theirs) / max(1, min(len(words), len(theirs)))
                    if free or tie >= LEAST_TIE:
                        link = (tie + (OTHER_SPEAKER if role != speaker else 0.0), at, nth, cid, speaker)
                        best = link if best is None or link > best else best
                recent.append((us, rank, mid, role, words))
                if own:
                    found.append(best or (0.0, None, None, None, None))
            out = pdf.loc[pdf["own"], ["conv", "id", "role", "at", "rank", "empty"]].reset_index(drop=True)
            names = ("score", "parent_us", "parent_rank", "parent_id", "parent_role")
            columns = zip(*found, strict=True) if found else [()] * len(names)
            links = {n: pd.Series(list(v), dtype={"score": "float64", "parent_us": "Int64", "parent_rank": "Int32"}.get(n, "object")) for n, v in zip(names, columns, strict=True)}
            yield pd.concat([out, pd.DataFrame(links)], axis=1)

    return run


def reply_links(messages: DataFrame, window: int = WINDOW) -> DataFrame:
    """The likeliest parent of each message among all messages of the `window` seconds before it in its conversation.

    Columns conv, id, role, at, rank, empty, prev_id, prev_role, prev_at (of the message directly
    before), parent_id, parent_role, parent_at, parent_rank and score. A candidate's score adds the other speaker, nearness
    in time, a mention (`@` and the candidate's role) and the shared share of words; the nearer
    candidate wins a tie. Any message with words but an assistant's begins a thread if no candidate
    ties it by more than a change of speaker (LEAST_TIE); one without words cannot tell and takes the
    likeliest. An assistant's without a candidate answers the message directly before. A conversation is cut into
    stretches of time, each with a copy of the window before it, so that a hot one is spread over tasks
    and every task holds one window of one conversation at a time; words travel as hashes, texts not at all. Rows without role, time
    or conversation are left out; repeats count once.
    """
    rows = ordered_messages(messages, is_empty_text(F.col("content")).alias("empty"), _terms(F.col("content")).alias("terms"), _calls(F.col("content")).alias("calls")).where("role is not null and at is not null")
    us, size = F.unix_micros(F.col("at").cast("timestamp")), STRETCH * window * 1_000_000
    stretch, late = F.floor(F.col("us") / size), F.floor((F.col("us") + window * 1_000_000) / size)
    places = F.array(F.struct(stretch.alias("stretch"), F.lit(True).alias("own")), F.struct(late.alias("stretch"), (late == stretch).alias("own")))
    laid = rows.withColumn("us", us).select("*", F.inline(F.array_distinct(places)))
    sorted_ = laid.repartition("conv", "stretch").sortWithinPartitions("conv", "stretch", "us", "rank", "id")
    scored = sorted_.mapInPandas(_likeliest(window), "conv string, id string, role string, at timestamp_ntz, rank int, empty boolean, score double, parent_us long, parent_rank int, parent_id string, parent_role string")
    known = with_previous(scored, ["role", "at", "rank"])
    direct = F.col("parent_id").isNull() & (F.col("role") == "assistant")
    parent = lambda c, own: F.when(direct, F.col(f"prev_{c}")).otherwise(own).alias(f"parent_{c}")
    then = (F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("parent_us") / F.lit(1_000_000).cast("decimal(18,6)"))).cast("timestamp_ntz")
    told = F.when(direct & (F.col("role") != F.col("prev_role")), OTHER_SPEAKER).otherwise(F.col("score"))
    return known.select("conv", "id", "role", "at", "rank", "empty", "prev_id", "prev_role", "prev_at", parent("id", F.col("parent_id")), parent("role", F.col("parent_role")), parent("at", then), parent("rank", F.col("parent_rank")), told.alias("score"))


def reply_threads(messages: DataFrame, window: int = WINDOW) -> DataFrame:
    """The links of reply_links as trees: conv, id, role, at, rank, prev_id, parent_id, score and root_id (the message at the root of its tree)."""
    key = ["conv", "id", "role", "at", "rank"]
    links = staged(reply_links(messages, window).withColumn("num", F.monotonically_increasing_id()))
    numbers = links.select("conv", F.col("id").alias("parent_id"), F.col("at").alias("parent_at"), F.col("rank").alias("parent_rank"), F.col("num").alias("parent"))
    tree = links.join(numbers, ["conv", "parent_id", "parent_at", "parent_rank"], "left").select("num", "parent")
    roots = follow_pointers(tree, "num", "parent").join(links.select(F.col("num").alias("root"), F.col("id").alias("root_id")), "root")
    return links.join(roots.select(F.col("node").alias("num"), "root_id"), "num").select(*key, "prev_id", "parent_id", "score", "root_id")


def thread_links(messages: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of reply_threads with their content."""
    key = ["conv", "id", "role", "at", "rank"]
    threads = reply_threads(messages, window)
    texts = ordered_messages(messages, "content").where("role is not null and at is not null").dropDuplicates(key)
    return texts.join(threads, key)


def conversation_state(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Per conversation: conversation_id, reason (null where it can be used), n_messages.

    The reply links choose what is suspect: a conversation in which an assistant's likeliest parent
    is missing, no user's message, or not the message directly before, or in which a user's message
    has not exactly one assistant's message below it. A conversation without such links alternates
    without a gap, so nothing else can be broken or lack a reply. Of the suspect ones the order then
    gives the reason, the first that holds: `empty` (no messages, or all of them without content),
    `broken` (a message with a blank role or null time, an assistant first, or two assistants in a
    row), `missing_reply` (a user message whose direct successor is not an assistant's, or an empty
    one). Ids compare as references and come out in canonical form; repeated rows count once; a null or
    blank id is no conversation. Everything per conversation is a combinable aggregate, so a hot
    conversation sends one row per task.
    """
    ids = conversations.select(ref_key(F.col("id")).alias("conv")).where("conv is not null").distinct()
    seen = ordered_messages(messages, is_empty_text(F.col("content")).alias("empty")).groupBy("conv").agg(F.bool_and("empty").alias("all_empty"), F.bool_or(F.col("role").isNull() | F.col("at").isNull()).alias("unordered"))
    links = reply_links(messages)
    assistant, user = F.col("role") == "assistant", F.col("role") == "user"
    answered = assistant & (F.col("prev_role") == "user")
    below = assistant & (F.col("parent_role") == "user")
    astray = assistant & (F.col("parent_id").isNull() | (F.col("parent_role") != "user") | (F.col("parent_id") != F.col("prev_id")) | (F.col("parent_at") != F.col("prev_at")))
    judged = links.groupBy("conv").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.bool_or(F.coalesce(astray, F.lit(False)) | (below & F.col("empty")) | ~(assistant | user)).alias("astray"),
        F.count_if(user).alias("users"), F.count_if(below).alias("replies"),
        F.bool_or(assistant & (F.col("prev_id").isNull() | (F.col("prev_role") == "assistant"))).alias("misplaced"),
        F.bool_or(((F.col("prev_role") == "user") & ~answered) | (answered & F.col("empty"))).alias("unanswered"),
        F.max_by("role", F.struct("at", "rank", "id")).alias("last_role"),
    )
    # where no assistant is astray, each answers the message directly before it, so that no two share a parent and equal counts mean one reply each
    suspect = F.coalesce(F.col("astray") | (F.col("users") != F.col("replies")), F.lit(True))
    all_ = ids.join(seen, "conv", "left").join(judged, "conv", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = F.when(F.coalesce("all_empty", F.lit(True)), "empty").when(yes("unordered"), "broken").when(suspect & yes("misplaced"), "broken").when(suspect & (yes("unanswered") | (F.col("last_role") == "user")), "missing_reply")
    return all_.select(uuid_text(F.col("conv")).alias("conversation_id"), reason.alias("reason"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"))


def rebuilt_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """The turns of the usable conversations: conversation_id, turn (from 1), message_id, parent_id, root_id, role, content.

    Turns are numbered by day first, then shifted by the turns of earlier days, so that no task has
    to hold a whole conversation. parent_id links the turns to trees, one for each thread; root_id is
    the message that began the thread.
    """
    usable = conversation_state(conversations, messages).where("reason is null").select(ref_key(F.col("conversation_id")).alias("conv"))
    links = thread_links(messages).withColumn("day", F.to_date("at")).join(usable, "conv", "left_semi")
    days = links.groupBy("conv", "day").agg(F.count(F.lit(1)).alias("n"))
    before = days.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("day")) - F.col("n")).drop("n")
    numbered = links.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "day").orderBy("at", "rank", "id"))).join(before, ["conv", "day"])
    return numbered.select(uuid_text(F.col("conv")).alias("conversation_id"), (F.col("before") + F.col("nth")).alias("turn"), F.col("id").alias("message_id"), "parent_id", "root_id", "role", "content")
