"""Chat messages in order: roles, blank contents, and the message before each message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenry.functions.refs import ref_key

#: Spellings of the two speakers; any other non-blank role is its own speaker.
USER = ("user", "human", "customer", "client", "prompter", "usr", "question")
ASSISTANT = ("assistant", "ai", "bot", "model", "gpt", "system_assistant", "chatbot", "agent", "asst", "answer")
#: Texts that stand for no value.
STAND_INS = ("null", "none", "undefined", "nan", "na", "nil", "void", "empty", "blank", "noresponse", "noanswer", "nocontent", "tbd", "todo", "keine", "vide", "vacío", "无", "空")


def speaker(role: Column) -> Column:
    """`user`, `assistant`, another role in lower case, or null for a null or blank role."""
    bare = F.lower(F.regexp_replace(role, r"(?U)^[\s\p{Punct}]+|[\s\p{Punct}]+$", ""))
    return F.when(bare == "", None).when(bare.isin(*USER), "user").when(bare.isin(*ASSISTANT), "assistant").otherwise(bare)


def is_empty_text(content: Column) -> Column:
    """True for null and for texts of white space, punctuation, markup or a stand-in for no value only."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(content, F.lit("")), r"<[^<>]*>|&[a-zA-Z#0-9]+;", ""), r"```[a-z]*", ""))
    words = F.regexp_replace(plain, r"[^\p{L}\p{N}\p{So}]+", "")
    return (words == "") | words.isin(*STAND_INS)


def ordered_messages(messages: DataFrame, *columns: str) -> DataFrame:
    """Messages as (conv, id, role, at, rank, *columns); the order is (at, rank, id) with the user first at equal times.

    conv is the reference key of conversation_id. Rows without a conversation are left out; rows
    with a blank role or null time stay, with null role or at.
    """
    role = speaker(F.col("role"))
    return messages.select(ref_key(F.col("conversation_id")).alias("conv"), F.col("id").cast("string").alias("id"), role.alias("role"), F.col("created_at").alias("at"), F.when(role == "user", 0).otherwise(1).alias("rank"), *columns).where("conv is not null")


def with_previous(rows: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Adds prev_<column> of the directly preceding message of the conversation, and drops repeated messages.

    A conversation is cut into days, so that one with a third of all rows is spread over tasks; the
    last message of a day is handed to the first of the next day on which the conversation goes on.
    Only those edge rows are shuffled a second time. The first message has null prev_role and
    prev_id. rows needs conv, id, role, at, rank, all of role and at non-null.
    """
    order = ["at", "rank", "id"]
    day = Window.partitionBy("conv", "day").orderBy(*order)
    own = rows.withColumn("day", F.to_date("at")).withColumn("_before", F.lag("id").over(day)).where(F.col("_before").isNull() | (F.col("_before") != F.col("id"))).drop("_before")
    names = ["id", *carried]
    linked = own.withColumns({f"prev_{c}": F.lag(c).over(day) for c in names} | {"_last": F.lead("id").over(day).isNull()})
    inner = linked.where("prev_id is not null").drop("_last", "day")
    # edges: the first (0) and last (1) message of each day of a conversation
    edge = linked.where("prev_id is null or _last").withColumn("_side", F.explode(F.filter(F.array(F.when(F.col("prev_id").isNull(), 0), F.when(F.col("_last"), 1)), lambda x: x.isNotNull())))
    across = Window.partitionBy("conv").orderBy("day", "_side")
    heads = edge.drop(*[f"prev_{c}" for c in names]).withColumns({f"prev_{c}": F.lag(c).over(across) for c in names}).where("_side = 0")
    return inner.unionByName(heads.select(*inner.columns))
