"""Texts packed into containers of fixed capacity by harmonic classes."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.sources.ship import ship_file, shipped_file

#: Public byte-level vocabulary the sizes are measured with.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary splits text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of at most this share of the capacity form the last class, which is filled by size, not by count.
CLASSES = 32
#: Kinds of containers packed at once.
MOST_PACKS = 1000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of each text; null and empty texts have 0 tokens. Whole texts are encoded at once.

    The vocabulary file is read on the driver's machine and handed to the executors.
    """
    name = ship_file(docs.sparkSession, vocabulary)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(shipped_file(name)).encode_ordinary
        for pdf in frames:
            yield pd.DataFrame({"key": pdf["key"], "n_tokens": [len(encode(t or "")) for t in pdf["text"]]})

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(measure, "key long, n_tokens long")


def pieces(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, capacity, key, piece, start, size): what is to be placed for each capacity.

    Only a text larger than the capacity is split: into full pieces and the rest. Texts without
    tokens need no place and give no piece. Packs need a name and a positive
    capacity; repeats count once, and there are at most MOST_PACKS.
    """
    rows = packs.where("pack_name is not null and capacity_tokens > 0").select("pack_name", "capacity_tokens").distinct().limit(MOST_PACKS + 1).collect()
    if len(rows) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} kinds of containers")
    own = [F.struct(F.lit(r.pack_name).alias("pack_name"), F.lit(r.capacity_tokens).cast("long").alias("capacity")) for r in sorted(rows)]
    none = F.array().cast("array<struct<pack_name:string,capacity:bigint>>")
    each = sizes.where("n_tokens > 0").select("key", "n_tokens", F.inline(F.array(*own) if own else none))
    full = F.expr("cast(ceil(n_tokens / capacity) as int)")
    out = each.withColumn("piece", F.explode(F.sequence(F.lit(0), full - 1)))
    start = F.col("piece") * F.col("capacity")
    return out.select("pack_name", "capacity", "key", "piece", start.alias("start"), F.least("capacity", F.col("n_tokens") - start).alias("size"))


class _Bins:
    """Bins of one capacity in one task: classes with a fixed count of items, and the room left in bins that are done."""

    def __init__(self) -> None:
        self.n, self.kind, self.current, self.count, self.room = 0, 0, -1, 0, 0
        self.spare: dict[int, list[int]] = {}
        self.mask = 0  # bit g is set where some done bin has room for g

    def _done(self, bin_: int, room: int) -> None:
        if room:
            self.spare.setdefault(room, []).append(bin_)
            self.mask |= 1 << room

    def place(self, kind: int, size: int, capacity: int) -> int:
        """The bin of the next item; classes come in rising order, that is from large items to small ones."""
        if kind != self.kind:
            self._close()
            self.kind = kind
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1  # the least room that is enough
            bins = self.spare[room]
            bin_ = bins.pop()
            if not bins:
                self.mask ^= 1 << room
            self._done(bin_, room - size)
            return bin_
        if self.current < 0 or size > self.room:
            self._close()
            self.current, self.count, self.room, self.n = self.n, 0, capacity, self.n + 1
        bin_ = self.current
        self.count, self.room = self.count + 1, self.room - size
        if self.count == kind < CLASSES:
            self._close()
        return bin_

    def _close(self) -> None:
        if self.current >= 0:
            self._done(self.current, self.room)
        self.current = -1


def harmonic_pack(items: DataFrame) -> DataFrame:
    """Adds bin_id to items (pack_name, capacity, key, piece, start, size).

    An item of size in (C/(k+1), C/k] belongs to class k, and a bin of that class takes k of them;
    items of at most C/CLASSES share bins by size. Room left in bins that are done goes, where it
    is enough, to items of the same or later classes before a bin is begun. Each task fills bins on
    its own, from rows spread by key in portions that AQE sizes, so that no class is brought
    together and few bins per task stay unfinished; a bin belongs to one pack name and capacity. Order within a task is fixed, so that a
    repeated task gives the same bins. Sizes must lie in 1..capacity.
    """
    classed = items.withColumn("kind", F.least(F.lit(CLASSES), F.expr("cast(capacity div size as int)")))
    spread = classed.hint("rebalance", "key").sortWithinPartitions("pack_name", "capacity", "kind", "key", "piece")

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        last, bins = None, _Bins()
        for pdf in frames:
            ids = []
            for pack, capacity, kind, size in zip(pdf["pack_name"], pdf["capacity"], pdf["kind"], pdf["size"], strict=True):
                if (pack, capacity) != last:
                    last, bins = (pack, capacity), _Bins()
                ids.append(f"{pack}-{capacity}-{task}-{bins.place(kind, size, capacity)}")
            yield pdf.assign(bin_id=ids)[["pack_name", "capacity", "key", "piece", "start", "size", "bin_id"]]

    return spread.mapInPandas(fill, "pack_name string, capacity long, key long, piece int, start long, size long, bin_id string")


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: bins, tokens, and the share of the bins' space that is used."""
    bins = packed.groupBy("pack_name", "capacity", "bin_id").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n"))
    return bins.groupBy("pack_name", "capacity").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("n").alias("n_pieces"), F.sum("load").alias("n_tokens"), F.max("load").alias("fullest"), F.round(F.sum("load") / F.count(F.lit(1)) / F.first("capacity"), 4).alias("used"))
