import os
import random

import pytest

from lumenry.llm.packing import VOCABULARY, fill_report, harmonic_pack, pieces, token_sizes

PACKS = "pack_name string, capacity_tokens int, key string"


@pytest.fixture
def packs(spark):
    return spark.createDataFrame([("s", 64, "x"), ("l", 1000, "y"), ("s", 64, "x"), (None, 5, ""), ("bad", 0, "")], PACKS)


def test_every_token_is_placed_once_and_no_bin_overflows(spark, packs):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 1, 3, rng.randrange(1, 60), rng.randrange(1, 3000)]) for i in range(3000)}
    df = spark.createDataFrame(list(sizes.items()), "key long, n_tokens long")
    rows = harmonic_pack(pieces(df, packs)).collect()
    for name, capacity in (("s", 64), ("l", 1000)):
        load, placed = {}, {}
        for r in rows:
            if r.pack_name == name:
                load[r.bin_id] = load.get(r.bin_id, 0) + r["size"]
                placed.setdefault(r.key, []).append((r.start, r["size"]))
        assert max(load.values()) <= capacity
        for key, n in sizes.items():
            at = 0
            for start, size in sorted(placed.get(key, [])):
                assert start == at
                at += size
            assert at == n and (n > capacity or len(placed.get(key, [])) == (n > 0))
        assert sum(load.values()) / len(load) / capacity > 0.8
    assert {r.pack_name: r.n_tokens for r in fill_report(harmonic_pack(pieces(df, packs))).collect()} == {"s": sum(sizes.values()), "l": sum(sizes.values())}


def test_one_name_with_several_capacities(spark):
    packs = spark.createDataFrame([("p", 100, ""), ("p", 250, "")], PACKS)
    df = spark.createDataFrame([(i, 1 + i * 37 % 99) for i in range(800)], "key long, n_tokens long")
    load = {}
    for r in harmonic_pack(pieces(df, packs)).collect():
        load.setdefault(r.bin_id, []).append((r.capacity, r["size"]))
    assert all(len({c for c, _ in x}) == 1 and sum(n for _, n in x) <= x[0][0] for x in load.values())


def test_nothing_to_pack(spark, packs):
    none = spark.createDataFrame([], "key long, n_tokens long")
    assert harmonic_pack(pieces(none, packs)).count() == 0 and harmonic_pack(pieces(spark.createDataFrame([(1, 5)], "key long, n_tokens long"), packs.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_long_texts_count_as_in_one_go(spark):
    from lumenry.llm.packing import _encoding

    long = " ".join(f"word{i % 977} says, 价格" for i in range(30_000))
    df = spark.createDataFrame([(1, None, ""), (2, "", ""), (3, "hello world", ""), (4, long, ""), (5, "价格" * 120_000, "")], "id long, t string, key string")
    got = {r.key: r.n_tokens for r in token_sizes(df, "id", "t").collect()}
    whole = _encoding(VOCABULARY).encode_ordinary
    assert got == {1: 0, 2: 0, 3: 2, 4: len(whole(long)), 5: len(whole("价格" * 120_000))}
