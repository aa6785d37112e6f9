import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenry.llm.endings import BARE, DOTTED, ENDS, GOES_ON, WHOLE, bare_end, end_likelihood, ending_counts, is_short, last_grams, scan
from lumenry.llm.truncation import length_limits, share_per_source, truncated

SENTENCES = ["The pump works well in a cold garage", "We bought it for the small office last year", "Nobody noticed any noise during the long winter", "It survived two falls from the kitchen table", "The cable fits perfectly and feels solid today"]


def test_scan_tells_ends_from_middles():
    text, follows, grams, whole = scan(["One two. Three,\nfour", "", "five", "一二。三"])
    assert text.tolist() == [0, 0, 0, 0, 2, 3, 3, 3]
    assert follows.tolist() == [GOES_ON, ENDS, ENDS, BARE, WHOLE, GOES_ON, ENDS, BARE]
    assert grams.shape == (8, 3) and whole[4].tolist() == [True, True, False]
    for short in ([], [""], ["a"], ["a b"], ["。"]):
        assert len(scan(short)[0]) == len(" ".join(short).replace("。", "").split())


def test_same_words_hash_alike_wherever_they_stand():
    _, _, grams, _ = scan(["x y alpha beta gamma", "other z y alpha beta gamma"])
    assert np.array_equal(grams[4], grams[10])
    assert last_grams(["say alpha beta gamma"])[0] == last_grams([("filler words " * 100) + "say alpha beta gamma"])[0]
    assert last_grams(["", "..."]) == [[], []]


@pytest.mark.parametrize(("text", "want"), [("Good. ", ("Good.", True, "")), ("Good", ("Good", False, "")), ("cut off… read more", ("cut off", False, "… read more")), ("a [more]", ("a", False, "[more]")), ("done...", ("done", False, "...")), ("bad <b", ("bad ", False, "<b")), ("x<br/> \n", ("x", False, "")), ("ok 👍", ("ok 👍", True, "")), ("Fine. Greetings", ("Fine. Greetings", True, "")), ("no greetings", ("no greetings", False, "")), ("好�", ("好", False, "�"))])
def test_bare_end(text, want):
    assert bare_end(text) == want


def test_short_titles():
    assert is_short("Great buy") and is_short("很快就坏") and not is_short("one two three four five six")


def documents(spark, seed=1):
    rng = random.Random(seed)
    rows, cut = [], set()
    for i in range(900):
        text = ". ".join(rng.choice(SENTENCES) for _ in range(rng.randint(2, 7))) + rng.choice([".", "."])
        source = rng.choice(["limited", "free"])
        if source == "limited" and len(text) > 120:
            text = text[:120]
            if not text.rstrip().endswith(".") and not any(text.endswith(s) for s in SENTENCES):
                cut.add(i)
        elif source == "free" and rng.random() < 0.1 and len(text) > 60:
            k = rng.randrange(50, len(text) - 8)
            text = text[:k]
            if not text.rstrip().endswith(".") and not any(text.endswith(s) for s in SENTENCES):
                cut.add(i)
        elif rng.random() < 0.3:
            text = text.rstrip(".") + rng.choice(["", " ...", "…"])
        rows.append((i, text, source, "x", "y"))
    rows += [(1000, None, "free", "", ""), (1001, "", None, "", ""), (1002, "word " * 60_000 + "end.", "free", "", ""), (1003, "Great buy", "free", "", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, grams string"), cut


def test_truncated_documents(spark):
    docs, cut = documents(spark)
    found = truncated(docs)
    got = {r.key for r in found.collect()}
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut) <= 0.03 * len(cut)
    shares = {r.source: (r.n_texts, r.n_cut) for r in share_per_source(docs, found).collect()}
    assert sum(n for n, _ in shares.values()) == docs.count() and shares["limited"][1] == len([1 for r in found.collect() if r.source == "limited"])
    assert truncated(docs.limit(0)).count() == 0


def test_limits_show_under_the_right_measure(spark):
    from lumenry.llm.truncation import _inspected

    rng = random.Random(2)
    texts = [("é" * rng.randrange(5) + " ".join(rng.choice(SENTENCES) for _ in range(9))).encode()[:150].decode("utf-8", "ignore") for _ in range(300)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    sizes = {(r.measure, r["size"]) for r in length_limits(_inspected(df, "doc_id", "source", "text")).collect()}
    assert ("utf8", 150) in sizes


def test_limits_of_small_sources_and_short_texts(spark):
    sized = lambda sizes: spark.createDataFrame([("s", [("chars", n)]) for n in sizes], "source string, measures array<struct<measure:string,size:int>>")
    limits = lambda sizes: [(r["size"], r.n) for r in length_limits(sized(sizes)).collect()]
    assert limits([24] * 4 + [60, 70]) == [(24, 4)] and limits([24, 24, 60, 70]) == []
    assert limits([n for n in range(100, 200) for _ in range(5)]) == [] and limits([n for n in range(100, 200) for _ in range(5)] + [150] * 60) == [(150, 65)]


def test_dots_prove_no_end(spark):
    _, follows, _, _ = scan(["one two… three four...", "five"])
    assert follows.tolist() == [GOES_ON, DOTTED, GOES_ON, DOTTED, WHOLE]
    texts = [("the pump works well in a cold garage.",)] * 30 + [("the pump works well in a co...",)] * 9
    counts = ending_counts(spark.createDataFrame(texts, "t string"), "t")
    rows = spark.createDataFrame([(1, last_grams(["works well in a co"])[0]), (2, last_grams(["in a cold garage"])[0])], "key long, grams array<long>")
    got = {r.key: r.likelihood for r in end_likelihood(rows, counts).collect()}
    assert got[1] < 0.15 and got[2] > 0.9


def test_every_reason_is_named(spark):
    docs, _ = documents(spark)
    rows = truncated(docs).collect()
    assert all(r.reason == r.reasons[0] for r in rows) and any(r.reasons == ["ending", "limit"] for r in rows)


def test_likelihood_counts_whole_corpus(spark):
    texts = spark.createDataFrame([("we like it here.",)] * 5 + [("like it here and there.",)] * 5, "t string")
    counts = ending_counts(texts, "t")
    rows = spark.createDataFrame([(1, last_grams(["they like it here"])[0]), (2, last_grams(["and we like it"])[0]), (3, last_grams(["they unseenword"])[0])], "key long, grams array<long>")
    got = {r.key: r.likelihood for r in end_likelihood(rows, counts).collect()}
    assert abs(got[1] - 0.5) < 0.05 and got[2] < 0.05 and got[3] < 0.15
    assert ending_counts(texts.where(F.lit(False)), "t").count() == 0
