import random

import numpy as np

from lumenry.llm import leakage
from lumenry.llm.leakage import GRAM, WINDOW, fingerprints, leaked_items, tokens


def texts(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    items = {i: " ".join(["the ledger states that", *(rng.choice(words) for _ in range(40)), "which statement must be false?"]) for i in range(20)}
    filler = lambda n: " ".join(rng.choice(["nice", "pump", "works", "garage", "cold", "handle", "easy"]) for _ in range(n))
    docs, want = {}, set()
    for i in range(120):
        item = rng.randrange(20)
        ws = items[item].split()
        kind = i % 6
        if kind == 0:
            docs[i] = filler(30)
        elif kind == 1:
            docs[i] = f"{filler(20)} {items[item].upper().replace(' ', '  ')} {filler(5)}"
        elif kind == 2:
            docs[i] = f"{filler(9)} <b>{' '.join(ws[:25])}</b> {filler(25)} {' '.join(ws[25:])}"
        elif kind == 3:
            docs[i] = " ".join("changed" if j % 9 == 5 else w for j, w in enumerate(ws))
        elif kind == 4:
            docs[i] = f"{filler(5)} {' '.join(ws[10:28])} {filler(5)}"
        else:
            docs[i] = f"{filler(5)} the ledger states that {' '.join(ws[6:13])} {filler(9)} which statement must be false?"
        if kind not in (0, 5):
            want.add((i, item))
    return items, docs, want


def frames(spark, items, docs):
    d = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], "doc_id long, text string, item string")
    return d, spark.createDataFrame([(k, v, "x") for k, v in items.items()], "item_id long, text string, doc string")


def test_finds_copies_passages_and_changed_texts(spark, monkeypatch):
    items, docs, want = texts()
    docs |= {900: None, 901: "", 902: "word " * 50_000}
    d, i = frames(spark, items, docs)
    got = {(r.doc, r.item) for r in leaked_items(d, i).collect()}
    assert got == want
    monkeypatch.setattr(leakage, "SENT", 10)
    assert {(r.doc, r.item) for r in leaked_items(d, i).collect()} == want


def test_empty_sides(spark):
    items, docs, _ = texts()
    d, i = frames(spark, items, docs)
    assert leaked_items(d.limit(0), i).count() == 0 and leaked_items(d, i.limit(0)).count() == 0


def test_shared_runs_are_never_missed():
    rng = random.Random(3)
    for _ in range(200):
        run = [f"r{rng.randrange(10**6)}" for _ in range(GRAM + WINDOW - 1)]
        a, b = ([f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(9))] + run + [f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(9))] for _ in range(2))
        assert np.intersect1d(fingerprints(a), fingerprints(b)).size
    assert fingerprints(["a"] * (GRAM - 1)).size == 0 and fingerprints(["a"] * GRAM).size == 1
    assert tokens("Ａb&nbsp;<i>c</i>中文 d-e") == ["ab", "c", "中", "文", "d", "e"]


def test_short_items_are_found(spark, monkeypatch):
    rng = random.Random(7)
    items = {i: " ".join(f"k{i}x{j}" for j in range(1 + i % 4)) for i in range(60)} | {99: "一二"}
    docs = {i: " ".join(f"f{rng.randrange(50)}" for _ in range(rng.randrange(6))) + " " + t.upper() + " " + " ".join(f"f{rng.randrange(50)}" for _ in range(rng.randrange(6))) for i, t in items.items()}
    docs |= {200: "k3x0 k3x1 and k3x2 k3x3", 201: "一 三 二"}
    d, i = frames(spark, items, docs)
    want = {(k, k) for k in items} | {(d, k) for d, t in docs.items() for k, it in items.items() if f" {it} " in f" {t.lower()} "} | {(200, k) for k in items if f" {items[k]} " in f" {docs[200]} "}
    assert {(r.doc, r.item) for r in leaked_items(d, i).collect()} == want
    monkeypatch.setattr(leakage, "SENT", 1)
    assert {(r.doc, r.item) for r in leaked_items(d, i).collect()} == want
