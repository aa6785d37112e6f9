import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenry.operators import relational as R
from lumenry.operators.components import components
from lumenry.operators.keywords import expand_keywords, infer_profile
from lumenry.operators.vectors import centroids, cosine_search
from lumenry.sources import writers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_filters_and_pages(spark):
    df = spark.createDataFrame([(1, "Ab", ["x"]), (2, None, None), (3, "b%", ["aB"])], "id int, t string, a array<string>")
    assert [r.id for r in df.where(R.matches_any("ab", [F.col("t")], [F.col("a")])).collect()] == [1, 3]
    assert R.where_equal(df, id=1, t=None).count() == 1
    with pytest.raises(ValueError):
        R.one_of("t", "zzz", ("a",))
    assert [r.id for r in R.page(df, [F.col("id")], -5, 2).collect()] == [1, 2] and R.page_count(0, 20) == 1 and R.page_count(41, 20) == 3


def test_latest_upsert_insert_replace(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", None, "z")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 2, "n"), ("c", 1, "m"), ("c", 1, "m")], "k string, v int, w string")
    assert rows(R.latest(old, ["k"], ["v"], ["v", "w"])) == [("a", 1, "x"), ("b", 2, "y")]
    assert rows(R.upsert(old, new, ["k"], "v").select("k", "w")) == [("a", "x"), ("b", "n"), ("c", "m")]
    assert rows(R.insert_missing(old.limit(0), new, ["k"]).select("k")) == [("b",), ("c",)]
    assert rows(R.replace_group(old, new, "k").select("k", "w")) == [("a", "x"), ("b", "n"), ("c", "m"), ("c", "m")]


def test_pointers_and_cycles(spark):
    n = 70
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)] + [(100, 101), (101, 102), (102, 100), (103, 100), (200, 999)], "n int, t int")
    got = dict(rows(R.follow_pointers(df, "n", "t")))
    assert all(got[i] == 0 for i in range(n)) and {got[100], got[101], got[102], got[103]} == {100} and got[200] == 200


def test_long_chains_and_ways_into_cycles(spark):
    n = 400
    chain = [(1000 + (i * 7) % n, 1000 + (i - 1) * 7 % n if i else None) for i in range(1, n)] + [(1000, 5000), (5000, None)]
    ring = [(2000 + i, 2000 + (i + 1) % 150) for i in range(150)]
    way = [(i, i + 1 if i < 90 else 2077) for i in range(1, 91)]
    got = dict(rows(R.follow_pointers(spark.createDataFrame(chain + ring + way, "n int, t int"), "n", "t")))
    assert {got[k] for k, _ in chain} == {5000} and {got[k] for k, _ in ring + way} == {2000}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (5, 5), (None, 1)] + [(500, 600 + i) for i in range(50)]
    got = dict(rows(components(spark.createDataFrame(edges, "a int, b int"))))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[600 + i] for i in range(50)} == {500}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_calendar_backfill_windows(spark):
    events = spark.createDataFrame([("x", "2024-01-02"), ("x", "2024-01-02"), ("y", "2024-02-01")], "series string, day string").withColumn("day", F.col("day").cast("date"))
    assert [(str(r.day), r.x, r.y) for r in R.calendar(events, "day", "2024-01-01", 3, ("x", "y")).orderBy("day").collect()] == [("2024-01-01", 0, 0), ("2024-01-02", 2, 0), ("2024-01-03", 0, 0)]
    a = spark.createDataFrame([(1, 10, 1)], "q int, item int, o int")
    b = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "q int, item int, o int")
    assert [(r.item, r.source) for r in R.backfill(a, b, ["q"], "item", "o", 2).orderBy("rank").collect()] == [(10, 0), (11, 1)]
    words = lambda n: spark.range(1).select(F.size(R.word_windows(F.lit(" ".join(["w"] * n))))).first()[0]
    assert [words(n) for n in (0, 1, 350, 351, 400, 701)] == [0, 1, 1, 2, 2, 3]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(m)] + [(500, [0.0] * 8, 0), (501, None, 0)], "id int, v array<double>, g int")
    got = {}
    for r in cosine_search(df.where("id % 10 = 0"), df, "id", "v", 4).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["item"]))
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    for q in range(0, 120, 10):
        sims = unit @ unit[q]
        sims[q] = -9
        assert [i for _, i in sorted(got[q])] == np.argsort(-sims, kind="stable")[:4].tolist()
    c = {r.g: r.centroid for r in centroids(df.where("id < 120"), "g", "v").collect()}
    assert np.allclose(c[1], m[1::3].mean(axis=0))


def test_keywords(spark):
    seeds = spark.createDataFrame([("p", 1, "solar"), ("p", 2, "wind")], "pack string, pos int, seed string")
    templates = spark.createDataFrame([("d", i, f"{{s}} {i}", 60, 50) for i in range(8)] + [("d", 8, "b2b {s}", 60, 50)], "dimension string, at int, template string, recommend_base int, business_base int")
    got = expand_keywords(seeds, templates, ["b2b"]).orderBy("rank").collect()
    assert [r.keyword for r in got] == [f"solar {i}" for i in range(8)] + ["wind 0", "wind 1"] and all(35 <= r.recommendation <= 99 for r in got)
    markers = spark.createDataFrame([("energy", 0, "solar"), ("energy", 0, "wind"), ("food", 1, "bread")], "profile string, at int, marker string")
    assert rows(infer_profile(seeds, markers, "none")) == [("p", "energy")] and rows(infer_profile(seeds.withColumn("seed", F.lit("q")), markers, "none")) == [("p", "none")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x"y'), (None, "z")], "k string, v string").coalesce(1)
    writers.write_csv(df, str(tmp_path / "csv"))
    body = "".join(f.read_text("utf-8") for f in sorted((tmp_path / "csv").glob("part-*")))
    assert body == '\ufeffk,v\n"a","x""y"\n"","z"\n'
    assert writers.write_verified(df, str(tmp_path / "kept")) == 2
    files = writers.manifest(spark, str(tmp_path / "csv")).collect()
    assert len(files) >= 1 and all(len(f.sha256) == 64 for f in files)
    assert writers.manifest_totals(writers.manifest(spark, str(tmp_path / "csv"))).first() == (len(files), sum(f["size"] for f in files))
    nodes = spark.createDataFrame([("c", "n", "Person"), ("c", "n", "Person"), ("c", "m", "Planet")], "company_id string, name string, type string")
    edges = spark.createDataFrame([("c", "n", "LIKES", "m"), ("c", "", "USES_TECH", "m"), ("c", "n", "FOUNDED_BY", "m")], "company_id string, src string, type string, dst string")
    assert rows(writers.graph_violations(nodes, edges)) == [("c", "blank end", "USES_TECH"), ("c", "edge", "LIKES"), ("c", "label", "m"), ("c", "repeated name", "n")]
    md = spark.range(1).select(writers.markdown_report(F.lit("t"), {"s": F.lit(1)}, {"A": F.array(F.lit("x")), "B": F.array().cast("array<string>")})).first()[0]
    assert md == "# t\n\n- s: 1\n\n## A\n- x\n\n## B\n- none"
