import datetime as dt
import random
import uuid

from lumenry.operators.references import Reference, orphan_counts, orphan_references

CHILD = "id string, ref string, created_at timestamp_ntz, key string, period string"
PARENT = "id string, created_at timestamp_ntz, key string"


def forms(rng, key):
    return rng.choice([key, key.upper(), key.replace("-", ""), "{" + key + "}", f" \t{key}\n"])


def test_against_brute_force(spark):
    rng = random.Random(5)
    keys = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(60)]
    at = lambda: rng.choice([None] + [dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(9000)) for _ in range(6)])
    parents = [(k, at(), "x") for k in keys[:40]]
    children = [(f"c{i}", rng.choice([None, "", " ", "0" * 32, "not a uuid", forms(rng, rng.choice(keys)), forms(rng, keys[0])]), at(), "x", "y") for i in range(800)]
    children += children[:50]
    born = {k: b for k, b, _ in parents}
    want = set()
    for cid, ref, made, *_ in children:
        bare = (ref or "").strip().translate(str.maketrans("", "", "{}-")).lower()
        if not bare or set(bare) == {"0"}:
            continue
        known = next((k for k in born if k.replace("-", "") == bare), None)
        kind = "missing" if known is None else "late" if made and born[known] and made < born[known] else None
        if kind:
            want.add(("child", "ref", cid, kind, made.strftime("%Y-%m") if made else "unknown"))
    reference = Reference("child", "ref", spark.createDataFrame(children, CHILD), "parent", spark.createDataFrame(parents, PARENT))
    got = orphan_references([reference]).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    assert sum(r.n_rows for r in orphan_counts(orphan_references([reference])).collect()) == len(want)


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], CHILD), spark.createDataFrame([("1", "ab", None, "", "")], CHILD)
    parents = spark.createDataFrame([], PARENT)
    assert orphan_references([Reference("c", "ref", none, "p", parents)]).count() == 0
    assert [tuple(r) for r in orphan_references([Reference("c", "ref", some, "p", parents)]).collect()] == [("c", "ref", "1", "missing", "unknown")]
