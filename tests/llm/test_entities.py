import random
from itertools import permutations

import pytest

from lumenry.llm.entities import firm_classes, variant_pairs
from lumenry.llm.names import aligned, cheapest, keys, near, parse_name, parse_slug, parse_url

FIRM = "id string, name string, url string, headquarters string, founded_date string, core string, trade string"


@pytest.mark.parametrize(("name", "want"), [("Kirdud Baldud Systems Inc.", ("baldud kirdud", "systems")), ("BALDUD, Kirdud (Sys.)", ("baldud kirdud", "systems")), ("The Kïrdud-Baldud Systems – Online", ("baldud kirdud", "systems")), ("Torvex Dept. Store & Co", ("torvex", "department store")), ("星河（上海）科技有限公司", ("星河", "科技"))])
def test_parse_name(name, want):
    assert parse_name(name)[:2] == want


def test_initials_slugs_and_urls():
    assert parse_name("K.B.S.")[2] == "kbs" and parse_name("KB Ltd")[2] == "kb" and parse_name("Mike Torvex Software")[0] == "mike torvex"
    assert parse_url("HTTPS://www.Kirdud-Baldud.example:443/about")[1:] == ("kirdud-baldud", "") and parse_url("http://host.example/c/kirdud-101")[2] == "kirdud" and parse_url("n/a 12") == ("", "", "")
    assert parse_slug("getkirdud-baldud-systems") == ("baldud kirdud", "systems", "kb")


@pytest.mark.parametrize(("a", "b", "how"), [("baldud kirdud", "baldud kirdud", "same"), ("baldud kirdud", "baldud krdud", "near"), ("baldud kirdud", "badlud kirdud", "near"), ("b kirdud", "baldud kirdud", "initial"), ("klaus kirdud", "kirdud nikholas", "initial"), ("kirdud tim", "kirdud timothi", "initial"), ("baldud kirdud", "baldud torvex", ""), ("星河云海", "星云河海", "near"), ("星云", "星河云海", "part"), ("上海星河云", "星河云", "prefixed")])
def test_aligned(a, b, how):
    assert aligned(a, b) == how == aligned(b, a)
    if how == "initial":
        assert set(keys(a)) & set(keys(b))
    if how == "near":
        assert near(a, b) or set(keys(a)) & set(keys(b))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "t") for r in rows], FIRM)


ROWS = [
    ("1", "Kirdud Baldud Systems Inc.", "https://kirdud-baldud.example", "Lowmarsh", "2001-01-01"),
    ("2", "baldud kirdud sys.", "n/a", None, "2001-01-01"),
    ("3", "Kirdud Balduud Systems", None, "Lowmarsh", None),
    ("4", "K. Baldud Systems", "", "Lowmarsh", None),
    ("5", "KBS", "http://shop.kirdud-baldud.example/x", None, None),
    ("6", "Kirdud Baldud Insurance", "https://kirdud-baldud-insurance.example", "Zalpa", "1980-01-01"),
    ("7", "Torvex Logistics", None, None, None),
    ("8", None, None, None, None),
    ("9", "", "", "", None),
    ("1", "Kirdud Baldud Systems Inc.", "https://kirdud-baldud.example", "Lowmarsh", "2001-01-01"),
]


def test_classes(spark):
    got = {r.id: r.firm for r in firm_classes(frame(spark, [*ROWS, (None, "x", None, None, None)])).collect()}
    assert got == {**dict.fromkeys("12345", "1"), **{k: k for k in "6789"}}


def test_a_firm_with_most_rows(spark):
    rows = ROWS + [(f"h{i:04d}", "Kirdud Baldud Systems Inc.", f"http://x{i}.example", None, None) for i in range(400)]
    classes = firm_classes(frame(spark, rows))
    assert variant_pairs(classes).count() == 405 * 404 // 2 and variant_pairs(classes).where("id_a >= id_b").count() == 0


def test_empty(spark):
    assert firm_classes(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("a", "b", "how"), [("anna garcia lopez maria ruiz", "a garcia lopez maria ruiz", "initial"), ("abel bodo carla dora emil", "abel boddo carla dora emill", "near"), ("nthrn torvex", "northern torvex", "initial"), ("kim torvex", "kin torvex", "close"), ("badlud kirddud", "baldud kirdud", "near"), ("anna lopez maria", "anna lopez", "part"), ("kirdudtorvex", "torvex kirdud", "near"), ("a b c d e f", "g h i j k l", "")])
def test_tokens_of_any_number(a, b, how):
    assert aligned(a, b) == how == aligned(b, a)


def test_assignment_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        n, more = rng.randint(1, 5), rng.randint(0, 1)
        cost = [[rng.choice([0.0, 1.0, 1.1, 100.0]) for _ in range(n + more)] for _ in range(n)]
        best = min(sum(cost[i][j] for i, j in enumerate(order)) for order in permutations(range(len(cost[0])), n))
        assert abs(sum(cost[i][j] for i, j in enumerate(cheapest(cost))) - best) < 1e-9


def test_keys_meet_for_slips_in_two_tokens_of_one_date():
    assert set(keys("baldud kirdud", "systems", "2001")) & set(keys("badud kirdd", "systems", "2001")) and not set(keys("baldud kirdud")) & set(keys("badud kirdd"))
    assert set(keys("kim torvex")) & set(keys("kin torvex")) and "n:bks|2001" in keys("baldud kirdud", "systems", "2001")


def test_many_spellings_on_one_domain(spark):
    names = ["Kirdud Baldud Systems", "Kirrdud Baldud Systems", "Kirdud Balddud Systems", "Kirdud Baldudd Systems", "Kirdudd Baldud Systems", "Kiirdud Baldud Systems", "Kirdud Balduud Systems"]
    rows = [(f"{i}", n, "https://kirdud-baldud.example/team", None, None) for i, n in enumerate(names)] + [("9", "KBS", "https://kirdud-baldud.example/about", None, None)]
    assert len({r.firm for r in firm_classes(frame(spark, rows)).collect()}) == 1


def test_initials_with_a_date(spark):
    rows = [("1", "Kirdud Baldud Systems", None, None, "2001-01-01"), ("2", "K.B.S.", "https://kirdudbaldud.example", None, "2001-01-01"), ("3", "K.B.S.", None, None, "1999-01-01"), ("4", "KBT", None, None, "2001-01-01")]
    assert {r.id: r.firm for r in firm_classes(frame(spark, rows)).collect()} == {"1": "1", "2": "1", "3": "3", "4": "4"}


def test_a_name_of_many_firms_makes_few_pairs(spark, monkeypatch):
    import lumenry.llm.entities as e

    rows = [(f"{i:04d}", "Smith Software", f"https://smith{i}.example", f"Town {i}", f"{1000 + i}-01-01") for i in range(2000)]
    seen, real = [], e.staged
    monkeypatch.setattr(e, "staged", lambda df: seen.append(out := real(df)) or out)
    classes = firm_classes(frame(spark, rows + [("9999", "Smith Software", None, None, None)]))
    assert classes.select("firm").distinct().count() == 2001
    assert all(df.count() <= 40_000 for df in seen)
