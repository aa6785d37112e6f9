import datetime as dt
import random

import pytest

from lumenry.llm.conversations import conversation_state, rebuilt_conversations, reply_links, thread_links
from lumenry.llm.pairs import _open, _other_language, _refuses, _same, language, pair_defects, prompt_response_pairs

MESSAGE = "id string, conversation_id string, role string, content string, created_at timestamp_ntz, key string, conv string, day string"
T0 = dt.datetime(2024, 3, 1, 23, 30)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], MESSAGE)


def conv(n):
    return f"{n:032x}"


def brute_pairs(rows):
    order = {}
    for mid, c, role, content, at in set(rows):
        bare = (c or "").strip().lower().translate(str.maketrans("", "", "{}-"))
        r = (role or "").strip().lower()
        if bare and set(bare) != {"0"} and r and at:
            order.setdefault(bare, []).append((at, r not in ("user", "human"), mid, content))
    out = set()
    for ms in order.values():
        ms.sort(key=lambda m: m[:3])
        for a, b in zip(ms, ms[1:]):
            if not a[1] and b[1]:
                out.add((b[2], b[3], a[3]))
    return out


def test_pairs_across_days_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        c = conv(1) if rng.random() < 0.4 else conv(rng.randrange(2, 60))
        c = rng.choice([c, c.upper(), "{" + c + "}", f" {c}\n"])
        at = None if rng.random() < 0.03 else T0 + dt.timedelta(minutes=10 * rng.randrange(600))
        rows.append((f"m{i:03d}", None if rng.random() < 0.02 else c, rng.choice(["user", "User ", "human", "assistant", "AI", " bot", None, ""]), f"t{i}", at))
    rows += rows[:60]
    got = [tuple(r) for r in prompt_response_pairs(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)


@pytest.mark.parametrize(("q", "a", "same"), [("Is it worth it?", "“is it worth it?”", True), ("Is it worth spending time on this page?", "Question: Is it wroth spending time on this page", True), ("Why now?", "Why now? Why now?", True), ("Is it worth it?", "Is it worth it? Yes, because links stay alive for long.", False), ("Is 2 good?", "Yes.", False), ("", "", False)])
def test_copies(q, a, same):
    assert _same(q, a) is same


@pytest.mark.parametrize(("a", "no"), [("I'm sorry, but I can't help with that.", True), ("Good question. Unfortunately I have to decline here. Please contact a qualified adviser.", True), ("I cannot see your logs, but the report is enough. Start with the titles and keep the old links alive.", False), ("这个问题我不能回答。", True), ("Leider muss ich hier ablehnen.", True), ("Je ne peux pas vous aider.", True), ("No puedo ayudar con eso.", True), ("You can't go wrong with short titles, and links help. Do both. Then wait.", False), ("Yes.", False)])
def test_refusals(a, no):
    assert _refuses(a, language(a)[0]) is no


def test_long_refusals():
    assert _refuses("I can't help with that. I won't answer. I must decline. I am unable to assist.", "en")
    assert _refuses("I can't help with that. " * 40, "en") and _refuses("这个问题我不能回答。" * 20, "zh")
    assert _refuses("Advising a shop is not something I'm permitted to do.", "en") and not _refuses("I can't help with that. " + "Start with the titles. " * 3, "en")


def test_copies_with_slips_of_any_length():
    assert _same("abcd efghi", "abcd efgih") and not _same("abcd efghi", "xbcd yfgiz")
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000))
    slipped = "".join("z" if i % 25 == 7 else c for i, c in enumerate(text))
    assert _same(text, slipped) and not _same(text, "".join("z" if i % 4 == 1 else c for i, c in enumerate(text)))
    assert not _same(text, "".join(rng.sample(text, len(text))))


def test_open_brackets_far_from_the_end():
    assert _open("see (page " + "and more words " * 60) and _open("[a (b] c (d") and not _open("[a (b] c") and not _open("1) one\n2) two") and _open("call f({") and not _open("„Hallo“ (ja)")


def test_languages():
    german = "Jede Seite braucht eine klare Überschrift und einen ersten Absatz, der die Frage beantwortet."
    assert _other_language("How should we improve the page for the hotel?", *language(german))
    assert not _other_language("Please answer in German: how should we improve the page?", *language(german))
    assert not _other_language("Wie verbessern wir die Seite für den Laden?", *language(german)) and not _other_language("", *language(german))
    assert language("这是中文") [0] == "zh" and language("12")[0] == ""


@pytest.mark.parametrize(("a", "is_open"), [("x\n```json\n{", True), ("x\n```json\n{}\n```", False), ("One.\n2) ", True), ("42.", False), ("see (page", True), ("a :(", False), ("- a\n- b", False)])
def test_open_ends(a, is_open):
    assert _open(a) is is_open


def test_defects_end_to_end(spark):
    good = "Give each page one clear heading. Keep the old addresses alive so that links stay. Ask two vendors for a fixed price."
    answers = {"e1": None, "e2": " \n", "e3": "null", "e4": "```\n```", "e5": "<p></p>", "c1": "What should we do with the pricing page?", "r1": "I can't help with that.", "l1": "Chaque page a besoin d'un titre clair et d'un premier paragraphe qui répond à la question.", "t1": good[:-20], "t2": "Do this.\n```json\n{", "g1": good, "g2": good[:-1], "g3": "Yes.", "g4": "x" * 200_000 + "."}
    rows, at = [], T0
    for i in range(30):
        answers[f"f{i}"] = good
    for i, (k, a) in enumerate(answers.items()):
        rows += [(f"q{k}", conv(i + 1), "user", "What should we do with the pricing page?", at), (k, conv(i + 1), "assistant", a, at)]
    got = {r.response_id: r.defects[0] for r in pair_defects(frame(spark, rows)).collect()}
    want = {"e1": "empty", "e2": "empty", "e3": "empty", "e4": "empty", "e5": "empty", "c1": "copy", "r1": "refusal", "l1": "language", "t1": "truncated", "t2": "truncated"}
    assert got == want
    assert pair_defects(frame(spark, [])).count() == 0


def test_states_and_turns(spark):
    m = lambda i, c, role, text, minute: (i, conv(c), role, text, None if minute is None else T0 + dt.timedelta(minutes=minute))
    rows = [m("1", 1, "user", "q", 0), m("2", 1, "bot", "a", 0), m("3", 1, "user", "q", 45), m("4", 1, "ai", "b", 46), m("4", 1, "ai", "b", 46)]
    rows += [m("5", 2, "user", "q", 0), m("6", 2, "user", "q", 1), m("7", 2, "ai", "b", 2)]
    rows += [m("8", 3, "ai", "b", 0)] + [m("9", 4, "user", "q", 0), m("10", 4, "ai", "b", 1), m("11", 4, "ai", "b", 2)]
    rows += [m("12", 5, "user", " ", 0)] + [m("13", 6, "user", "q", 0), m("14", 6, " ", "b", 1)] + [m("15", 7, "user", "q", 0), m("16", 7, "ai", "...", 1)] + [m("17", 8, "user", "q", None)]
    conversations = spark.createDataFrame([(conv(i),) for i in range(1, 10)] + [(conv(1),), (None,), (" ",)], "id string")
    got = {int(r.conversation_id.replace("-", ""), 16): r.reason for r in conversation_state(conversations, frame(spark, rows)).collect()}
    assert got == {1: None, 2: "missing_reply", 3: "broken", 4: "broken", 5: "empty", 6: "broken", 7: "missing_reply", 8: "broken", 9: "empty"}
    turns = [(r.turn, r.message_id, r.parent_id) for r in rebuilt_conversations(conversations, frame(spark, rows)).orderBy("turn").collect()]
    assert turns == [(1, "1", None), (2, "2", "1"), (3, "3", "2"), (4, "4", "3")]


def test_links_look_back(spark):
    m = lambda i, role, text, minute: (i, conv(1), role, text, T0 + dt.timedelta(minutes=minute))
    rows = [m("1", "user", "price of solar panels", 0), m("2", "ai", "solar panels price list", 1), m("3", "user", "thanks for the roof", 2), m("4", "user", "another matter entirely", 3), m("5", "ai", "thanks, the roof it is", 4), m("6", "ai", "@user yes", 5)]
    got = {r.id: (r.parent_id, r.prev_id) for r in reply_links(frame(spark, rows + rows[:3])).collect()}
    assert got["1"] == (None, None) and got["2"] == ("1", "1") and got["5"] == ("3", "4") and got["6"][1] == "5" and {k: v[1] for k, v in got.items()} == {"1": None, "2": "1", "3": "2", "4": "3", "5": "4", "6": "5"}


def test_states_follow_the_links(spark):
    m = lambda i, k, role, text, minute: (i, conv(k), role, text, T0 + dt.timedelta(minutes=minute))
    rows = [m("1", 1, "user", "solar roof", 0), m("2", 1, "user", "tax number", 1), m("3", 1, "ai", "tax number fine", 2), m("4", 1, "ai", "solar roof fine", 3), m("5", 2, "user", "q", 0), m("6", 2, "ai", "a", 1)]
    conversations = spark.createDataFrame([(conv(1),), (conv(2),)], "id string")
    state = lambda: {int(r.conversation_id.replace("-", ""), 16): r.reason for r in conversation_state(conversations, frame(spark, rows)).collect()}
    assert state() == {1: "broken", 2: None}
    links = {r.id: r.parent_id for r in reply_links(frame(spark, rows)).collect()}
    assert links["4"] == "1" and links["3"] == "2"
    rng = random.Random(9)
    many = [m(f"m{i:03d}", rng.randrange(1, 60), rng.choice(["user", "ai"]), rng.choice(["solar roof", "tax number", "garden fence", "", "..."]), rng.randrange(4000)) for i in range(240)]
    ids = spark.createDataFrame([(conv(i),) for i in range(1, 60)], "id string")
    with_links = sorted(map(tuple, conversation_state(ids, frame(spark, many)).collect()))
    by_order = {}
    for i in range(1, 60):
        ms = sorted({(x[4], x[2] != "user", x[0], x[2], x[3]) for x in many if x[1] == conv(i)})
        empty = lambda t: not t.strip(" .")
        if not ms or all(empty(x[4]) for x in ms):
            by_order[i] = "empty"
        elif ms[0][3] == "ai" or any(a[3] == b[3] == "ai" for a, b in zip(ms, ms[1:])):
            by_order[i] = "broken"
        elif any(x[3] == "user" and (n + 1 == len(ms) or ms[n + 1][3] != "ai" or empty(ms[n + 1][4])) for n, x in enumerate(ms)):
            by_order[i] = "missing_reply"
        else:
            by_order[i] = None
    assert {int(k.replace("-", ""), 16): r for k, r, _ in with_links} == by_order


def test_interleaved_threads(spark):
    m = lambda i, role, text, minute: (str(i), conv(1), role, text, T0 + dt.timedelta(minutes=minute))
    rows = [
        m(1, "user", "solar panels price roof", 0), m(2, "user", "invoice tax number missing", 40), m(3, "user", "bicycle repair garage", 80), m(4, "user", "garden fence paint", 120), m(5, "user", "kitchen lamp broken", 160),
        m(6, "ai", "solar panels price roof", 165), m(7, "ai", "invoice tax number missing", 166), m(8, "user", "solar panels roof warranty", 200), m(9, "user", "wholly different", 3000), m(10, "ai", "gladly", 6000),
    ]
    frame_ = frame(spark, rows + rows[:2])
    got = {int(r.id): (r.parent_id, r.root_id) for r in thread_links(frame_).collect()}
    assert got == {1: (None, "1"), 2: (None, "2"), 3: (None, "3"), 4: (None, "4"), 5: (None, "5"), 6: ("1", "1"), 7: ("2", "2"), 8: ("6", "1"), 9: (None, "9"), 10: ("9", "9")}
    pairs = [m(1, "user", "solar panels", 0), m(2, "ai", "solar panels answer", 1), m(3, "user", "invoice number", 60), m(4, "ai", "invoice number answer", 61), m(5, "user", "solar panels again", 100), m(6, "ai", "gladly", 101)]
    turns = rebuilt_conversations(spark.createDataFrame([(conv(1),)], "id string"), frame(spark, pairs)).orderBy("turn").collect()
    assert [(r.turn, r.parent_id, r.root_id) for r in turns] == [(1, None, "1"), (2, "1", "1"), (3, None, "3"), (4, "3", "3"), (5, "2", "1"), (6, "5", "1")]
