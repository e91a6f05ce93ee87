"""Blocking by rare grams and the bounds that keep names from being aligned."""

import difflib
import random

from loomgraph.operators import construct


def test_a_common_beginning_brings_no_names_together(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfghjklmnp") for _ in range(8))
    names = [f"theunitedcompanyof{word()}" for _ in range(300)]
    mentions = [(n, f"{names[n]}{'ltd' if n % 2 else ''}"[: None if n % 3 else -1]) for n in range(0, 300, 3)] + [(900, "ab"), (901, ""), (902, "theunitedcompanyof"), (903, None)]
    m = spark.createDataFrame(mentions, "mention_id long, name string")
    e = spark.createDataFrame([(f"E{n}", name) for n, name in enumerate(names)] + [("E900", "ab"), ("E901", "abc")], "id string, name string")
    want = {(i, k) for i, name in mentions if name for k, other in [(f"E{n}", x) for n, x in enumerate(names)] + [("E900", "ab"), ("E901", "abc")] if name == other or (min(len(name), len(other)) >= 3 and (name in other or other in name))}
    assert {tuple(r) for r in construct.blocked(m, e, limit=1000).collect()} == want
    pairs = construct.candidate_pairs(m.filter("length(name) > 18").toDF("s_id", "s"), e.toDF("l_id", "l")).count()
    assert pairs < 0.05 * len(mentions) * len(names)


def test_hot_grams_are_split(spark, monkeypatch):
    monkeypatch.setattr(construct, "GRAM_PART", 7)
    m = spark.createDataFrame([(1, "aaa"), (2, "aaaa")], "mention_id long, name string")
    e = spark.createDataFrame([(n, "xaaaa" + "a" * (n % 3)) for n in range(40)], "id long, name string")
    assert construct.blocked(m, e, limit=100).count() == 80
    assert construct.candidate_pairs(m.toDF("s_id", "s"), e.toDF("l_id", "l")).count() == 80


def test_bounds_never_decide_wrongly():
    rng = random.Random(7)
    aligned = 0
    for _ in range(3000):
        a = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 12)))
        b = a[: rng.randint(0, len(a))] + "".join(rng.choice("abcde") for _ in range(rng.randint(0, 6))) or "a"
        assert construct.alike(a, b, 0.85) == (difflib.SequenceMatcher(None, a, b).ratio() >= 0.85)
        aligned += 2 * min(len(a), len(b)) >= 0.85 * (len(a) + len(b)) and difflib.SequenceMatcher(None, a, b).quick_ratio() >= 0.85
    assert aligned < 1500


def test_mentions_and_entities_of_one_name_are_compared_once(spark, monkeypatch):
    seen = []
    pairs = construct.candidate_pairs
    monkeypatch.setattr(construct, "candidate_pairs", lambda short, long: seen.append(pairs(short, long)) or seen[-1])
    names = ["red ring", "Red Ring!", "big red rings", "blue bolt"]
    m = spark.createDataFrame([(n, names[n % 4]) for n in range(400)], "mention_id long, name string")
    e = spark.createDataFrame([(n, names[n % 4]) for n in range(1200)], "id long, name string")
    found = {}
    for r in construct.blocked(m, e, limit=20).collect():
        found.setdefault(r[0], set()).add(r[1])
    same = {0: [0, 1], 1: [0, 1], 2: [2], 3: [3]}
    assert found == {n: set([k for k in range(1200) if k % 4 in same[n % 4]][:20]) for n in range(400)}
    assert sum(rows.count() for rows in seen) <= 10
