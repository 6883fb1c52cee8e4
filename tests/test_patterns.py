"""C2 for tables of patterns."""

import random
import re

from pyspark.sql import functions as F

from platewise.operators import patterns, similarity


def test_needed_literals():
    cases = {
        "brand#1$|brand#2": ["brand#1", "brand#2"], "Italian": ["italian"], "x*": [], ".*": [],
        "[ab]cd": ["acd", "bcd"], "(?i)Foo.bar": ["foo"], "(": None, r"\bcafe\b": ["cafe"],
        "cafés": ["caf"], "(foo|.*)": [], "(?=abc)d": ["d"], "(?:ab)+xyz": ["xyz"], "": [],
        "a{2,}b": ["a"], "North|South Indian": ["north", "south indian"],
    }
    for pattern, want in cases.items():
        got = patterns.needed(pattern)
        assert (got is None and want is None) or sorted(got) == sorted(want), pattern


def random_pattern(rng, depth=0):
    parts = ["a", "b", "s", "ab", "K", ".", "[ab]", "[^a]", r"\w", "é", "ſ", "^", "$", r"\b", " "]
    out = ""
    for _ in range(rng.randint(1, 4)):
        p = rng.choice(parts)
        if depth < 2 and rng.random() < 0.3:
            p = "(" + "|".join(random_pattern(rng, depth + 1) for _ in range(rng.randint(1, 3))) + ")"
        out += p + rng.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}"] if p not in ("^", "$", r"\b") else [""])
    return out


def test_every_match_has_a_needed_literal():
    rng = random.Random(1)
    fold = str.maketrans(*patterns.FOLDED)
    texts = ["".join(rng.choices("abskABSKéſKıİ. ", k=rng.randint(0, 12))) for _ in range(300)]
    tried = 0
    for _ in range(2000):
        p = random_pattern(rng)
        literals = patterns.needed(p)
        if not literals:
            continue
        tried += 1
        compiled = re.compile(p, re.IGNORECASE)
        for t in texts:
            if compiled.search(t):
                low = t.translate(fold).lower()
                assert any(x in low for x in literals), (p, t, literals)
    assert tried > 500


def test_matching_texts(spark):
    rng = random.Random(3)
    texts = sorted({"".join(rng.choices("abskABSKéſKıİ, ", k=rng.randint(0, 14))) for _ in range(150)})
    asked = sorted({random_pattern(rng) for _ in range(150)} | {"(", "", ".*", "ab", "zzz", "sk"})
    got = patterns.matching_texts(
        spark.createDataFrame([(p,) for p in asked], "p string"), "p",
        spark.createDataFrame([(t,) for t in texts], "t string"), "t",
    )
    want = set()
    for p in asked:
        try:
            compiled = re.compile(p, re.IGNORECASE)
        except re.error:
            continue
        want |= {(p, t) for t in texts if compiled.search(t)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_hundred_thousand_patterns(spark):
    """Each pattern meets the texts with its rarest gram only."""
    asked = spark.range(100_000).select(F.concat(F.lit("Dish "), F.col("id"), F.lit("$")).alias("p"))
    texts = spark.range(0, 100_000, 97).select(F.concat(F.lit("a, dish "), F.col("id")).alias("t"))
    found = patterns.candidates(asked, "p", texts, "t")
    assert found.count() < 40 * 100_000  # all pairs would be 100 million
    got = patterns.matching_texts(asked, "p", texts, "t")
    assert got.count() == texts.count()


def test_no_array_of_patterns_in_the_plan(spark, venues_small):
    req = spark.createDataFrame(
        [(i, None, f"brand#{i}", None, None, None) for i in range(30)], similarity.REQUEST_SCHEMA
    )
    plan = similarity.recommend(req, venues_small, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(q_cuisine" not in plan
