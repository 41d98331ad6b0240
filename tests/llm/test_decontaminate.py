import hashlib
import random
import re

import pytest

from heddle.llm.decontaminate import contamination, phrase_matches, phrases, positional_index, proximity_index, proximity_matches, term_filter, text_runs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items, size):
    windows = set()
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.add((item, tuple(w[i : i + size])))
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
        named = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(named.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(spark, docs, items, size):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as term", "2 as N_HIT", "3 as row", "4 as item_id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as terms", "2 as Query")
    got = contamination(d.repartition(3), b, size).drop("row")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, size)


def test_small_vocabulary_many_hits(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["A", "b", "c,", "é-", "d7"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(1, "a b c"), (1, "a b c"), (None, text(30)), (50, None), (51, ""), (52, "... !")]
    items = [(i, text(rng.randint(0, 9))) for i in range(12)] + [(3, "zz zz"), (None, "a b"), (20, None), (21, "b"), (21, "b")]
    check(spark, docs, items, 4)


def test_nothing_to_find(spark):
    check(spark, [], [(1, "a b")], 13)
    check(spark, [(1, "a b"), (2, None)], [], 13)
    check(spark, [(1, "a b")], [(1, None), (2, "?!")], 13)
    check(spark, [(1, "word " * 30_000 + "the end is near")], [(1, "The END is near")], 13)


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(1, "a x b y c a"), (2, "c b a"), (3, "a a a")], "doc_id long, text string")
    queries = phrases(spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "x"), (4, "y")], "item_id long, text string"))
    return positional_index(text_runs(docs, *term_filter(queries)))


def test_phrases(spark, index):
    queries = spark.createDataFrame([("p", ["a", "x", "b"]), ("q", ["a", "a"]), ("r", ["c", "a", "b"]), ("s", ["b"]), ("t", ["a", "nowhere"])], "query string, terms array<string>")
    got = {(r["query"], r.doc_id, r.start) for r in phrase_matches(index, queries).collect()}
    assert got == {("p", 1, 0), ("q", 3, 0), ("q", 3, 1), ("s", 1, 2), ("s", 2, 1)}


def test_proximity(spark, index):
    queries = spark.createDataFrame([("p", ["a", "b"]), ("q", ["c", "x", "a"]), ("s", ["b"]), ("t", ["a", "a"])], "query string, terms array<string>")
    near = lambda slop: {(r["query"], r.doc_id, r.position) for r in proximity_matches(index, queries, slop).collect()}
    alone = {("s", 1, 2), ("s", 2, 1), ("t", 1, 0), ("t", 1, 5), ("t", 2, 2), ("t", 3, 0), ("t", 3, 1), ("t", 3, 2)}
    assert near(1) == alone | {("p", 2, 1)}
    assert near(3) == alone | {("p", 1, 2), ("p", 2, 1), ("q", 1, 1)}


def test_proximity_of_terms_between_other_words(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "a b c"), (3, "x a y")], "doc_id long, text string")
    queries = spark.createDataFrame([("p", ["a", "b"]), ("q", ["a", "b", "c"])], "query string, terms array<string>")
    found = proximity_matches(proximity_index(docs, queries), queries, 2)
    assert {(r["query"], r.doc_id) for r in found.collect()} == {("p", 1), ("p", 2), ("q", 1), ("q", 2)}
    assert proximity_index(docs, queries.limit(0)).count() == 0
