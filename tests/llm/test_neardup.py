import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from heddle.llm import neardup
from heddle.llm.common import Words
from heddle.llm.neardup import classes, probability_jaccard, shingles, signatures


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())


def brute(rows):
    bags = [bag(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (not bags[i] and not bags[j]) or rows[i][1] == rows[j][1] or similarity(bags[i], bags[j]) >= 0.8 - 1e-9:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        least[x] = min((v for v in (least.get(x), d) if v is not None), default=None)
    return sorted(((d, least[x]) for (d, _), x in zip(rows, label)), key=str)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as Text", "3 as bucket")
    assert sorted(((r.doc_id, r.class_id) for r in classes(docs.repartition(3)).collect()), key=str) == brute(rows)


def sets(text):
    grams, weights, _ = shingles(Words(pa.array([text])))
    return grams, weights


def test_similarity_and_estimate():
    rng = random.Random(3)
    for _ in range(15):
        base = [rng.choice("abcdefgh") + rng.choice("uvwxyz") for _ in range(rng.randint(5, 60))]
        other = [w if rng.random() > 0.03 else "new" for w in base] + base[:9] * rng.randint(0, 3)
        a, b = " ".join(base), " ".join(other)
        exact = similarity(bag(a), bag(b))
        assert probability_jaccard(sets(a), sets(b)) == pytest.approx(exact)
        grams, weights, first = shingles(Words(pa.array([a, b])))
        found = signatures(grams, weights, first, 4000)
        assert (found[0] == found[1]).mean() == pytest.approx(exact, abs=0.05)
    assert probability_jaccard(sets("a b c"), sets("a b c")) == 1 and probability_jaccard(sets("a b"), sets("a b c")) == 0


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [512, 3])
def test_groups(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    rows = []
    for _ in range(12):
        base = text(rng.randint(40, 160))
        rows += [(rng.randint(0, 500), edited(rng, base, rng.randint(0, 3))) for _ in range(rng.randint(1, 6))]
    shared = text(60)
    rows += [(1000 + i, shared + " " + text(15)) for i in range(40)]  # similar, but not enough
    chain = text(200)
    for i in range(8):  # each near the next one
        rows.append((2000 + i, chain))
        chain = edited(rng, chain, 2)
    rows += [(9, None), (8, ""), (7, " \n"), (5, "one two"), (6, "one  two"), (4, "one three"), (None, rows[0][1]), (None, "all alone here"), rows[1], rows[1]]
    rows += [(3000, "the same " * 400), (3001, "the same " * 380 + "end"), (3002, "of " * 4000)]
    check(spark, rows)


def test_no_rows(spark):
    check(spark, [])
    check(spark, [(1, "a"), (2, "b")])


def test_pairs_of_a_block_at_once():
    rng = random.Random(6)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(10, 90))]
        line = [f"v{rng.randint(0, 30)}" for _ in range(9)]
        for _ in range(7):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w + line * rng.choice([0, 1, 2, 2, 3, 7, 11])))
    grams, weights, first = shingles(Words(pa.array(texts)))
    bags = [(grams[x:y], weights[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
    pairs = np.array([(i, j, 0) for i in range(len(bags)) for j in range(i + 1, len(bags))])
    exact = np.array([probability_jaccard(bags[i], bags[j]) for i, j, _ in pairs.tolist()])
    for limit in (0.3, 0.6, 0.8, 0.95):
        answer = neardup._similar(bags, pairs, limit)
        assert (answer != 2).mean() > 0.7
        assert ((answer == 1) == (exact >= limit - 1e-9))[answer != 2].all()
    with_few = np.array([max(w.max() for w in (bags[i][1], bags[j][1])) <= 3 for i, j, _ in pairs.tolist()])
    assert (neardup._similar(bags, pairs[with_few], 0.8) != 2).all()


def test_recall_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = {r.doc_id: r.label for r in classes(docs).collect()}
    grams, weights, first = shingles(Words(pa.array([t for _, t in rows])))
    order = np.lexsort((np.repeat(np.arange(len(rows)), np.diff(first)), grams))
    owner, gram = np.repeat(np.arange(len(rows)), np.diff(first))[order], grams[order]
    pairs = set()
    for a, b in zip(np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]), np.r_[np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram)]):
        held = owner[a:b].tolist()
        pairs.update((i, j) for k, i in enumerate(held) for j in held[k + 1 :])
    bags = [(grams[x:y], weights[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
    links = [(i, j) for i, j in pairs if probability_jaccard(bags[i], bags[j]) >= 0.8]
    assert len(links) > 50 and all(found[rows[i][0]] == found[rows[j][0]] for i, j in links)
