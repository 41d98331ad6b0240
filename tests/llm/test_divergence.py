import random
import re
from collections import Counter, defaultdict

from heddle.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_df, top):
    held, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(SMALL))
        groups.add((lang, source))
        held[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    share = lambda n, total, v: 1 + 10**9 * (n + 2) // (total + 2 * v)
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_df)
        mine = sorted(s for x, s in groups if x == lang)
        total = {s: sum(held[lang, s][t] for t in kept) for s in mine}
        whole = {t: sum(held[lang, s][t] for s in mine) for t in kept}
        p = {s: [share(held[lang, s][t], total[s], len(kept)) for t in kept] for s in mine}
        q = [share(whole[t], sum(whole.values()), len(kept)) for t in kept]
        for s in mine:
            pairs = [(-sum(map(apart, p[s], p[x])), x.encode()) for x in mine if x != s]
            terms = [(-apart(a, b), t.encode()) for t, a, b in zip(kept, p[s], q) if held[lang, s][t] and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank + 1) for rank, (value, item) in enumerate(found)]
    return sorted(out)


def made(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "été", "ÉTÉ", "x", "naïve", "日本", "a", "zebra", "Q"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(n):
        source = rng.choice(["s0", "s0", "s0", "s1", "S1", "", None, "ß"])
        text = rng.choice(["", None, "12 34 !"]) if rng.random() < 0.2 else "-1 ".join(rng.choices(words[: rng.randint(3, 30)], k=rng.randint(1, 40)))
        rows.append((rng.choice(["en", "en", "de", None, "a b"]), source, text))
    return rows + [("one", "only", "few words"), ("two", "a", None), ("two", "b", "x y"), ("en", "silent", "... 77")]


def check(spark, rows, min_df=3, top=4):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, value int, TERM int")
    found = divergence.audit(docs.repartition(3), min_df, top)
    assert found.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, min_df, top)


def test_against_brute_force(spark):
    check(spark, made(150))


def test_blocks_and_shares_do_not_matter(spark, monkeypatch):
    for name, value in (("SHARE_TERMS", 20), ("TERM_BLOCK", 5), ("SOURCE_BLOCK", 2), ("HELD_ENTRIES", 50)):
        monkeypatch.setattr(divergence, name, value)
    check(spark, made(120, 2))
    monkeypatch.setattr(divergence, "HELD_SUMS", 30)
    check(spark, made(60, 4))


def test_nothing_kept_empty_and_long(spark):
    check(spark, made(30, 3), min_df=1000)
    check(spark, [])
    check(spark, [(None, None, None)] * 3)
    check(spark, [("en", "s", "word " * 200_000 + "é"), ("en", "t", "word other " * 3)] * 3)
