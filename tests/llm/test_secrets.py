import math
import random
import re
from collections import defaultdict

import pytest

from heddle.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
BASE = (("assign", ASSIGN, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
RUN = re.compile(ASSIGN.pattern + "|[A-Za-z0-9+/_=-]+", re.I | re.A)
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def base_spans(text):
    found = []
    for no, (_, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), no, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(found)


def encoding(core):
    if re.fullmatch("[0-9]+|[a-z]+|[A-Z]+", core):
        return None
    for name, letters in (("hex", DIGITS + "abcdef"), ("hex", DIGITS + "ABCDEF"), ("base32", UPPER + "234567"), ("base36", DIGITS + LOWER), ("base36", DIGITS + UPPER), ("base62", UPPER + LOWER + DIGITS), ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64", UPPER + LOWER + DIGITS + "-_")):
        if set(core) <= set(letters):
            return name, letters
    return None


def p_value(core, letters):
    x, k, n = [letters.index(c) for c in core], len(letters), len(core)
    chi = sum((x.count(v) - n / k) ** 2 / (n / k) for v in range(k))
    ratio = 2 * (k - 1) * (n - 1) / n / (k - 1) ** 2
    z = [((chi / (k - 1)) ** (1 / 3) - (1 - ratio / 9)) / math.sqrt(ratio / 9)]
    side = [v >= k / 2 for v in x]
    z.append((sum(a != b for a, b in zip(side, side[1:])) - (n - 1) / 2) / math.sqrt((n - 1) / 4))
    z.append(sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in zip(x, x[1:])) / ((k * k - 1) / 12) / math.sqrt(n - 1))
    tails = [2 / (1 + math.exp(min(30, 1.5976 * abs(v) + 0.07056 * abs(v) ** 3))) for v in z]
    return 0.5 - math.atan(sum(math.tan((0.5 - min(p, 0.999999)) * math.pi) for p in tails) / 3) / math.pi


def brute(texts, rate=0.05):
    tokens, strata = [], defaultdict(dict)
    for text in texts:
        own = []
        for m in RUN.finditer(text or ""):
            core = m[0].rstrip("=")
            if m[1] or len(core) < 20 or ASSIGN.search(m[0]) or re.search(ASSIGN.pattern.partition(r"\x20*[:=]")[0] + r"\x20*[:=]", m[0], re.I) or re.search("[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", m[0]):
                continue
            if known := encoding(core):
                key = known[0], min(40, math.floor(2 * math.log2(len(core))))
                p = p_value(core, known[1])
                strata[key][core] = p
                own.append((m.start(), m.end(), key, p))
        tokens.append(own)
    limit = {}
    for key, ps in strata.items():
        for t in secrets.THRESHOLDS:
            n = sum(p >= t for p in ps.values())
            if n and n - 2 * sum(p > 0.5 for p in ps.values()) * (1 - t) <= rate * n:
                limit[key] = t
                break
    return [sorted(base_spans(text or "") + [(a, 3, b) for a, b, key, p in own if p >= limit.get(key, 2)]) for text, own in zip(texts, tokens)]


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, start int, TEXT int").repartition(3)
    found = secrets.secret_spans(docs).collect()
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in found}
    expected = dict(enumerate(brute(texts)))
    assert got == expected
    return expected


def made(n, seed=2):
    rng = random.Random(seed)
    pick = lambda letters, a, b: "".join(rng.choices(letters, k=rng.randint(a, b)))
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 12)):
            kind = rng.randrange(12)
            key = rng.choice(["password", "PassWd", "SECRET", "token", "api_key", "apikey", "APIKey"])
            quote, gap = rng.choice(["", "'", '"']), " " * rng.randrange(3)
            parts.append(
                [
                    lambda: f"{key}{quote}{gap}{rng.choice(':=')}{gap}{quote}{pick(UPPER + DIGITS + '.=-', 1, 12)}{quote}",
                    lambda: "AKIA" + pick(UPPER + DIGITS, 1, 30),
                    lambda: pick("0123456789abcdef", 10, 44),
                    lambda: pick(UPPER + LOWER + DIGITS + "+/", 15, 60) + "=" * rng.randrange(3),
                    lambda: pick(UPPER + "234567", 18, 40),
                    lambda: pick(LOWER + DIGITS, 18, 40),
                    lambda: rng.choice(["internationalisationWorks", "get_elements_by_tag_name", "usr/local/share/applications", "-" * 30, "=" * 40, "a1" * 15, "2024" * 8, "x" * 50]),
                    lambda: rng.choice(["é日本😀", "naïve", "secret:token : abcdefgh", "ſecret=abcdefgh", "toKen=abcdefgh"]),
                ][kind % 8]()
                if kind < 11
                else rng.choice(["the", "of", "words"])
            )
        texts.append(rng.choice([" ", "\n", ", "]).join(parts))
    return texts


def test_against_brute_force(spark):
    expected = check(spark, made(250) + [None, "", "plain words only"])
    kinds = [k for spans in expected.values() for _, k, _ in spans]
    assert all(kinds.count(k) > 20 for k in range(4))


def test_repeats_empty_and_long(spark, monkeypatch):
    check(spark, made(6) * 5)
    assert secrets.secret_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    many = " ".join(f"token = v{i:06d}x é" for i in range(700))
    check(spark, [many, many, "0" * 5000 + "g" + "word " * 100_000 + "deadbeef" * 9])


def test_words_are_left_alone_and_random_tokens_found(spark):
    rng = random.Random(8)
    words = ["".join(w).replace("Z", "") for w in zip(*[["Get", "Set", "Find", "Load"] * 60, ["Elements", "Document", "Configuration", "Parameters"] * 60, ["ByTagName", "FromContext", "ForWindow2", "InContainer"] * 60, [f"{rng.choice('ABCDE')}bout{i}" for i in range(240)]])]
    drawn = ["".join(rng.choices(UPPER + LOWER + DIGITS, k=rng.choice([32, 40]))) for _ in range(60)]
    texts = [f"see {w} and more" for w in words] + [f"key {d} here" for d in drawn]
    found = check(spark, texts)
    assert sum(bool(found[i]) for i in range(len(words))) <= 0.05 * len(words)
    assert sum(bool(found[i]) for i in range(len(words), len(texts))) >= 0.9 * len(drawn)


@pytest.mark.parametrize("text,expected", [("token: abcdef", "assign:0:13"), ("x AKIA" + "B" * 16, "access:2:22"), ("é" + "a0" * 12, "hex:1:25"), ("token: abc", "")])
def test_listed(spark, text, expected):
    found = secrets.secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert found.select(secrets.listed(found.spans)).first()[0] == expected
