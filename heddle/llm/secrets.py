"""Secrets in texts: fixed patterns, and a battery of randomness tests over other tokens. DataFrame functions only.

A token gets the smallest encoding that holds it. Three tests ask whether its symbols look drawn at random from that
encoding's alphabet: chi-squared (are all symbols equally frequent), runs (how often the symbols cross the middle of the
alphabet) and serial correlation (does a symbol tell the next one). The Cauchy combination makes one p-value of the three, which holds
whether or not they depend on each other.

Random tokens have p-values spread evenly, ordinary ones gather near 0. So in each stratum of one encoding and similar length, counted over
the distinct tokens of all documents, twice the tokens above 0.5 estimate how many are random, and the least threshold is
taken above which at most `rate` of the tokens are more than that estimate: short tokens, on which the tests have little
power, need a higher p-value than long ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import pick
from heddle.session import cut

# The patterns of the contract, the least lengths, and the order of kinds.
KINDS = ("assign", "access", "hex", "random")
KEY = r"(password|passwd|secret|token|api_?key)"
ASSIGN = rf"(?i){KEY}[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # a match of AKIA[A-Z0-9]+ that is shorter holds no longer one
HEX = "[0-9a-f]{24,}"
LEAST_ASSIGNED = 6

#: Runs that can be a token: at least so many characters, not after one of them; assignments come first and are told apart.
LEAST_TOKEN = 20
TOKEN = rf"{ASSIGN}|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}"
#: Tokens that hold a span of the other kinds.
TAKEN = rf"(?i:{KEY}[\"']?\x20*[:=])|{HEX}|{ACCESS}"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the smallest: name, pattern of the whole token (without padding), alphabet. Tokens of one case of letters alone,
#: or of digits alone, are words and numbers.
ENCODINGS = (
    (None, "[0-9]+|[a-z]+|[A-Z]+", ""),
    ("hex", "[0-9a-f]+|[0-9A-F]+", _DIGITS + "abcdef"),
    ("base32", "[A-Z2-7]+", _UPPER + "234567"),
    ("base36", "[0-9a-z]+|[0-9A-Z]+", _DIGITS + _LOWER),
    ("base62", "[0-9A-Za-z]+", _UPPER + _LOWER + _DIGITS),
    ("base64", "[0-9A-Za-z+/]+|[0-9A-Za-z_-]+", _UPPER + _LOWER + _DIGITS + "+/"),
)
#: Thresholds that are tried, from the least.
THRESHOLDS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
#: Lengths are alike within half a power of two; beyond this class all are.
LAST_LENGTH_CLASS = 40
#: Elements whose sums are taken one by one; longer lists go by pieces of so many.
PIECE = 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _starts(lengths: Column) -> Column:
    """For each element the sum of those before it. The list goes by pieces, so that a long one does not cost its square."""
    pieces = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / PIECE).cast("int"))
    piece = lambda i: F.slice(lengths, i * PIECE + 1, PIECE)
    sums = F.transform(pieces, lambda i: _sum(piece(i)))
    begins = F.transform(sums, lambda _, i: F.struct(_sum(F.slice(sums, F.lit(1), i)).alias("before"), piece(i).alias("own")))
    return F.flatten(F.transform(begins, lambda b: F.transform(b["own"], lambda _, i: b["before"] + _sum(F.slice(b["own"], F.lit(1), i)))))


def _with_matches(df: DataFrame, pattern: str, out: str, possible: Column) -> DataFrame:
    """`out`: start, end (code points, end exclusive) and text of the leftmost matches, in order. Starts are the lengths of what stands
    between the matches and of the matches before. Each list is a column of its own, so that it is made once."""
    none = F.array().cast("array<string>")
    df = df.withColumn("_found", F.when(possible, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_between", F.when(F.size("_found") > 0, F.split("text", pattern, -1)).otherwise(none))
    sizes = F.zip_with("_found", F.slice("_between", 1, F.size("_found")), lambda m, g: F.struct(F.char_length(g).cast("long").alias("gap"), F.char_length(m).cast("long").alias("own"), m.alias("text")))
    df = df.withColumn("_sizes", sizes)
    df = df.withColumn("_lengths", F.transform("_sizes", lambda s: s["gap"] + s["own"]))
    df = df.withColumn("_starts", F.when(F.size("_sizes") > 0, _starts(F.col("_lengths"))).otherwise(F.array().cast("array<bigint>")))
    begin = lambda s, b: b + s["gap"]
    spans = F.zip_with("_sizes", "_starts", lambda s, b: F.struct(begin(s, b).alias("start"), (begin(s, b) + s["own"]).alias("end"), s["text"].alias("text")))
    return df.withColumn(out, spans).drop("_found", "_between", "_sizes", "_lengths", "_starts")


def _tested(tokens: Column) -> Column:
    """start, end, encoding, class of length, hash and p-value of the tokens (start, end, text) that have an encoding."""
    core = lambda t: F.regexp_replace(t["text"], "=+$", "")
    tokens = F.filter(tokens, lambda t: ~t["text"].rlike(TAKEN))
    tokens = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), core(t).alias("core")))

    def encoding(t: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, pattern, _ in reversed(ENCODINGS):
            found = F.when(t["core"].rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(found)
        return found

    tokens = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["core"].alias("core"), encoding(t).alias("encoding")))
    tokens = F.filter(tokens, lambda t: t["encoding"].isNotNull() & (F.char_length(t["core"]) >= LEAST_TOKEN))

    def symbols(t: Column) -> Column:
        alike = F.when(t["encoding"].isin("hex", "base36"), F.lower(t["core"])).otherwise(F.translate(t["core"], "-_", "+/"))
        alphabet = F.element_at(F.create_map(*[F.lit(x) for name, _, letters in ENCODINGS if name for x in (name, letters)]), t["encoding"])
        return F.struct(
            *[t[x].alias(x) for x in ("start", "end", "encoding")],
            F.xxhash64(t["core"]).alias("hash"),
            F.transform(F.split(alike, ""), lambda c: F.instr(alphabet, c) - 1).alias("x"),
            F.char_length(alphabet).cast("double").alias("k"),
        )

    def sums(t: Column) -> Column:
        n = F.size(t["x"])
        pairs = lambda f: F.zip_with(F.slice(t["x"], F.lit(1), n - 1), F.slice(t["x"], F.lit(2), n - 1), f)
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        often = F.transform(F.array_distinct(t["x"]), lambda v: F.size(F.filter(t["x"], lambda y: y == v)).cast("double"))
        middle = (t["k"] - 1) / 2
        return F.struct(
            *[t[x].alias(x) for x in ("start", "end", "encoding", "hash", "k")],
            n.cast("double").alias("n"),
            total(F.transform(often, lambda o: o * o)).alias("squares"),
            total(pairs(lambda a, b: ((a > middle) != (b > middle)).cast("double"))).alias("crossings"),
            total(pairs(lambda a, b: (a - middle) * (b - middle))).alias("products"),
        )

    def scores(t: Column) -> Column:
        k, n = t["k"], t["n"]
        spread = 2 * (n - 1) / (n * (k - 1))  # variance of chi-squared over its squared mean
        chi = (F.cbrt((k / n * t["squares"] - n) / (k - 1)) - (1 - spread / 9)) / F.sqrt(spread / 9)
        runs = (t["crossings"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = t["products"] / ((k * k - 1) / 12 * F.sqrt(n - 1))
        return F.struct(*[t[x].alias(x) for x in ("start", "end", "encoding", "hash", "n")], F.array(F.abs(chi), F.abs(runs), F.abs(serial)).alias("z"))

    def combined(t: Column) -> Column:
        # both tails of the normal distribution, by a logistic curve that is within 0.0002 of it
        tails = F.transform(t["z"], lambda z: 2 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(30.0)))))
        mean = F.aggregate(tails, F.lit(0.0), lambda a, p: a + F.tan((0.5 - F.least(p, F.lit(0.999999))) * math.pi) / 3)
        length = F.least(F.floor(2 * F.log2(t["n"])), F.lit(LAST_LENGTH_CLASS)).cast("int")
        return F.struct(*[t[x].alias(x) for x in ("start", "end", "encoding", "hash")], length.alias("length"), (0.5 - F.atan(mean) / math.pi).alias("p"))

    for step in (symbols, sums, scores, combined):
        tokens = F.transform(tokens, step)
    return tokens


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans by start, then kind: start, kind as its number, end) and tokens with their p-values, of docs(doc_id, text)."""
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = _with_matches(rows, ASSIGN, "assign", F.lit(True))
    rows = _with_matches(rows, ACCESS, "access", F.col("text").contains("AKIA"))
    rows = _with_matches(rows, HEX, "hex", F.lit(True))
    rows = _with_matches(rows, TOKEN, "token", F.lit(True))
    kept = F.filter("assign", lambda s: F.char_length(F.regexp_extract(s["text"], ASSIGN, 2)) >= LEAST_ASSIGNED)
    of_kind = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    base = F.concat(*[of_kind(spans, kind) for kind, spans in enumerate((kept, F.col("access"), F.col("hex")))])
    return rows.select("doc_id", F.sort_array(base).alias("base"), _tested(F.col("token")).alias("tokens"))


def thresholds(tokens: DataFrame, rate: float) -> DataFrame:
    """encoding, length and threshold of the strata in which one keeps the false share of the distinct tokens(encoding, length, hash, p)
    at `rate` at most."""
    once = tokens.select("encoding", "length", "hash", "p").distinct()
    above = [F.count_if(F.col("p") >= t).alias(f"n{i}") for i, t in enumerate(THRESHOLDS)]
    counted = once.groupBy("encoding", "length").agg(*above, F.count_if(F.col("p") > 0.5).alias("half"))
    holds = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i}") - 2 * F.col("half") * (1 - t) <= rate * F.col(f"n{i}")), F.lit(t)) for i, t in enumerate(THRESHOLDS)]
    return counted.select("encoding", "length", F.coalesce(*holds).alias("threshold")).filter("threshold is not null")


def secret_spans(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id and spans, an array of (start, kind, end) by start, then kind in the order of KINDS. Positions are
    code points, the end is exclusive, and a span is the whole match.

    `assign`, `access` and `hex` are the leftmost matches of their patterns that do not overlap, each kind for itself; assigned values
    of fewer than 6 characters are dropped. `random` are tokens of 20 or more characters outside these that pass
    the randomness tests at their stratum's threshold. A null or empty text has no spans. Repeated rows each get the result; their
    tokens count once for the thresholds. An empty table gives no rows. Other columns are not read.

    A document is scanned in its own row and nothing but tokens is shuffled, as hashes. What the driver reads is a number for each
    stratum, at most encodings times length classes.
    """
    found = cut(scanned(docs))
    limits = thresholds(found.select(F.explode("tokens").alias("t")).select("t.*"), rate).collect()
    limit = F.create_map(*[F.lit(x) for r in limits for x in (f"{r.encoding}:{r.length}", r.threshold)]) if limits else F.lit(None).cast("map<string,double>")
    passed = F.filter("tokens", lambda t: t["p"] >= F.try_element_at(limit, F.concat_ws(":", t["encoding"], t["length"])))
    extra = F.transform(passed, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))
    return found.select("doc_id", F.sort_array(F.concat("base", extra)).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
