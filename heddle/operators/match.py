"""Name search and matching. Candidate pairs come from indexes (equal keys, shared grams,
shared segments), never from all pairs; each index provably holds every pair that can qualify."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import combinations
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from heddle.functions import ratio
from heddle.operators.graph import M, descendants
from heddle.session import cut, moved, placed
from heddle.sources.landed import CAMEL, folded

TIERS = ("exact", "normalized", "partial")
FUZZY_CUTOFF = 0.72


def squash(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def singular(name: str) -> Column:
    """One trailing s dropped from a word long enough to lose it."""
    c = F.col(name)
    plural = (F.length(c) > 3) & F.endswith(c, F.lit("s")) & ~F.endswith(c, F.lit("ss"))
    return F.when(plural, F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def grams(text: Column, n: int) -> Column:
    """Distinct substrings of length n; empty for a shorter text."""
    spots = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(
        F.length(text) >= n, F.array_distinct(F.transform(spots, lambda i: F.substring(text, i, F.lit(n))))
    ).otherwise(F.expr("cast(array() as array<string>)"))


# --- name search ------------------------------------------------------------

def containing(needle: DataFrame, hay: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, _q, _e): the distinct texts `_e` of `hay` that hold a text `_q` of `needle`.
    Each `_q` reads the posting list of its rarest gram; a gram that no text has proves that none holds it."""
    asked = cut(needle.select(*scope, "_q").filter("_q <> ''").distinct().withColumn("_w", F.least(F.length("_q"), F.lit(3))))
    widths = sorted(r["_w"] for r in asked.select("_w").distinct().collect()) or [3]  # of 1, 2 and 3
    own = F.when(F.col("_w") == 3, grams(F.col("_q"), 3)).when(F.col("_w") == 2, grams(F.col("_q"), 2)).otherwise(grams(F.col("_q"), 1))
    wanted = asked.select(*scope, "_q", F.explode(own).alias("_g"))
    texts = hay.select(*scope, "_e").distinct()
    posting = texts.select(*scope, "_e", F.explode(F.concat(*[grams(F.col("_e"), n) for n in widths])).alias("_g"))
    counts = (
        posting.join(moved(wanted.select(*scope, "_g").distinct()), [*scope, "_g"], "left_semi")
        .groupBy(*scope, "_g")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    rarest = (
        wanted.join(counts, [*scope, "_g"], "left")
        .groupBy(*scope, "_q")
        .agg(F.min_by("_g", F.struct(F.coalesce("_c", F.lit(0)), "_g")).alias("_g"))
    )
    return moved(rarest).join(posting, [*scope, "_g"]).filter(F.contains("_e", F.col("_q"))).select(*scope, "_q", "_e")


def name_tiers(query: DataFrame, entity: DataFrame) -> DataFrame:
    """(query_id, model, entity_id, tier) before filters. `query` is (query_id, model, name).

    exact: same text; normalized: same letters and digits, one plural s tolerated; partial:
    the query inside the name, or a name inside the query that is 70% of its length.
    """
    q = query.select("query_id", M, F.lower(F.trim("name")).alias("_raw"), squash(F.trim("name")).alias("_q")).filter("_q <> ''")
    q = cut(q.withColumn("_qs", singular("_q")))
    e = cut(
        entity.select(M, "entity_id", F.lower(F.trim("name")).alias("_name"), squash("name").alias("_e")).withColumn("_es", singular("_e"))
    )

    def tier(n: int) -> Column:
        return F.lit(n).alias("tier")

    same = q.select("query_id", M, F.col("_raw").alias("_name")).join(e, [M, "_name"]).select("query_id", M, "entity_id", tier(0))
    keys = q.select("query_id", M, F.explode(F.array_distinct(F.array("_q", "_qs"))).alias("_e"))
    alike = keys.join(e.filter("_e <> ''"), [M, "_e"]).select("query_id", M, "entity_id", tier(1))
    alike2 = q.select("query_id", M, F.col("_q").alias("_es")).join(e, [M, "_es"]).select("query_id", M, "entity_id", tier(1))
    # The query inside the name.
    inside = q.join(containing(q, e, [M]), [M, "_q"]).join(e, [M, "_e"]).select("query_id", M, "entity_id", tier(2))
    # The name inside the query: every long enough part of the query is an exact key.
    least = F.ceil(F.length("_q") * 7 / 10).cast("int")
    parts = F.flatten(
        F.transform(
            F.sequence(least, F.length("_q")),
            lambda n: F.transform(F.sequence(F.lit(1), F.length("_q") - n + 1), lambda i: F.substring("_q", i, n)),
        )
    )
    held = (
        moved(q.select("query_id", M, F.explode(F.array_distinct(parts)).alias("_e"))).join(e, [M, "_e"]).select("query_id", M, "entity_id", tier(2))
    )
    every = reduce(DataFrame.union, [same, alike, alike2, inside, held])
    return every.groupBy("query_id", M, "entity_id").agg(F.min("tier").alias("tier"))


def _judged(hits: DataFrame, query: DataFrame, entity: DataFrame) -> DataFrame:
    """Hits (query_id, model, entity_id) with the entity's path and whether the query's kind and layer let it pass."""
    asked = query.select("query_id", F.col("kind").alias("_kind"), F.coalesce(squash("layer"), F.lit("")).alias("_layer"))
    fits = (F.col("_kind").isNull() | F.col("_kind").eqNullSafe(F.col("kind"))) & (
        (F.col("_layer") == "") | F.col("_layer").eqNullSafe(squash("layer_name"))
    )
    place = entity.select(M, "entity_id", "kind", "layer_name", "path")
    return hits.join(place, [M, "entity_id"]).join(asked, "query_id").withColumn("_fits", fits)


def resolve_names(query: DataFrame, entity: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, answers) for queries (query_id, model, name, kind, layer), null filters meaning any.

    Matches are ranked by tier and path, all of them unless a `limit` is asked for; answers carry the true
    count, the best tier and how many exact or normalized names only the filters removed.
    """
    judged = cut(_judged(name_tiers(query, entity), query, entity))
    kept = judged.filter("_fits")
    name = lambda c: F.when(c == 0, TIERS[0]).when(c == 1, TIERS[1]).when(c == 2, TIERS[2])
    matches = placed(kept, ["query_id"], ["tier", "path", "entity_id"], "position", limit).select(
        "query_id", "position", "entity_id", name(F.col("tier")).alias("tier"), "path"
    )
    found = judged.groupBy("query_id").agg(
        F.count_if("_fits").alias("matched"),
        F.min(F.when(F.col("_fits"), F.col("tier"))).alias("_best"),
        F.count_if(~F.col("_fits") & (F.col("tier") < 2)).alias("filtered_out"),
    )
    answers = query.select("query_id").join(found, "query_id", "left").select(
        "query_id",
        F.coalesce("matched", F.lit(0)).alias("matched"),
        F.coalesce(name(F.col("_best")), F.lit("none")).alias("how"),
        F.coalesce("filtered_out", F.lit(0)).alias("filtered_out"),
    )
    return matches, answers


def resolve_layers(query: DataFrame, entity: DataFrame) -> DataFrame:
    """(query_id, layer_name): a layer argument in the model's own spelling, the first that fits."""
    layers = entity.filter("kind = 'layer'").select(M, squash("name").alias("_k"), "name", "ordinal")
    first = layers.filter("_k <> ''").groupBy(M, "_k").agg(F.min_by("name", "ordinal").alias("layer_name"))
    return query.select("query_id", M, squash("layer").alias("_k")).join(first, [M, "_k"], "left").select("query_id", "layer_name")


def search_hits(query: DataFrame, entity: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """In-model search: (query_id, position, kind, name, rank, entities) groups, exact before prefix before substring; and the
    members of each group, (query_id, position, entity_id)."""
    q = query.select("query_id", M, F.lower(F.trim("name")).alias("_q")).filter("_q <> ''")
    names = cut(entity.groupBy(M, "kind", "name").agg(F.count(F.lit(1)).alias("entities")).withColumn("_e", F.lower("name")))
    hit = q.join(containing(q, names, [M]), [M, "_q"]).join(names, [M, "_e"])
    rank = F.when(F.col("_e") == F.col("_q"), 0).when(F.startswith("_e", F.col("_q")), 1).otherwise(2)
    ranked = cut(placed(hit.withColumn("rank", rank), ["query_id"], ["rank", "_e", "name", "kind"], "position", limit))
    members = ranked.select("query_id", M, "position", "kind", "name").join(entity.select(M, "kind", "name", "entity_id"), [M, "kind", "name"])
    return ranked.select("query_id", "position", "kind", "name", "rank", "entities"), members.select("query_id", "position", "entity_id")


def search_catalog(query: DataFrame, entry: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, totals) of catalogue entries by name: exact before substring, an optional kind.
    Totals count every match, whatever the `limit`."""
    q = query.select("query_id", F.lower(F.trim("name")).alias("_q"), F.col("kind").alias("_kind")).filter("_q <> ''")
    e = entry.withColumn("_e", F.lower(F.trim("name")))
    hit = q.join(containing(q, e, []), "_q").join(e, "_e").filter(
        F.col("_kind").isNull() | (F.col("kind") == F.col("_kind"))
    ).withColumn("exact", F.col("_e") == F.col("_q"))
    hit = cut(hit.select("query_id", "exact", *entry.columns))
    matches = placed(hit, ["query_id"], [F.col("exact").desc(), "name", "kind", "workspace_id", "id"], "position", limit)
    totals = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    return matches, totals


# --- overlap joins ------------------------------------------------------------

def numbered(tokens: Column) -> Column:
    """A multiset as a set: every token with the number of its occurrence."""
    return F.transform(
        tokens, lambda t, i: F.concat(t, F.lit("\u0001"), F.size(F.filter(F.slice(tokens, 1, i + 1), lambda x: x == t)).cast("string"))
    )


#: Most tokens that a key of the overlap join holds, and most keys of a set for one length of the other side (if its keys hold several tokens).
MOST_TOKENS, MOST_KEYS = 5, 50_000
#: Keys made at once, and the work of a pair that meets by chance in that of a key.
KEYS_AT_ONCE, CHANCE = 1 << 19, 0.3
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row (_key, ...) for each choice of `_k` of the hashed tokens `_p` of a row, whose `_key` is where its keys start."""
    for pdf in batches:
        for (width, k), part in pdf.groupby([pdf["_p"].map(len), "_k"]):
            choice = np.array([*combinations(range(width), k)], dtype=np.intp)
            start, tokens = part["_key"].to_numpy().astype(np.uint64), np.stack(part["_p"].to_list()).astype(np.uint64)
            rest = part.drop(columns=["_p", "_k", "_key"])
            step = max(1, KEYS_AT_ONCE // len(choice))
            for at in range(0, len(part), step):
                key = np.repeat(start[at : at + step, None], len(choice), axis=1)
                for c in range(k):
                    key = (key ^ tokens[at : at + step][:, choice[:, c]]) * _PRIME
                    key ^= key >> np.uint64(29)
                own = {c: np.repeat(rest[c].to_numpy()[at : at + step], len(choice)) for c in rest.columns}
                yield pd.DataFrame({"_key": key.ravel().astype(np.int64), **own})


def _met(left: DataFrame, right: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """(_x, _y) of pairs that may reach the threshold of `overlap_pairs`, each once; both are hashes of (scope, id), so scopes are to be compared.

    Sets of n and m tokens reach it with o = ceil(threshold * (n + m) / 2) common tokens. Ordered from rare to frequent, they then share k
    tokens among the first n - o + k of the one and m - o + k of the other, so every choice of k tokens of such a prefix is a
    key, for each pair of lengths that occurs. The more tokens a key has, the more keys there are, and the fewer pairs meet by chance: k is
    what makes least of both for so many sets, so chance pairs do not grow with the square of the sets.
    Of a pair that meets, 64 bits of each side's tokens bound what it shares: a bit that one side lacks is a token that it lacks.
    """
    spark = left.sparkSession
    both = left.select(F.explode("tokens").alias("_t")).union(right.select(F.explode("tokens").alias("_t")))
    weight = cut(both.groupBy("_t").agg(F.count(F.lit(1)).alias("_f")))
    known = float(max(weight.count(), MOST_TOKENS))

    def ordered(df: DataFrame) -> DataFrame:
        rows = df.select(*scope, "id", F.size("tokens").alias("_n"), F.explode("tokens").alias("_t")).join(weight, "_t")
        sets = rows.groupBy(*scope, "id", "_n").agg(F.sort_array(F.collect_list(F.struct("_f", "_t")))["_t"].alias("_o"))
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))
        hashed = sets.select(*scope, "_n", F.xxhash64(*scope, "id").alias("_id"), F.transform("_o", lambda t: F.xxhash64(t)).alias("_o"))
        return cut(hashed.withColumn("_bits", F.aggregate("_o", F.lit(0).cast("bigint"), lambda s, h: s.bitwiseOR(bit(h)))))

    a, b = ordered(left), ordered(right)
    need = F.greatest(F.lit(1), F.ceil(threshold * (F.col("_n") + F.col("_m")) / 2 - 1e-9)).cast("int")

    def choices(n: Column, k: int) -> Column:
        return reduce(lambda x, i: x * (n + F.lit(float(k - i))) / F.lit(float(i + 1)), range(k), F.lit(1.0))

    def work(k: int) -> Column:
        x, y = choices(F.col("_n") - need, k), choices(F.col("_m") - need, k)
        by_chance = F.col("_a") * F.col("_b") * x * y / prod((known - i) / (i + 1) for i in range(k))
        fits = (need >= k) & ((F.greatest(x, y) <= MOST_KEYS) if k > 1 else F.lit(True))
        return F.struct(F.when(fits, F.col("_a") * x + F.col("_b") * y + CHANCE * by_chance).otherwise(F.lit(float("inf"))).alias("work"), F.lit(k).alias("k"))

    lengths = a.groupBy(*scope, "_n").agg(F.count(F.lit(1)).cast("double").alias("_a")).join(
        b.groupBy(*scope, F.col("_n").alias("_m")).agg(F.count(F.lit(1)).cast("double").alias("_b")), scope
    )
    lengths = lengths.filter(need <= F.least("_n", "_m")).withColumn("_k", F.array_min(F.array(*[work(k) for k in range(1, MOST_TOKENS + 1)]))["k"])
    lengths = cut(lengths.select(*scope, "_n", "_m", "_k", need.alias("_need")))

    def keyed_by_lengths(df: DataFrame, own: str, name: str, *also: Column) -> DataFrame:
        rows = df.withColumnRenamed("_n", own).join(lengths, [*scope, own])
        prefix = F.slice("_o", F.lit(1), F.least(F.col(own) - F.col("_need") + F.col("_k"), F.col(own))).alias("_p")
        rows = rows.select(F.xxhash64(*scope, "_n", "_m").alias("_key"), F.col("_id").alias(name), F.col("_bits").alias(f"{name}_bits"), *also, "_k", prefix)
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), name)
        return rows.mapInPandas(_keys, StructType([f for f in rows.schema.fields if f.name not in ("_k", "_p")]))

    mine = keyed_by_lengths(a, "_n", "_x", (F.col("_n") - F.col("_need")).alias("_x_spare"), (F.col("_m") - F.col("_need")).alias("_y_spare"))
    theirs = keyed_by_lengths(b, "_m", "_y")
    lacks = lambda one, other: F.bit_count(F.col(one).bitwiseAND(F.bitwise_not(F.col(other))))
    found = moved(mine).join(theirs, "_key").filter((lacks("_x_bits", "_y_bits") <= F.col("_x_spare")) & (lacks("_y_bits", "_x_bits") <= F.col("_y_spare")))
    return found.select("_x", "_y").distinct()


def overlap_candidates(left: DataFrame, right: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """(scope, left_id, right_id) of pairs that may reach the threshold of `overlap_pairs`, each once."""
    a = left.select(*scope, F.col("id").alias("left_id"), F.xxhash64(*scope, "id").alias("_x")).distinct()
    b = right.select(*scope, F.col("id").alias("right_id"), F.xxhash64(*scope, "id").alias("_y")).distinct()
    return _met(left, right, scope, threshold).join(a, "_x").join(b, [*scope, "_y"]).select(*scope, "left_id", "right_id")


def overlap_pairs(left: DataFrame, right: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """(scope, left_id, right_id, overlap) of all pairs whose tokens can reach 2*overlap/(a+b) >= threshold.
    `left` and `right` are (scope, id, tokens), tokens distinct."""
    met = cut(_met(left, right, scope, threshold))
    a = left.select(*scope, F.col("id").alias("left_id"), F.col("tokens").alias("_a"), F.xxhash64(*scope, "id").alias("_x"))
    b = right.select(*scope, F.col("id").alias("right_id"), F.col("tokens").alias("_b"), F.xxhash64(*scope, "id").alias("_y"))
    sized = met.join(a, "_x").join(b, [*scope, "_y"])
    overlap = F.size(F.array_intersect("_a", "_b"))
    return (
        sized.withColumn("overlap", overlap)
        .filter(2 * F.col("overlap") >= threshold * (F.size("_a") + F.size("_b")) - 1e-9)
        .select(*scope, "left_id", "right_id", "overlap")
    )


def _characters(text: Column) -> Column:
    return numbered(F.filter(F.split(text, ""), lambda c: c != ""))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, as the standard library computes it."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def fuzzy_suggestions(query: DataFrame, entity: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, position, entity_id, path): near names that pass the query's kind and layer, for queries none of whose
    tier hits passes them. Suggestions, never matches.
    The block ratio cannot exceed the character overlap, so the overlap join holds every pair."""
    answered = _judged(name_tiers(query, entity), query, entity).filter("_fits").select("query_id").distinct()
    missed = query.join(answered, "query_id", "left_anti")
    needle = cut(missed.select("query_id", M, squash(F.trim("name")).alias("_q")).filter("_q <> ''"))
    names = cut(entity.select(M, "entity_id", squash("name").alias("_e")).filter("_e <> ''"))
    left = needle.select(M, F.col("_q").alias("id")).distinct().withColumn("tokens", _characters(F.col("id")))
    right = names.select(M, F.col("_e").alias("id")).distinct().withColumn("tokens", _characters(F.col("id")))
    near = overlap_pairs(left, right, [M], FUZZY_CUTOFF).filter(sequence_ratio("left_id", "right_id") >= FUZZY_CUTOFF)
    hit = needle.join(near.withColumnRenamed("left_id", "_q").withColumnRenamed("right_id", "_e"), [M, "_q"]).join(names, [M, "_e"])
    fitting = _judged(hit.select("query_id", M, "entity_id"), query, entity).filter("_fits").select("query_id", "entity_id", "path")
    return placed(fitting, ["query_id"], ["path", "entity_id"], "position", limit).select("query_id", "position", "entity_id", "path")


# --- filters ------------------------------------------------------------------

def filter_view(
    entity: DataFrame,
    prop: DataFrame,
    name: str = "",
    kinds: tuple[str, ...] = (),
    access: tuple[str, ...] = (),
    tags: tuple[str, ...] = (),
    properties: tuple[tuple[str, str], ...] = (),
) -> DataFrame:
    """(model, entity_id, matched): entities that pass every facet, and the containers that hold them.
    A property with a blank value means having it at all; a filter without facets matches nothing."""
    wanted = [(k.strip(), v.strip().lower()) for k, v in properties if k.strip()]
    rows = entity.select(M, "entity_id", "kind", "name")
    if not (name.strip() or kinds or access or tags or wanted):
        return rows.limit(0).select(M, "entity_id", F.lit(True).alias("matched"))
    if name.strip():
        rows = rows.filter(F.contains(F.lower("name"), F.lit(name.strip().lower())))
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    if access:
        allowed = prop.filter((F.col("key") == "Access") & F.col("value").isin("Read", "Write") & F.col("value").isin(*access))
        rows = rows.join(allowed.select(M, "entity_id"), [M, "entity_id"], "left_semi")
    if tags:
        own = F.transform(F.split(F.lower("value"), ","), lambda s: F.trim(s))
        tagged = prop.filter((F.col("key") == "Tags") & F.arrays_overlap(own, F.array(*[F.lit(x.lower()) for x in tags])))
        rows = rows.join(tagged.select(M, "entity_id"), [M, "entity_id"], "left_semi")
    for key, value in wanted:
        having = prop.filter(F.col("key") == key)
        if value:
            having = having.filter(F.contains(F.lower("value"), F.lit(value)))
        rows = rows.join(having.select(M, "entity_id"), [M, "entity_id"], "left_semi")
    hit = cut(rows.select(M, "entity_id"))
    held = ancestors_of(hit, entity).join(hit, [M, "entity_id"], "left_anti")
    return hit.withColumn("matched", F.lit(True)).union(held.select(M, "entity_id", F.lit(False)))


def ancestors_of(ids: DataFrame, entity: DataFrame) -> DataFrame:
    """(model, entity_id): the containers of a set of entities, each once; one join per nesting level."""
    parent = cut(entity.filter("parent_id is not null").select(M, "entity_id", "parent_id"))
    level, seen = ids.select(M, "entity_id").distinct(), []
    while True:
        up = level.join(parent, [M, "entity_id"]).select(M, F.col("parent_id").alias("entity_id")).distinct()
        for earlier in seen:
            up = up.join(earlier, [M, "entity_id"], "left_anti")
        level = cut(up)
        if level.isEmpty():
            break
        seen.append(level)
    return reduce(DataFrame.union, seen) if seen else ids.select(M, "entity_id").limit(0)


def filter_transitions(transition: DataFrame, matched: DataFrame, hide: bool) -> DataFrame:
    """When hiding, an edge is shown only if both its ends are; otherwise all edges are."""
    if not hide:
        return transition
    ids = matched.select(M, "entity_id").distinct()
    return transition.join(ids.withColumnRenamed("entity_id", "source"), [M, "source"], "left_semi").join(
        ids.withColumnRenamed("entity_id", "target"), [M, "target"], "left_semi"
    )


SORTS = {"viewed": "last_viewed_at", "modified": "updated_at", "created": "created_at"}


def filter_models(models: DataFrame, search: str = "", tags: tuple[str, ...] = (), starred: bool = False, sort: str = "viewed") -> DataFrame:
    """The model list: starred AND any of the tags AND the text in name, description or a tag; newest first, then name."""
    rows = models
    if starred:
        rows = rows.filter("starred")
    lower = F.transform("tags", lambda s: F.lower(s))
    if tags:
        rows = rows.filter(F.arrays_overlap(lower, F.array(*[F.lit(x.lower()) for x in tags])))
    text = F.lit(search.strip().lower())
    if search.strip():
        rows = rows.filter(
            F.contains(F.lower("name"), text) | F.contains(F.lower("description"), text) | F.exists(lower, lambda s: F.contains(s, text))
        )
    by_name = [F.lower("name"), F.col("name"), F.col("model_id")]
    return rows.orderBy(*([F.col(SORTS[sort]).desc()] if sort in SORTS else []), *by_name)


# --- mapping suggestions --------------------------------------------------------

def map_scopes(
    entity: DataFrame, transition: DataFrame, source_root: DataFrame | None, target_root: DataFrame | None, groups: bool = False
) -> DataFrame:
    """(model, side, entity_id) of mappable attributes. A root (model, entity_id) stands for its subtree. Auto is
    everything a transition touches, with its subtree; an Auto source beside a named target is what exchanges
    edges with the target or with something inside it."""

    def subtree(ids: DataFrame) -> DataFrame:
        seeds = ids.select(M, F.lit("").alias("start"), F.col("entity_id").alias("node")).distinct()
        return descendants(seeds, entity).select(M, F.col("node").alias("entity_id")).distinct()

    ends = transition.select(M, F.col("source").alias("entity_id")).union(transition.select(M, "target"))
    connected = subtree(ends) if source_root is None and target_root is None else None
    if connected is not None:
        connected = cut(connected)
    target = cut(subtree(target_root)) if target_root is not None else (connected if connected is not None else cut(subtree(ends)))
    if source_root is not None:
        source = subtree(source_root)
    elif target_root is not None:
        outside = lambda c: target.withColumnRenamed("entity_id", c)
        feeding = transition.join(outside("target"), [M, "target"], "left_semi").select(M, F.col("source").alias("entity_id"))
        fed = transition.join(outside("source"), [M, "source"], "left_semi").select(M, F.col("target").alias("entity_id"))
        source = subtree(feeding.union(fed).join(target, [M, "entity_id"], "left_anti"))
    else:
        source = connected
    usable = entity.filter("kind = 'attribute'" + ("" if groups else " and not has_children")).select(M, "entity_id")
    side = lambda df, s: df.join(usable, [M, "entity_id"], "left_semi").select(M, F.lit(s).alias("side"), "entity_id")
    return side(source, "source").union(side(target, "target"))


def eligible_pairs(pair: DataFrame, entity: DataFrame, transition: DataFrame, directed: bool) -> DataFrame:
    """Candidate (model, source, target, ...) rows that may be mapped: two layers, not connected yet, and
    left to right in layer order unless a side was named."""
    layer = entity.filter("kind = 'layer'").select(M, F.col("entity_id").alias("layer_id"), F.col("ordinal").alias("_o"))
    place = entity.select(M, "entity_id", "layer_id").join(layer, [M, "layer_id"])
    s = place.select(M, F.col("entity_id").alias("source"), F.col("layer_id").alias("_ls"), F.col("_o").alias("_os"))
    t = place.select(M, F.col("entity_id").alias("target"), F.col("layer_id").alias("_lt"), F.col("_o").alias("_ot"))
    rows = pair.filter("source <> target").join(s, [M, "source"]).join(t, [M, "target"]).filter("_ls <> _lt")
    if not directed:
        rows = rows.filter("_os < _ot")
    return rows.drop("_ls", "_os", "_lt", "_ot").join(transition.select(M, "source", "target").distinct(), [M, "source", "target"], "left_anti")


def plain(text: Column | str) -> Column:
    """A name as the fast comparison sees it."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s_\-.]+", "")


def fast_pairs(left: DataFrame, right: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, source, target, score 100) of values equal apart from case, blanks and ``_ - .``.
    `left` and `right` are (scope, id, value)."""
    a = left.filter("coalesce(value, '') <> ''").select(*scope, F.col("id").alias("source"), plain("value").alias("_k"))
    b = right.filter("coalesce(value, '') <> ''").select(*scope, F.col("id").alias("target"), plain("value").alias("_k"))
    return a.join(b, [*scope, "_k"]).select(*scope, "source", "target", F.lit(100).cast("bigint").alias("score"))


def levenshtein_pairs(left: DataFrame, right: DataFrame, scope: list[str], confidence: int) -> DataFrame:
    """(scope, source, target, score) of values with an edit similarity of at least `confidence`; never of zero.

    With at most k edits, one of k+1 even segments of the right value is found unchanged in the left one, at
    most k places off. Segments are joined by value for every pair of lengths that can qualify. Below 50 a
    segment can be empty; there the characters in common, which no alignment exceeds, select the candidates.
    """
    confidence = max(confidence, 1)
    loss = 1 - (confidence - 0.5) / 100
    a = left.filter("coalesce(value, '') <> ''").select(*scope, F.col("value").alias("_a")).distinct().withColumn("_la", F.length("_a"))
    b = right.filter("coalesce(value, '') <> ''").select(*scope, F.col("value").alias("_b")).distinct().withColumn("_lb", F.length("_b"))

    met = _alike_characters(a, b, scope, 1 - loss) if confidence < 50 else _shared_segments(a, b, scope, loss)
    longest = F.greatest(F.length("_a"), F.length("_b"))
    # Scored where they meet: of the pairs, only those that qualify are moved to be told apart.
    scored = met.withColumn("score", F.floor((1 - F.levenshtein("_a", "_b") / longest) * 100 + 0.5)).filter(F.col("score") >= confidence).distinct()
    s = left.select(*scope, F.col("id").alias("source"), F.col("value").alias("_a"))
    t = right.select(*scope, F.col("id").alias("target"), F.col("value").alias("_b"))
    return scored.join(s, [*scope, "_a"]).join(t, [*scope, "_b"]).select(*scope, "source", "target", "score")


def _alike_characters(a: DataFrame, b: DataFrame, scope: list[str], share: float) -> DataFrame:
    """Candidates (scope, _a, _b): values with that share of their characters in common."""
    side = lambda df, c: cut(df.select(*scope, F.col(c).alias("id")).withColumn("tokens", _characters(F.col("id"))))
    return overlap_pairs(side(a, "_a"), side(b, "_b"), scope, share).select(
        *scope, F.col("left_id").alias("_a"), F.col("right_id").alias("_b")
    )


def _shared_segments(a: DataFrame, b: DataFrame, scope: list[str], loss: float) -> DataFrame:
    """Candidates (scope, _a, _b): values that share an even segment at nearly the same place, once for each segment they share."""

    def lengths(own: str, other: str, df: DataFrame, met: DataFrame) -> DataFrame:
        low = F.greatest(F.lit(1), F.ceil(F.col(own) * (1 - loss) - 1e-9)).cast("int")
        high = F.floor(F.col(own) / (1 - loss) + 1e-9).cast("int")
        there = cut(met.select(*scope, other).distinct())
        rows = df.join(there, scope).filter(F.col(other).between(low, high))
        return rows.withColumn("_k", F.floor(F.greatest(own, other) * loss + 1e-9).cast("int"))

    # Segment i of a value of length n cut into k+1 starts at floor(i*n/(k+1)) + 1.
    start = lambda i: F.floor(i * F.col("_lb") / (F.col("_k") + 1)).cast("int") + 1
    segment = F.sequence(F.lit(0), F.col("_k"))
    cutup = lengths("_lb", "_la", b, a).select(
        *scope, "_b", "_la", "_lb", "_k", F.explode(segment).alias("_i")
    ).select("*", F.substring("_b", start(F.col("_i")), start(F.col("_i") + 1) - start(F.col("_i"))).alias("_s"))
    probe = lengths("_la", "_lb", a, b).select(*scope, "_a", "_la", "_lb", "_k", F.explode(segment).alias("_i"))
    first = start(F.col("_i"))
    width = start(F.col("_i") + 1) - first
    spots = F.sequence(F.greatest(F.lit(1), first - F.col("_k")), F.greatest(F.lit(1), F.least(F.col("_la") - width + 1, first + F.col("_k"))))
    found = F.array_distinct(F.transform(spots, lambda p: F.substring(F.col("_a"), p, width)))
    probe = probe.select(*scope, "_a", "_la", "_lb", "_i", F.explode(found).alias("_s"))
    return moved(probe).join(cutup.drop("_k"), [*scope, "_la", "_lb", "_i", "_s"]).select(*scope, "_a", "_b")


def bigrams(text: Column) -> Column:
    """Letter pairs of a text of two letters or more, numbered."""
    spots = F.sequence(F.lit(1), F.length(text) - 1)
    return numbered(F.transform(spots, lambda i: F.substring(text, i, F.lit(2))))


def dice_pairs(left: DataFrame, right: DataFrame, scope: list[str], confidence: int) -> DataFrame:
    """(scope, source, target, score) of values whose letter pairs overlap enough, ignoring case."""

    def side(df: DataFrame) -> DataFrame:
        rows = df.select(*scope, F.lower("value").alias("id")).filter("length(id) >= 2").distinct()
        return rows.withColumn("tokens", bigrams(F.col("id")))

    a, b = cut(side(left)), cut(side(right))
    # Rounded half up: a score reaches `confidence` from half a point below.
    near = overlap_pairs(a, b, scope, (confidence - 0.5) / 100)
    total = F.length("left_id") + F.length("right_id") - 2
    scored = near.withColumn("score", F.floor(F.col("overlap") * 200 / total + 0.5)).filter(F.col("score") >= confidence)
    # A single letter has no pairs but equals itself.
    single = lambda df: df.select(*scope, F.lower("value").alias("_v")).filter("length(_v) = 1").distinct()
    ones = single(left).join(single(right), [*scope, "_v"]).select(*scope, F.col("_v").alias("left_id"), F.col("_v").alias("right_id"), F.lit(100).cast("bigint").alias("score"))
    pairs = scored.select(*scope, "left_id", "right_id", "score").union(ones)
    s = left.select(*scope, F.col("id").alias("source"), F.lower("value").alias("left_id"))
    t = right.select(*scope, F.col("id").alias("target"), F.lower("value").alias("right_id"))
    return pairs.join(s, [*scope, "left_id"]).join(t, [*scope, "right_id"]).select(*scope, "source", "target", "score")


# Date spellings that are understood.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "d MMM yyyy", "MMM d, yyyy", "MM/dd/yyyy", "yyyy/MM/dd")


def instant(value: Column | str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMATS])


def date_pairs(left: DataFrame, right: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, source, target, score 100) of values that are the same instant, however written."""
    a = left.select(*scope, F.col("id").alias("source"), instant("value").alias("_t")).filter("_t is not null")
    b = right.select(*scope, F.col("id").alias("target"), instant("value").alias("_t")).filter("_t is not null")
    return a.join(b, [*scope, "_t"]).select(*scope, "source", "target", F.lit(100).cast("bigint").alias("score"))


#: Pairs that reach a score, by algorithm.
MATCHERS = {
    "fast": lambda left, right, scope, confidence: fast_pairs(left, right, scope),
    "levenshtein": levenshtein_pairs,
    "dice": dice_pairs,
    "date": lambda left, right, scope, confidence: date_pairs(left, right, scope),
}


def _ready(algorithm: str, value: Column) -> Column:
    """What the algorithm compares, made once per value and not once per pair."""
    if algorithm == "fast":
        return plain(value)
    if algorithm == "date":
        return instant(value)
    if algorithm == "dice":
        low = F.lower(value)
        return F.struct(low.alias("text"), F.when(F.length(low) >= 2, bigrams(low)).otherwise(F.array().cast("array<string>")).alias("pairs"))
    return value


def _score(algorithm: str, a: Column, b: Column) -> Column:
    """0 to 100 for two values made by `_ready`."""
    if algorithm in ("fast", "date"):
        return F.when(a == b, 100).otherwise(0).cast("bigint")
    if algorithm == "dice":
        shared, total = F.size(F.array_intersect(a["pairs"], b["pairs"])), F.size(a["pairs"]) + F.size(b["pairs"])
        return F.when(a["text"] == b["text"], 100).otherwise(F.floor(F.coalesce(F.try_divide(shared * 200, total), F.lit(0.0)) + 0.5)).cast("bigint")
    return F.floor((1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))) * 100 + 0.5)


def suggest_mappings(criteria: dict[str, tuple[str, DataFrame, DataFrame]], scope: list[str], confidence: int) -> DataFrame:
    """(scope, source, target, confidence, via) of all pairs whose mean score reaches `confidence` (1 at least).

    `criteria` names (algorithm, left, right), sides (scope, id, value). A mean reaches the confidence only if one
    criterion does, so the pairs that do in some criterion are all the candidates; these get all their scores.
    """
    confidence = max(confidence, 1)
    known = {
        name: (algorithm, *[df.filter("coalesce(value, '') <> ''").select(*scope, "id", "value") for df in sides])
        for name, (algorithm, *sides) in criteria.items()
    }
    met = [MATCHERS[algorithm](a, b, scope, confidence).select(*scope, "source", "target") for algorithm, a, b in known.values()]
    candidates = cut(reduce(DataFrame.union, met).distinct())
    scored, value = [], []
    for name, (algorithm, a, b) in known.items():
        s = a.select(*scope, F.col("id").alias("source"), _ready(algorithm, F.col("value")).alias("_a"))
        t = b.select(*scope, F.col("id").alias("target"), _ready(algorithm, F.col("value")).alias("_b"))
        scored.append(
            candidates.join(s, [*scope, "source"])
            .join(t, [*scope, "target"])
            .select(*scope, F.lit(name).alias("criterion"), "source", "target", _score(algorithm, F.col("_a"), F.col("_b")).alias("score"))
            .filter("score > 0")
        )
        value += [df.select(*scope, "id", F.lit(name).alias("criterion")) for df in (a, b)]
    return score_pairs(reduce(DataFrame.unionByName, scored), reduce(DataFrame.union, value), scope, confidence)


def score_pairs(scored: DataFrame, value: DataFrame, scope: list[str], confidence: int) -> DataFrame:
    """(scope, source, target, confidence, via): the mean over the criteria for which both ends have a value.

    `scored` is (scope, criterion, source, target, score) for pairs that score above zero, complete for every
    criterion; `value` (scope, id, criterion) says who has a value. A pair scoring zero in a criterion is a
    mismatch there and drags the mean; one criterion above zero is needed.
    """
    has = value.groupBy(*scope, "id").agg(F.collect_set("criterion").alias("_c"))
    pair = scored.groupBy(*scope, "source", "target").agg(
        F.sum("score").alias("_sum"), F.sort_array(F.collect_set(F.when(F.col("score") > 0, F.col("criterion")))).alias("via")
    )
    both = pair.join(has.withColumnRenamed("id", "source").withColumnRenamed("_c", "_a"), [*scope, "source"]).join(
        has.withColumnRenamed("id", "target").withColumnRenamed("_c", "_b"), [*scope, "target"]
    )
    n = F.size(F.array_intersect("_a", "_b"))
    return (
        both.withColumn("confidence", F.floor(F.col("_sum") / n + 0.5))
        .filter((F.size("via") > 0) & (F.col("confidence") >= confidence) & (F.col("confidence") > 0))
        .select(*scope, "source", "target", "confidence", "via")
    )


def one_to_one(suggestion: DataFrame, scope: list[str]) -> DataFrame:
    """Greedy one-to-one over the suggestions in a strict order: confidence first, then `source_key`, then `target_key`.

    Per round, every pair that is the best one left for both its ends is taken; these are exactly pairs the
    sequential pass would take, and the overall best is always among them.
    """
    order = F.struct((-F.col("confidence")).alias("c"), "source_key", "target_key", "source", "target")
    left = cut(suggestion.withColumn("_o", order))
    taken: list[DataFrame] = []
    while not left.isEmpty():
        # One row for each end decides; the pairs themselves are not moved, and pairs that come twice are taken twice.
        by_source = left.groupBy(*scope, "source").agg(F.min("_o").alias("_o"))
        by_target = left.groupBy(*scope, "target").agg(F.min("_o").alias("_o"))
        chosen = cut(by_source.withColumn("target", F.col("_o.target")).join(by_target, [*scope, "target", "_o"]))
        best = cut(left.join(chosen, [*scope, "source", "target", "_o"], "left_semi"))
        taken.append(best.drop("_o"))
        left = cut(
            left.join(best.select(*scope, "source"), [*scope, "source"], "left_anti").join(
                best.select(*scope, "target"), [*scope, "target"], "left_anti"
            )
        )
    return reduce(DataFrame.unionByName, taken) if taken else suggestion.limit(0)


def group_suggestions(suggestion: DataFrame, entity: DataFrame) -> DataFrame:
    """(model, source_owner, target_owner, labels, suggestions): suggestions per pair of objects, largest first."""
    owner = F.when(F.col("kind") == "attribute", F.col("object_id")).otherwise(F.col("entity_id"))
    label = F.concat_ws(" · ", "layer_name", F.coalesce("object_name", "name"))
    e = entity.select(M, "entity_id", owner.alias("_owner"), label.alias("_label"))
    s = e.select(M, F.col("entity_id").alias("source"), F.col("_owner").alias("source_owner"), F.col("_label").alias("source_label"))
    t = e.select(M, F.col("entity_id").alias("target"), F.col("_owner").alias("target_owner"), F.col("_label").alias("target_label"))
    keys = [M, "source_owner", "target_owner", "source_label", "target_label"]
    return suggestion.join(s, [M, "source"]).join(t, [M, "target"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("suggestions"))


def apply_suggestions(suggestion: DataFrame, transition: DataFrame, algorithm: str) -> tuple[DataFrame, DataFrame]:
    """(transitions, properties) that accepted suggestions add; pairs already connected are skipped."""
    fresh = suggestion.join(transition.select(M, "source", "target").distinct(), [M, "source", "target"], "left_anti")
    one = fresh.groupBy(M, "source", "target").agg(F.max_by(F.struct("confidence", "via"), "confidence").alias("_v"))
    made = one.withColumn("transition_id", F.concat(F.lit("map-"), F.sha2(F.concat_ws("\u0001", "source", "target"), 256)))
    bag = F.array(
        F.struct(F.lit("Confidence").alias("key"), F.col("_v.confidence").cast("string").alias("value")),
        F.struct(F.lit("Mapped by").alias("key"), F.array_join("_v.via", ", ").alias("value")),
        F.struct(F.lit("Algorithm").alias("key"), F.lit(algorithm).alias("value")),
    )
    return made.select(M, "transition_id", "source", "target"), made.select(
        M, F.col("transition_id").alias("entity_id"), F.inline(bag)
    )


# --- definition sheets ----------------------------------------------------------

CONFIDENT, PLAUSIBLE, MARGIN = 0.88, 0.62, 0.06


def _sorted_tokens(name: Column) -> Column:
    spaced = F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), CAMEL, " "))
    return F.array_join(F.array_sort(F.filter(F.split(spaced, "[^0-9a-z]+"), lambda x: x != "")), " ")


#: Names of a side that a task compares at once.
BLOCK = 1024


def _block_scores(floor: float):
    """Scores of one block of sheet names (_f, _t) with one block of columns (_g, _u): the pairs scoring at least `floor`, with both sides' keys."""
    # Rounding to three decimals can lift a ratio by half a thousandth.
    least = floor - 0.0005

    def near(a: list[str], b: list[str]) -> np.ndarray:
        both = np.array([len(t) for t in a])[:, None] + np.array([len(t) for t in b])[None, :]
        return ratio.common_bound(a, b) >= np.maximum(1, np.ceil(least * both / 2 - 1e-9))

    def scores(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        mine, a = left[["_f", "_t"]].drop_duplicates(ignore_index=True), left.groupby(["_f", "_t"], sort=False).ngroup().to_numpy()
        theirs, b = right[["_g", "_u"]].drop_duplicates(ignore_index=True), right.groupby(["_g", "_u"], sort=False).ngroup().to_numpy()
        (x, tx), (y, ty) = (mine[c].to_numpy() for c in ("_f", "_t")), (theirs[c].to_numpy() for c in ("_g", "_u"))
        plain = bool((x == tx).all() and (y == ty).all())
        i, j = np.nonzero(near(x, y) if plain else near(x, y) | near(tx, ty))
        best = ratio.ratios(x, y, i, j)
        if not plain:
            best = np.maximum(best, ratio.ratios(tx, ty, i, j))
        best = np.minimum(np.where(tx[i] == ty[j], 0.97, best), 0.97)
        values, which = np.unique(best, return_inverse=True)
        score = np.where(x[i] == y[j], 1.0, np.array([round(float(v), 3) for v in values])[which] if len(values) else best)
        kept = score >= floor
        # Back to the rows that have these names.
        pair = pd.DataFrame({"_a": i[kept], "_b": j[kept], "score": score[kept]})
        out = left.assign(_a=a)[["table_guid", "row_no", "_a"]].merge(pair, on="_a").merge(right.assign(_b=b)[["ordinal", "_b"]], on="_b")
        return out[["table_guid", "row_no", "ordinal", "score"]]

    return scores


def definition_similarity(sheet: DataFrame, column: DataFrame, floor: float) -> DataFrame:
    """(table_guid, row_no, ordinal, score) of sheet names and columns scoring at least `floor`. `sheet` is
    (table_guid, row_no, name), `column` (table_guid, ordinal, column_guid, name).

    At such a floor most names of a sheet share enough characters with most columns, so every pair of a sheet is looked at, blocks of names
    against blocks of columns, each pair of blocks in one task; what passes the common subsequence is scored there.
    """

    def form(df: DataFrame, key: str, f: str, t: str) -> DataFrame:
        rows = df.select("table_guid", key, folded(F.col("name")).alias(f), _sorted_tokens(F.col("name")).alias(t))
        return cut(rows.filter(F.col(f) != "").dropna(subset=["table_guid", key]))

    def blocks(df: DataFrame, own: str, other: str) -> DataFrame:
        many = lambda side: F.ceil(F.col(side) / BLOCK).cast("int")
        mine = F.pmod(F.xxhash64(*df.columns), many(own)).cast("int")
        return df.join(sizes, "table_guid").select(*df.columns, mine.alias(own), F.explode(F.sequence(F.lit(0), many(other) - 1)).alias(other))

    rows, cols = form(sheet, "row_no", "_f", "_t"), form(column, "ordinal", "_g", "_u")
    size = lambda df, name: df.groupBy("table_guid").agg(F.count(F.lit(1)).alias(name))
    sizes = cut(size(rows, "_i").join(size(cols, "_j"), "table_guid"))
    meeting = ["table_guid", "_i", "_j"]
    made = rows.select("table_guid", "row_no").schema.fields + cols.select("ordinal").schema.fields + [StructField("score", DoubleType())]
    return blocks(rows, "_i", "_j").groupBy(*meeting).cogroup(blocks(cols, "_j", "_i").groupBy(*meeting)).applyInPandas(_block_scores(floor), StructType(made))


def match_definitions(sheet: DataFrame, column: DataFrame, alternatives: int | None = None) -> DataFrame:
    """One proposal per sheet row, with all plausible alternatives in their order, or the first so many. Rows choose in the order of their best score, each the best column still
    free; a column goes once. Per round, a row takes its first free column if no row before it could want it."""
    scored = cut(definition_similarity(sheet, column, PLAUSIBLE - MARGIN - 0.001))
    key = ["table_guid"]
    turn = scored.groupBy(*key, "row_no").agg(F.struct((-F.max("score")).alias("b"), F.col("row_no")).alias("_turn"))
    pick = F.struct((-F.col("score")).alias("s"), "ordinal")
    ranked = cut(scored.join(turn, [*key, "row_no"]).withColumn("_pick", pick))
    left = ranked.filter(F.col("score") >= PLAUSIBLE)
    done: list[DataFrame] = []
    while not left.isEmpty():
        # One row for each row and each column decides; the pairs themselves are not moved.
        top = left.groupBy(*key, "row_no").agg(F.min(F.struct("_pick", "score", "_turn")).alias("_b"))
        first = left.groupBy(*key, "ordinal").agg(F.min("_turn").alias("_turn"))
        best = top.select(*key, "row_no", F.col("_b._pick.ordinal").alias("ordinal"), "_b.score", "_b._turn")
        won = cut(best.join(first, [*key, "ordinal", "_turn"]).select(*key, "row_no", "ordinal", "score", "_turn"))
        done.append(won)
        left = cut(
            left.join(won.select(*key, "row_no"), [*key, "row_no"], "left_anti").join(won.select(*key, "ordinal"), [*key, "ordinal"], "left_anti")
        )
    chosen = ranked.select(*key, "row_no", "ordinal", "score", "_turn")
    # Rows that come twice are chosen twice.
    chosen = cut(chosen.join(reduce(DataFrame.unionByName, done), [*key, "row_no", "ordinal", "score"], "left_semi")) if done else chosen.limit(0)
    # What was still free when a row's turn came: not taken by an earlier row.
    holder = chosen.select(*key, "ordinal", F.col("_turn").alias("_by"))
    free = ranked.join(chosen.select(*key, "row_no", F.col("ordinal").alias("_mine")), [*key, "row_no"]).join(
        holder, [*key, "ordinal"], "left"
    ).filter("_by is null or _by >= _turn").filter("ordinal <> _mine")
    names = column.select(*key, "ordinal", "column_guid", F.col("name").alias("column_name"))
    place = F.row_number().over(W.partitionBy(*key, "row_no").orderBy("_pick"))
    others = free.withColumn("_n", place).join(names, [*key, "ordinal"])
    others = others if alternatives is None else others.filter(F.col("_n") <= alternatives)
    listed = others.groupBy(*key, "row_no").agg(
        F.max("score").alias("_next"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("score") >= PLAUSIBLE, F.struct("_n", "column_name"))))["column_name"], "|").alias("_alt"),
    )
    out = (
        sheet.select(*key, "row_no", F.col("name").alias("source_name"))
        .join(chosen.drop("_turn"), [*key, "row_no"], "left")
        .join(names, [*key, "ordinal"], "left")
        .join(listed, [*key, "row_no"], "left")
    )
    score = F.col("score")
    ambiguous = (score < 1.0) & (score - F.coalesce("_next", F.lit(0.0)) < MARGIN)
    return out.select(
        *key,
        "row_no",
        "source_name",
        "column_guid",
        "column_name",
        F.coalesce("score", F.lit(0.0)).alias("confidence"),
        F.when(score.isNull(), "unmatched").when(ambiguous, "ambiguous").when(score >= 1.0, "exact").otherwise("fuzzy").alias("status"),
        F.coalesce((score >= CONFIDENT) & ~ambiguous, F.lit(False)).alias("selected"),
        F.when(score < 1.0, F.coalesce("_alt", F.lit(""))).otherwise("").alias("alternatives"),
    )
