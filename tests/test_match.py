"""Matching against brute force over all pairs."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions import ratio
from heddle.operators import match as mt


def words(seed, n, alphabet="abcde_", low=1, high=9):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(low, high))) for _ in range(n)]


def side(spark, values, prefix):
    return spark.createDataFrame([("m", f"{prefix}{i}", v) for i, v in enumerate(values)], "model_id string, id string, value string")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("confidence", [0, 20, 45, 50, 67, 80, 95])
def test_levenshtein_pairs(spark, confidence):
    a, b = words(1, 60), words(2, 60)
    got = {(r["source"], r["target"]): r["score"] for r in mt.levenshtein_pairs(side(spark, a, "s"), side(spark, b, "t"), ["model_id"], confidence).collect()}
    want = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            score = int((1 - edit_distance(x, y) / max(len(x), len(y))) * 100 + 0.5)
            if score >= max(confidence, 1):
                want[(f"s{i}", f"t{j}")] = score
    assert got == want


def dice(x, y):
    x, y = x.lower(), y.lower()
    if x == y:
        return 1.0
    if min(len(x), len(y)) < 2:
        return 0.0
    left = [x[i:i + 2] for i in range(len(x) - 1)]
    shared = 0
    for i in range(len(y) - 1):
        if y[i:i + 2] in left:
            left.remove(y[i:i + 2])
            shared += 1
    return 2 * shared / (len(x) + len(y) - 2)


@pytest.mark.parametrize("confidence", [0, 45, 70])
def test_suggested_mappings_hold_every_pair_of_the_mean(spark, confidence):
    names, paths = (words(21, 30), words(22, 30)), (words(23, 30, "abAB", 0, 6), words(24, 30, "abAB", 0, 6))
    paths[0][3] = paths[1][4] = None
    exact = ["X y", "x_Y", "z"] * 10, ["xy", "q", ""] * 10
    columns = {"name": ("levenshtein", names), "path": ("dice", paths), "tag": ("fast", exact)}
    criteria = {c: (how, side(spark, l, "s"), side(spark, r, "t")) for c, (how, (l, r)) in columns.items()}
    got = {(r["source"], r["target"]): (r["confidence"], r["via"]) for r in mt.suggest_mappings(criteria, ["model_id"], confidence).collect()}
    same = lambda x: re.sub(r"[\s_.-]+", "", x.lower())
    score = {
        "name": lambda x, y: int((1 - edit_distance(x, y) / max(len(x), len(y))) * 100 + 0.5),
        "path": lambda x, y: int(dice(x, y) * 100 + 0.5),
        "tag": lambda x, y: 100 * (same(x) == same(y)),
    }
    want = {}
    for i in range(30):
        for j in range(30):
            both = {c: score[c](l[i], r[j]) for c, (_, (l, r)) in columns.items() if l[i] and r[j]}
            mean = int(sum(both.values()) / len(both) + 0.5)
            if mean >= max(confidence, 1):
                want[(f"s{i}", f"t{j}")] = (mean, sorted(c for c, n in both.items() if n))
    assert got == want and want


@pytest.mark.parametrize("confidence", [30, 60, 90])
def test_dice_pairs(spark, confidence):
    a, b = words(3, 60, "abAB"), words(4, 60, "abAB")
    got = {(r["source"], r["target"]): r["score"] for r in mt.dice_pairs(side(spark, a, "s"), side(spark, b, "t"), ["model_id"], confidence).collect()}
    want = {(f"s{i}", f"t{j}"): int(dice(x, y) * 100 + 0.5) for i, x in enumerate(a) for j, y in enumerate(b) if int(dice(x, y) * 100 + 0.5) >= confidence}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_to_one_equals_the_sequential_pass(spark, seed):
    rnd = random.Random(seed)
    pairs = {(f"s{rnd.randrange(15)}", f"t{rnd.randrange(15)}"): rnd.randint(50, 55) for _ in range(90)}
    df = spark.createDataFrame([("m", s, t, c, s, t) for (s, t), c in pairs.items()], "model_id string, source string, target string, confidence int, source_key string, target_key string")
    got = {(r["source"], r["target"]) for r in mt.one_to_one(df, ["model_id"]).collect()}
    taken, want = set(), set()
    for (s, t), _ in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
        if s not in taken and t not in taken:
            taken |= {s, t}
            want.add((s, t))
    assert got == want


def test_fuzzy_suggestions(spark):
    names = words(5, 80, "abcdefgh", 4, 10)
    kinds, layers = ["object", "attribute", "layer"], ["Gold", "Silver"]
    entities = [("m", f"e{i}", v, v, kinds[i % 3], layers[i % 2]) for i, v in enumerate(names)]
    entity = spark.createDataFrame(entities, "model_id string, entity_id string, name string, path string, kind string, layer_name string")
    asked = words(6, 40, "abcdefgh", 4, 10) + [v[:-1] + "z" for v in names[:10]] + names[10:30]
    filters = [(None, None), ("layer", None), (None, " gold "), ("object", "SILVER")]
    queries = [(f"q{i}", "m", v, *filters[i % 4]) for i, v in enumerate(asked)]
    query = spark.createDataFrame(queries, "query_id string, model_id string, name string, kind string, layer string")
    fits = lambda q, e: (q[3] is None or q[3] == e[4]) and (q[4] is None or q[4].strip().lower() == e[5].lower())
    hit = {(r["query_id"], r["entity_id"]) for r in mt.name_tiers(query, entity).collect()}
    want = set()
    for q in queries:
        passing = [e for e in entities if fits(q, e)]
        if not any((q[0], e[1]) in hit for e in passing):
            want |= {(q[0], e[1]) for e in passing if SequenceMatcher(None, q[2], e[2]).ratio() >= 0.72}
    found = mt.fuzzy_suggestions(query, entity).collect()
    assert {(r["query_id"], r["entity_id"]) for r in found} == want and want
    # Some query has a tier hit that its filters remove, and still gets a suggestion.
    assert {q for q, _ in hit} & {q for q, _ in want}
    assert all(r["position"] == 1 for r in mt.fuzzy_suggestions(query, entity, limit=1).collect())


def definition_score(a, b):
    import re
    camel = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    tokens = lambda s: [t for t in re.split("[^0-9a-z]+", camel.sub(" ", s.strip()).lower()) if t]
    x, y = "".join(tokens(a)), "".join(tokens(b))
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    ta, tb = sorted(tokens(a)), sorted(tokens(b))
    best = max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, " ".join(ta), " ".join(tb)).ratio())
    return round(min(max(best, 0.97) if ta == tb else best, 0.97), 3)


@pytest.mark.parametrize("seed,most", [(1, 3), (2, 3), (1, None)])
def test_match_definitions(spark, seed, most):
    rnd = random.Random(seed)
    stems = ["order", "date", "customer", "Id", "line", "total", "Amount", "net"]
    name = lambda: rnd.choice(["_", " ", ""]).join(rnd.sample(stems, rnd.randint(1, 3)))
    rows, cols = [name() for _ in range(25)], [name() for _ in range(20)]
    sheet = spark.createDataFrame([("g", i, n) for i, n in enumerate(rows)], "table_guid string, row_no int, name string")
    column = spark.createDataFrame([("g", i, f"c{i}", n) for i, n in enumerate(cols)], "table_guid string, ordinal int, column_guid string, name string")
    got = {r["row_no"]: (r["column_guid"], r["confidence"], r["status"], r["selected"], r["alternatives"]) for r in mt.match_definitions(sheet, column, most).collect()}
    ranked = [sorted(((definition_score(r, c), -j) for j, c in enumerate(cols)), reverse=True) for r in rows]
    taken, want = set(), {}
    for i in sorted(range(len(rows)), key=lambda i: -ranked[i][0][0]):
        free = [(s, -j) for s, j in ranked[i] if -j not in taken]
        want[i] = (None, 0.0, "unmatched", False, "")
        if free and free[0][0] >= 0.62:
            score, j = free[0]
            after = free[1][0] if len(free) > 1 else 0.0
            unsure = score < 1.0 and score - after < 0.06
            others = [] if score >= 1.0 else [cols[k] for s, k in free[1:][:most] if s >= 0.62]
            want[i] = (f"c{j}", score, "ambiguous" if unsure else "exact" if score >= 1.0 else "fuzzy", score >= 0.88 and not unsure, "|".join(others))
            taken.add(j)
    assert got == want


def test_empty_filter_matches_nothing(spark):
    entity = spark.createDataFrame([("m", "a", "object", "A", None)], "model_id string, entity_id string, kind string, name string, parent_id string")
    prop = spark.createDataFrame([("m", "a", "Note", "")], "model_id string, entity_id string, key string, value string")
    assert mt.filter_view(entity, prop).count() == 0
    assert mt.filter_view(entity, prop, properties=(("Note", " "),)).filter(F.col("matched")).count() == 1


def test_search_members_are_the_counted_entities(spark):
    rows = [("m", "a", "object", "Name"), ("m", "b", "object", "Name"), ("m", "c", "attribute", "Name"), ("m", "d", "object", "m_name"), ("o", "e", "object", "Name"), ("m", "f", "object", None)]
    entity = spark.createDataFrame(rows, "model_id string, entity_id string, kind string, name string")
    query = spark.createDataFrame([("q", "m", " NAME "), ("none", "m", "x")], "query_id string, model_id string, name string")
    groups, members = mt.search_hits(query, entity)
    assert sorted(tuple(r) for r in groups.collect()) == [("q", 1, "attribute", "Name", 0, 1), ("q", 2, "object", "Name", 0, 2), ("q", 3, "object", "m_name", 2, 1)]
    assert sorted(tuple(r) for r in members.collect()) == [("q", 1, "c"), ("q", 2, "a"), ("q", 2, "b"), ("q", 3, "d")]
    assert sorted(tuple(r) for r in mt.search_hits(query, entity, 1)[1].collect()) == [("q", 1, "c")]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_overlap_candidates_are_complete(spark, threshold):
    rng = random.Random(9)
    sets = lambda n, seed: [sorted({rng.choice("abcdefghijkl") + rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 34]))}) for _ in range(n)]
    a, b = sets(50, 1), sets(50, 2)
    b[:20] = [sorted({*x[1:], "new"}) for x in a[:20]]
    frame = lambda rows: spark.createDataFrame([("m", f"i{i}", x) for i, x in enumerate(rows)], "model_id string, id string, tokens array<string>")
    got = {(r.left_id, r.right_id): r.overlap for r in mt.overlap_pairs(frame(a), frame(b), ["model_id"], threshold).collect()}
    shared = {(f"i{i}", f"i{j}"): (len({*x} & {*y}), len(x) + len(y)) for i, x in enumerate(a) for j, y in enumerate(b)}
    assert got == {k: n for k, (n, total) in shared.items() if 2 * n >= threshold * total - 1e-9} and got


def test_overlap_candidates_are_few(spark):
    rng = random.Random(2)
    code = lambda: "".join(rng.choices("0123456789abcdef", k=15))
    a = [code() for _ in range(1500)]
    b = [x[:3] + x[4:] if i % 2 else code() for i, x in enumerate(a)]
    frame = lambda rows: spark.createDataFrame([("m", x) for x in {*rows}], "model_id string, id string").withColumn("tokens", mt.bigrams(F.col("id"))).cache()
    left, right = frame(a), frame(b)
    found = mt.overlap_pairs(left, right, ["model_id"], 0.6).count()
    assert found >= 740 and mt.overlap_candidates(left, right, ["model_id"], 0.6).count() <= 5 * found


def joins_of(df, key):
    """The joins of the plan on a key column of that name."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if re.search(rf"Join \[.*\b{key}#", line)]


def test_exploded_sides_are_moved_by_key_and_not_sent_through_the_driver(spark):
    a, b = side(spark, words(41, 20), "s"), side(spark, words(42, 20), "t")
    found = joins_of(mt.levenshtein_pairs(a, b, ["model_id"], 75), "_s")
    assert found and all("SortMergeJoin" in x for x in found)
    tokens = lambda df: df.select("model_id", "id", F.array_distinct(F.split("value", "")).alias("tokens"))
    found = joins_of(mt.overlap_candidates(tokens(a), tokens(b), ["model_id"], 0.7), "_key")
    assert found and all("SortMergeJoin" in x for x in found)
    needle, hay = a.select("model_id", F.col("value").alias("_q")), b.select("model_id", F.col("value").alias("_e"))
    found = joins_of(mt.containing(needle, hay, ["model_id"]), "_g")
    assert any("SortMergeJoin" in x and "LeftSemi" in x for x in found) and any("SortMergeJoin" in x and "Inner" in x for x in found)


def test_the_lengths_of_one_scope_make_no_keys_in_another(spark):
    a = spark.createDataFrame([("m", "s1", "abcdefgh"), ("n", "s2", "abcdefghij")], "model_id string, id string, value string")
    b = spark.createDataFrame([("m", "t1", "abcdefgx"), ("n", "t2", "abcdefghi"), ("o", "t3", "abcdefgh")], "model_id string, id string, value string")
    assert {(r["source"], r["target"], r["score"]) for r in mt.levenshtein_pairs(a, b, ["model_id"], 80).collect()} == {("s1", "t1", 88), ("s2", "t2", 90)}


def test_statements_with_repeated_text_are_moved_by_key(spark):
    from heddle.functions import plantext
    from heddle.operators import runs

    execution = spark.createDataFrame([("v", 1, "d", "OK", "s", 1)], "livy_id string, execution_id int, description string, status string, submitted string, duration_ms int")
    access = spark.createDataFrame([("v", 1, "read", "W/L/x"), ("v", 2, "read", "W/L/x")], "livy_id string, execution_id int, access string, ref string")
    rows, used = runs.statements(execution, access)
    joined = rows.join(access, ["livy_id", "execution_id"])
    assert any("SortMergeJoin" in x and "Inner" in x for x in joins_of(joined, "livy_id")) and joined.count() == 1
    assert any("SortMergeJoin" in x for x in joins_of(used, "livy_id")) and used.count() == 1
    plan = "(1) Scan parquet\nLocation: X [abfss://onelake@a/W/L/Tables/x]\n"
    block = plantext.blocks(spark.createDataFrame([("e", plan)], "execution_id string, plan string"))
    context = spark.createDataFrame([("e", "W", "L")], "execution_id string, workspace string, lakehouse string")
    refs = plantext.node_refs(block, context)
    assert any("SortMergeJoin" in x for x in joins_of(refs, "execution_id")) and refs.count() >= 1


def test_block_ratios_equal_the_library(spark):
    rnd = random.Random(51)
    for letters, low, high in (("ab ", 1, 9), ("0123456789abcdef", 1, 40), ("abc", 60, 140), ("ab", 195, 205)):
        a, b = words(rnd.random(), 20, letters, low, high), words(rnd.random(), 20, letters, low, high)
        i, j = (x.ravel() for x in np.indices((20, 20)))
        want = [SequenceMatcher(None, x, y).ratio() for x in a for y in b]
        assert ratio.ratios(a, b, i, j).tolist() == want
        bound = ratio.common_bound(a, b)
        assert all(2 * bound[k // 20, k % 20] / (len(a[k // 20]) + len(b[k % 20])) >= w - 1e-12 for k, w in enumerate(want))


def test_few_codes_are_scored_by_blocks(spark):
    a, b = words(52, 200, "0123456789abcdef", 32, 32), words(53, 200, "0123456789abcdef", 32, 32)
    shared = lambda x, y: sum(min(x.count(c), y.count(c)) for c in set(x))
    passed = ratio.common_bound(a, b) >= 18
    assert sum(shared(x, y) >= 18 for x in a for y in b) > 20000 and passed.sum() < 400
    # Pairs of blocks meet; no keys of names are exploded and joined.
    sheet = spark.createDataFrame([("g", i, n) for i, n in enumerate(a)], "table_guid string, row_no int, name string")
    column = spark.createDataFrame([("g", i, f"c{i}", n) for i, n in enumerate(b)], "table_guid string, ordinal int, column_guid string, name string")
    found = mt.definition_similarity(sheet, column, 0.62)
    assert "CoGroups" in found._jdf.queryExecution().executedPlan().toString() and not joins_of(found, "_key")


def test_rows_and_columns_that_come_twice_are_chosen_twice(spark):
    sheet = spark.createDataFrame([("g", 1, "order date")] * 2 + [("g", 2, "order dates"), ("g", None, "x"), (None, 3, "order date")], "table_guid string, row_no int, name string")
    column = spark.createDataFrame([("g", 1, "c1", "orderDate")] * 2 + [("g", 2, "c2", "order dat"), ("g", None, "c3", "order date")], "table_guid string, ordinal int, column_guid string, name string")
    assert mt.definition_similarity(sheet, column, 0.62).count() == 9
    assert mt.match_definitions(sheet, column, None).filter("row_no = 1 and column_guid = 'c1'").count() == 2 * 4 * 2


def test_chance_pairs_do_not_grow_with_the_square_of_the_sets(spark):
    """Short codes within long ones: two tokens a key would let most of these pairs meet."""
    rng = random.Random(54)
    code = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    a, b = {code(15) for _ in range(3000)}, [code(32) for _ in range(3000)]
    b[:20] = [code(8) + x + code(9) for x in sorted(a)[:20]]
    frame = lambda rows: spark.createDataFrame([("m", x) for x in rows], "model_id string, id string").withColumn("tokens", mt.bigrams(F.col("id"))).cache()
    found = {(r.left_id, r.right_id) for r in mt.overlap_candidates(frame(a), frame(b), ["model_id"], 0.6).collect()}
    assert {*zip(sorted(a)[:20], b[:20])} <= found and len(found) <= 100
