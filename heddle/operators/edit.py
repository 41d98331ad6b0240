"""Bulk edits as change sets over the tables of many models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.operators.graph import M, descendants
from heddle.session import Passing, cut, keyed

TAGS = "Tags"


def with_descendants(ids: DataFrame, entity: DataFrame) -> DataFrame:
    """(model, entity_id): the ids that exist and everything inside them."""
    known = ids.select(M, "entity_id").join(entity.select(M, "entity_id"), [M, "entity_id"], "left_semi").distinct()
    seeds = known.select(M, F.lit("").alias("start"), F.col("entity_id").alias("node"))
    return descendants(seeds, entity).select(M, F.col("node").alias("entity_id")).distinct()


def _untouched(transition: DataFrame, doomed: DataFrame) -> DataFrame:
    return transition.join(doomed.withColumnRenamed("entity_id", "source"), [M, "source"], "left_anti").join(
        doomed.withColumnRenamed("entity_id", "target"), [M, "target"], "left_anti"
    )


def delete_cascade(ids: DataFrame, entity: DataFrame, transition: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, transitions) that are left; property bags outlive their entity."""
    with Passing(entity.sparkSession) as here:
        doomed = here.kept(with_descendants(ids, entity))
    return entity.join(doomed, [M, "entity_id"], "left_anti"), _untouched(transition, doomed)


def delete_bridging(ids: DataFrame, entity: DataFrame, transition: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As `delete_cascade`, and what fed a removed entity feeds what it fed: one hop, both ends surviving,
    no self loop, no duplicate. A chain of two removed entities is not bridged."""
    with Passing(entity.sparkSession) as here:
        doomed = here.kept(with_descendants(ids, entity))
    left = _untouched(transition, doomed)
    into = transition.join(doomed.withColumnRenamed("entity_id", "target"), [M, "target"], "left_semi").select(
        M, F.col("target").alias("_mid"), "source"
    )
    out = transition.join(doomed.withColumnRenamed("entity_id", "source"), [M, "source"], "left_semi").select(
        M, F.col("source").alias("_mid"), "target"
    )
    into = into.join(doomed.withColumnRenamed("entity_id", "source"), [M, "source"], "left_anti").distinct()
    out = out.join(doomed.withColumnRenamed("entity_id", "target"), [M, "target"], "left_anti").distinct()
    made = into.join(out, [M, "_mid"]).filter("source <> target").select(M, "source", "target").distinct()
    fresh = made.join(transition.select(M, "source", "target"), [M, "source", "target"], "left_anti")
    bridged = fresh.withColumn("transition_id", _id("t-", M, "source", "target")).withColumn("ordinal", F.lit(None).cast("bigint"))
    return entity.join(doomed, [M, "entity_id"], "left_anti"), left.unionByName(bridged.select(*left.columns))


def _id(prefix: str, *columns: str) -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\u0001", *columns), 256))


def add_transitions(edge: DataFrame, entity: DataFrame, transition: DataFrame) -> DataFrame:
    """(model, source, target) accepted: both ends exist, not a self loop, not there yet; the reverse edge is another one."""
    ids = entity.select(M, "entity_id")
    return (
        edge.filter("source <> target")
        .select(M, "source", "target")
        .join(ids.withColumnRenamed("entity_id", "source"), [M, "source"], "left_semi")
        .join(ids.withColumnRenamed("entity_id", "target"), [M, "target"], "left_semi")
        .distinct()  # of edges that lie by their target already
        .join(transition.select(M, "source", "target"), [M, "source", "target"], "left_anti")
    )


def remove_transitions(ids: DataFrame, transition: DataFrame) -> DataFrame:
    return transition.join(ids.select(M, "transition_id").distinct(), [M, "transition_id"], "left_anti")


def rename(change: DataFrame, entity: DataFrame) -> DataFrame:
    """`change` is (model, entity_id, seq, new_name); the last change of an entity counts."""
    last = change.groupBy(M, "entity_id").agg(F.max_by("new_name", "seq").alias("_new"))
    return entity.join(last, [M, "entity_id"], "left").withColumn("name", F.coalesce("_new", "name")).drop("_new").select(*entity.columns)


def clone(ids: DataFrame, entity: DataFrame, transition: DataFrame, prop: DataFrame, salt: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, transitions, properties) to add for copies of the selected subtrees beside their originals.

    A selected entity inside a selected one is not copied twice. Properties come along. Only copied layers carry
    edges: inner ones between the copies, boundary ones re-attached to the end outside that still exists.
    """
    chosen = ids.select(M, "entity_id").distinct().join(entity.select(M, "entity_id", "kind"), [M, "entity_id"])
    seeds = chosen.select(M, F.col("entity_id").alias("start"), F.col("entity_id").alias("node"))
    with Passing(entity.sparkSession) as here:
        inside = descendants(seeds, entity).select(M, F.col("start"), F.col("node").alias("entity_id"), "hops")
        nested = inside.filter("hops > 0").select(M, F.col("entity_id").alias("start")).distinct()
        roots = inside.join(nested, [M, "start"], "left_anti")
        tops = chosen.select(M, F.col("entity_id").alias("start"), (F.col("kind") == "layer").alias("whole"))
        fresh = here.kept(roots.join(tops, [M, "start"]).select(M, "entity_id", "whole").distinct())
    # The id of a copy follows from its original's, so only the originals' are moved and looked up.
    copy = lambda c: F.concat(F.lit("copy-"), F.sha2(F.concat_ws("\u0001", F.lit(salt), M, c), 256))
    held = ("parent_id", "layer_id", "object_id")
    made = entity.join(fresh.select(M, "entity_id"), [M, "entity_id"])
    for c in held:
        made = made.join(fresh.select(M, F.col("entity_id").alias(c), F.lit(True).alias(f"_{c}")), [M, c], "left")
    names = {"entity_id": copy("entity_id"), **{c: F.when(F.col(f"_{c}"), copy(c)).otherwise(F.col(c)) for c in held}}
    made = made.select(*[names[c].alias(c) if c in names else c for c in entity.columns])
    bags = prop.join(fresh.select(M, "entity_id"), [M, "entity_id"]).withColumn("entity_id", copy("entity_id")).select(*prop.columns)
    end = lambda c: fresh.select(M, F.col("entity_id").alias(c), F.col("whole").alias(f"_w{c}"))
    alive = lambda c: entity.select(M, F.col("entity_id").alias(c), F.lit(True).alias(f"_a{c}"))
    edges = transition.select(M, "source", "target")
    for c in ("source", "target"):
        edges = edges.join(end(c), [M, c], "left").join(alive(c), [M, c], "left")
    copied = edges.filter("coalesce(_wsource, false) or coalesce(_wtarget, false)").filter(
        "coalesce(_wsource, _asource) and coalesce(_wtarget, _atarget)"
    )
    # Few edges are left by now. They are written as what they copy, which is short, and come once; so do their copies' names,
    # unless some end has the name of a copy already.
    copied = cut(copied.select(M, "source", "target", *[F.col(f"_w{c}").isNotNull().alias(f"_c{c}") for c in ("source", "target")]).distinct())
    named = lambda c: F.when(F.col(f"_c{c}"), copy(c)).otherwise(F.col(c)).alias(c)
    added = copied.select(M, named("source"), named("target")).filter("source <> target")
    if not copied.filter("source like 'copy-%' or target like 'copy-%'").isEmpty():
        added = added.distinct()
    return made, added, bags


# --- properties -----------------------------------------------------------------

def set_properties(change: DataFrame, prop: DataFrame) -> DataFrame:
    """`change` is (model, entity_id, seq, key, value): the last change of a key counts, a blank value removes it,
    the reserved key is refused."""
    clean = change.withColumn("key", F.trim("key")).filter(f"key <> '' and lower(key) <> lower('{TAGS}')")
    last = clean.groupBy(M, "entity_id", "key").agg(F.max_by(F.coalesce("value", F.lit("")), "seq").alias("_new"))
    both = prop.join(last, [M, "entity_id", "key"], "full").withColumn("value", F.coalesce("_new", "value"))
    return both.filter("_new is null or value <> ''").select(*prop.columns)


def rename_property(change: DataFrame, prop: DataFrame) -> DataFrame:
    """`change` is (model, entity_id, old_key, new_key), one per entity and key: the moved value beats one already
    under the new key. Blank and reserved keys are refused."""
    clean = change.withColumn("new_key", F.trim("new_key")).filter(
        f"new_key <> '' and new_key <> old_key and lower(new_key) <> lower('{TAGS}') and lower(old_key) <> lower('{TAGS}')"
    ).select(M, "entity_id", F.col("old_key").alias("key"), F.col("new_key").alias("_new"))
    rows = prop.join(clean, [M, "entity_id", "key"], "left")
    moved = F.col("_new").isNotNull()
    named = rows.select(M, "entity_id", F.coalesce("_new", "key").alias("key"), moved.alias("_moved"), "value")
    return named.groupBy(M, "entity_id", "key").agg(F.max_by("value", "_moved").alias("value"))


def common_properties(selection: DataFrame, prop: DataFrame) -> DataFrame:
    """(selection_id, key, value, mixed, present) over selections (selection_id, model, entity_id): one value for
    all, else mixed with a blank value."""
    size = selection.groupBy("selection_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = selection.join(prop.filter(F.lower("key") != TAGS.lower()), [M, "entity_id"])
    keys = rows.groupBy("selection_id", "key").agg(
        F.count(F.lit(1)).alias("present"), F.min("value").alias("_a"), F.max("value").alias("_b")
    )
    mixed = (F.col("_a") != F.col("_b")) | (F.col("present") < F.col("_n"))
    return keys.join(size, "selection_id").select(
        "selection_id", "key", F.when(mixed, "").otherwise(F.col("_a")).alias("value"), mixed.alias("mixed"), "present"
    )


def key_counts(prop: DataFrame) -> DataFrame:
    """(model, key, entities, values): carriers and distinct non-blank values per key, the reserved key aside."""
    rows = prop.filter(F.lower("key") != TAGS.lower())
    return rows.groupBy(M, "key").agg(
        F.count(F.lit(1)).alias("entities"), F.countDistinct(F.nullif("value", F.lit(""))).alias("values")
    )


def key_values(prop: DataFrame) -> DataFrame:
    return prop.filter(f"lower(key) <> lower('{TAGS}') and value <> ''").select(M, "key", "value").distinct()


def compact_properties(prop: DataFrame, entity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, orphaned bags per model): bags of live layers, objects and attributes are kept; bags of
    transitions count as orphaned, as they do where a model leaves the system."""
    ids = entity.select(M, "entity_id")
    gone = prop.join(ids, [M, "entity_id"], "left_anti").select(M, "entity_id").distinct()
    return prop.join(ids, [M, "entity_id"], "left_semi"), gone.groupBy(M).agg(F.count(F.lit(1)).alias("orphans"))


# --- tags -----------------------------------------------------------------------

def tag_array(value: Column | str) -> Column:
    """A comma list as tags: trimmed, once per spelling-insensitive tag with the first spelling, sorted."""
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    return distinct_tags(parts)


def distinct_tags(parts: Column) -> Column:
    lower = F.transform(parts, lambda s: F.lower(s))
    first = F.filter(parts, lambda s, i: F.array_position(lower, F.lower(s)) == i + 1)
    return F.transform(F.array_sort(F.transform(first, lambda s: F.struct(F.lower(s).alias("k"), s.alias("s")))), lambda p: p["s"])


def tags(prop: DataFrame) -> DataFrame:
    """(model, entity_id, tag)"""
    return prop.filter(F.col("key") == TAGS).select(M, "entity_id", F.explode(tag_array("value")).alias("tag"))


def tag_counts(prop: DataFrame, entity: DataFrame) -> DataFrame:
    """(model, tag, entities) over live entities, by spelling-insensitive tag."""
    live = tags(prop).join(entity.select(M, "entity_id"), [M, "entity_id"], "left_semi")
    return live.groupBy(M, F.lower("tag").alias("_k")).agg(F.min("tag").alias("tag"), F.count(F.lit(1)).alias("entities")).drop("_k")


def model_tag_counts(models: DataFrame) -> DataFrame:
    """(tag, models) over a model list (model, tags array), largest first."""
    rows = models.select(M, F.explode("tags").alias("tag"))
    n = rows.groupBy(F.lower("tag").alias("_k")).agg(F.min("tag").alias("tag"), F.count(F.lit(1)).alias("models"))
    return n.drop("_k").orderBy(F.col("models").desc(), F.lower("tag"), "tag")


def edit_tags(change: DataFrame, prop: DataFrame, entity: DataFrame) -> DataFrame:
    """Apply tag edits to the property table. `change` is (model, action, entity_id, tag, new_tag): `add` goes to its
    entity; `rename` and `delete` go to every live carrier (entity_id null). One edit per tag and model. A rename onto
    a tag already carried merges; an entity left without tags loses the key."""
    live = entity.select(M, "entity_id")
    one = lambda c: F.get(tag_array(c), F.lit(0))
    carried = tags(prop.join(live, [M, "entity_id"], "left_semi"))
    swap = change.filter("action in ('rename', 'delete')").select(
        M, F.lower("tag").alias("_k"), "action", one("new_tag").alias("_new")
    ).filter("action = 'delete' or (_new is not null and lower(_new) <> _k)")
    edited = carried.withColumn("_k", F.lower("tag")).join(swap, [M, "_k"], "left").filter("action is null or action <> 'delete'")
    kept = edited.select(M, "entity_id", F.coalesce("_new", "tag").alias("tag"), F.lit(0).alias("_n"))
    added = change.filter("action = 'add'").select(M, "entity_id", one("tag").alias("tag"), F.lit(1).alias("_n")).filter("tag is not null")
    every = kept.union(added)
    once = every.groupBy(M, "entity_id", F.lower("tag").alias("_k")).agg(F.min(F.struct("_n", "tag"))["tag"].alias("tag"))
    bag = once.groupBy(M, "entity_id").agg(F.array_sort(F.collect_list(F.struct("_k", "tag")))["tag"].alias("_t"))
    made = bag.select(M, "entity_id", F.lit(TAGS).alias("key"), F.array_join("_t", ", ").alias("value"))
    touched = edited.filter("action is not null").select(M, "entity_id").union(
        carried.withColumn("_k", F.lower("tag")).join(swap, [M, "_k"], "left_semi").select(M, "entity_id")
    ).union(added.select(M, "entity_id")).distinct()
    others = prop.filter(F.col("key") != TAGS).unionByName(
        prop.filter(F.col("key") == TAGS).join(touched, [M, "entity_id"], "left_anti").select(*prop.columns)
    )
    return others.unionByName(made.join(touched, [M, "entity_id"], "left_semi").select(*prop.columns))


# --- proposed changes --------------------------------------------------------------

def validate_changes(edit: DataFrame, entity: DataFrame, transition: DataFrame, prop: DataFrame) -> DataFrame:
    """(batch_id, seq, status, reason) of proposed edits (model, batch_id, seq from 0, kind, describes, source_id,
    target_id, entity_id, key, value). The first reason that applies is given."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    kind = F.col("kind")
    edge, setting, tagging = kind == "add_transition", kind == "set_property", kind == "add_tag"
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    rows = edit.withColumns({
        "_silent": blank("describes"), "_open": empty("source_id") | empty("target_id"),
        "_key": F.when(setting, F.trim("key")).when(tagging, F.lit(TAGS)),
    }).drop("describes")
    absent = lambda **columns: [F.lit(None).cast(t).alias(c) for c, t in columns.items()]
    no_ends = absent(_source_id="boolean", _target_id="boolean", _edge="boolean")
    no_bag = absent(_current="string", _entity_id="boolean", _n_entity_id="string")

    def with_ends(df: DataFrame) -> DataFrame:
        for c in ("source_id", "target_id"):
            ids = entity.select(M, F.col("entity_id").alias(c), F.lit(True).alias(f"_{c}"))
            df = df.withColumn(c, keyed(F.col(c))).join(ids, [M, c], "left")
        there = transition.select(M, F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit(True).alias("_edge")).distinct()
        return df.join(there, [M, "source_id", "target_id"], "left")

    def with_bag(df: DataFrame) -> DataFrame:
        bag = prop.select(M, "entity_id", F.col("key").alias("_key"), F.col("value").alias("_current"))
        names = entity.select(M, "entity_id", F.lit(True).alias("_entity_id"), F.col("name").alias("_n_entity_id"))
        return df.withColumn("_key", keyed(F.col("_key"))).join(bag, [M, "entity_id", "_key"], "left").join(names, [M, "entity_id"], "left")

    has_tag = F.array_contains(F.transform(tag_array("_current"), lambda s: F.lower(s)), F.lower(F.trim("value")))
    reason = (
        F.when(F.col("_silent"), "no description")
        .when(edge & F.col("_open"), "needs both ends")
        .when(edge & F.col("_source_id").isNull(), "unknown source")
        .when(edge & F.col("_target_id").isNull(), "unknown target")
        .when(edge & (F.col("source_id") == F.col("target_id")), "self loop")
        .when(edge & F.col("_edge").isNotNull(), "exists")
        .when(~edge & F.col("_entity_id").isNull(), "unknown entity")
        .when(setting & blank("key"), "needs a key")
        .when(setting & (F.lower(F.trim("key")) == TAGS.lower()), "reserved key")
        .when(setting & blank("value"), "needs a value")
        .when(setting & (F.col("_current") == F.col("value")), "no change")
        .when(tagging & blank("value"), "needs a tag")
        .when(tagging & has_tag, "no change")
        .when((kind == "rename") & blank("value"), "needs a name")
        .when((kind == "rename") & (F.col("_n_entity_id") == F.col("value")), "no change")
    )

    def once(df: DataFrame) -> DataFrame:
        """Judged edges, of which a batch gets the first of each kind."""
        judged = df.select("batch_id", M, "seq", "source_id", "target_id", reason.alias("reason"), (edge & F.col("batch_id").isNotNull()).alias("_counts"))
        fine = F.col("_counts") & F.col("reason").isNull()
        first = F.min(F.when(fine, F.col("seq"))).over(W.partitionBy("batch_id", M, "source_id", "target_id"))
        twice = fine & (F.col("seq") > F.col("_first"))
        return judged.repartition("batch_id", M, "source_id", "target_id").withColumn("_first", first).withColumn("reason", F.when(twice, "already proposed").otherwise(F.col("reason")))

    # An id that is null names nothing: rows are moved by the ids that they have, and edges alone are compared with each other.
    ends, named = F.col("source_id").isNotNull() | F.col("target_id").isNotNull(), F.col("entity_id").isNotNull()
    verdict = lambda df: df.select("batch_id", "seq", "reason")
    out = verdict(once(with_ends(rows.filter(ends & ~named)).select("*", *no_bag)))
    out = out.union(verdict(with_bag(rows.filter(~ends & named)).select("*", *no_ends).withColumn("reason", reason)))
    out = out.union(verdict(rows.filter(~ends & ~named).select("*", *no_ends, *no_bag).withColumn("reason", reason)))
    if not edit.filter(ends & named).isEmpty():
        out = out.union(verdict(once(with_bag(with_ends(rows.filter(ends & named))))))
    final = F.col("reason")
    return out.select("batch_id", "seq", F.when(final.isNull(), "accepted").otherwise("rejected").alias("status"), final.alias("reason"))


def apply_changes(edit: DataFrame, entity: DataFrame, transition: DataFrame, prop: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, transitions, properties) after accepted edits, folded in the order of `seq`; unknown kinds are ignored."""
    filled = lambda *cs: " and ".join(f"coalesce({c}, '') <> ''" for c in cs)
    named = rename(edit.filter("kind = 'rename' and " + filled("entity_id", "value")).withColumn("new_name", F.col("value")), entity)
    asked = edit.filter("kind = 'add_transition' and " + filled("source_id", "target_id"))
    fresh = add_transitions(asked.select(M, F.col("source_id").alias("source"), F.col("target_id").alias("target")), entity, transition)
    edges = transition.select(M, "transition_id", "source", "target").unionByName(
        fresh.withColumn("transition_id", _id("t-", M, "source", "target")).select(M, "transition_id", "source", "target")
    )
    bags = set_properties(edit.filter("kind = 'set_property' and " + filled("entity_id", "key", "value")), prop)
    added = edit.filter("kind = 'add_tag' and " + filled("entity_id", "value")).select(
        M, F.lit("add").alias("action"), "entity_id", F.col("value").alias("tag"), F.lit(None).cast("string").alias("new_tag")
    )
    return named, edges, edit_tags(added, bags, entity)
