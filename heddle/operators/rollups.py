"""Version diffs, schema drift and catalogue roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.graph import M, reachable
from heddle.session import cut


def diff_versions(before: DataFrame, after: DataFrame, edges_before: DataFrame, edges_after: DataFrame) -> DataFrame:
    """(model, change, id, name, was): entities matched by id, transitions by their ends and not by id."""
    b = before.select(M, F.col("entity_id").alias("id"), F.col("name").alias("was"), F.lit(True).alias("_b"))
    a = after.select(M, F.col("entity_id").alias("id"), "name", F.lit(True).alias("_a"))
    both = b.join(a, [M, "id"], "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("name") != F.col("was"), "renamed")
    entities = both.withColumn("change", change).filter("change is not null").select(M, "change", "id", "name", "was")
    end = lambda df, f: df.select(M, F.concat_ws(">", "source", "target").alias("id"), F.lit(True).alias(f)).distinct()
    moved = end(edges_before, "_b").join(end(edges_after, "_a"), [M, "id"], "full").filter("_a is null or _b is null")
    nothing = F.lit(None).cast("string")
    edges = moved.select(
        M, F.when(F.col("_b").isNull(), "transition added").otherwise("transition removed").alias("change"), "id", nothing.alias("name"), nothing.alias("was")
    )
    return entities.unionByName(edges)


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy(M).agg(*[
        F.count_if(F.col("change") == c).alias(c.replace(" ", "_")) for c in ("added", "removed", "renamed", "transition added", "transition removed")
    ])


def schema_drift(tables: DataFrame, column: DataFrame, candidate: DataFrame, live: DataFrame, live_column: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status, columns) of model tables (model, entity_id) against the live tables of their names.

    `column` is (model, entity_id, column_name), leaves only; `candidate` (model, entity_id, live_id) what a name search
    found; `live` (live_id, readable); `live_column` (live_id, column_name). status: not found, ambiguous, not comparable
    or compared; an unreadable schema is never diffed. Columns match whatever their case.
    """
    hits = candidate.groupBy(M, "entity_id").agg(F.count(F.lit(1)).alias("_n"), F.min("live_id").alias("live_id"))
    placed = tables.select(M, "entity_id").join(hits, [M, "entity_id"], "left").join(live, "live_id", "left")
    status = (
        F.when(F.col("_n").isNull(), "not found")
        .when(F.col("_n") > 1, "ambiguous")
        .when(~F.coalesce("readable", F.lit(False)), "not comparable")
        .otherwise("compared")
    )
    judged = cut(placed.withColumn("status", status).select(M, "entity_id", "status", "live_id"))
    compared = judged.filter("status = 'compared'").select(M, "entity_id", "live_id")
    key = [M, "entity_id", "_k"]
    mine = column.join(compared, [M, "entity_id"]).select(M, "entity_id", F.lower("column_name").alias("_k"), F.col("column_name").alias("_m")).distinct()
    theirs = compared.join(live_column, "live_id").select(M, "entity_id", F.lower("column_name").alias("_k"), F.col("column_name").alias("_l")).distinct()
    both = mine.join(theirs, key, "full")
    verdict = F.when(F.col("_l").isNull(), "only_in_model").when(F.col("_m").isNull(), "only_in_live").otherwise("matching")
    columns = both.select(M, "entity_id", verdict.alias("verdict"), F.coalesce("_m", "_l").alias("column_name"))
    return judged.withColumn("live_id", F.when(F.col("status").isin("compared", "not comparable"), F.col("live_id"))), columns


# Item types by what they are.
STORES = ("lakehouse", "warehouse", "datamart", "kqldatabase", "eventhouse", "sqldatabase", "mirroreddatabase", "mirroredwarehouse")
BI_TYPES = ("report", "paginatedreport", "dashboard", "semanticmodel")
PIPELINE_TYPES = ("datapipeline", "dataflow")


def asset_buckets(entry: DataFrame) -> DataFrame:
    """Catalogue entries with `bucket` (data, notebook, pipeline, other; null for a workspace) and `slice` (table, store, bi)."""
    kind, item = F.col("kind"), F.lower(F.coalesce("item_type", F.lit("")))
    bucket = (
        F.when(kind == "workspace", None)
        .when(kind.isin("table", "lakehouse"), "data")
        .when(kind == "notebook", "notebook")
        .when(item.isin(*PIPELINE_TYPES), "pipeline")
        .when(item.isin(*STORES, *BI_TYPES), "data")
        .otherwise("other")
    )
    part = F.when(kind == "table", "table").when((kind == "lakehouse") | item.isin(*STORES), "store").otherwise("bi")
    return entry.withColumn("bucket", bucket).withColumn("slice", F.when(F.col("bucket") == "data", part))


COUNTS = ("data", "notebook", "pipeline", "other")
SLICES = ("table", "store", "bi")


def asset_counts(entry: DataFrame) -> DataFrame:
    """Counts per workspace, workspaces with nothing included, and a total row (workspace_id null); largest first."""
    rows = asset_buckets(entry)
    counts = [F.count_if(F.col("bucket") == c).alias(c) for c in COUNTS] + [F.count_if(F.col("slice") == s).alias(s) for s in SLICES]
    total = F.count("bucket").alias("total")
    per = rows.groupBy("workspace_id").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "workspace", F.col("workspace_name"))), F.max("workspace_name")).alias("workspace_name"), *counts, total
    )
    whole = rows.agg(F.lit(None).cast("string").alias("workspace_id"), F.lit(None).cast("string").alias("workspace_name"), *counts, total)
    return per.unionByName(whole).orderBy(F.col("total").desc(), F.lower("workspace_name"), "workspace_name")


# --- data products -------------------------------------------------------------------

def pending_assets(wanted: DataFrame, known: DataFrame, linked: DataFrame) -> DataFrame:
    """(product_id, guid, action, asset_id) per wanted (product_id, guid): onboard what the catalogue does not know, link what it
    knows and the product does not hold yet; nothing on a second run. `known` is (guid, asset_id), `linked` (product_id, asset_id)."""
    rows = wanted.filter("coalesce(guid, '') <> ''").select("product_id", "guid").distinct().join(known, "guid", "left")
    fresh = rows.filter("asset_id is null").select("product_id", "guid", F.lit("onboard").alias("action"), "asset_id")
    held = rows.filter("asset_id is not null").join(linked.select("product_id", "asset_id"), ["product_id", "asset_id"], "left_anti")
    return fresh.unionByName(held.select("product_id", "guid", F.lit("link").alias("action"), "asset_id"))


def domain_tree(domain: DataFrame, product: DataFrame) -> DataFrame:
    """(domain_id, name, depth, path, products): products of a domain include those of its sub-domains.
    `domain` is (id, name, parent_id); a domain whose parent is missing is a root."""
    rows = domain.select(F.lit("").alias(M), "id", "name", "parent_id")
    step = rows.filter("parent_id is not null").select(M, F.col("id").alias("node"), F.col("parent_id").alias("nxt"))
    step = step.join(rows.select(F.col("id").alias("nxt")), "nxt", "left_semi").select(M, "node", "nxt")
    seeds = rows.select(M, F.col("id").alias("start"), F.col("id").alias("node"))
    up = cut(reachable(seeds, step))
    named = up.join(rows.select(F.col("id").alias("node"), "name"), "node")
    path = F.array_join(F.sort_array(F.collect_list(F.struct((-F.col("hops")).alias("h"), "name")))["name"], " / ")
    place = named.groupBy(F.col("start").alias("domain_id")).agg(F.max("hops").alias("depth"), path.alias("path"))
    n = up.join(product.groupBy(F.col("domain_id").alias("start")).agg(F.count(F.lit(1)).alias("_n")), "start")
    totals = n.groupBy(F.col("node").alias("domain_id")).agg(F.sum("_n").alias("products"))
    return rows.select(F.col("id").alias("domain_id"), "name").join(place, "domain_id").join(totals, "domain_id", "left").fillna(0, ["products"])


# --- access requests ----------------------------------------------------------------------

def inbox(request: DataFrame, product_id: str | None = None, status: str | None = None) -> DataFrame:
    """Requests of a product and a status, newest first."""
    rows = request
    if product_id is not None:
        rows = rows.filter(F.col("product_id") == product_id)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(F.col("created_at").desc(), "id")


def decide(request: DataFrame, decision: DataFrame, product: DataFrame, writes_enabled: bool) -> tuple[DataFrame, DataFrame]:
    """(requests, conflicts). The first decision (request_id, seq, approve, decided_by, decided_at, apply) on a pending
    request counts, any other one is a conflict with the status it met. An approval stands whatever its grant does:
    `grant_error` says why access did not change, `grant_applied` whether the grant is to be sent."""
    first = decision.groupBy("request_id").agg(F.min(F.struct("seq", "approve", "decided_by", "decided_at", "apply")).alias("_d"))
    rows = request.withColumnRenamed("id", "request_id").join(first, "request_id", "left").join(
        product.select(F.col("id").alias("product_id"), "workspace_id"), "product_id", "left"
    )
    hit = (F.col("status") == "pending") & F.col("_d").isNotNull()
    approved = hit & F.col("_d.approve")
    send = approved & F.col("_d.apply") & F.lit(writes_enabled)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    error = F.when(approved & F.lit(not writes_enabled), "writes are disabled").when(
        send & blank("workspace_id"), "the product has no workspace"
    ).when(send & blank("requester_object_id"), "the requester's principal id is unknown")
    decided = rows.select(
        "request_id",
        "product_id",
        F.when(hit, F.when(F.col("_d.approve"), "approved").otherwise("denied")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.col("_d.decided_at")).otherwise(F.col("decided_at")).alias("decided_at"),
        F.when(hit, F.col("_d.decided_by")).otherwise(F.col("decided_by")).alias("decided_by"),
        error.alias("grant_error"),
        F.when(approved, send & error.isNull()).alias("grant_applied"),
    )
    met = rows.select("request_id", F.when(hit, F.col("_d.seq")).alias("_won"), F.when(hit, F.when(F.col("_d.approve"), "approved").otherwise("denied")).otherwise(F.col("status")).alias("met"))
    conflicts = decision.join(met, "request_id").filter("_won is null or seq <> _won").select("request_id", "seq", "met")
    return decided, conflicts
