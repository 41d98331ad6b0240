"""Run history: observed runs, prediction against observation, coverage, failures, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.session import moved

# States in which a run has ended.
ENDED = ("success", "succeeded", "completed", "finished", "dead", "error", "failed", "killed")


def _first(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def sessions(raw: DataFrame) -> DataFrame:
    """Sessions with one spelling of each field: (nb_id, ordinal, livy_id, app_id, state, submitted_at, submitter)."""
    return raw.select(
        "nb_id",
        "ordinal",
        _first("livyId", "livySessionId", "id").alias("livy_id"),
        _first("sparkApplicationId", "applicationId", "appId").alias("app_id"),
        _first("state", "status").alias("state"),
        _first("submittedDateTime", "startDateTime", "queuedDateTime").alias("submitted_at"),
        _first("submitter", "creator").alias("submitter"),
    )


def latest_run(session: DataFrame) -> DataFrame:
    """One session per notebook: the newest that has ended, else the newest; the first listed on a tie."""
    ended = F.lower("state").isin(*ENDED)
    best = F.max(F.struct(ended.alias("_e"), F.col("submitted_at").alias("_s"), (-F.col("ordinal")).alias("_o"), *[
        F.col(c) for c in session.columns if c != "nb_id"
    ])).alias("_b")
    return session.groupBy("nb_id").agg(best).select("nb_id", *[F.col(f"_b.{c}").alias(c) for c in session.columns if c != "nb_id"])


def observed_run(latest: DataFrame, execution: DataFrame, access: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, access) of each notebook's latest run: all statements seen and resolved, and the run's
    reads and writes; what any statement writes is not also a read of the run. `reason` says why a run tells nothing: it is not
    available (no session or application id), has no statements, or none that names a table.
    `execution` is (livy_id, execution_id); `access` (livy_id, execution_id, access, ref)."""
    known = latest.filter((F.col("livy_id") != "") & (F.col("app_id") != ""))
    used = moved(execution.join(known.select("nb_id", "livy_id"), "livy_id"))
    hits = access.join(used.select("nb_id", "livy_id", "execution_id"), ["livy_id", "execution_id"])
    resolved = hits.select("nb_id", "livy_id", "execution_id").distinct().groupBy("nb_id").agg(F.count(F.lit(1)).alias("resolved"))
    seen = used.groupBy("nb_id").agg(F.count(F.lit(1)).alias("seen"))
    counts = (
        latest.select("nb_id", "livy_id", "app_id", "state", "submitted_at")
        .join(seen, "nb_id", "left")
        .join(resolved, "nb_id", "left")
        .fillna(0, ["seen", "resolved"])
        .withColumn("available", (F.col("livy_id") != "") & (F.col("app_id") != ""))
        .withColumn(
            "reason",
            F.when(F.col("livy_id") == "", "no run")
            .when(F.col("app_id") == "", "no application id")
            .when(F.col("seen") == 0, "no statements")
            .when(F.col("resolved") == 0, "none resolved"),
        )
    )
    run = hits.groupBy("nb_id", "ref").agg(F.max("access").alias("access")).select("nb_id", "access", "ref")
    return counts, run


def statements(execution: DataFrame, access: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, access): each statement that names a table, with the tables as rows;
    statements without a table count but are not listed."""
    keep = access.select("livy_id", "execution_id").distinct()
    rows = moved(execution.join(keep, ["livy_id", "execution_id"], "left_semi"))
    return moved(rows.select(
        "livy_id", "execution_id", "description", "status", "submitted", "duration_ms"
    )), access.join(rows.select("livy_id", "execution_id"), ["livy_id", "execution_id"], "left_semi").distinct()


def code_newer(latest: DataFrame, modified: DataFrame) -> DataFrame:
    """(nb_id, code_newer): edited after the run, when both times are known; ISO text, compared as written."""
    rows = latest.select("nb_id", "submitted_at").join(modified.select("nb_id", "modified_at"), "nb_id", "left")
    late = (F.coalesce("modified_at", F.lit("")) > F.col("submitted_at")) & (F.col("submitted_at") != "")
    return rows.select("nb_id", F.coalesce(late, F.lit(False)).alias("code_newer"))


def compare(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """(run_id, access, ref, verdict): agreed, predicted_only or observed_only."""
    p = predicted.select("run_id", "access", "ref").distinct().withColumn("_p", F.lit(True))
    o = observed.select("run_id", "access", "ref").distinct().withColumn("_o", F.lit(True))
    verdict = F.when(F.col("_p") & F.col("_o"), "agreed").when(F.col("_p"), "predicted_only").otherwise("observed_only")
    return p.join(o, ["run_id", "access", "ref"], "full").select("run_id", "access", "ref", verdict.alias("verdict"))


def compare_counts(comparison: DataFrame) -> DataFrame:
    """Sizes of the six sets per run, and whether the run agrees."""
    n = lambda v, a: F.count_if((F.col("verdict") == v) & (F.col("access") == a)).alias(f"{v}_{a}s")
    return comparison.groupBy("run_id").agg(
        *[n(v, a) for v in ("agreed", "predicted_only", "observed_only") for a in ("read", "write")],
        (F.count_if(F.col("verdict") != "agreed") == 0).alias("agrees"),
    )


def observed_summary(observed: DataFrame, comparison: DataFrame, group: str = "sequence_id") -> tuple[DataFrame, DataFrame]:
    """(summary, refs) over the runs of a sequence. `observed` is (group, run_id, available, submitted_at, submitter,
    state, code_changed_at); `comparison` (group, run_id, access, ref, verdict). A table agreed anywhere is
    not also predicted-only."""
    there = F.col("available")
    newest = F.max(F.when(there & (F.col("submitted_at") != ""), F.struct("submitted_at", "submitter", "state"))).alias("_n")
    summary = observed.groupBy(group).agg(
        F.count(F.lit(1)).alias("asked"),
        F.count_if(there).alias("available"),
        newest,
        F.max(there & (F.coalesce("code_changed_at", F.lit("")) > F.col("submitted_at"))).alias("code_is_newer"),
    ).select(
        group, "asked", "available", F.col("_n.submitted_at").alias("last_run_at"), F.col("_n.submitter").alias("last_run_by"),
        F.col("_n.state").alias("last_run_state"), "code_is_newer",
    )
    alive = comparison.join(observed.filter("available").select(group, "run_id"), [group, "run_id"], "left_semi")
    sets = alive.select(group, "ref", "verdict").distinct()
    agreed = sets.filter("verdict = 'agreed'").select(group, "ref")
    refs = sets.filter("verdict <> 'predicted_only'").unionByName(
        sets.filter("verdict = 'predicted_only'").join(agreed, [group, "ref"], "left_anti").select(*sets.columns)
    )
    return summary, refs


def failures(step: DataFrame, run: DataFrame, cell: DataFrame) -> DataFrame:
    """(sequence_id, ordinal, scope, name, cell, error): failed steps, failed runs and failed cells, cells from 1."""
    s = step.filter("coalesce(error, '') <> ''").select("sequence_id", "ordinal", F.lit("step").alias("scope"), "name", F.lit(None).cast("int").alias("cell"), "error")
    r = run.filter("coalesce(error, '') <> ''").select("sequence_id", "ordinal", F.lit("run").alias("scope"), "name", F.lit(None).cast("int").alias("cell"), "error")
    failed = cell.filter("status = 'error' and coalesce(error, '') <> ''").select("run_id", "cell_index", "error")
    c = failed.join(run.select("run_id", "sequence_id", "ordinal", "name"), "run_id").select(
        "sequence_id", "ordinal", F.lit("cell").alias("scope"), "name", (F.col("cell_index") + 1).cast("int").alias("cell"), "error"
    )
    return s.unionByName(r).unionByName(c)


def narrative_counts(run: DataFrame, cell: DataFrame, access: DataFrame, uncovered: DataFrame) -> DataFrame:
    """Notebooks, cells, distinct tables read, written and written without column lineage, per sequence."""
    key = run.select("sequence_id", "run_id")
    a = run.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("notebooks"))
    b = cell.join(key, "run_id").groupBy("sequence_id").agg(F.count(F.lit(1)).alias("cells"))
    touched = access.join(key, "run_id").select("sequence_id", "access", "ref").distinct()
    c = touched.groupBy("sequence_id").agg(
        F.count_if(F.col("access") == "read").alias("reads"), F.count_if(F.col("access") == "write").alias("writes")
    )
    d = uncovered.join(key, "run_id").select("sequence_id", "ref").distinct().groupBy("sequence_id").agg(F.count(F.lit(1)).alias("bare"))
    out = a
    for part in (b, c, d):
        out = out.join(part, "sequence_id", "left")
    return out.fillna(0, ["cells", "reads", "writes", "bare"])


def table_coverage(access: DataFrame, traced: DataFrame, schema: DataFrame, unresolved: DataFrame, coverage: DataFrame) -> DataFrame:
    """(sequence_id, ref, level, reason): the best any run knows of each table.

    `access` is (sequence_id, run_id, ordinal, access, ref); `traced`, `schema` and `unresolved` (run_id, ref);
    `coverage` (run_id, frame_write_cells, dynamic_sql_cells, unparsable_cells, first_failure). Reasons are codes.
    """
    per = access.groupBy("sequence_id", "run_id", "ordinal", "ref").agg(F.max((F.col("access") == "write")).alias("written"))
    flag = lambda df, n: df.select("run_id", "ref", F.lit(True).alias(n)).distinct()
    rows = per
    for df, n in ((traced, "_traced"), (schema, "_schema"), (unresolved, "_unres")):
        rows = rows.join(flag(df, n), ["run_id", "ref"], "left")
    rows = rows.join(coverage, "run_id", "left")
    rank = F.when(F.col("_traced"), 2).when(F.col("_schema"), 1).otherwise(0)
    bare = (
        F.when(F.col("_unres") & F.col("first_failure").isNotNull(), F.concat(F.lit("schema unreadable: "), "first_failure"))
        .when(F.col("_unres"), "schema unreadable")
        .otherwise("no columns resolved")
    )
    partial = (
        F.when(~F.col("written"), "read only")
        .when(F.col("frame_write_cells").isNull(), "no coverage recorded")
        .when(F.col("frame_write_cells") > 0, "frame write")
        .when(F.col("dynamic_sql_cells") > 0, "dynamic sql")
        .when(F.col("unparsable_cells") > 0, "unparsable cell")
        .otherwise("unknown")
    )
    graded = rows.select(
        "sequence_id", "ref", rank.alias("_rank"), "ordinal", F.when(rank == 2, "").when(rank == 1, partial).otherwise(bare).alias("reason")
    )
    best = graded.groupBy("sequence_id", "ref").agg(F.max(F.struct("_rank", (-F.col("ordinal")).alias("_o"), "reason")).alias("_b"))
    level = F.when(F.col("_b._rank") == 2, "traced").when(F.col("_b._rank") == 1, "columns-only").otherwise("bare")
    return best.select("sequence_id", "ref", level.alias("level"), F.col("_b.reason").alias("reason"))


def coverage_counts(per_table: DataFrame) -> DataFrame:
    return per_table.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("tables"),
        F.count_if(F.col("level") == "traced").alias("traced"),
        F.count_if(F.col("level") == "columns-only").alias("columns_only"),
        F.count_if(F.col("level") == "bare").alias("bare"),
    )


def diff_runs(tables: DataFrame, columns: DataFrame, traced: DataFrame, pair: DataFrame) -> DataFrame:
    """(sequence_id, change, ref, column_name) between two executions of a sequence.

    `tables` is (execution, ref), `columns` (execution, ref, column_name), `traced` (execution, ref);
    `pair` (sequence_id, previous, current), previous null for a first execution, which has no diff.
    Lost lineage is reported for tables still touched only.
    """
    pair = pair.filter("previous is not null")
    nothing = F.lit(None).cast("string").alias("column_name")

    def sides(df: DataFrame, keys: list[str]) -> DataFrame:
        one = df.select("execution", *keys).distinct()
        before = pair.select("sequence_id", F.col("previous").alias("execution")).join(one, "execution").select("sequence_id", *keys, F.lit(True).alias("_b"))
        after = pair.select("sequence_id", F.col("current").alias("execution")).join(one, "execution").select("sequence_id", *keys, F.lit(True).alias("_a"))
        return before.join(after, ["sequence_id", *keys], "full")

    t, c, f = sides(tables, ["ref"]), sides(columns, ["ref", "column_name"]), sides(traced, ["ref"])
    word = lambda noun: F.when(F.col("_b").isNull(), f"added {noun}").otherwise(f"removed {noun}").alias("change")
    still = t.filter("_a").select("sequence_id", "ref")
    lost = f.filter("_b and _a is null").join(still, ["sequence_id", "ref"], "left_semi")
    return (
        t.filter("_a is null or _b is null").select("sequence_id", word("table"), "ref", nothing)
        .unionByName(c.filter("_a is null or _b is null").select("sequence_id", word("column"), "ref", "column_name"))
        .unionByName(lost.select("sequence_id", F.lit("lost lineage").alias("change"), "ref", nothing))
    )
