"""Reads and writes from the text of executed plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.refs import qualify
from heddle.session import moved

# Plan node names and the text around them.
WRITE_NODES = (
    "InsertInto",
    "CreateDataSourceTableAsSelect",
    "(?:Optimized)?CreateHiveTableAsSelect",
    "(?:Atomic)?CreateTableAsSelect",
    "(?:Atomic)?ReplaceTable",
    "SaveIntoDataSource",
    "Write(?:IntoDelta|Delta)",
    "MergeInto",
    "Update(?:Command|Table)",
    "Delete(?:Command|FromTable)",
    "AppendData",
    "OverwriteByExpression",
    "OverwritePartitionsDynamic",
    "ReplaceData",
    "LoadData",
)
READ_NODES = (
    "(?:File)?Scan",
    "BatchScan",
    "LogicalRelation",
    "HiveTableRelation",
    "Relation",
    "(?:Streaming)?DataSourceV2",
)
OTHER_NODES = (
    "Optimize",
    "Vacuum",
    "AnalyzeTable",
    "RefreshTable",
    "CreateTable",
    "CreateV2Table",
    "AlterTable",
    "(?:Noop)?DropTable",
    "TruncateTable",
    "RenameTable",
    "DescribeTable",
    "ShowTable",
    "SetCommand",
    "AddJar",
)
DEFAULT_CATALOGS = "spark_catalog|hive_metastore|default|delta"
PLACEHOLDERS = ("dummydeltatable", "onerowrelation", "unresolvedrelation")
IN_MEMORY = r"(?i)^(?:localtablescan|scan existingrdd)"
LOCATION = r"Location:[^\[\n]*\[([^\]]*)\]"
URI = r"""(abfss://[^\s,\]\)'"]+)"""
BACKTICKED = r"`([^`]+(?:`\.`[^`]+)*)`"
SCAN_TABLE = r"(?iU)^(?:File)?Scan\s+\w+\s+([\w.]+?)\s*$"
HEADER = r"^\((\d+)\)\s+(.+?)(?:\s*\[[^\]\n]*\])?[ \t]*(?:\n|$)"
TREE_DRAWING = r"^[\s+\-*:|]*(?:\(\d+\)\s*)?"


def node_class(name: Column | str) -> Column:
    """write, read, skip or '' for unknown. Writes go first: a create-as-select also starts like a plain create."""
    text = F.col(name) if isinstance(name, str) else name
    one_of = lambda names: "(?:" + "|".join(names) + ")"
    return (
        F.when(F.rlike(text, F.lit(rf"(?i)^(?:Execute\s+)?{one_of(WRITE_NODES)}")), "write")
        .when(F.rlike(text, F.lit(rf"(?i)^{one_of(READ_NODES)}")), "read")
        .when(F.rlike(text, F.lit(rf"(?i)^(?:Execute\s+)?{one_of(OTHER_NODES)}")), "skip")
        .otherwise("")
    )


def blocks(execution: DataFrame) -> DataFrame:
    """(execution_id, node_no, node_name, body) of formatted plans; other plans give no rows."""
    cut_text = F.split("plan", r"(?m)(?=^\(\d+\)\s+\S)")
    part = execution.select("execution_id", F.explode(cut_text).alias("_b")).filter(F.rlike("_b", F.lit(r"^\(\d+\)\s+\S")))
    return part.select(
        "execution_id",
        F.regexp_extract("_b", HEADER, 1).cast("int").alias("node_no"),
        F.trim(F.regexp_extract("_b", HEADER, 2)).alias("node_name"),
        F.regexp_replace("_b", HEADER, "").alias("body"),
    )


def _has_arguments(body: Column) -> Column:
    return F.exists(
        F.split(body, "\n"), lambda s: (F.trim(s) != "") & ~F.trim(s).startswith("Output:") & ~F.trim(s).startswith("Input:")
    )


def path_candidates(text: Column) -> Column:
    """Paths a text names: entries of a Location list, and any storage URI. An overflow mark names nothing."""
    listed = F.flatten(
        F.transform(F.regexp_extract_all(text, F.lit(LOCATION), 1), lambda s: F.transform(F.split(s, ","), lambda x: F.trim(x)))
    )
    every = F.array_distinct(F.concat(listed, F.regexp_extract_all(text, F.lit(URI), 1)))
    return F.filter(every, lambda s: (s != "") & ~s.startswith("..."))


def _catalog_name(dotted: Column) -> Column:
    """An identifier without the engine's own catalogs; '' for a placeholder."""
    plain = F.array_join(F.filter(F.split(F.replace(dotted, F.lit("`"), F.lit("")), r"\."), lambda s: s != ""), ".")
    bare = F.regexp_replace(plain, rf"(?i)^(?:(?:{DEFAULT_CATALOGS})(?:\.|$))+", "")
    return F.when(F.lower(F.element_at(F.split(bare, r"\."), -1)).isin(*PLACEHOLDERS), "").otherwise(bare)


def identifier_candidates(text: Column) -> Column:
    """Catalog identifiers in backticks, in the order written."""
    named = F.transform(F.regexp_extract_all(text, F.lit(BACKTICKED), 1), _catalog_name)
    return F.array_distinct(F.filter(named, lambda s: s != ""))


PATH_RANK, HEADER_RANK, IDENTIFIER_RANK = 1, 2, 3


def node_refs(block: DataFrame, context: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(execution_id, node_no, node_name, kind, rank, pos, ref): every table a reading or writing
    node may name, by source. `context` is (execution_id, workspace, lakehouse)."""
    used = block.withColumn("kind", node_class("node_name")).filter(
        F.col("kind").isin("read", "write") & _has_arguments(F.col("body"))
    )

    def ranked(found: Column, rank: int) -> Column:
        return F.transform(
            found, lambda s, i: F.struct(F.lit(rank).alias("rank"), i.cast("int").alias("pos"), s.alias("raw"))
        )

    header = _catalog_name(F.regexp_extract("node_name", SCAN_TABLE, 1))
    from_header = F.when((F.col("kind") == "read") & (header != ""), F.array(header)).otherwise(F.expr("cast(array() as array<string>)"))
    every = F.concat(
        ranked(path_candidates(F.col("body")), PATH_RANK),
        ranked(from_header, HEADER_RANK),
        ranked(identifier_candidates(F.col("body")), IDENTIFIER_RANK),
    )
    rows = used.select("execution_id", "node_no", "node_name", "kind", F.inline(every)).join(moved(context), "execution_id", "left")
    return qualify(rows, "raw", "workspace", "lakehouse", names, placed=True).select(
        "execution_id", "node_no", "node_name", "kind", "rank", "pos", "ref"
    )


def access(refs: DataFrame) -> DataFrame:
    """(execution_id, access, ref) per statement from `node_refs`.

    Paths beat the header, the header beats identifiers. A write has one target: its
    smallest path, else its first identifier. What a statement writes it does not also read.
    """
    node = refs.groupBy("execution_id", "node_no", "kind").agg(
        F.min("rank").alias("_best"), F.collect_set(F.struct("rank", "pos", "ref")).alias("_all")
    )
    best = F.filter("_all", lambda r: r["rank"] == F.col("_best"))
    by_place = F.array_min(F.transform(best, lambda r: F.struct(r["pos"], r["ref"])))["ref"]
    target = F.when(F.col("_best") == PATH_RANK, F.array_min(best["ref"])).otherwise(by_place)
    used = node.select(
        "execution_id", "kind", F.explode(F.when(F.col("kind") == "write", F.array(target)).otherwise(best["ref"])).alias("ref")
    )
    return used.groupBy("execution_id", "ref").agg(F.max("kind").alias("access")).select("execution_id", "access", "ref")


def unrecognised(block: DataFrame, refs: DataFrame) -> DataFrame:
    """(execution_id, node_name): reading or writing nodes with arguments that name no table; in-memory scans are none."""
    used = block.withColumn("kind", node_class("node_name")).filter(
        F.col("kind").isin("read", "write")
        & _has_arguments(F.col("body"))
        & ~((F.col("kind") == "read") & F.rlike("node_name", F.lit(IN_MEMORY)))
    )
    return used.join(refs.select("execution_id", "node_no"), ["execution_id", "node_no"], "left_anti").select(
        "execution_id", "node_name"
    ).distinct()


def access_simple(execution: DataFrame, context: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Plans with one operator per line: same classes, the line is the node and its paths the only source."""
    lines = execution.filter(~F.rlike("plan", F.lit(r"(?m)^\(\d+\)\s+\S"))).select(
        "execution_id", F.posexplode(F.split("plan", "\n")).alias("line_no", "line")
    )
    rows = (
        lines.withColumn("kind", node_class(F.regexp_replace("line", TREE_DRAWING, "")))
        .filter(F.col("kind").isin("read", "write"))
        .select("execution_id", "line_no", "kind", F.explode(path_candidates(F.col("line"))).alias("raw"))
        .join(moved(context), "execution_id", "left")
    )
    made = qualify(rows, "raw", "workspace", "lakehouse", names, placed=True)
    writes = made.filter("kind = 'write'").groupBy("execution_id", "line_no").agg(F.min("ref").alias("ref"))
    reads = made.filter("kind = 'read'").select("execution_id", F.lit("read").alias("access"), "ref")
    return reads.union(writes.select("execution_id", F.lit("write").alias("access"), "ref")).distinct()
