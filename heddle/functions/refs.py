"""Canonical table references, ``workspace/lakehouse/table``, as column expressions.

Unknown parts are empty; ``%`` and ``/`` inside a part are escaped, ``%`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.session import keyed

# How storage paths and item names are written.
ABFSS = r"(?i)^abfss://([^@/]+)@[^/]+/(.*)$"
STORAGE_LEAF = r"(?i)^[_.]|^part-|\.(?:json|parquet|crc|checkpoint|txt|avro)$"
KIND_SUFFIX = r"(?i)\.(?:Lakehouse|Warehouse|Datawarehouse)$"
GENERIC_CONTAINER = "onelake"
WORKSPACE_GUID = r"(?i)abfss://([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})@"
FILES = "files"
TABLES = "tables"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def escape(part: Column | str) -> Column:
    text = F.coalesce(_c(part), F.lit(""))
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def unescape(part: Column) -> Column:
    out = part
    for code, char in (("%2F", "/"), ("%2f", "/"), ("%25", "%")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def make_ref(table: Column | str, lakehouse: Column | str, workspace: Column | str) -> Column:
    return F.concat_ws("/", escape(workspace), escape(lakehouse), escape(table))


def parse_ref(ref: Column | str) -> Column:
    """struct(workspace, lakehouse, table); a bare name is a table, two parts lack the workspace."""
    parts = F.split(_c(ref), "/", -1)
    n = F.size(parts)
    rest = F.array_join(F.slice(parts, 3, F.greatest(n - 2, F.lit(0))), "/")
    empty = F.lit("")
    return F.struct(
        unescape(F.when(n >= 3, F.get(parts, F.lit(0))).otherwise(empty)).alias("workspace"),
        unescape(F.when(n >= 3, F.get(parts, F.lit(1))).when(n == 2, F.get(parts, F.lit(0))).otherwise(empty)).alias("lakehouse"),
        unescape(F.when(n >= 3, rest).otherwise(F.get(parts, n - 1))).alias("table"),
    )


def ref_parts(ref: Column | str) -> Column:
    """The side record of a ref: its parts, whether it is placed, and file or table."""
    p = parse_ref(ref)
    leaf = F.lower(p["table"])
    is_file = (p["table"] == "Files") | leaf.startswith("files/")
    return F.struct(
        p["workspace"].alias("workspace"),
        p["lakehouse"].alias("lakehouse"),
        p["table"].alias("table"),
        ((p["workspace"] != "") & (p["table"] != "")).alias("resolved"),
        F.when(is_file, "file").otherwise("table").alias("kind"),
    )


def path_leaf(segments: Column) -> Column:
    """What a storage path names: from ``Files`` on as written, else the table whose storage it reaches into."""
    at = F.array_position(F.transform(segments, F.lower), FILES)
    inside = F.filter(segments, lambda s: (F.lower(s) != TABLES) & ~F.rlike(s, F.lit(STORAGE_LEAF)))
    file_path = F.array_join(F.slice(segments, F.greatest(at, F.lit(1)).cast("int"), F.size(segments)), "/")
    return F.when(at > 0, file_path).otherwise(F.coalesce(F.try_element_at(inside, F.lit(-1)), F.lit("")))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def clean_raw(raw: Column | str) -> Column:
    """A reference as written, without the blanks, backticks, quotes and closing slashes around it."""
    out = F.regexp_replace(F.coalesce(_c(raw), F.lit("")), r"^\s+|\s+$", "")
    out = F.regexp_replace(out, r"^`+|`+$", "")
    out = F.regexp_replace(out, r"""^['"]+|['"]+$""", "")
    return F.regexp_replace(out, r"/+$", "")


def _with_parts(df: DataFrame, raw: str | Column, workspace: str | Column, lakehouse: str | Column, placed: bool) -> DataFrame:
    """Add `_q`, struct(workspace, lakehouse, table, by_path), before GUIDs are named; `by_path` marks the
    storage-path form, the only one whose parts go through the name map. Built in steps, each a
    column of its own, so that no pattern is matched more than once per row."""
    rows = df.withColumn("_text", clean_raw(raw))
    rows = rows.withColumn("_container", F.regexp_extract("_text", ABFSS, 1))
    by_path, generic = F.col("_container") != "", F.lower("_container") == GENERIC_CONTAINER
    rows = rows.withColumn("_segs", _segments(F.when(by_path, F.regexp_extract("_text", ABFSS, 2)).otherwise(F.col("_text"))))
    skip = F.when(generic, 1).otherwise(0)
    rows = rows.withColumn(
        "_tail", F.when(by_path, F.slice("_segs", skip + 2, F.greatest(F.size("_segs"), F.lit(1)))).otherwise(F.col("_segs"))
    )
    rows = rows.withColumn("_leaf", F.when(F.contains("_text", F.lit("/")), path_leaf(F.col("_tail"))))
    rows = rows.withColumn("_dots", F.filter(F.split("_text", r"\."), lambda s: s != ""))
    n, nothing = F.size("_dots"), F.lit("")
    ws, lh = F.coalesce(_c(workspace), nothing), F.coalesce(_c(lakehouse), nothing)
    strip = lambda c: F.regexp_replace(c, KIND_SUFFIX, "")
    last = lambda i: F.try_element_at("_dots", F.lit(i))
    segment = lambda i: F.coalesce(F.get("_segs", i), nothing)

    def row(w: Column, l: Column, t: Column, p: bool) -> Column:
        return F.struct(w.alias("workspace"), l.alias("lakehouse"), t.alias("table"), F.lit(p).alias("by_path"))

    parts = (
        F.when(F.col("_text") == "", row(nothing, nothing, nothing, False))
        .when(by_path, row(F.when(generic, segment(F.lit(0))).otherwise(F.col("_container")), strip(segment(skip)), F.col("_leaf"), True))
        .when(F.col("_leaf").isNotNull(), row(ws, lh, F.col("_leaf"), False))
        .when(n >= 3, row(last(-3), strip(last(-2)), last(-1), False))
        .when(n == 2, row(ws, strip(last(-2)), last(-1), False))
        .otherwise(row(ws, lh, F.col("_text"), False))
    )
    # Exploding a one-element array keeps later filters from being pushed into, and so
    # repeated over, all the steps above; without a table the array is empty.
    one = F.array(parts)
    made = F.explode(F.filter(one, lambda p: p["table"] != "") if placed else one)
    return rows.select(*df.columns, made.alias("_q"))


def qualify(
    df: DataFrame,
    raw: str,
    workspace: str | Column,
    lakehouse: str | Column,
    names: DataFrame | None = None,
    out: str = "ref",
    placed: bool = False,
) -> DataFrame:
    """Add the canonical ref of a raw reference. `names` is (guid, name), guid in lower case and unique.
    With `placed`, rows whose reference names no table are dropped."""
    rows = _with_parts(df, raw, workspace, lakehouse, placed)
    parts = {p: F.col(f"_q.{p}") for p in ("table", "lakehouse", "workspace")}
    if names is not None:
        lookup = names.select(F.col("guid").alias("_g"), F.col("name").alias("_name"))
        for p in parts:
            key = F.when(F.col("_q.by_path") & (F.col(f"_q.{p}") != ""), F.lower(f"_q.{p}"))
            rows = rows.withColumn("_k", keyed(key)).join(
                lookup.withColumnRenamed("_g", "_k").withColumnRenamed("_name", f"_n_{p}"), "_k", "left"
            ).drop("_k")
            parts[p] = F.coalesce(f"_n_{p}", f"_q.{p}")
    made = make_ref(parts["table"], parts["lakehouse"], parts["workspace"])
    return rows.withColumn(out, made).drop("_q", "_n_table", "_n_lakehouse", "_n_workspace")


def is_canonical(value: Column | str) -> Column:
    text = F.trim(_c(value))
    return ~F.lower(text).startswith("abfss://") & (F.size(F.split(text, "/", -1)) > 2)


def as_ref(df: DataFrame, raw: str, workspace: str, lakehouse: str, names: DataFrame | None = None, out: str = "ref") -> DataFrame:
    """Like `qualify`, but a value that is a canonical ref already stays as it is."""
    return qualify(df, raw, workspace, lakehouse, names, "_made").withColumn(
        out, F.when(is_canonical(raw), F.col(raw)).otherwise(F.col("_made"))
    ).drop("_made")


def view_key(raw: Column | str) -> Column:
    """Key of a temp view, or '' for what cannot name one."""
    text = F.regexp_replace(F.coalesce(_c(raw), F.lit("")), r"^\s+|\s+$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^`+|`+$", ""), r"""^['"]+|['"]+$""", "")
    name = F.regexp_extract(F.trim(text), r"(?iU)^(?:global_temp\.)?([^\W\d]\w*)$", 1)
    return F.lower(name)


def workspaces_referenced(cell: DataFrame) -> DataFrame:
    """(nb_id, guid): workspace GUIDs in storage paths of a notebook, in the spelling that comes first."""
    found = cell.select(
        "nb_id", "cell_index", F.posexplode(F.regexp_extract_all("source", F.lit(WORKSPACE_GUID), 1)).alias("pos", "guid")
    )
    first = F.min_by("guid", F.struct("cell_index", "pos")).alias("guid")
    return found.groupBy("nb_id", F.lower("guid").alias("_k")).agg(first).drop("_k")


def guid_names(*sources: DataFrame) -> DataFrame:
    """(guid, name) over workspaces and items; each source is (id, name), earlier sources win."""
    rows = None
    for rank, source in enumerate(sources):
        part = source.filter("coalesce(id, '') <> '' and coalesce(name, '') <> ''").select(
            F.lower("id").alias("guid"), "name", F.lit(rank).alias("_r")
        )
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("guid").agg(F.min(F.struct("_r", "name"))["name"].alias("name"))


def named(df: DataFrame, guid: str, names: DataFrame, out: str) -> DataFrame:
    """A GUID's display name, or the GUID itself when unknown."""
    lookup = names.select(F.col("guid").alias("_g"), F.col("name").alias("_name"))
    return df.withColumn("_k", keyed(F.lower(F.trim(F.col(guid))))).join(lookup, F.col("_k") == F.col("_g"), "left").withColumn(
        out, F.coalesce("_name", F.trim(F.col(guid)))
    ).drop("_k", "_g", "_name")


def asset_name(qualified: Column | str, name: Column | str) -> Column:
    """Key a catalogue asset is matched by: last segment of its twice-encoded qualified name, without the schema."""
    def decoded(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)

    def last(x: Column) -> Column:
        tail = F.element_at(F.split(F.regexp_replace(x, "/+$", ""), "/"), -1)
        return F.element_at(F.split(decoded(decoded(tail)), "/"), -1)

    own = last(F.coalesce(_c(qualified), F.lit("")))
    return F.lower(F.when(own != "", own).otherwise(F.coalesce(_c(name), F.lit(""))))


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) for keys that exactly one value has."""
    seen = df.filter(F.col(key) != "").groupBy(key)
    return seen.agg(F.min(value).alias(value), F.max(value).alias("_high")).filter(F.col(value) == F.col("_high")).drop("_high")


def visible_only(requested: DataFrame, visible: DataFrame | None) -> DataFrame:
    """Requested (request_id, ordinal, id) the caller may see, once per id whatever its case, first place kept.
    `visible` is (request_id, id): None means no restriction; a request without rows there sees nothing."""
    once = (
        requested.filter("trim(id) <> ''")
        .groupBy("request_id", F.lower(F.trim("id")).alias("_k"))
        .agg(F.min(F.struct("ordinal", "id")).alias("_f"))
        .select("request_id", "_k", F.col("_f.ordinal").alias("ordinal"), F.col("_f.id").alias("id"))
    )
    if visible is not None:
        allowed = visible.select("request_id", F.lower(F.trim("id")).alias("_k")).distinct()
        once = once.join(allowed, ["request_id", "_k"], "left_semi")
    return once.drop("_k")
