"""Session helpers: cutting lineage, joins with hot keys, distributed ranking."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local session gets its own."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/heddle-steps")


#: Codec of steps: ids of lineage tables repeat their beginnings, which this one makes far smaller than Spark's default.
STEP_CODEC = "zstd"


#: Spark's factor from the bytes of a file to those of its rows, and what ids of lineage tables come to: 4 to 8 bytes in a file, 100 or more in
#: a table that is sent to all tasks.
FACTOR, GROWN = "spark.sql.sources.fileCompressionFactor", "16.0"


def sized(spark: SparkSession) -> None:
    """From now on Spark sizes files by what their rows come to, unless the session has a factor of its own. As bytes of a file, millions of ids pass
    as small enough to be sent whole through the driver."""
    if float(spark.conf.get(FACTOR)) == 1.0:
        spark.conf.set(FACTOR, GROWN)


#: Spark's switch for deleting the shuffle files of a query when it ends.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: a step is read from its own files from then on, and those that it was made
    from would lie there until the driver happens to collect its garbage."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


#: What is under way, innermost last: path and table name of the steps that each has written.
_PASSING: list[list[tuple[str, str | None]]] = []


class Passing:
    """Steps written inside are deleted when it ends: those that only lead to what is kept. `kept` writes a step that outlasts it, and so does
    all that is written in `outside`. Nothing that was left lazy inside may be read later."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.steps: list[tuple[str, str | None]] = []

    def __enter__(self) -> Passing:
        _PASSING.append(self.steps)
        return self

    def __exit__(self, *_) -> None:
        _PASSING.pop()
        for path, name in self.steps:
            if name is not None:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                _TABLES[self.spark.sparkContext.applicationId].remove(name)
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    @contextmanager
    def outside(self) -> Iterator[None]:
        _PASSING.pop()
        try:
            yield
        finally:
            _PASSING.append(self.steps)

    def kept(self, df: DataFrame, *keys: str) -> DataFrame:
        with self.outside():
            return cut_by(df, *keys) if keys else cut(df)


@contextmanager
def lasting() -> Iterator[None]:
    """What is written inside lasts as long as the session, whatever is under way."""
    held = _PASSING[:]
    _PASSING.clear()
    try:
        yield
    finally:
        _PASSING.extend(held)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the checkpoint folder and read it back.

    Loops keep short plans, lost executors re-read a finished step instead of
    recomputing it, and the optimizer learns the size of what was written.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{root}/step-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.option("compression", STEP_CODEC).parquet(path)
    if _PASSING:
        _PASSING[-1].append((path, None))
    return spark.read.schema(df.schema).parquet(path)


#: How often each application's steps have been deleted; what refers to steps is out of date after that.
_FORGOTTEN: dict[str, int] = {}
#: Names of each application's steps that are tables.
_TABLES: dict[str, list[str]] = {}


def generation(spark: SparkSession) -> int:
    return _FORGOTTEN.get(spark.sparkContext.applicationId, 0)


def forget(spark: SparkSession) -> None:
    """Delete every step this session has written to its checkpoint folder."""
    _FORGOTTEN[spark.sparkContext.applicationId] = generation(spark) + 1
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(found.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_by(df: DataFrame, *keys: str) -> DataFrame:
    """As `cut`, dealt and sorted by the keys, so that a join or a group on them reads it without moving it again.

    The step is a table of the session's catalogue whose files lie in the checkpoint folder; `forget` drops it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"heddle_step_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"
    with swept(spark):
        df.repartition(parts, *keys).write.bucketBy(parts, *keys).sortBy(*keys).option("compression", STEP_CODEC).option("path", path).saveAsTable(name)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)
    if _PASSING:
        _PASSING[-1].append((path, name))
    return spark.table(name)


#: Salts of a hot key for each equal share of a task it holds: so many that chance deals tasks alike.
SALTS = 8


#: Groups of keys by hash in which hot keys are looked for.
GROUPS = 1 << 16


def hot_keys(df: DataFrame, keys: list[str], share: int) -> DataFrame:
    """(keys, _salts) of the keys with more than `share` rows. Rows are counted by groups of keys first: a group has few partial counts whatever
    the number of keys, and only the keys of groups that hold enough rows are counted themselves. `df` is read twice."""
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int")
    with Passing(df.sparkSession) as here:
        heavy = cut(df.groupBy(group.alias("_group")).count().filter(F.col("count") > share).select("_group"))
        some = df.select(*keys).withColumn("_group", group).join(F.broadcast(heavy), "_group", "left_semi")
        if heavy.isEmpty():
            some = some.limit(0)
        counted = some.groupBy(*keys).count().filter(F.col("count") > share)
        return here.kept(counted.select(*keys, F.ceil(F.col("count") * SALTS / share).cast("int").alias("_salts")))


class Dealt:
    """The side of a loop's join that does not change, moved once: `join` brings only the other side to it.

    Rows of a key that holds more than an equal share of a task are spread over as many tasks as that takes, by a salt; the
    other side's rows of such a key, and of no other, go to each of them. More keys than tasks cannot be that hot, which
    bounds what is broadcast.

    `among` is a stored table that holds the rows of `df`, perhaps among others, under the same keys: hot keys are then looked for in it,
    and `df` is written once, without being moved where it is dealt by the keys already.
    """

    def __init__(self, df: DataFrame, *keys: str, least: int = 100_000, among: DataFrame | None = None) -> None:
        self.keys = list(keys)
        with Passing(df.sparkSession) as here:
            if among is None:
                among = df = cut(df)
            parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            share = max(least, among.count() // parts + 1)
            with here.outside():
                self.hot = hot_keys(among, list(keys), share)
            if self.hot.isEmpty():
                self.hot = None
                self.table = here.kept(df, *keys)
            else:
                salted = df.join(F.broadcast(self.hot), self.keys, "left")
                salt = F.pmod(F.xxhash64(*df.columns), F.coalesce("_salts", F.lit(1))).cast("int")
                self.table = here.kept(salted.withColumn("_salt", salt).drop("_salts"), *keys, "_salt")

    def rows(self) -> DataFrame:
        """The rows as they were given."""
        return self.table if self.hot is None else self.table.drop("_salt")

    def join(self, other: DataFrame) -> DataFrame:
        """The inner join of `other` with the table on the keys."""
        if self.hot is None:
            return other.join(self.table, self.keys)
        last = F.coalesce("_salts", F.lit(1)) - 1
        spread = other.join(F.broadcast(self.hot), self.keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_salts")
        return spread.join(self.table, [*self.keys, "_salt"]).drop("_salt")


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", least: int = 100_000) -> DataFrame:
    """The inner or left join of `big` with `small` where keys may be hot in `big`: the rows of a key that holds more than an equal share of a task
    are spread, and only such keys' rows of `small` are repeated. Null keys meet nothing."""
    big = cut(big)
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(least, big.count() // parts + 1)
    hot = hot_keys(big, keys, share)
    if hot.isEmpty():
        return big.join(small, keys, how)
    dealt = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.floor(F.rand(7) * F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    spread = small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")


def moved(df: DataFrame) -> DataFrame:
    """`df` for a join that moves both sides by key. For rows that `explode` or `repeat` makes many or wide: Spark sizes them as what they are
    made from, and would send them whole through the driver."""
    return df.hint("merge")


def keyed(key: Column) -> Column:
    """A text key for the left side of a left join, where null meets nothing: rows without a key get one that no
    table holds, each its own, so that they do not gather in one task."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string")))


def _sliced(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """`df` range-partitioned over (group, order), with the number of the slice."""
    spread = df.repartitionByRange(*[F.col(c) for c in group], *order)
    return cut(spread.withColumn("_slice", F.spark_partition_id()))


def running_last(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last non-null `value` before each row of its group, in `order` (column names,
    ascending), for groups of any size: a local answer per slice, else the earlier slices'."""
    sliced = _sliced(df, group, [F.col(c) for c in order])
    ends = sliced.filter(F.col(value).isNotNull()).groupBy(*group, "_slice").agg(
        F.max_by(value, F.struct(*order)).alias("_end")
    )
    every = sliced.select(*group, "_slice").distinct().join(ends, [*group, "_slice"], "left")
    earlier = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = every.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    inside = W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        sliced.withColumn("_here", F.last(value, ignorenulls=True).over(inside))
        .join(carried, [*group, "_slice"])
        .withColumn(out, F.coalesce("_here", "_carried"))
        .drop("_here", "_carried", "_slice")
    )


def running_position(df: DataFrame, group: list[str], order: list, out: str) -> DataFrame:
    """1-based position of each row inside its group, in `order`.

    A plain ``row_number`` puts a whole group into one task. Here the rows are
    range-partitioned over (group, order), so a hot group spreads over many
    tasks; positions are local positions plus the sizes of the earlier slices.
    The slices are materialised first, because both passes must see the same cut.
    """
    sliced = _sliced(df, group, order)
    sizes = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(W.partitionBy(*group, "_slice").orderBy(*order))
    return (
        sliced.withColumn("_local", local)
        .join(offsets, [*group, "_slice"])
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_local", "_before", "_slice")
    )


def placed(
    df: DataFrame, group: list[str], order: list, out: str, limit: int | None = None, least: int = 100_000, stored: bool = False
) -> DataFrame:
    """All rows with their 1-based position in the group, or the first `limit` of each group, which Spark
    picks in every partition before it shuffles. Groups that hold more than an equal share of a task are numbered in
    slices, the others each in its task; rows with a null in the group are in none and are left out. `stored` says that `df` reads
    steps already and need not be written to be read several times."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")
    if limit is not None:
        return df.withColumn(out, place).filter(F.col(out) <= limit)
    df = df.dropna(subset=group) if stored else cut(df.dropna(subset=group))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(df, group, max(least, df.count() // parts + 1)).drop("_salts")
    if hot.isEmpty():
        return df.withColumn(out, place)
    large = F.broadcast(hot)
    sliced = running_position(df.join(large, group, "left_semi"), group, order, out)
    return df.join(large, group, "left_anti").withColumn(out, place).select(*df.columns, out).unionByName(sliced.select(*df.columns, out))
