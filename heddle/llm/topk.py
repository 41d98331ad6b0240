"""Exact top-k search by a three-phase uniform threshold.

A vector's inner product with a query is the sum of local scores, one for each slice of the components; a slice of a block of
vectors is a holder. Phase one gathers the best local scores of every holder and scores the vectors named there in full: their
k-th best score is a safe cutoff. Phase two gives the holders the cutoff and collects every entry that can still
matter: a vector that reaches the cutoff has an equal share of it in one slice at least. What is known of an entry bounds
its score from above. Phase three asks the holders for the missing local scores of those whose bound reaches the cutoff.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.common import pick
from heddle.session import cut, moved

SLICES = 2
#: Entries that a holder names for a query in phase one, as a multiple of k.
NAMED = 4
#: Queries and vectors of a block.
QUERY_BLOCK = 256
ROW_BLOCK = 4096
#: Numbers that holders are dealt to, as a multiple of the tasks that run at a time.
DEALS = 4
LONGEST = 2**63 - 1


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """row (a number, in the order of vec_id), vec_id and v, the components times `scale` rounded down. Left out are vectors that are null,
    empty, or hold a component that is null or not finite, and rows without an id."""
    rows = pick(vectors, "vec_id", "embedding").filter("vec_id is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)).cast("double"))
    made = rows.filter(finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).withColumn("_h", F.xxhash64("v"))
    ranged = made.repartitionByRange("vec_id", "_h").sortWithinPartitions("vec_id", "_h")
    return ranged.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def _whole_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers, exact; it raises where a number passes 62 bits, so that two slices still fit into 63."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[-1] < 2**53:
        return (a @ b).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    found = whole(a) @ whole(b)
    if max((abs(x) for x in np.ravel(found)), default=0) >= 2**62:
        raise OverflowError("a score does not fit into 62 bits; use a smaller scale")
    return np.asarray(found).astype(np.int64)


def blocks(vectors: DataFrame, size: int, cutoffs: bool = False) -> DataFrame:
    """The vectors in blocks of at most `size` of one length, a record for each slice of a block: block, slice, slices,
    length, ids, rows (numbers as bytes), and with `cutoffs` those of the ids."""
    names = ["vec_id", "v", *(["cutoff"] if cutoffs else [])]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        made = 0

        def record(length: int, rows: list[tuple]) -> pa.RecordBatch:
            edges = _edges(length)
            matrix = np.array([r[2] for r in rows])
            n = len(edges) - 1
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([(rows[0][0] << 32) + made] * n, pa.int64()),
                    "slice": pa.array(range(n), pa.int32()),
                    "slices": pa.array([n] * n, pa.int32()),
                    "length": pa.array([length] * n, pa.int32()),
                    "ids": [np.array([r[1] for r in rows], np.int64).tobytes()] * n,
                    "rows": [np.ascontiguousarray(matrix[:, a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)],
                    "cutoffs": [np.array([-LONGEST if r[3] is None else r[3] for r in rows], np.int64).tobytes()] * n,
                }
            )

        for batch in batches:
            part = batch.column("part").to_pylist()
            lists = batch.column("v")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
            at = at - at[0]
            cutoff = batch.column("cutoff").to_pylist() if cutoffs else [None] * batch.num_rows
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                v = flat[at[i] : at[i + 1]]
                rows = held.setdefault(len(v), [])
                rows.append((part[i], vec_id, v, cutoff[i]))
                if len(rows) == size:
                    yield record(len(v), held.pop(len(v)))
                    made += 1
        for length, rows in held.items():
            yield record(length, rows)
            made += 1

    schema = "block bigint, slice int, slices int, length int, ids binary, rows binary, cutoffs binary"
    return vectors.select(*names).withColumn("part", F.spark_partition_id()).mapInArrow(pack, schema)


def _edges(length: int) -> np.ndarray:
    return np.linspace(0, length, min(SLICES, length) + 1).astype(int)


def pairs(queries: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """Every holder of rows beside the same slice of every block of queries. Holders are dealt to `parts` numbers, and the
    query blocks, the smaller side, go to each; they are moved there, not sent as many times through the driver."""
    r = rows.select("slice", "length", "slices", F.col("block").alias("row_block"), F.col("ids").alias("row_ids"), F.col("rows").alias("row_rows"))
    r = r.withColumn("deal", F.pmod(F.xxhash64("row_block"), F.lit(parts)))
    q = queries.select("slice", "length", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("rows").alias("query_rows"), "cutoffs")
    q = q.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return r.join(moved(q), ["slice", "length", "deal"]).drop("deal")


class _Pair:
    """A record of `pairs`: ids, cutoffs, and the local scores of all its queries and rows, exact."""

    def __init__(self, record: dict) -> None:
        self.record = record
        self.queries = np.frombuffer(record["query_ids"], np.int64)
        self.rows = np.frombuffer(record["row_ids"], np.int64)
        self.cutoffs = np.frombuffer(record["cutoffs"], np.int64)
        q = np.frombuffer(record["query_rows"]).reshape(len(self.queries), -1)
        r = np.frombuffer(record["row_rows"]).reshape(len(self.rows), -1)
        self.scores = _whole_product(q, r.T)
        self.own = self.queries[:, None] == self.rows[None, :]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[_Pair]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Pair(batch.slice(i, 1).to_pylist()[0])


def _named(met: DataFrame, most: int) -> DataFrame:
    """Phase one: for each query and holder the best entries: query_id, slice, vec_id, local score."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _each(batches):
            scores = np.where(pair.own, -LONGEST, pair.scores)
            n = min(most, scores.shape[1])
            at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            query = np.repeat(np.arange(len(pair.queries)), n)
            keep = ~pair.own[query, at.ravel()]
            query, at = query[keep], at.ravel()[keep]
            yield pa.RecordBatch.from_pydict(
                {"query_id": pair.queries[query], "slice": pa.array(np.full(len(at), pair.record["slice"]), pa.int32()), "vec_id": pair.rows[at], "local": scores[query, at]}
            )

    found = met.mapInArrow(name, "query_id bigint, slice int, vec_id bigint, local bigint")
    best = W.partitionBy("query_id", "slice").orderBy(F.desc("local"), "vec_id")
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most).drop("place")


def _cutoffs(named: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id and cutoff: the k-th best full score of the vectors named for a query; null if fewer were named."""
    wanted = named.select("query_id", "vec_id").distinct()
    full = wanted.join(vectors, "vec_id").join(vectors.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").filter(F.size("q") == F.size("v"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs_ = zip(batch.column("q").to_pylist(), batch.column("v").to_pylist(), strict=True)
            found = [int(_whole_product(np.array([q]), np.array(v))[0]) for q, v in pairs_]
            yield pa.RecordBatch.from_pydict({"query_id": batch.column("query_id"), "score": pa.array(found, pa.int64())})

    scored = full.select("query_id", "q", "v").mapInArrow(score, "query_id bigint, score bigint")
    best = W.partitionBy("query_id").orderBy(F.desc("score"))
    return scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") == k).select("query_id", F.col("score").alias("cutoff"))


def _entries(met: DataFrame) -> DataFrame:
    """Phase two: for each holder and query block the entries that reach a share of the cutoff: their places as one number, and
    their local scores."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _each(batches):
            share = -(-pair.cutoffs // pair.record["slices"])  # a local score below has less than an equal share
            hit = np.flatnonzero((pair.scores >= share[:, None]) & ~pair.own)
            yield pa.RecordBatch.from_pydict(
                {
                    "row_block": pa.array([pair.record["row_block"]], pa.int64()),
                    "query_block": pa.array([pair.record["query_block"]], pa.int64()),
                    "slice": pa.array([pair.record["slice"]], pa.int32()),
                    "slices": pa.array([pair.record["slices"]], pa.int32()),
                    "n_rows": pa.array([len(pair.rows)], pa.int64()),
                    "cutoffs": [pair.record["cutoffs"]],
                    "places": [hit.tobytes()],
                    "locals": [pair.scores.ravel()[hit].tobytes()],
                }
            )

    return met.mapInArrow(collect, "row_block bigint, query_block bigint, slice int, slices int, n_rows bigint, cutoffs binary, places binary, locals binary")


def _wanted(entries: DataFrame) -> DataFrame:
    """Phase two, second half: of the entries of a pair of blocks those whose upper bound reaches the cutoff."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.to_pylist():
                lists = [np.frombuffer(x["places"], np.int64) for x in record["lists"]]
                scores = [np.frombuffer(x["locals"], np.int64) for x in record["lists"]]
                places, back = np.unique(np.concatenate(lists), return_inverse=True)
                known, seen = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
                np.add.at(known, back, np.concatenate(scores))
                np.add.at(seen, back, 1)
                cutoff = np.frombuffer(record["cutoffs"], np.int64)[places // record["n_rows"]]
                below = -(-cutoff // record["slices"]) - 1  # the most that a slice that did not name it can have
                places = places[known + (record["slices"] - seen) * below >= cutoff]
                yield pa.RecordBatch.from_pydict(
                    {"row_block": pa.array([record["row_block"]], pa.int64()), "query_block": pa.array([record["query_block"]], pa.int64()), "places": [places.tobytes()]}
                )

    # at most SLICES records meet in a group
    grouped = entries.groupBy("row_block", "query_block").agg(
        F.first("slices").alias("slices"), F.first("n_rows").alias("n_rows"), F.first("cutoffs").alias("cutoffs"), F.collect_list(F.struct("places", "locals")).alias("lists")
    )
    return grouped.mapInArrow(bound, "row_block bigint, query_block bigint, places binary").filter(F.octet_length("places") > 0)


def _resolved(met: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Phase three: the holders' local scores of the wanted entries, added up; the k best of each query."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                record = batch.slice(i, 1).to_pylist()[0]
                pair = _Pair(record)
                places = np.frombuffer(record["places"], np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row_block": pa.array([record["row_block"]], pa.int64()),
                        "query_block": pa.array([record["query_block"]], pa.int64()),
                        "query_ids": [pair.queries[places // len(pair.rows)].tobytes()],
                        "row_ids": [pair.rows[places % len(pair.rows)].tobytes()],
                        "locals": [pair.scores.ravel()[places].tobytes()],
                    }
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.to_pylist():
                total = sum(np.frombuffer(x, np.int64) for x in record["locals"])
                query, row = np.frombuffer(record["query_ids"], np.int64), np.frombuffer(record["row_ids"], np.int64)
                order = np.lexsort((row, -total, query))
                first = np.concatenate([[True], query[order][1:] != query[order][:-1]])
                place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
                order = order[place < k]
                yield pa.RecordBatch.from_pydict({"query_id": query[order], "vec_id": row[order], "score": total[order]})

    asked = met.join(wanted, ["row_block", "query_block"]).mapInArrow(ask, "row_block bigint, query_block bigint, query_ids binary, row_ids binary, locals binary")
    # at most SLICES records meet in a group; places are the same in each
    summed = asked.groupBy("row_block", "query_block").agg(F.first("query_ids").alias("query_ids"), F.first("row_ids").alias("row_ids"), F.collect_list("locals").alias("locals"))
    scored = summed.mapInArrow(add, "query_id bigint, vec_id bigint, score bigint")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The k best inner products of each query among vectors(vec_id, embedding): query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id `every` divides; candidates are all rows of the query's length but its own, also those of its id. Scores
    are those of `quantised` vectors, exact; one beyond 62 bits raises OverflowError. Ties go to the smaller id. A query with
    fewer candidates gets them all. Without queries or candidates there are no rows. Results do not depend on blocks or slices.

    Work is queries times vectors, in blocks. A task holds one pair of blocks; the best of many blocks meet by windows that
    Spark limits before the shuffle. The quantised vectors and their blocks are written once.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    found = cut(quantised(vectors, scale))
    ids = found.select("row", "vec_id")
    # from here on a vector goes by its row, which orders as the ids do
    own = found.select(F.col("row").alias("vec_id"), "v")
    rows = cut(blocks(own, ROW_BLOCK))
    queries = found.filter(F.col("vec_id") % every == 0).select(F.col("row").alias("vec_id"), "v")
    # a copy of the queries for each number: as many as keep all tasks busy, not as many as there are blocks
    parts = max(1, min(rows.select("block").distinct().count(), DEALS * spark.sparkContext.defaultParallelism))
    named = _named(pairs(cut(blocks(queries.coalesce(_few(queries)), QUERY_BLOCK)), rows, parts), NAMED * k)
    cutoffs = _cutoffs(cut(named), own, k)
    with_cutoffs = queries.join(cutoffs.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    asked = cut(blocks(with_cutoffs.coalesce(_few(queries)), QUERY_BLOCK, cutoffs=True))
    met = pairs(asked, rows, parts)
    wanted = cut(_wanted(_entries(met)))
    best = _resolved(met, wanted, k).withColumnRenamed("vec_id", "row")
    named = best.join(ids, "row").drop("row").withColumnRenamed("query_id", "row")
    return named.join(ids.withColumnRenamed("vec_id", "query_id"), "row").select("query_id", "rank", "vec_id", "score")


def _few(queries: DataFrame) -> int:
    """Tasks that make query blocks, so that blocks are well filled."""
    return max(1, queries.count() // (4 * QUERY_BLOCK))
