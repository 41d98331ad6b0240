"""Hard negatives by an inverted multi-index.

Two codebooks, one for each half of the components, put every vector into a cell. Vectors are dealt to blocks in the order
of their cells; a block knows how far its vectors lie from their codewords in either half. A half score's upper bound is the
product with the codeword plus the radius times the length of the query's half, and a heap visits a block's cells by falling sum
of two such bounds (the multi-sequence walk). It stops when no cell that is left can change the answer: for the
positives when the bound is below the last one kept, for a window of scores when the window is certified, that is when it
holds enough better entries or the bound has passed its lower end. So results are exact; the index only saves work.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.common import pick, small_batches
from heddle.session import cut

#: Codewords of each half.
CODES = 16
#: Vectors on which the codebooks are fitted, those with the least hashes, and rounds of the fit.
SAMPLE_ROWS = 4096
ROUNDS = 8
#: Rows of a block, and bytes of its vectors; the same for anchors.
ROW_BLOCK, ROW_BYTES = 16384, 8 << 20
ANCHOR_BLOCK, ANCHOR_BYTES = 256, 1 << 20
LONGEST = 2**63 - 1


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """row (a number), vec_id, label and v, the components times `scale` rounded down, of the rows that take part."""
    rows = pick(vectors, "vec_id", "label", "embedding").filter("vec_id is not null and label is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)).cast("double"))
    return rows.filter(finite).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))


def _lloyd(points: np.ndarray, codes: int) -> np.ndarray:
    """Codewords of the points: farthest points first, then rounds of means."""
    words = points[:1]
    far = ((points - words[0]) ** 2).sum(1)
    while len(words) < codes and far.max(initial=0) > 0:
        words = np.vstack([words, points[far.argmax()]])
        far = np.minimum(far, ((points - words[-1]) ** 2).sum(1))
    for _ in range(ROUNDS):
        own = _nearest(points, words)
        words = np.array([points[own == i].mean(0) if (own == i).any() else words[i] for i in range(len(words))])
    return words


def _nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1)[None, :] - 2 * points @ words.T).argmin(1)


class Codebooks:
    """The codewords of both halves for vectors of one length; vectors of other lengths have one codeword, the origin."""

    def __init__(self, sample: np.ndarray) -> None:
        self.length = sample.shape[1]
        self.halves = [_lloyd(part, CODES) for part in np.split(sample, [self.length // 2], axis=1)]

    def words(self, length: int) -> list[np.ndarray]:
        return self.halves if length == self.length else [np.zeros((1, length // 2)), np.zeros((1, length - length // 2))]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = (_nearest(part, words) for part, words in zip(np.split(vectors, [vectors.shape[1] // 2], axis=1), self.words(vectors.shape[1]), strict=True))
        return a * CODES + b


def codebooks(own: DataFrame) -> Codebooks | None:
    """Fitted on SAMPLE_ROWS vectors of the commonest length; None without vectors."""
    lengths = own.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    if not lengths:
        return None
    sample = own.filter(F.size("v") == lengths[0].length).orderBy(F.xxhash64("v"), "row").limit(SAMPLE_ROWS).select("v").toArrow()
    return Codebooks(np.array(sample["v"].to_pylist(), dtype=float))


def blocks(own: DataFrame, books: Codebooks) -> DataFrame:
    """The vectors in blocks of one length, in the order of their cells. A record holds numbers as bytes: row, vec_id, label, cell and
    vector of its rows."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            at = at - at[0]
            lengths = np.diff(at)
            cell = np.zeros(len(lengths), np.int32)
            for n in np.unique(lengths):
                some = np.flatnonzero(lengths == n)
                cell[some] = books.cells(flat[at[some][:, None] + np.arange(n)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), pa.array(cell)], ["row", "vec_id", "label", "v", "length", "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        made = 0
        for batch in batches:
            columns = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("row", "vec_id", "label", "cell", "length", "part")]
            flat, at = batch.column("v").flatten().to_numpy(zero_copy_only=False), batch.column("v").offsets.to_numpy(zero_copy_only=False)
            at = at - at[0]
            for i, key in enumerate(zip(*columns, strict=True)):
                if held and (held[0][0][4] != key[4] or len(held) >= min(ROW_BLOCK, max(1, ROW_BYTES // (8 * int(key[4]))))):
                    yield record(held, made)
                    held, made = [], made + 1
                held.append((key, flat[at[i] : at[i + 1]]))
        if held:
            yield record(held, made)

    def record(rows: list[tuple], made: int) -> pa.RecordBatch:
        key = np.array([r[0][:4] for r in rows], np.int64)
        fields = {"block": pa.array([(int(rows[0][0][5]) << 32) + made], pa.int64()), "length": pa.array([int(rows[0][0][4])], pa.int32())}
        fields |= {name: [np.ascontiguousarray(key[:, i]).tobytes()] for i, name in enumerate(("rows", "ids", "labels", "cells"))}
        return pa.RecordBatch.from_pydict(fields | {"vectors": [np.array([r[1] for r in rows]).tobytes()]})

    placed = cut(own.mapInArrow(place, "row bigint, vec_id bigint, label bigint, v array<double>, length int, cell int"))
    order = ["length", "cell", "row"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return dealt.mapInArrow(pack, "block bigint, length int, rows binary, ids binary, labels binary, cells binary, vectors binary")


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; it raises where one passes 64 bits."""
    if np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * len(query) < 2**53:
        return (vectors @ query).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    found = whole(vectors) @ whole(query)
    if max(abs(x) for x in found) > LONGEST:
        raise OverflowError("a score does not fit into 64 bits; use a smaller scale")
    return found.astype(np.int64)


class Block:
    """A block's vectors with the walk over its cells."""

    def __init__(self, record: dict, books: Codebooks) -> None:
        self.rows, self.ids, self.labels, cells = (np.frombuffer(record[x], np.int64) for x in ("rows", "ids", "labels", "cells"))
        self.vectors = np.frombuffer(record["vectors"]).reshape(len(self.ids), -1)
        begin = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        self.at = {int(c): slice(a, b) for c, a, b in zip(cells[begin], begin, np.r_[begin[1:], len(cells)], strict=True)}
        self.half = self.vectors.shape[1] // 2
        self.sides = []  # of each half: the codes that occur here, their words, the radii
        for part, words, code in zip(np.split(self.vectors, [self.half], axis=1), books.words(self.vectors.shape[1]), (cells // CODES, cells % CODES), strict=True):
            far = np.zeros(len(words))
            np.maximum.at(far, code, np.sqrt(((part - words[code]) ** 2).sum(1)))
            here = np.unique(code)
            self.sides.append((here, words[here], far[here]))
        self.longest = np.sqrt((self.vectors**2).sum(1).max(initial=0))

    def walk(self, query: np.ndarray) -> Iterator[tuple[float, slice]]:
        """The cells with a bound of their scores, from the greatest bound down."""
        bounds, orders = [], []
        for part, (_, words, far) in zip((query[: self.half], query[self.half :]), self.sides, strict=True):
            bound = words @ part + far * np.sqrt((part**2).sum())
            orders.append(np.argsort(-bound))
            bounds.append(bound[orders[-1]].tolist())
        codes = [here[order].tolist() for (here, _, _), order in zip(self.sides, orders, strict=True)]
        slack = 1e-9 * self.longest * np.sqrt((query**2).sum()) + 1e-6  # rounding never hides an entry
        heap = [(-bounds[0][0] - bounds[1][0], 0, 0)]
        while heap:
            low, i, j = heapq.heappop(heap)
            if j == 0 and i + 1 < len(bounds[0]):
                heapq.heappush(heap, (-bounds[0][i + 1] - bounds[1][0], i + 1, 0))
            if j + 1 < len(bounds[1]):
                heapq.heappush(heap, (-bounds[0][i] - bounds[1][j + 1], i, j + 1))
            at = self.at.get(codes[0][i] * CODES + codes[1][j])
            if at is not None:
                yield slack - low, at


class Best:
    """The `most` highest scores seen at or above a floor, ties by id."""

    def __init__(self, most: int, floor: int) -> None:
        self.most, self.need = most, floor
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores >= self.need
        if some.any():
            scores, ids = np.r_[self.scores, scores[some]], np.r_[self.ids, ids[some]]
            order = np.lexsort((ids, -scores))[: self.most]
            self.scores, self.ids = scores[order], ids[order]
            if len(order) == self.most:
                self.need = max(self.need, int(self.scores[-1]))


def _best_of_label(block: Block, query: np.ndarray, row: int, label: int, most: int, floor: int) -> Best:
    best = Best(most, floor)
    for bound, at in block.walk(query):
        if bound < best.need:
            break
        some = np.flatnonzero((block.labels[at] == label) & (block.rows[at] != row)) + at.start
        if len(some):
            best.add(exact_scores(block.vectors[some], query), block.ids[some])
    return best


def _best_in_windows(block: Block, query: np.ndarray, label: int, windows: list[tuple[int, int]], most: int) -> list[Best]:
    found = [Best(most, low) for low, _ in windows]
    for bound, at in block.walk(query):
        if bound < min(best.need for best in found):  # every window is certified
            break
        some = np.flatnonzero(block.labels[at] != label) + at.start
        if len(some):
            scores = exact_scores(block.vectors[some], query)
            for best, (_, high) in zip(found, windows, strict=True):
                under = scores <= high
                best.add(scores[under], block.ids[some][under])
    return found


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _anchors(rows: DataFrame, books: Codebooks, every: int, most: int) -> DataFrame:
    """The anchors, with a floor for the scores of their positives: the last of the best in their own block, if it holds enough."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in _records(batches):
            block = Block(record, books)
            for i in np.flatnonzero(block.ids % every == 0):
                best = _best_of_label(block, block.vectors[i], block.rows[i], block.labels[i], most, -LONGEST)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": block.rows[i : i + 1],
                        "vec_id": block.ids[i : i + 1],
                        "label": block.labels[i : i + 1],
                        "length": pa.array([block.vectors.shape[1]], pa.int32()),
                        "vector": [block.vectors[i].tobytes()],
                        "floor": pa.array([best.need], pa.int64()),
                    }
                )

    return rows.mapInArrow(find, "row bigint, vec_id bigint, label bigint, length int, vector binary, floor bigint")


def _anchor_blocks(anchors: DataFrame, more: str) -> DataFrame:
    """Anchors(row, label, length, vector, `more`) in records of one length: a_rows, a_labels, a_vectors, a_more."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for one in _records(batches):
            if held and (held[0]["length"] != one["length"] or len(held) >= min(ANCHOR_BLOCK, max(1, ANCHOR_BYTES // (8 * one["length"])))):
                yield record(held)
                held = []
            held.append(one)
        if held:
            yield record(held)

    def record(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "length": pa.array([rows[0]["length"]], pa.int32()),
                "a_rows": pa.array([[r["row"] for r in rows]], pa.list_(pa.int64())),
                "a_labels": pa.array([[r["label"] for r in rows]], pa.list_(pa.int64())),
                "a_vectors": pa.array([[r["vector"] for r in rows]], pa.list_(pa.binary())),
                "a_more": pa.array([[r["more"] for r in rows]], pa.list_(pa.list_(pa.int64()))),
            }
        )

    plain = anchors.select("row", "label", "length", "vector", F.col(more).alias("more")).sortWithinPartitions("length")
    return plain.mapInArrow(pack, "length int, a_rows array<bigint>, a_labels array<bigint>, a_vectors array<binary>, a_more array<array<bigint>>")


def _met(rows: DataFrame, anchors: DataFrame, parts: int) -> DataFrame:
    """Every block of rows beside every block of anchors of its length. Blocks of rows are dealt to `parts` numbers and move once; the
    blocks of anchors, a hundredth of the rows, go to each number."""
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(parts)))
    spread = anchors.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return dealt.join(spread, ["length", "deal"])


def _walked(met: DataFrame, books: Codebooks, most: int, least: int, highest: int, windows: bool) -> DataFrame:
    """row, positive_score, vec_id, score: of each anchor and block the best of its label (positive_score null), or the best in each window."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for record in _records(batches):
            if record["block"] != last:
                last, block = record["block"], Block(record, books)
            out: list[tuple] = []
            for row, label, vector, more in zip(record["a_rows"], record["a_labels"], record["a_vectors"], record["a_more"], strict=True):
                query = np.frombuffer(vector)
                if windows:
                    bests = _best_in_windows(block, query, label, [(-(-least * p // 100), highest * p // 100) for p in more], most)
                else:
                    bests, more = [_best_of_label(block, query, row, label, most, more[0])], [None]
                out += [(row, p, v, s) for p, best in zip(more, bests, strict=True) for v, s in zip(best.ids.tolist(), best.scores.tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["row", "positive_score", "vec_id", "score"])

    return met.mapInArrow(find, "row bigint, positive_score bigint, vec_id bigint, score bigint")


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = 256) -> DataFrame:
    """The hard negatives of vectors(vec_id, label, embedding): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id `every` divides. An anchor's positives are the first `positives` other rows of its label; for each, the
    first `negatives` rows of other labels whose score is between `least` and `most` per cent of the positive's are returned, ranked
    from 1. Scores are inner products of `quantised` vectors, exact; higher ones come first, ties by the smaller id. Fewer
    rows give what there is; a positive with a negative score has an empty window. Only vectors of one length meet.

    Rows with a null id, label or vector, an empty vector, or a component that is null or not finite take no part. Rows of one id are
    rows of their own, also as anchors. An empty table gives no rows. A score beyond 64 bits raises OverflowError. Other columns
    are not read.

    Anchors meet all rows, block by block: a task holds one block of rows and one of anchors, both bounded in bytes. Equal
    vectors, however many, are split over blocks by row number. Only the best few of a block and anchor leave a task.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    own = cut(quantised(vectors, scale))
    books = codebooks(own)
    if books is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = cut(blocks(own, books))
    parts = max(1, rows.count())
    anchors = cut(_anchors(rows, books, every, positives).withColumn("floor", F.array("floor")))
    first = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    own_label = _walked(_met(rows, cut(_anchor_blocks(anchors, "floor")), parts), books, positives, least, most, windows=False)
    kept = cut(own_label.withColumn("place", first("row")).filter(F.col("place") <= positives).select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    scores = kept.groupBy("row").agg(F.collect_set("positive_score").alias("scores"))  # at most `positives` of them
    asked = cut(_anchor_blocks(anchors.join(scores, "row"), "scores"))
    other = _walked(_met(rows, asked, parts), books, negatives, least, most, windows=True)
    found = other.withColumn("rank", first("row", "positive_score")).filter(F.col("rank") <= negatives)
    named = kept.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.join(found, ["row", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


ORACLE = """
WITH whole AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
 scored AS (SELECT a.r, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
            FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND a.r <> c.r AND len(a.v) = len(c.v)),
 pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, c) AS k FROM scored WHERE same) x WHERE k <= 5),
 neg AS (SELECT p.r, p.anchor_id, p.c, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
                CAST(row_number() OVER (PARTITION BY p.r, p.c ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
         FROM pos p JOIN scored n ON n.r = p.r AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""
