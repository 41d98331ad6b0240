"""What the operators share: picking columns, sizing partitions, Arrow batches, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.session import FACTOR

#: Text handed to one vectorised step, in bytes; a single longer text is a step of its own.
STEP_BYTES = 4 << 20
#: Input bytes (as the planner estimates them, compressed) that one partition of packed records is made for.
PART_BYTES = 8 << 20
#: What the planner says of rows that come from no file is beyond this.
UNKNOWN_BYTES = 1 << 56
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone. Other columns may be called anything, also the same but for case:
    the exact name counts, the first of several equal ones."""
    where = [df.columns.index(name) for name in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(name) for i, name in zip(where, names, strict=True)])


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size of `df`: for files, their size, whatever factor it goes by; 0 where it does not know any."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = int(size / float(df.sparkSession.conf.get(FACTOR)))
    return size if size < UNKNOWN_BYTES else 0


def part_count(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Partitions for records derived from `df`: in proportion to its size, at least the session's number."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, estimated_bytes(df) // part_bytes + 1))


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches follow bytes, not rows, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(STEP_BYTES))


def steps(batches: Iterable[pa.RecordBatch], column: str | None = "text", limit: int = STEP_BYTES) -> Iterator[pa.Table]:
    """Batches put together or cut so that each table holds about `limit` bytes of `column`."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for end in _cuts(lengths, size, limit):
            held.append(batch.slice(begin, end - begin))
            yield pa.Table.from_batches(held).combine_chunks()
            held, size, begin = [], 0, end
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
            size += int(lengths[begin:].sum())
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cuts(lengths: np.ndarray, size: int, limit: int) -> Iterator[int]:
    for i, n in enumerate(lengths):
        size += int(n)
        if size >= limit:
            yield i + 1
            size = 0


def column(table: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    found = table.column(name)
    return found.chunk(0) if found.num_chunks == 1 else pa.concat_arrays(found.chunks) if found.num_chunks else pa.array([], found.type)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end (a null is empty), and where each begins; one more for the end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def byte_table(separators: Iterable[int], lower: bool = False) -> np.ndarray:
    """What becomes of each byte: a separator turns into a space; A-Z into a-z if `lower`."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 32
    return table


#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = byte_table([32, *range(9, 14)])


class Words:
    """The words of a run of texts: `code` numbers each word's spelling, `spelling` lists the spellings,
    `first[i]` is where the words of text i begin in `code` (one more for the end)."""

    def __init__(self, texts: pa.Array, table: np.ndarray = WHITE) -> None:
        raw, at = bytes_of(texts)
        clean = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(table[raw]))
        split = pc.split_pattern(clean, " ")
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        spelling = coded.dictionary
        ends = split.offsets.to_numpy(zero_copy_only=False)
        ends = ends - ends[0]
        blank = pc.index(spelling, pa.scalar("", spelling.type)).as_py() if len(spelling) else -1
        full = code != blank
        self.first = np.concatenate([[0], np.cumsum(full)])[ends].astype(np.int64)
        self.code = code[full].astype(np.int64)
        self.spelling = spelling

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every task."""
        return string_hashes(self.spelling)[self.code] if len(self.code) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * MULTIPLIER
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_BYTE = np.random.default_rng(20240517).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD1342543DE82EF95)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings: random numbers for their bytes, summed with the powers of an odd number."""
    raw, at = bytes_of(strings)
    if not len(at) - 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(at) - 1, np.uint64)
    inverse = np.uint64(pow(int(_STEP), -1, 2**64))
    begin = 0
    while begin < len(out):  # pieces of bounded size
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + STEP_BYTES, "right")) - 1)
        part, where = raw[at[begin] : at[end]], at[begin : end + 1] - at[begin]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[part] * _powers(_STEP, len(part))[: len(part)], dtype=np.uint64)])
        out[begin:end] = (sums[where[1:]] - sums[where[:-1]]) * _powers(inverse, len(part))[where[:-1]]
        begin = end
    lengths = np.diff(at).astype(np.uint64)
    return mix(out + lengths * MULTIPLIER)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, for each place where they begin (also across texts)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = out * _STEP + hashes[i : i + size]
    return mix(out)


def spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places first[i], first[i] + 1, ..., lengths[i] of them, for every i in turn."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
    out += np.arange(total)
    return out
