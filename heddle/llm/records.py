"""Token ids as length-delimited binary records, with a separate offset index.

A record is: length of the body (8 bytes, little-endian), masked checksum of those 8 bytes (4), the body, masked checksum
of the body (4). A body is: 1 byte that tells whether the id is there, the document's id (8), bytes an id takes (1), number of
ids (8), the ids. Checksums are CRC-32, masked by a rotation and an added constant so that a checksum of bytes that hold
checksums stays useful.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.common import column, pick, small_batches, spans, steps
from heddle.session import cut, ensure_checkpoint_dir

# Fixed values of the format.
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<?qBQ")
FOOT = struct.Struct("<I")

#: Spellings whose ids a worker keeps; beyond that it starts anew.
KEPT_WORDS = 500_000
#: Letters whose lower case and composition do not depend on what stands beside them.
LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Spellings encoded in one call as one text, parted by blanks.
CALL_WORDS = 500
#: Bytes that one read of a file takes, unless a single record is longer.
READ_BYTES = 4 << 20


class DamagedRecord(ValueError):
    """A length or a body does not fit its checksum, or a file ends inside a record."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    body = BODY.pack(doc_id is not None, doc_id or 0, width, len(ids)) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(body))
    return length + FOOT.pack(masked(length)) + body + FOOT.pack(masked(body))


def unframe(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """Document id, ids (as 32-bit numbers) and the place behind the record at `at`."""
    if len(data) < at + HEAD.size:
        raise DamagedRecord(f"a record's head is cut off at byte {at}")
    length, crc = HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != crc:
        raise DamagedRecord(f"the length at byte {at} does not fit its checksum")
    begin, end = at + HEAD.size, at + HEAD.size + length
    if len(data) < end + FOOT.size:
        raise DamagedRecord(f"the record at byte {at} is cut off")
    if masked(data[begin:end]) != FOOT.unpack_from(data, end)[0]:
        raise DamagedRecord(f"the body at byte {begin} does not fit its checksum")
    there, doc_id, width, n = BODY.unpack_from(data, begin)
    ids = np.frombuffer(data[begin + BODY.size : end], f"<u{width}", n).astype("<u4")
    return doc_id if there else None, ids, end + FOOT.size


class Tokens:
    """The library's tokenizer over runs of texts. Blanks and line feeds end a word for it, so that texts are cut there and a
    spelling goes through the library once. Spellings that surely are one word of Latin letters, or that and one closing
    sign, share the ids of the lower-case word (the library lowers case itself); many such words go through in one call
    and are told apart by the ids that end words. All other spellings go through singly."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            self.suffix = json.load(file)["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        if self.suffix:
            self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith(self.suffix)]] = True
        #: Signs that are a word of one id. No sign has id 0 here.
        ids = {c: self.library.encode(c, add_special_tokens=False).ids for c in ".,;:!?|"}
        ids = {c: x[0] for c, x in ids.items() if len(x) == 1 and x[0]}
        self.signs = pa.array(list(ids), pa.large_string())
        self.sign_ids = np.array([*ids.values(), 0], np.uint32)
        self.kept_words = kept_words
        self._forget()

    def _forget(self) -> None:
        #: Spellings met, and of each where its ids are in `store`.
        self.known = pa.array([], pa.large_string())
        self.starts, self.sizes, self.store = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _append(self, words: pa.Array, starts: np.ndarray, sizes: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
        """Places of the added spellings."""
        self.known = pa.concat_arrays([self.known, words])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        self.store = np.concatenate([self.store, *ids])
        return np.arange(len(self.known) - len(words), len(self.known))

    def _slots(self, words: pa.Array) -> np.ndarray:
        """Place of each spelling among the known ones, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Places of spellings that were not known so far."""
        out = np.zeros(len(words), np.int64)
        sign_at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(words, -1), value_set=self.signs), len(self.signs))
        base = pc.if_else(pc.less(sign_at, len(self.signs)), pc.utf8_slice_codeunits(words, 0, -1), words)
        sure = pc.match_substring_regex(base, LATIN) if self.suffix else pa.array(np.zeros(len(words), bool))
        surely = sure.to_numpy(zero_copy_only=False)
        single = words.filter(pc.invert(sure))
        found = self._library(single.to_pylist())
        sizes = np.array([len(x) for x in found], np.int64)
        out[~surely] = self._append(single, len(self.store) + np.cumsum(sizes) - sizes, sizes, found)

        made, base = words.filter(sure), pc.utf8_lower(base.filter(sure))
        coded = base.dictionary_encode()
        slots = self._slots(coded.dictionary)
        fresh = coded.dictionary.filter(pa.array(slots < 0))
        listed = fresh.to_pylist()
        found = self._library([" ".join(listed[i : i + CALL_WORDS]) for i in range(0, len(listed), CALL_WORDS)])
        edges = np.flatnonzero(self.ends[np.concatenate([*found, np.zeros(0, np.uint32)])]) + 1
        sizes = np.diff(edges, prepend=0).astype(np.int64)
        slots[slots < 0] = self._append(fresh, len(self.store) + edges - sizes, sizes, found)

        of = slots[coded.indices.to_numpy(zero_copy_only=False)]
        other = pc.not_equal(made, base).to_numpy(zero_copy_only=False)
        sign = self.sign_ids[sign_at.filter(sure).to_numpy(zero_copy_only=False)[other]]
        begin, inner = self.starts[of[other]], self.sizes[of[other]]
        sizes = inner + (sign > 0)
        at = np.cumsum(sizes) - sizes
        ids = np.repeat(sign, sizes)
        ids[spans(at, inner)] = self.store[spans(begin, inner)]
        of[other] = self._append(made.filter(pa.array(other)), len(self.store) + at, sizes, [ids])
        out[surely] = of
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with `end_id` behind it, and where each text's begin."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        slots = self._slots(words)
        fresh = slots < 0
        if fresh.any():
            if len(self.known) + fresh.sum() > self.kept_words:
                self._forget()
                fresh[:] = True
            slots[fresh] = self._learn(words.filter(pa.array(fresh)))
        code = slots[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.sizes[code]
        edges = split.offsets.to_numpy(zero_copy_only=False)
        body_at = np.concatenate([[0], np.cumsum(n)])[edges - edges[0]]
        lengths = np.diff(body_at)
        first = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int64)
        ids = self.store[spans(self.starts[code], n)]
        return np.insert(ids, body_at[1:], np.uint32(end_id)), first


@cache
def tokens_at(path: str) -> Tokens:
    return Tokens(path)


def _open(uri: str):
    """File system and path of a URI of the shared folder (Hadoop writes file:/x for file:///x)."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode every row of docs(doc_id, text) and write record files in the order of doc_id; the offset index.

    Index, one row a record: file, part (ascending with doc_id), at and length of the record in bytes, place in the file,
    doc_id, n_tokens. It is itself written as a table, in the shared checkpoint folder like the files (or in `folder`, a URI that
    executors reach through Arrow's file systems). A task writes a file of its own name and the index names the files of
    the tasks that succeeded, so files that a lost executor left behind are never read.

    Order: doc_id (nulls first), then size and checksum of the text, then place in the input; the range
    partitioning uses them all, so that many rows with one id do not meet in one task. A null text is an empty one:
    the end id alone. Ids take 2 bytes where the vocabulary allows it, else 4. An empty table writes no file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/records-{uuid.uuid4().hex}"
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    text = F.coalesce(F.col("text"), F.lit(""))
    order = ["doc_id", "size", "crc", "place"]
    keyed = rows.select("*", F.octet_length(text).alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("place"))
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_at(tokenizer_path)
        width = 2 if max(tokens.size, end_id + 1) <= 1 << 16 else 4
        system, path = _open(folder)
        sink, name, at, place = None, "", 0, 0
        try:
            for table in steps(batches):
                if sink is None:
                    system.create_dir(path, recursive=True)
                    name = f"{table['part'][0].as_py():06d}-{uuid.uuid4().hex}.rec"
                    sink = system.open_output_stream(f"{path}/{name}")
                ids, first = tokens.encode(column(table, "text"), end_id)
                doc_ids = table["doc_id"].to_pylist()
                records = [frame(d, ids[a:b], width) for d, a, b in zip(doc_ids, first[:-1], first[1:], strict=True)]
                sink.write(b"".join(records))
                lengths = np.array([len(r) for r in records], np.int64)
                starts = at + np.concatenate([[0], np.cumsum(lengths)])
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": [name] * len(records),
                        "part": table["part"].combine_chunks(),
                        "at": starts[:-1],
                        "length": lengths,
                        "place": np.arange(place, place + len(records)),
                        "doc_id": pa.array(doc_ids, pa.int64()),
                        "n_tokens": np.diff(first),
                    }
                )
                at, place = int(starts[-1]), place + len(records)
        finally:
            if sink is not None:
                sink.close()

    schema = "file string, part int, at bigint, length bigint, place bigint, doc_id bigint, n_tokens bigint"
    index = cut(placed.mapInArrow(write, schema))
    return index.withColumn("folder", F.lit(folder))


def read_records(index: DataFrame) -> DataFrame:
    """The records that the index rows name, in any order or selection: the index columns file, part and place, and from the
    file doc_id, n_tokens and ids. Rows of one file that follow each other are read in one go. A record that does not fit its
    checksums raises DamagedRecord. Repeated index rows give repeated records; no index rows, no records."""
    wanted = index.select("folder", "file", "part", "place", "at", "length").repartition("file", F.floor(F.col("at") / READ_BYTES)).sortWithinPartitions("file", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            begin = 0
            while begin < batch.num_rows:
                end, last = begin, rows["at"][begin]
                stretch = last
                while end < batch.num_rows and rows["file"][end] == rows["file"][begin] and rows["at"][end] - stretch <= READ_BYTES // 4 and (end == begin or rows["at"][end] + rows["length"][end] - rows["at"][begin] <= READ_BYTES):
                    stretch = rows["at"][end] + rows["length"][end]
                    end += 1
                system, path = _open(rows["folder"][begin])
                with system.open_input_file(f"{path}/{rows['file'][begin]}") as source:
                    data = memoryview(source.read_at(stretch - last, last))
                found = [unframe(data, rows["at"][i] - last) for i in range(begin, end)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": rows["file"][begin:end],
                        "part": pa.array(rows["part"][begin:end], pa.int32()),
                        "place": pa.array(rows["place"][begin:end], pa.int64()),
                        "doc_id": pa.array([x[0] for x in found], pa.int64()),
                        "n_tokens": pa.array([len(x[1]) for x in found], pa.int64()),
                        "ids": pa.array([x[1].astype("<u4").tobytes() for x in found], pa.binary()),
                    }
                )
                begin = end

    return wanted.mapInArrow(read, "file string, part int, place bigint, doc_id bigint, n_tokens bigint, ids binary")


def token_starts(index: DataFrame, records: DataFrame) -> DataFrame:
    """Records (ids as little-endian 32-bit numbers) with `start`, the number of ids in all documents before, in the order of the files."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))
    inside = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return (
        records.withColumn("inner_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(parts, "part")
        .withColumn("start", (F.col("part_start") + F.col("inner_start")).cast("long"))
        .drop("part_start", "inner_start")
    )
