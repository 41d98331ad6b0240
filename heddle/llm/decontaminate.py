"""Benchmark decontamination with a distributed positional inverted index.

The index stores, for every term of the training texts that the test set may ask for, where it stands: postings
(term, document, positions). A phrase is found by intersecting offset-adjusted position lists, its rarest terms first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import Words, byte_table, column, pick, small_batches, spans, steps
from heddle.session import cut

#: Words: runs of digits, letters a-z (A-Z lower-cased) and everything beyond ASCII.
TERMS = byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)
WINDOW = 13
#: Bits of the filter that tells tasks which terms the test set has: 1 MiB, whatever the size of the test set.
FILTER_BITS = 1 << 23


def _bits(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) & (FILTER_BITS - 1)


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The windows of items(item_id, text): `terms`, of `window` consecutive words; an item of fewer words, but not none, is one
    window. One row for each (item_id, terms); null texts have no words. Repeated rows change nothing."""
    rows = pick(items, "item_id", "text")
    small_batches(items.sparkSession)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches):
            words = Words(column(table, "text"), TERMS)
            counts = words.counts()
            n = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
            size = np.minimum(np.repeat(counts, n), window)
            begin = spans(words.first[:-1], n)
            flat = words.spelling.take(pa.array(words.code[spans(begin, size)]))
            terms = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), flat)
            yield pa.RecordBatch.from_pydict({"item_id": column(table, "item_id").take(pa.array(np.repeat(np.arange(len(n)), n))), "terms": terms.cast(pa.list_(pa.string()))})

    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(windows, f"item_id {kind}, terms array<string>").distinct()


def term_filter(phrase_terms: DataFrame) -> tuple[bytes, int]:
    """Bit set of the terms' hashes, and the number of words of the shortest phrase (0 without phrases).
    Each task makes one set of fixed size, at most 8 of them reach the driver."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, least = np.zeros(FILTER_BITS // 8, np.uint8), 0
        for batch in batches:
            lists = batch.column("terms")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            if len(sizes):
                least = min(least or sizes.min(), sizes.min())
                at = _bits(lists.flatten().unique().to_pylist())
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": [bits.tobytes()], "least": pa.array([int(least)], pa.int32())})

    found = phrase_terms.select("terms").coalesce(8).mapInArrow(collect, "bits binary, least int").collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in found:
        bits |= np.frombuffer(row.bits, np.uint8)
    return bits.tobytes(), min((r.least for r in found if r.least), default=0)


def text_runs(docs: DataFrame, bits: bytes, least: int) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, row (a hash of the text), n_words, and `runs`: start and terms of each
    stretch of at least `least` words that all pass the filter. A phrase can stand nowhere else; terms that are to be near
    each other can, unless `least` is 1."""
    rows = pick(docs, "doc_id", "text").withColumn("row", F.xxhash64("text"))
    small_batches(docs.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_bits = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        for table in steps(batches):
            words = Words(column(table, "text"), TERMS)
            known = filter_bits[_bits(words.spelling.to_pylist())]
            inside = known[words.code]
            edge = np.zeros(len(inside) + 1, bool)  # where a run may begin or end
            edge[words.first] = True
            edge[1:-1] |= inside[1:] != inside[:-1]
            at = np.flatnonzero(edge)
            begin, size = at[:-1], np.diff(at)
            keep = inside[begin] & (size >= least) if least and len(begin) else np.zeros(len(begin), bool)
            begin, size = begin[keep], size[keep]
            owner = np.searchsorted(words.first, begin, "right") - 1
            flat = words.spelling.take(pa.array(words.code[spans(begin, size)])).cast(pa.string())
            terms = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)
            runs = pa.StructArray.from_arrays([pa.array(begin - words.first[owner]), terms], ["start", "terms"])
            per_text = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=table.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": column(table, "doc_id"),
                    "row": column(table, "row"),
                    "n_words": pa.array(words.counts()),
                    "runs": pa.ListArray.from_arrays(pa.array(per_text), runs),
                }
            )

    return rows.mapInArrow(find, f"doc_id {kind}, row bigint, n_words bigint, runs array<struct<start:bigint,terms:array<string>>>")


def positional_index(runs: DataFrame) -> DataFrame:
    """Postings of the runs: term, doc_id, row and the term's positions there, ascending. Equal rows count once."""
    exploded = runs.filter(F.size("runs") > 0).select("doc_id", "row", "runs").distinct().select("doc_id", "row", F.explode("runs").alias("run"))
    tokens = exploded.select("doc_id", "row", "run.start", F.posexplode("run.terms").alias("at", "term"))
    placed = tokens.select("term", "doc_id", "row", (F.col("start") + F.col("at")).alias("position"))
    return placed.groupBy("term", "doc_id", "row").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def _same_doc(a: str, b: str) -> Column:
    """The same document; `row` stands for the text, ids may be null."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))


def _ranked(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries(query, terms) with `ranked`: their terms as (frequency, offset, term), the rarest first. Queries with a term that
    the index lacks are left out: they occur nowhere."""
    frequency = index.groupBy("term").agg(F.sum(F.size("positions")).alias("frequency"))
    terms = queries.select("query", F.size("terms").alias("n"), F.posexplode("terms").alias("offset", "term"))
    listed = F.sort_array(F.collect_list(F.struct("frequency", "offset", "term"))).alias("ranked")
    return terms.join(frequency, "term").groupBy("query", "n").agg(listed).filter(F.size("ranked") == F.col("n"))


def phrase_matches(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Every exact occurrence of queries(query, terms): query, doc_id, row, start, n.

    The positions of the rarest term give the possible starts; those where the second rarest stands at its offset go on;
    the others are looked up for these alone, and all must be there.
    """
    ranked = _ranked(index, queries)
    first = ranked.select("query", "n", "ranked", F.col("ranked")[0]["term"].alias("term"))
    starts = (
        first.join(index, "term")
        .select("query", "n", "ranked", "doc_id", "row", F.explode("positions").alias("position"))
        .withColumn("start", F.col("position") - F.col("ranked")[0]["offset"])
        .filter("start >= 0")
        .drop("position")
    )
    short = starts.filter("n = 1").select("query", "doc_id", "row", "start", "n")
    seconds = starts.filter("n > 1").withColumn("term", F.get("ranked", F.lit(1))["term"]).alias("s")
    here = (F.col("s.term") == F.col("i.term")) & _same_doc("s", "i")
    both = seconds.join(index.alias("i"), here).filter(F.array_contains("i.positions", F.col("s.start") + F.get("s.ranked", F.lit(1))["offset"])).select("s.*")
    pairs = both.filter("n = 2").select("query", "doc_id", "row", "start", "n")
    rest = both.filter("n > 2").select("query", "doc_id", "row", "start", "n", F.explode(F.expr("slice(ranked, 3, n - 2)")).alias("t"))
    rest = rest.select("query", "doc_id", "row", "start", "n", "t.term", "t.offset").alias("s")
    hits = rest.join(index.alias("i"), here).filter(F.array_contains("i.positions", F.col("s.start") + F.col("s.offset")))
    full = hits.groupBy("s.query", "s.doc_id", "s.row", "s.start", "s.n").agg(F.count(F.lit(1)).alias("found")).filter("found = n - 2").drop("found")
    return short.unionByName(pairs).unionByName(full)


def proximity_index(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Postings of every occurrence of a term of queries(terms) in docs(doc_id, text): what `proximity_matches` needs."""
    bits, least = term_filter(queries)
    return positional_index(text_runs(docs, bits, min(least, 1)))


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """Where the rarest term of queries(query, terms) has every other term of the query at most `slop` words away, in any
    order: query, doc_id, row, position of the rarest term. A term that the query repeats needs to stand there once only.
    The index is that of `proximity_index`; one made for phrases alone lacks terms that stand between other words.
    """
    once = queries.select("query", F.array_distinct("terms").alias("terms"))
    ranked = _ranked(index, once)
    places = ranked.select("query", "n", "ranked", F.col("ranked")[0]["term"].alias("term")).join(index, "term").select("query", "n", "ranked", "doc_id", "row", F.explode("positions").alias("position"))
    alone = places.filter("n = 1").select("query", "doc_id", "row", "position")
    others = places.filter("n > 1").select("query", "n", "doc_id", "row", "position", F.explode(F.expr("slice(ranked, 2, n - 1)")).alias("t"))
    others = others.select("query", "n", "doc_id", "row", "position", "t.term").alias("s")
    near = F.exists("i.positions", lambda p: F.abs(p - F.col("s.position")) <= slop)
    hits = others.join(index.alias("i"), (F.col("s.term") == F.col("i.term")) & _same_doc("s", "i")).filter(near)
    full = hits.groupBy("s.query", "s.n", "s.doc_id", "s.row", "s.position").agg(F.count(F.lit(1)).alias("found")).filter("found = n - 1")
    return alone.unionByName(full.select("query", "doc_id", "row", "position"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs(doc_id, text) against items(item_id, text): n_words, n_hit (words inside an occurrence of a window),
    n_items (items with occurring windows), items_sha256 (of those ids, sorted as strings, comma-joined), contaminated (n_hit
    over 0 and at least a twentieth of n_words).

    Nulls have no words. Repeated rows each get the result; rows with one id and different texts are told apart. Items with
    null id count as one item without a name in the list. Without items or documents the result says so or is empty.

    The test set is compared through a bit set of fixed size and by joins on terms, never broadcast by hand. The
    index and the runs are written once. Joins carry the hot side's rows apart, which adaptive execution can split.
    """
    windows = cut(phrases(items, window))
    bits, least = term_filter(windows)
    runs = cut(text_runs(docs, bits, least))
    index = cut(positional_index(runs))
    queries = windows.select("terms").distinct().select(F.array_join("terms", " ").alias("query"), "terms")
    matches = cut(phrase_matches(index, queries))

    covered = matches.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
    # Words covered by sorted spans: each adds what lies behind the furthest end so far.
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    walked = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["n"]).alias("end"),
            (acc["hit"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(acc["end"], s["start"]))).alias("hit"),
        ),
    )
    hits = covered.select("doc_id", "row", walked["hit"].alias("n_hit"))
    of_item = windows.select(F.col("item_id").cast("string").alias("item"), F.array_join("terms", " ").alias("query"))
    named = matches.select("doc_id", "row", "query").distinct().join(of_item, "query").select("doc_id", "row", F.struct("item").alias("item")).distinct()
    listed = named.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item.item")), ",").alias("items"))
    both = hits.alias("h").join(listed.alias("l"), _same_doc("h", "l")).select("h.doc_id", "h.row", "n_hit", "n_items", "items").alias("b")
    every = runs.select("doc_id", "row", "n_words").alias("e")
    n_hit, n_items = F.coalesce("b.n_hit", F.lit(0)).cast("long"), F.coalesce("b.n_items", F.lit(0)).cast("long")
    return every.join(both, F.col("e.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("e.row").eqNullSafe(F.col("b.row")), "left").select(
        F.col("e.doc_id").alias("doc_id"),
        F.col("e.row").alias("row"),
        F.col("e.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.coalesce("b.items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("e.n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs(doc_id, text, ...), with all their columns, that `contamination` does not call contaminated."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(x)}") for x in ("doc_id", "text"))
    bad = contamination(docs, items, window).filter("contaminated").select("doc_id", "row").distinct()
    return plain.join(bad, doc_id.eqNullSafe(bad["doc_id"]) & (F.xxhash64(text) == bad["row"]), "left_anti").toDF(*names)
