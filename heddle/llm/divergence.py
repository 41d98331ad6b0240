"""Divergence of the sources of each language, in whole numbers.

CountVectorizer (Spark's own, with the largest vocabSize) turns every document into its exact sparse vector of kept terms, those in at
least minDF documents of their language. A term carries its language, so that one vocabulary keeps the languages apart.
Vectors are summed per language and source, and pairs of sources are evaluated on the terms that either of them has; terms that
neither has give one value, which is multiplied.

In how many documents a term is, is counted by the tasks that split the texts and added up by Spark, which is cheaper than a fit
on the documents; the fit is on the terms that are kept. A fitted vocabulary stands in the driver and in every executor. It is
bounded: terms are split by hash into as many shares as keep a vocabulary near SHARE_TERMS terms, and each share has
a fit of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.common import Words, byte_table, column, pick, small_batches, steps, string_hashes
from heddle.session import cut, ensure_checkpoint_dir

#: Kept terms that one vocabulary is made for.
SHARE_TERMS = 1 << 19
#: Terms and sources of a block in which pairs are evaluated.
TERM_BLOCK = 4096
SOURCE_BLOCK = 256
#: Entries of vectors that a task sums before it hands them on.
HELD_ENTRIES = 2_000_000
#: Numbers that a task keeps for sums of sources and terms; where more would be needed it hands the sums on at once.
HELD_SUMS = 1 << 23
#: Pairs of rows and terms that are marked in one array to count distinct ones.
MARKED = 1 << 24
MAX_VOCABULARY = 2**31 - 1
SCALE = 1_000_000_000
#: Letters A to Z, which become small ones, and all but ASCII make terms.
LETTERS = byte_table([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)
#: Between the language and the spelling of a term; no spelling holds it.
MARK = "\0"


def term_lists(docs: DataFrame) -> DataFrame:
    """lang, source, terms (each with its language in front, in order) of docs(lang, source, text), and seen: on the first row of every step of a
    task the terms of the step with the number of its rows that hold them."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches):
            words = Words(column(table, "text"), LETTERS)
            langs = column(table, "lang").dictionary_encode()
            owner = np.repeat(np.arange(table.num_rows), words.counts())
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
            width = len(langs.dictionary)
            place = np.zeros(len(words.spelling) * width, np.int64)
            place[words.code * width + lang] = 1
            kinds = np.flatnonzero(place)
            place[kinds] = np.arange(len(kinds))
            code = place[words.code * width + lang]
            spelled = words.spelling.take(pa.array(kinds // width)).cast(pa.large_string())
            terms = pc.binary_join_element_wise(langs.dictionary.take(pa.array(kinds % width)).cast(pa.large_string()), spelled, pa.scalar(MARK, pa.large_string())).cast(pa.string())
            rows = _rows_of(owner, code, table.num_rows, len(kinds))
            seen = pa.StructArray.from_arrays([terms, pa.array(rows, pa.int32())], ["term", "rows"])
            yield pa.RecordBatch.from_arrays(
                [
                    column(table, "lang"),
                    column(table, "source"),
                    pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), terms.take(pa.array(code))),
                    pa.ListArray.from_arrays(pa.array([0] + [len(kinds)] * table.num_rows, pa.int32()), seen),
                ],
                ["lang", "source", "terms", "seen"],
            )

    return docs.mapInArrow(split, "lang string, source string, terms array<string>, seen array<struct<term: string, rows: int>>")


def _rows_of(owner: np.ndarray, code: np.ndarray, rows: int, kinds: int) -> np.ndarray:
    """For each code the number of distinct owners (0 to rows - 1) beside it."""
    if rows * kinds > MARKED:
        return np.bincount(np.unique(owner * kinds + code) % kinds, minlength=kinds)
    held = np.zeros(rows * kinds, bool)
    held[owner * kinds + code] = True
    return held.reshape(rows, kinds).sum(0)


def _share(terms: pa.Array, shares: int) -> np.ndarray:
    return (string_hashes(terms) % np.uint64(shares)).astype(np.int64)


def _shares(lists: DataFrame, min_df: int) -> list[tuple[DataFrame, DataFrame]]:
    """The lists with the terms(term) that at least `min_df` rows hold, split by hash of the terms so that each share has near SHARE_TERMS at most."""
    seen = lists.select(F.inline("seen")).groupBy("term").agg(F.sum("rows").alias("rows"))
    kept = cut(seen.filter(F.col("rows") >= min_df).select("term"))
    shares = 1 + kept.count() // SHARE_TERMS
    lists = lists.drop("seen")
    if shares == 1:
        return [(lists, kept)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(_share(batch.column("term"), shares), pa.int32())], ["term", "share"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms")
            flat = terms.flatten().dictionary_encode()
            code = flat.indices.to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            key = owner * shares + _share(flat.dictionary, shares)[code]
            order = np.argsort(key, kind="stable")
            rows, at = np.unique(key[order], return_index=True)
            dealt = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)), pa.int32()), flat.dictionary.take(pa.array(code[order])))
            who = pa.array(rows // shares)
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(who), batch.column("source").take(who), dealt, pa.array(rows % shares, pa.int32())], ["lang", "source", "terms", "share"])

    spark = lists.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/shares-{uuid.uuid4().hex}"
    lists.mapInArrow(deal, "lang string, source string, terms array<string>, share int").write.partitionBy("share").parquet(path)
    dealt, names = spark.read.parquet(path), cut(kept.mapInArrow(mark, "term string, share int"))
    own = lambda df, i: df.filter(F.col("share") == i).drop("share")
    return [(own(dealt, i), own(names, i)) for i in range(shares)]


def group_sums(vectors: DataFrame, width: int) -> DataFrame:
    """Sums of the sparse vectors(source, vector), `width` wide, of each source: source, index, count. A vector's language is that of its terms."""
    most = max(1, HELD_SUMS // max(1, width))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        sums = np.zeros(0)
        for source, index, value in entries(batches):
            new = [x for x in source.dictionary.to_pylist() if x not in names]
            if len(names) + len(new) > most:  # sums of so many sources do not fit
                yield handed(source.dictionary, *summed(source.indices.to_numpy(zero_copy_only=False), index, value))
                continue
            names.update({x: len(names) + i for i, x in enumerate(new)})
            place = np.array([names[x] for x in source.dictionary.to_pylist()], np.int64)[source.indices.to_numpy(zero_copy_only=False)]
            found = np.bincount(place * width + index, value, len(names) * width)
            found[: len(sums)] += sums
            sums = found
        for at, name in enumerate(names):
            own = sums[at * width : (at + 1) * width]
            index = np.flatnonzero(own)
            yield handed(pa.array([name], pa.string()), np.zeros(len(index), np.int64), index, own[index])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DictionaryArray, np.ndarray, np.ndarray]]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("vector").field("indices").flatten())
            if size >= HELD_ENTRIES:
                yield flat(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield flat(pa.Table.from_batches(held))

    def flat(table: pa.Table) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        vector = column(table, "vector")
        lists = vector.field("indices")
        owner = np.repeat(np.arange(table.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        source = column(table, "source").dictionary_encode().take(pa.array(owner))
        return source, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), vector.field("values").flatten().to_numpy(zero_copy_only=False)

    def summed(source: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, back = np.unique(source.astype(np.int64) * width + index, return_inverse=True)
        return keys // width, keys % width, np.bincount(back, value, len(keys))

    def handed(names: pa.Array, source: np.ndarray, index: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        # whole numbers far below 2^53
        return pa.RecordBatch.from_arrays([names.take(pa.array(source)), pa.array(index), pa.array(value.astype(np.int64))], ["source", "index", "count"])

    return vectors.select("source", "vector").mapInArrow(add, "source string, index bigint, count bigint").groupBy("source", "index").agg(F.sum("count").alias("count"))


def term_counts(lists: DataFrame, min_df: int) -> DataFrame:
    """lang, source, term, index and count of the kept terms, those in at least `min_df` rows of their language."""
    spark = lists.sparkSession
    out = spark.createDataFrame([], "lang string, source string, term string, index long, count long")
    for number, (share, kept) in enumerate(_shares(lists, min_df)):
        if kept.isEmpty():  # CountVectorizer refuses an empty vocabulary
            continue
        fitted = kept.select(F.array("term").alias("terms"))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=1.0, vocabSize=MAX_VOCABULARY).fit(fitted)
        spelled = [name.rpartition(MARK) for name in model.vocabulary]
        names = pa.table({"index": pa.array(range(len(spelled)), pa.int64()), "lang": pa.array([x[0] for x in spelled], pa.string()), "term": pa.array([x[2] for x in spelled], pa.string())})
        found = group_sums(model.transform(share), len(spelled)).join(spark.createDataFrame(names), "index")
        out = out.unionByName(cut(found.select("lang", "source", "term", (F.col("index") + F.lit(number << 32)).alias("index"), "count")))
    return out


def _share_of(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact; null where nothing is kept."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    below = F.nullif(total + 2 * kept, F.lit(0)).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most SCALE + 1, so 64 bits hold the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _evaluate(table: pa.Table) -> pa.Table:
    """For the sources of one or two blocks and the terms of a block: of each pair the sum, over terms that one of the sources here
    has, of the value less the value that two counts of 0 give."""
    sources = column(table, "source")
    names = sources.unique().sort()  # so that every block of terms names a pair the same way round
    source = pc.index_in(sources, names).to_numpy(zero_copy_only=False)
    block, p = (column(table, x).to_numpy(zero_copy_only=False) for x in ("block", "p"))
    index = column(table, "index")
    plain = index.is_null().to_numpy(zero_copy_only=False)
    none = np.zeros(len(names), np.int64)
    none[source[plain]] = p[plain]
    place = np.zeros(len(names), np.int64)
    place[source] = block
    terms, row = np.unique(index.drop_null().to_numpy(zero_copy_only=False), return_inverse=True)
    shares = np.tile(none, (len(terms), 1))
    shares[row, source[~plain]] = p[~plain]
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    left, right = np.flatnonzero(place == low), np.flatnonzero(place == high)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in left:
        others = right[right > a] if low == high else right
        if len(others):
            p, q = shares[:, [a]], shares[:, others]
            value = ((p - q) * (p - q) // (p + q)).sum(0)
            value -= len(terms) * ((none[a] - none[others]) ** 2 // (none[a] + none[others]))
            found.append((np.full(len(others), a), others, value))
    a, b, value = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [[]] * 3))
    lang = pa.array([table["lang"][0].as_py()] * len(a), pa.string())
    return pa.table({"lang": lang, "source": names.take(pa.array(a, pa.int64())), "item": names.take(pa.array(b, pa.int64())), "more": pa.array(value, pa.int64())})


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of all ordered pairs of sources of a language."""
    blocks = F.ceil(F.col("sources") / SOURCE_BLOCK).cast("int")
    groups = groups.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    groups = groups.withColumn("chunks", F.ceil(F.col("kept") / TERM_BLOCK).cast("int"))
    own = ["lang", "source", "block", "blocks", "chunks"]
    here = counts.join(groups.filter("kept > 0"), ["lang", "source"])
    here = here.select(*own, F.pmod(F.xxhash64("index"), F.col("chunks")).cast("int").alias("chunk"), "index", _share_of(F.col("count"), F.col("total"), F.col("kept")).alias("p"))
    chunks = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    plain = groups.filter("kept > 0").select(*own, chunks, F.lit(None).cast("long").alias("index"), F.col("none").alias("p"))
    met = here.unionByName(plain).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("lang", "chunk", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "source", "block", "index", "p")
    half = met.groupBy("lang", "chunk", "low", "high").applyInArrow(_evaluate, "lang string, source string, item string, more bigint")
    half = cut(half.groupBy("lang", "source", "item").agg(F.sum("more").alias("more")))
    more = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "more"))

    left = groups.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", "source", "kept", "none", "at")
    right = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"), F.col("block").alias("at"))
    every = left.join(right, ["lang", "at"]).filter("source != item")
    value = F.col("kept") * _apart(F.col("none"), F.col("item_none")) + F.coalesce("more", F.lit(0))
    return every.join(more, ["lang", "source", "item"], "left").select("lang", "source", "item", F.when(F.col("kept") > 0, value).otherwise(F.lit(0)).cast("long").alias("value"))


def audit(docs: DataFrame, min_df: int = 10, top: int = 10) -> DataFrame:
    """How far the sources of docs(lang, source, text) are apart in their terms: lang, source, part, item, value, rank.

    A term is a run of letters (A to Z alike in either case) and of characters beyond ASCII. A language keeps the terms that at least
    `min_df` of its rows hold. With V kept terms, a group (or language) that has N occurrences of them gives a term with
    `count` occurrences the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)). Two shares are floor((p - q)^2 / (p + q)) apart.

    Part `pair`: every other source of the language, with the sum over all kept terms, all ranks. Part `term`: the `top` terms of the group
    whose share is above the language's. Ranks go by value, then by the item's bytes. Null lang, source and text
    count as empty ones; '' is a language and a source like others. A group without terms, or a language that keeps none, has its
    pairs (with value 0 where V is 0) and no term rows. Repeated rows count as often as they stand. An empty table, and a
    language with one source and no kept term, give no rows. Other columns are not read.

    Documents move once, as sums per group and term that each task has added up before; so a source or language that holds most rows
    costs no more than its terms. Pairs meet in blocks of TERM_BLOCK terms and SOURCE_BLOCK sources.
    """
    small_batches(docs.sparkSession)
    ensure_checkpoint_dir(docs.sparkSession)
    read = pick(docs, "lang", "source", "text").select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source", "text")])
    lists = cut(term_lists(read))
    counts = term_counts(lists, min_df)
    terms = cut(counts.groupBy("lang", "index").agg(F.sum("count").alias("all")))
    langs = terms.groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    named = lists.select("lang", "source").distinct()
    groups = named.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(named.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")), "lang")
    groups = groups.fillna(0, ["total", "lang_total", "kept"])
    groups = cut(groups.withColumn("none", _share_of(F.lit(0), F.col("total"), F.col("kept"))))

    p, q = _share_of(F.col("count"), F.col("total"), F.col("kept")), _share_of(F.col("all"), F.col("lang_total"), F.col("kept"))
    above = counts.join(groups.select("lang", "source", "total", "lang_total", "kept"), ["lang", "source"]).join(terms, ["lang", "index"])
    above = above.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    above = above.select("lang", "source", "item", _apart(F.col("p"), F.col("q")).cast("long").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    pairs = _pairs(counts, groups).withColumn("rank", F.row_number().over(order))
    parts = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", pairs), ("term", best))]
    return parts[0].unionByName(parts[1])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
 c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
 l AS (SELECT lang, count(DISTINCT term) AS v, sum(n) AS total FROM c GROUP BY lang),
 lt AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
 g AS (SELECT DISTINCT lang, source FROM d),
 gt AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
 whole AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gt.total, 0) + 2 * l.v)::HUGEINT AS p,
           1 + (1000000000::HUGEINT * (lt.n + 2)) // (l.total + 2 * l.v)::HUGEINT AS q
           FROM g JOIN kept USING (lang) JOIN l USING (lang) JOIN lt USING (lang, term)
           LEFT JOIN c USING (lang, source, term) LEFT JOIN gt USING (lang, source)),
 sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM whole a JOIN whole b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
 pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
           FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
           LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
 terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM whole WHERE n > 0 AND p > q),
 every AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM terms),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
