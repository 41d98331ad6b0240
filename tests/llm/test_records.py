import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heddle.llm import queries, records

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TOKENS = records.Tokens(PATH, kept_words=100)


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


def check(texts):
    ids, first = TOKENS.encode(pa.array(texts, pa.string()), 1)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [expected(t) for t in texts]


def test_texts():
    check(["", None, " ", "\n", "don't stop. a|b x| 12 |", "É́ x", "<|endoftext|> a<|startoftext|>b", "a b\x1cc\td", "中文 🙂", "abc " * 3000, "x" * 5000])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aabeST'td  .,|\n\t0é中🙂́İ<|>")), max_size=40), min_size=1, max_size=6))
def test_any_text(texts):
    check(texts)


def test_every_document(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op10_binary_records(spark, sf_dir).collect()}
    start = 0
    for row in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = expected(row.text)
        r = got[row.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_shuffled_reads_nulls_and_repeated_rows(spark):
    rows = [(2, "b c"), (None, "n"), (2, "b c"), (1, None), (3, "the cat " * 2000), (2, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("1 as part", "doc_id", "text", "text as Text", "2 as n_tokens")
    index = records.write_records(docs, PATH, 1)
    assert sorted(index.select("doc_id", "n_tokens").collect(), key=str) == sorted(((d, len(expected(t))) for d, t in rows), key=str)
    some = index.filter("doc_id = 2").orderBy("place", ascending=False)
    got = sorted(np.frombuffer(r.ids, "<u4").tolist() for r in records.read_records(some).collect())
    assert got == sorted(expected(t) for d, t in rows if d == 2)
    starts = records.token_starts(index, records.read_records(index)).orderBy("start").collect()
    assert [r.doc_id for r in starts] == [None, 1, 2, 2, 2, 3]
    assert [r.start for r in starts] == np.concatenate([[0], np.cumsum([r.n_tokens for r in starts])[:-1]]).tolist()
    assert records.read_records(records.write_records(docs.limit(0), PATH, 1)).count() == 0


def test_damage_is_noticed():
    data = records.frame(7, np.arange(5), 2)
    doc_id, ids, end = records.unframe(memoryview(data), 0)
    assert (doc_id, ids.tolist(), end) == (7, [0, 1, 2, 3, 4], len(data))
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(records.DamagedRecord):
            records.unframe(memoryview(bytes(broken)), 0)
        with pytest.raises(records.DamagedRecord):
            records.unframe(memoryview(data[:at]), 0)
