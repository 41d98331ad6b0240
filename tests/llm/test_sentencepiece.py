import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from heddle.llm.sentencepiece_bpe import Encoder, encode_texts, model_at

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
ENCODER = Encoder(model_at(PATH), kept_words=50)


def both(texts):
    ids, first = ENCODER.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])], ENCODER.model.decode(ids, first)


def check(texts):
    ids, decoded = both(texts)
    expected = [LIBRARY.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    assert ids == expected
    assert decoded == [LIBRARY.decode(x) for x in expected]


def test_odd_texts():
    check(["", None, " ", "  ", "a  b", " a", "a ", "a▁ b", "▁", "x\n\ny\t z\x00", "中文 🙂🙂", "aaaa" * 300, "the the " * 400, "   " * 50 + "x", "ab" * 5000])


def test_many_random_long_words():
    rng = np.random.default_rng(1)
    check(["".join(rng.choice(list("aeinorst \n.▁é"), int(n))) for n in rng.integers(1, 3000, 60)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aabehinrst  ▁.,\n0é中🙂")), max_size=60), min_size=1, max_size=8))
def test_any_text(texts):
    check(texts)


def test_operator(spark):
    rows = [(1, "the cat  sat"), (1, "the cat  sat"), (None, "x"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id as Text", "*", "1 as n_tokens", "2 as ids")
    got = encode_texts(docs, PATH, with_ids=True, with_decoded=True).collect()
    assert [r.doc_id for r in got] == [1, 1, None, 3, 4]
    for row, (_, text) in zip(got, rows):
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        assert row.ids == ids and row.n_tokens == len(ids) and row.decoded == LIBRARY.decode(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert encode_texts(docs.limit(0), PATH).count() == 0


def test_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.ids_sha256 for r in encode_texts(docs, PATH).collect()}
    for row in docs.collect():
        ids = LIBRARY.encode(row.text, add_bos=True, add_eos=True)
        assert got[row.doc_id] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_other_kinds_of_models_are_refused(tmp_path):
    with pytest.raises(FileNotFoundError):
        model_at(str(tmp_path / "none.model"))
