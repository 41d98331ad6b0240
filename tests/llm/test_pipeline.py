import hashlib

import numpy as np
import public_tokenizers
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from heddle.llm import quality
from heddle.session import cut
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_neardup import brute as classes
from tests.llm.test_substrings import brute as repeats

SF_DIR = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(120)
    extra = [(9001, None), (9002, ""), (None, "no id " * 9), (9003, "tiny"), (9003, "tiny")]
    docs = cut(docs.unionByName(spark.createDataFrame([(*x, "en", "src0", 0) for x in extra], docs.schema)))
    schema = docs.schema
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    listed = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    net = quality.train(*quality.training_sample(docs, labels))
    kept = corpus_pipeline.quality_classifier(spark, docs, SF_DIR)
    assert kept.schema.names == schema.names
    good = lambda t: net.scores(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] >= 0.3
    assert listed(kept) == sorted((r for r in rows if good(r[1])), key=str)

    once = corpus_pipeline.near_dedup(spark, docs, SF_DIR)
    assert once.schema.names == schema.names
    stay = listed(once)
    assert sorted({str(c) for _, c in classes(rows)}) == sorted({str(d) for d, _ in stay})
    assert set(stay) <= set(rows) and len(stay) == len({d for d, _ in stay})

    shorter = corpus_pipeline.substring_dedup(spark, docs, SF_DIR)
    assert shorter.schema.names == schema.names
    texts = {}
    for r in shorter.collect():
        texts.setdefault(r.doc_id, r.text)
        assert r.n_chars == (None if r.text is None else len(r.text))
    for doc_id, _, removed, digest in repeats(spark, rows, 20):
        assert hashlib.sha256(b" ".join((texts[doc_id] or "").encode().split())).hexdigest() == digest
        assert removed or texts[doc_id] == next(t for d, t in rows if d == doc_id)
    assert shorter.count() == len(rows)

    clean = corpus_pipeline.decontamination(spark, docs, SF_DIR)
    assert clean.schema.names == schema.names
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated(rows, items, 13) if r[-1]}
    assert bad and listed(clean) == sorted((r for r in rows if r[0] not in bad), key=str)

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coded = corpus_pipeline.sentencepiece(spark, docs, SF_DIR).collect()
    assert sorted(str(r.ids) for r in coded) == sorted(str(library.encode(t or "", add_bos=True, add_eos=True)) for _, t in rows)


def test_run(spark):
    done = corpus_pipeline.run(spark, SF_DIR)
    ids = [r.doc_id for r in done.collect()]
    assert ids and len(ids) == len(set(ids)) and min(r.n_tokens for r in done.collect()) >= 2
