import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from weftarc.llm.scratch import stored

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, before, SF), "test")
        assert docs.columns == columns, name
        ids, earlier = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, before))
        assert ids <= earlier and docs.count() == len(ids)
        assert (ids == earlier) == (name == "substring dedup") or name == "benchmark decontamination"
        before = docs
    last = stored(corpus_pipeline.STAGES[-1][1](spark, docs, SF), "test")
    texts = {r.doc_id: r for r in docs.collect()}
    assert all(r.n_chars == len(r.text) for r in texts.values())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = last.collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id].text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids) and r.decoded_text == library.decode(ids, skip_special_tokens=False)


def test_run_is_the_stages_and_repeats_exactly(spark):
    key = lambda df: hashlib.sha256(repr(sorted((r.doc_id, r.n_tokens, r.decoded_text) for r in df.collect())).encode()).hexdigest()
    assert key(corpus_pipeline.run(spark, SF)) == key(corpus_pipeline.run(spark, SF))


def test_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
