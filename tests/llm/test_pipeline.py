import corpus_pipeline
from conftest import DATA

from conceptframe.llm import decontaminate, jaccard, mixing, tokencounts, toxicity  # noqa: F401
from conceptframe.llm.tokenizing import tokenizer


def test_stages_act_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA).cache()
        assert after.columns == docs.columns
        before_ids, ids = ({r.doc_id for r in x.select("doc_id").collect()} for x in (docs, after))
        assert ids <= before_ids
        if name == "near_copies":
            assert before_ids - ids == {r.doc_id for r in jaccard.jaccard_join(docs).collect() if r.component_id != r.doc_id}
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.contamination(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect() if r.contaminated}
            assert before_ids - ids == bad
        docs = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).orderBy("start").collect()
    own = tokenizer("word_bpe_49k.json")
    want = sorted((r.doc_id, len(own.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in out) == want
    assert [r.start for r in out] == [sum(r.n_tokens for r in out[:k]) for k in range(len(out))]


def test_run_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50


def test_queries_are_registered():
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert len(names) == 11 and {int(n[2:].split("_")[0]) for n in names if n != "pipeline"} == set(range(1, 11))
