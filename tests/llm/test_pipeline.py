"""The pipeline's stages in order, each on all that the one before kept."""

import public_tokenizers
import sentencepiece

import corpus_pipeline
from veridex.llm import decontaminate, host_rules, near_dedup, queries, suffix_dedup
from veridex.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "passages", "decontamination", "encoding"]
    docs = table(spark, SF, "documents")
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    kept = {r.doc_id for r in host_rules.report(docs).collect() if r.kept}
    first = corpus_pipeline.quality_rules(spark, docs, SF)
    assert ids(first) == kept and first.columns == docs.columns
    alone = {r.doc_id for r in near_dedup.classes(first, 5, 80).collect() if r.kept}
    second = corpus_pipeline.near_duplicates(spark, first, SF)
    assert ids(second) == alone
    third = corpus_pipeline.passages(spark, second, SF)
    assert ids(third) == alone and third.columns == docs.columns
    assert suffix_dedup.report(third).agg({"n_removed": "sum"}).first()[0] <= suffix_dedup.report(second).agg({"n_removed": "sum"}).first()[0]
    clean = {r.doc_id for r in decontaminate.report(third, table(spark, SF, "benchmark")).collect() if not r.contaminated}
    fourth = corpus_pipeline.decontamination(spark, third, SF)
    assert ids(fourth) == clean
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in fourth.collect()}
    result = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in result} == clean
    assert all(list(r.ids) == library.encode(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in result)


def test_registered():
    names = queries.queries()
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) and len([n for n in names if n.startswith("op")]) == 13 and "pipeline" in names
