"""The registered queries and the pipeline as a whole."""

import brute
import pytest
from compare import difference, duck
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from pedalgrid.llm import bpe_codec, queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, con, sf_dir, name):
    assert difference(queries.queries()[name](spark, sf_dir), con, queries.oracle_sql()[name]) is None


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert "pipeline" in names


def test_pipeline(spark, sf_dir):
    """Stage by stage against plain loops; the verdicts of the first stage are tested elsewhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n in stages] == ["quality_rules", "line_dedup", "jaccard_join", "decontaminate", "bpe_codec"]
    good = stages["quality_rules"](spark, docs, sf_dir)
    assert good.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert all(not brute.quality(t)[-1] for _, t in kept)
    left = {d: sha for d, _, _, sha in brute.line_dedup(kept)}
    texts = {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, good, sf_dir).collect()}
    assert {d: brute.sha(t) for d, t in texts.items()} == left
    after = sorted(texts.items())
    firsts = {c for _, n, c in brute.jaccard(after) if n} | {d for d, n, _ in brute.jaccard(after) if not n}
    clean = [(d, t) for d, t in after if d in firsts and not brute.contaminated([(d, t)], items)]
    tokenizer = Tokenizer.from_file(bpe_codec.default_vocabulary())
    want = {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in clean}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_pipeline_takes_edge_cases(spark, edge_docs, no_docs, sf_dir):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "bpe_codec":
                assert out.columns == docs.columns
            out.count()
