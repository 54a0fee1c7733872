"""No n-gram and no language is cut from the models."""

import random

import numpy as np
import pytest

from pedalgrid.llm import language_id


def test_tables_score_what_the_arrays_lack(spark, sample, edge_docs, monkeypatch):
    """With arrays of few 4-grams, or none, all costs stay those of the model of all 4-grams."""
    asked = sample.select("doc_id", "text").unionByName(edge_docs.select("doc_id", "text"))
    whole = language_id.train(sample)
    assert whole.whole
    key = lambda r: (str(r["doc_id"]), r["lang_pred"], r["cross_entropy"] or 0.0)
    want = sorted(language_id.predict(asked, whole).collect(), key=key)
    for most in (5000, 0):
        monkeypatch.setattr(language_id, "MAX_GRAMS", most)
        model = language_id.train(sample)
        assert not model.whole and len(model.grams[0][1]) <= most + 1
        assert (len(model.grams[0][1]) > 1) == (most > 0)
        assert model.limits == pytest.approx(whole.limits, abs=2e-4)
        got = sorted(language_id.predict(asked, model).collect(), key=key)
        assert [r["lang_pred"] for r in got] == [r["lang_pred"] for r in want]
        assert [r["cross_entropy"] or 0 for r in got] == pytest.approx([r["cross_entropy"] or 0 for r in want], abs=1e-5)
        assert [r["score"] for r in got] == pytest.approx([r["score"] for r in want], abs=1e-3)


def test_more_than_64_languages(spark):
    rng = random.Random(8)
    text = lambda i: "".join(rng.choice([chr(0x4E00 + 16 * i + j) for j in range(8)] + [" "]) for _ in range(60))
    docs = spark.createDataFrame([(70 * k + i, text(i), f"x{i:02}") for k in range(12) for i in range(70)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(docs).collect()}
    assert np.mean([got[d] == f"x{d % 70:02}" for d in got]) == 1
