import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from .test_decontaminate import brute_force
from panelcraft.llm import pii, registry, toxicity
from panelcraft.llm.packing import default_tokenizer

from .conftest import DOC
from .test_near_dedup import brute_classes
from .test_pii import plain_spans


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_one_after_another(spark, sf, scratch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept, results = docs.columns, docs, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf)
        out.write.parquet(f"{scratch}/{i}")
        before, kept = kept, spark.read.parquet(f"{scratch}/{i}")
        results[name] = (before, kept)
        assert name == "packing" or kept.columns == columns
    before, after = (rows_of(x) for x in results["toxicity"])
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r.doc_id: r.s for r in toxicity.with_scores(docs, model, "s").collect()}
    assert after == {d: t for d, t in before.items() if scores[d] < toxicity.THRESHOLD}
    before, after = (rows_of(x) for x in results["near_duplicates"])
    assert set(after) == set(brute_classes(sorted(before.items())).values())
    before, after = (rows_of(x) for x in results["benchmark_decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(after) == {r[0] for r in brute_force(list(before.items()), items) if not r[2]}
    before, after = (rows_of(x) for x in results["personal_data"])
    assert set(after) == set(before) and not any(plain_spans(t) for t in after.values())
    assert all(after[d] == t for d, t in before.items() if not any(c in t for c in "@+0123456789"))
    assert all(r.n_chars == len(r.text) for r in results["personal_data"][1].collect())
    exact, pieces = Tokenizer.from_file(default_tokenizer()), {}
    for r in sorted(results["packing"][1].collect(), key=lambda r: (r.doc_id, r.start)):
        pieces.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert pieces == {d: [*exact.encode(t, add_special_tokens=False).ids, 0] for d, t in after.items()}


def test_run_equals_its_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "ids", "doc_tokens", "length", "sequence_id", "offset"] and out.count() > 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_documents(spark, sf, odd, empty, name, stage):
    out = stage(spark, odd.withColumn("extra", odd.doc_id), sf)
    assert out.count() > 0 and stage(spark, empty, sf).count() == 0
    assert name == "packing" or out.columns == [*odd.columns, "extra"]


def test_personal_data_stage_learns_from_all_candidates(spark, sf):
    """95 % of the phone candidates are well formed; among at most 400 of each label only 80 % would be."""
    rows = [(i, f"call 555-{'2011-1' if i % 20 == 0 else '201-11'}{i % 90 + 10} now {i:06d}", "en", "s", 1) for i in range(2000)]
    out = corpus_pipeline.personal_data(spark, spark.createDataFrame(rows, DOC), sf).collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in out} == {i: (f"call [PHONE] now {i:06d}", 23) for i in range(2000)}


@pytest.mark.parametrize("well_formed", [9, 1])
def test_personal_data_stage_counts_candidates_of_a_label_in_one_fold(spark, sf, monkeypatch, well_formed):
    """Without the fold of the only ill-formed one all candidates have the same label: they count all the same."""
    rows = [(i, f"call 555-{'2011-1' if i == 0 else '201-11'}{i + 10} now", "en", "s", 1) for i in range(well_formed + 1)]
    bins, calibrate = [], pii.calibrate
    monkeypatch.setattr(pii, "calibrate", lambda found: bins.extend(found) or calibrate(found))
    out = corpus_pipeline.personal_data(spark, spark.createDataFrame(rows, DOC), sf)
    assert out.count() == len(rows)
    assert (sum(r["n"] for r in bins), sum(r["hits"] for r in bins)) == (well_formed + 1, well_formed)


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.queries()) == list(range(1, 14))
