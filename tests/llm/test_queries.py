"""The registered queries over whole tables, and the pipeline against brute force."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from opinara.llm import quality  # noqa: E402
from opinara.llm import queries as llm  # noqa: E402
from tests.llm.test_operators import brute_fingerprint, brute_groups, brute_spans, least_reachable, rows_of  # noqa: E402
from tests.parity import DATA, compare  # noqa: E402

SF_DIR = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


#: Queries whose rows are not documents.
OTHER_ROWS = {"op11_lexical_search", "op12_chat_formatting", "op13_phrase_collocations"}


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - OTHER_ROWS))
def test_query_has_a_row_per_document(spark, name):
    got = llm.QUERIES[name](spark, SF_DIR)
    ids = [r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()]
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(ids)


@pytest.mark.parametrize("name", sorted(llm.CHECK_SQL))
def test_matches_sql(spark, name):
    out = compare(spark, llm.QUERIES[name], llm.CHECK_SQL[name], SF_DIR)
    assert out["ok"], out.get("why")


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    model = quality.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    want = {i for i, t in rows_of(docs) if quality.scores([t], model)[0] >= quality.THRESHOLD}
    for name, stage in stages.items():
        out = corpus_pipeline.materialise(stage(spark, docs, SF_DIR), "test")
        if name == "exact dedup":
            want = {i for i, g in brute_groups(rows_of(docs)).items() if g[2]}
        elif name == "SimHash near-dedup":
            want = {i for i, least in least_reachable({i: brute_fingerprint(t) for i, t in rows_of(docs)}, 4).items() if i == least}
        assert {r.doc_id for r in out.select("doc_id").collect()} == want, name
        if name == "secret scans":
            before, after = dict(rows_of(docs)), dict(rows_of(out))
            assert not any(brute_spans(t) for t in after.values())
            assert all(("[SECRET]" in after[i]) if brute_spans(t) else True for i, t in before.items())
        if name != "best-fit packing":
            assert out.columns == columns
        docs = out
    assert corpus_pipeline.run(spark, SF_DIR).count() == docs.count()
