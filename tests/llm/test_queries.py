"""The registered queries of the dealt operators."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from parity import duck, mismatch
from sessionscope.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    difference = mismatch(spark, duck(SF_DIR), SF_DIR, queries.build_queries()[name], queries.SQL[name])
    assert difference is None, difference


def test_recall_of_neighbours(spark):
    found = queries.op8_permutation_index(spark, SF_DIR).toPandas()
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, data = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = data @ data[i]
        best = [ids[j] for j in np.lexsort((ids, -scores)) if j != i][:20]
        hits.append(len(set(best) & set(found[found.query_id == ids[i]].vec_id)) / 20)
    assert np.mean(hits) >= 0.9


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == columns, name
        assert 0.75 * docs.count() < kept.count() <= docs.count(), name
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0


def test_decontamination_spares_other_rows_of_an_id(spark):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").head().text
    rows = [(None, f"before {item} after"), (None, "clean without id"), (None, None), (1, item), (1, "clean with a repeated id"), (2, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.decontaminated(spark, docs, SF_DIR).collect()
    assert {tuple(r) for r in kept} == {rows[i] for i in (1, 2, 4, 5)} and len(kept) == 4
