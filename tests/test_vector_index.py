from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from veilscan.operators.retrieval import nearest_chunks
from veilscan.operators.vector_index import compared_chunks, fit_index, indexed_chunks, nearest_indexed
from veilscan.plans import corpora as C


def vectors(spark, clustered: bool):
    """Four documents of 500 chunks, in clusters or without any."""
    random = np.random.default_rng(3)
    centres = random.normal(size=(25, 24))
    rows = []
    for i in range(2000):
        near = centres[random.integers(25)] + 0.15 * random.normal(size=24)
        rows.append((i % 4, i, [float(x) for x in (near if clustered else random.normal(size=24))]))
    return spark.createDataFrame(rows, "doc_id int, chunk_no long, vector array<float>")


# the share of all pairs that may be compared
@pytest.mark.parametrize("clustered, most", [(True, 0.3), (False, 0.95)])
def test_recall_with_fewer_comparisons(spark, clustered, most):
    chunks = vectors(spark, clustered)
    asked = chunks.where("chunk_no % 10 = 0").select(F.col("chunk_no").alias("q_id"), "doc_id", F.col("vector").alias("q_vector"))
    index = fit_index(chunks)
    indexed = indexed_chunks(chunks, index)
    assert indexed.count() == 2000
    true = {(r.q_id, r.chunk_no) for r in nearest_chunks(asked, chunks, k=5).collect()}
    found = {(r.q_id, r.chunk_no): r for r in nearest_indexed(asked, indexed, index, k=5).collect()}
    assert len(true & set(found)) >= 0.9 * len(true)
    assert compared_chunks(asked, indexed, index).count() <= most * 200 * 500
    exact = {(r.q_id, r.chunk_no): r.distance for r in nearest_chunks(asked, chunks, k=50).collect()}
    assert all(exact[pair] == r.distance for pair, r in found.items() if pair in exact)


def test_recall_of_the_registered_query(spark, sf_dir):
    from veilscan.plans.queries import vector_related

    chunks = C.vector_rows(spark, sf_dir)
    asked = chunks.select(F.col("chunk_no").alias("q_id"), "doc_id", F.col("vector").alias("q_vector"))
    true = {(r.q_id, r.chunk_no) for r in nearest_chunks(asked, chunks, k=5).collect()}
    found = {(r.q_id, r.vec_id) for r in vector_related(spark, sf_dir).collect()}
    assert len(true & found) >= 0.9 * len(true)


def test_a_document_is_spread_by_buckets(spark):
    chunks = vectors(spark, True)
    index = fit_index(chunks)
    asked = chunks.select(F.col("chunk_no").alias("q_id"), "doc_id", F.col("vector").alias("q_vector"))
    plan = plan_of(nearest_indexed(asked, indexed_chunks(chunks, index), index))
    assert "NestedLoop" not in plan and "bucket" in plan


def test_index_of_nothing(spark):
    chunks = vectors(spark, True).where("false")
    index = fit_index(chunks)
    asked = chunks.select(F.col("chunk_no").alias("q_id"), "doc_id", F.col("vector").alias("q_vector"))
    assert nearest_indexed(asked, indexed_chunks(chunks, index), index).count() == 0


@pytest.mark.parametrize("block", [16384, 100])
def test_no_row_for_a_pair(spark, block):
    """Copies, numbers that come twice, and vectors without a place: the same rows as over pairs, which are not made."""
    chunks = vectors(spark, True).unionByName(
        spark.sql("select 1 as doc_id, id + 5000 as chunk_no, transform(sequence(1, 24), x -> cast(0.5 as float)) as vector from range(300)")
    )
    index = fit_index(chunks)
    odd = spark.createDataFrame(
        [(1, 9001, None), (1, 9002, [None] * 24), (1, 9003, [float("nan")] * 24), (1, 9004, [1.0]), (None, 9005, [0.5] * 24), (1, None, [0.5] * 24)],
        chunks.schema,
    )
    rows = chunks.unionByName(odd)
    asked = rows.where("chunk_no % 7 = 0 or chunk_no > 5290").select((F.col("chunk_no") % 1000).alias("q_id"), "doc_id", F.col("vector").alias("q_vector"))
    near = nearest_indexed(asked, indexed_chunks(rows, index), index, k=5, block=block)
    plan = plan_of(near)
    assert "FlatMapCoGroupsInArrow" in plan
    got = {(r.q_id, r["rank"]): (r.doc_id, r.chunk_no, r.distance) for r in near.collect()}
    right = rows.where("chunk_no is null or chunk_no not between 9001 and 9004")
    pairs = compared_chunks(asked.where("size(q_vector) = 24 and not isnan(q_vector[0]) and q_vector[0] is not null"), indexed_chunks(right, index), index)
    by: dict = {}
    for r in pairs.collect():
        by.setdefault(r.q_id, []).append((r.distance, r.chunk_no is not None, r.chunk_no, r.doc_id))
    want = {(q, i + 1): (d, n, s) for q, found in by.items() for i, (s, _, n, d) in enumerate(sorted(found, key=lambda x: x[:2] + (x[2] or 0,))[:5])}
    assert got.keys() == want.keys()
    assert all(got[at][1:] == want[at][1:] for at in want)


def test_vectors_without_a_place_do_not_stop_the_fit(spark):
    chunks = vectors(spark, True).limit(50)
    odd = spark.createDataFrame([(1, 9001, None), (1, 9002, [None] * 24), (1, 9003, [float("inf")] * 24), (1, 9004, [1.0])], chunks.schema)
    assert np.isfinite(fit_index(chunks.unionByName(odd)).medians).all()
