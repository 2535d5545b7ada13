"""Queries over split nulls and median splits read whole tables."""

from collections import Counter

import numpy as np
import pytest
from tests.oracle import SF_DIR

from sourcelens.operators import calibration
from sourcelens.plans import catalog, feature_queries


def test_median_split_has_all_users(spark):
    n = Counter(r.user_id for r in spark.read.parquet(f"{SF_DIR}/events.parquet").select("user_id").collect())
    v = [n[u] for u in sorted(n)]
    for r in catalog.queries()["median_split"](spark, SF_DIR).collect():
        assert len(set(r.side_a)) == len(r.side_a) == len(v) // 2
        assert min(v[k] for k in r.side_a) >= max(x for k, x in enumerate(v) if k not in set(r.side_a))


def test_sampled_split_null_has_all_embeddings(spark):
    rows = {str(r.vec_id): r.embedding for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()}
    n = len(rows)
    s = np.corrcoef([rows[u] for u in sorted(rows)])
    np.fill_diagonal(s, 0)
    gaps = np.concatenate([calibration.gap_batch(s, calibration.drawn_masks(np.arange(k, k + 2000), n, n // 2, 3)) for k in range(0, 20_000, 2000)])
    r = catalog.queries()["split_null_sampled"](spark, SF_DIR).first()
    assert r.n_evaluated == 20_000 and r.maximum == pytest.approx(gaps.max(), abs=1e-8) and r.median == pytest.approx(np.median(gaps), abs=1e-8)
    assert sum(x.n for x in catalog.queries()["null_histogram"](spark, SF_DIR).collect()) == 20_000


def test_shares_of_many_event_types(spark, tmp_path):
    """Shares add up to 1 beyond a hundred event types."""
    spark.createDataFrame([(k % 2, f"t{k:03}") for k in range(240)], "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    for r in feature_queries.event_shares(spark, str(tmp_path)).collect():
        assert len(r.x[0]) == 240 and sum(r.x[0]) == pytest.approx(1)
