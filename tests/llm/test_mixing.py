import pyarrow as pa
import pytest
from tests.oracle import SF_DIR, same

from sourcelens.llm import mixing


def test_oracle(spark):
    assert same(mixing.op7_mix(spark, SF_DIR), mixing.ORACLE) == 1000


def fill(sizes, share, weights):
    """Targets by resharing until none is above its cap."""
    cap = {s: 2.0 * n for s, n in sizes.items()}
    target, free, rest = {}, set(sizes), share * sum(sizes.values())
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / total > cap[s]}
        if not over:
            return target | {s: rest * weights[s] / total for s in free}
        for s in over:
            target[s] = cap[s]
            rest -= cap[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    sizes = {f"s{i:02}": rng.choice([0, 1, 10, 500, rng.randint(1, 3000)]) for i in range(rng.randint(1, 14))}
    got = mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long"))
    want = fill(sizes, 1.5, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))})
    assert {r.source: pytest.approx(r.target) for r in got.collect()} == want


ROWS = [(1, "a b c", "x"), (None, None, None), (2, "a " * 500, "x"), (2, "a " * 500, "x"), (3, "", "y"), (4, "b\x0bc\x0cd", None), (5, "  é", "z"), (6, "q " * 9, "y")]


def test_small_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    docs = spark.createDataFrame([(*r, 5, "t") for r in ROWS], "doc_id long, text string, source string, size long, target string")
    arrow = pa.table({n: pa.array([r[i] for r in ROWS], pa.int64() if not i else pa.string()) for i, n in enumerate(("doc_id", "text", "source"))})
    same(mixing.mix(docs), mixing.ORACLE, tables={"documents": arrow})
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and sorted(map(str, rows.collect())) == sorted(map(str, mixing.mixed_rows(docs.repartition(3)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0


def test_budgets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = mixing.mix(docs).selectExpr("*").collect()
    of = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    taken, target = {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
        target[of[r.doc_id]] = r.target
    assert taken == {s: int(t) for s, t in target.items()}
