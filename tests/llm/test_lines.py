import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tests.oracle import SF_DIR

from sourcelens.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """(id, text) rows after line dedup, by every run of every document: a line goes if an earlier one has a run with it that may be deleted."""
    docs = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None})
    out, before = {}, set()
    for d in docs:
        cut = [x.strip(SPACE) for x in d[2].split("\n")]
        at = [k for k, x in enumerate(cut) if x]
        w = [cut[k] for k in at]
        every = {(a, b) for a in range(len(w)) for b in range(a + 1, len(w) + 1) if (b - a == 3 or b - a < 3 and sum(map(len, w[a:b])) >= 200)}
        gone = {k for a, b in every if tuple(w[a:b]) in before for k in range(a, b)}
        before |= {tuple(w[a:b]) for a, b in every}
        left = []
        for i, x in enumerate(d[2].split("\n")):
            near = [max((k for k, j in enumerate(at) if j <= i), default=None), min((k for k, j in enumerate(at) if j >= i), default=None)]
            if not w or not all(k is None or k in gone for k in near):
                left.append(x)
        out[d] = "\n".join(left)
    return [(i, None if t is None else out[i is not None, i or 0, t]) for i, t in rows]


def test_patience_properties():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 12) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 12) for _ in range(rng.randint(0, 25))]
        blocks = lines.patience(a, b)
        at = [(0, 0)]
        for i, j, n in blocks:
            assert a[i : i + n] == b[j : j + n] and n > 0 and i >= at[-1][0] and j >= at[-1][1]
            at.append((i + n, j + n))
    assert lines.patience([1, 2, 3, 4, 5], [9, 2, 3, 4, 8]) == [(1, 1, 3)]
    assert lines.patience([1, 2, 3], [1, 2, 3]) == [(0, 0, 3)]
    assert lines.patience([1, 2, 3, 7, 4, 5], [1, 2, 3, 4, 5]) == [(0, 0, 3), (4, 3, 2)]
    assert lines.patience([], [1]) == []


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


LONG = "word " * 60
ROWS = [
    (1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "b\nc"), (None, "p\nq\n r \ns"), (None, None), (4, "p\n\nq\nr\ns\nz"), (4, "p\n\nq\nr\ns\nz"), (5, ""), (5, ""),
    (6, LONG + "\nu"), (7, "v\n" + LONG), (8, "a\nb\nc\nd"), (9, "\n\n\n\n"), (10, "\n\n\n\n"), (11, "k\n" * 500), (12, "k\n" * 500),
]


def test_small_rows(spark):
    docs = spark.createDataFrame([(*r, "x", 3) for r in ROWS], "doc_id long, text string, key string, h int")
    got = lines.line_dedup(docs)
    assert got.columns == [*docs.columns, "lines__n", "lines__deleted", "lines__sources"]
    assert order([(r.doc_id, r.text) for r in got.collect()]) == order(brute(ROWS))
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[2].text == "x\ny" and by_id[8].text == "" and by_id[8].lines__sources == [1] and by_id[7].text == "v"
    assert lines.line_dedup(docs.limit(0)).count() == 0
    named = docs.select("doc_id", "text", F.lit(1).alias("lines__n"), F.lit(2).alias("row"), F.lit(3).alias("a.b"))
    again = lines.line_dedup(named)
    assert again.columns == ["doc_id", "text", "row", "a.b", "lines__n", "lines__deleted", "lines__sources"]
    assert order([(r.doc_id, r.text) for r in again.collect()]) == order(brute(ROWS))


@pytest.mark.parametrize("seed", range(3))
def test_random_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"line {i}" for i in range(40)]
    rows = []
    for i in range(60):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 8))]
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(0, 30)
            text += pool[k : k + rng.randint(1, 9)]
        rows.append((rng.randint(0, 50), "\n".join(text)))
    # documents with the same id are in the order of a hash, so the brute force needs distinct ids
    seen, distinct = set(), []
    for i, t in rows:
        if i not in seen:
            seen.add(i)
            distinct.append((i, t))
    docs = spark.createDataFrame(distinct, "doc_id long, text string")
    assert order([(r.doc_id, r.text) for r in lines.line_dedup(docs).collect()]) == order(brute(distinct))


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = {r.doc_id: r for r in lines.op6_lines(spark, SF_DIR).collect()}
    for i, t in brute(docs):
        assert got[i].left_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert sum(r.n_deleted for r in got.values()) > 0


def held_before(rows):
    """(id, text) to the worded lines left, by all pairs: a line goes if an earlier document has it in a common run that may be deleted."""
    out, before = {}, set()
    for i, t in sorted(rows):
        w = [x.strip(SPACE) for x in t.split("\n")]
        w = [x for x in w if x]
        every = [(a, b) for a in range(len(w)) for b in range(a + 1, len(w) + 1) if b - a >= lines.MIN_LINES or sum(map(len, w[a:b])) >= lines.MIN_CHARS]
        gone = {k for a, b in every if tuple(w[a:b]) in before for k in range(a, b)}
        before |= {tuple(w[a:b]) for a, b in every}
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def left(spark, rows):
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: [x.strip(SPACE) for x in r.text.split("\n") if x.strip(SPACE)] for r in got}


def test_two_lines_of_enough_characters(spark):
    """A block of two lines that only together have the characters is found without a longer common one."""
    a, b = "a" * 120, "b" * 120
    rows = [(1, f"u\n{a}\n{b}\nv"), (2, f"x\n{a}\n{b}\ny"), (3, f"{a}\nz\n{b}")]
    assert left(spark, rows) == held_before(rows) == {1: ["u", a, b, "v"], 2: ["x", "y"], 3: [a, "z", b]}


def test_blocks_that_patience_leaves(spark):
    """Crossing blocks, other line spacing and lines that repeat in a document."""
    x, y = "x1\nx2\nx3", "y1\ny2\ny3"
    rows = [(1, f"{x}\n{y}"), (2, f"{y}\n{x}"), (3, "a\nb\nc\no"), (4, "p\na\n\nb\n\nc\nq"), (5, "r\ns\nr\nt\nr"), (6, "1\nr\ns\nr\n2\ns\nr\nt\n3\nr\ns\nr\nt")]
    got = left(spark, rows)
    assert got == held_before(rows) and got[2] == [] and got[4] == ["p", "q"] and got[6] == ["1", "2", "3"]


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs(spark, seed):
    """Lines of all sizes, few enough to cross and repeat, with blank ones between: nothing of a shared run is left."""
    rng = random.Random(seed)
    pool = [f"{i}" * rng.choice([1, 30, 60, 110]) for i in range(14)]
    rows = [(i, "\n".join(rng.choice([*pool, ""]) for _ in range(rng.randint(1, 9)))) for i in range(50)]
    assert left(spark, rows) == held_before(rows)
    code = {x: k + 1 for k, x in enumerate(pool)} | {"": 0}
    cut = {i: t.split("\n") for i, t in rows}
    for i in cut:  # what patience aligns with any earlier document is gone too
        gone = held_before(rows)[i]
        for j in range(i):
            w, f = ([code[x] for x in cut[k] if x] for k in (i, j))
            for a, _, n in lines.patience(w, f):
                words = [x for x in cut[i] if x][a : a + n]
                if n >= lines.MIN_LINES or sum(map(len, words)) >= lines.MIN_CHARS:
                    assert len(gone) <= len(w) - n


def test_common_and_rare_lines(spark, monkeypatch):
    """Runs of rare lines meet all earlier holders, runs of common ones the first; both lose the same lines at any bound."""
    rng = random.Random(4)
    pool = [f"{i} line" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(100 + i, f"head {i}\n" + "\n".join(pool[:4])) for i in range(15)]
    want = order(brute(rows))
    for rare in (0, 3, 1000):
        monkeypatch.setattr(lines, "RARE", rare)
        got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert order([(r.doc_id, r.text) for r in got]) == want


def test_equal_hashes_are_not_enough(spark):
    """Lines are equal if 128 bits of hash are; those that find a document by 64 bits only are not deleted."""
    pos, h = [0, 1, 2], [1, 2, 3]
    assert lines.common_lines(pos, list(zip(h, h)), [9, 9, 9], pos, list(zip(h, h))) == [0, 1, 2]
    assert lines.common_lines(pos, list(zip(h, h)), [9, 9, 9], pos, list(zip(h, [1, 2, 4]))) == []
    assert lines.common_lines([0, 1, 3], list(zip(h, h)), [9, 9, 9], pos, list(zip(h, h))) == []
