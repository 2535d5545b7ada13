import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.oracle import SF_DIR

from sourcelens.llm import graph, jaccard


def brute(rows, threshold=0.8):
    """class_id, class_size, n_links of each (id, text) by all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) >= threshold * max(len(a), len(b)) - 1e-9:
                k = len(a & b)
                if k >= threshold * (len(a) + len(b) - k) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (id_, _) in enumerate(rows):
        ids = groups[find(i)]
        out.append((id_, min((x for x in ids if x is not None), default=None), len(ids), links[i]))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.class_id, r.class_size, r.n_links) for r in df.collect()), key=str)


def test_query_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert result(jaccard.op10_jaccard(spark, SF_DIR)) == brute(rows)


def near_copies(rng, n, size=60):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(size)] = f"x{rng.randint(0, 9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block,by_bucket,node", [(512, False, 512), (7, False, 512), (7, True, 512), (7, True, 5)])
def test_large_groups(spark, monkeypatch, block, by_bucket, node):
    monkeypatch.setattr(jaccard, "NODE", node)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(4)
    texts = near_copies(rng, 60) + near_copies(rng, 15, 400) + [f"only {i} here are few words {i}" for i in range(20)]
    if by_bucket:
        monkeypatch.setattr(jaccard, "BUCKET_WEIGHT", 0)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.jaccard_join(docs)) == brute(rows)


def test_cell_modes_agree():
    """Counting pairs in the first tree where they meet finds what comparing all of a group finds."""
    rng = random.Random(9)
    texts = near_copies(rng, 40) + near_copies(rng, 10, 100)
    words = [np.array([hash(w) & (2**64 - 1) for w in t.split()], np.uint64) for t in texts]
    flat, ends = np.concatenate(words), np.cumsum([len(w) for w in words])
    hashes, first = jaccard.shingles(flat, ends)
    labels, sets = jaccard.paths(hashes, first), [np.unique(x) for x in np.split(hashes, first[1:])]
    deep = [None if i % 3 else [{"tree": i % 32, "depth": 7}] for i in range(len(texts))]
    code = jaccard.codes(labels, deep, 6)
    whole = jaccard.compare(code, sets, None, -1, 0.8)
    parts = [jaccard.compare(code, sets, None, t, 0.8) for t in range(jaccard.TREES)]
    assert (sum(p.astype(int) for p in parts) == whole).all()


def test_depths():
    """The longest prefix that reaches the recall, and the shortest: they follow the threshold and the recall."""
    assert jaccard.depths(0.8, 0.999) == (6, 7) and jaccard.depths(0.7, 0.999) == (3, 4)
    assert jaccard.depths(0.8, 0.9999999)[1] < 5 and jaccard.depths(0.99, 0.999)[1] == jaccard.MAX_DEPTH


def test_depth_follows_density(spark, monkeypatch):
    """Texts in dense places match by longer prefixes than those in sparse ones; either way all links are found."""
    monkeypatch.setattr(jaccard, "NODE", 8)
    rng = random.Random(11)
    texts = near_copies(rng, 60, 200) + [t for _ in range(20) for t in near_copies(rng, 2, 80)]
    words = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(jaccard._doc_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    rows = jaccard.signatures(words)
    assert {r.id: r.n_words for r in rows.select("key.id", "n_words").collect()} == {i: len(x.split()) for i, x in enumerate(texts)}
    met, below = jaccard.nodes(rows.select("did", "labels"), *jaccard.depths())
    by_id = {r.did: r.id for r in rows.select("did", "key.id").collect()}
    depth = {}
    for r in met.collect():
        depth.setdefault(by_id[r.did] < 60, set()).add(r.depth)
    assert depth[True] == {6, 7} and depth[False] == {6}
    assert {by_id[r.did] < 60 for r in below.collect()} == {True}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert result(jaccard.jaccard_join(docs)) == brute(list(enumerate(texts)))


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity just over the threshold: at least 0.99 of them are linked."""
    rng = random.Random(12)
    rows = []
    for g in range(300):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(104)]
        x = w[:10] + [f"v{g}"] + w[11:60] + [f"u{g}"] + w[61:]
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(x))]
    got = result(jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert brute(rows)[0][2] == 2 and sum(n for _, _, _, n in got) >= 0.99 * 600


def test_long_texts_are_cut_into_cells_by_words(spark, monkeypatch):
    """Blocks hold so many words at most, so that a group of long texts is compared in many cells."""
    monkeypatch.setattr(jaccard, "BLOCK_WORDS", 2000)
    rows = list(enumerate(near_copies(random.Random(13), 30, 700)))
    assert result(jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


T = " ".join(f"t{i}" for i in range(50))
ROWS = [(1, T), (2, T + " end"), (2, T), (2, T), (None, T), (None, None), (None, "a b"), (3, ""), (4, " \n"), (5, "a b"), (6, "a\tb"), (7, "a b c"), (8, "z " * 30000), (9, "z " * 30001), (10, "one")]


def test_small_rows(spark):
    docs = spark.createDataFrame([(*r, 1, b"x") for r in ROWS], "doc_id long, text string, root int, did binary")
    assert result(jaccard.jaccard_join(docs)) == brute(ROWS)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 5, 7, 8, 10, None, 3, 4], key=str)
    assert jaccard.jaccard_join(docs.limit(0)).count() == 0 and jaccard.one_of_each(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 70)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
