import pyarrow as pa
from tests.oracle import SF_DIR, same

from sourcelens.llm import quality

ROWS = [
    (1, "a b c a b c " * 30, "en", "s"), (2, None, None, None), (2, "", "en", None), (3, " \t\n", None, "s"), (4, "x y", "en", "s"),
    (None, "one\ntwo\none\n \n \ntwo " + "w " * 60, "en", "s"), (5, "a a a a a", "en", "s"), (6, " ".join(f"w{i}" for i in range(80)), "en", "s"),
    (6, " ".join(f"w{i}" for i in range(80)), "en", "s"), (7, " ".join(f"w{i}#$%" for i in range(80)), "en", "s"),
    (8, "é ü x \x1c" + " ".join(f"v{i}" for i in range(3000)), "en", "t"), (9, "a b a b a", "de", "t"), (10, "a b c d a b c", "de", "t"),
]


def test_oracle(spark):
    assert same(quality.op4_quality(spark, SF_DIR), quality.ORACLE) == 1000


def test_small_rows(spark):
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], schema + ", n_words int, kept string")
    arrow = pa.table({n: [r[i] for r in ROWS] for i, n in enumerate(("doc_id", "text", "lang", "source"))})
    same(quality.quality(docs), quality.ORACLE, tables={"documents": arrow})
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    want = sorted(r.doc_id for r in quality.quality(docs).where("kept").collect())
    odd = docs.withColumns({"row": quality.F.lit(1), "fence": quality.F.lit(2), "m.w": quality.F.lit(3), "kept": quality.F.lit(False)})
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(odd).count() == len(want)
    assert sorted(r.doc_id for r in kept.collect()) == want and {6, 8} <= set(want) and not {1, 2, 3, 4, 5, 9, 10} & set(want)
    assert quality.quality(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0


def brute_repeats(w):
    at = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({p for i, g in enumerate(at) if at.count(g) > 1 for p in (i, i + 1, i + 2)})


def test_repeat_words_brute_force(spark):
    import random

    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in range(0, 60)]
    got = quality.quality(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    assert {r.doc_id: r.n_repeat_words for r in got.collect()} == {i: brute_repeats(t.split()) for i, t in enumerate(texts)}


def test_clean_documents_stay(spark):
    """Of labelled documents that pass the base rules, nearly all good ones are kept and nearly all bad ones are not."""
    read = lambda t: spark.read.parquet(f"{SF_DIR}/{t}.parquet")
    rows = quality.quality(read("documents")).join(read("labels"), "doc_id").where("not base_failed").groupBy("quality").agg({"kept": "max", "*": "count"})
    kept = quality.quality(read("documents")).join(read("labels"), "doc_id").where("not base_failed and kept").groupBy("quality").count()
    total, kept = {r.quality: r["count(1)"] for r in rows.collect()}, {r.quality: r["count"] for r in kept.collect()}
    assert kept[1] >= 0.98 * total[1] and kept.get(0, 0) <= 0.1 * total[0]


def limits(docs):
    out = quality.fences(quality.sketches(quality.with_base(docs))).collect()
    return {(r.fence_lang, r.fence_source): r.fence.asDict() for r in out}


def test_fences_differ_between_groups(spark):
    """On the table of the correctness run every rate has different fences in different groups."""
    got = limits(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    assert len(got) == 80
    for rate, _ in quality.RATES:
        assert len({f[f"high_{rate}"] for f in got.values()}) >= 10, rate


def make(rng, source, n, symbol, dup, repeat, letters):
    """n documents of a source whose rates lie about the given shares."""
    out = []
    for _ in range(n):
        size = rng.randint(100, 200)
        w = [(chr(97 + rng.randint(0, 25)) * 2 + str(rng.randint(0, 10**9))).ljust(letters, "x")[:letters] for _ in range(size)]
        for k in range(int(repeat * size / 6)):
            w[6 * k + 3 : 6 * k + 6] = w[6 * k : 6 * k + 3]
        w = [x + "#" if rng.random() < symbol else x for x in w]
        text = [" ".join(w[k : k + 5]) for k in range(0, size, 5)]
        text += [text[0]] * int(dup * len(text))
        out.append((len(out), "\n".join(text), "en", source))
    return out


def test_a_source_moves_its_own_fences(spark):
    """A shift of one source's rates moves its fences, and nearly nothing but them; other sources keep what they kept."""
    import random

    def docs(symbol, dup, repeat, letters):
        rows = [r for k in range(3) for r in make(random.Random(k), f"s{k}", 200, 0.02, 0.02, 0.08, 9)]
        rows += make(random.Random(9), "moved", 200, symbol, dup, repeat, letters)
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    usual, odd = docs(0.02, 0.02, 0.08, 9), docs(0.3, 0.1, 0.2, 14)
    before, after = limits(usual), limits(odd)
    octave = 1 << quality.GRID_BITS
    for rate, _ in quality.RATES:
        name = f"high_{rate}"
        moved = after["en", "moved"][name] - before["en", "moved"][name]
        assert moved > octave / 3, rate
        assert all(abs(after["en", f"s{k}"][name] - before["en", f"s{k}"][name]) < moved / 3 for k in range(3)), rate
    # what is usual in the source is kept there, and goes where it is not
    moved, strays = odd.source == "moved", odd.doc_id < 10
    marked = odd.select(quality.F.when(moved, odd.doc_id).alias("doc_id"), "text", "lang", quality.F.when(moved & strays, "s0").otherwise(odd.source).alias("source"))
    kept = [r.doc_id for r in quality.quality(marked).where("kept and doc_id is not null").collect()]
    assert sum(i >= 10 for i in kept) >= 170 and sum(i < 10 for i in kept) <= 1


def test_one_value_has_a_fence(spark):
    """Groups whose values are all one have a fence one step of the grid wide for each interquartile range."""
    rows = [(i, " ".join(f"w{j:04d}" for j in range(100)), "en", "s") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert quality.quality(docs).where("kept").count() == 5
