import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tests.llm import test_jaccard, test_lines
from tests.oracle import SF_DIR, run_sql

import corpus_pipeline
from sourcelens.llm import bpe, mixing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def arrow(rows):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table({c: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(COLUMNS)})


def brute(rows):
    """The digests of all texts of the mix, from SQL, all pairs and the tokenizer's own library."""
    from tokenizers import Tokenizer

    names = ", ".join(COLUMNS)
    _, rows = run_sql(f"WITH docs_in AS (SELECT * FROM documents), {quality.JUDGED_SQL.strip()} SELECT {names} FROM judged WHERE kept", tables={"documents": arrow(rows)})
    cut = test_lines.brute([(r[0], r[1]) for r in rows])
    rows = [(i, t, r[2], r[3], r[4] if t == r[1] else len(t)) for (i, t), r in zip(cut, rows) if t == r[1] or t.strip(test_lines.SPACE)]
    heads = {i: c for i, c, _, _ in test_jaccard.brute([(r[0], r[1]) for r in rows])}
    rows = [r for r in rows if heads[r[0]] == r[0]]
    sql = f"WITH mix_in AS (SELECT * FROM documents), {mixing.MIXED_SQL.strip()} SELECT doc_id, text, CASE WHEN size > 0 THEN epochs + (2 * lft >= size)::INT ELSE 0 END FROM mixed"
    _, mixed = run_sql(sql, tables={"documents": arrow(rows)})
    own = Tokenizer.from_file(bpe.tokenizer_path())
    out = []
    for i, t, n in mixed:
        ids = own.encode(t, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out += [(i, len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False)))] * n
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())


def test_run_brute_force(spark):
    rows = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = result(corpus_pipeline.run(spark, SF_DIR))
    assert got == brute(rows) and len(got) > 500


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rng = random.Random(1)
    fresh = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    clean = [(i, "\n".join(fresh(30) for _ in range(4)), "en", f"s{i % 3}", 1) for i in range(60)]
    odd = [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, "#$% " * 100, "en", "s0", 1), (103, clean[0][1], "en", "s1", 1)]
    docs = spark.createDataFrame([(*r, "x") for r in clean + odd], "doc_id long, text string, lang string, source string, n_chars long, key string")
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, "")
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "mix_sources":
            assert {r.doc_id for r in docs.collect()} >= {r[0] for r in clean}, name
    assert not {r.doc_id for r in docs.collect()} & {100, 101, 102, 103}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_nothing_to_do(spark, tmp_path, rows):
    pq.write_table(arrow(rows), tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
