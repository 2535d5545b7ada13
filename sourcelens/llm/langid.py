"""Language identification by the nearest of several centroids per language.

Texts become TF-IDF vectors of hashed character bigrams and trigrams, scaled to
length one. A bounded sample of labelled texts per language is clustered by
spherical k-means; a text takes the language of the centroid with the highest
cosine. Texts further from their centroid than its members lie are marked
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcelens.llm import common

#: Hashed n-grams.
DIMS = 1 << 13
#: Labelled texts that the model is fitted on, per language: those with the least hashes of text, then of id.
SAMPLE_PER_LANG = 400
#: Bytes of all centroids at most.
MODEL_BYTES = 1 << 30
CENTROIDS = 4
ROUNDS = 12
#: A text is rejected below this part of the least cosine of its centroid's members.
SLACK = 0.5
#: Characters of a text that are turned into n-grams together; texts in a matrix.
BLOCK_CHARS = 1 << 20
BLOCK_DOCS = 64

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of the letters, other characters as one gap; None without a letter."""
    if not text:
        return None
    out, letter = np.zeros(DIMS, np.int64), _is_letter()
    carry, some = np.zeros(1, np.uint32), False
    for at in range(0, len(text), BLOCK_CHARS):
        code = np.frombuffer(text[at : at + BLOCK_CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(letter[code], code, 0).astype(np.uint32)
        some = some or bool(code.any())
        code = np.concatenate([carry, code, np.zeros(1, np.uint32)] if at + BLOCK_CHARS >= len(text) else [carry, code])
        code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]
        two = (code[:-1] * np.uint32(0x9E3779B1)) ^ (code[1:] * np.uint32(0x85EBCA77))
        three = (code[:-2] * np.uint32(0xC2B2AE3D)) ^ two[1:]
        # the last two characters stand again in the next block; their own bigram was counted
        for h in (two[max(0, len(carry) - 1) :], three):
            h = h ^ (h >> np.uint32(15))
            out += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 13), minlength=DIMS)
        carry = code[-2:]
    return out if some else None


@dataclass
class Model:
    """Centroids in order of their languages."""

    langs: list[str]
    of: np.ndarray  # language of each centroid
    centroids: np.ndarray
    least: np.ndarray  # least cosine of each centroid's members
    idf: np.ndarray

    def vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        return _unit(np.log1p(np.stack(rows)).astype(np.float32) * self.idf)

    def predict(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, cosine, rejected."""
        if not len(self.centroids):
            return np.full(len(rows), -1), np.zeros(len(rows)), np.ones(len(rows), bool)
        cosine = self.vectors(rows) @ self.centroids.T
        best = cosine.argmax(1)
        score = cosine[np.arange(len(rows)), best]
        return self.of[best], np.clip(score, 0, 1), score < SLACK * self.least[best]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from a farthest-first start: centroids, least cosine of their members."""
    centers = [_unit(x.mean(0, keepdims=True))[0]]
    while len(centers) < min(k, len(x)):
        centers.append(x[(x @ np.stack(centers).T).max(1).argmin()])
    c = np.stack(centers)
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        c = _unit(np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))]))
    cosine = x @ c.T
    near = cosine.argmax(1)
    used = np.unique(near)
    return c[used], np.array([cosine[near == i, i].min() for i in used])


def _sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, text: SAMPLE_PER_LANG distinct texts with a letter of each language at most, those with the least hashes."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    hashed = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit(7), text_col).alias("t"), F.col(text_col).alias("text"))
    # a sketch counts the distinct texts, so that about twice as many as needed reach the sort, however often texts repeat
    share = hashed.groupBy("lang").agg(F.approx_count_distinct("t").alias("n")).select(F.col("lang").alias("l"), (2 * SAMPLE_PER_LANG / F.col("n")).alias("share"))
    part = F.pmod(F.col("t"), F.lit(1 << 30)) / float(1 << 30)
    near = hashed.join(share, F.col("lang") == F.col("l")).where(part < F.col("share")).dropDuplicates(["lang", "t"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(part, "t"))
    return near.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_PER_LANG).select("lang", "t", "text")


def _clusters(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, idf, centroids, least: each language is clustered in a task of its own, from its part of the sample."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(lang, t, c) for lang, t, text in zip(*(batch.column(i).to_pylist() for i in range(3))) if (c := counts(text)) is not None]
            at = [np.flatnonzero(c) for _, _, c in got]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            arrays = [[g[0] for g in got], [g[1] for g in got], at, [c[i] for (_, _, c), i in zip(got, at)]]
            yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], ["lang", "t", "at", "n"])

    sample = common.written(_sample(labelled, id_col, text_col, lang_col).mapInArrow(features, "lang string, t long, at array<int>, n array<int>"), "langid")
    total, df = sample.count(), np.zeros(DIMS)
    for r in sample.select(F.explode("at").alias("i")).groupBy("i").count().collect():  # DIMS rows at most
        df[r.i] = r["count"]
    idf = (np.log((total + 1) / (df + 1)) + 1).astype(np.float32)

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("t")  # the same order in every run
        x = np.zeros((t.num_rows, DIMS), np.float32)
        for i, (at, n) in enumerate(zip(t["at"], t["n"])):
            x[i, at.values.to_numpy()] = n.values.to_numpy()
        c, low = _cluster(_unit(np.log1p(x) * idf), CENTROIDS)
        return pa.table({"lang": t["lang"].slice(0, 1), "idf": [idf.tobytes()], "centroids": [c.astype(np.float32).tobytes()], "least": pa.array([low.tolist()], pa.list_(pa.float64()))})

    return sample.groupBy("lang").applyInArrow(one, "lang string, idf binary, centroids binary, least array<double>")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on SAMPLE_PER_LANG distinct texts of each language at most; equal texts count once, so repeats do not matter.

    All languages are learned. Only centroids (32 KB each) reach the driver;
    more than MODEL_BYTES of them raise an error. Rows without a language, or
    with a null text or one without a letter, are left out; without any other
    row the model is empty.
    """
    with common.Tables() as own:
        made = common.written(_clusters(labelled, id_col, text_col, lang_col), "model")
        size = made.agg(F.sum(F.octet_length("centroids"))).first()[0] or 0
        if size > MODEL_BYTES:
            raise ValueError(f"the centroids have {size} bytes, more than MODEL_BYTES")
        rows = sorted(made.collect(), key=lambda r: r.lang)
    own.release()
    if not rows:
        return Model([], np.zeros(0, int), np.zeros((0, DIMS), np.float32), np.zeros(0), np.ones(DIMS, np.float32))
    of = np.concatenate([[i] * len(r.least) for i, r in enumerate(rows)]).astype(int)
    centroids = np.concatenate([np.frombuffer(r.centroids, np.float32).reshape(-1, DIMS) for r in rows])
    return Model([r.lang for r in rows], of, centroids, np.concatenate([r.least for r in rows]), np.frombuffer(rows[0].idf, np.float32))


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", reject_as: str | None = None) -> DataFrame:
    """keep columns with lang_pred, score, rejected for every row; rejected rows get reject_as if it is given.

    A text that is null or has no letter is `und` with score 0. Texts are judged
    one by one from the text alone.
    """
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            for at in range(0, len(texts), BLOCK_DOCS):
                part = [counts(t.as_py()) for t in texts.slice(at, BLOCK_DOCS)]
                have = [i for i, c in enumerate(part) if c is not None]
                lang, score, far = ["und"] * len(part), np.zeros(len(part)), np.ones(len(part), bool)
                if have:
                    got, s, f = model.predict([part[i] for i in have])
                    score[have], far[have] = s, f
                    for i, g in zip(have, got):
                        lang[i] = model.langs[g] if g >= 0 and not (reject_as and far[i]) else reject_as or "und"
                cols = [batch.column(i).slice(at, BLOCK_DOCS) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang), pa.array(score), pa.array(far)], [*keep, "lang_pred", "score", "rejected"])

    return docs.select(*keep, text_col).mapInArrow(run, ", ".join([*kept, "lang_pred string, score double, rejected boolean"]))


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@common.tracked
def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the rows that are not held out and predicts every row: id_col, held_out, lang_pred, score, rejected.

    Rows without a language are not learned from. Without any labelled row,
    every text is `und`. Repeated rows are judged alike, texts of any length
    whole; an empty table gives an empty result; other columns are not read.
    """
    model = fit(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    own = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return predict(own, model, ["id", "held_out"]).withColumnRenamed("id", id_col)


@common.tracked
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify(common.table(spark, sf_dir, "documents"))
