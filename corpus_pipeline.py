"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, tokenization.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame that is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import bpe, common, jaccard, lines, mixing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Null texts and texts of fewer than 50 words are among them; equal rows are judged alike; no rows give no rows."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the blocks of lines that an earlier document has; documents that lose all their words go. n_chars follows the text.

    Null and empty texts pass unchanged. Equal rows are one document and stay
    alike. Columns of any name pass, lines__* too.
    """
    out = lines.deduped(docs)
    worded = F.btrim(common.text_or_empty(F.col("row.text")), F.lit(common.SPACE)) != ""
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("n_deleted") > 0, F.length("row.text").cast(docs.schema["n_chars"].dataType)).otherwise(cols["n_chars"])
    return out.where((F.col("n_deleted") == 0) | worded).select(*[x.alias(c) for c, x in cols.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the least id; of equal rows one. Texts without a word all stay."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go until each source has its share. Documents without a word go; a null source is a source."""
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix; a null text has no token. Row by row, so repeats and extra columns do not matter."""
    return bpe.encode_decode(docs, bpe.tokenizer_path())


STAGES = [
    ("quality_rules", common.tracked(quality_rules)), ("line_dedup", common.tracked(line_dedup)), ("near_duplicates", common.tracked(near_duplicates)),
    ("mix_sources", common.tracked(mix_sources)), ("tokenize", common.tracked(tokenize)),
]

#: Alignment, verified similarity and byte-pair merges have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of sf_dir.

    A stage's output goes once the next one is written, and with it the tables
    that the stage wrote for itself. common.release(result) deletes what the
    result is read from.
    """
    docs, before, kept = common.table(spark, sf_dir, "documents"), None, common.Tables()
    for name, f in STAGES[:-1]:
        with common.Tables() as own:
            out = common.written(f(spark, docs, sf_dir), f"pipeline-{name}", kept)
        own.release()
        if before is not None:
            common.discard(before)
        docs = before = out
    with kept:
        out = STAGES[-1][1](spark, docs, sf_dir)
    out._tables = kept
    return out
