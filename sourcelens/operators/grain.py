"""Sweeps over provenance grains: the same rows scored under several definitions of source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelens.functions.frames import attach, ratio, xlog2x
from sourcelens.functions.keys import KeySpec, as_spec, key

COLUMNS = [
    "grain", "n_sources", "n_spanning_sources", "n_nested_sources", "n_zero_weight_sources", "h_group", "h_group_given_source", "ratio", "uncertainty_coefficient", "n_rows", "n_units",
    "n_groups", "degeneracy",
]


def grain_map(grains: Mapping[str, KeySpec] | Sequence[str]) -> dict[str, KeySpec]:
    """label to column specification; a bare text is a TypeError, none at all a ValueError."""
    if isinstance(grains, str):
        raise TypeError(f"grains must be a mapping or a sequence of columns, not the text {grains!r}")
    out = {str(k): v for k, v in grains.items()} if isinstance(grains, Mapping) else {str(c): str(c) for c in grains}
    if not out:
        raise ValueError("a sweep needs a grain at least")
    return out


def _source_key(spec: KeySpec):
    """A grain's source as one text: the key itself, or the JSON of a composite one."""
    return key(spec) if len(as_spec(spec, "grain")) == 1 else F.when(key(spec).isNotNull(), F.to_json(F.struct(key(spec).alias("k"))))


def score_long(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows (grain, source, group, weight) scored per grain, in one pass for all grains.

    shared (unit, group, weight) are the rows that all grains have in common; their
    numbers and total are taken once and not per grain.
    """
    live = shared.agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("unit").alias("n_units"), F.count_distinct("group").alias("n_groups"))
    w = rows.groupBy("grain", "source", "group").agg(F.sum("weight").alias("weight"))
    w = attach(w, live.select("total")).withColumn("p", ratio(F.col("weight"), F.col("total")))
    by_source = w.groupBy("grain", "source").agg(F.sum("p").alias("n"), F.sum(xlog2x(F.col("p"))).alias("s"), F.count_if(F.col("p") > 0).alias("k"))
    within = F.when(F.col("k") > 1, F.greatest(xlog2x(F.col("n")) - F.col("s"), F.lit(0.0))).otherwise(0.0)
    sources = by_source.groupBy("grain").agg(
        F.sum(within).alias("h_within"), F.count(F.lit(1)).alias("n_sources"), F.count_if((F.col("n") > 0) & (F.col("k") > 1)).alias("n_spanning_sources"),
        F.count_if((F.col("n") > 0) & (F.col("k") <= 1)).alias("n_nested_sources"), F.count_if(F.col("n") <= 0).alias("n_zero_weight_sources"),
    )
    groups = w.groupBy("grain", "group").agg(F.sum("p").alias("n")).groupBy("grain").agg((-F.sum(xlog2x(F.col("n")))).alias("h"), F.count_if(F.col("n") > 0).alias("g"))
    out = attach(sources.join(groups, "grain"), live)
    out = out.withColumn("h_group", F.when(F.col("g") <= 1, F.lit(0.0)).otherwise(F.greatest(F.col("h"), F.lit(0.0))))
    out = out.withColumn("h_group_given_source", F.least("h_within", "h_group"))
    r = ratio(F.col("h_group_given_source"), F.col("h_group"))
    why = F.when(F.col("n_groups") < 2, "one group").when(F.col("n_sources") == 1, "one source").when(F.col("n_sources") == F.col("n_rows"), "a source per row").otherwise("")
    return out.withColumns({"ratio": r, "uncertainty_coefficient": 1 - r, "degeneracy": why}).select(*COLUMNS)


def score_grains(df: DataFrame, grains: Mapping[str, KeySpec] | Sequence[str], *, unit: KeySpec, group: KeySpec, weight: str | None = None, dropna: bool = True) -> DataFrame:
    """Scores every grain on the same rows: those with no null in any column that is used. Rows are exploded per grain, so df is read once.

    dropna=False raises if there is an incomplete row. The least ratio first is
    `orderBy(F.col('ratio').asc_nulls_last(), 'grain')`.
    """
    specs = grain_map(grains)
    used = [*as_spec(unit, "unit"), *as_spec(group, "group"), *[c for s in specs.values() for c in as_spec(s, "grain")], *([weight] if weight else [])]
    used = list(dict.fromkeys(used))
    absent = [c for c in used if c not in df.columns]
    if absent:
        raise KeyError(f"no columns {absent} among {df.columns}")
    incomplete = F.lit(False)
    for c in used:
        incomplete |= F.col(f"`{c}`").isNull()
    if not dropna and not df.where(incomplete).isEmpty():
        raise ValueError("there are rows with nulls in the columns of the sweep")
    labels = [F.struct(F.lit(label).alias("grain"), _source_key(spec).alias("source")) for label, spec in specs.items()]
    mass = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    whole = df.where(~incomplete)
    shared = whole.select(key(unit).alias("unit"), key(group).alias("group"), mass.alias("weight"))
    keyed = whole.select(F.explode(F.array(*labels)).alias("g"), key(group).alias("group"), mass.alias("weight"))
    return score_long(keyed.select("g.grain", "g.source", "group", "weight"), shared)


def grain_sweep(corpus, columns: Mapping[str, KeySpec] | Sequence[str]) -> DataFrame:
    """Scores a corpus's own rows under other definitions of source, taken from the columns of its records.

    Rows are matched by their position. A row without a value for one of the grains is an error.
    """
    specs = grain_map(columns)
    absent = [c for s in specs.values() for c in as_spec(s, "grain") if c not in corpus.records.columns]
    if absent:
        raise KeyError(f"no columns {absent} among {corpus.records.columns}")
    texts = [F.struct(F.lit(label).alias("grain"), _source_key(spec).alias("source")) for label, spec in specs.items()]
    sources = corpus.records.select("row_position", F.explode(F.array(*texts)).alias("g")).select("row_position", "g.grain", "g.source")
    rows = corpus.projection.where("analysis_included").select("row_position", "group", "weight").join(sources, "row_position")
    if lost := rows.where("source is null").limit(1).collect():
        raise ValueError(f"a row has no value for grain {lost[0].grain!r}")
    return score_long(rows.select("grain", "source", "group", "weight"), corpus.frame)


def ranked(scores: DataFrame, ascending: bool = True) -> DataFrame:
    """By ratio, undefined ones last."""
    by = F.col("ratio").asc_nulls_last() if ascending else F.col("ratio").desc_nulls_last()
    return scores.orderBy(by, "grain")


def declare_grain(row: dict, name: str = "corpus") -> str:
    """One sentence that states a score together with its grain and weighting."""
    value = "undefined" if row.get("ratio") is None else f"{row['ratio']:.4f}"
    text = f"In {name}, with {row['grain']} as the source ({row['n_sources']} sources, {row['n_rows']} rows, {row.get('weighting', 'incidence rows')}), the residual label entropy is {value} of the whole"
    return text + (f"; note: {row['degeneracy']}." if row.get("degeneracy") else ".")
