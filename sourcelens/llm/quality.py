"""Quality rules with adaptive thresholds.

Every document gets a few rates. Per language and source the rates go into
quantile sketches: histograms over a fixed logarithmic grid of whole numbers,
which merge by adding counts, so the result depends neither on the order of
rows nor on how tasks split them. A sketch holds the rate with half an event
added: a document of n words without an event still says that its rate lies
about 1 / 2n, so sketches of mostly zeros have a spread too, set by the lengths
of their documents. Fences lie SPREAD interquartile ranges beyond the quartiles
on the grid, that is by ratios, not differences. No fixed margin takes part.

To the sketch of a group that of its language is added as PRIOR documents at its
evenly spaced quantiles, and to that of a language the one over everything:
small groups lean on their parents, large ones on themselves, without a switch. A
document fails a rate if even the rate less two standard deviations of its own
count lies beyond the fence, so that short documents are not judged by chance.
A join of the fences to the documents gives the verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcelens.llm import common

#: The symbols that count.
SYMBOLS = "[#*$%&|<>]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rate and interquartile ranges (of the logarithm) from quartile to fence; only word length has a lower fence too.
RATES = [("symbol_rate", 2), ("dup_line_rate", 2), ("repeat_rate", 2), ("word_length", 4)]
TWO_SIDED = ("word_length",)
#: Documents that a parent's sketch counts for in that of its child.
PRIOR = 20
#: Rates are whole numbers: parts of a thousand million.
UNIT = 1_000_000_000
#: Groups whose fences may be broadcast.
BROADCAST_GROUPS = 20_000
#: The grid splits each power of two into this many steps (as a power of two).
GRID_BITS = 8


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(grams: Column) -> Column:
        ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.array_compact(F.transform(s, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"]))))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        add = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end"))
        return F.aggregate(common.let(ranked, places), start, add, lambda a: a["n"])

    def count(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(covered(grams))

    grams = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(common.let(grams, count))


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base columns, the number of lines with a word, and base_failed."""
    text = common.text_or_empty(F.col(text_col))
    by_word = common.let(
        common.words(F.col(text_col)),
        lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("repeats")),
    )
    by_line = common.let(
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(common.SPACE)) != ""),
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dups")),
    )
    n_symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
    # an explode of one element: Catalyst moves no filter below it, so the measures are computed once
    measures = F.struct(by_word.alias("w"), by_line.alias("l"), n_symbols.cast("long").alias("s"))
    out = docs.select("*", F.explode(F.array(measures)).alias("m")).withColumns({
        "n_words": F.col("m.w.n").cast("long"), "word_chars": F.col("m.w.chars").cast("long"), "n_repeat_words": F.col("m.w.repeats").cast("long"),
        "n_lines": F.col("m.l.n").cast("long"), "n_dup_lines": F.col("m.l.dups").cast("long"), "n_symbols": F.col("m.s"),
    }).drop("m")
    n = F.col("n_words")
    return out.withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))


def _counts() -> dict[str, tuple[Column, Column]]:
    """Events and places of the rates that are shares."""
    c = F.col
    return {"symbol_rate": (c("n_symbols"), c("n_words")), "dup_line_rate": (c("n_dup_lines"), c("n_lines")), "repeat_rate": (c("n_repeat_words"), c("n_words"))}


def _part(a: Column, b: Column) -> Column:
    """floor(UNIT * a / b), 1 at least; null without places."""
    return F.when(b > 0, F.greatest(F.call_function("div", F.lit(UNIT) * a, b), F.lit(1)))


def rates() -> dict[str, Column]:
    """What the sketches hold: rates with half an event added, and the mean word length."""
    out = {r: _part(2 * a + 1, 2 * b) for r, (a, b) in _counts().items()}
    return out | {"word_length": _part(F.col("word_chars"), F.col("n_words"))}


def least_rates() -> dict[str, Column]:
    """What is held against the fences: rates less two standard deviations of the count (its root), and the mean word length."""
    out = {r: _part(F.greatest(a - F.floor(F.sqrt(4 * a)), F.lit(0)), b) for r, (a, b) in _counts().items()}
    return out | {"word_length": rates()["word_length"]}


def grid(v: Column) -> Column:
    """v's step on the sketch's grid: 2^GRID_BITS steps for each power of two, whole numbers below."""
    shift = F.greatest(F.length(F.bin(v)) - 1 - GRID_BITS, F.lit(0))
    return (F.call_function("shiftleft", shift.cast("long"), F.lit(GRID_BITS)) + F.call_function("shiftright", v, shift)).cast("long")


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Sketches per language and source as rows lang, source, rate, bucket, n; they merge by adding n."""
    values = F.array(*[F.struct(F.lit(name).alias("rate"), grid(v).alias("bucket")) for name, v in rates().items()])
    rows = measured.where(~F.col("base_failed")).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(values))
    return rows.groupBy("lang", "source", "rate", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _summed(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches merged per value of by, with running and whole sums over the buckets."""
    merged = sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rate")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    return merged.withColumns({"upto": upto, "total": F.sum("n").over(group)})


def _as_prior(summed: DataFrame, *by: str) -> DataFrame:
    """A sketch of PRIOR documents that lie at the evenly spaced quantiles of a sketch: PRIOR rows a rate at most."""
    below = lambda upto: F.call_function("div", 2 * PRIOR * upto + F.col("total"), 2 * F.col("total"))
    return summed.select(*by, "rate", "bucket", (below(F.col("upto")) - below(F.col("upto") - F.col("n"))).alias("n")).where("n > 0")


def fences(sketch: DataFrame) -> DataFrame:
    """One row per language and source with the fences low_<rate> and high_<rate>, as steps of the grid."""
    cols = ["lang", "source", "rate", "bucket", "n"]
    top = _as_prior(_summed(sketch)).withColumn("one", F.lit(1))
    langs = sketch.select("lang").distinct().withColumn("one", F.lit(1)).join(F.broadcast(top), "one")  # PRIOR rows a rate
    by_lang = _as_prior(_summed(sketch.select("lang", "rate", "bucket", "n").unionByName(langs.drop("one")), "lang"), "lang").withColumnRenamed("lang", "l")
    groups = sketch.select("lang", "source").distinct().join(by_lang, F.col("lang").eqNullSafe(F.col("l")))
    summed = _summed(sketch.select(*cols).unionByName(groups.select(*cols)), "lang", "source")
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket")))
    q = summed.groupBy("lang", "source", "rate").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    times = reduce(lambda a, r: a.when(F.col("rate") == r[0], F.lit(r[1])), RATES, F.when(F.lit(False), F.lit(0)))
    spread = times * F.greatest(F.col("q3") - F.col("q1"), F.lit(1))  # one step of the grid where all values are one
    q = q.withColumns({"high": F.col("q3") + spread, "low": F.col("q1") - spread})
    of = [F.max(F.when(F.col("rate") == r, F.col(x))).alias(f"{x}_{r}") for r, _ in RATES for x in ("low", "high")]
    out = q.groupBy("lang", "source").agg(*of)
    return out.select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), F.struct(*[f"{x}_{r}" for r, _ in RATES for x in ("low", "high")]).alias("fence"))


def judged(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """measured with the verdict column; the fence columns go again."""
    on = F.col(lang).eqNullSafe(F.col("fence_lang")) & F.col(source).eqNullSafe(F.col("fence_source"))
    fence = F.col("fence")
    inside = [grid(v) <= fence[f"high_{r}"] for r, v in least_rates().items()]
    inside += [grid(least_rates()[r]) >= fence[f"low_{r}"] for r in TWO_SIDED]
    good = F.coalesce(reduce(lambda a, b: a & b, inside), F.lit(False))
    # groups without a document that passes the base rules have no fence, and need none
    return measured.join(limits, on, "left").withColumn("kept", ~F.col("base_failed") & good).drop("fence", "fence_lang", "fence_source")


@common.tracked
def quality(docs: DataFrame, lang: str = "lang", source: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base columns and verdict for every row of docs.

    Returns id_col, the base columns, base_failed, kept. A null text has no
    words and fails. Null languages and sources are groups of their own. Repeated
    rows are judged alike; an empty table gives an empty result; columns besides
    the four named are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    measured = common.written(with_base(own).drop("text"), "quality")
    out = judged(measured, fences(sketches(measured)))
    return out.select(F.col("id").alias(id_col), *BASE, "base_failed", "kept")


@common.tracked
def keep_good(docs: DataFrame, lang: str = "lang", source: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs that quality() keeps, with the columns of docs and no other; rows of any name, repeated and empty as there.

    Rows are written with their measures once, for the sketches and the filter;
    no text is shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # so that no name of docs meets one of ours
    own = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    measured = common.written(with_base(own).drop("text").where(~F.col("base_failed")), "measured")
    limits = common.written(fences(sketches(measured)), "fences")
    if limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)  # some hundred bytes a group; beyond the bound the join shuffles
    return judged(measured, limits).where("kept").select("row.*")


@common.tracked
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document."""
    return quality(common.table(spark, sf_dir, "documents"))


_COUNTS_SQL = {"symbol_rate": ("n_symbols", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words")}
_part_sql = lambda a, b: f"greatest({UNIT} * ({a}) // nullif({b}, 0), CASE WHEN {b} > 0 THEN 1 END)"
_LENGTH_SQL = {"word_length": _part_sql("word_chars", "n_words")}
_RATES_SQL = {r: _part_sql(f"2 * {a} + 1", f"(2 * {b})") for r, (a, b) in _COUNTS_SQL.items()} | _LENGTH_SQL
_LEAST_SQL = {r: _part_sql(f"greatest({a} - floor(sqrt(4 * {a}))::BIGINT, 0)", b) for r, (a, b) in _COUNTS_SQL.items()} | _LENGTH_SQL
_grid_sql = lambda v: "(greatest(length(bin({v})) - 1 - {b}, 0) * {n} + ({v} >> greatest(length(bin({v})) - 1 - {b}, 0)))".format(v=v, b=GRID_BITS, n=1 << GRID_BITS)
_inside = " AND ".join(f"g.{r} <= high_{r}" + (f" AND g.{r} >= low_{r}" if r in TWO_SIDED else "") for r, _ in RATES)
_edges = ", ".join(f"max(q3 + spread) FILTER (rate = '{r}') AS high_{r}, max(q1 - spread) FILTER (rate = '{r}') AS low_{r}" for r, _ in RATES)
_spread = f"greatest(q3 - q1, 1) * CASE rate {' '.join(f"WHEN '{r}' THEN {k}" for r, k in RATES)} END"


def _summed_sql(relation: str, by: str) -> str:
    part = f"OVER (PARTITION BY {by}rate"
    merged = f"SELECT {by}rate, bucket, sum(n)::BIGINT AS n FROM {relation} GROUP BY ALL"
    return f"(SELECT *, (sum(n) {part} ORDER BY bucket ROWS UNBOUNDED PRECEDING))::BIGINT AS upto, (sum(n) {part}))::BIGINT AS total FROM ({merged}))"


def _prior_sql(relation: str, by: str) -> str:
    below = lambda upto: f"({2 * PRIOR} * {upto} + total) // (2 * total)"
    return f"(SELECT {by}rate, bucket, {below('upto')} - {below('(upto - n)')} AS n FROM {_summed_sql(relation, by)} WHERE {below('upto')} > {below('(upto - n)')})"


#: DuckDB SQL up to a relation judged(<columns of documents>, base columns, base_failed, kept) over the relation `docs_in`.
JUDGED_SQL = f"""
q_words AS (SELECT *, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM docs_in),
q_grams AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM q_words WHERE len(w) >= 3)),
q_rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM q_grams) WHERE n > 1),
q_cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM q_rep) GROUP BY rid),
q_base AS (SELECT q_words.* EXCLUDE (w, ls), len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(q_cov.n, 0)::BIGINT AS n_repeat_words
    FROM q_words LEFT JOIN q_cov USING (rid)),
q_failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q_base),
q_least AS (SELECT rid, """ + ", ".join(f"({v})::BIGINT AS {r}" for r, v in _LEAST_SQL.items()) + """ FROM q_failed),
q_steps AS (SELECT rid, """ + ", ".join(f"{_grid_sql(r)} AS {r}" for r, _ in RATES) + """ FROM q_least),
q_values AS (""" + " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, ({v})::BIGINT AS v FROM q_failed WHERE NOT base_failed" for r, v in _RATES_SQL.items()) + f"""),
q_sketch AS (SELECT lang, source, rate, {_grid_sql("v")} AS bucket, count(*) AS n FROM q_values GROUP BY ALL),
q_top AS {_prior_sql("q_sketch", "")},
q_lang AS (SELECT lang, rate, bucket, n FROM q_sketch UNION ALL SELECT l.lang, t.* FROM (SELECT DISTINCT lang FROM q_sketch) l, q_top t),
q_own AS (SELECT * FROM q_sketch UNION ALL SELECT g.lang, g.source, p.rate, p.bucket, p.n FROM (SELECT DISTINCT lang, source FROM q_sketch) g
    JOIN {_prior_sql("q_lang", "lang, ")} p ON g.lang IS NOT DISTINCT FROM p.lang),
q_quart AS (SELECT lang, source, rate, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3
    FROM {_summed_sql("q_own", "lang, source, ")} GROUP BY ALL),
q_limits AS (SELECT lang, source, {_edges} FROM (SELECT *, {_spread} AS spread FROM q_quart) GROUP BY ALL),
judged AS (SELECT q_failed.*, NOT base_failed AND coalesce({_inside}, false) AS kept
    FROM q_failed JOIN q_steps g USING (rid) LEFT JOIN q_limits l ON q_failed.lang IS NOT DISTINCT FROM l.lang AND q_failed.source IS NOT DISTINCT FROM l.source)"""

ORACLE = f"WITH docs_in AS (SELECT * FROM documents), {JUDGED_SQL.strip()} SELECT doc_id, {', '.join(BASE)}, base_failed, kept FROM judged"
