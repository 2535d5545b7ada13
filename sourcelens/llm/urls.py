"""URL filters from association rules.

Some URLs have a verdict from a list of host and path rules. FP-growth mines
the token combinations of those URLs together with their verdict; rules that
imply a verdict with enough confidence and support, and that no shorter rule
makes redundant, judge the other URLs. Each mined rule stands in an inverted
index under its rarest token only, so a URL meets few candidates, whose other
tokens are then checked. Verdicts are made once per distinct URL.
"""

from __future__ import annotations



from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import common

#: Verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Share of the labelled URLs that a mined combination needs.
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
#: Length to which the tests' brute force lists combinations; mined rules have any length.
MOST_TOKENS = 3
#: The verdict where no rule matches.
DEFAULT = "allow"

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LABEL = "="


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without one."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fitting(rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits columns host and path, as struct(rule, verdict); null for none."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in longest])


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments with their place, extension, names of query parameters, fragment."""
    tag = lambda t, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(t), x))
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    placed = F.transform(segments, lambda x, i: F.concat(F.lit("path"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), x))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(
        tag("scheme:", F.array(F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))), tag("host:", F.split(host(url), r"\.")), placed,
        tag("extension:", F.array(F.regexp_extract(path(url), r"\.([A-Za-z0-9]{1,8})$", 1))), tag("query:", names),
        tag("fragment:", F.array(F.regexp_extract(url, "(?s)#(.*)$", 1))),
    ))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """labelled (tokens, verdict) to pruned rules: antecedent, verdict, confidence, support, anchor (the rarest token)."""
    items = labelled.select(F.array_append("tokens", F.concat(F.lit(_LABEL), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    mined = model.associationRules.where(F.col("consequent")[0].startswith(_LABEL)).where(~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
    rules = mined.select(
        F.array_sort("antecedent").alias("antecedent"), F.regexp_replace(F.col("consequent")[0], f"^{_LABEL}", "").alias("verdict"), "confidence", "support"
    )
    rules = common.written(rules, "rules")
    # redundant: a rule for the same verdict with one token less has as much confidence
    shorter = rules.select(F.col("antecedent").alias("a"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    less = rules.select("antecedent", "verdict", "confidence", F.explode(F.transform("antecedent", lambda x: F.array_remove("antecedent", x))).alias("part"))
    redundant = less.join(shorter, (F.col("part") == F.col("a")) & (F.col("verdict") == F.col("v")) & (F.col("c") >= F.col("confidence")), "left_semi")
    rules = rules.join(redundant.select("antecedent", "verdict"), ["antecedent", "verdict"], "left_anti")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq"))
    each = rules.withColumn("token", F.explode("antecedent")).join(single, "token")
    anchors = each.groupBy("antecedent", "verdict").agg(F.min(F.struct("freq", "token")).alias("m"))
    return rules.join(anchors, ["antecedent", "verdict"]).select("antecedent", "verdict", "confidence", "support", F.col("m.token").alias("anchor"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, tokens) that some rule matches: url, verdict, confidence of the best one.

    The best rule has the most confidence, then support, then tokens; ties go to
    the last antecedent in order.
    """
    index = rules.withColumnRenamed("verdict", "mined")
    met = urls.withColumn("anchor", F.explode("tokens")).join(index, "anchor").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    rank = F.struct("confidence", "support", F.size("antecedent").alias("n"), "antecedent", "mined")
    return met.groupBy("url").agg(F.max(rank).alias("best")).select("url", F.col("best.mined").alias("mined"), F.col("best.confidence").alias("confidence"))


@common.tracked
def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict for every row of pages.

    Returns id_col, host, path, rule (of the given list, else null), verdict, confidence
    (of the mined rule that decided, else null). A null url, or one without ://,
    has an empty host and path and gets the default verdict. Repeated urls are
    judged once and alike, urls of any length whole; an empty table gives an empty
    result; other columns are not read. If no URL has a
    verdict from the list, or nothing is mined, the default decides.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    own = own.withColumn("fit", fitting(rules))
    distinct = common.written(own.where("url is not null").select("url", "fit").distinct().withColumn("tokens", tokens(F.col("url"))), "urls")
    labelled = distinct.where("fit is not null").select("tokens", F.col("fit.verdict").alias("verdict"))
    if labelled.isEmpty():
        judged = own.withColumns({"mined": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    else:
        found = match(distinct.where("fit is null").select("url", "tokens"), mine(labelled, min_support, min_confidence))
        judged = own.join(found, "url", "left")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "mined", F.lit(DEFAULT)).alias("verdict"), "confidence"
    )


@common.tracked
def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL verdicts of all pages."""
    return url_filter(common.table(spark, sf_dir, "pages"))
