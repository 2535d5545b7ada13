"""Keys: normalized text, or a struct of normalized texts for composite keys.

Composite keys are structs and never joined with a delimiter, so two different
tuples cannot meet in one text. Structs group, join and sort like tuples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelens.functions.frames import kept

#: Texts that stand for a missing key, compared without case.
MISSING = ("", "nan", "none", "<na>")
#: All Unicode white space and the ASCII separators: what Python's str.strip() removes.
SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

KeySpec = str | Sequence[str]


def stripped(value: Column) -> Column:
    """Text without white space at its ends, of any Unicode kind."""
    return F.btrim(value.cast("string"), F.lit(SPACE))


def text_key(value: Column, missing: Sequence[str] = MISSING) -> Column:
    """Normalized text, null if missing."""
    text = stripped(value)
    return F.when(F.lower(text).isin(*missing), F.lit(None).cast("string")).otherwise(text)


def as_spec(spec: KeySpec, role: str) -> tuple[str, ...]:
    """The column names of a role: one name, or several distinct ones."""
    names = (spec,) if isinstance(spec, str) else tuple(spec)
    if not names or any(not isinstance(n, str) or not n for n in names):
        raise TypeError(f"{role} needs a column name or a sequence of column names, got {spec!r}")
    if len(set(names)) != len(names):
        raise ValueError(f"{role} names a column twice: {names}")
    return names


def key(spec: KeySpec, role: str = "key") -> Column:
    """The key of one or several columns; a composite key is null if any part is."""
    parts = [text_key(F.col(f"`{c}`")) for c in as_spec(spec, role)]
    if len(parts) == 1:
        return parts[0]
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known &= p.isNotNull()
    return F.when(known, F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)]))


def key_text(column: Column, dtype: str) -> Column:
    """A key as one readable text, for reports only: parts joined by ' | '."""
    if dtype.startswith("struct"):
        n = dtype.count(":")
        return F.concat_ws(" | ", *[column[f"c{i}"] for i in range(n)])
    return column.cast("string")


def with_row_position(df: DataFrame, name: str = "row_position") -> DataFrame:
    """df with a dense zero-based position in the order of its partitions.

    The numbered rows are computed once and kept, as a second computation might
    deal them to other partitions. Partition sizes are counted then; one row per
    partition is broadcast. Tables that have a unique position need none of this.
    """
    from pyspark.sql import Window

    raw = kept(df.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = raw.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__offset"))
    out = raw.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    within = F.col("__id") - F.shiftleft(F.col("__part").cast("long"), 33)
    return out.withColumn(name, F.col("__offset") + within).drop("__id", "__part", "__offset")
