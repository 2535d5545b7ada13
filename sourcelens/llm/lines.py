"""Line dedup by pairwise alignment.

Documents find each other through the hashes of shared rare lines, are aligned
by patience diff, and the aligned common blocks are deleted from the later one.
Blocks of MIN_LINES lines or MIN_CHARS characters are deleted; lines without a
word take no part. How many documents hold a line is counted first; lines that
one document holds alone are in no shared block and go no further.

A block that may be deleted is covered by the shortest runs of lines in it that
may be deleted themselves. The key of such a run is its rarest line: if RARE
documents hold that line at most, each later holder meets every earlier one. If
all its lines are commoner, the key is the whole run, and each later holder
meets the first holder only, which has the whole run too. So a line that is very
common costs one link per document, and no key is too common to be used.

Shared runs that patience leaves (blocks that cross, lines that repeat) are
aligned at their first place in the earlier document. So a line with a word goes
exactly if it lies in a run that may be deleted and that an earlier document has.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import common

#: A block is deleted if it has this many lines with a word, or this many characters.
MIN_LINES = 3
MIN_CHARS = 200
#: Documents that hold a rare line at most; they meet each other, holders of commoner runs the first one.
RARE = 8

_KEY = "struct<known:boolean,id:bigint,text:bigint>"


def _doc_key(id_col: Column, text: Column) -> Column:
    """The document's identity and place in the order: null ids first, then by id; equal rows are one document."""
    return F.struct(id_col.isNotNull().alias("known"), F.coalesce(id_col.cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("text"))


def worded_lines(docs: DataFrame) -> DataFrame:
    """docs (key, text) to one row per key: key, w, an array of the lines with a word.

    begin and end are the lines of the text that go if the line does; the first
    and last line with a word take the empty ones beside them along. h and g are
    128 bits of hash: h finds, both must agree for lines to be equal.
    """
    def build(x: Column) -> Column:
        w = x["w"]
        return F.transform(w, lambda s, k: F.struct(
            F.when(k == 0, 0).otherwise(s["i"]).alias("begin"), F.when(k == F.size(w) - 1, x["n"]).otherwise(s["i"] + 1).alias("end"),
            F.xxhash64(s["v"]).alias("h"), F.xxhash64(F.lit(1), s["v"]).alias("g"), F.length(s["v"]).alias("size"),
        ))

    split = F.split("text", "\n")
    trimmed = F.transform(split, lambda x, i: F.struct(F.btrim(x, F.lit(common.SPACE)).alias("v"), i.alias("i")))
    rows = docs.select("key", common.let(F.struct(F.filter(trimmed, lambda s: s["v"] != "").alias("w"), F.size(split).alias("n")), build).alias("w"))
    return rows.where(F.size("w") > 0).groupBy("key").agg(F.first("w").alias("w"))


def shared_lines(lines: DataFrame) -> DataFrame:
    """worded_lines() to key, z: the lines that two documents hold at least, in order, with pos (place among those with a word) and n (how many hold it)."""
    held = lines.select(F.explode(F.array_distinct(F.transform("w", lambda x: x["h"]))).alias("h"))
    often = common.written(held.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    each = lines.select("key", F.posexplode("w").alias("pos", "x")).select("key", "pos", "x.*")
    return each.join(often, "h").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "begin", "end", "h", "g", "size", "n"))).alias("z"))


def finding_keys(shared: DataFrame) -> DataFrame:
    """key, rare, f: the distinct keys of every run of runs()."""

    def keys(z: Column, n: int) -> Column:
        def one(_: Column, i: Column) -> Column:
            at = [F.get(z, i + k) for k in range(n)]
            total = lambda part: sum((v["size"] for v in part), F.lit(0))
            ok = at[-1]["pos"] - at[0]["pos"] == n - 1
            ok &= (F.lit(n >= MIN_LINES) | (total(at) >= MIN_CHARS)) & ((total(at[:-1]) < MIN_CHARS) | (total(at[1:]) < MIN_CHARS))
            rarest = F.array_min(F.array(*[F.struct(v["n"].alias("n"), v["h"].alias("h")) for v in at]))
            run = F.xxhash64(F.lit(n), *[v[c] for v in at for c in ("h", "g")])
            return F.when(ok, common.let(rarest, lambda r: F.struct((r["n"] <= RARE).alias("rare"), F.when(r["n"] <= RARE, r["h"]).otherwise(run).alias("f"))))

        return F.transform(F.slice(z, 1, F.greatest(F.size(z) - (n - 1), F.lit(0))), one)

    every = F.concat(*[keys(F.col("z"), n) for n in range(1, MIN_LINES + 1)])
    return shared.select("key", F.explode(F.array_compact(F.array_distinct(every))).alias("k")).select("key", "k.*")


def runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs [start, end) of worded lines that may be deleted and that lose this without their first or without their last line.

    Every longer run that may be deleted is covered by such runs inside it.
    """
    for i in range(len(sizes)):
        for n in range(1, min(MIN_LINES, len(sizes) - i) + 1):
            part = sizes[i : i + n]
            if (n >= MIN_LINES or sum(part) >= MIN_CHARS) and (sum(part[:-1]) < MIN_CHARS or sum(part[1:]) < MIN_CHARS):
                yield i, i + n


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Maximal common blocks (start in a, start in b, length) of the patience diff, in order."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        n = 0
        while a0 + n < a1 and b0 + n < b1 and a[a0 + n] == b[b0 + n]:
            n += 1
        if n:
            found.append((a0, b0, n))
        a0, b0, n = a0 + n, b0 + n, 0
        while a0 < a1 - n and b0 < b1 - n and a[a1 - 1 - n] == b[b1 - 1 - n]:
            n += 1
        if n:
            found.append((a1 - n, b1 - n, n))
        a1, b1 = a1 - n, b1 - n
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if once_b[b[j]] == 1}
        both = [(i, place[a[i]]) for i in range(a0, a1) if once_a[a[i]] == 1 and a[i] in place]
        if not both:
            continue
        # longest increasing run of places in b
        ends, at, back = [], [], []
        for k, (_, j) in enumerate(both):
            p = bisect_left(ends, j)
            ends[p:p + 1] = [j]
            at[p:p + 1] = [k]
            back.append(at[p - 1] if p else -1)
        chain, k = [], at[-1]
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        chain = [*reversed(chain), (a1, b1)]
        todo.append((a0, chain[0][0], b0, chain[0][1]))
        todo += [(i, i2, j, j2) for (i, j), (i2, j2) in zip(chain, chain[1:])]
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def _sequence(pos: list[int], codes: list, side: str) -> tuple[list, list[int]]:
    """Shared lines as a sequence to align, and the number of each; a gap, equal to nothing, stands where lines between are not shared."""
    out, at = [], []
    for k, (p, code) in enumerate(zip(pos, codes)):
        if k and p != pos[k - 1] + 1:
            out.append((side, k))
            at.append(-1)
        out.append(code)
        at.append(k)
    return out, at


def common_lines(pos: list[int], codes: list, sizes: list[int], other_pos: list[int], other_codes: list) -> list[int]:
    """Which shared lines of the later document common blocks of enough lines or characters cover, in order."""
    own, at = _sequence(pos, codes, "own")
    held, _ = _sequence(other_pos, other_codes, "other")
    size = [sizes[k] if k >= 0 else 0 for k in at]
    blocks = [(i, n) for i, _, n in patience(own, held) if n >= MIN_LINES or sum(size[i : i + n]) >= MIN_CHARS]
    block = [-1] * len(own)
    for k, (i, n) in enumerate(blocks):
        block[i : i + n] = [k] * n
    gaps = [-1, *(i for i, k in enumerate(at) if k < 0), len(at)]
    parts = [(x + 1, y) for x, y in zip(gaps, gaps[1:]) if y > x + 1]
    left = [(x + a, x + b) for x, y in parts for a, b in runs(size[x:y]) if block[x + a] < 0 or block[x + a] != block[x + b - 1]]
    if left:
        known = {tuple(held[j : j + n]) for n in range(1, MIN_LINES + 1) for j in range(len(held) - n + 1)}
        blocks += [(a, b - a) for a, b in left if tuple(own[a:b]) in known]
    return sorted({at[k] for i, n in blocks for k in range(i, i + n)})


def links(keys: DataFrame) -> DataFrame:
    """key, first: every document with earlier ones that hold a key of it: all of them for rare lines, the first for commoner runs."""
    keys = common.written(keys, "keys")
    holders = keys.where("rare").groupBy("f").agg(F.sort_array(F.collect_list("key")).alias("k")).where(F.size("k") > 1)  # RARE of them at most
    earlier = F.flatten(F.transform("k", lambda x, i: F.transform(F.slice("k", 1, i), lambda y: F.struct(x.alias("key"), y.alias("first")))))
    rare = holders.select(F.explode(earlier).alias("x")).select("x.*")
    common_keys = keys.where("not rare").select("key", "f")
    first = common.written(common_keys.groupBy("f").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    return common_keys.join(first, "f").where(F.col("key") != F.col("first")).select("key", "first").unionByName(rare).distinct()


def deletions(lines: DataFrame) -> DataFrame:
    """key, spans, sources: what to delete from each document that has anything to delete, and the ids of the earliest documents that it was found in."""
    shared = common.written(shared_lines(lines), "shared")
    pairs = links(finding_keys(shared))
    other = shared.select(F.col("key").alias("first"), F.col("z").alias("other"))
    pairs = pairs.join(shared, "key").join(other, "first").select("key", "first", "z", "other")

    def columns(z: pa.ListArray, *names: str) -> Iterator[list[list]]:
        z, cut = z.flatten(), z.offsets.to_numpy() - z.offsets[0].as_py()
        cols = [z.field(n).to_pylist() for n in names]
        for a, b in zip(cut, cut[1:]):
            yield [c[a:b] for c in cols]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (pos, begin, end, h, g, size), (p, oh, og) in zip(columns(batch["z"], "pos", "begin", "end", "h", "g", "size"), columns(batch["other"], "pos", "h", "g")):
                gone = common_lines(pos, list(zip(h, g)), size, p, list(zip(oh, og)))
                out.append([{"pos": pos[k], "start": begin[k], "end": end[k]} for k in gone])
            line = pa.list_(pa.struct([("pos", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["first"], pa.array(out, line)], ["key", "first", "gone"])

    aligned = pairs.mapInArrow(align, f"key {_KEY}, first {_KEY}, gone array<struct<pos:int,start:int,end:int>>").where(F.size("gone") > 0)
    each = F.transform("gone", lambda g: F.struct(g["pos"].alias("pos"), F.col("first").alias("first"), g["start"].alias("start"), g["end"].alias("end")))
    every = aligned.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("x"))
    once = F.filter("x", lambda g, i: (i == 0) | (F.get(F.col("x"), i - 1)["pos"] != g["pos"]))  # each line with the earliest document that has it
    out = every.select("key", once.alias("gone"))
    return out.withColumn("sources", F.array_sort(F.array_distinct(F.transform("gone", lambda g: g["first"]["id"]))))


def _left(text: Column, gone: Column) -> Column:
    """The lines of a text that stay: lines without a word between two that go in a row go too."""
    after = lambda i: F.coalesce(F.get(gone, i + 1)["pos"] == F.get(gone, i)["pos"] + 1, F.lit(False))
    spans = F.transform(gone, lambda g, i: F.struct(g["start"].alias("a"), F.when(after(i), F.get(gone, i + 1)["start"]).otherwise(g["end"]).alias("b")))
    return common.let(spans, lambda s: F.filter(F.split(text, "\n"), lambda _, i: ~F.exists(s, lambda x: (i >= x["a"]) & (i < x["b"]))))


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (docs with what is left of the text), n_lines, n_deleted, sources; see line_dedup()."""
    c = lambda name: F.col(f"`{name}`")
    row = F.struct(*[c(x) for x in docs.columns])
    keyed = docs.select(row.alias("row"), c(text_col).alias("text"), _doc_key(c(id_col), c(text_col)).alias("key"))
    lines = common.written(worded_lines(keyed.where("text is not null").select("key", "text")), "lines")
    gone = common.written(deletions(lines), "deletions").withColumnRenamed("key", "at")
    # the same plan at every size: texts are shuffled once, by their key, and stand in the row only
    out = keyed.drop("text").join(gone.hint("merge"), F.col("key") == F.col("at"), "left").withColumn("text", F.col(f"row.`{text_col}`"))
    out = out.withColumns({
        "n_lines": F.coalesce(F.size(F.split("text", "\n")), F.lit(0)), "left": F.when(F.col("gone").isNotNull(), _left(F.col("text"), F.col("gone"))),
        "sources": F.coalesce("sources", F.array().cast("array<bigint>")),
    })
    text = F.coalesce(F.array_join("left", "\n"), F.col("text"))
    row = F.struct(*[(text if x == text_col else F.col(f"row.`{x}`")).alias(x) for x in docs.columns])
    return out.select(row.alias("row"), "n_lines", F.coalesce(F.col("n_lines") - F.size("left"), F.lit(0)).alias("n_deleted"), "sources")


@common.tracked
def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated blocks of lines deleted from text_col, and lines__n, lines__deleted, lines__sources added.

    Documents are in the order of their ids (null first), then of a hash of their
    text; rows that are equal in both are one document and treated alike. A line
    is compared without the white space around it. Lines without a word go where
    the nearest lines with a word before and after them, as far as there are any,
    go. Null texts stay null and empty texts empty; texts whose lines all go
    become empty. lines__sources holds the ids of the documents that the deleted
    blocks stay in. Ids must cast to long. An empty table gives an empty
    result; columns of docs with one of the three added names are replaced.
    """
    own = {"lines__n": "n_lines", "lines__deleted": "n_deleted", "lines__sources": "sources"}
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in own]
    return deduped(docs, id_col, text_col).select(*kept, *[F.col(x).alias(n) for n, x in own.items()])


@common.tracked
def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents: what each lost and a digest of what is left."""
    out = line_dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("lines__n").alias("n_lines"), F.col("lines__deleted").alias("n_deleted"), F.col("lines__sources").alias("source_ids"),
        F.sha2(common.text_or_empty(F.col("text")), 256).alias("left_sha256"),
    )
