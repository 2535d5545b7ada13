"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of hashed 5-word shingles; equal word sequences are one text. A
signature has TREES labels of MAX_DEPTH min-hashes, each a path in a prefix
trie. Two texts are candidates if they lie in the same node of some tree. The
tries are descended level by level, from the shortest prefix on: a node with
NODE texts at most is used as it is, a larger one is divided by the next
min-hash, down to the longest prefix by which a pair at the threshold is still
found with the target recall. So texts in sparse places match by short prefixes,
above the target, those in dense ones by longer ones, never below it. Candidates
are then compared exactly.

Texts linked by candidate pairs form groups. A group is compared in one task
if it is small, otherwise in cells of two blocks of bounded size (in texts and
in words), either over the group or over each of its nodes, whichever needs
fewer rows; in the latter case a pair counts in the first tree where it meets.
So all links are counted and none is listed, and no task holds more than two
blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcelens.llm import common
from sourcelens.llm.graph import components

WORDS = 5
THRESHOLD = 0.8
TREES = 32
MAX_DEPTH = 7
#: Least share of the pairs at exactly the threshold that share a node.
RECALL = 0.999
#: Levels by which a matched prefix is shortened at most.
LEVELS = 1
#: Texts in a node that is not divided further.
NODE = 512
#: Texts, and words, in a block of a comparison (a longer text is a block of its own).
BLOCK = 512
BLOCK_WORDS = 1 << 21
#: Weight of a row in a bucket against a row in a whole group, when the way to compare a large group is chosen.
BUCKET_WEIGHT = 1.0
#: Words hashed together, and columns of a matrix multiplied together.
CHUNK_WORDS = 1 << 17
CHUNK_COLUMNS = 1 << 12

_LABEL = 2 * MAX_DEPTH  # bytes of a path: 16 bits of each min-hash


def depths(threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """The shortest and the longest prefix that matches: the longest reaches the recall at the threshold."""
    d = MAX_DEPTH
    while d > 1 and 1 - (1 - threshold**d) ** TREES < recall:
        d -= 1
    return max(1, d - LEVELS), d


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts that lie one after another in words: all hashes, the first one of each text.

    A text of fewer than WORDS words (but one at least) has one shingle: itself.
    """
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    n = np.where(sizes >= WORDS, sizes - WORDS + 1, 1)
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(starts - first, n)
    length = np.repeat(np.minimum(sizes, WORDS), n)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            w = words[np.minimum(at + k, len(words) - 1)] if len(words) else h
            h = np.where(k < length, h * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(1), h)
    return _mixed(h), first


def _factors() -> np.ndarray:
    return _mixed(np.arange(1, TREES * MAX_DEPTH + 1, dtype=np.uint64)) | np.uint64(1)


def paths(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the min-hashes of all trees, 16 bits each: (texts, TREES * MAX_DEPTH) big-endian."""
    out = np.empty((len(first), TREES * MAX_DEPTH), ">u2")
    for p, factor in enumerate(_factors()):
        with np.errstate(over="ignore"):
            low = np.minimum.reduceat(hashes * factor, first)
        out[:, p] = (_mixed(low) >> np.uint64(48)).astype(np.uint16)
    return out


def _runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a list<long> column without nulls in runs of bounded size: first row, words, ends."""
    offsets, at = column.offsets.to_numpy(), 0
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_WORDS, "right")) - 1)
        end = min(end, len(column))
        yield at, values[offsets[at] : offsets[end]], (offsets[at + 1 : end + 1] - offsets[at]).astype(np.int64)
        at = end


def _doc_key(id_col, text):
    return F.struct(id_col.isNotNull().alias("known"), F.coalesce(id_col.cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("text"))


_KEY = "struct<known:boolean,id:bigint,text:bigint>"


def _hashed(text) -> F.Column:
    return F.transform(common.words(text), lambda w: F.xxhash64(w))


def signatures(keyed: DataFrame) -> DataFrame:
    """keyed (key, text), texts with a word, to key, did (digest of the word sequence), labels, n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words, ends in _runs(batch.column(1)):
                labels = paths(*shingles(words, ends))
                cuts = [0, *ends]
                did = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cuts, cuts[1:])]
                cols = [batch.column(0).slice(at, len(ends)), pa.array(did, pa.binary()), pa.array([x.tobytes() for x in labels], pa.binary()), pa.array(np.diff(ends, prepend=0))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "did", "labels", "n_words"])

    return keyed.select("key", _hashed(F.col("text")).alias("words")).mapInArrow(run, f"key {_KEY}, did binary, labels binary, n_words long")


def nodes(texts: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of several texts: did, tree, depth, bucket, v (their least did), m (how many); and did, tree, depth of texts below the first level."""
    path = F.substring(F.col("labels"), F.col("tree") * _LABEL + 1, F.lit(_LABEL))
    rows = texts.select("did", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("did", "tree", path.alias("path"))
    found, below = [], []
    for d in range(low, high + 1):
        named = rows.withColumn("bucket", F.xxhash64("tree", F.lit(d), F.substring("path", 1, 2 * d)))
        stars = common.written(named.groupBy("bucket").agg(F.min("did").alias("v"), F.count(F.lit(1)).alias("m")).where("m > 1"), "stars")
        last = d == high or stars.where(F.col("m") > NODE).isEmpty()
        met = common.written(named.join(stars, "bucket").withColumn("depth", F.lit(d)), "met")
        found.append(met if last else met.where(F.col("m") <= NODE))
        if d > low:
            below.append(rows.select("did", "tree", F.lit(d).alias("depth")))
        if last:
            break
        rows = met.where(F.col("m") > NODE).select("did", "tree", "path")
    deepest = reduce(DataFrame.unionByName, below, texts.limit(0).select("did", F.lit(0).alias("tree"), F.lit(0).alias("depth")))
    deepest = deepest.groupBy("did", "tree").agg(F.max("depth").alias("depth"))
    return reduce(DataFrame.unionByName, found).drop("path"), deepest


def codes(labels: np.ndarray, deep: list[list[dict] | None], low: int) -> np.ndarray:
    """A number for the node of each text in each tree: (texts, TREES); deep has the trees in which a text lies below the level low."""
    n = len(deep)
    prefix = labels.reshape(n, TREES, MAX_DEPTH).astype(np.uint64)
    depth = np.full((n, TREES), low)
    for i, rows in enumerate(deep):
        for x in rows or ():
            depth[i, x["tree"]] = x["depth"]
    out = depth.astype(np.uint64)
    for k in range(MAX_DEPTH):
        with np.errstate(over="ignore"):
            out = np.where(k < depth, _mixed(out * np.uint64(65537) + prefix[:, :, k] + np.uint64(1)), out)
    return out


def compare(code: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, tree: int, threshold: float) -> np.ndarray:
    """Matrix of linked pairs i < j between the sides of a cell, or inside the only one (side is None).

    code: numbers of nodes. tree < 0: pairs that share a node in any tree; otherwise those that share one there and in no earlier tree.
    """
    n = len(sets)
    meet = np.zeros((n, n), bool)
    for t in range(TREES):
        same = code[:, t][:, None] == code[:, t][None, :]
        if t == tree:
            meet = same & ~meet
            break
        meet |= same
    meet &= np.triu(np.ones((n, n), bool), 1)
    if side is not None:
        meet &= side[:, None] != side[None, :]
    sizes = np.array([len(s) for s in sets], np.int64)
    # sizes alone rule a pair out if the smaller set is under threshold times the larger
    meet &= np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes) - 1e-9
    i, j = np.nonzero(meet)
    out = np.zeros((n, n), bool)
    if not len(i):
        return out
    if len(i) <= 4 * n:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)])
    else:
        rows = np.unique(np.concatenate([i, j]))
        flat, owner = np.concatenate([sets[r] for r in rows]), np.repeat(np.arange(len(rows)), sizes[rows])
        values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        # a shingle of one text only is in no intersection
        shared = times[column] > 1
        column, owner = (np.cumsum(times > 1) - 1)[column[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        inter = np.zeros((len(rows), len(rows)), np.float32)
        for low in range(0, int((times > 1).sum()), CHUNK_COLUMNS):
            a, b = np.searchsorted(column, [low, low + CHUNK_COLUMNS])
            m = np.zeros((len(rows), CHUNK_COLUMNS), np.float32)
            m[owner[a:b], column[a:b] - low] = 1
            inter += m @ m.T
        both = np.rint(inter[np.searchsorted(rows, i), np.searchsorted(rows, j)]).astype(np.int64)
    ok = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
    out[i[ok], j[ok]] = True
    return out


def _roots(n: int, linked: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component."""
    root = np.arange(n)
    both = linked | linked.T | np.eye(n, dtype=bool)
    while True:
        low = np.where(both, root[None, :], n).min(1)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _n_blocks(texts: str, words: str) -> Column:
    return F.greatest(F.ceil(F.col(texts) / BLOCK), F.ceil(F.col(words) / BLOCK_WORDS))


def _cells(entries: DataFrame) -> DataFrame:
    """entries (gid, tree, m, words_in, ...) dealt to cells of two blocks; every pair of a group meets in exactly one cell."""
    rows = entries.withColumn("n_blocks", _n_blocks("m", "words_in").cast("int")).withColumn("side", F.pmod(F.xxhash64("did"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    return rows.withColumn("other", other).withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})


def verified(cells: DataFrame, low: int, threshold: float) -> DataFrame:
    """cells with words to did, links (rows of the linked texts), root, gid, n_blocks."""

    def one(t: pa.Table) -> pa.Table:
        words = t["words"].combine_chunks()
        sets: list[np.ndarray] = []
        for _, flat, ends in _runs(words):
            hashes, first = shingles(flat, ends)
            sets += [np.unique(x) for x in np.split(hashes, first[1:])]
        labels = np.frombuffer(b"".join(t["labels"].to_pylist()), ">u2")
        side = t["side"].to_numpy() if t["low"][0] != t["high"][0] else None
        linked = compare(codes(labels, t["deep"].to_pylist(), low), sets, side, t["tree"][0].as_py(), threshold)
        copies = t["copies"].to_numpy()
        links = linked @ copies + linked.T @ copies
        did = t["did"].to_pylist()
        order = sorted(range(len(did)), key=did.__getitem__)
        back = np.argsort(order)
        root = [did[order[r]] for r in _roots(len(did), linked[np.ix_(order, order)])]
        return pa.table({"did": t["did"], "links": pa.array(links, pa.int64()), "root": pa.array([root[b] for b in back], pa.binary()), "gid": t["gid"], "n_blocks": t["n_blocks"]})

    cols = cells.select("gid", "tree", "low", "high", "side", "n_blocks", "did", "copies", "labels", "deep", "words")
    return cols.groupBy("gid", "low", "high").applyInArrow(one, "did binary, links long, root binary, gid string, n_blocks int")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs with a word in its text: key, root (of its class), links (other rows linked to it)."""
    low, high = depths(threshold, recall)
    keyed = docs.select(_doc_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    worded = keyed.where(F.btrim(common.text_or_empty(F.col("text")), F.lit(common.SPACE)) != "")
    rows = common.written(signatures(worded), "signatures")
    texts = rows.groupBy("did").agg(F.min(F.struct("key", "labels", "n_words")).alias("x"), F.count(F.lit(1)).alias("copies"))
    texts = common.written(texts.select("did", "x.key", "x.labels", "x.n_words", "copies"), "texts")

    met, deepest = nodes(texts.select("did", "labels"), low, high)
    grouped = components(met.select(F.col("did").alias("u"), "v"))
    grouped = common.written(grouped.select(F.col("node").alias("did"), F.col("root").alias("comp")), "grouped")

    # the cheaper way to compare a group: all of it, or node by node
    counted = grouped.join(texts.select("did", "n_words"), "did")
    size = common.written(counted.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n_words").alias("words_in")), "sizes")
    large = size.where(_n_blocks("m", "words_in") > 1)
    filled = met.join(texts.select("did", "n_words"), "did").groupBy("tree", "bucket").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("m"), F.sum("n_words").alias("words_in"))
    in_large = grouped.join(large.select("comp"), "comp", "left_semi")
    filled = common.written(filled.join(in_large, F.col("v") == F.col("did")).select("tree", "bucket", "m", "words_in", "comp"), "filled")
    rows_for = F.col("m") * _n_blocks("m", "words_in")
    by_node = filled.groupBy("comp").agg(F.sum(rows_for).alias("rows"))
    split = common.written(large.join(by_node, "comp").where(BUCKET_WEIGHT * F.col("rows") < rows_for).select(F.col("comp").alias("split")), "split")
    sized = grouped.join(size, "comp").join(split, F.col("comp") == F.col("split"), "left")
    sized = common.written(sized, "sized")
    whole = sized.where("split is null").select("did", F.hex("comp").alias("gid"), F.lit(-1).alias("tree"), "m", "words_in")
    divided = filled.join(split, F.col("comp") == F.col("split"), "left_semi").select("tree", "bucket", F.col("m").alias("in_node"), "words_in")
    parts = met.select("did", "tree", "bucket").join(divided, ["tree", "bucket"])
    parts = parts.select("did", F.concat(F.lit("b"), F.col("bucket").cast("string")).alias("gid"), "tree", F.col("in_node").alias("m"), "words_in")
    deep = deepest.groupBy("did").agg(F.collect_list(F.struct("tree", "depth")).alias("deep"))
    entries = texts.drop("n_words").join(whole.unionByName(parts), "did").join(deep, "did", "left")

    text = worded.select(F.col("key").alias("k"), F.col("text"))
    needed = texts.join(grouped.select("did"), "did").select("key", "did")
    fetched = text.join(needed, F.col("k") == F.col("key")).select("did", _hashed(F.col("text")).alias("words")).dropDuplicates(["did"])
    cells = _cells(entries.drop("key")).join(fetched, "did")
    found = common.written(verified(cells, low, threshold), "found")

    links = found.groupBy("did").agg(F.sum("links").alias("links"))
    alone = found.where("n_blocks = 1 and not startswith(gid, 'b')").select("did", "root")
    multi = found.where("n_blocks > 1 or startswith(gid, 'b')").select(F.col("did").alias("u"), F.col("root").alias("v"))
    roots = alone
    if not multi.isEmpty():
        comps = components(multi).select(F.col("node").alias("did"), "root")
        roots = alone.unionByName(comps)
    known = common.written(links.join(roots, "did", "left"), "known")
    out = texts.select("did", "copies").join(known, "did", "left")
    out = out.select(F.col("did").alias("d"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "did").alias("root"))
    return rows.select("key", "did").join(common.written(out, "classes"), F.col("did") == F.col("d")).select("key", "root", "links")


@common.tracked
def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Classes of near-duplicate texts: id_col, class_id, class_size, n_links, one row per row of docs.

    class_id is the least id in the class (null if none has an id); n_links is
    the number of other rows whose similarity is at least the threshold, equal
    texts among them. Texts are compared as sets of their 5-word shingles; a
    shorter text is one shingle. Null texts and texts without a word are linked
    to nothing and are classes of their own. An empty table gives an empty
    result; other columns are not read.
    """
    found = common.written(classes(docs, id_col, text_col, threshold, recall), "linked")
    heads = found.groupBy("root").agg(F.min(F.when(F.col("key.known"), F.col("key.id"))).alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    heads = common.written(heads, "heads")
    out = found.join(heads, "root").select(F.when(F.col("key.known"), F.col("key.id")).alias(id_col), "class_id", "class_size", F.col("links").alias("n_links"))
    none = docs.where(F.btrim(common.text_or_empty(F.col(text_col)), F.lit(common.SPACE)) == "")
    own = F.col(id_col).cast("long")
    return out.unionByName(none.select(own.alias(id_col), own.alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links")))


@common.tracked
def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each class: that with the least id (null ids last), and of equal rows any one."""
    found = common.written(classes(docs, id_col, text_col, threshold, recall), "linked")
    stays = found.groupBy("root").agg(F.min(F.struct((~F.col("key.known")).alias("last"), F.col("key"))).alias("x"))
    stays = common.written(stays.select(F.col("x.key").alias("stays")), "stays")
    repeated = not found.groupBy("key").count().where("count > 1").isEmpty()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col(text_col).alias("text"), _doc_key(F.col(id_col), F.col(text_col)).alias("key"))
    empty = F.btrim(common.text_or_empty(F.col("text")), F.lit(common.SPACE)) == ""
    kept = keyed.where(~empty).join(stays, F.col("key") == F.col("stays"), "left_semi")
    if repeated:
        first = Window.partitionBy("key").orderBy(F.lit(0))
        kept = kept.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return kept.select("row.*").unionByName(keyed.where(empty).select("row.*"))


@common.tracked
def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return jaccard_join(common.table(spark, sf_dir, "documents"))
