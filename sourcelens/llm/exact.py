"""Exact dedup against a minimal perfect hash index of historical digests.

The distinct digests of what is known already are dealt to shards by their
first bytes. Each shard is one index row: bit arrays of a minimal perfect hash
(levels of collision-free bits; a key's slot is the rank of its bit), and per
slot the full digest with the locator of the winner. New documents are
pre-aggregated by digest, so every distinct digest is looked up once, whatever
the size of its group. A lookup counts only if the whole digest in the slot is
equal; digests that are in no slot form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import common

#: Digests in a shard of the index, about; it bounds what one task holds.
SHARD_KEYS = 100_000
#: Bits per key at each level.
GAMMA = 2.0

_GROUP = "digest binary, win_known boolean, win_id long, win_row long, n long"
_INDEX = "shard long, sizes array<int>, bits binary, digests binary, win_known array<boolean>, win_id array<long>, win_row array<long>, n array<long>"


def _mix(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of 32-byte keys (rows of four words) for a level."""
    with np.errstate(over="ignore"):
        h = np.full(len(words), (0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1), np.uint64)
        for k in range(4):
            h ^= words[:, k]
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    return h


def _as_words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, 4)


def build(digests: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Minimal perfect hash of distinct 32-byte digests: sizes of the levels, all bits, the slot of each key."""
    keys = _as_words(digests)
    at, sizes, levels, places = np.arange(len(keys)), [], [], np.empty(len(keys), np.int64)
    base = 0
    while len(at):
        m = max(8, int(len(at) * GAMMA))
        pos = (_mix(keys[at], len(sizes)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(pos, minlength=m) == 1
        hit = alone[pos]
        places[at[hit]] = base + pos[hit]
        levels.append(alone)
        sizes.append(m)
        base += m
        at = at[~hit]
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    return sizes, bits, (np.cumsum(bits) - 1)[places] if len(keys) else places


def slots(sizes: list[int], bits: np.ndarray, digests: bytes) -> np.ndarray:
    """The only slot where each digest can be, -1 for none."""
    keys = _as_words(digests)
    rank = np.cumsum(bits) - 1
    out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, m in enumerate(sizes):
        pos = base + (_mix(keys[open_], level) % np.uint64(m)).astype(np.int64)
        hit = bits[pos]
        out[open_[hit]] = rank[pos[hit]]
        open_, base = open_[~hit], base + m
    return out


def _joined(col: pa.ChunkedArray) -> bytes:
    return b"".join(col.to_pylist())


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased and nothing else changed, as binary; null counts as empty."""
    t = common.text_or_empty(text)
    lowered = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.unhex(F.sha2(lowered, 256))


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the winner (largest id; null is smallest; then the largest row number) and the number of rows."""
    win = F.max(F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), F.col("row")))
    out = rows.groupBy("digest").agg(win.alias("w"), F.count(F.lit(1)).alias("n"))
    return out.select("digest", F.col("w.known").alias("win_known"), F.col("w.id").alias("win_id"), F.col("w.row").alias("win_row"), "n")


def _sharded(group_rows: DataFrame, n_shards: int) -> DataFrame:
    first = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    return group_rows.withColumn("shard", first % n_shards)


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """One index row per shard from groups() of the historical documents."""

    def one(t: pa.Table) -> pa.Table:
        raw = _joined(t["digest"])
        sizes, bits, slot = build(raw)
        order = np.argsort(slot)
        pick = t.take(pa.array(order))
        cell = lambda name: pa.array([pick[name].to_pylist()])
        return pa.table({
            "shard": t["shard"].slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int32())), "bits": pa.array([np.packbits(bits).tobytes()]),
            "digests": pa.array([_joined(pick["digest"])]), "win_known": cell("win_known"), "win_id": cell("win_id"), "win_row": cell("win_row"), "n": cell("n"),
        })

    return _sharded(history, n_shards).groupBy("shard").applyInArrow(one, _INDEX)


def look_up(new: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """Merges groups() of new documents into the index: all groups afterwards, and whether each was in the index.

    Members change the winner and the count in their slot; nonmembers pass as
    groups of their own. Needs memory for one shard of the index and the new
    digests that fall to it.
    """

    def one(fresh: pa.Table, shard: pa.Table) -> pa.Table:
        cols = {c: fresh[c].to_pylist() for c in ("digest", "win_known", "win_id", "win_row", "n")}
        out = {c: [] for c in cols} | {"member": []}
        if shard.num_rows:
            s = shard.to_pylist()[0]
            bits = np.unpackbits(np.frombuffer(s["bits"], np.uint8)).astype(bool)[: sum(s["sizes"])]
            raw, kept = s["digests"], {c: s[c] for c in ("win_known", "win_id", "win_row", "n")}
            for i, at in enumerate(slots(s["sizes"], bits, b"".join(cols["digest"]))):
                if at >= 0 and raw[32 * at : 32 * at + 32] == cols["digest"][i]:
                    if (cols["win_known"][i], cols["win_id"][i], cols["win_row"][i]) > (kept["win_known"][at], kept["win_id"][at], kept["win_row"][at]):
                        for c in ("win_known", "win_id", "win_row"):
                            kept[c][at] = cols[c][i]
                    kept["n"][at] += cols["n"][i]
                else:
                    for c in cols:
                        out[c].append(cols[c][i])
            out["member"] = [False] * len(out["digest"]) + [True] * len(kept["n"])
            out["digest"] += [raw[i : i + 32] for i in range(0, len(raw), 32)]
            for c in kept:
                out[c] += kept[c]
        else:
            out = cols | {"member": [False] * fresh.num_rows}
        kinds = {"digest": pa.binary(), "win_known": pa.bool_(), "win_id": pa.int64(), "win_row": pa.int64(), "n": pa.int64(), "member": pa.bool_()}
        return pa.table({c: pa.array(out[c], kinds[c]) for c in kinds})

    dealt = _sharded(new, n_shards).groupBy("shard").cogroup(index.groupBy("shard"))
    return dealt.applyInArrow(one, _GROUP + ", member boolean")


@common.tracked
def exact_dedup(docs: DataFrame, history_below: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keeps one row of each group of equal texts (A-Z lower-cased, null as empty): the one with the largest id.

    history_below: rows with a smaller id are the history that the index is
    built from, the others are new; None halves the range of ids. The result
    does not depend on it.

    Returns one row per row of docs: id_col, keep_id, group_size, kept,
    text_sha256. A null id is smaller than any other. Of rows that tie on the
    largest id, exactly one is kept. An empty table gives an empty result; other
    columns are not read.
    """
    rows = common.written(
        docs.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests"
    )
    if history_below is None:
        low, high = rows.agg(F.min("id"), F.max("id")).first()
        history_below = (low + high) // 2 if low is not None else 0
    old = F.coalesce(F.col("id") < history_below, F.lit(True))
    history, fresh = groups(rows.where(old)), groups(rows.where(~old))
    n_shards = max(1, -(-rows.count() // SHARD_KEYS))
    merged = common.written(look_up(fresh, build_index(history, n_shards), n_shards), "groups")
    won = merged.select(F.col("digest").alias("d"), "win_known", "win_id", "win_row", "n")
    out = rows.join(won, F.col("digest") == F.col("d"))
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("win_known"), F.col("win_id")).alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("win_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


@common.tracked
def op3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents."""
    return exact_dedup(common.table(spark, sf_dir, "documents"))


ORACLE = """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""
