"""Exact deduplication against a history, through minimal perfect hash tables.

Texts are equal when they are identical after every run of white space (space, tab to carriage return) becomes one
space; null counts as empty. Each row has the SHA-256 of that text, and from there on only digests move.

The distinct digests of the history are dealt into buckets of about ``BUCKET``. Each bucket is one row of a table: a
minimal perfect hash (levels of bit arrays; a key's slot is the rank of its bit), and at each slot the full digest, the
winner's locator and the number of rows. Digests that are looked up find one slot and are compared there byte by byte:
members are repeats of the winner, all others form groups of their own. Rows with equal digests are added up before
any shuffle, so a text that a third of all rows share is one row a task; its rows meet their group again in a join of
which one side has one row a key.

Defined results: the row with the smallest id stays, null ids come last, and of rows with equal id and text one stays.
Ids are whole numbers. Empty tables give empty results; other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm._store import discard, free, sized, stored
from orrery.llm._text import mix

#: Digests in a bucket, on average.
BUCKET = 2048
#: Bits of a level for each key that is left; levels until the few keys still left are compared one by one.
SPREAD, LEVELS = 2, 40

_INDEX = "bucket long, n long, sizes array<long>, bits binary, digests binary, ids binary, counts binary"
_GROUPS = "digest binary, no_id boolean, doc_id long, rid long, size long, member boolean"


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normal_text(text), 256))


def _keys(digests: np.ndarray) -> np.ndarray:
    """64 bits of each 32-byte digest, from all of its bytes."""
    w = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)
    return mix(w[:, 0] ^ mix(w[:, 1] + np.uint64(1)) ^ mix(w[:, 2] + np.uint64(2)) ^ mix(w[:, 3] + np.uint64(3)))


def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


def perfect_hash(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits one after the other, and the slot of each of the distinct digests (n x 32)."""
    n = len(digests)
    slots, left, sizes, bits, taken = np.full(n, -1, dtype=np.int64), np.arange(n), [], [], 0
    keys = _keys(digests)
    while len(left) and len(sizes) < LEVELS:
        size = max(8, SPREAD * len(left))
        at = _at(keys[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        rank = np.cumsum(alone) - 1
        slots[left[own]] = taken + rank[at[own]]
        taken += int(own.sum())
        sizes.append(size)
        bits.append(alone)
        left = left[~own]
    slots[left] = taken + np.arange(len(left))
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), slots


def slots_of(digests: np.ndarray, sizes: list[int], bits: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The slot where ``held`` (slots x 32) has the same digest, or -1."""
    out, left, start, taken = np.full(len(digests), -1, dtype=np.int64), np.arange(len(digests)), 0, 0
    keys = _keys(digests) if len(digests) else np.zeros(0, np.uint64)
    for level, size in enumerate(sizes):
        own = bits[start : start + size]
        at = _at(keys[left], level, size)
        hit = own[at]
        out[left[hit]] = taken + (np.cumsum(own) - 1)[at[hit]]
        taken += int(own.sum())
        start += size
        left = left[~hit]
    for i in left if taken < len(held) else ():
        same = np.flatnonzero((held[taken:] == digests[i]).all(axis=1))
        out[i] = taken + same[0] if len(same) else -1
    found = out >= 0
    found[found] = (held[out[found]] == digests[found]).all(axis=1)
    return np.where(found, out, -1)


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(-1, 32)


def _build(rows: pa.Table) -> pa.Table:
    digests = _matrix(rows["digest"])
    sizes, bits, slots = perfect_hash(digests)
    order = np.argsort(slots)
    ids = np.stack([rows[c].cast(pa.int64()).fill_null(0).to_numpy() for c in ("no_id", "doc_id", "rid")], axis=1)
    one = [
        rows["bucket"][0].as_py(), len(slots), sizes, np.packbits(bits).tobytes(), digests[order].tobytes(), ids[order].tobytes(),
        rows["size"].to_numpy()[order].tobytes(),
    ]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 4
    names = ["bucket", "n", "sizes", "bits", "digests", "ids", "counts"]
    return pa.table({c: pa.array([v], type=t) for c, v, t in zip(names, one, kinds, strict=True)})


def _look_up(index: pa.Table, asked: pa.Table) -> pa.Table:
    new = _matrix(asked["digest"]) if asked.num_rows else np.zeros((0, 32), np.uint8)
    new_ids = np.stack([asked[c].cast(pa.int64()).fill_null(0).to_numpy() for c in ("no_id", "doc_id", "rid")], axis=1)
    more = asked["size"].to_numpy()
    held, ids, counts = np.zeros((0, 32), np.uint8), np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    slot = np.full(len(new), -1, dtype=np.int64)
    if index.num_rows:
        row = index.slice(0, 1).to_pylist()[0]
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        ids, counts = np.frombuffer(row["ids"], np.int64).reshape(-1, 3), np.frombuffer(row["counts"], np.int64).copy()
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["sizes"])].astype(bool)
        slot = slots_of(new, row["sizes"], bits, held)
        np.add.at(counts, slot[slot >= 0], more[slot >= 0])
    other = slot < 0
    digests, ids = np.concatenate([held, new[other]]), np.concatenate([ids, new_ids[other]])
    no_id = ids[:, 0] == 1
    return pa.table(
        {
            "digest": pa.array([d.tobytes() for d in digests], type=pa.binary()),
            "no_id": pa.array(no_id),
            "doc_id": pa.array(ids[:, 1], mask=no_id),
            "rid": pa.array(ids[:, 2]),
            "size": pa.array(np.concatenate([counts, more[other]])),
            "member": pa.array(np.arange(len(digests)) < len(held)),
        }
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """One row a digest: the locator of its first row, and how many rows it has."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    return rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("size")).select("digest", "first.*", "size")


def build_index(rows: DataFrame, buckets: int) -> DataFrame:
    """The table of perfect hashes of ``rows`` (digest, no_id, doc_id, rid, size; digests distinct)."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets))).groupBy("bucket").applyInArrow(_build, _INDEX)


def look_up(index: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """Groups of the history with what ``rows`` adds to them, and those of the digests that the history has not."""
    asked = rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    return index.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_look_up, _GROUPS)


def classes(digests: DataFrame, spark: SparkSession, history: Column) -> DataFrame:
    """``digests`` (doc_id, rid, digest; rid tells rows apart) with keep_id, group_size and kept. Rows where
    ``history`` is true fill the index, all others are looked up in it; either way the smallest id of all stays."""
    old, new = stored(_grouped(digests.where(history)), spark, "history"), stored(_grouped(digests.where(~history)), spark, "incoming")
    buckets = max(1, -(-max(old.count(), new.count()) // BUCKET))
    index = stored(build_index(old, buckets), spark, "perfect-hash")
    groups = look_up(index, new, buckets)
    # The history's winner stands unless an id from outside the history comes before it.
    least = F.least(
        F.struct("no_id", "doc_id", "rid"),
        F.struct(F.coalesce("n_no_id", F.lit(True)).alias("no_id"), F.coalesce("n_doc_id", F.lit(2**63 - 1)).alias("doc_id"), F.coalesce("n_rid", F.lit(2**63 - 1)).alias("rid")),
    )
    fresh = new.select("digest", *(F.col(c).alias(f"n_{c}") for c in ("no_id", "doc_id", "rid")))
    repeated = groups.where(F.col("size") > 1).join(fresh, "digest", "left").select("digest", least.alias("first"), "size")
    repeated = stored(repeated.select("digest", F.when(~F.col("first.no_id"), F.col("first.doc_id")).alias("keep_id"), F.col("first.rid").alias("keep_rid"), "size"), spark, "repeated")
    discard(spark, old, new, index)
    alone = F.col("size").isNull()
    return digests.join(sized(repeated), "digest", "left").select(
        "doc_id", "rid", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_classes(docs: DataFrame, spark: SparkSession, history: Column | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256. ``history`` marks the rows (by doc_id) that
    fill the index; else those in the lower half of the range of ids do."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), digest(F.col("text")).alias("digest"))
    digests = stored(rows, spark, "digests")
    if history is None:
        low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
        history = F.col("doc_id") <= (0 if low is None else (low + high) // 2)
    return classes(digests, spark, F.coalesce(history, F.lit(False))).drop("rid")


def remove_repeats(docs: DataFrame, spark: SparkSession, seen: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose text ``seen`` has, and but one row of each text; all columns stay as they are."""
    rid, key = free(docs.columns, "__rid"), free(docs.columns, "__digest")
    whole = stored(docs.withColumn(rid, F.monotonically_increasing_id()), spark, "documents")
    mine = whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(rid).alias("rid"), digest(F.col("text")).alias("digest"), F.lit(False).alias("old"))
    if seen is not None:
        old = seen.select(F.col("doc_id").cast("long").alias("doc_id"), (-1 - F.monotonically_increasing_id()).alias("rid"), digest(F.col("text")).alias("digest"), F.lit(True).alias("old"))
        # What is seen already wins by its place before all ids of the new rows.
        mine = mine.unionByName(old.withColumn("doc_id", F.lit(-(2**63)).cast("long")))
    digests = stored(mine, spark, "digests")
    kept = classes(digests, spark, F.col("old")).where(F.col("kept") & (F.col("rid") >= 0)).select(F.col("rid").alias(key))
    return whole.join(kept, whole[rid] == kept[key], "left_semi").drop(rid)
