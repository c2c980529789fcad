"""Benchmark decontamination over a distributed positional inverted index.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. A benchmark window is ``width``
consecutive words of an item, or the whole of a shorter one.

1. One scan counts the benchmark's own words over all documents. Words are recognised by a bitmap of fixed size, so
   the benchmark may be of any length.
2. The two rarest words of every window become its search terms.
3. A second scan stores the index: the postings (document, position) of search terms, each with the hashes of the
   ``width - 1`` words on either side, and the number of words of every document.
4. Windows meet postings by a join on the term. The lists, shifted by the term's offset in its window, are intersected
   (both terms must point at the same start); what is left is compared word by word with the stored neighbours.

Exact phrases are those whose words all agree. Proximity matches (``slack``) are windows whose two rarest words occur
in their order within ``slack`` words more or less than in the window.

Null and empty texts have no words, match nothing and are not contaminated; items without words are ignored; equal
windows of several items count for each. Repeated documents are reported once a row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import _text as tx
from orrery.llm._store import free, small_batches, stored, tidy

#: Bits of the fixed-size filter of benchmark words.
FILTER_BITS = 23


def benchmark_windows(bench: DataFrame, width: int) -> DataFrame:
    """item_id, len, w (word hashes of the window), code (the same as bytes)."""

    def windows(batches):
        for batch in batches:
            ids, at, values, sizes, codes = batch.column(0), [], [], [], []
            for block in tx.blocks(batch.column(1), tx.ALNUM):
                h = block.hashes()
                for i in range(block.rows):
                    a, b = int(block.first[i]), int(block.first[i + 1])
                    for s in range(a, max(b - width, a if b > a else a - 1) + 1):
                        w = h[s : min(b, s + width)]
                        at.append(block.lo + i)
                        sizes.append(len(w))
                        values.append(w)
                        codes.append(w.tobytes())
            flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
            w = tx.list_array(tx.signed(flat), np.array(sizes, np.int64), pa.int64())
            cols = [ids.take(pa.array(at, pa.int64())), pa.array(sizes, pa.int32()), w, pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["item_id", "len", "w", "code"])

    got = bench.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return got.mapInArrow(tidy(windows), "item_id long, len int, w array<long>, code binary").distinct()


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Fixed-size filter (FILTER_BITS bits) of the column ``term``."""

    def fill(batches):
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(bits))], names=["bit"])

    got = terms.select("term").mapInArrow(tidy(fill), "bit long").distinct().toPandas()
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[got["bit"].to_numpy(dtype=np.int64)] = True
    return np.packbits(bits)


def _hits(h: np.ndarray, packed: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return np.flatnonzero((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)


def word_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, freq: occurrences in all documents of the given words (0 if none)."""
    packed = _bitmap(terms)

    def count(batches):
        for batch in batches:
            for block in tx.blocks(batch.column(0), tx.ALNUM):
                h = block.hashes()
                term, n = np.unique(h[_hits(h, packed)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tx.signed(term)), pa.array(n)], names=["term", "n"])

    seen = docs.select("text").mapInArrow(tidy(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("freq"))
    return terms.select("term").distinct().join(seen, "term", "left").select("term", F.coalesce("freq", F.lit(0)).alias("freq"))


def build_index(docs: DataFrame, terms: DataFrame, width: int) -> DataFrame:
    """One row a document: doc_id, n_words, and postings (term, pos, near: hashes of the words around it)."""
    packed, side = _bitmap(terms), width - 1
    kind = pa.list_(pa.struct([("term", pa.int64()), ("pos", pa.int64()), ("near", pa.binary())]))

    def scan(batches):
        for batch in batches:
            for block in tx.blocks(batch.column(1), tx.ALNUM):
                h = block.hashes()
                at = _hits(h, packed)
                row = block.row_of(at)
                near = []
                for p, i in zip(at, row, strict=True):
                    a, b = block.first[i], block.first[i + 1]
                    own = np.zeros(2 * side + 1, dtype=np.uint64)
                    lo, hi = max(a, p - side), min(b, p + side + 1)
                    own[lo - p + side : hi - p + side] = h[lo:hi]
                    near.append(own.tobytes())
                items = pa.StructArray.from_arrays(
                    [pa.array(tx.signed(h[at])), pa.array(at - block.first[row]), pa.array(near, pa.binary())], names=["term", "pos", "near"]
                )
                offs = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=block.rows))]).astype(np.int32)
                postings = pa.ListArray.from_arrays(pa.array(offs), items).cast(kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.rows), pa.array(block.counts.astype(np.int64)), postings],
                    names=["doc_id", "n_words", "postings"],
                )

    schema = "doc_id long, n_words long, postings array<struct<term: long, pos: long, near: binary>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(scan), schema)


def search(docs: DataFrame, bench: DataFrame, spark: SparkSession, width: int = 13, slack: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The index rows (rid, doc_id, n_words) and the matches (rid, item_id, kind, start, len); see the module's text."""
    small_batches(spark)
    windows = stored(benchmark_windows(bench, width), spark, "windows")
    words = windows.select(F.explode("w").alias("term")).distinct()
    freq = stored(word_frequencies(docs, words), spark, "frequencies")
    key = F.xxhash64("w").alias("wid")
    placed = windows.select("w", "len", key).distinct().select("wid", "len", F.posexplode("w").alias("off", "term")).join(freq, "term")
    ranked = placed.groupBy("wid", "len").agg(F.sort_array(F.collect_list(F.struct("freq", "off", "term"))).alias("all"))
    ranked = ranked.select("wid", "len", F.slice("all", 1, 2).alias("two"))
    terms = stored(
        ranked.select("wid", "len", F.size("two").alias("need"), F.posexplode("two").alias("nth", "x")).select(
            "wid", "len", "need", "nth", F.col("x.off").alias("off"), F.col("x.term").alias("term")
        ),
        spark,
        "terms",
    )
    index = stored(build_index(docs, terms, width).withColumn("rid", F.monotonically_increasing_id()), spark, "index")
    postings = index.where(F.size("postings") > 0).select("rid", F.inline("postings"))
    met = postings.join(terms, "term").select("rid", "wid", "len", "need", "nth", "pos", (F.col("pos") - F.col("off")).alias("start"), "off", "near")
    # The rarest term's neighbours serve for the comparison; a window's words end where its length says.
    full = met.groupBy("rid", "wid", "start", "len", "need").agg(
        F.count_distinct("nth").alias("terms"), F.min(F.when(F.col("nth") == 0, F.col("near"))).alias("near"), F.min(F.when(F.col("nth") == 0, F.col("off"))).alias("off")
    )
    exact = full.where("terms = need and start >= 0").join(windows.select(key, "code", "item_id"), "wid")
    exact = exact.where(F.expr(f"substring(near, cast(({width - 1} - off) * 8 + 1 as int), len * 8) = code"))
    found = exact.select("rid", "item_id", F.lit("phrase").alias("kind"), "start", F.col("len").cast("long").alias("len"))
    if slack is not None:
        one, two = (met.where(f"nth = {k}").select("rid", "wid", F.col("start").alias(f"s{k}"), F.col("pos").alias(f"p{k}"), "len") for k in (0, 1))
        near = one.join(two.drop("len"), ["rid", "wid"]).where(f"abs(s0 - s1) <= {slack}")
        near = near.join(windows.select(key, "item_id"), "wid")
        found = found.union(
            near.select("rid", "item_id", F.lit("proximity"), F.least("p0", "p1"), (F.greatest("p0", "p1") - F.least("p0", "p1") + 1)).distinct()
        )
    return index.select("rid", "doc_id", "n_words"), found


def contamination(docs: DataFrame, bench: DataFrame, spark: SparkSession, width: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any phrase match), items (sorted item_ids as strings), contaminated:
    at least one word in ``share`` is hit."""
    rows, found = search(docs, bench, spark, width)
    found = stored(found, spark, "matches")
    items = found.groupBy("rid").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hit = (
        found.select("rid", F.explode(F.expr("sequence(start, start + len - 1)")).alias("word"))
        .distinct()
        .groupBy("rid")
        .agg(F.count("*").alias("n_hit"))
    )
    per = hit.join(items, "rid")
    out = rows.join(per, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "rid"
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, bench: DataFrame, spark: SparkSession, width: int = 13, share: int = 20) -> DataFrame:
    """``docs`` without contaminated documents, whether or not they have a doc_id; all columns stay as they are."""
    # Only the text decides, so its hash stands for the row: a doc_id may be null, or repeat with another text.
    texts, th = docs.select(F.xxhash64("text").alias("doc_id"), "text"), free(docs.columns, "__th")
    bad = contamination(texts, bench, spark, width, share).where("contaminated").select(F.col("doc_id").alias(th)).distinct()
    return docs.join(bad, F.xxhash64(docs["text"]) == bad[th], "left_anti").select(docs.columns)
