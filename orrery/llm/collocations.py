"""Collocations: phrases of two and three words that occur together more often than their parts let expect.

Texts are cut into pieces at punctuation and line ends. Equal pieces of a language are counted once with their
multiplicity: tasks send them as compressed Arrow blocks, one for each hash bucket, and duckdb adds up each bucket. The
n-grams of the distinct pieces, weighted by the multiplicities, go the same way into hash buckets of n-grams, where
duckdb counts them; it writes what does not fit its memory to a folder of the task's own, which goes with the task.
N-grams keep their words all the way, so that counts are exact.

A phrase of ``min_count`` occurrences has parts of as many at least, so only n-grams that reach it are kept. Each
candidate sends requests for the counts of its parts, which are joined with the counts by language and part, and come
back to the candidate.

Defined results: null texts are empty, a null language is ``und``, an empty table has no phrases, repeated rows count
as often as they occur. Other columns are not read.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm._store import discard, sized, small_batches, stored, tidy
from orrery.llm._text import BLOCK, LOWER, buffers, mix
from orrery.llm._text import _letters as letter_values
from orrery.llm._text import _powers as powers

#: Bytes of text for a bucket, and the most buckets: beyond them buckets grow, and duckdb works out of core.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 1 << 14
#: Megabytes that duckdb may hold in a task; words that are numbered at a time; bytes of pieces sent at a time.
DUCKDB_MB, WORDS, SEND = 256, 1 << 20, 16 << 20

_CUT = np.array([chr(b) in ".,;:!?" or 10 <= b <= 13 for b in range(256)])
_BLANK = np.array([b in (32, 9) for b in range(256)])
_COUNTED = pa.schema([("lang", pa.string()), ("size", pa.int64()), ("gram", pa.string()), ("f", pa.int64())])


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces of the rows, A-Z lower-cased and words one space apart; the row of each; a 64-bit hash of each."""
    data, offs = LOWER[data[offs[0] : offs[-1]]], offs - offs[0]
    cut, solid = _CUT[data], None
    solid = ~(cut | _BLANK[data])
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = offs[1:] > offs[:-1]
    a, b = offs[:-1][full], offs[1:][full] - 1
    start[a], end[b] = solid[a], solid[b]
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    rows = np.searchsorted(offs, first, side="right") - 1
    cuts = np.cumsum(cut)
    # Words that belong to the piece of the word before them keep the first blank between the two.
    joined = np.zeros(len(first), dtype=bool)
    joined[1:] = (cuts[first[1:]] == cuts[last[:-1]]) & (rows[1:] == rows[:-1])
    blank = last[:-1][joined[1:]] + 1
    data[blank] = 32
    solid[blank] = True
    rank = np.cumsum(solid, dtype=np.int64)
    text = data[solid]
    heads = ~joined
    borders = np.append(rank[first[heads]] - 1, len(text))
    power, inverse = powers(BLOCK if len(text) <= BLOCK else 1 << int(len(text) - 1).bit_length())
    total = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(letter_values()[text] * power[: len(text)], out=total[1:])
    hashes = mix((total[borders[1:]] - total[borders[:-1]]) * inverse[borders[:-1]])
    return pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders), pa.py_buffer(text)), rows[heads], hashes


def _packed(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def _sent(t: pa.Table, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket as one block."""
    order = np.argsort(bucket, kind="stable")
    t, bucket = t.take(pa.array(order)), bucket[order]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(bucket))
    for lo in range(0, len(at), 64):
        some = slice(lo, lo + 64)
        blocks = [_packed(t.slice(a, b - a)) for a, b in zip(at[some], ends[some], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at[some]].astype(np.int64)), pa.array(blocks, type=pa.binary())], ["bucket", "block"])


def _send_pieces(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed():
            t = pa.concat_tables(held).group_by(["lang", "piece", "h"]).aggregate([([], "count_all")]).rename_columns(["lang", "piece", "h", "m"])
            held.clear()
            return _sent(t.select(["lang", "piece", "m"]), (t["h"].to_numpy() % np.uint64(buckets)).astype(np.int64))

        for batch in batches:
            data, offs = buffers(batch.column(1))
            lang = batch.column(0)
            lo, n = 0, len(offs) - 1
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + BLOCK, side="right")) - 1)
                text, rows, h = pieces(data, offs[lo : hi + 1])
                if len(text):
                    own = lang.take(pa.array(rows + lo))
                    seed = own.dictionary_encode()
                    salt = np.array([zlib.crc32(x.encode()) for x in seed.dictionary.to_pylist()], dtype=np.uint64)
                    h = mix(h + salt[seed.indices.to_numpy()])
                    held.append(pa.table({"lang": own, "piece": text.cast(pa.string()), "h": h}))
                    size += int(offs[hi] - offs[lo])
                if size >= SEND:
                    yield from flushed()
                    size = 0
                lo = hi
        if held:
            yield from flushed()

    return run


def _summed(batches: Iterator[pa.RecordBatch], by: str, weight: str, having: str = "") -> Iterator[pa.RecordBatch]:
    """Rows of each bucket (blocks sorted by bucket) added up by duckdb, which works out of core."""
    import duckdb

    columns = ", ".join(f"{c} {'BIGINT' if c == 'size' else 'VARCHAR'}" for c in by.split(", "))
    with tempfile.TemporaryDirectory() as folder:

        def opened():
            con = duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCKDB_MB}MB", "temp_directory": folder, "preserve_insertion_order": False})
            con.execute(f"CREATE TABLE t ({columns}, {weight} BIGINT)")
            return con

        def result(con):
            out = con.sql(f"SELECT {by}, CAST(sum({weight}) AS BIGINT) AS {weight} FROM t GROUP BY {by} {having}")
            yield from out.to_arrow_reader(1 << 15)
            con.close()

        con, bucket = None, None
        for batch in batches:
            for b, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket:
                    if con is not None:
                        yield from result(con)
                    con, bucket = opened(), b
                rows = pa.ipc.open_stream(block.as_buffer()).read_all()  # noqa: F841  (read by duckdb)
                con.execute("INSERT INTO t SELECT * FROM rows")
        if con is not None:
            yield from result(con)


def _totals(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct key in order: a place where it stands, its summed weight; and each place's number."""
    order = np.argsort(key, kind="stable")
    own = key[order]
    new = np.append(True, own[1:] != own[:-1])
    at = np.flatnonzero(new)
    number = np.empty(len(key), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[at], np.add.reduceat(weight[order], at), number


def grams(text: pa.Array, weight: np.ndarray, most: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Distinct n-grams of pieces with their weights and hashes, for n = 1 to ``most``."""
    lists = pc.split_pattern(text, " ")
    flat = lists.flatten().dictionary_encode()
    names = flat.dictionary
    order = np.asarray(pc.sort_indices(names))  # numbers in the order of the words: blocks compress better
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    names, word = names.take(pa.array(order)), rank[flat.indices.to_numpy()]
    own = np.array([zlib.crc32(x.encode()) for x in names.to_pylist()], dtype=np.uint64)
    counts = np.asarray(pc.list_value_length(lists))
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(word))  # words from here to the end of the piece
    w = np.repeat(weight, counts)
    number = word
    for n in range(1, most + 1):
        at = np.flatnonzero(left >= n)
        if not len(at):
            return
        key = word[at] if n == 1 else number[at] << 32 | word[at + n - 1]
        first, total, mine = _totals(key, w[at])
        number = np.zeros(len(word), dtype=np.int64)
        number[at] = mine
        places = at[first]
        h = np.zeros(len(places), dtype=np.uint64)
        parts = []
        for k in range(n):
            h = mix(h + own[word[places + k]] + np.uint64(k + 1))
            parts.append(names.take(pa.array(word[places + k])))
        yield n, parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " "), total, h


def _send_grams(buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed():
            t = pa.concat_tables(held).combine_chunks()
            held.clear()
            langs = t["lang"].combine_chunks().dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                rows = t.filter(pc.equal(langs.indices, k)).combine_chunks()
                made, hashes = [], []
                for n, gram, total, h in grams(rows["piece"].combine_chunks(), rows["m"].to_numpy(), most):
                    made.append(pa.table([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), n)), gram, total], schema=_COUNTED))
                    hashes.append(h)
                    if n == 1:
                        made.append(pa.table([[lang], [0], [""], [int(total.sum())]], schema=_COUNTED))
                        hashes.append(np.zeros(1, np.uint64))
                h = mix(np.concatenate(hashes) + np.uint64(zlib.crc32(lang.encode())))
                yield from _sent(pa.concat_tables(made), (h % np.uint64(buckets)).astype(np.int64))

        for batch in _summed(batches, "lang, piece", "m"):
            t = pa.Table.from_batches([batch])
            words = np.asarray(pc.add(pc.count_substring(t["piece"], " "), 1)).cumsum()
            lo = 0
            while lo < t.num_rows:  # a few pieces can be as long as a document
                hi = max(lo + 1, int(np.searchsorted(words, (words[lo - 1] if lo else 0) + WORDS, side="right")))
                held.append(t.slice(lo, hi - lo))
                size += int(words[hi - 1] - (words[lo - 1] if lo else 0))
                if size >= WORDS:
                    yield from flushed()
                    size = 0
                lo = hi
        if held:
            yield from flushed()

    return run


def _count_grams(min_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _summed(batches, "lang, size, gram", "f", f"HAVING size = 0 OR sum(f) >= {min_count}"):
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(batch.columns, _COUNTED, strict=True)], schema=_COUNTED)

    return run


def gram_counts(docs: DataFrame, spark: SparkSession, most: int = 3, min_count: int = 10) -> DataFrame:
    """lang, size, gram, f of all n-grams of ``min_count`` occurrences; size 0: parts of the number of all words."""
    small_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(MOST_BUCKETS, max(1, -(-size // BUCKET_BYTES))))
    dealt = lambda df: df.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    sent = dealt(texts.mapInArrow(tidy(_send_pieces(buckets)), "bucket long, block binary"))
    grams_ = dealt(sent.mapInArrow(tidy(_send_grams(buckets, most)), "bucket long, block binary"))
    return grams_.mapInArrow(tidy(_count_grams(min_count)), "lang string, size long, gram string, f long")


def cut_scores(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``found`` (lang, size, gram, f) with its lowest-scoring cut: l, r, score. Parts ask for their counts by
    shuffled requests, each with the phrase it comes from."""
    words = F.split("gram", " ")
    part = lambda first, n, k, side: F.struct(F.array_join(F.slice(words, first, n), " ").alias("part"), k.alias("k"), F.lit(side).alias("side"))
    asks = F.flatten(
        F.transform(F.sequence(F.lit(1), F.col("size").cast("int") - 1), lambda k: F.array(part(1, k, k, 0), part(k + 1, F.col("size").cast("int") - k, k, 1)))
    )
    requests = found.withColumn("ask", F.explode(asks)).select("lang", "size", "gram", F.col("f").alias("a"), "ask.*")
    held = counts.where(F.col("size") > 0).select("lang", F.col("gram").alias("part"), F.col("f").alias("has"))
    answers = requests.join(held, ["lang", "part"]).groupBy("lang", "size", "gram", "a").agg(F.collect_list(F.struct("k", "side", "has")).alias("parts"))
    of = lambda k, side: F.element_at(F.filter("parts", lambda p: (p["k"] == k) & (p["side"] == side)), 1)["has"]
    big = lambda x: x.cast("decimal(19,0)")
    whole = answers.withColumn("cut", F.transform(F.sequence(F.lit(1), F.col("size").cast("int") - 1), lambda k: F.struct(k.alias("k"), of(k, 0).alias("l"), of(k, 1).alias("r"))))
    # Products pass 64 bits; decimals of 38 digits hold them, and div is exact.
    scored = whole.withColumn("num", big(F.lit(1_000_000)) * (big(F.col("a")) * big(F.col("a")))).withColumn("c", F.explode("cut"))
    scored = scored.select("lang", "size", "gram", "a", F.expr("num div (CAST(c.l AS DECIMAL(19,0)) * CAST(c.r AS DECIMAL(19,0)))").alias("score"), "c.k", "c.l", "c.r")
    best = F.min(F.struct("score", "k", "l", "r")).alias("b")
    return scored.groupBy("lang", "size", "gram", "a").agg(best).select("lang", "size", F.col("gram").alias("phrase"), "a", "b.l", "b.r", "b.score")


def without_contained(scored: DataFrame, found: DataFrame, share: int = 50) -> DataFrame:
    """``scored`` without phrases inside a longer one of ``found`` that has ``share`` in a hundred of their count."""
    words, n = F.split("gram", " "), F.col("size").cast("int")
    inner = F.flatten(
        F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.array_join(F.slice(words, i, m), " ")))
    )
    longer = found.where(F.col("size") > 2).select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return scored.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")


def first_of_each(rows: DataFrame, count: int, by: str, order: list, top: int, spread: str, share: int = 50_000, fan: int = 32) -> DataFrame:
    """``rank`` and the first ``top`` rows of each ``by`` in the order. No task orders all rows of a key: shares of the
    rows, by the hash of ``spread``, keep their first ``top`` each, again and again until one share is left."""
    shares = max(1, -(-count // share))
    while True:
        w = Window.partitionBy(by, "share").orderBy(*order)
        rows = rows.withColumn("share", F.pmod(F.xxhash64(spread), F.lit(shares)))
        rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        if shares == 1:
            return rows.withColumn("rank", F.col("rank").cast("long")).drop("share")
        rows = rows.drop("rank")
        shares = max(1, shares // fan)


def collocations(docs: DataFrame, spark: SparkSession, most: int = 3, min_count: int = 10, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    counts = stored(gram_counts(docs, spark, most, min_count), spark, "grams")
    found = counts.where(F.col("size") > 1)
    left = stored(without_contained(cut_scores(found, counts), found), spark, "phrases")
    words = counts.where(F.col("size") == 0).groupBy("lang").agg(F.sum("f").alias("n"))
    ranked = first_of_each(left, left.count(), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "phrase")
    return ranked.join(sized(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
