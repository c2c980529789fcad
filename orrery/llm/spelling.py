"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

One inserted, deleted or replaced letter leaves a half of a word as it was. A word of ``l`` letters stands in the
classes ``l`` (as the longer or one of two equally long words) and ``l + 1`` (as the shorter), in each of them in the
block of the words with the same first ``class // 2`` letters (the forward dictionary) and with the same last ones (the
reversed one). Blocks are ranges of the sorted dictionaries. A block of more than ``BLOCK`` words is divided, as the
edit again leaves half of what lies between the shared ends as it was: into blocks with more letters in front and
blocks with more letters behind. At last one letter lies between them, and such a block has at most one word for each
letter there is. Sizes are counted, and blocks divided, by Spark for all large blocks at once.

A pair belongs to the block with the longer shared front where it has one, so ``below`` says of the other block that
its pairs share fewer letters in front; each pair is met once. Every pair of a block is compared letter by letter.

Defined results: null and empty texts have no words, repeated rows count as often as they occur, an empty table has no
words, and a null id counts as an empty one. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm._store import discard, sized, small_batches, stored, tidy
from orrery.llm._text import BLOCK as BYTES
from orrery.llm._text import LOWER, buffers

#: Words of a block that is compared as it is.
BLOCK = 48
#: Pairs that are compared at a time, and distinct words that a task adds up before it hands them on.
PAIRS, WORDS = 1 << 18, 1 << 19
#: One in so many (document, word) hashes marks an occurrence for a deletion.
EDIT_EVERY = 97

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b == 0xC3 for b in range(256)])
_SHORT = 48


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32 (reflected polynomial EDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1)).astype(np.uint32)
    return t


_CRC = _crc_table()


def _shifted(states: np.ndarray, n: int) -> np.ndarray:
    """Checksums as they stand after 0, 1, ... n further zero bytes, without the final complement: (n + 1) x states."""
    out = np.empty((n + 1, len(states)), dtype=np.uint32)
    out[0] = states
    for k in range(n):
        out[k + 1] = _CRC[out[k] & np.uint32(255)] ^ (out[k] >> np.uint32(8))
    return out


def runs(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Runs of ASCII letters and U+00C0 to U+00FF of the rows, A-Z lower-cased, and the row of each."""
    data = data[offs[0] : offs[-1]]
    offs = offs - offs[0]
    solid = _LETTER[data]
    solid[1:] |= data[:-1] == 0xC3  # in UTF-8 these are C3 and one byte more
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    full = offs[:-1][offs[1:] > offs[:-1]]
    start[full] = solid[full]
    at = np.flatnonzero(start)
    bytes_ = LOWER[data[solid]]
    rank = np.cumsum(solid, dtype=np.int64)
    borders = np.append(rank[at] - 1, len(bytes_)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(borders), pa.py_buffer(bytes_))
    return words, np.searchsorted(offs, at, side="right") - 1


def edited_counts(words: pa.Array, rows: np.ndarray, ids: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and their occurrences, marked occurrences with their letter deleted. ``ids``: what stands before
    the colon, of each row."""
    coded = words.dictionary_encode()
    code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    raw = [w.encode() for w in names]
    length = np.array([len(w) for w in raw], dtype=np.int64)
    own = np.array([zlib.crc32(w) for w in raw], dtype=np.uint32)
    # The checksum of a joined text: that of its front, moved on by the length of its back, and that of its back.
    front = np.array([zlib.crc32(i + b":") for i in ids], dtype=np.uint32)
    longest = int(min(length.max(initial=0), _SHORT))
    moved = _shifted(front, longest)
    h = moved[np.minimum(length[code], longest), rows] ^ own[code]
    for k in np.flatnonzero(length[code] > longest):
        h[k] = zlib.crc32(raw[code[k]], int(front[rows[k]]))
    marked = np.flatnonzero(h % EDIT_EVERY == 0)
    counts = np.bincount(code, minlength=len(names)) - np.bincount(code[marked], minlength=len(names))
    changed: dict[str, int] = {}
    for k in marked:
        w = names[code[k]]
        i = int(h[k]) % len(w)
        if w := w[:i] + w[i + 1 :]:
            changed[w] = changed.get(w, 0) + 1
    out = pa.concat_arrays([coded.dictionary, pa.array(list(changed), type=pa.large_string())])
    return out, np.concatenate([counts, np.fromiter(changed.values(), np.int64, len(changed))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[pa.Table] = []

    def summed() -> pa.Table:
        t = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
        parts[:] = [t]
        return t

    pending = 0
    for batch in batches:
        data, offs = buffers(batch.column(1))
        ids = [i.encode() for i in batch.column(0).to_pylist()]
        lo, n = 0, len(offs) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + BYTES, side="right")) - 1)
            words, rows = runs(data, offs[lo : hi + 1])
            if len(words):
                w, c = edited_counts(words, rows, ids[lo:hi])
                parts.append(pa.table({"word": w.cast(pa.string()), "n": c}))
                pending += len(w)
            if pending >= WORDS:
                if (t := summed()).num_rows >= WORDS // 2:
                    yield from t.to_batches(1 << 16)
                    parts.clear()
                pending = sum(p.num_rows for p in parts)
            lo = hi
    if parts:
        yield from summed().to_batches(1 << 16)


def word_counts(docs: DataFrame, spark: SparkSession, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """word, n: the edited words of all texts that are long and frequent enough."""
    small_batches(spark)
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").where(F.col("text").isNotNull()).mapInArrow(tidy(_count), "word string, n long")
    counted = found.where((F.col("n") > 0) & (F.length("word") >= min_length)).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


_BLOCK = ["cls", "front", "back", "below", "key"]


def _keyed(rows: DataFrame) -> DataFrame:
    """The block's key: its letters in front, and those behind read from the end."""
    return rows.withColumn("key", F.concat_ws("|", F.substring("word", F.lit(1), F.col("front")), F.reverse(F.expr("right(word, back)"))))


def _entries(words: DataFrame) -> DataFrame:
    """Each word in the two blocks, of the forward and of the reversed dictionary, of its two classes."""
    half = F.expr("cls div 2").cast("int")
    both = F.array(
        F.struct(half.alias("front"), F.lit(0).alias("back"), (F.col("cls") + 1).alias("below")),
        F.struct(F.lit(0).alias("front"), half.alias("back"), half.alias("below")),
    )
    long = words.withColumn("cls", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    return _keyed(long.withColumn("b", F.explode(both)).select("word", "n", "cls", "b.*"))


def _divided(rows: DataFrame) -> DataFrame:
    """Rows of blocks that are too large, in the blocks that share half of what lies between the ends more."""
    half = F.expr("(cls - front - back) div 2").cast("int")
    both = F.array(
        F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back"), F.col("below").alias("below")),
        F.struct(F.col("front").alias("front"), (F.col("back") + half).alias("back"), F.least("below", F.col("front") + half).alias("below")),
    )
    return _keyed(rows.withColumn("b", F.explode(both)).select("word", "n", "cls", "b.*"))


def blocks(words: DataFrame, spark: SparkSession, most: int = BLOCK) -> list[DataFrame]:
    """Stored tables of entries, no block larger than ``most`` but those with one letter between their ends."""
    out, rows = [], stored(_entries(words), spark, "entries")
    while True:
        wide = F.col("cls") - F.col("front") - F.col("back") > 1
        large = stored(rows.where(wide).groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most).drop("size"), spark, "large")
        if large.isEmpty():
            discard(spark, large)
            return [*out, rows]
        held = sized(large)
        out.append(stored(rows.join(held, _BLOCK, "left_anti"), spark, "blocks"))
        more = stored(_divided(rows.join(held, _BLOCK, "left_semi")), spark, "entries")
        discard(spark, rows, large)
        rows = more


def _compared(a: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, cls: int, below: np.ndarray) -> np.ndarray:
    """Which pairs of rows of the letters ``a`` (words x cls, zeros behind short words) are one edit apart."""
    same = a[i] == a[j]
    front = np.where(same.all(axis=1), cls, np.argmin(same, axis=1))
    equal = (size[i] == cls) & (size[j] == cls)
    near = equal & (same.sum(axis=1) == cls - 1)
    other = np.flatnonzero(size[i] != size[j])
    if len(other):
        longer, shorter = np.where(size[i[other]] == cls, i[other], j[other]), np.where(size[i[other]] == cls, j[other], i[other])
        rest = a[longer][:, 1:] == a[shorter][:, : cls - 1]  # letters after the one left out
        tail = np.where(rest.all(axis=1), cls - 1, np.argmin(rest[:, ::-1], axis=1))
        near[other] = np.minimum(front[other], cls - 1) + tail >= cls - 1
    return near & (np.minimum(front, cls) < below)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sorted rows of whole blocks: each word's near words in its block, counted, and the best of them."""
    carried: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if carried is None else pa.concat_tables([carried, t])
        keys = t.select(_BLOCK).combine_chunks()
        last = keys.slice(t.num_rows - 1, 1).to_pylist()[0]
        at_last = np.ones(t.num_rows, dtype=bool)
        for c in _BLOCK:
            at_last &= np.asarray(pc.equal(keys[c], last[c]))
        cut = int(np.argmax(at_last))  # rows are sorted: the last block is the end
        carried = t.slice(cut)
        yield from _block_links(t.slice(0, cut))
    if carried is not None:
        yield from _block_links(carried)


def _block_links(t: pa.Table) -> Iterator[pa.RecordBatch]:
    if t.num_rows < 2:
        return
    t = t.combine_chunks()
    cols = {c: t[c].to_numpy() for c in ("cls", "front", "back", "below")}
    keys = t["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    new = np.ones(t.num_rows, dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    for c in cols.values():
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, t.num_rows))
    words, n = t["word"].combine_chunks(), t["n"].to_numpy()
    text = words.to_numpy(zero_copy_only=False)
    # From each row to the rows of its block behind it.
    behind = np.repeat(first + size, size) - np.arange(t.num_rows) - 1
    done = np.concatenate([[0], np.cumsum(behind)])
    lo = 0
    while lo < t.num_rows:
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(lo, hi), behind[lo:hi])
        j = np.arange(len(i)) - np.repeat(done[lo:hi] - done[lo], behind[lo:hi]) + i + 1
        for cls in np.unique(cols["cls"][i]) if len(i) else ():
            mine = cols["cls"][i] == cls
            a, b = i[mine], j[mine]
            rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            raw = [x.encode("latin-1") for x in text[rows]]
            letters = np.frombuffer(b"".join(x.ljust(cls, b"\0") for x in raw), np.uint8).reshape(len(raw), cls)
            near = _compared(letters, np.array([len(x) for x in raw]), at[: len(a)], at[len(a) :], int(cls), cols["below"][a])
            x, y = np.concatenate([a[near], b[near]]), np.concatenate([b[near], a[near]])
            if len(x):
                # Rows of a block are in the order of their words: of equal counts the first row is the first word.
                order = np.lexsort((y, -n[y], x))
                x, y = x[order], y[order]
                at_first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                links = np.diff(np.append(at_first, len(x)))
                x, y = x[at_first], y[at_first]
                out = pa.table({"word": words.take(pa.array(x)), "links": links, "near": words.take(pa.array(y)), "near_n": n[y]})
                yield from out.to_batches(1 << 16)
        lo = hi


def near_words(words: DataFrame, spark: SparkSession, most: int = BLOCK) -> DataFrame:
    """word, n_near, form, form_n: how many words are one edit away, and the most frequent of them (of several the
    first). ``words`` has word (of letters up to U+00FF) and n; it is a stored table."""
    parts, links = blocks(words, spark, most), None
    for part in parts:
        ordered = part.repartitionByRange(*_BLOCK).sortWithinPartitions(*_BLOCK, "word").select("word", "n", *_BLOCK)
        found = ordered.mapInArrow(tidy(_links), "word string, links long, near string, near_n long")
        links = found if links is None else links.unionByName(found)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    summed = links.groupBy("word").agg(F.sum("links").alias("n_near"), best.alias("best"))
    out = stored(summed.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), spark, "near")
    discard(spark, *parts)
    return out


def roots(links: DataFrame, spark: SparkSession) -> DataFrame:
    """word, root: where following word to form ends. A form is more frequent than its word, so there are no rings.
    Each round doubles the steps of the words whose way goes on; those that have ended stay out of its join."""
    forms = links.select(F.col("word").alias("via"))
    ways = stored(links.join(forms, links["form"] == forms["via"], "left").select("word", F.col("form").alias("root"), F.col("via").isNull().alias("over")), spark, "ways")
    while not (going := ways.where(~F.col("over"))).isEmpty():
        on = ways.select(F.col("word").alias("via"), F.col("root").alias("next"), F.col("over").alias("ends"))
        moved = going.join(on, going["root"] == on["via"]).select("word", F.col("next").alias("root"), F.col("ends").alias("over"))
        old, ways = ways, stored(ways.where(F.col("over")).unionByName(moved), spark, "ways")
        discard(spark, old)
    return ways.select("word", "root")


def spelling_variants(docs: DataFrame, spark: SparkSession, min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word: its form is the near word of largest n (of several
    the first in code-point order) if that is ``ratio`` times its own n at least, and its root the last of its forms."""
    words = stored(word_counts(docs, spark, min_length, min_count), spark, "words")
    near = near_words(words, spark)
    whole = words.join(near, "word", "left")
    takes = F.col("form_n") >= ratio * F.col("n")
    formed = stored(
        whole.select("word", F.when(takes, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form_n")).alias("form_n")),
        spark, "formed",
    )
    discard(spark, words, near)
    ends = roots(formed.where(F.col("form").isNotNull()), spark)
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
