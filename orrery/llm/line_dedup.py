"""Line deduplication by an exact set-similarity join, in built-in SQL functions only.

A line is the set of its lower-cased words (divided by blanks). A line goes when an earlier one, by (doc_id, place),
has a Jaccard similarity of at least ``threshold``, whether or not that earlier line stays itself. Lines of fewer than
``min_words`` different words always stay, as do blank ones; the query and the pipeline set it to 1.

Words are ordered by rarity: a 64-bit key has the level of the word's counter cell in its top bits (2**16 cells, a
fixed size), its hash below. Sets that are equal are merged first; sets so small that only equal ones reach the
threshold are settled by that and form no pairs. A larger set's prefix, its ``n - ceil(t n) + m`` rarest words, meets
the prefixes of sets no larger, of which ``n - ceil(2 t n / (1 + t)) + m`` words are enough; they must share m words,
more for long lines. Pairs must pass the length
and positional filters and parity bitmaps of the rarest words (one bit flipped by each: bits differ in no more places
than words do); all of that is part of the join, so what fails is never written.

As one earlier line is enough, the join has two rounds: first, for words that many sets have, the earliest of them and
those just before a set, which settles large groups of near copies without pairing their members; then, for sets not
settled by that, all earlier ones.

Null texts stay null, empty ones empty; blank lines and ties change nothing. Rows that repeat a doc_id with
its text count as one document and are treated alike; those with one doc_id (or none) and different texts are documents
of their own, ordered by a hash of the text. Documents of which no line stays are ``emptied``. Extra columns are kept by
``drop_repeated_lines``; none are needed, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm._store import BROADCAST_ROWS, discard, sized, stored

#: xxhash64('') under Spark's seed: what blanks next to each other leave.
_EMPTY = -7444071767201028348
#: Entries of one word that are lined up together.
LINE = 4000
#: Words that more sets than this share in their prefixes get the first round.
MANY = 300
#: The rarest words of a set that its bitmaps tell.
FEW = 24


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("rank", F.posexplode(F.split("text", "\n")).alias("no", "line"))


def cell_levels(docs: DataFrame) -> Column:
    """Array literal: level 0 to 15 of each of 2**16 counter cells by how many words fell into it, in a key's top bits."""
    words = docs.select(F.explode(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")).alias("w"))
    cells = words.select(F.shiftrightunsigned(F.xxhash64("w"), 48).cast("int").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    got = {r["cell"]: r["n"] for r in cells.collect()}
    counts = [got.get(k, 0) for k in range(1 << 16)]
    mid = sorted(counts)[len(counts) // 2]
    level = [min(15, int(1 + max(0, n - mid) / (mid**0.5 + 1)).bit_length() - 1) for n in counts]
    return F.split(F.lit(",".join(str(x << 58) for x in level)), ",").cast("array<bigint>")


def _keys(line: Column, levels: Column) -> Column:
    """The set as sorted longs: rarity first."""
    hashes = F.array_remove(F.array_distinct(F.transform(F.split(F.lower(line), " "), lambda w: F.xxhash64(w))), _EMPTY)
    level = lambda h: F.coalesce(F.get(levels, F.shiftrightunsigned(h, 48).cast("int")), F.lit(0).cast("long"))
    return F.sort_array(F.transform(hashes, lambda h: level(h).bitwiseOR(h.bitwiseAND((1 << 58) - 1))))


def _common(n: str) -> str:
    """How many words the prefixes of two sets share that reach the threshold, the smaller having n: prefixes are as much
    longer. Long lines meet by chance in one rare word, and hardly in more."""
    return f"if({n} < 40, 1, if({n} < 120, 2, 4))"


def _key_rows(lines: DataFrame, levels: Column) -> DataFrame:
    """key and w, the set of each line. The array of one makes sure that it is computed once, whatever is done with it."""
    return lines.select("key", F.explode(F.array(_keys(F.col("line"), levels))).alias("w"))


def _parity() -> Column:
    """Bitmap of 64 bits, one flipped by each of the set's FEW rarest words. Written out, and no longer than the virtual
    machine compiles."""
    return F.expr(" ^ ".join(f"coalesce(shiftleft(1L, cast(get(w, {j}) & 63 as int)), 0L)" for j in range(FEW)))


def free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column has."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def ranked(docs: DataFrame, spark: SparkSession, name: str) -> tuple[DataFrame, int, DataFrame]:
    """``docs`` with the column ``name``, which orders documents as doc_id and then a hash of the text do; the bits that
    the places of lines need (by the longest document; ranks have the rest of 63 bits); and the ranks (rank) of rows whose
    text an earlier document has."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.octet_length("text").alias("bytes"))
    rows = stored(rows, spark, "texts")
    got = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("bytes").alias("longest")).first()
    bits, own = (got["longest"] or 0).bit_length(), docs["doc_id"].cast("long")
    several = rows.groupBy("doc_id").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b")
    if (got["lo"] is None or got["hi"] - got["lo"] < (1 << (63 - bits)) - 1) and several.isEmpty():
        simple = lambda c: F.coalesce(c - F.lit(got["lo"] or 0) + 1, F.lit(0).cast("long"))
        rows = rows.withColumn("rank", simple(F.col("doc_id")))
        docs = docs.withColumn(name, simple(own))
    else:
        ids = rows.select("doc_id", "th").distinct().repartitionByRange("doc_id", "th")
        ids = stored(ids.withColumn("part", F.spark_partition_id()), spark, "ids")
        parts = ids.groupBy("part").agg(F.count("*").alias("n"))
        before = parts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
        at, th = free(docs, "id"), free(docs, "th")
        number = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "th")) + F.col("before")
        place = stored(ids.join(before, "part").select(F.col("doc_id").alias(at), F.col("th").alias(th), number.cast("long").alias(name)), spark, "ranks")
        rows = place.select(F.col(th).alias("th"), F.col(name).alias("rank"))
        docs = docs.join(place, own.eqNullSafe(F.col(at)) & (F.xxhash64(docs["text"]) == F.col(th))).drop(at, th)
    first = rows.groupBy("th").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last")
    return docs, bits, sized(stored(rows.join(sized(first), "th").where("rank > first").select("rank").distinct(), spark, "copies"))


def removed_lines(docs: DataFrame, copies: DataFrame, spark: SparkSession, bits: int, threshold: tuple[int, int] = (9, 10), min_words: int = 5) -> DataFrame:
    """Key (rank, then place from 0 in its last ``bits`` bits) of each line that repeats an earlier one; ``docs`` has
    rank and text, ``copies`` the ranks of texts that stand earlier too."""
    num, den = threshold
    docs = docs.where("text is not null").select("rank", "text")
    key = F.shiftleft(F.col("rank"), bits).bitwiseOR(F.col("no").cast("long"))
    solid = F.ltrim("line") != ""
    copied = None
    if min_words <= 1:
        # Of a document that is another once more, each line with a word goes: no set of it needs to be made.
        copied = _lines(docs.join(copies, "rank", "left_semi")).where(solid).select(key.alias("key"))
        docs = docs.join(copies, "rank", "left_anti")
    levels = cell_levels(docs)
    size = F.size("w")
    cut = size - F.expr(f"cast((size(w) * {num}L + {den - 1}) div {den} as int)") + F.expr(_common("size(w)"))
    # Sets of n and n + 1 words reach the threshold at best by n / (n + 1); with fewer words only equal sets do.
    pairable = size * (den - num) >= num
    made = _key_rows(_lines(docs).where(solid).select(key.alias("key"), "line"), levels)
    if min_words > 1:
        made = made.where(size >= min_words)
    index = stored(
        made.select(
            "key", size.alias("n"), F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(7), "w").alias("h2"),
            F.when(pairable, _parity()).alias("bits"), F.when(pairable, F.slice("w", 1, cut)).alias("prefix"),
        ),
        spark, "lines",
    )
    # Equal sets have equal bitmaps and prefixes, so whichever row comes first says the same.
    sets = stored(index.groupBy("h1", "h2", "n").agg(F.min("key").alias("key"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix")), spark, "sets")
    enough = F.expr(f"n - cast((2L * {num} * n + {num + den - 1}) div {num + den} as int) + {_common('n')}")
    entries = sets.where("prefix is not null").select("key", "n", "bits", enough.alias("index"), F.posexplode("prefix").alias("pos", "word"))
    least = f"(({num}L * (na + nb) + {num + den - 1}) div {num + den})"
    filters = f"a > b and least(na, nb) * {den} >= greatest(na, nb) * {num} and least(pa, pb) + least(na - pa, nb - pb) >= {least}"
    # If at most k words of the larger set are not in the other, as many rarest words of each differ in 2 k at most.
    filters += f" and bit_count(bitsa ^ bitsb) <= 2 * (greatest(na, nb) - {least}) and if(na < nb, pa < indexa, if(nb < na, pb < indexb, pa < indexa or pb < indexb))"
    parts = {"key": "", "n": "n", "pos": "p", "bits": "bits", "index": "index"}

    def verified(pairs: DataFrame) -> DataFrame:
        """First keys of the pairs that reach the threshold."""
        pairs = stored(pairs.distinct(), spark, "pairs")
        if pairs.isEmpty():
            return pairs.select(F.col("a").alias("key"))
        needed = stored(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct(), spark, "needed")
        held = stored(needed.select(F.shiftright("key", bits).alias("rank")).distinct(), spark, "held")
        texts = docs.join(sized(held), "rank", "left_semi")
        whole = _lines(texts).select(key.alias("key"), "line").join(sized(needed), "key", "left_semi")
        # A document that stands twice gives its lines twice; the distinct below sees to that.
        whole = stored(_key_rows(whole, levels), spark, "whole")
        a, b = whole.select(F.col("key").alias("a"), F.col("w").alias("wa")), whole.select(F.col("key").alias("b"), F.col("w").alias("wb"))
        both = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("wa", "wb")))
        out = stored(both.where(f"both * {den} >= (size(wa) + size(wb) - both) * {num}").select(F.col("a").alias("key")).distinct(), spark, "later")
        discard(spark, pairs, needed, held, whole)
        return out

    # Words that many sets have: each set against the first of its line and those just before it.
    many = entries.groupBy("word").agg(F.count("*").alias("met"), F.max(F.col("pos") < F.col("index")).alias("indexed"))
    many = sized(stored(many.where(f"met > {MANY} and indexed").select("word", "met"), spark, "many"))
    along = Window.partitionBy("word", "slot").orderBy("key")
    other = F.struct(*[F.col(c).alias(f"{x}b" if x else "b") for c, x in parts.items()])
    before = [F.first(other).over(along.rowsBetween(Window.unboundedPreceding, -1)), *[F.lag(other, j).over(along) for j in (1, 2, 3)]]
    lined = entries.join(many, "word").withColumn("slot", F.pmod(F.xxhash64("key"), F.ceil(F.col("met") / LINE)))
    lined = lined.select(*[F.col(c).alias(f"{x}a" if x else "a") for c, x in parts.items()], *[x.alias(f"o{j}") for j, x in enumerate(before)])
    lined = lined.select(*[f"{x}a" if x else "a" for x in parts.values()], F.inline(F.filter(F.array(*[f"o{j}" for j in range(len(before))]), lambda o: o.isNotNull())))
    near = verified(lined.where(filters).select("a", "b"))

    # All others against all earlier ones: x is the larger set or, of equally large ones, the later.
    settled = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    known = entries.join(settled.select("key", F.lit(True).alias("settled")), "key", "left")
    x, y = (rows.select("word", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "pos", "bits", "settled")]) for s, rows in (("x", known), ("y", known.where("pos < index"))))
    least_xy = least.replace("na", "n_x").replace("nb", "n_y")
    fit = (
        f"(n_x > n_y or (n_x = n_y and key_x > key_y)) and n_y * {den} >= n_x * {num} and bit_count(bits_x ^ bits_y) <= 2 * (n_x - {least_xy}) "
        f"and if(key_x > key_y, settled_x is null, settled_y is null) and least(pos_x, pos_y) + least(n_x - pos_x, n_y - pos_y) >= {least_xy}"
    )
    more = x.join(y, "word").where(fit).select(F.greatest("key_x", "key_y").alias("a"), F.least("key_x", "key_y").alias("b"), F.expr(_common("n_y")).alias("need"))
    more = more.groupBy("a", "b", "need").agg(F.count("*").alias("met")).where("met >= need").select("a", "b")
    later = near.union(verified(more))
    # What stays of all lines is the first of each set, unless an earlier set is like it.
    stays = sets.select("key").join(later, "key", "left_anti")
    gone = index.select("key").join(stays, "key", "left_anti")
    return (gone.union(copied) if copied is not None else gone).distinct()


def _marked(docs: DataFrame, spark: SparkSession, threshold: tuple[int, int], min_words: int) -> tuple[DataFrame, str]:
    """``docs`` with another column, whose name comes back too: the places of lines to remove (null if none)."""
    rank, gone, at = free(docs, "rank"), free(docs, "gone"), free(docs, "at")
    own, bits, copies = ranked(docs, spark, rank)
    keys = removed_lines(own.select(F.col(rank).alias("rank"), F.col("text").alias("text")), copies, spark, bits, threshold, min_words)
    places = keys.groupBy(F.shiftright("key", bits).alias(at)).agg(F.collect_list(F.col("key").bitwiseAND((1 << bits) - 1).cast("int")).alias(gone))
    places = sized(stored(places, spark, "gone"))
    return own.join(places, F.col(rank) == F.col(at), "left").drop(rank, at), gone


def _kept_text(gone: str) -> Column:
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    return F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))


def dedup_lines(docs: DataFrame, spark: SparkSession, threshold: tuple[int, int] = (9, 10), min_words: int = 5) -> DataFrame:
    """doc_id, n_lines, n_removed, emptied and the text that stays, for every row."""
    marked, gone = _marked(docs.select("doc_id", "text"), spark, threshold, min_words)
    out = marked.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
        _kept_text(gone).alias("text"),
    )
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", "\n", " ")) == "")
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.greatest("n_removed", F.lit(0)).alias("n_removed"), F.coalesce(emptied, F.lit(False)).alias("emptied"), "text")


def drop_repeated_lines(docs: DataFrame, spark: SparkSession, threshold: tuple[int, int] = (9, 10), min_words: int = 5) -> DataFrame:
    """``docs`` with repeated lines taken out of text (n_chars follows, where there is such a column); documents of
    which nothing stays go. All columns stay."""
    marked, gone = _marked(docs, spark, threshold, min_words)
    marked = marked.withColumn("text", _kept_text(gone))
    marked = marked.where(F.col(gone).isNull() | (F.trim(F.regexp_replace("text", "\n", " ")) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        marked = marked.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return marked.select(docs.columns)
