"""N-gram Jaccard join by multiple-global-order filtering, and near-duplicate classes from its links.

Documents are sets of distinct word n-grams. Under any total order of all n-grams, two sets with a Jaccard similarity
of at least t share an element among their first ``n - ceil(t n) + 1``, of the smaller even among its first
``n - ceil(2 t n / (1 + t)) + 1``. Candidates must share such prefix elements under every one of several orders; only
then are the sets compared exactly.

The orders: n-grams whose counter cell is full are late in each of them (rarity), ties are broken by a different hash
in each. Counters are kept for 2**16 hash cells, a fixed size whatever the corpus; any order is correct, a better one
only gives fewer candidates.

Equal sets are merged first, so copies cost one row each. Links are sought in two steps. First, sets with the same
first n-gram under one of a few plain hash orders are lined up and only neighbours compared, then each with the one of them that has
most links: a number of pairs that grows with the documents and not with the square of a group; that joins most near
copies. Then all pairs of sets that share a prefix
n-gram under the first order, are in different classes still, and pass the size and positional filters and a parity
sketch (two sets that differ in d elements differ in d bits at most) are candidates; the sketch is part of the join,
so pairs it drops are never written. No link between different texts is lost as far as classes go: each skipped pair
is within one class already.

Every row is a document of its own, known by its text: rows may lack a doc_id or share one. Null and empty texts have
no n-grams, link with nothing and are their own class. ``component_id`` is the smallest doc_id of a class; a class of
rows without doc_id has none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm import _text as tx
from orrery.llm._store import BROADCAST_ROWS, discard, free, sized, small_batches, stored, tidy
from orrery.llm.components import connected_components

CELLS = 1 << 16
#: Longs of the sketch that goes into the join; pairs are held after it against a wide one, of at least as many bits as
#: the set has elements.
NARROW = 8
#: Plain hash orders whose first n-gram lines sets up; rarity would put first what each copy has of its own.
LEADS = 3
#: Rows with one first n-gram that are lined up together.
LINE = 4000
#: How many of those before it a row in such a line is compared with, turn by turn.
NEIGHBOURS = (1, 8, 24)


def set_blocks(col: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct n-gram hashes row by row, number of them for each row)."""
    for block in tx.blocks(col, tx.SOLID):
        h, counts = block.hashes(), block.counts
        g, _ = tx.grams(h, block.first, n)
        size = np.maximum(counts - n + 1, 0)
        ends = np.cumsum(size)
        parts = []
        for i, (c, b) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
            if c >= n:
                parts.append(np.sort(g[b - (c - n + 1) : b]))
            elif c:
                parts.append(tx.gram_at(h, np.array([block.first[i]]), c))
                size[i] = 1
        g = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        if len(g):
            row = np.repeat(np.arange(len(size)), size)
            new = np.ones(len(g), dtype=bool)
            new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
            g, size = g[new], np.bincount(row[new], minlength=len(size))
        yield block.lo, g, size.astype(np.int64)


def cell_counts(docs: DataFrame, n: int, spark: SparkSession) -> np.ndarray:
    """Number of n-gram occurrences for each of CELLS hash cells; the result has a fixed size."""

    def count(batches):
        cells = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for block in tx.blocks(batch.column(0), tx.SOLID):
                g, _ = tx.grams(block.hashes(), block.first, n)
                cells += np.bincount((g >> np.uint64(48)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "n"])

    got = docs.select("text").mapInArrow(tidy(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, dtype=np.int64)
    out[got["cell"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


def levels(cells: np.ndarray) -> np.ndarray:
    """0 for cells as full as most, up to 15 for those far fuller."""
    mid = np.median(cells)
    return np.minimum(15, np.floor(np.log2(1 + np.maximum(0, cells - mid) / (np.sqrt(mid) + 1)))).astype(np.uint64)


def order_key(g: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    turned = tx.mix(g + np.uint64(order * 0xA0761D6478BD642F % 2**64)) if order else g * np.uint64(0xE7037ED1A0B428DB)
    return (level[(g >> np.uint64(48)).astype(np.int64)] << np.uint64(60)) | (turned >> np.uint64(4))


def prefix_sizes(size: np.ndarray, t: Fraction) -> np.ndarray:
    least = -((-size * t.numerator) // t.denominator)
    return np.where(size > 0, size - least + 1, 0)


def parity(g: np.ndarray, size: np.ndarray, longs: np.ndarray, salt: int) -> np.ndarray:
    """Set after set, ``longs`` of them for each (a power of two): bits that tell whether an odd number of its elements
    fell there. The halves of a sketch, one flipping the other, are the sketch of half the length."""
    first = np.concatenate([[0], np.cumsum(longs)]) * 64
    cell = tx.mix(g ^ np.uint64(salt)) & np.repeat(longs * 64 - 1, size).astype(np.uint64)
    odd = np.bincount(cell.astype(np.int64) + np.repeat(first[:-1], size), minlength=int(first[-1])) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def wide_longs(size: np.ndarray) -> np.ndarray:
    return 1 << np.ceil(np.log2(np.maximum(size, 64) / 64)).astype(np.int64)


def describe_sets(docs: DataFrame, n: int, t: Fraction, level: np.ndarray, orders: int) -> DataFrame:
    """doc_id, th (hash of the text), size of the set, two hashes of the whole set, its sketches, its first element under
    each of the plain orders, and its prefix under each of the others."""

    def prefixes(batches):
        for batch in batches:
            for lo, g, size in set_blocks(batch.column(2), n):
                first = np.concatenate([[0], np.cumsum(size)])
                full = size > 0
                cols = [batch.column(0).slice(lo, len(size)), batch.column(1).slice(lo, len(size)), pa.array(size)]
                for salt in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
                    total = np.zeros(len(size), dtype=np.uint64)
                    if len(g):
                        total[full] = np.add.reduceat(tx.mix(g ^ np.uint64(salt)), first[:-1][full])
                    cols.append(pa.array(tx.signed(total)))
                narrow = parity(g, size, np.full(len(size), NARROW), 0x1D8E4E27C47D124F).reshape(-1, NARROW)
                cols += [pa.array(np.ascontiguousarray(narrow[:, j])) for j in range(NARROW)]
                cols.append(tx.list_array(parity(g, size, wide_longs(size), 0x369DEA0F31A53F85), wide_longs(size), pa.int64()))
                for k in range(LEADS):
                    least = np.zeros(len(size), dtype=np.uint64)
                    if len(g):
                        least[full] = np.minimum.reduceat(tx.mix(g ^ np.uint64((k + 1) * 0xD6E8FEB86659FD93 % 2**64)), first[:-1][full])
                    cols.append(pa.array(tx.signed(least)))
                take = prefix_sizes(size, t)
                for k in range(orders):
                    key, heads = order_key(g, level, k), []
                    for a, b, m in zip(first[:-1].tolist(), first[1:].tolist(), take.tolist(), strict=True):
                        if m:
                            own = key[a:b]
                            at = np.argpartition(own, m - 1)[:m] if m < b - a else np.arange(m)
                            heads.append(a + at[np.argsort(own[at])])
                    head = np.concatenate(heads) if heads else np.zeros(0, np.int64)
                    cols.append(tx.list_array(tx.signed(g[head]), take, pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "th", "size", "m1", "m2", *(f"s{j}" for j in range(NARROW)), "wide", *(f"lead{k}" for k in range(LEADS)), *(f"prefix{k}" for k in range(orders))]
    schema = ", ".join(f"{c} array<long>" if c == "wide" or c.startswith("prefix") else f"{c} long" for c in names)
    return _keyed(docs).mapInArrow(tidy(prefixes), schema)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def _whole_sets(texts: DataFrame, n: int) -> DataFrame:
    """v and the set's n-grams as bytes, from (v, text)."""

    def sets(batches):
        for batch in batches:
            for lo, g, size in set_blocks(batch.column(1), n):
                raw, first = g.tobytes(), np.concatenate([[0], np.cumsum(size)]) * 8
                own = pa.array([raw[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(size)), own], names=["v", "grams"])

    return texts.select("v", "text").mapInArrow(tidy(sets), "v long, grams binary")


class Verifier:
    """Exact comparison of candidate pairs (a, b) of vertices, behind the filters of the other orders."""

    def __init__(self, docs: DataFrame, reps: DataFrame, n: int, t: Fraction, orders: int, repeats: bool, spark: SparkSession):
        self.docs, self.reps, self.n, self.t, self.orders, self.repeats, self.spark = docs, reps, n, t, orders, repeats, spark

    def least(self) -> str:
        """Common elements that sets of size_a and size_b need."""
        num, den = self.t.numerator, self.t.denominator
        return f"(({num} * (size_a + size_b) + {num + den - 1}) div {num + den})"

    def sizes_fit(self) -> str:
        return f"least(size_a, size_b) * {self.t.denominator} >= greatest(size_a, size_b) * {self.t.numerator}"

    def sketches_fit(self) -> str:
        off = " + ".join(f"bit_count(s{j}_a ^ s{j}_b)" for j in range(NARROW))
        return f"{off} <= size_a + size_b - 2 * {self.least()}"

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that reach the similarity, as a stored table."""
        t, spark = self.t, self.spark
        pairs = stored(pairs.distinct(), spark, "pairs")
        if pairs.isEmpty():
            return pairs
        def ends(pairs: DataFrame) -> DataFrame:
            ids = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
            return F.broadcast(ids) if 2 * pairs.count() <= BROADCAST_ROWS else ids

        def joined(pairs: DataFrame, columns: list[str]) -> DataFrame:
            """The pairs with these columns of both of their sets."""
            own = self.reps.select("v", *columns).join(ends(pairs), "v", "left_semi")
            for s in ("a", "b"):
                pairs = pairs.join(own.select(F.col("v").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns]), s)
            return pairs

        def folded(s: str) -> Column:
            """The wide sketch, halved if the other is shorter; sizes that fit are never further apart."""
            own, n = F.col(f"wide_{s}"), F.size(f"wide_{s}")
            half_n = F.shiftright(n, 1)
            half = F.zip_with(F.slice(own, F.lit(1), half_n), F.slice(own, half_n + 1, half_n), lambda x, y: x.bitwiseXOR(y))
            return F.when(n > F.least(F.size("wide_a"), F.size("wide_b")), half).otherwise(own)

        off = F.aggregate(F.zip_with(folded("a"), folded("b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda k, x: k + x)
        both = joined(pairs, ["size", "wide"]).where(self.sizes_fit()).where(off <= F.expr(f"size_a + size_b - 2 * {self.least()}"))
        near = stored(both.select("a", "b"), spark, "near")
        both = joined(near, [f"prefix{k}" for k in range(1, self.orders)])
        for k in range(1, self.orders):
            both = both.where(F.arrays_overlap(f"prefix{k}_a", f"prefix{k}_b"))
        met = stored(both.select("a", "b"), spark, "candidates")
        if met.isEmpty():
            return met
        rows = self.reps.select("v", "rep_id").join(ends(met), "v", "left_semi")
        rows = F.broadcast(rows) if 2 * met.count() <= BROADCAST_ROWS else rows
        texts = _keyed(self.docs).join(rows, (F.col("th") == F.col("v")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("v", "text")
        grams = grams_table = stored(_whole_sets(texts, self.n), spark, "sets")
        if self.repeats:
            grams = grams.dropDuplicates(["v"])
        sides = [grams.select(F.col("v").alias(s), F.col("grams").alias(f"grams_{s}")) for s in ("a", "b")]

        def compare(batches):
            for batch in batches:
                keep = np.zeros(len(batch), dtype=bool)
                for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                    x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                    keep[i] = both * t.denominator >= (len(x) + len(y) - both) * t.numerator
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

        close = met.join(sides[0], "a").join(sides[1], "b").select("a", "b", "grams_a", "grams_b")
        out = stored(close.mapInArrow(tidy(compare), "a long, b long"), spark, "links")
        discard(spark, pairs, near, met, grams_table)
        return out


def lined_up(leads: DataFrame, reps: DataFrame, turn: int) -> DataFrame:
    """Pairs of each row (v, size, k, lead, component) with those just before it among the rows with its lead, where
    classes differ and narrow sketches allow a link. In turn 0 they stand by size, in later ones by hash, with more
    neighbours. Long lines are cut by hash."""
    many = leads.groupBy("k", "lead").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("n > 1 and lo <> hi")
    cut = F.pmod(F.xxhash64("v", F.lit(turn + 11)), F.ceil(F.col("n") / LINE))
    lined = leads.join(many.select("k", "lead", "n"), ["k", "lead"]).withColumn("slot", cut)
    sketch = [f"s{j}" for j in range(NARROW)]
    lined = lined.join(reps.select("v", *sketch), "v")
    by = F.col("size") if turn == 0 else F.xxhash64("v", F.lit(turn))
    along = Window.partitionBy("k", "lead", "slot").orderBy(by, "v").rowsBetween(-NEIGHBOURS[turn], -1)
    own = {"v": "", "size": "size_", "component": "component_"} | {c: f"{c}_" for c in sketch}
    others = F.collect_list(F.struct(*[F.col(c).alias(f"{x}b") for c, x in own.items()])).over(along)
    met = lined.select(*[F.col(c).alias(f"{x}a") for c, x in own.items()], others.alias("o"))
    return met.select(*[f"{x}a" for x in own.values()], F.inline("o"))


def starred(leads: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of each row (v, size, k, lead, component) with the one of its lead that has most links so far: copies of one text, each changed in its own way, are alike to the text and hardly to each other."""
    degree = links.select(F.col("a").alias("v")).union(links.select(F.col("b").alias("v"))).groupBy("v").agg(F.count("*").alias("degree"))
    seen = leads.join(degree, "v", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hubs = seen.groupBy("k", "lead").agg(F.max(F.struct("degree", "v", "size", "component")).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    hubs = hubs.where("lo <> hi and hub.degree > 0").select("k", "lead", F.col("hub.v").alias("b"), F.col("hub.size").alias("size_b"), F.col("hub.component").alias("component_b"))
    met = leads.join(hubs, ["k", "lead"])
    return met.select(F.col("v").alias("a"), F.col("size").alias("size_a"), F.col("component").alias("component_a"), "b", "size_b", "component_b")


def similar_classes(docs: DataFrame, spark: SparkSession, n: int, threshold: tuple[int, int], orders: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, size, m1, m2) of all documents, and a row for each different set: m1, m2, size, component, and
    ``keeper``, the class's first row (none, doc_id, th): smallest doc_id, rows without one last."""
    small_batches(spark)
    t = Fraction(*threshold)
    num, den = t.numerator, t.denominator
    level = levels(cell_counts(docs, n, spark))
    sets = stored(describe_sets(docs, n, t, level, orders), spark, "described")
    rows = stored(sets.select("doc_id", "th", "size", "m1", "m2"), spark, "rows")
    same = [c for c in sets.columns if c not in ("doc_id", "th", "size", "m1", "m2")]
    # Equal sets have equal columns, so whichever row comes first says the same.
    reps = sets.where("size > 0").groupBy("m1", "m2", "size").agg(
        F.min(F.struct("th", "doc_id")).alias("own"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("keeper"), *[F.first(c).alias(c) for c in same]
    )
    reps = stored(reps.select("m1", "m2", "size", F.col("own.th").alias("v"), F.col("own.doc_id").alias("rep_id"), "keeper", *same), spark, "reps")
    discard(spark, sets)
    repeats = not rows.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    verifier = Verifier(docs, reps, n, t, orders, repeats, spark)
    leads = reps.select("v", "size", F.posexplode(F.array(*[f"lead{k}" for k in range(LEADS)])).alias("k", "lead"))
    links, label = None, None
    for turn in range(len(NEIGHBOURS) + 1):
        own = leads.withColumn("component", F.col("v")) if label is None else leads.join(label, F.col("v") == F.col("id"), "left").drop("id").withColumn("component", F.coalesce("component", "v"))
        met = lined_up(own, reps, turn).where(verifier.sketches_fit()) if turn < len(NEIGHBOURS) else starred(own, links or found)
        found = verifier.links(met.where(f"component_a <> component_b and {verifier.sizes_fit()}").select("a", "b"))
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        label = connected_components(links, spark)

    index = F.expr(f"size - ((2L * {num} * size + {num + den - 1}) div {num + den}) + 1")
    links = found if links is None else links
    label = connected_components(links, spark) if label is None else label
    placed = reps.join(label, F.col("v") == F.col("id"), "left").withColumn("component", F.coalesce("component", "v"))
    entries = placed.select("v", "size", "component", index.alias("index"), F.posexplode("prefix0").alias("pos", "gram"))
    # N-grams of one class, or that no smaller set has in its own prefix, give no pair; most are such.
    mixed = entries.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.col("pos") < F.col("index")).alias("indexed"))
    mixed = stored(mixed.where("lo < hi and indexed").select("gram"), spark, "open")
    few = stored(entries.join(mixed, "gram", "left_semi"), spark, "entries")
    few = few.join(reps.select("v", *[f"s{j}" for j in range(NARROW)]), "v")
    side = lambda s: few.select("gram", F.col("v").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in few.columns if c not in ("gram", "v")])
    meet = (
        f"(size_a > size_b or (size_a = size_b and a > b)) and pos_b < index_b and component_a <> component_b and {verifier.sizes_fit()}"
        f" and least(pos_a, pos_b) + least(size_a - pos_a, size_b - pos_b) >= {verifier.least()} and {verifier.sketches_fit()}"
    )
    rest = side("a").alias("x").join(side("b").alias("y"), (F.col("x.gram") == F.col("y.gram")) & F.expr(meet)).select("a", "b")
    more = verifier.links(rest)
    label = label if more.isEmpty() else connected_components(links.union(more), spark)
    named = reps.select("m1", "m2", "size", "v", "keeper").join(label, F.col("v") == F.col("id"), "left").withColumn("component", F.coalesce("component", "v"))
    named = stored(named.select("m1", "m2", "size", "component", "keeper"), spark, "named")
    first = named.groupBy("component").agg(F.min("keeper").alias("keeper"))
    return rows, named.drop("keeper").join(first, "component")


def near_duplicate_classes(
    docs: DataFrame, spark: SparkSession, n: int = 5, threshold: tuple[int, int] = (4, 5), orders: int = 3
) -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id (smallest doc_id reachable by links) for each document."""
    rows, classes = similar_classes(docs, spark, n, threshold, orders)
    return rows.join(classes, ["m1", "m2", "size"], "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, spark: SparkSession, n: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """``docs`` with one row of each class of near duplicates, the one with the smallest doc_id (rows without one come
    last); all columns stay as they are. Texts without words always stay."""
    rows, classes = similar_classes(docs, spark, n, threshold, 3)
    placed = rows.join(classes, ["m1", "m2", "size"])
    first = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("th") == F.col("keeper.th"))
    count = placed.groupBy("doc_id", "th").agg(F.count("*").alias("n"), F.max(first).alias("first")).where("n > 1 or not first")
    own_id, th, stays = (free(docs.columns, c) for c in ("__id", "__th", "stays"))
    some = sized(stored(count.select(F.col("doc_id").alias(own_id), F.col("th").alias(th), F.col("first").alias(stays)), spark, "copies"))
    match = docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(docs["text"]) == F.col(th))
    kept = docs.join(some, match, "left_anti").select(docs.columns)
    again = some.where(F.col(stays))
    if again.isEmpty():
        return kept
    # Whole rows repeat: one of each stays.
    one = docs.join(again, match).dropDuplicates([own_id, th]).select([docs[c] for c in docs.columns])
    return kept.union(one)
