"""Exact nearest-neighbour joins in blocks.

Queries and bank rows are gathered into blocks of bounded size; each pair of blocks is one matrix product in numpy
that gives at most k rows a query, and a window over those keeps the k best. Neither side is collected or broadcast,
and single pairs of rows never become Spark rows. Ties go to the smaller bank id (distances are compared at nine
digits).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096


def half_sq(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half squared Euclidean distance; one minus the cosine for unit rows."""
    return np.maximum(0, 0.5 * ((q * q).sum(1)[:, None] + (b * b).sum(1)[None]) - q @ b.T)


def l1(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.abs(b - row).sum(1) for row in q])


def chebyshev(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.abs(b - row).max(1) for row in q])


METRICS: dict[str, Callable] = {"half_sq": half_sq, "l1": l1, "chebyshev": chebyshev}


def _blocks(df: DataFrame, name: str, n: int, carried: list[str], same: str | None) -> DataFrame:
    """Rows in ``n`` blocks, or each value of ``same`` in as many as its own rows fill."""
    cols = [F.col(c).cast("long").alias(c) for c in ["id", *carried]]
    own = df.select(*cols, F.col("vec").cast("array<double>").alias("vec"))
    if same:
        many = own.groupBy(F.col(same).alias("same")).agg(F.ceil(F.count("*") / BLOCK).alias("of_value"))
        own = own.withColumn("same", F.col(same)).join(many, "same")
    part = F.pmod(F.xxhash64("id"), F.col("of_value") if same else F.lit(max(1, n)))
    by = ["same"] if same else []
    return own.groupBy(part.alias(name), *by).agg(F.collect_list(F.struct("id", *carried, "vec")).alias(f"{name}_rows")).drop(name)


def knn_join(
    queries: DataFrame, bank: DataFrame, k: int = 1, metric: str = "half_sq", same: str | None = None, other: str | None = None, weight: float = 0.0
) -> DataFrame:
    """(query, bank, dist, place) of the k nearest bank rows of each query.

    ``queries(id, vec)`` and ``bank(id, vec)``; ``same`` names a column of both that must agree, ``other`` one that must
    differ (leave-one-out); ``weight`` adds that multiple of the bank's column ``w`` to the distance.
    """
    carried = [c for c in (same, other) if c]
    nq, nb = (0, 0) if same else (-(-df.count() // BLOCK) for df in (queries, bank))
    q = _blocks(queries, "q", nq, carried, same)
    b = _blocks(bank, "b", nb, carried + (["w"] if weight else []), same)
    measure = METRICS[metric]

    def search(frames):
        for pdf in frames:
            for qs, bs in zip(pdf["q_rows"], pdf["b_rows"], strict=True):
                qv, bv = np.stack([r["vec"] for r in qs]), np.stack([r["vec"] for r in bs])
                qi, bi = np.array([r["id"] for r in qs]), np.array([r["id"] for r in bs])
                if weight:
                    extra = weight * np.array([r["w"] for r in bs], dtype=float)
                for i in range(0, len(qv), 512):
                    d = measure(qv[i : i + 512], bv)
                    if weight:
                        d = d + extra
                    for col, keep in ((same, True), (other, False)):
                        if col:
                            qc, bc = np.array([r[col] for r in qs[i : i + 512]]), np.array([r[col] for r in bs])
                            d = np.where((qc[:, None] == bc[None]) == keep, d, np.inf)
                    rounded = np.round(d, 9)
                    m = min(k, rounded.shape[1])
                    if m == 1:
                        low = rounded.min(1, keepdims=True)
                        at = np.where(rounded == low, bi[None], np.iinfo(np.int64).max).argmin(1)[:, None]
                    else:
                        at = np.stack([np.lexsort((bi, row))[:m] for row in rounded])
                    dist = np.take_along_axis(d, at, 1).ravel()
                    ok = np.isfinite(dist)
                    yield pd.DataFrame({"query": np.repeat(qi[i : i + 512], m)[ok], "bank": bi[at].ravel()[ok], "dist": dist[ok]})

    # Only blocks of one value meet where one is asked for; else each query block must see the whole bank.
    met = q.join(b, "same").drop("same") if same else q.crossJoin(b)
    found = met.mapInPandas(search, "query long, bank long, dist double")
    order = Window.partitionBy("query").orderBy(F.round("dist", 9), "bank")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest_with_ties(queries: DataFrame, bank: DataFrame, tol: float = 1e-6) -> DataFrame:
    """query, bank, dist, ties: the nearest bank row by Euclidean distance (of several the smaller id) and how many rows
    are no farther than ``tol`` beyond it. Each pair of blocks gives a query one row: its nearest, and the distances up to
    ``tol`` beyond that with their counts, among which are all that count in the end; equal distances are one entry."""
    q, b = (_blocks(df, name, -(-df.count() // BLOCK), [], None) for df, name in ((queries, "q"), (bank, "b")))

    def search(frames):
        for pdf in frames:
            for qs, bs in zip(pdf["q_rows"], pdf["b_rows"], strict=True):
                bv, bi = np.stack([r["vec"] for r in bs]), np.array([r["id"] for r in bs])
                order = np.argsort(bi, kind="stable")
                bv, bi = bv[order], bi[order]
                for i in range(0, len(qs), 512):
                    d = np.sqrt(2 * half_sq(np.stack([r["vec"] for r in qs[i : i + 512]]), bv))
                    at = np.round(d, 9).argmin(1)
                    dist = d[np.arange(len(d)), at]
                    near = [np.unique(row[row <= x + tol], return_counts=True) for row, x in zip(d, d.min(1), strict=True)]
                    yield pd.DataFrame({"query": [r["id"] for r in qs[i : i + 512]], "bank": bi[at], "dist": dist, "d": [x.tolist() for x, _ in near], "n": [n.tolist() for _, n in near]})

    found = q.crossJoin(b).mapInPandas(search, "query long, bank long, dist double, d array<double>, n array<long>")
    own = found.withColumn("least", F.min("dist").over(Window.partitionBy("query")))
    count = F.aggregate(F.filter(F.arrays_zip("d", "n"), lambda x: x["d"] <= F.col("least") + tol), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    first = F.min(F.struct(F.round("dist", 9).alias("r"), "bank", "dist")).alias("first")
    return own.groupBy("query").agg(first, F.sum(count).alias("ties")).select("query", "first.bank", "first.dist", "ties")


def banded(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """id, dw, dg: half the squared distance to the nearest bank row whose (row, col) is at most one off the query's in
    each (null if there is none), and to the nearest of all, in one search: a pair of blocks is one product, whose minima
    by the bank's cells serve both, and gives a query one row."""
    q = _blocks(queries, "q", -(-queries.count() // BLOCK), ["row", "col"], None)
    b = _blocks(bank, "b", -(-bank.count() // BLOCK), ["row", "col"], None)

    def search(frames):
        for pdf in frames:
            for qs, bs in zip(pdf["q_rows"], pdf["b_rows"], strict=True):
                place = np.array([(r["row"], r["col"]) for r in bs])
                order = np.lexsort(place.T)
                cells, first = np.unique(place[order][:, ::-1], axis=0, return_index=True)  # by column, then row
                bv = np.stack([bs[i]["vec"] for i in order])
                for i in range(0, len(qs), 512):
                    part = qs[i : i + 512]
                    d = np.minimum.reduceat(half_sq(np.stack([r["vec"] for r in part]), bv), first, axis=1)
                    at = np.array([(r["col"], r["row"]) for r in part])
                    near = (np.abs(at[:, None] - cells[None]) <= 1).all(2)
                    yield pd.DataFrame({"id": [r["id"] for r in part], "dw": np.where(near, d, np.inf).min(1), "dg": d.min(1)})

    found = q.crossJoin(b).mapInPandas(search, "id long, dw double, dg double")
    least = found.groupBy("id").agg(F.min("dw").alias("dw"), F.min("dg").alias("dg"))
    return least.withColumn("dw", F.when(F.col("dw") < float("inf"), F.col("dw")))


def nearest_per(queries: DataFrame, bank: DataFrame, by: str) -> DataFrame:
    """query, ``by``, dist: half the squared distance to the nearest bank row of each value of the bank's integer column
    ``by`` (rows where it is null take no part), all values in one search. A pair of blocks gives a query one row a value."""
    bank = bank.where(F.col(by).isNotNull())
    kind = bank.schema[by].dataType.simpleString()
    q = _blocks(queries, "q", -(-queries.count() // BLOCK), [], None)
    b = _blocks(bank.withColumn("__of", F.col(by).cast("long")), "b", -(-bank.count() // BLOCK), ["__of"], None)

    def search(frames):
        for pdf in frames:
            for qs, bs in zip(pdf["q_rows"], pdf["b_rows"], strict=True):
                bs = sorted(bs, key=lambda r: r["__of"])
                bv = np.stack([r["vec"] for r in bs])
                values, first = np.unique([r["__of"] for r in bs], return_index=True)
                for i in range(0, len(qs), 512):
                    part = qs[i : i + 512]
                    d = np.minimum.reduceat(half_sq(np.stack([r["vec"] for r in part]), bv), first, axis=1)
                    yield pd.DataFrame({"query": np.repeat([r["id"] for r in part], len(values)), by: np.tile(values, len(part)), "dist": d.ravel()})

    found = q.crossJoin(b).mapInPandas(search, f"query long, {by} long, dist double")
    return found.groupBy("query", F.col(by).cast(kind).alias(by)).agg(F.min("dist").alias("dist"))


#: Rows of a packed block of queries, of one side of a unit of pairs, and queries of a product.
QUERIES, SIDE, STRIP = 12288, 1536, 256
#: Groups of at most so many pairs give their midpoints as rows; so do pairs whose sum is that much shorter (squared) than its parts.
FEW, SHORT = 64, 1e-3
#: Pairs of a query that are looked at one by one in a unit, and rows of pairs that are tried first where there are more.
CROSS, PROBES = 16384, 4


def _matrix(ids: pa.Array, vecs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one length each, as numpy arrays."""
    lengths = np.unique(pc.list_value_length(vecs).to_numpy(zero_copy_only=False))
    if vecs.null_count or len(lengths) > 1:
        raise ValueError("vectors must be of one length and not null")
    return ids.to_numpy(zero_copy_only=False), vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _packed_rows(df: DataFrame, size: int) -> DataFrame:
    """n, ids, vecs: at most ``size`` rows of a partition as bytes."""

    def pack(batches):
        for batch in batches:
            ids, vecs = _matrix(batch["id"], batch["vec"]) if len(batch) else ([], [])
            for i in range(0, len(ids), size):
                part = ids[i : i + size]
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(part)], pa.int32()), "ids": [part.tobytes()], "vecs": [vecs[i : i + size].tobytes()]})

    own = df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    return own.mapInArrow(pack, "n int, ids binary, vecs binary")


def _packed_units(bank: DataFrame, first: str, second: str) -> DataFrame:
    """Units of pairs as bytes: rows of one value of ``first`` beside rows whose ``second`` has that value, at most SIDE a
    side, or no rows; small units lie together in a row. Every bank row is on the first side of a unit."""

    def sides(key, name):
        own = bank.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.col(key).alias("key"))
        many = own.groupBy(F.col("key").alias("value")).agg(F.ceil(F.count("*") / SIDE).alias("of_value"))
        dealt = own.join(many, F.col("key").eqNullSafe(F.col("value")))
        return dealt.groupBy("key", F.pmod(F.xxhash64("id"), F.col("of_value")).alias("part")).agg(F.collect_list(F.struct("id", "vec")).alias(name)).drop("part")

    def pack(batches):
        held, rows = [], 0

        def row():
            a, b = ([x[i : i + 2] for x in held] for i in (0, 2))
            one = {f"{name}{k}": [b"".join(x[i].tobytes() for x in side)] for k, side in (("a", a), ("b", b)) for i, name in enumerate(("ids_", "vecs_"))}
            return pa.RecordBatch.from_pydict({"na": pa.array([[len(x[0]) for x in a]], pa.list_(pa.int32())), "nb": pa.array([[len(x[0]) for x in b]], pa.list_(pa.int32())), **one})

        for batch in batches:
            for k in range(len(batch)):
                unit = []
                for side in (batch["a"][k].values, batch["b"][k].values):
                    unit += _matrix(side.field("id"), side.field("vec")) if side is not None else (np.zeros(0, np.int64), np.zeros((0, 0)))
                held.append(unit)
                rows += len(unit[0]) + len(unit[2])
                if rows >= SIDE:
                    yield row()
                    held, rows = [], 0
        if held:
            yield row()

    units = sides(first, "a").join(sides(second, "b").where("key IS NOT NULL"), "key", "left").select("a", "b")
    return units.mapInArrow(pack, "na array<int>, nb array<int>, ids_a binary, vecs_a binary, ids_b binary, vecs_b binary")


class _Unit:
    """Pairs (a, b) of two sides, id of a before that of b: what one over the length of a + b is, 0 for no pair."""

    def __init__(self, ids_a, a, ids_b, b):
        sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None]
        n2 = sq + 2 * (a @ b.T)
        ok = ids_a[:, None] < ids_b[None]
        near = ok & (n2 < SHORT * sq)  # their length must come from the sum itself
        if ok.sum() <= FEW:
            near = ok
        ok = ok & ~near
        self.as_rows = (a, b, *np.nonzero(near)) if near.any() else None
        self.w = np.where(ok, 1 / np.sqrt(np.where(ok, n2, 1)), 0)
        self.a, self.b, self.most = a, b, self.w.max(1, initial=0)
        self.least_a, self.least_b = (1 / np.maximum(most, 1e-300) for most in (self.most, self.w.max(0, initial=0)))

    def rows(self):
        """Midpoints of the pairs that are taken as rows, in parts."""
        a, b, i, j = self.as_rows
        for k in range(0, len(i), SIDE):
            m = (a[i[k : k + SIDE]] + b[j[k : k + SIDE]]) / 2
            n = np.sqrt((m * m).sum(1))
            yield m[n > 0] / n[n > 0, None]

    def better(self, x: np.ndarray, sa: np.ndarray, sb: np.ndarray, best: np.ndarray, slack: np.ndarray, ranks: int | None = PROBES) -> None:
        """Raise ``best`` to the largest product of a query with a midpoint, (sa + sb) / length, where it is larger; the
        products ``sa`` and ``sb`` with the rows may be off by ``slack``, so what can be larger is computed anew.

        A pair can only be if sa + the largest sb is above ``best`` times the least length of a sum with its a, and the
        same for its b; where few rows of either side can, all their pairs are looked at, else see ``_by_rows``."""
        kind, off = sa.dtype, 2 * slack
        with np.errstate(all="ignore"):
            (qa, a), (qb, b) = (
                np.divmod(np.flatnonzero(side > best.astype(kind)[:, None] * least.astype(kind) - (other.max(1) + off).astype(kind)[:, None]), side.shape[1])
                for side, least, other in ((sa, self.least_a, sb), (sb, self.least_b, sa))
            )
        na, nb = (np.bincount(q, minlength=len(best)) for q in (qa, qb))
        many = (na * nb > CROSS) | (best < 0)
        own = ~many[qa] & (nb[qa] > 0)
        qa, a = qa[own], a[own]
        if len(qa):
            # Of a query's b, sorted by product, those go with an a that are above what is still needed; in units of slack.
            need = (best[qa] * self.least_a[a] - off[qa] - sa[qa, a]) / slack[qa]
            have = sb[qb, b] / slack[qb]
            span = 1 + 2 * max(np.abs(need).max(), np.abs(have).max(initial=0))
            key = qb * span - have
            order = np.argsort(key)
            start = (np.cumsum(nb) - nb)[qa]
            n = np.searchsorted(key[order], qa * span - need, "right") - start
            one = np.repeat(np.arange(len(qa)), n)
            two = order[np.arange(len(one)) + np.repeat(start - (np.cumsum(n) - n), n)]
            q, i, j = qa[one], a[one], b[two]
            both = sa[q, i].astype(float) + sb[q, j]
            w = self.w[i, j]
            most = best.copy()
            np.maximum.at(most, q, (both - off[q]) * w)
            go = np.flatnonzero((both + off[q]) * w > most[q])
            for k in range(0, len(go), 4 * SIDE):
                at = go[k : k + 4 * SIDE]
                np.maximum.at(best, q[at], ((self.a[i[at]] + self.b[j[at]]) * x[q[at]]).sum(1) * w[at])
        if many.any():
            x, left = x[many], best[many]
            exact = x @ self.a.T, x @ self.b.T
            self._by_rows(*exact, left, ranks)
            if ranks:
                self.better(x, *exact, left, slack[many], None)
            best[many] = left

    def _by_rows(self, sa: np.ndarray, sb: np.ndarray, best: np.ndarray, ranks: int | None) -> None:
        """The same by whole rows of pairs, of the ``ranks`` most promising a of a query, or until none can do better: no
        pair of a exceeds (sa + the largest sb) times its largest w (0, if that is negative)."""
        top = sb.max(1)
        may = sa + top[:, None] > best[:, None] * self.least_a
        may[best < 0] = self.most > 0
        q, a = np.divmod(np.flatnonzero(may), sa.shape[1])
        bound = np.maximum((sa[q, a] + top[q]) * self.most[a], 0)
        order = np.lexsort((-bound, q))
        q, a, bound = q[order], a[order], bound[order]
        own, at, n = np.unique(q, return_index=True, return_counts=True)
        end = at + (np.minimum(n, ranks) if ranks else n)
        while len(own):
            go = bound[at] > best[own]
            own, at, end = own[go], at[go], end[go]
            w = self.w[a[at]]
            got = sb[own]
            got += sa[own, a[at]][:, None]
            got *= w
            most = got.max(1, initial=-np.inf)
            low = most <= 0  # may be of no pair
            if low.any():
                most[low] = np.where(w[low] > 0, got[low], -np.inf).max(1)
            best[own] = np.maximum(best[own], most)
            at = at + 1
            go = at < end
            own, at, end = own[go], at[go], end[go]


def _least(queries: DataFrame, units: DataFrame, bank_rows: int) -> DataFrame:
    """query, dist over packed blocks of both sides. A task holds one block of queries at a time and what it has found for
    them so far, and passes a slice of the units by it."""
    n = queries.count()
    parts = -(-n // (QUERIES * 3 // 4)) or 1
    slices = max(-(-bank_rows // (40 * SIDE)), -(-3 * queries.sparkSession.sparkContext.defaultParallelism // parts))
    blocks = _packed_rows(queries.repartition(parts), QUERIES)

    def search(batches):
        ids, x, best = None, None, None

        def found():
            return pa.RecordBatch.from_pydict({"query": ids, "dist": np.maximum(0, 0.5 * (x * x).sum(1) - best)})

        for batch in batches:
            for k in range(len(batch)):
                get = lambda name, kind: np.frombuffer(batch[name][k].as_buffer(), kind)  # noqa: E731, B023
                if ids is None or not np.array_equal(ids, get("ids", np.int64)):
                    if ids is not None:
                        yield found()
                    ids = get("ids", np.int64).copy()
                    x = get("vecs", float).reshape(len(ids), -1).copy()
                    best, x_long = np.full(len(ids), -np.inf), np.sqrt((x * x).sum(1))
                na, nb = (np.concatenate([[0], np.cumsum(batch[c][k].values.to_numpy())]) for c in ("na", "nb"))
                ia, ib = get("ids_a", np.int64), get("ids_b", np.int64)
                a, b = (get(c, float).reshape(-1, x.shape[1]) for c in ("vecs_a", "vecs_b"))
                pairs = [(slice(*na[u : u + 2]), slice(*nb[u : u + 2])) for u in range(len(na) - 1) if nb[u + 1] > nb[u]]
                pairs = [(i, j, _Unit(ia[i], a[i], ib[j], b[j])) for i, j in pairs]
                half = 0.5 * (a * a).sum(1)
                # Products are screened in single precision where its range allows, by what they can be off at most.
                long = np.sqrt(max(2 * half.max(initial=0), (b * b).sum(1).max(initial=0)))
                kind = np.float32 if 1e-12 < long < 1e12 and (x_long < 1e12).all() and (x_long[x_long > 0] > 1e-12).all() else float
                slack = (x.shape[1] + 16) * 1.2e-7 * (x_long + long) * long
                xk, ak, bk, hk = (z.astype(kind) for z in (x, a, b, half))
                for i in range(0, len(x), STRIP):
                    part, most, off = xk[i : i + STRIP], best[i : i + STRIP], slack[i : i + STRIP]
                    sa = part @ ak.T
                    go = np.flatnonzero((sa - hk).max(1) > most - off)
                    most[go] = np.maximum(most[go], (x[i + go] @ a.T - half).max(1))
                    most += 0.5  # a midpoint has length one
                    for of_a, of_b, unit in pairs:
                        if unit.most.any():
                            unit.better(x[i : i + STRIP], sa[:, of_a], part @ bk[of_b].T, most, off)
                    most -= 0.5
                for m in (m for _, _, unit in pairs if unit.as_rows for m in unit.rows() if len(m)):
                    for i in range(0, len(x), STRIP):
                        best[i : i + STRIP] = np.maximum(best[i : i + STRIP], (x[i : i + STRIP] @ m.T).max(1) - 0.5)
        if ids is not None:
            yield found()

    met = blocks.hint("shuffle_replicate_nl").crossJoin(units.repartition(slices))
    return met.mapInArrow(search, "query long, dist double").groupBy("query").agg(F.min("dist").alias("dist"))


def nearest(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """query, dist: half the squared distance to the nearest bank row, whichever that is."""
    rows = _packed_rows(bank, SIDE).select(F.array("n").alias("na"), F.array(F.lit(0)).alias("nb"), F.col("ids").alias("ids_a"), F.col("vecs").alias("vecs_a"), F.lit(b"").alias("ids_b"), F.lit(b"").alias("vecs_b"))
    return _least(queries, rows, bank.count())


def nearest_midpoint(queries: DataFrame, bank: DataFrame, first: str, second: str) -> DataFrame:
    """query, dist: half the squared distance to the nearest of the bank's rows and of the midpoints, at length one, of any
    two of them where ``first`` of the one with the smaller id equals ``second`` of the other (null: equals none).

    Midpoints are not made: a query's product with one is the sum of its products with the two rows over the length of
    their sum, so a block of queries is multiplied with the rows only, and pairs whose bound is below what was found are
    left out.
    """
    return _least(queries, _packed_units(bank, first, second), bank.count())


def position_locked(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """Nearest bank row among those at the query's own (row, col): an equi-join."""
    from orrery.functions.vectors import sq_l2

    pairs = queries.join(bank.select("row", "col", F.col("id").alias("bank"), F.col("vec").alias("bvec")), ["row", "col"])
    return pairs.groupBy("id").agg(F.min(0.5 * sq_l2(F.col("vec"), F.col("bvec"))).alias("dist"))


def mutual(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest; both sides come from ``knn_join`` with k = 1."""
    back = backward.select(F.col("query").alias("bank"), F.col("bank").alias("query"))
    return forward.join(back, ["query", "bank"])
