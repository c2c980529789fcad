"""Entropic transport in the log domain, for many problems at a time, none of them held by one task.

``cost`` has a row for each pair: keys of the problem, row and column (positions from 0) and the cost. Rows are gathered
into blocks. Potentials of the columns are a table, one row a problem. In each step a block normalises its own rows and
gives its share of every column's mass as (largest exponent, sum below it), which merge to the mass of the whole
problem whatever the blocks; then the potentials move, and the table is written. It ends when none has moved by more
than the tolerance.

The columns' masses are met exactly (balanced), or as far as ``tau`` presses for it: the pull of a column is then
``tau / (eps + tau)`` of what would be needed, and each step goes half of the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.sources.shared import dropped, written

#: Rows of a block; bytes of all potentials that are sent to every executor, beyond which they are joined.
ROWS, BROADCAST_BYTES = 256, 64 << 20


def _block(t: pa.Table) -> pa.Table:
    t = t.sort_by([("row", "ascending"), ("col", "ascending")])
    rows, cols = np.unique(t["row"].to_numpy()), np.unique(t["col"].to_numpy())
    if len(rows) * len(cols) != t.num_rows:
        raise ValueError("transport needs the cost of every row and column of a problem, once")
    one = [t["cell"][0].as_py(), rows.tolist(), len(cols), t["c"].to_numpy().astype(float).tobytes()]
    return pa.table({n: pa.array([v], k) for n, v, k in zip(("cell", "rows", "m", "c"), one, (pa.string(), pa.list_(pa.int64()), pa.int64(), pa.binary()), strict=True)})


def _exponents(row: dict, eps: float, clip: float | None) -> tuple[np.ndarray, np.ndarray]:
    """A block's costs, and the logarithms of its rows' shares under the potentials (each row's sum to one)."""
    c = np.frombuffer(row["c"]).reshape(-1, row["m"])
    x = -(np.clip(c, 0, clip) if clip is not None else c) / eps + np.frombuffer(row["lb"])
    top = x.max(axis=1, keepdims=True)
    return c, x - top - np.log(np.exp(x - top).sum(axis=1, keepdims=True))


def _shares(eps: float, clip: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                x = _exponents(row, eps, clip)[1]
                top = x.max(axis=0)
                out.append((row["cell"], len(x), top.tobytes(), np.exp(x - top).sum(axis=0).tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["cell", "n", "top", "sum"])

    return run


def _moved(alpha: float, damp: float):
    def run(parts: pa.Table, state: pa.Table) -> pa.Table:
        s = state.to_pylist()[0]
        lb, rho = np.frombuffer(s["lb"]), np.frombuffer(s["rho"])
        top, total = (np.stack([np.frombuffer(b) for b in parts[c].to_pylist()]) for c in ("top", "sum"))
        most = top.max(axis=0)
        # Rows weigh alike: the mass of a row is one over their number.
        mass = most + np.log((np.exp(top - most) * total).sum(axis=0)) - np.log(sum(parts["n"].to_pylist()))
        new = lb + damp * (-alpha * (mass - lb - np.log(np.maximum(rho, 1e-300))) - lb)
        return pa.table({"cell": [s["cell"]], "lb": pa.array([new.tobytes()], pa.binary()), "rho": pa.array([s["rho"]], pa.binary()), "moved": [float(np.abs(new - lb).max())]})

    return run


def _told(eps: float, clip: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c, x = _exponents(row, eps, clip)
                n, m = c.shape
                cols = [pa.array([row["cell"]] * (n * m), pa.string()), pa.array(np.repeat(row["rows"], m)), pa.array(np.tile(np.arange(m), n)), pa.array(c.ravel()), pa.array(np.exp(x).ravel())]
                yield pa.RecordBatch.from_arrays(cols, ["cell", "row", "col", "c", "share"])

    return run


def _key(keys: list[str]) -> Column:
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("cell")


def plan(
    cost: DataFrame, keys: list[str], row: str, col: str, c: str, eps: float = 0.05, iterations: int = 500, tol: float = 1e-6, tau: float | None = None, clip: float | None = 50.0,
    mass: DataFrame | None = None,
) -> DataFrame:
    """keys, row, col, c, share: how a row's mass is shared among the columns (a row's shares sum to one; its mass is one
    over the number of rows). ``mass`` (keys, col, rho) weighs the columns, else they weigh alike. ``tau`` None is
    balanced, 0 leaves columns free (each row its own soft minimum), in between presses for the masses softly."""
    spark = cost.sparkSession
    long = cost.select(_key(keys), F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), F.col(c).cast("double").alias("c"))
    kept = long.withColumn("block", F.expr(f"row div {ROWS}")).groupBy("cell", "block").applyInArrow(_block, "cell string, rows array<long>, m long, c binary")
    kept, blocks_path = written(kept, "blocks")
    sizes = kept.groupBy("cell").agg(F.max("m").alias("m"))
    if mass is not None:
        own = mass.select(_key(keys), F.struct(F.col(col).cast("long").alias("col"), F.col("rho").cast("double").alias("rho")).alias("x"))
        sizes = sizes.join(own.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["rho"]).alias("rho")), "cell")

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            rho = [np.array(r.get("rho") or [1.0] * r["m"], dtype=float) for r in rows]
            cols = [[r["cell"] for r in rows], [np.zeros(r["m"]).tobytes() for r in rows], [(x / x.sum()).tobytes() for x in rho], [0.0] * len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.string(), pa.binary(), pa.binary(), pa.float64()), strict=True)], ["cell", "lb", "rho", "moved"])

    schema = "cell string, lb binary, rho binary, moved double"
    state, path = written(sizes.mapInArrow(begun, schema), "potentials")
    size = state.agg(F.sum(F.length("lb"))).first()[0] or 0
    near = (lambda df: F.broadcast(df)) if size <= BROADCAST_BYTES else (lambda df: df)
    alpha, damp = (1.0, 1.0) if tau is None else (tau / (eps + tau), 0.5)
    for _ in range(iterations if size and alpha else 0):
        shares = kept.join(near(state.select("cell", "lb")), "cell").mapInArrow(_shares(eps, clip), "cell string, n long, top binary, sum binary")
        new, new_path = written(shares.groupBy("cell").cogroup(state.groupBy("cell")).applyInArrow(_moved(alpha, damp), schema), "potentials")
        dropped(spark, path)
        state, path = new, new_path
        if state.agg(F.max("moved")).first()[0] <= tol:
            break
    got = kept.join(near(state.select("cell", "lb")), "cell").mapInArrow(_told(eps, clip), "cell string, row long, col long, c double, share double")
    names = F.from_json("cell", cost.select(*keys).schema)
    return got.select(*[names[k].alias(k) for k in keys], "row", "col", "c", "share")


def row_costs(got: DataFrame, keys: list[str], name: str = "cost") -> DataFrame:
    """Expected cost of each row under its shares."""
    return got.groupBy(*keys, "row").agg(F.sum(F.col("share") * F.col("c")).alias(name))


def coupled(
    a: DataFrame, b: DataFrame, keys: list[str], row: str, col: str, c: str, eps: float = 0.05, gamma: float = 0.1, rounds: int = 4, **how
) -> tuple[DataFrame, DataFrame]:
    """Plans of two branches that are drawn together: each round adds to a branch's cost ``gamma`` times the gradient of
    the Jensen-Shannon divergence of its rows to the other's, and solves both again. Shares come back with the branches'
    own costs."""
    own = [x.select(*keys, F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), F.col(c).cast("double").alias("c")) for x in (a, b)]
    at = [*keys, "row", "col"]
    plans = [plan(x, keys, "row", "col", "c", eps, **how) for x in own]
    for _ in range(rounds):
        # The plan's mass is its share times the mass of a row.
        n = [p.groupBy(*keys).agg(F.countDistinct("row").alias("n")) for p in plans[:1]][0]
        both = plans[0].select(*at, F.col("share").alias("sa")).join(plans[1].select(*at, F.col("share").alias("sb")), at).join(n, keys)
        sa, sb = (F.greatest(F.col(s) / F.col("n"), F.lit(1e-12)) for s in ("sa", "sb"))
        m = F.greatest((sa + sb) / 2, F.lit(1e-12))
        off = both.select(*at, (0.5 * (F.log(sa) - F.log(m))).alias("oa"), (0.5 * (F.log(sb) - F.log(m))).alias("ob"))
        moved = [x.join(off.select(*at, F.col(o).alias("o")), at).withColumn("c", F.col("c") + gamma * F.col("o")) for x, o in zip(own, ("oa", "ob"), strict=True)]
        plans = [plan(x, keys, "row", "col", "c", eps, **how) for x in moved]
    return tuple(p.select(*at, "share").join(x, at) for p, x in zip(plans, own, strict=True))


def capacity_premium(cost: DataFrame, keys: list[str], row: str, col: str, c: str, eps: float, tau: float, mass: DataFrame | None = None, **how) -> DataFrame:
    """keys, row, cost, free_cost, premium: what each row pays more because columns' capacities press on it."""
    pressed = row_costs(plan(cost, keys, row, col, c, eps, tau=tau, clip=None, mass=mass, **how), keys)
    free = row_costs(plan(cost, keys, row, col, c, eps, tau=0.0, clip=None, **how), keys, "free_cost")
    return pressed.join(free, [*keys, "row"]).withColumn("premium", F.col("cost") - F.col("free_cost"))
