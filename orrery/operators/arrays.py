"""Array operators that have no relational form: per-map or per-group numpy under applyInPandas and mapInPandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def haar(a: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """One level of the two-dimensional Haar transform: approximation and three detail planes."""
    p, q, r, s = a[::2, ::2], a[::2, 1::2], a[1::2, ::2], a[1::2, 1::2]
    return (p + q + r + s) / 2, [(p - q + r - s) / 2, (p + q - r - s) / 2, (p - q - r + s) / 2]


def haar_details(a: np.ndarray, levels: int) -> list[np.ndarray]:
    """Detail planes of each level, spread back to the map's size."""
    out, low = [], a
    for k in range(levels):
        low, planes = haar(low)
        out += [np.kron(x, np.ones((2 ** (k + 1), 2 ** (k + 1)))) for x in planes]
    return out


def haar_residual(maps: DataFrame, width: int, levels: int = 2, trim: int = 1) -> DataFrame:
    """``maps(id, ref, values)`` to (id, p, v): detail planes standardised by the references' median and MAD of each
    plane, absolute, averaged over planes without the ``trim`` smallest and largest."""
    planes = 3 * levels

    def detail(frames):
        for pdf in frames:
            for i, ref, v in zip(pdf["id"], pdf["ref"], pdf["values"], strict=True):
                d = haar_details(np.asarray(v, dtype=float).reshape(-1, width), levels)
                yield pd.DataFrame({"id": i, "ref": ref, "plane": np.repeat(np.arange(planes), d[0].size), "p": np.tile(np.arange(d[0].size), planes), "v": np.concatenate([x.ravel() for x in d])})

    cells = maps.select("id", "ref", "values").mapInPandas(detail, "id long, ref int, plane int, p int, v double")
    med = cells.where("ref = 1").groupBy("plane").agg(F.median("v").alias("m"))
    mad = cells.where("ref = 1").join(F.broadcast(med), "plane").groupBy("plane").agg(F.max("m").alias("m"), F.greatest(F.median(F.abs(F.col("v") - F.col("m"))), F.lit(1e-9)).alias("s"))
    z = cells.join(F.broadcast(mad), "plane").withColumn("z", F.abs((F.col("v") - F.col("m")) / F.col("s")))
    kept = z.groupBy("id", "p").agg(F.sort_array(F.collect_list("z")).alias("a"))
    middle = F.slice("a", trim + 1, planes - 2 * trim)
    return kept.select("id", "p", (F.aggregate(middle, F.lit(0.0), lambda a, x: a + x) / (planes - 2 * trim)).alias("v"))


def ransac_affine(src: np.ndarray, dst: np.ndarray, tries: int = 200, reach: float = 1.0, seed: int = 0) -> tuple[np.ndarray | None, float]:
    """2x3 affine map with the most inliers over random triples, refitted on them; None under three points."""
    if len(src) < 3:
        return None, 0.0
    r, ones = np.random.default_rng(seed), np.ones((len(src), 1))
    x, best = np.concatenate([src, ones], axis=1), np.zeros(len(src), dtype=bool)
    for _ in range(tries):
        pick = r.choice(len(src), 3, replace=False)
        if abs(np.linalg.det(x[pick])) < 1e-9:
            continue
        inside = np.linalg.norm(x @ np.linalg.solve(x[pick], dst[pick]) - dst, axis=1) <= reach
        if inside.sum() > best.sum():
            best = inside
    if best.sum() < 3:
        return None, 0.0
    return np.linalg.lstsq(x[best], dst[best], rcond=None)[0].T, float(best.mean())


def affine_by_group(matches: DataFrame, group: str, reach: float = 1.0) -> DataFrame:
    """``matches(group, x, y, u, v)`` to one affine map a group with its share of inliers; null where none is found."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "u", "v"])
        m, share = ransac_affine(pdf[["x", "y"]].to_numpy(float), pdf[["u", "v"]].to_numpy(float), reach=reach)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "map": [None if m is None else m.ravel().tolist()], "inliers": [share]})

    return matches.groupBy(group).applyInPandas(fit, f"{group} long, map array<double>, inliers double")


def semi_relaxed_ot(cost: np.ndarray, a: np.ndarray, rho: np.ndarray, eps: float, tau: float, rounds: int = 2000, tol: float = 1e-10) -> np.ndarray:
    """Transport plan with row sums ``a`` and a KL penalty ``tau`` on column sums against ``rho``, in the log domain."""
    f, g = np.zeros(len(a)), np.zeros(len(rho))
    lse = lambda m, axis: np.log(np.exp(m - m.max(axis, keepdims=True)).sum(axis)) + m.max(axis)
    for _ in range(rounds):
        f = eps * (np.log(a) - lse((g[None] - cost) / eps, 1))
        new = tau / (tau + eps) * eps * (np.log(rho) - lse((f[:, None] - cost) / eps, 0))
        done, g = np.abs(new - g).max() < tol, new
        if done:
            break
    f = eps * (np.log(a) - lse((g[None] - cost) / eps, 1))
    return np.exp((f[:, None] + g[None] - cost) / eps)


def semi_relaxed_line_cost(x: np.ndarray, y: np.ndarray, eps: float, tau: float, rounds: int = 2000, tol: float = 1e-10, cells: int = 1 << 20) -> float:
    """Cost of ``semi_relaxed_ot`` between points of a line at their distances, alike in weight, without the matrix. As the
    distance to points on one side grows by the step alone, sums over all points are running sums from either end: a round
    takes time and memory in proportion to the points. The plan itself is added up at the end, ``cells`` at a time."""
    x, y = np.sort(x), np.sort(y)
    x, y = (x - y[0]) / eps, (y - y[0]) / eps
    none = np.array([-np.inf])
    a, rho = -np.log(len(x)), -np.log(len(y))

    def reach(at: np.ndarray, places: np.ndarray, cut: np.ndarray, h: np.ndarray) -> np.ndarray:
        """log sum over places of exp(h - distance), at each point; the first ``cut`` places lie before it."""
        before = np.concatenate([none, np.logaddexp.accumulate(h + places)])
        behind = np.concatenate([np.logaddexp.accumulate((h - places)[::-1])[::-1], none])
        return np.logaddexp(before[cut] - at, behind[cut] + at)

    to_y, to_x = np.searchsorted(y, x, "right"), np.searchsorted(x, y, "right")
    g = np.zeros(len(y))  # potentials in units of eps, as are the places
    for _ in range(rounds):
        new = tau / (tau + eps) * (rho - reach(y, x, to_x, a - reach(x, y, to_y, g)))
        done, g = np.abs(new - g).max() * eps < tol, new
        if done:
            break
    f, cost, step = a - reach(x, y, to_y, g), 0.0, max(1, cells // len(y))
    for i in range(0, len(x), step):
        c = np.abs(x[i : i + step, None] - y[None])
        cost += float((np.exp(f[i : i + step, None] + g[None] - c) * c).sum())
    return cost * eps


def semi_ot_cost(sides: DataFrame, group: str, eps: float = 0.05, tau: float = 0.5) -> DataFrame:
    """``sides(group, side, v)``: transport cost of the values of side 0 to those of side 1, by group. A group's task holds
    its values, not their pairs."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf.loc[pdf["side"] == k, "v"].to_numpy(float) for k in (0, 1))
        cost = semi_relaxed_line_cost(x, y, eps, tau) if len(x) and len(y) else float("nan")
        return pd.DataFrame({group: [pdf[group].iloc[0]], "cost": [cost]})

    return sides.groupBy(group).applyInPandas(solve, f"{group} long, cost double")


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row in a cheapest assignment (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner, back = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j, least, used = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while owner[j]:
            used[j] = True
            row = owner[j]
            gap = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (gap < least[1:])
            least[1:][better], back[1:][better] = gap[better], j
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            k = int(free.argmin())
            step = free[k]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j = k
        while j:
            owner[j], j = owner[back[j]], back[j]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def merged(masks: list[set], overlap: float = 0.3) -> list[tuple[int, set]]:
    """Regions in order, each joining the first kept one that it overlaps (IoU above ``overlap``); masks grow as they
    are joined, the first region's number stays."""
    kept: list[tuple[int, set]] = []
    for k, mask in enumerate(masks):
        for _, own in kept:
            if len(own & mask) > overlap * len(own | mask):
                own |= mask
                break
        else:
            kept.append((k, set(mask)))
    return kept


def aupro(maps: list[np.ndarray], regions: list[list[np.ndarray]], limit: float = 0.3, steps: int = 300) -> float | None:
    """Area under mean region overlap against false-positive rate up to ``limit``, divided by it. Thresholds are the
    normal cells at the places that ``steps`` rates from limit / steps to limit point to, rounded down; a cell counts at
    or above one. The curve starts at no overlap and no false positives. None without regions or normals."""
    scores, normal = [], []
    for m, own in zip(maps, regions, strict=True):
        inside = np.zeros(m.shape, dtype=bool)
        for region in own:
            inside |= region
            scores.append(np.sort(m[region]))
        normal.append(m[~inside])
    normal = np.sort(np.concatenate(normal)) if normal else np.zeros(0)
    if not scores or not len(normal):
        return None
    n = len(normal)
    at = normal[[int((1 - limit * k / steps) * (n - 1)) for k in range(1, steps + 1)]]
    reached = lambda s: (len(s) - np.searchsorted(s, at, "left")) / len(s)
    rate, overlap = np.append(0.0, reached(normal)), np.append(0.0, np.mean([reached(s) for s in scores], axis=0))
    area = 0.0
    for x0, x1, y0, y1 in zip(rate, rate[1:], overlap, overlap[1:], strict=False):
        if x0 < limit and x1 > x0:
            end = min(x1, limit)
            area += (end - x0) * (2 * y0 + (y1 - y0) * (end - x0) / (x1 - x0)) / 2
    return float((area + max(0.0, limit - rate[-1]) * overlap[-1]) / limit)
