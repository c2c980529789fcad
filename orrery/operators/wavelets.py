"""Undecimated Haar energies of images: one row an image, all scales in one pass, no shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TINY = 1e-8


def bands(x: np.ndarray, scales: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Details of maps (..., rows, columns), coarsest scale first: high along rows' axis, along columns' axis, along both.
    At scale s a cell is paired with the one 2**s further, around the border; nothing is thinned out."""
    out = []
    for s in range(scales):
        pair = lambda m, axis, s=s: (m, np.roll(m, -(2**s), axis=axis))
        low, high = (f(*pair(x, -2)) / np.sqrt(2) for f in (np.add, np.subtract))
        (ll, lh), (hl, hh) = ([f(*pair(m, -1)) / np.sqrt(2) for f in (np.add, np.subtract)] for m in (low, high))
        out.append((hl, lh, hh))
        x = ll
    return out[::-1]


def box_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square of ``size`` from ``size // 2`` before each cell on, the map turned back at its borders."""
    before = size // 2
    for axis in (-2, -1):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (before, size - 1 - before)
        wide, n = np.pad(x, pad, mode="symmetric"), x.shape[axis]
        x = sum(np.take(wide, range(i, i + n), axis=axis) for i in range(size)) / size
    return x


def describe(x: np.ndarray, scales: int, window: int) -> np.ndarray:
    """Images (n, channels, rows, columns) to (n, rows / window, columns / window, features): per channel, scale and band
    the logarithm of the mean energy; then for the first channel by scale that of the bands' ratios, and by scale that of
    the energy against its wider neighbourhood; each as the mean of a block of ``window`` cells."""
    energies = [[box_mean(b * b, window) for b in three] for three in bands(x, scales)]
    log = lambda e: np.log(_TINY + e)
    got = [log(energies[s][b][:, c]) for c in range(x.shape[1]) for s in range(scales) for b in range(3)]
    first = [[e[:, 0] for e in three] for three in energies]
    for h, v, d in first:
        got += [log(h) - log(v), log(d) - log(h + v)]
    for three in first:
        got.append(log(sum(three)) - log(box_mean(sum(three), 3 * window)))
    y = np.stack(got, axis=-1)
    n, rows, cols, k = y.shape
    return y.reshape(n, rows // window, window, cols // window, window, k).mean(axis=(2, 4))


def colour_planes(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> np.ndarray:
    """Luma and two opponent planes, stacked before rows and columns."""
    return np.stack([0.299 * red + 0.587 * green + 0.114 * blue, red - green, 0.5 * (red + green) - blue], axis=-3)


def haar_energies(images: DataFrame, shape: tuple[int, int, int], scales: int = 2, window: int = 14, colour: bool = False) -> DataFrame:
    """id, r, c, vec for every block of every image. ``images(id, pixels)`` holds channels, rows and columns of ``shape`` in
    that order; with ``colour`` the three channels are red, green and blue, turned into luma and opponents first. An image
    without pixels has no rows; one of another size, or a window that does not divide the shape, is an error."""
    channels, rows, cols = shape
    if rows % window or cols % window:
        raise ValueError("the window must divide the image")
    kind = images.schema["id"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 16):  # so many images are worked on at a time
                part = pdf.iloc[at : at + 16]
                x = np.stack([np.asarray(v, float).reshape(shape) for v in part["pixels"]])
                x = colour_planes(x[:, 0], x[:, 1], x[:, 2]) if colour else x
                y = describe(x, scales, window)
                n, h, w, k = y.shape
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), h * w), "r": np.tile(np.repeat(np.arange(h), w), n), "c": np.tile(np.arange(w), n * h), "vec": list(y.reshape(-1, k))})

    return images.where(F.col("pixels").isNotNull()).select("id", "pixels").mapInPandas(run, f"id {kind}, r int, c int, vec array<double>")
