"""NumPy archives read by their directory: names, shapes and kinds of arrays without the arrays, and small arrays alone.

Files are listed by Spark (names and lengths only); each is opened where a task runs, through pyarrow's file systems, and
only the parts that are asked for are read: the archive's directory at its end, and the first block of an array. So the
bytes read follow the number of arrays, not their size.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str) -> DataFrame:
    own = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)
    return own.select("path", "length")


def _opened(path: str):
    """A stream that can seek, on whatever file system the path names."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + unquote(path[5:]).lstrip("/"))
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def _header(member) -> tuple[list[int], str, bool]:
    """Shape, kind and column order of an array from the head of its file."""
    version = np.lib.format.read_magic(member)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(member)
    return [int(n) for n in shape], kind.str, fortran


def headers_of(stream) -> Iterator[dict]:
    """One record an array of the archive in ``stream``; one with ``error`` for what cannot be read."""
    try:
        archive = zipfile.ZipFile(stream)
        members = [m for m in archive.infolist() if m.filename.endswith(".npy")]
    except Exception as e:
        yield {"error": f"{type(e).__name__}: {e}"}
        return
    for m in members:
        own = {"name": m.filename[:-4], "bytes": m.file_size, "stored": m.compress_size}
        try:
            with archive.open(m) as member:
                shape, kind, fortran = _header(member)
            yield own | {"shape": shape, "kind": kind, "fortran": fortran}
        except Exception as e:
            yield own | {"error": f"{type(e).__name__}: {e}"}


_HEADERS = "path string, length long, name string, shape array<long>, kind string, fortran boolean, bytes long, stored long, error string"


def array_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, length, name, shape, kind (NumPy's code), fortran, bytes, stored (compressed), error: a row for each array of
    every .npz file below ``path``, from its header. A file or array that cannot be read is a row with ``error``, not a
    failure; a file without arrays has no rows."""
    names = [c.split()[0] for c in _HEADERS.split(", ")]

    def run(frames):
        for pdf in frames:
            for file, length in zip(pdf["path"], pdf["length"], strict=True):
                try:
                    with _opened(file) as stream:
                        got = list(headers_of(stream))
                except Exception as e:
                    got = [{"error": f"{type(e).__name__}: {e}"}]
                if got:
                    rows = [{"path": file, "length": int(length)} | r for r in got]
                    yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return _files(spark, path).mapInPandas(run, _HEADERS)


def map_shape(shape: Column) -> Column:
    """Items, rows and columns of an array of maps, with or without one channel; null for any other shape."""
    return F.when(F.size(shape) == 3, shape).when((F.size(shape) == 4) & (shape[1] == 1), F.array(shape[0], shape[2], shape[3]))


def small_arrays(spark: SparkSession, path: str, names: Sequence[str], most: int = 64 << 20) -> DataFrame:
    """path, item, and each of ``names`` as a string: flat arrays of every .npz file side by side, one row an item. Other
    arrays of a file are not read. A name that a file has not is null throughout; arrays of one file that differ in length,
    or one above ``most`` bytes, fail the query with the file's name."""
    names = list(names)

    def run(frames):
        for pdf in frames:
            for file in pdf["path"]:
                with _opened(file) as stream, zipfile.ZipFile(stream) as archive:
                    there = {m.filename[:-4]: m for m in archive.infolist() if m.filename.endswith(".npy")}
                    got = {}
                    for n in (n for n in names if n in there):
                        if there[n].file_size > most:
                            raise ValueError(f"{file}: {n} is no small array")
                        with archive.open(there[n]) as member:
                            got[n] = np.lib.format.read_array(member, allow_pickle=False).reshape(-1)
                if len({len(a) for a in got.values()}) > 1:
                    raise ValueError(f"{file}: arrays differ in length")
                if got:
                    n = len(next(iter(got.values())))
                    yield pd.DataFrame({"path": [file] * n, "item": np.arange(n)} | {k: got[k].astype(str) if k in got else [None] * n for k in names})

    kept = ", ".join(f"`{n}` string" for n in names)
    return _files(spark, path).select("path").mapInPandas(run, f"path string, item long, {kept}")


def with_sidecar(rows: DataFrame, sidecar: DataFrame, name: str) -> DataFrame:
    """``rows`` of ``small_arrays`` with ``name`` taken from a sidecar (path of the archive, item, name) where the archive has
    none itself; items that neither names fail the query."""
    other = sidecar.select("path", "item", F.col(name).alias("__other"))
    got = rows.join(other, ["path", "item"], "left")
    lost = F.raise_error(F.concat(F.col("path"), F.lit(f": {name} missing and no sidecar")))
    return got.withColumn(name, F.coalesce(F.col(name), F.col("__other"), lost)).drop("__other")
