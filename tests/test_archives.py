"""Archives by their directory: what is told, and how little is read."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.sources import archives


class Counting(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        got = super().read(n)
        self.read_bytes += len(got)
        return got


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a b").mkdir()
    ids = np.array(["x/1", "x/2", "ü"])
    np.savez(tmp_path / "a b" / "one.npz", maps=np.zeros((3, 1, 64, 64), np.float32), sample_ids=ids, gt_sp=np.array([[0], [1], [1]]))
    np.savez_compressed(tmp_path / "two.npz", maps=np.ones((2, 8, 9), order="F"), gt_sp=np.array([1.5, 0.0]), odd=np.zeros(()))
    (tmp_path / "broken.npz").write_bytes(b"not an archive")
    (tmp_path / "note.txt").write_text("left out")
    return str(tmp_path)


def test_headers(spark, folder):
    got = {(r["path"].rsplit("/", 1)[1], r["name"]): r for r in archives.array_headers(spark, folder).withColumn("m", archives.map_shape(F.col("shape"))).collect()}
    assert len(got) == 7
    one, two = got["one.npz", "maps"], got["two.npz", "maps"]
    assert (one["shape"], one["kind"], one["m"], one["fortran"]) == ([3, 1, 64, 64], "<f4", [3, 64, 64], False) and one["bytes"] > 3 * 64 * 64 * 4
    assert two["m"] == [2, 8, 9] and two["fortran"] and two["stored"] < two["bytes"]
    assert got["two.npz", "odd"]["shape"] == [] and got["two.npz", "odd"]["m"] is None and got["one.npz", "sample_ids"]["kind"] == "<U3"
    assert got["broken.npz", None]["error"] and all(r["error"] is None for k, r in got.items() if k[1])


def test_bytes_do_not_grow_with_the_maps():
    read = []
    for n in (4, 4000):
        raw = io.BytesIO()
        np.savez(raw, maps=np.random.default_rng(0).random((n, 16, 16)), gt=np.zeros(4))
        stream = Counting(raw.getvalue())
        assert [r["shape"] for r in archives.headers_of(stream)] == [[n, 16, 16], [4]]
        read.append(stream.read_bytes)
    assert max(read) < 40_000 and read[1] <= read[0] + 10_000


def test_a_damaged_array_is_a_row():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("bad.npy", b"nothing")
        z.writestr("readme", b"no array")
    (only,) = archives.headers_of(io.BytesIO(raw.getvalue()))
    assert only["name"] == "bad" and "error" in only


def test_small_arrays_and_sidecar(spark, folder, tmp_path):
    (tmp_path / "broken.npz").unlink()
    got = archives.small_arrays(spark, folder, ["sample_ids", "gt_sp"])
    rows = {(r["path"].rsplit("/", 1)[1], r["item"]): (r["sample_ids"], r["gt_sp"]) for r in got.collect()}
    assert rows == {("one.npz", 0): ("x/1", "0"), ("one.npz", 1): ("x/2", "1"), ("one.npz", 2): ("ü", "1"), ("two.npz", 0): (None, "1.5"), ("two.npz", 1): (None, "0.0")}
    two = [r["path"] for r in got.where("sample_ids is null").select("path").distinct().collect()][0]
    side = spark.createDataFrame([(two, 0, "s0"), (two, 1, "s1")], "path string, item long, sample_ids string")
    assert {r["sample_ids"] for r in archives.with_sidecar(got, side, "sample_ids").collect()} == {"x/1", "x/2", "ü", "s0", "s1"}
    with pytest.raises(Exception, match="no sidecar"):
        archives.with_sidecar(got, side.limit(0), "sample_ids").collect()
    for bad, said in ((["maps", "gt_sp"], "differ in length"), (["maps"], "no small array")):
        with pytest.raises(Exception, match=said):
            archives.small_arrays(spark, folder, bad, most=1000 if bad == ["maps"] else 1 << 20).collect()
