"""Point cloud files, block files, archives, configuration, the request API and the command line."""

import struct

import numpy as np
import pytest

from gridloom import api, cli
from gridloom.plans.compress import Compression
from gridloom.settings import CompressionSettings, block_sizes, compressor_config, sweep_config
from gridloom.sources import archive, headers, pointcloud, writers
from gridloom.sources.headers import BadCloudFile, Format
from tests.test_engine import FOUR, cloud

PLY = "ply\nformat ascii 1.0\ncomment a b\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + "".join(f"{x} {y} {z}\n" for x, y, z in FOUR)


def put(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data.encode() if isinstance(data, str) else data)
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_detection(tmp_path):
    assert headers.detect(put(tmp_path, "a.txt", PLY)) is Format.PLY
    assert headers.detect(put(tmp_path, "b", "# .PCD v.7\nFIELDS x y z\nPOINTS 1\nDATA ascii\n0 0 0\n")) is Format.PCD
    assert headers.detect(put(tmp_path, "c.PLY", "junk\n")) is Format.PLY
    assert headers.detect(put(tmp_path, "d.xyz", "\n\njunk")) is Format.UNKNOWN
    assert headers.detect(str(tmp_path / "none.pcd")) is Format.UNKNOWN and not headers.supported(str(tmp_path))
    assert [headers.by_extension(p) for p in ("x/.pcd", "a.b.Pcd", "pcd", "a.ply/b", "")] == [Format.PCD, Format.PCD, Format.UNKNOWN, Format.UNKNOWN, Format.UNKNOWN]
    info = headers.describe(put(tmp_path, "e.pcd", PLY))
    assert info.mismatch and info.points == 4 and headers.describe(put(tmp_path, "f.ply", "ply\n")).error


def test_ply(spark, tmp_path):
    assert rows(pointcloud.load(spark, put(tmp_path, "a.ply", PLY))) == sorted(FOUR)
    extra = "ply\nformat ascii 1.0\nelement vertex 2\nproperty uchar red\nproperty float z\nproperty float x\nproperty double y\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n9 3 1 2\n\n8 6 4 5\n3 0 1 1\n"
    path = put(tmp_path, "b.ply", extra)
    assert rows(pointcloud.load(spark, path)) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    assert rows(pointcloud.load(spark, put(tmp_path, "a2.ply", PLY + "5 5 5\n6 6 6\n"))) == sorted(FOUR)
    with pytest.raises(Exception, match="fewer than 3 numbers"):
        pointcloud.load(spark, put(tmp_path, "a3.ply", PLY.replace("0.0 1.0 0.0", "0.0 1.0")))
    dtype = np.dtype([("x", "<f4"), ("i", "u1"), ("y", "<f4"), ("z", "<f4")])
    data = np.zeros(5000, dtype)
    data["x"], data["y"], data["z"] = np.arange(5000), 1, np.where(np.arange(5000) == 7, np.nan, 2)
    head = "ply\r\nformat binary_little_endian 1.0\r\nelement vertex 5000\r\nproperty float x\r\nproperty uchar i\r\nproperty float y\r\nproperty float z\r\nend_header\r\n"
    path = put(tmp_path, "c.ply", head.encode() + data.tobytes())
    for size in (1000, 1 << 20):
        got = pointcloud.load(spark, path, rangeBytes=size)
        assert got.count() == 4999 and sorted(r.x for r in got.collect())[:9] == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    with pytest.raises(Exception, match="fewer points"):
        pointcloud.load(spark, put(tmp_path, "d.ply", head.encode() + data.tobytes()[:-1])).count()


def test_pcd(spark, tmp_path):
    lines = "".join(f"{i} {i + 0.5} -{i}\n" for i in range(3000))
    text = f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 3000\nHEIGHT 1\nPOINTS 3000\nDATA ascii\n{lines}"
    path = put(tmp_path, "a.pcd", text)
    for size in (100, 997, 1 << 20):
        assert rows(pointcloud.load(spark, path, rangeBytes=size)) == sorted((float(i), i + 0.5, -float(i)) for i in range(3000))
    assert pointcloud.load(spark, put(tmp_path, "b.pcd", text.rstrip("\n"))).count() == 3000
    assert pointcloud.load(spark, put(tmp_path, "b2.pcd", text + "junk\n9 9 9\n")).count() == 3000
    with pytest.raises(BadCloudFile, match="2999 points"):
        pointcloud.load(spark, put(tmp_path, "c.pcd", text.replace("7 7.5 -7\n", "seven\n", 1)))
    dtype = np.dtype([("i", "<u2"), ("n", "<f4", 3), ("x", "<f8"), ("y", "<f4"), ("z", "<f4")])
    data = np.zeros(10, dtype)
    data["x"], data["y"], data["z"] = np.arange(10), [1] * 9 + [np.inf], 3
    head = "VERSION 0.7\nFIELDS i n x y z\nSIZE 2 4 8 4 4\nTYPE U F F F F\nCOUNT 1 3 1 1 1\nWIDTH 10\nHEIGHT 1\nPOINTS 10\nDATA binary\n"
    assert rows(pointcloud.load(spark, put(tmp_path, "d.pcd", head.encode() + data.tobytes()))) == [(float(i), 1.0, 3.0) for i in range(9)]


@pytest.mark.parametrize("bad", ["", "ply\n", "ply\nformat ascii 1.0\nend_header\n", "ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty float x\nend_header\n", "VERSION 0.7\nFIELDS x y z\nPOINTS 0\nDATA ascii\n", "VERSION 0.7\nPOINTS 2\n", "VERSION 0.7\nFIELDS x y z\nPOINTS 2\nDATA binary_compressed\n"])
def test_malformed(spark, tmp_path, bad):
    with pytest.raises(BadCloudFile):
        pointcloud.load(spark, put(tmp_path, "bad.dat", bad))


def test_writers(spark, tmp_path):
    points = cloud(spark, FOUR + [(-1234.56789, 0.000012345, 1e9)])
    for name in ("a.pcd", "a.ply"):
        path = str(tmp_path / name)
        assert writers.save(points, path) == 5
        assert headers.detect(path) is Format[name[2:].upper()]
        got = np.array(rows(pointcloud.load(spark, path)))
        assert np.allclose(got, np.array(rows(points)), rtol=1e-5, atol=2e-5)
    assert "0.000000 0.000000 1.000000" in (tmp_path / "a.pcd").read_text()
    with pytest.raises(ValueError):
        writers.save(points, str(tmp_path / "a.txt"))
    blocks = spark.createDataFrame([(1, 0, 0, b"\x05"), (0, 0, 1, b"\x01")], "bx int, by int, bz int, pattern binary")
    path = str(tmp_path / "blocks.bin")
    assert writers.write_blocks(blocks, path, 2) == 2
    assert struct.unpack("<II", (tmp_path / "blocks.bin").read_bytes()[:8]) == (2, 2)
    size, back = writers.read_blocks(spark, path)
    assert size == 2 and [tuple(r) for r in back.collect()] == [(1, 0, 0, b"\x05"), (0, 0, 1, b"\x01")]


def test_archive(spark, tmp_path):
    run = Compression(cloud(spark, np.random.default_rng(1).normal(size=(300, 3)).tolist()), CompressionSettings(0.2, 3))
    path = str(tmp_path / "map")
    assert not archive.is_archive(spark, path)
    with pytest.raises(archive.BadArchive):
        archive.read(spark, path)
    archive.write(run, path)
    tables = archive.read(spark, path)
    assert tables["metadata"].first().compression_method == "voxel_dictionary"
    assert tables["dictionary"].count() == run.sizes.n_patterns
    assert {r.voxel_id for r in archive.decode(spark, path).collect()} == {r.voxel_id for r in run.voxels.collect()}
    archive.write_raw(run, str(tmp_path / "raw"), full=True)
    raw = spark.read.parquet(str(tmp_path / "raw/voxels"))
    assert raw.count() == run.grid.voxels and raw.where("value = 255").count() == run.committed


def test_config():
    text = "some_node:\n  ros__parameters:\n    input_file: a.ply\n    voxel_size: 0.1\n    block_size: 13\n    min_points_threshold: 2\n"
    c = compressor_config(text)
    assert (c.voxel_size, c.block_size, c.settings.min_points, c.archive_path) == (0.1, 13, 2, None)
    assert compressor_config("input_file: b.pcd\nsave_hdf5: true\n").problems(look=False) == ["hdf5_output_file must be set when save_hdf5 is true"]
    s = sweep_config("block_size_optimizer:\n  ros__parameters: {min_block_size: 2, max_block_size: 1, step_size: 0}\n")
    assert len(s.problems()) == 3 and s.base.block_size == 8
    assert block_sizes(0, 99, 0) == list(range(1, 65)) and block_sizes(5, 4) == []


def test_requests(spark, tmp_path):
    path = put(tmp_path, "four.ply", PLY)
    seen = []
    with api.Handle(spark) as handle:
        report = handle.compress(api.Request(path, CompressionSettings(0.1, 2), str(tmp_path / "out"), str(tmp_path / "raw")))
        assert report.success and not report.error and not report.warning and report.sizes.n_patterns == 2
        assert archive.is_archive(spark, str(tmp_path / "out"))
        assert "Compression ratio: 4.541667" in report.text() and "[REPORT][Memory]" in report.run.report(path)
        bad = handle.compress(api.Request(str(tmp_path / "none.ply")))
        assert not bad.success and "no such file" in bad.error
        assert not handle.compress(api.Request("", CompressionSettings(0, 0))).success
    assert api.run_compression(spark, api.Request(path, CompressionSettings(0.1, 2)), lambda r: seen.append(r.sizes.n_blocks)) == "" and seen == [216]
    with pytest.raises(ValueError):
        api.run_compression(spark, api.Request(path), None)


def test_command_line(spark, tmp_path, capsys):
    path = put(tmp_path, "four.ply", PLY)
    config = put(tmp_path, "c.yaml", f"block_size_optimizer:\n  ros__parameters:\n    input_file: {path}\n    voxel_size: 0.1\n    min_block_size: 2\n    max_block_size: 4\n    step_size: 1\n    save_hdf5: true\n    hdf5_output_file: {tmp_path}/arch\n    run_once: true\n")
    assert cli.main(["optimize", config], spark) == 0
    said = capsys.readouterr().out
    assert "Optimal block size: 4" in said and "Optimal voxel size: 0.050000" in said and archive.is_archive(spark, f"{tmp_path}/arch")
    assert cli.main(["sweep", config], spark) == 0 and '"optimal_block_size": 4' in capsys.readouterr().out
    plain = put(tmp_path, "p.yaml", f"input_file: {path}\nvoxel_size: 0.1\nblock_size: 2\n")
    assert cli.main(["compress", plain], spark) == 0 and "Block count      : 216" in capsys.readouterr().out
    assert cli.main(["compress", put(tmp_path, "q.yaml", "input_file: ''\n")], spark) == 1 and cli.main(["compress"], spark) == 2
