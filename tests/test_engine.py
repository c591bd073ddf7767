"""The four-point cloud's goldens, round trips over random clouds, and properties that any cloud has."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import metrics, packing
from gridloom.operators import blocks, dictionary, sweep, voxel
from gridloom.plans.compress import Compression, EmptyCloud
from gridloom.settings import CompressionSettings

FOUR = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]


def cloud(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, y double, z double").select(*[F.col(a).cast("float") for a in "xyz"])


GOLD = {1: (1331, 2, 1333, 27.770834), 2: (216, 2, 218, 4.5416665), 3: (64, 5, 84, 1.75), 4: (27, 5, 67, 1.3958334), 8: (8, 5, 328, 6.8333335)}


def test_four_points(spark):
    points = cloud(spark, FOUR)
    for size, (n, patterns, compressed, ratio) in GOLD.items():
        run = Compression(points, CompressionSettings(0.1, size))
        s = run.sizes
        assert run.grid.dims == (11, 11, 11) and run.committed == 4
        assert (s.n_blocks, s.n_patterns, s.compressed_bytes, s.index_bits) == (n, patterns, compressed, 8)
        assert s.compression_ratio == float(np.float32(ratio)) and s.original_bytes == 48
    run = Compression(points, CompressionSettings(0.1, 2))
    found = {r.code: r.pattern.hex() for r in run.patterns.collect()}
    assert found == {0: "01", 1: "00"}
    assert sorted(r.block_id for r in run.dense.where("code = 0").collect()) == [0, 5, 30, 180]
    three = {r.code: r.pattern.hex() for r in Compression(points, CompressionSettings(0.1, 3)).patterns.collect()}
    assert [three[k] for k in sorted(three)] == ["01000000", "00000000", "02000000", "08000000", "00020000"]
    four = {r.code: r.pattern.hex() for r in Compression(points, CompressionSettings(0.1, 4)).patterns.collect()}
    assert [four[k] for k in sorted(four)] == ["0100000000000000", "0000000000000000", "0400000000000000", "0001000000000000", "0000000001000000"]
    assert Compression(points, CompressionSettings(0.1, 8)).dictionary.empty_code == 3


def test_four_points_sweeps(spark):
    run = Compression(cloud(spark, FOUR), CompressionSettings(0.1, 2))
    best = sweep.best_block_size(run.sweep_blocks(2, 4)).first()
    assert best.block_size == 4 and best.ratio == pytest.approx(1.3958334)
    sizes = sweep.voxel_sizes()
    assert len(sizes) == 10 and sizes[-1] == 0.04999999329447746
    assert [run.grid.at(s).dims[0] for s in sizes] == [201, 101, 68, 51, 42, 35, 30, 27, 24, 22]
    top = sweep.best_voxel_size(run.sweep_voxels()).first()
    assert top.voxel_size == pytest.approx(0.05) and top.score == pytest.approx(0.00037551633) and top.occupied == 4


def slow(points, s: CompressionSettings):
    """Everything over again with dictionaries and 32-bit floats."""
    f = np.float32
    p = np.array(points, f)
    p = p[np.isfinite(p).all(axis=1)]
    low, high = p.min(0), p.max(0)
    if s.margin > 0:
        pad = np.where(high - low < np.finfo(f).eps, f(0), high - low) * f(s.margin)
        low, high = low - pad, high + pad
    dims = np.ceil((high - low) / f(s.voxel_size)).astype(int) + 1
    at = ((p - low) * (f(1) / f(s.voxel_size))).astype(int)
    at = at[((at >= 0) & (at < dims)).all(axis=1)]
    count = {}
    for v in map(tuple, at.tolist()):
        count[v] = count.get(v, 0) + 1
    kept = {v for v, n in count.items() if n >= s.threshold}
    size, b = s.block_size, -(-dims // s.block_size)
    bits = {}
    for x, y, z in kept:
        i = (z // size) * b[0] * b[1] + (y // size) * b[0] + x // size
        bits.setdefault(int(i), []).append((z % size) * size * size + (y % size) * size + x % size)
    codes, out = {}, []
    for i in range(int(b.prod())):
        out.append(codes.setdefault(tuple(sorted(bits.get(i, []))), len(codes)))
    ids = {int(z * dims[0] * dims[1] + y * dims[0] + x) for x, y, z in kept}
    return dims, ids, list(codes), out


@pytest.mark.parametrize("size,threshold,margin", [(1, 1, 0.0), (2, 2, 0.1), (3, 1, 0.2), (5, 3, 0.0), (13, 1, 0.0)])
def test_round_trip(spark, size, threshold, margin):
    rng = np.random.default_rng(size)
    rows = np.round(rng.normal(0, 1.2, (400, 3)), 3).tolist() + [[0.1, 0.2, 0.3]] * 5 + [[float("nan"), 0, 0], [0, float("inf"), 0]]
    s = CompressionSettings(0.3, size, threshold, margin)
    run = Compression(cloud(spark, rows), s)
    dims, ids, codes, indices = slow(rows, s)
    assert run.grid.dims == tuple(dims)
    assert {r.voxel_id for r in run.voxels.collect()} == ids == {r.voxel_id for r in run.decoded().collect()}
    found = run.dictionary.codes.orderBy("code").collect()
    assert [tuple(r.bits) for r in found] == codes and [r.code for r in found] == list(range(len(codes)))
    assert [a.first_block < b.first_block for a, b in zip(found, found[1:])] == [True] * (len(found) - 1)
    assert [r.code for r in run.dense.orderBy("block_id").collect()] == indices
    assert sum(r.uses for r in found) == run.n_blocks == len(indices)
    again = Compression(cloud(spark, rows[::-1]), s)
    assert {tuple(r) for r in again.encoded.collect()} == {tuple(r) for r in run.encoded.collect()}
    bits = blocks.unpacked(run.patterns, "code").groupBy("code").agg(F.sort_array(F.collect_list("bit")).alias("b")).collect()
    assert {r.code: tuple(r.b) for r in bits} == {k: c for k, c in enumerate(codes) if c}
    for pack, back in ((run.index_chunks(), lambda p: packing.unpack_fixed(p, run.sizes.index_bits)), (run.bit_chunks(), lambda p: packing.unpack_bits(p, run.sizes.bit_width, run.n_blocks))):
        assert [r.code for r in back(pack).orderBy("block_id").collect()] == indices
    assert sum(len(r.data) for r in run.bit_chunks().collect()) == packing.packed_bytes(run.n_blocks, run.sizes.bit_width)
    flat = b"".join(bytes(r.data) for r in run.dictionary_chunks().orderBy("chunk").collect())
    assert len(flat) == len(codes) * s.pattern_bytes
    assert sum(r.n for r in run.markers(50).collect()) == len(ids)


def test_packing_widths(spark):
    rng = np.random.default_rng(0)
    for width in (1, 3, 7, 8, 13, 31, 32):
        codes = [int(c) for c in rng.integers(0, 1 << width, 37)]
        df = spark.createDataFrame(list(enumerate(codes)), "block_id long, code long")
        chunks = packing.pack_bits(df, width, 16)
        data = b"".join(bytes(r.data) for r in chunks.orderBy("chunk").collect())
        want = sum(c << (i * width) for i, c in enumerate(codes)).to_bytes(packing.packed_bytes(37, width), "little")
        assert data == want
        assert [r.code for r in packing.unpack_bits(chunks, width, 37, 16).orderBy("block_id").collect()] == codes
    for width in (8, 16, 32, 64):
        codes = [int(c) for c in rng.integers(0, 1 << min(width, 62), 21)]
        chunks = packing.pack_fixed(spark.createDataFrame(list(enumerate(codes)), "block_id long, code long"), width, 8)
        assert b"".join(bytes(r.data) for r in chunks.orderBy("chunk").collect()) == b"".join(c.to_bytes(width // 8, "little") for c in codes)
        assert [r.code for r in packing.unpack_fixed(chunks, width, 8).orderBy("block_id").collect()] == [c & 0xFFFFFFFF for c in codes]
    assert packing.pack_fixed(spark.createDataFrame([(0, 1)], "block_id long, code long"), 12).first().data == b""


def test_widths(spark):
    tops = [0, 1, 2, 3, 255, 256, 2**32 - 1]
    assert [packing.bit_width_of(t) for t in tops] == [1, 1, 2, 2, 8, 9, 32]
    df = spark.createDataFrame([(t,) for t in tops], "t long")
    assert [r.w for r in df.select(packing.bit_width(F.col("t")).alias("w")).collect()] == [1, 1, 2, 2, 8, 9, 32]
    wide = spark.createDataFrame([(0,), (1,), (65535,), (2**33,)], "t long")
    assert [r.u for r in wide.select(packing.to_u32(F.col("t")).alias("u")).collect()] == [0, 1, 65535, 0]
    assert [dictionary.index_width(t) for t in (0, 255, 256, 65535, 65536, 2**32 - 1, 2**32)] == [8, 8, 16, 16, 32, 32, 64]


def test_metrics():
    m = metrics.summary_metrics((2, 2, 2), (1, 1, 1), 2, 0.1, 1, 4, 4, 8, 8)
    assert m.ratio_vs_one_byte == 1.0 and m.ratio_vs_one_bit == 8.0
    said = metrics.sweep_json(8, m)
    assert '"optimal_block_size": 8' in said and '"dictionary_entries": 1' in said and '"index_entries": 4' in said and '"compression_ratio_vs_one_bit": 8.000000' in said
    assert len(metrics.summary_lines(m)) == 8
    assert metrics.sweep_text(None, None, {}) == "Block size optimization failed."
    assert metrics.builder_ratio(0, 0, 1) == 1.0 and metrics.ratio32(1, 0) == 1.0
    assert metrics.memory_estimate(5, CompressionSettings(0.1, 2, 2)) == 60 + 3 + 8


def test_ranks_by_range(spark):
    df = spark.createDataFrame([(v * v,) for v in range(300)], "v long")
    got = dictionary.ranked(df.repartition(5), "v", "rank", 300, per_range=40).collect()
    assert sorted((r.v, r["rank"]) for r in got) == [(v * v, v) for v in range(300)]


def test_grid_edits_and_lookup(spark):
    run = Compression(cloud(spark, FOUR), CompressionSettings(0.1, 2))
    one, two = spark.createDataFrame([(5,)], "voxel_id long"), spark.createDataFrame([(0,)], "voxel_id long")
    more = voxel.set_voxels(run.voxels, one)
    assert more.count() == 5 and voxel.clear_voxels(more, two).count() == 4
    asked = spark.createDataFrame([(0, 0, 0), (10, 0, 0), (1, 1, 1), (-1, 0, 0), (99, 0, 0)], "vx int, vy int, vz int")
    assert {tuple(r) for r in voxel.lookup(asked, run.voxels, run.grid).select("vx", "occupied").collect()} == {(0, True), (10, True), (1, False), (-1, False), (99, False)}
    words = packing.words(run.voxels)
    assert packing.popcount(words).first().occupied == 4
    probe = spark.createDataFrame([(0,), (1,), (10,)], "voxel_id long")
    assert {tuple(r) for r in packing.probe_bits(words, probe).collect()} == {(0, True), (1, False), (10, True)}


def test_empty_and_single(spark):
    with pytest.raises(EmptyCloud):
        Compression(cloud(spark, FOUR).limit(0), CompressionSettings()).sizes
    one = Compression(cloud(spark, [(2, 2, 2)]), CompressionSettings(0.1, 1, 1, 0.5))
    assert one.grid.dims == (1, 1, 1) and one.sizes.n_patterns == 1 and one.dictionary.empty_code is None
    none = Compression(cloud(spark, FOUR), CompressionSettings(0.1, 4, 2))
    assert none.committed == 0 and none.sizes.n_patterns == 1 and none.decoded().count() == 0


def test_plan_reads_only_its_columns(spark):
    run = Compression(cloud_of_table(spark), CompressionSettings(1.0, 4))
    plan = run.counts._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in plan.replace("\n", "")


def cloud_of_table(spark):
    from gridloom.plans.clouds import CLOUDS

    return CLOUDS["lineitem"].read(spark, "/root/testdata/sf0.001")


def test_streaming_counts(spark, tmp_path):
    from gridloom.streaming.counts import fixed_grid, running_counts

    points, schema = cloud(spark, FOUR * 3), "x float, y float, z float"
    points.write.parquet(str(tmp_path / "in"))
    grid = fixed_grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), 0.1)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = running_counts(stream, grid).writeStream.outputMode("complete").format("memory").queryName("voxels").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("voxels").collect()} == {tuple(r) for r in voxel.voxel_counts(points, grid).collect()}


def slow_sweep(points, grid, sizes, threshold=1):
    """Occupied voxels of each size, from every point at every size."""
    f = np.float32
    p = np.array(points, f)
    p = np.clip(p[np.isfinite(p).all(axis=1)] - np.array(grid.low, f), -1e16, 1e16).astype(f)
    out = []
    for g in map(grid.at, sizes):
        at = (p * g.inverse).astype(np.int64)
        at = at[((at >= 0) & (at < np.array(g.dims))).all(axis=1)]
        out.append(int((np.unique(at, axis=0, return_counts=True)[1] >= threshold).sum()))
    return out


def exploded(node):
    """Rows that the plan's explosions made of rows of points."""
    own = node.metrics().apply("numOutputRows").value() if node.nodeName() == "Generate" else 0
    return own + sum(exploded(node.children().apply(i)) for i in range(node.children().size()))


def test_voxel_size_sweep_puts_cells_not_points_in_voxels(spark):
    rng = np.random.default_rng(7)
    corners = rng.integers(0, 20, (40, 3)) * 0.05
    rows = (corners[rng.integers(0, 40, 5000)] + rng.uniform(0.0005, 0.0045, (5000, 3))).tolist() + [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = Compression(cloud(spark, rows), CompressionSettings(0.1, 2))
        swept = run.sweep_voxels()
        found = [r.occupied for r in sorted(swept.collect())]
        made = exploded(swept._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert found == slow_sweep(rows, run.grid, sweep.voxel_sizes())
    # 42 cells, rather than 5002 points, at ten sizes each; ten rows more are the sizes themselves.
    assert made <= 10 * 42 * 2 + 10


@pytest.mark.parametrize("span,threshold,margin", [((0.005, 0.05, 0.005), 1, 0.0), ((0.07, 0.9, 0.031), 1, 0.1), ((0.013, 0.4, 0.0477), 3, 0.0), ((0.3, 0.31, 0.1), 2, 0.3)])
def test_voxel_size_sweep_against_every_point(spark, span, threshold, margin):
    rng = np.random.default_rng(3)
    near = np.round(rng.normal(0, 0.6, (1500, 3)), 2).tolist()
    rows = near + near[:700] + rng.normal(0, 0.2, (1500, 3)).tolist() + [[float("nan"), 0, 0], [0, float("inf"), 0]]
    sizes = sweep.voxel_sizes(*span)
    run = Compression(cloud(spark, rows), CompressionSettings(0.1, 2, threshold, margin))
    assert [r.occupied for r in sorted(run.sweep_voxels(*span).collect())] == slow_sweep(rows, run.grid, sizes, threshold)
    # On a grid that leaves points outside, near and far.
    box = voxel.Grid((-0.25, -0.3, -0.1), (0.4, 0.3, 0.5), 0.1, 0, (0.65, 0.6, 0.6))
    rows += [[1e6, 0, 0], [0, -3e38, 0], [0, 0, 3e38]]
    found = sweep.voxel_size_sweep(cloud(spark, rows), box, sizes, threshold)
    assert [r.occupied for r in sorted(found.collect())] == slow_sweep(rows, box, sizes, threshold)


def test_voxel_size_sweep_of_wide_clouds(spark):
    for wide in (2e7, 1e15):
        rows = [(0, 0, 0), (wide, 0, 0), (wide / 2, 0, 0), (wide / 2, 0, 0)]
        run = Compression(cloud(spark, rows), CompressionSettings(1.0, 2))
        found = [r.occupied for r in sorted(run.sweep_voxels().collect())]
        assert found == slow_sweep(rows, run.grid, sweep.voxel_sizes()) and max(found) == 3


@pytest.mark.parametrize("name", ["best_voxel_size_lineitem", "voxel_size_sweep_lineitem_fine", "best_voxel_size_lineitem_fine"])
def test_voxel_sizes_of_a_repeated_table(spark, tmp_path, name):
    from gridloom import registry

    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows.write.parquet(str(tmp_path / "one/lineitem.parquet"))
    rows.crossJoin(spark.range(5)).drop("id").write.parquet(str(tmp_path / "five/lineitem.parquet"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = [registry.queries()[name](spark, str(tmp_path / d)) for d in ("one", "five")]
        one, five = (sorted(map(tuple, df.collect())) for df in found)
        made = [exploded(df._jdf.queryExecution().executedPlan()) for df in found]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert one == five and made[0] == made[1] > 0
