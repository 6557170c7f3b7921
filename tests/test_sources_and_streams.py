import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom import queries as Q
from cubeloom.cube import Axis, Cube
from cubeloom.operators import images
from cubeloom.operators import massquery as M
from cubeloom.plans.chunking import Chunks
from cubeloom.sources import readers, sinks
from cubeloom.streaming import cubes as streams

SHAPE = (2, 3, 4, 5)


@pytest.fixture(scope="module")
def block():
    return np.random.default_rng(1).integers(0, 3, SHAPE) * np.random.default_rng(2).integers(1, 90, SHAPE)


@pytest.fixture(scope="module")
def cube(spark, block):
    rows = [(*map(int, c), int(block[c])) for c in np.ndindex(SHAPE)]
    return Cube(spark.createDataFrame(rows, "layer int, x int, y int, mz int, signal long"), ("layer", "x", "y", "mz"), SHAPE, axes=(Axis("mz", "mz", 100, 0.5),))


def test_custom_source(spark):
    class Dense(readers.ChunkSource):
        def chunks(self):
            return Chunks((4, 6), (3, 4))

        def dims(self):
            return ("x", "mz")

        def fill(self, box):
            (a, b), (c, d) = box
            return np.add.outer(np.arange(a, b), np.arange(c, d))

    readers.register_source(spark, "test_chunks", Dense)
    got = {(r.x, r.mz): r.signal for r in spark.read.format("test_chunks").load().collect()}
    assert got == {(i, k): float(i + k) for i in range(4) for k in range(6) if i + k}


def test_layouts_and_totals(spark, cube, block, tmp_path):
    layouts = {"spectra": (Chunks(SHAPE, (1, 1, 1, 5)), ["x", "y", "mz"]), "images": (Chunks(SHAPE, (1, 3, 4, 1)), ["mz", "x", "y"])}
    sinks.write_cube(cube, str(tmp_path), layouts, {"entry": {"instrument": {"name": "t"}}, "n": 1})
    reader = readers.StoredReader(spark, str(tmp_path), cube, {n: c for n, (c, _) in layouts.items()})
    assert {r.mz: r.signal for r in reader.spectrum(1, 2, 3).collect()} == dict(enumerate(block[1, 2, 3]))
    assert {(r.x, r.y): r.signal for r in reader.image(0, 4, (0, 1), (1, 2)).collect()} == {(i, j): block[0, i, j, 4] for i in (0, 1) for j in (1, 2)}
    assert {(r.x, r.y): r.signal for r in reader.accumulated_image("max", 1).collect()} == {(i, j): block[1, i, j].max() for i in range(3) for j in range(4)}
    assert {r.mz: r.signal for r in reader.accumulated_spectrum("tic", 0).collect()} == dict(enumerate(block[0].sum((0, 1))))
    assert {(r.path, r.key): r.value for r in spark.read.parquet(f"{tmp_path}/metadata").collect()} == {("/entry/instrument", "name"): "t", ("/", "n"): "1"}
    assert reader.mass_values() == [100, 100.5, 101, 101.5, 102]
    with pytest.raises(readers.UnsupportedDataError):
        readers.FrameReader(cube).accumulated_image("tic", 0)


def test_imzml_round_trip(cube, block, tmp_path):
    sinks.write_imzml(cube, str(tmp_path / "a"))
    got = sinks.read_imzml(str(tmp_path / "a"))
    assert [p for p, _, _ in got] == [(x + 1, y + 1, z + 1) for x in range(3) for y in range(4) for z in range(2)]
    for (x, y, z), mz, s in got:
        assert mz == [100, 100.5, 101, 101.5, 102] and s == block[z - 1, x - 1, y - 1].tolist()
    own = cube.with_df(cube.df.withColumn("m", F.col("mz") + F.col("x") * 10.0))
    sinks.write_imzml(own, str(tmp_path / "b"), one_indexed=False, mz="m")
    assert sinks.read_imzml(str(tmp_path / "b"))[-1][1] == [20, 21, 22, 23, 24]
    with pytest.raises(ValueError):
        sinks.write_imzml(cube, str(tmp_path / "c"), x="y")


def test_spectra_and_dense(cube, block):
    got = {(r.layer, r.x, r.y): r.spectrum for r in cube.where("signal > 0").spectra().collect()}
    for k, v in got.items():
        assert v == block[k].tolist()
    sparse = cube.where("signal > 0")
    assert {(r.layer, r.x, r.y, r.mz): r.signal for r in sparse.dense().collect()} == {c: block[c] for c in np.ndindex(SHAPE)}


def test_query(cube, block):
    spec = M.QuerySpec((M.MassRange("a", 0, 2), M.MassRange("b", 1, 4), M.MassRange("c", 3, 3)), xs=(1, None), scaling=M.Norm.MAX, accumulate=True, origin=M.Origin.TOP_RIGHT)
    r = M.query(cube, spec)
    assert [e.title for e in r.empty] == ["c"]
    cut = block[:, 1:]
    for row in r.images.collect():
        lo, hi = ((0, 2), (1, 4))[row.range_id]
        top = cut[row.layer, :, :, lo:hi].sum((0, 1)).max()
        assert row.tic == cut[row.layer, 2 - row.x - 1, row.y, lo:hi].sum() and row.scaled == pytest.approx(row.tic / top)
    for row in r.accumulated.collect():
        assert row.signal == cut[row.layer, 1 - row.x, row.y, 0:2].sum() + cut[row.layer, 1 - row.x, row.y, 1:4].sum()


def test_spline():
    ramp = np.add.outer(np.arange(6.0), 2 * np.arange(5.0))
    assert np.allclose(images.spline(ramp, 1.0, 3), ramp)
    for order in (1, 2, 3):
        made = images.spline(ramp, 2.0, order)
        assert made.shape == (12, 10) and np.allclose(made[[0, -1]][:, [0, -1]], ramp[[0, -1]][:, [0, -1]])
    with pytest.raises(ValueError):
        images.spline(ramp, 2, 6)


def test_tall_images_are_zoomed_whole(spark):
    rng = np.random.default_rng(2)
    tall = rng.integers(0, 99, (3, 70)) * (rng.random((3, 70)) < 0.5)
    cells = spark.createDataFrame([(g, x, y, float(tall[x, y])) for g in (1, 2) for x in range(3) for y in range(70) if tall[x, y] and (g == 1 or y < 9)], "g int, x int, y int, v double")
    for order in (0, 1, 3):
        made = images.zoom(cells, 2.0, order, 3, 70, ["g"], "v", rows=8, halo=40).collect()
        for g, image in ((1, tall), (2, np.where(np.arange(70) < 9, tall, 0))):
            want, got = images.spline(image, 2.0, order), np.full((6, 140), np.nan)
            for r in made:
                if r.g == g:
                    got[r.x, r.y] = r.v
            assert np.allclose(got, want)


def test_whole_cubes_are_zoomed_and_measured(spark):
    d = "/root/testdata/sf0.1"
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    top, n, labels = vectors.selectExpr("max(vec_id)", "count(distinct vec_id)", "count(distinct label)").first()
    zoomed = Q.QUERIES["fn6_zoom_spline"](spark, d)
    assert zoomed.groupBy("layer").count().select("count").distinct().collect() == [(50 * 2 * (top // 25 + 1),)]
    assert zoomed.select("layer").distinct().count() == labels
    assert Q.QUERIES["agg16_p2_quantiles"](spark, d).count() == n


def test_guard_and_timer(tmp_path):
    with pytest.raises(RuntimeError), sinks.FileGuard(str(tmp_path / "x")):
        (tmp_path / "x").write_text("1")
        raise RuntimeError
    assert not (tmp_path / "x").exists()
    with pytest.raises(FileNotFoundError), sinks.FileGuard(str(tmp_path / "y")):
        pass
    with sinks.JsonTimer(str(tmp_path / "t.json"), "a", "b"):
        pass
    assert json.loads((tmp_path / "t.json").read_text())["a"]["b"] >= 0
    (tmp_path / "c.toml").write_text("[image]\nwidth = 3\n")
    assert readers.plot_config(str(tmp_path / "c.toml"), "image") == {"width": 3}


def test_streams(spark, tmp_path):
    rows = [(f"e{k % 3}", k % 5, float(k % 17) - 3, f"2024-01-01 {k % 24:02d}:00:00") for k in range(300)]
    df = spark.createDataFrame(rows, "kind string, u int, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "kind string, u int, value double, ts timestamp"
    key = lambda d: sorted(map(tuple, d.collect()))
    total = streams.run_to_end(streams.running_totals(streams.read_stream(spark, str(tmp_path / "in"), schema), ["kind"], "value"), "running", "complete")
    assert key(total) == key(streams.running_totals(df, ["kind"], "value"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), schema).withColumnRenamed("value", "signal")
    streams.merge_into(stream, str(tmp_path / "out"), ["kind"], str(tmp_path / "cp")).awaitTermination()
    assert key(streams.totals(spark, str(tmp_path / "out"), ["kind"])) == key(streams.running_totals(df, ["kind"], "value"))
    seen = streams.run_to_end(streams.first_seen(streams.read_stream(spark, str(tmp_path / "in"), schema).select("kind", "u"), ["kind", "u"]), "seen", "append")
    assert seen.count() == 15
    online = streams.run_to_end(streams.online_quantiles(streams.read_stream(spark, str(tmp_path / "in"), schema), "kind", "value"), "online", "update")
    last = online.groupBy("kind").agg(F.max_by("percentiles", "seen").alias("p"), F.max("seen").alias("n")).collect()
    assert {r.n for r in last} == {100} and all(r.p[0] == -3 and r.p[-1] == 13 for r in last)
    layers = streams.window_layers(df, "ts", "12 hours", ["kind"], "value")
    assert sum(r.n for r in layers.collect()) == 300


def test_progress_of_a_stream(spark, tmp_path):
    from cubeloom.streaming import cubes

    seen = []
    listener = cubes.Progress(lambda done, rows: seen.append((done, rows)))
    spark.streams.addListener(listener)
    try:
        for k in range(2):
            spark.range(3).selectExpr("id as x", "id as signal").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = cubes.read_stream(spark, f"{tmp_path}/in", "x long, signal long")
        cubes.run_to_end(cubes.running_totals(stream, ["x"]), "progress_sink", "complete")
        import time

        for _ in range(50):
            if sum(r for _, r in seen) >= 6:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sum(r for _, r in seen) == 6
