import numpy as np
import pytest

from cubeloom import engine
from cubeloom.cube import Axis, Cube
from cubeloom.functions import chem
from cubeloom.operators import massquery as M
from cubeloom.operators import slicing as S

SHAPE = (2, 4, 3, 8)


@pytest.fixture(scope="module")
def block():
    return np.random.default_rng(7).integers(1, 50, SHAPE)


@pytest.fixture(scope="module")
def cube(spark, block):
    rows = [(*map(int, c), int(block[c])) for c in np.ndindex(SHAPE)]
    return Cube(spark.createDataFrame(rows, "layer int, x int, y int, mz int, signal long"), ("layer", "x", "y", "mz"), SHAPE, axes=(Axis("mz", "mz"),))


def test_convert_query_and_describe(spark, cube, block, tmp_path):
    options = engine.ConvertOptions(chunk_bytes=8 * 16, memory_bytes=8 * 64)
    reader = engine.convert(cube, str(tmp_path), options, {"run": {"id": 3}})
    layouts, name, read = engine.plan(SHAPE, options)
    assert set(layouts) == {"images", "spectra"} and name in layouts and np.prod(read.chunk) <= 64
    images = engine.query(reader, M.QuerySpec((M.MassRange("a", 2, 5),))).images.collect()
    assert {(r.layer, r.x, r.y): r.tic for r in images} == {(i, j, k): block[i, j, k, 2:5].sum() for i, j, k in np.ndindex(SHAPE[:3])}
    both = engine.bulk_query({"one": cube, "two": reader}, M.QuerySpec((M.MassRange("a", 0, 1),)))
    assert {r["input"]: r["count"] for r in both.groupBy("input").count().collect()} == {"one": 24, "two": 24}
    assert [(r.path, r.key, r.value) for r in engine.inspect(spark, str(tmp_path)).collect()] == [("/run", "id", "3")]
    stats = {r.layout: r for r in engine.density(reader).collect()}
    assert all(s.used_chunks == s.total_chunks and s.density == 1 for s in stats.values())
    with pytest.raises(S.MissingArgumentError):
        engine.bulk_query({}, M.QuerySpec(()))


def test_slices(cube, block):
    groups = {"a": S.GroupSpec("a", ("s",), default_action=S.Action.SUM)}
    assert engine.slice({"s": cube}, groups)["a"].first().signal == block.sum()
    assert engine.slice({"s": cube}, groups, check=True)["a"].shape == SHAPE


def test_chemistry(spark, tmp_path):
    # Masses of well-known formulas over the common isotopes.
    want = {"CH2": (14.0270895706, 14.01565, 14.01565), "H2O": (18.01503785738, 18.010565, 18.010565), "NaCl": (58.442508215, 57.958623, 57.958623), "SnCl2": (189.45439827, 181.842532, 189.839905), "Fe2O3": (159.6905864497, 155.863969, 159.854623), "LiBO2": (49.7517342732, 48.017891, 50.01514), "C60": (720.6622143, 720.0, 720.0)}
    got = {r.formula: (r.average, r.lightest, r.abundant) for r in engine.compound(spark, list(want)).collect()}
    for f, masses in want.items():
        assert got[f] == pytest.approx(masses, abs=1e-8)
    with pytest.raises(Exception, match="unknown element Xx"):
        engine.compound(spark, ["Xx2"]).collect()
    (tmp_path / "i.csv").write_text('Carbon, C, 12, 12.000000, 98.90,\n"Carbon", C, 13, 13.003355, 1.10,\nHydrogen, H, 1, 1.007825, 99.99,\n')
    table = chem.read_isotopes(spark, str(tmp_path / "i.csv"))
    assert {(r.symbol, r.nominal, r.accurate) for r in table.collect()} == {("C", 12, 12.0), ("C", 13, 13.003355), ("H", 1, 1.007825), ("E", 0, chem.ELECTRON)}
    assert chem.formula_mass(table, "CH2") == pytest.approx(14.01565)


def test_stored_cubes_open_again_and_answer_from_their_totals(spark, cube, block, tmp_path):
    options = engine.ConvertOptions(chunk_bytes=8 * 16, memory_bytes=8 * 64)
    engine.convert(cube, str(tmp_path), options)
    reader = engine.readers.open_stored(spark, str(tmp_path))
    assert reader.cube().shape == SHAPE and reader.cube().axis("mz").labels(8) == list(range(8))
    result = engine.query(reader, M.QuerySpec((M.MassRange("a", 2, 5),), scaling=M.Norm.MAX, accumulate=True))
    assert {(r.layer, r.x, r.y): r.tic for r in result.total_image.withColumn("tic", result.total_image.tic).collect()} == {(i, j, k): block[i, j, k].sum() for i, j, k in np.ndindex(SHAPE[:3])}
    assert "total_images" in "".join(result.total_image.inputFiles()) and "total_spectra" in "".join(result.total_spectrum.inputFiles())
    cut = engine.query(reader, M.QuerySpec((), layers=(0, 1)))
    assert {(r.x, r.y): r.tic for r in cut.total_image.collect()} == {(j, k): block[0, j, k].sum() for j, k in np.ndindex(SHAPE[1:3])}
    engine.export(result, cube, str(tmp_path / "txt"))
    lines = spark.read.text(str(tmp_path / "txt" / "images")).where("range_id = 0 and layer = 0").collect()
    assert len(lines) == SHAPE[2] and len(lines[0].value.split()) == SHAPE[1]
    assert spark.read.text(str(tmp_path / "txt" / "total_spectrum")).count() == SHAPE[0] * SHAPE[3]


def test_subpixels(cube, block):
    result = engine.query(cube, M.QuerySpec((M.MassRange("a", 0, 1),), subpixels=2.0, interpolation=1))
    rows = {(r.x, r.y): r.scaled for r in result.images.where("layer = 0").collect()}
    assert len(rows) == 4 * SHAPE[1] * SHAPE[2]
    for corner, at in (((0, 0), (0, 0)), ((2 * SHAPE[1] - 1, 2 * SHAPE[2] - 1), (SHAPE[1] - 1, SHAPE[2] - 1))):
        assert rows[corner] == pytest.approx(block[0, at[0], at[1], 0])


def test_cells_are_appended(spark, cube, block, tmp_path):
    half = cube.where("layer = 0")
    options = engine.ConvertOptions(chunk_bytes=8 * 16)
    reader = engine.convert(half, str(tmp_path), options)
    layouts = {n: (c, list(cube.dims)) for n, c in reader.layouts.items()}
    engine.sinks.append_cells(cube.where("layer = 1").df, cube, str(tmp_path), layouts)
    again = engine.readers.open_stored(spark, str(tmp_path))
    assert again.cube().df.count() == block.size
    engine.sinks.refresh_totals(again.cube(), str(tmp_path))
    assert again.accumulated_spectrum("tic", 1).count() == SHAPE[3]


def test_exact_values_and_counts_are_read_back(spark, tmp_path):
    from cubeloom.operators import ingest

    points = spark.createDataFrame([(0, 0, 0, 0.4, 2), (0, 0, 0, 0.6, 3), (0, 1, 0, 1.5, 4)], "layer int, x int, y int, exact double, signal long")
    made, sums = ingest.convert_points(points, ("layer", "x", "y", "mz"), (1, 2, 1, 2), {"mz": ("exact", [0.0, 1.0, 2.0])}, named={"image": ("mz",)})
    assert made.axis("mz").labels(2) == [1.0, 2.0]
    assert {(r.x, r.tic, r.n) for r in sums.collect()} == {(0, 5, 2), (1, 4, 1)}
    reader = engine.convert(made, str(tmp_path))
    assert {(r.x, r.signal, r.exact, r.n) for r in reader.points().collect()} == {(0, 5, 0.6, 2), (1, 4, 1.5, 1)}


def test_first_needs_an_order(spark):
    from cubeloom.operators import ingest

    rows = spark.createDataFrame([(0, 5, 1), (0, 1, 2)], "x int, v int, at int")
    merged = ingest.merge_duplicates(rows, ["x"], {"v": "first"}, order=["at"]).first()
    assert merged.v == 5
    with pytest.raises(ValueError):
        ingest.merge_duplicates(rows, ["x"], {"v": "first"})


def test_concat_needs_shapes_that_fit(cube):
    from cubeloom.cube import Cube, concat

    whole = concat([cube, cube], "x")
    assert whole.shape == (2, 8, 3, 8) and whole.df.agg({"x": "max"}).first()[0] == 7
    with pytest.raises(ValueError):
        concat([cube, Cube(cube.df, cube.dims, (2, 4, 4, 8))], "x")


def test_command_line(spark, cube, tmp_path, capsys):
    from cubeloom import cli

    cube.df.write.parquet(f"{tmp_path}/cells")
    cli.run(["convert", "-i", f"{tmp_path}/cells", "-o", f"{tmp_path}/cube", "--shape", "2", "4", "3", "8"], spark)
    cli.run(["query", "-i", f"{tmp_path}/cube", "-o", f"{tmp_path}/out", "--mass-range", "1", "3", "--mass-centre", "CH2", "2", "--scaling", "tic", "--write-txt", "--kdm", "--layers", "0:1"], spark)
    assert spark.read.parquet(f"{tmp_path}/out/images.parquet").count() == 12 and spark.read.parquet(f"{tmp_path}/out/kendrick.parquet").count() == 8
    cli.run(["bulk_query", "-i", f"{tmp_path}/cube", f"{tmp_path}/cube", "-o", f"{tmp_path}/bulk", "--mass-range", "1", "3"], spark)
    cli.run(["slice", "-i", f"{tmp_path}/cube", "-o", f"{tmp_path}/slice", "--axis", "mz", "sum"], spark)
    assert spark.read.parquet(f"{tmp_path}/slice").count() == 24
    for command in (["compound", "H2O"], ["inspect", f"{tmp_path}/cube"], ["nx_density", f"{tmp_path}/cube"]):
        cli.run(command, spark)
    assert "18.01" in capsys.readouterr().out


def test_exports():
    import cubeloom

    assert all(callable(getattr(cubeloom, n)) for n in cubeloom.__all__)
    with pytest.raises(AttributeError):
        cubeloom.nothing
