"""The commands as a command line: python -m cubeloom <command> --help."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from cubeloom import engine
from cubeloom.cube import Axis, Cube
from cubeloom.functions import chem
from cubeloom.operators import massquery as M
from cubeloom.operators import slicing as S
from cubeloom.sources import readers


def opened(spark: SparkSession, path: str) -> readers.StoredReader:
    """A cube that `convert` has written."""
    return readers.open_stored(spark, path)


def _interval(text: str) -> tuple[int | None, int | None]:
    low, _, high = text.partition(":")
    return (int(low) if low else None, int(high) if high else None)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cubeloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("query", "bulk_query"):
        q = sub.add_parser(name, help="mass images and spectra of stored cubes")
        q.add_argument("-i", "--input", nargs="+" if name == "bulk_query" else 1, required=True)
        q.add_argument("-o", "--output", required=True)
        q.add_argument("--mass-range", nargs=2, type=float, action="append", default=[], metavar=("LOW", "HIGH"))
        q.add_argument("--mass-centre", nargs=2, action="append", default=[], metavar=("MASS_OR_FORMULA", "WIDTH"))
        q.add_argument("--scaling", choices=[n.value for n in M.Norm], default="none")
        q.add_argument("--acc", choices=[a.value for a in M.Accumulator], default="tic")
        q.add_argument("--accumulate-masses", action="store_true")
        q.add_argument("--origin", choices=[o.name.lower() for o in M.Origin], default="top_left")
        q.add_argument("--subpixels", type=float, default=1.0)
        q.add_argument("--interpolation", type=int, choices=range(6), default=0)
        q.add_argument("--write-txt", action="store_true")
        q.add_argument("--kdm", action="store_true")
        for cut in ("layers", "width", "height", "mass"):
            q.add_argument(f"--{cut}", type=_interval, default=(None, None), metavar="FROM:TO")
    s = sub.add_parser("slice", help="sums, maxima or loops over axes")
    s.add_argument("-i", "--input", required=True)
    s.add_argument("-o", "--output", required=True)
    s.add_argument("--default-action", choices=[a.value for a in S.Action], default=S.Action.LEAVE.value)
    s.add_argument("--axis", nargs="+", action="append", default=[], metavar="NAME ACTION [SLICE ...]", help="e.g. mz sum range 1 2.5")
    c = sub.add_parser("convert", help="a table of cells to a stored cube")
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--shape", nargs=4, type=int, required=True)
    c.add_argument("--steps", nargs=4, type=float, default=[1, 1, 1, 1], help="spacing of the labels")
    f = sub.add_parser("compound", help="masses of formulas")
    f.add_argument("formulas", nargs="+")
    for name in ("inspect", "nx_density"):
        d = sub.add_parser(name, help="what is stored")
        d.add_argument("input")
    return p


def spec_of(args: argparse.Namespace, cube: Cube) -> M.QuerySpec:
    spark, mz = cube.df.sparkSession, cube.dims[-1]
    labels = cube.default_axis(mz).labels(cube.size(mz))
    ranges = [M.range_of(labels, a, b) for a, b in args.mass_range]
    if args.mass_centre:
        isotopes = chem.common_isotopes(spark)
        ranges += [M.centre_of(labels, chem.number_or_formula(isotopes, m), float(w), m) for m, w in args.mass_centre]
    return M.QuerySpec(
        tuple(ranges), args.layers, args.width, args.height, args.mass, M.Norm(args.scaling), M.Accumulator(args.acc), args.accumulate_masses,
        M.Origin[args.origin.upper()], args.subpixels, args.interpolation,
    )


def run(argv: list[str], spark: SparkSession) -> None:
    args = parser().parse_args(argv)
    if args.command in ("query", "bulk_query"):
        for path in args.input:
            reader = opened(spark, path)
            cube = reader.cube()
            result = engine.query(reader, spec_of(args, cube))
            folder = args.output if len(args.input) == 1 else f"{args.output}/{path.rstrip('/').rsplit('/', 1)[-1]}"
            for name in ("images", "spectra", "total_image", "total_spectrum", "accumulated"):
                if (df := getattr(result, name)) is not None:
                    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
            if args.write_txt:
                engine.export(result, cube, f"{folder}/txt")
            if args.kdm:
                engine.kendrick(result, cube).write.mode("overwrite").parquet(f"{folder}/kendrick.parquet")
    elif args.command == "slice":
        cube = opened(spark, args.input).cube()
        axes = tuple(S.AxisSpec(name, S.Action(action), *([S.parse_slice(rest)] if rest else [])) for name, action, *rest in args.axis)
        group = S.GroupSpec("slice", ("signal",), axes=axes, default_action=S.Action(args.default_action))
        engine.slice({"signal": cube}, {"slice": group})["slice"].write.mode("overwrite").parquet(args.output)
    elif args.command == "convert":
        dims = ("layer", "x", "y", "mz")
        axes = tuple(Axis(d, d, 0, step) for d, step in zip(dims, args.steps))
        engine.convert(Cube(spark.read.parquet(args.input), dims, tuple(args.shape), axes=axes), args.output)
    elif args.command == "compound":
        engine.compound(spark, args.formulas).show(truncate=False)
    elif args.command == "inspect":
        engine.inspect(spark, args.input).show(1000, truncate=False)
    else:
        engine.density(opened(spark, args.input)).show(truncate=False)


def main() -> None:
    run(sys.argv[1:], SparkSession.builder.appName("cubeloom").getOrCreate())
