"""Command line: run, area, from-partitions."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
import time

from pyspark.sql import SparkSession

from .functions.sectors import sheet_of
from .operators.density import ClusteringConfig
from .operators.surface import SurfaceConfig
from .plans.runs import ContinueConfig, EngineConfig, run_engine, run_from_partitions
from .sources.area import area_boundary, area_points, load_area


def _economy(p: argparse.ArgumentParser) -> None:
    p.add_argument("--output-dir")
    p.add_argument("--classification", choices=("io16", "io80"), default="io80")
    p.add_argument("--transactions")
    p.add_argument("--transactions-sheet", default="0")
    p.add_argument("--technical-coefficients")
    p.add_argument("--technical-coefficients-sheet", default="0")
    p.add_argument("--io-data", help="folder of packaged tables")
    p.add_argument("--roads", required=True)
    p.add_argument("--roads-layer")
    p.add_argument("--mwas-method", choices=("fast", "exact"), default="fast")
    p.add_argument("--vertex-digits", type=int, default=11)
    p.add_argument("--centrality-direction", choices=("incoming", "outgoing"), default="incoming", help="accepted; changes nothing")
    p.add_argument("--distance-tempering", type=float, default=0.15)
    p.add_argument("--progress", action=argparse.BooleanOptionalAction, default=True)


def _spatial(p: argparse.ArgumentParser) -> None:
    p.add_argument("--min-cluster-size", type=int, default=5)
    p.add_argument("--min-samples", type=int)
    p.add_argument("--cluster-selection-method", choices=("eom", "leaf"), default="eom")
    p.add_argument("--allow-single-cluster", action="store_true")
    p.add_argument("--hdbscan-max-distance", type=float, default=5000.0)
    p.add_argument("--hdbscan-distance-mode", choices=("adaptive", "fixed"), default="adaptive")
    p.add_argument("--hdbscan-min-distance", type=float)
    p.add_argument("--hdbscan-max-neighbor-pairs", type=int, default=20_000_000)
    p.add_argument("--max-snap-distance", type=float)
    p.add_argument("--voronoi-resolution", type=float, default=500.0)
    p.add_argument("--voronoi-max-cells", type=int, default=1_000_000)
    p.add_argument("--voronoi-refine-factor", type=float, default=0.5)
    p.add_argument("--voronoi-max-refinements", type=int, default=5)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="waylattice", description="Scores of classified points by roads and economy")
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="the whole workflow")
    run.add_argument("--points", required=True)
    run.add_argument("--boundary", required=True)
    run.add_argument("--boundary-layer")
    run.add_argument("--io80-column")
    run.add_argument("--io16-column")
    area = commands.add_parser("area", help="the whole workflow for an area of a catalog")
    area.add_argument("area")
    area.add_argument("--areas-file", required=True)
    area.add_argument("--points-root", required=True, help="folder of a producer's output, by area")
    area.add_argument("--producer", help="command that makes an area's points; it gets the slug and the folder")
    area.add_argument("--refresh", action="store_true")
    again = commands.add_parser("from-partitions", help="from saved territories on")
    again.add_argument("--partitions", required=True)
    again.add_argument("--centers")
    again.add_argument("--points-with-center-distance")
    for p in (run, area, again):
        _economy(p)
    for p in (run, area):
        _spatial(p)
    return out


def progress(on: bool):
    start = time.monotonic()

    def say(message: str) -> None:
        s = int(time.monotonic() - start)
        print(f"[{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}] {message}", file=sys.stderr, flush=True)

    return say if on else None


def _configs(a: argparse.Namespace) -> dict:
    return {
        "roads_path": a.roads, "roads_layer": a.roads_layer, "output_dir": a.output_dir or "output", "classification": a.classification, "transactions_path": a.transactions, "transactions_sheet": sheet_of(a.transactions_sheet),
        "technical_coefficients_path": a.technical_coefficients, "technical_coefficients_sheet": sheet_of(a.technical_coefficients_sheet), "io_data": a.io_data, "mwas_method": a.mwas_method, "vertex_digits": a.vertex_digits,
        "centrality_direction": a.centrality_direction, "distance_tempering": a.distance_tempering, "progress": progress(a.progress),
    }


def _space(a: argparse.Namespace) -> dict:
    return {
        "clustering": ClusteringConfig(a.min_cluster_size, a.min_samples, a.cluster_selection_method, a.allow_single_cluster, a.hdbscan_max_distance, a.hdbscan_distance_mode, a.hdbscan_min_distance, max_pairs=a.hdbscan_max_neighbor_pairs),
        "surface": SurfaceConfig(a.voronoi_resolution, a.voronoi_max_cells, a.voronoi_refine_factor, a.voronoi_max_refinements), "max_snap_distance": a.max_snap_distance,
    }


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        spark = spark or SparkSession.builder.appName("waylattice").getOrCreate()
        if a.command == "run":
            result = run_engine(spark, EngineConfig(points_path=a.points, boundary_path=a.boundary, boundary_layer=a.boundary_layer, classification_column=a.io80_column if a.classification == "io80" else a.io16_column, **_configs(a), **_space(a)))
        elif a.command == "area":
            area = load_area(a.area, a.areas_file)
            config = _configs(a) | {"output_dir": a.output_dir or os.path.join("output", area.slug)}
            os.makedirs(config["output_dir"], exist_ok=True)
            produce = (lambda x, folder: subprocess.run([*a.producer.split(), x.slug, folder], check=True)) if a.producer else None
            points, _ = area_points(spark, area, a.points_root, a.classification, produce, a.refresh)
            boundary = area_boundary(spark, area, os.path.join(config["output_dir"], "boundary.gpkg"))
            result = run_engine(spark, EngineConfig(points_path=points, boundary_path=boundary, area_slug=area.slug, area_name=area.name, **config, **_space(a)))
        else:
            result = run_from_partitions(spark, ContinueConfig(partitions_path=a.partitions, centers_path=a.centers, points_path=a.points_with_center_distance, **_configs(a)))
    except (FileNotFoundError, ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    for name, path in result.output_paths.items():
        print(f"{name}: {path}")
    return 0
