"""Command line: analyse a board archive and write its reports.

Exit codes: 0 done, 1 the board can't be analysed, 2 blocked by open critical
reviews, 3 invalid rules, 4 conflicts between revisions, 5 import refused.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.layers import layer_key
from .geometry.air_gap import effective_gaps
from .geometry.compositing import composited_pairs, net_polygons
from .geometry.shapes import with_shapes
from .operators import assignments as asg
from .operators import measurements as mea
from .operators import requirements as req
from .operators import rules as rul
from .operators.revision_match import match_revisions
from .operators.vias import via_pads
from .session import cut_lineage
from .settings import Settings, read_profile, write_profile
from .sinks import reports
from .sources import assignment_files, board_archive
from .vocabulary import MATCH_TYPES, NET_CLASSES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkgap", description=__doc__)
    p.add_argument("board", help="folder of board archives, or an unpacked board")
    p.add_argument("--output", default="reports")
    p.add_argument("--profile", help="settings profile to start from")
    p.add_argument("--within-mm", type=float, help="measure only pairs below this distance (default: every pair of nets of a layer)")
    p.add_argument("--threshold-mm", type=float)
    p.add_argument("--effective-gap", action="store_true", help="also report how much of the line between each pair is free of other copper")
    p.add_argument("--rules", help="folder of a rule pack instead of the built-in one")
    p.add_argument("--local-rules", help="folder of a project's own rules")
    p.add_argument("--import-assignments", help="assignments of an older revision, JSON or CSV")
    p.add_argument("--gate", choices=("allow", "warn", "block"), default="warn")
    return p


def stack_roles(layers: DataFrame) -> DataFrame:
    """(job_id, layer, layer_role) of every copper layer, from its name and its place in the archive's stack-up."""
    stack = board_archive.signal_layers(layers).groupBy("job_id", layer_key(F.col("layer")).alias("layer")).agg(F.min("ordinal").alias("ordinal"))
    return mea.layer_roles(stack, "job_id", "layer", "ordinal")


def copper_and_vias(features: DataFrame, layers: DataFrame, settings: Settings) -> DataFrame:
    """Features of the copper layers with shapes, and the pads of plated vias on every layer they join."""
    placed = with_shapes(features.withColumn("layer", layer_key(F.col("layer"))))
    copper = layers.filter(F.col("ordinal").isNotNull()).select("job_id", layer_key(F.col("layer")).alias("layer")).distinct()
    drilled = placed.join(copper, ["job_id", "layer"], "left_anti")
    both = placed.join(copper, ["job_id", "layer"], "left_semi").unionByName(via_pads(drilled, layers))
    return both.filter(F.col("layer").isin(*[name.strip().upper() for name in settings.layers])) if settings.layers else both


def measure(features: DataFrame, layers: DataFrame, settings: Settings, within_mm: float | None) -> DataFrame:
    """Measured pairs of boards with both voltages; without `within_mm` every pair of nets of a layer."""
    pairs = composited_pairs(copper_and_vias(features, layers, settings), within_mm, ["job_id", "layer"], include_no_net=settings.include_none_net)
    return with_voltages(pairs, layers, settings)


def with_voltages(pairs: DataFrame, layers: DataFrame, settings: Settings) -> DataFrame:
    return mea.recomputed_voltages(
        pairs, roles=stack_roles(layers), cti=settings.cti, pollution=settings.pollution_degree, altitude_m=settings.altitude_m, particle_mm=settings.metallic_particle_size_mm, coated=settings.external_conformal_coating
    )


def air_gaps(features: DataFrame, layers: DataFrame, settings: Settings, measured: DataFrame) -> DataFrame:
    """The effective air gap of every measured pair, with both voltages by that gap."""
    scope = ["job_id", "layer"]
    nets = cut_lineage(net_polygons(copper_and_vias(features, layers, settings), scope, include_no_net=settings.include_none_net))
    gaps = effective_gaps(measured, nets, scope).withColumn("clearance_mm", F.col("effective_air_gap_mm"))
    return with_voltages(gaps, layers, settings).drop("clearance_mm", "layer_role")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    pack = rul.read_pack(args.rules) if args.rules else rul.builtin_pack()
    if args.local_rules:
        pack = rul.with_local_rules(pack, args.local_rules)
    if problems := rul.pack_problems(pack, NET_CLASSES, MATCH_TYPES):
        print("\n".join(problems), file=sys.stderr)
        return 3
    if spark is None:
        from .session import build_session

        spark = build_session("sparkgap")
    settings = read_profile(args.profile) if args.profile else Settings()
    threshold = settings.threshold_mm if args.threshold_mm is None else args.threshold_mm
    try:
        if os.path.isfile(os.path.join(args.board, "matrix", "matrix")):
            layers, features = board_archive.read_folder(spark, args.board)
        else:
            layers, features = board_archive.read_boards(spark, args.board, "layers"), board_archive.read_boards(spark, args.board)
        measured = measure(features, layers, settings, args.within_mm).persist()
        if not features.filter("layer is not null").limit(1).count():
            raise board_archive.ArchiveError("no features")
    except (board_archive.ArchiveError, OSError, AnalysisException) as error:
        print(error, file=sys.stderr)
        return 1
    nets = mea.all_nets((features, "net_name"))
    assigned = rul.classify_names(nets, pack)
    code = 0
    if args.import_assignments:
        try:
            reader = assignment_files.read_csv if args.import_assignments.endswith(".csv") else assignment_files.read_json
            old = reader(spark, args.import_assignments).filter("problem is null")
            if not old.limit(1).count():
                raise assignment_files.ImportRejected("no usable assignments")
        except assignment_files.ImportRejected as error:
            print(error, file=sys.stderr)
            return 5
        matches = match_revisions(old, nets, pack).persist()
        taken = matches.filter("match_status in ('exact', 'case_insensitive', 'normalized')").select("old_net", F.col("new_net").alias("net_name"), "match_status")
        values = ("final_class", "final_voltage_v", "review_state", "severity", "confidence")
        carried = taken.join(old.select(F.col("net_name").alias("old_net"), *values, "galvanic_zone"), "old_net").withColumn("source", F.concat(F.lit("imported_"), F.col("match_status"))).drop("old_net", "match_status")
        assigned = asg.merge_detected(carried.drop("galvanic_zone"), assigned.select("net_name", *values, "source"), ["net_name"], values).drop("changed").join(carried.select("net_name", "galvanic_zone"), "net_name", "left")
        code = 4 if matches.filter("match_status = 'conflict'").limit(1).count() else 0
    if "galvanic_zone" not in assigned.columns:
        assigned = assigned.withColumn("galvanic_zone", F.lit(None).cast("string"))
    assigned = assigned.persist()
    voltages = req.zone_voltages(settings.galvanic_zone_matrix, settings.galvanic_zone_voltage_v)
    required = req.with_compliance(req.pair_requirements(measured, assigned, voltages, zones_enabled=settings.galvanic_zones_enabled))
    folder = reports.run_folder(args.output)
    write_profile(settings, os.path.join(folder, "analysis_settings.json"))
    gate = asg.review_counts(assigned).first()
    tables = {"measurements": required, "assignments": assigned.drop("all_matched_rule_ids"), "zone_spacing": req.zone_spacing(required)}
    if args.effective_gap:
        tables["effective_gaps"] = air_gaps(features, layers, settings, measured)
    tables["per_net_minimum"] = mea.per_net_minimum(measured, ["job_id"])
    reports.write_reports(tables, folder, threshold_mm=threshold, facts={"nets to review": gate.needs_review, "open critical": gate.unreviewed_critical})
    print(folder)
    return 2 if args.gate == "block" and gate.unreviewed_critical else code


if __name__ == "__main__":
    raise SystemExit(main())
