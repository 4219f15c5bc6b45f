"""The publish job: clean, validate, gate, snapshot, document, alert.

Every run leaves its reports beside the data, refused or not.  They are written
first; one row in the folder of runs is written last and is what makes them count.
"""

from __future__ import annotations

import posixpath
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import cleaning as CL
from plumbline.operators import dictionary as DI
from plumbline.operators import validation as VA
from plumbline.operators import versions as VE
from plumbline.sources import files as FI


REPORTS, RUNS = "_reports", "_runs"
KINDS = ("validation", "actions", "dictionary", "alerts")


@dataclass(frozen=True)
class Published:
    version: str | None
    verdict: str
    forced: bool
    results: DataFrame
    dictionary: DataFrame | None
    alerts: DataFrame
    actions: DataFrame
    run: str


def publish(spark: SparkSession, raw: Mapping[str, DataFrame], policies: Mapping[str, CL.Policy],
            rules: Mapping[str, Mapping[str, Any]], work_dir: str, snapshot_dir: str,
            problems: DataFrame | None = None, glossary: DataFrame | None = None,
            thresholds: Mapping[str, Any] | None = None, force: bool = False,
            version: str | None = None) -> Published:
    """A snapshot is written only if validation passed, or with ``force``,
    which is stamped on it.  A refused run still writes its alerts, cleaning
    actions and rule results.

    Each table is cleaned once: later stages read the written clean tables.
    """
    clean, rejects, warnings, actions = {}, [], [], []
    for name, df in raw.items():
        policy = policies[name]
        result = CL.clean_table(df, policy)
        paths = FI.write_clean(result, work_dir, actions=True)
        clean[policy.table] = spark.read.parquet(paths["clean"])
        warnings.append(result.warnings)
        actions.append(spark.read.parquet(paths["actions"]))
        if "rejects" in paths:
            rejects.append(spark.read.parquet(paths["rejects"]))

    results_path = posixpath.join(work_dir, "_validation")
    VA.validate(clean, rules).write.mode("overwrite").parquet(results_path)
    results = spark.read.parquet(results_path)
    verdict = VA.verdict(results).first()["verdict"]

    none = spark.createDataFrame([], "kind string, file string, detail string")
    all_rejects = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in CL.REJECT_FIELDS))
    for r in rejects:
        all_rejects = all_rejects.unionByName(r)
    all_warnings = warnings[0]
    for w in warnings[1:]:
        all_warnings = all_warnings.unionByName(w)
    alerts = [VE.validation_alerts(results),
              VE.cleaning_alerts(problems if problems is not None else none, all_rejects,
                                 all_warnings, thresholds)]

    passed = not verdict.startswith("FAIL")
    written, fields = None, None
    if passed or force:
        before = FI.latest_version(spark, snapshot_dir)
        written = FI.write_snapshot(clean, snapshot_dir, verdict,
                                    "" if passed else "forced past a failed validation", version)
        manifests = FI.read_manifests(spark, snapshot_dir)
        fields = DI.build_dictionary(clean, {p.table: p for p in policies.values()}, glossary, rules)
        if before is None:
            alerts.append(VE.first_snapshot_alert(spark))
        else:
            diff = VE.diff_versions(manifests.filter(F.col("version") == before),
                                    manifests.filter(F.col("version") == written))
            alerts.append(VE.drift_alerts(diff, thresholds))
    run = written or version or FI.new_version_id()
    reports = {"validation": results, "actions": reduce(DataFrame.unionByName, actions),
               "dictionary": fields, "alerts": VE.rank_alerts(*alerts)}
    for kind, frame in reports.items():
        if frame is not None:
            frame.write.mode("overwrite").parquet(_report_path(snapshot_dir, kind, run))
    forced = written is not None and not passed
    spark.createDataFrame([(verdict, written, forced)],
                          "verdict string, version string, forced boolean").coalesce(1).write.mode(
        "errorifexists").parquet(posixpath.join(snapshot_dir, RUNS, f"run={run}"))
    stored = {kind: read_report(spark, snapshot_dir, kind, run)
              for kind, frame in reports.items() if frame is not None}
    return Published(written, verdict, forced, stored["validation"], stored.get("dictionary"),
                     stored["alerts"].orderBy("rank", "id"), stored["actions"], run)


def _report_path(snapshot_dir: str, kind: str, run: str) -> str:
    return posixpath.join(snapshot_dir, REPORTS, kind, f"run={run}")


def list_runs(spark: SparkSession, snapshot_dir: str) -> DataFrame:
    """run, verdict, version (null if refused), forced: one row per finished run."""
    return (spark.read.option("basePath", posixpath.join(snapshot_dir, RUNS))
            .schema("verdict string, version string, forced boolean, run string")
            .parquet(posixpath.join(snapshot_dir, RUNS)))


def read_report(spark: SparkSession, snapshot_dir: str, kind: str, run: str) -> DataFrame:
    """One report of one finished run; files of a run that never finished are not read."""
    if kind not in KINDS:
        raise KeyError(f"reports are {', '.join(KINDS)}")
    if list_runs(spark, snapshot_dir).where(F.col("run") == run).isEmpty():
        raise FileNotFoundError(f"no finished run {run} in {snapshot_dir}")
    return spark.read.parquet(_report_path(snapshot_dir, kind, run))
