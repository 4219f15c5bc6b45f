"""Validation rules with exact expected counts.

All row-wise rules of a table are answered by one aggregation.  Only
uniqueness, functional dependency, reference and duplicate checks shuffle.
A null operand is "not checked", never a violation.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import materialise

SEVERITIES = ("error", "warn")
ROW_TYPES = ("not_null", "range", "allowed_values", "regex", "identity", "expression", "min_rows")
SET_TYPES = ("unique", "consistency", "referential", "no_duplicate_rows")
SAMPLES = 5

RESULT = ("rule_id string, table string, type string, severity string, n_checked bigint, "
          "n_violations bigint, expect bigint, status string, detail string, "
          "samples array<string>, error string")


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    severity: str = "error"
    expect_violations: int | None = None
    spec: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.type not in ROW_TYPES + SET_TYPES:
            raise ValueError(f"rule {self.id}: unknown type {self.type!r}")
        if self.severity not in SEVERITIES:
            raise ValueError(f"rule {self.id}: unknown severity {self.severity!r}")

    @property
    def columns(self) -> list[str]:
        named = self.spec.get("columns", self.spec.get("column", []))
        return list(named) if isinstance(named, (list, tuple)) else [named]

    @property
    def dependents(self) -> list[str]:
        dep = self.spec.get("dependent", [])
        return list(dep) if isinstance(dep, (list, tuple)) else [dep]


def parse_rules(config: Mapping[str, Any]) -> list[Rule]:
    """Rules of one table; `min_rows` and `no_duplicate_rows` are table
    properties that become rules."""
    rules = []
    if config.get("min_rows") is not None:
        rules.append(Rule("min_rows", "min_rows", spec={"min_rows": int(config["min_rows"])}))
    if config.get("no_duplicate_rows"):
        rules.append(Rule("no_duplicate_rows", "no_duplicate_rows"))
    for raw in config.get("rules") or []:
        spec = {k: v for k, v in raw.items()
                if k not in ("id", "type", "severity", "expect_violations", "reason")}
        rules.append(Rule(str(raw["id"]), str(raw.get("type")), str(raw.get("severity", "error")),
                          raw.get("expect_violations"), spec))
    return rules


@dataclass(frozen=True)
class _Check:
    """One row-wise rule as aggregates plus the test that marks a bad row."""
    checked: Column
    violations: Column
    detail: Column
    bad: Column | None = None
    sample: Column | None = None


def _as_expr(value: Any) -> Column:
    return value if isinstance(value, Column) else F.expr(str(value))


def _number(value: Any) -> Column:
    return _as_expr(value).try_cast("double")


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _total(counts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, counts)


def _text(c: Column) -> Column:
    return c.cast("string")


def _row_check(rule: Rule, df: DataFrame) -> _Check:
    spec = rule.spec
    rows = F.count(F.lit(1))
    if rule.type == "not_null":
        cols = [F.col(c) for c in rule.columns]
        counts = [F.count_if(c.isNull()) for c in cols]
        told = [F.when(n > 0, F.concat(F.lit(name + "="), _text(n)))
                for name, n in zip(rule.columns, counts)]
        return _Check(rows * len(cols), _total(counts),
                      F.concat(F.lit("nulls: "), F.coalesce(
                          F.nullif(F.concat_ws(", ", *told), F.lit("")), F.lit("none"))),
                      _any([c.isNull() for c in cols]))
    if rule.type == "range":
        lo, hi = spec.get("min"), spec.get("max")
        cols = [_number(F.col(c)) for c in rule.columns]

        def outside(c: Column) -> Column:
            tests = ([c < F.lit(lo)] if lo is not None else []) + (
                [c > F.lit(hi)] if hi is not None else [])
            return F.coalesce(_any(tests or [F.lit(False)]), F.lit(False))

        seen = [F.concat(F.lit(n + " ["), _text(F.min(c)), F.lit(", "), _text(F.max(c)), F.lit("]"))
                for n, c in zip(rule.columns, cols)]
        return _Check(_total([F.count(c) for c in cols]),
                      _total([F.count_if(outside(c)) for c in cols]),
                      F.concat(F.lit(f"min={lo} max={hi}; observed "), F.concat_ws("; ", *seen)),
                      _any([outside(c) for c in cols]),
                      F.coalesce(*[F.when(outside(c), _text(c)) for c in cols]))
    if rule.type == "allowed_values":
        c = _text(F.col(rule.columns[0]))
        allowed = sorted({str(v) for v in spec["values"]})
        unseen = F.array_join(F.sort_array(F.array_except(
            F.array(*[F.lit(v) for v in allowed]),
            F.collect_set(F.when(c.isin(*allowed), c)))), ", ")
        bad = F.coalesce(~c.isin(*allowed), F.lit(False))
        return _Check(F.count(c), F.count_if(bad),
                      F.concat(F.lit(f"{len(allowed)} allowed value(s)"),
                               F.when(unseen != "", F.concat(
                                   F.lit("; declared but never observed: "), unseen)).otherwise("")),
                      bad, c)
    if rule.type == "regex":
        c = _text(F.col(rule.columns[0]))
        bad = F.coalesce(~c.rlike(r"\A(?:" + spec["pattern"] + r")\z"), F.lit(False))
        return _Check(F.count(c), F.count_if(bad), F.lit("pattern " + spec["pattern"]), bad, c)
    if rule.type == "identity":
        lhs, rhs = _number(spec["lhs"]), _number(spec["rhs"])
        gap = F.abs(lhs - rhs)
        tol = float(spec.get("tol_abs", 0) or 0)
        bad = gap > F.lit(tol)
        if spec.get("tol_rel"):
            bad = bad & (gap / F.greatest(F.abs(rhs), F.lit(1e-9)) > F.lit(float(spec["tol_rel"])))
        bad = F.coalesce(bad, F.lit(False))
        return _Check(F.count(gap), F.count_if(bad),
                      F.concat(F.lit(f"{spec['lhs']} == {spec['rhs']} (tol {tol}); max residual "),
                               F.format_string("%.6f", F.coalesce(F.max(gap), F.lit(0.0)))),
                      bad, _text(F.round(gap, 6)))
    if rule.type == "expression":
        test = _as_expr(spec["expr"]).cast("boolean")
        bad = F.coalesce(~test, F.lit(False))
        skipped = rows - F.count(test)
        return _Check(F.count(test), F.count_if(bad),
                      F.concat(F.lit(f"expects {spec['expr']}"),
                               F.when(skipped > 0, F.concat(
                                   F.lit("; "), _text(skipped),
                                   F.lit(" row(s) not evaluable (null operand)"))).otherwise("")),
                      bad, _text(F.col(df.columns[0])))
    floor = int(spec.get("min_rows", 1))
    return _Check(rows, F.when(rows >= floor, 0).otherwise(1),
                  F.concat(_text(rows), F.lit(f" row(s), floor {floor}")))


def _result(rule: Rule, table: str, checked: Column, violations: Column, detail: Column,
            error: str | None = None) -> Column:
    """One result as a struct; a rule that cannot run is always an error."""
    severity = "error" if error else rule.severity
    expect = rule.expect_violations
    passed = F.lit(False) if error else violations == F.lit(0 if expect is None else expect)
    return F.struct(
        F.lit(rule.id).alias("rule_id"), F.lit(table).alias("table"),
        F.lit(rule.type).alias("type"), F.lit(severity).alias("severity"),
        checked.cast("bigint").alias("n_checked"), violations.cast("bigint").alias("n_violations"),
        F.lit(expect).cast("bigint").alias("expect"),
        F.when(passed, "pass").otherwise("FAIL" if severity == "error" else "warn").alias("status"),
        detail.cast("string").alias("detail"),
        F.lit(error).cast("string").alias("error"))


def check_rows(df: DataFrame, table: str, rules: Sequence[Rule], samples: bool = True) -> DataFrame:
    """Every row-wise rule of one table in a single aggregation.

    Samples need one more pass, which keeps at most five values per rule
    before anything is shuffled.
    """
    checks = [(r, _row_check(r, df)) for r in rules]
    out = df.agg(F.array(*[_result(r, table, c.checked, c.violations, c.detail)
                           for r, c in checks]).alias("r")).selectExpr("inline(r)")
    shown = [(r, c) for r, c in checks if c.sample is not None]
    if not (samples and shown):
        return out.withColumn("samples", F.array().cast("array<string>"))
    hits = F.filter(
        F.array(*[F.struct(F.lit(r.id).alias("rule_id"),
                           F.when(c.bad, c.sample).alias("sample")) for r, c in shown]),
        lambda s: s["sample"].isNotNull())
    return out.join(_first_samples(df.select(F.explode(hits).alias("h")).select("h.*")),
                    "rule_id", "left").withColumn(
        "samples", F.coalesce("samples", F.array().cast("array<string>")))


def _first_samples(hits: DataFrame) -> DataFrame:
    """The five smallest samples per rule.

    The rank filter becomes a per-task group limit, so a rule broken by every
    row still sends only five values per task.
    """
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy("sample"))
    return (hits.withColumn("_r", rank).filter(F.col("_r") <= SAMPLES)
            .groupBy("rule_id").agg(F.sort_array(F.collect_list("sample")).alias("samples")))


def _duplicate_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))


def _broken(df: DataFrame, det: str, deps: Sequence[str]) -> DataFrame:
    """One row per determinant value and a flag per dependent.

    More than one value means min <> max, or nulls beside values; neither
    needs a distinct count, so partial aggregates absorb hot groups.
    """
    aggs = []
    for d in deps:
        c = F.col(d)
        aggs.append(((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))))
                    .alias("_bad_" + d))
    flags = df.filter(F.col(det).isNotNull()).groupBy(det).agg(*aggs)
    return flags.select(det, *[F.coalesce("_bad_" + d, F.lit(False)).alias("_bad_" + d)
                               for d in deps])


def _reference_sides(df: DataFrame, rule: Rule,
                     tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame, str]:
    target = str(rule.spec["references"])
    if "." not in target:
        raise ValueError(f"references must be 'table.column', got {target!r}")
    other, ref_col = target.split(".", 1)
    if other not in tables:
        raise KeyError(f"referenced table not available: {other}")
    if ref_col not in tables[other].columns:
        raise KeyError(f"referenced column not available: {target}")

    def values(frame: DataFrame, name: str) -> DataFrame:
        v = _text(F.col(name))
        if rule.spec.get("casefold"):
            v = F.lower(v)
        return frame.select(v.alias("_v")).filter("_v IS NOT NULL").distinct()

    return values(df, rule.columns[0]), values(tables[other], ref_col), target


def check_set(df: DataFrame, table: str, rule: Rule, tables: Mapping[str, DataFrame],
              samples: bool = True) -> DataFrame:
    """A rule that compares rows with each other or with another table."""
    hits = None
    if rule.type in ("unique", "no_duplicate_rows"):
        cols = rule.columns or df.columns
        keys = _duplicate_keys(df, cols)
        rows = F.coalesce(F.sum("_n"), F.lit(0))
        if rule.type == "unique":
            n = F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0))
            told = F.concat(_text(n), F.lit(" row(s) share a key value on " + ", ".join(cols)))
            hits = keys.filter("_n > 1").select(_text(F.col(cols[0])).alias("sample"))
        else:
            n = F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))
            told = F.concat(_text(n), F.lit(" exact duplicate row(s)"))
        out = keys.agg(_result(rule, table, rows, n, told).alias("r"))
    elif rule.type == "consistency":
        det, deps = rule.spec["determinant"], rule.dependents
        flags = _broken(df, det, deps)
        counts = [F.count_if("_bad_" + d) for d in deps]
        told = [F.when(n > 0, F.concat(F.lit(d + "="), _text(n))) for d, n in zip(deps, counts)]
        out = flags.agg(_result(
            rule, table, F.count(F.lit(1)), _total(counts),
            F.concat(F.lit(f"{det} determines {', '.join(deps)}; broken by "), F.coalesce(
                F.nullif(F.concat_ws(", ", *told), F.lit("")), F.lit("none")))).alias("r"))
        hits = flags.filter(_any([F.col("_bad_" + d) for d in deps])).select(
            _text(F.col(det)).alias("sample"))
    else:
        left, right, target = _reference_sides(df, rule, tables)
        joined = left.join(right.withColumn("_found", F.lit(True)), "_v", "left")
        out = joined.agg(_result(
            rule, table, F.count(F.lit(1)), F.count_if(F.col("_found").isNull()),
            F.concat(_text(F.count(F.lit(1))), F.lit(" distinct value(s) checked against " + target))
        ).alias("r"))
        hits = left.join(right, "_v", "left_anti").select(F.col("_v").alias("sample"))
    out = out.select("r.*")
    none = F.array().cast("array<string>")
    if not samples or hits is None:
        return out.withColumn("samples", none)
    first = hits.orderBy("sample").limit(SAMPLES).agg(
        F.sort_array(F.collect_list("sample")).alias("s")).scalar()
    return out.withColumn("samples", F.coalesce(first, none))


def _cannot_run(spark: SparkSession, rule: Rule, table: str, why: str) -> DataFrame:
    zero = F.lit(0)
    return (spark.range(1).select(_result(rule, table, zero, zero, F.lit(""), why).alias("r"))
            .select("r.*").withColumn("samples", F.array().cast("array<string>")))


_ORDER = ("rule_id", "table", "type", "severity", "n_checked", "n_violations", "expect",
          "status", "detail", "samples", "error")


def _why(exc: Exception) -> str:
    java = getattr(exc, "java_exception", None)
    told = str(java) if java is not None else f"{type(exc).__name__}: {exc}"
    return told.splitlines()[0][:200]


def validate_table(df: DataFrame, table: str, rules: Sequence[Rule],
                   tables: Mapping[str, DataFrame] | None = None,
                   samples: bool = True) -> DataFrame:
    """One row per rule.  A rule that cannot be planned, or that fails while it
    runs, is reported and stops no other.

    All rules run as one job, whose few result rows are checkpointed; only when
    that job fails do they run one by one, to find the rule that failed.
    """
    spark = df.sparkSession
    row_rules, alone, frames = [], [], []
    for rule in rules:
        named = rule.columns + rule.dependents + (
            [rule.spec["determinant"]] if "determinant" in rule.spec else [])
        absent = [c for c in named if c not in df.columns]
        if absent:
            frames.append(_cannot_run(spark, rule, table,
                                      "column(s) not in table: " + ", ".join(absent)))
            continue
        try:
            if rule.type in ROW_TYPES:
                df.agg(_row_check(rule, df).violations).schema
                row_rules.append(rule)
            else:
                one = check_set(df, table, rule, tables or {}, samples)
                one.schema
                alone.append((rule, one))
        except (PySparkException, ValueError, KeyError) as exc:
            frames.append(_cannot_run(spark, rule, table, _why(exc)))
    running = [one for _, one in alone]
    if row_rules:
        running.insert(0, check_rows(df, table, row_rules, samples))
    if not running and not frames:
        return spark.createDataFrame([], T.StructType.fromDDL(RESULT))

    def stacked(parts: Sequence[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [f.select(*_ORDER) for f in parts])

    try:
        return materialise(stacked([*running, *frames]))
    except (PySparkException, Py4JJavaError):
        apart = [(r, check_rows(df, table, [r], samples)) for r in row_rules] + alone
    for rule, one in apart:
        try:
            frames.append(materialise(one.select(*_ORDER)))
        except (PySparkException, Py4JJavaError) as exc:
            frames.append(_cannot_run(spark, rule, table, _why(exc)))
    return stacked(frames)


def validate(tables: Mapping[str, DataFrame], config: Mapping[str, Mapping[str, Any]],
             samples: bool = True) -> DataFrame:
    """Every configured rule of every table; an absent table is a failure."""
    spark = (next(iter(tables.values())).sparkSession if tables
             else SparkSession.getActiveSession())
    if spark is None:
        raise ValueError("without tables, validation needs an active session")
    frames = [spark.createDataFrame([], T.StructType.fromDDL(RESULT)).select(*_ORDER)]
    for name, cfg in config.items():
        rules = parse_rules(cfg)
        frames.append(validate_table(tables[name], name, rules, tables, samples)
                      if name in tables else
                      _cannot_run(spark, Rule("missing_table", "min_rows"), name,
                                  "expected table absent").select(*_ORDER))
    return reduce(DataFrame.unionByName, frames)


def verdict(results: DataFrame) -> DataFrame:
    """Counts and PASS / PASS with warnings / FAIL in one row."""
    failed = F.count_if(F.col("status") == "FAIL")
    warned = F.count_if(F.col("status") == "warn")
    return results.agg(
        F.count(F.lit(1)).alias("rules"), F.count_if(F.col("status") == "pass").alias("passed"),
        failed.alias("failed"), warned.alias("warned"),
        F.when(failed > 0, "FAIL").when(warned > 0, "PASS with warnings")
        .otherwise("PASS").alias("verdict"))


def violating_rows(df: DataFrame, rule: Rule,
                   tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Every offending row of a rule."""
    if rule.type in ROW_TYPES:
        bad = _row_check(rule, df).bad
        return df.limit(0) if bad is None else df.filter(bad)
    if rule.type in ("unique", "no_duplicate_rows"):
        cols = rule.columns or df.columns
        keys = _duplicate_keys(df, cols).filter("_n > 1").select(
            *[F.col(c).alias("_k_" + c) for c in cols])
        on = reduce(lambda a, b: a & b, [df[c].eqNullSafe(keys["_k_" + c]) for c in cols])
        return df.join(keys, on, "left_semi")
    if rule.type == "consistency":
        det = rule.spec["determinant"]
        keys = _broken(df, det, rule.dependents).filter(
            _any([F.col("_bad_" + d) for d in rule.dependents])).select(det)
        return df.join(keys, det, "left_semi")
    left, right, _ = _reference_sides(df, rule, tables or {})
    v = _text(F.col(rule.columns[0]))
    v = F.lower(v) if rule.spec.get("casefold") else v
    missing = left.join(right, "_v", "left_anti")
    return df.withColumn("_v", v).join(missing, "_v", "left_semi").drop("_v")


def forbidden_columns(outputs: Mapping[str, DataFrame], names: Sequence[str]) -> DataFrame:
    """One row per output: the personal columns it carries, by name or display
    label, and how many present cells they expose."""
    banned = {re.sub(r"[^a-z0-9]", "", n.lower()) for n in names}
    checks = []
    for key, frame in outputs.items():
        found = sorted(c for c in frame.columns if re.sub(r"[^a-z0-9]", "", c.lower()) in banned)
        cells = _total([F.count(c) for c in found]) if found else F.lit(0)
        one = frame if found else frame.sparkSession.range(1)
        checks.append(one.agg(cells.cast("bigint").alias("exposed_cells")).select(
            F.lit(key).alias("output"), F.lit(len(frame.columns)).alias("n_columns"),
            F.lit(len(found)).alias("n_violations"), F.lit(", ".join(found)).alias("columns"),
            "exposed_cells", F.lit("FAIL" if found else "pass").alias("status")))
    return reduce(DataFrame.unionByName, checks)
