"""Policy-driven cleaning.

A present cell that does not fit its declared type is quarantined and becomes
null; its row stays.  Every step counts what it changed.  The plan is lazy:
normalise -> repair rows -> map values -> drop -> de-duplicate -> type and
transform -> null policy -> derive -> order.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import dates
from plumbline.functions import numbers as N
from plumbline.functions import text as X
from plumbline.operators.quantiles import median
from plumbline.session import materialise

# --- fixed values -----------------------------------------------------------
TRUE_TOKENS = ("1", "true", "t", "yes", "y")
FALSE_TOKENS = ("0", "false", "f", "no", "n")
DEFAULTS = {
    "trim_whitespace": True,
    "collapse_internal_spaces": True,
    "sentinel_nulls_to_null": True,
    "money_dp": 2,
    "ratio_dp": 6,
    "coordinate_dp": 6,
}
NUMBER_TYPES = ("money", "ratio", "coordinate", "float")
TRANSFORMS = ("zero_pad", "upper", "lower", "title")
NULL_STRATEGIES = ("keep_null", "not_applicable", "impute_constant", "impute_median",
                   "impute_mode", "impute_zero", "drop_row")
REJECT_FIELDS = ("table", "row_key", "column", "source_column", "declared_type",
                 "raw_value", "reason")
# --- end of fixed values ----------------------------------------------------

# Larger mappings are joined instead of inlined.
INLINE_MAP = 64
# More hashes of repeated rows are not sent to every task.
FEW_HASHES = 500_000


@dataclass(frozen=True)
class ColumnRule:
    source: str
    clean: str
    type: str = "text"
    nulls: str = "keep_null"
    fill: Any = None
    transform: str | None = None
    width: int | None = None
    role: str | None = None
    description: str | None = None
    reason: str | None = None

    def __post_init__(self) -> None:
        if self.nulls not in NULL_STRATEGIES:
            raise ValueError(f"{self.clean}: unknown nulls strategy {self.nulls!r}")
        if self.transform and self.transform not in TRANSFORMS:
            raise ValueError(f"{self.clean}: unknown transform {self.transform!r}")
        if self.transform == "zero_pad" and (self.width or 0) <= 0:
            raise ValueError(f"{self.clean}: zero_pad needs a positive width")


@dataclass(frozen=True)
class DerivedRule:
    """A computed column: SQL text or a Column; ``row_number`` mints a key."""
    name: str
    type: str
    expr: Any
    null_when: Any = None
    reason: str | None = None


@dataclass(frozen=True)
class RowFix:
    id: str
    where: str
    columns: tuple[str, ...]
    do: str = "shift_right"


@dataclass(frozen=True)
class Policy:
    """How one source is cleaned.  ``order`` names the ingest-order columns
    that 'first occurrence' and minted keys refer to."""
    table: str
    columns: tuple[ColumnRule, ...]
    key_columns: tuple[str, ...] = ()
    date_formats: tuple[str, ...] = ("%Y-%m-%d",)
    row_fixes: tuple[RowFix, ...] = ()
    value_maps: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    drop: Mapping[str, str] = field(default_factory=dict)
    derived: tuple[DerivedRule, ...] = ()
    deduplicate: str | None = None
    dedupe_columns: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    encoding: str | None = None
    row_count_expected: int | None = None
    grain: str | None = None
    defaults: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for fmt in self.date_formats:
            dates.compile_format(fmt)
        if self.deduplicate not in (None, "exact_rows", "subset"):
            raise ValueError(f"unsupported deduplicate strategy {self.deduplicate!r}")

    def setting(self, name: str) -> Any:
        return {**DEFAULTS, **self.defaults}[name]

    def source_of(self, name: str, present: Sequence[str]) -> str:
        """A rule may use the clean name of a column the frame has by source name."""
        if name in present:
            return name
        for r in self.columns:
            if r.clean == name:
                return r.source
        raise KeyError(f"policy for {self.table} refers to unknown column {name!r}")


def policy_from_dict(key: str, spec: Mapping[str, Any],
                     defaults: Mapping[str, Any] | None = None) -> Policy:
    """Policy from a parsed YAML or JSON mapping."""
    dedupe = spec.get("deduplicate") or {}
    return Policy(
        table=spec.get("table", key),
        columns=tuple(ColumnRule(**{k: v for k, v in c.items() if k in _COLUMN_KEYS})
                      for c in spec.get("columns") or []),
        key_columns=tuple(spec.get("key") or ()),
        date_formats=tuple(spec.get("date_formats") or ("%Y-%m-%d",)),
        row_fixes=tuple(RowFix(f.get("id", "row_fix"), f["where"], tuple(f.get("columns", ())),
                               f.get("do", "")) for f in spec.get("row_fixes") or []),
        value_maps={k: {str(a): b for a, b in v.items()}
                    for k, v in (spec.get("value_maps") or {}).items()},
        drop={d["source"]: d.get("reason", "") for d in spec.get("drop") or []},
        derived=tuple(DerivedRule(d["name"], d.get("type", "text"), d["expr"],
                                  d.get("null_when"), d.get("reason"))
                      for d in spec.get("derived") or []),
        deduplicate=dedupe.get("strategy", "exact_rows") if dedupe else None,
        dedupe_columns=tuple(dedupe.get("columns") or ()),
        order=tuple(spec.get("order") or ()),
        encoding=spec.get("encoding"),
        row_count_expected=spec.get("row_count_expected"),
        grain=spec.get("grain"),
        defaults=dict(defaults or {}),
    )


_COLUMN_KEYS = set(ColumnRule.__dataclass_fields__)


# --- text normalisation -----------------------------------------------------

def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _normal_stages(df: DataFrame, columns: Sequence[str], trim: bool = True,
                   collapse: bool = True, sentinels: bool = True) -> DataFrame:
    """Normalise in separate projections, so each expression runs once per cell.

    ``_r_``, ``_s_`` and ``_t_`` columns hold the raw, trimmed and collapsed
    text for the counters; a reader that does not use them never computes them.
    """
    words = ", ".join("'" + w + "'" for w in X.POLICY_SENTINELS)

    def present(name: str) -> str:
        return (f"CASE WHEN lower(`{name}`) NOT IN ({words}) THEN `{name}` END"
                if sentinels else f"`{name}`")

    out = df.withColumns({"_r_" + c: _q(c) for c in columns})
    out = out.withColumns({"_s_" + c: X.strip(_q(c)) if trim else _q(c) for c in columns})
    if trim and collapse:
        out = out.withColumns({c: X.tidy(_q(c)) for c in columns})
    else:
        out = out.withColumns({c: X.collapse(_q("_s_" + c)) if collapse else _q("_s_" + c)
                               for c in columns})
    return out.withColumns({"_t_" + c: _q(c) for c in columns}).withColumns(
        {c: F.expr(present("_t_" + c)) for c in columns})


def _normal_counters(c: str) -> list[Column]:
    raw, trimmed, text = _q("_r_" + c), _q("_s_" + c), _q("_t_" + c)
    return [
        _counter("trim_whitespace", c, F.count_if(trimmed != raw)),
        _counter("collapse_spaces", c, F.count_if(text != trimmed)),
        _counter("sentinel_null", c, F.count_if(text.isNotNull() & _q(c).isNull())),
    ]


def normalise_text(df: DataFrame, trim: bool = True, collapse: bool = True,
                   sentinels: bool = True) -> DataFrame:
    """Trim, collapse inner whitespace, turn policy sentinels into null."""
    out = _normal_stages(df, _texts(df), trim, collapse, sentinels)
    return out.select(*[_q(c) for c in df.columns])


def normalise_counts(df: DataFrame) -> DataFrame:
    """Cells changed per column by each normalisation step, in one pass."""
    texts = _texts(df)
    rows = [r for c in texts for r in _normal_counters(c)]
    return _unroll(_normal_stages(df, texts), rows).groupBy("column").pivot(
        "step", ["trim_whitespace", "collapse_spaces", "sentinel_null"]).agg(F.first("n"))


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _counter(step: str, column: str, n: Column) -> Column:
    return F.struct(F.lit(step).alias("step"), F.lit(column).alias("column"),
                    n.cast("bigint").alias("n"))


class _Marks:
    """What the steps did to each row, as flags packed into whole numbers.

    Rows are counted by pattern of flags, so that no row passes through one sum
    for every step and column; the sums are taken over the patterns.
    """

    FLAGS, ENTRIES = 4, 15

    def __init__(self, prefix: str = "_k_") -> None:
        self.prefix = prefix
        self.entries: list[list[tuple[str, str]]] = []

    def add(self, df: DataFrame, flags: Column, *steps: tuple[str, str]) -> DataFrame:
        """Keep ``flags``, whose lowest bit stands for the first of ``steps``."""
        self.entries.append(list(steps))
        return df.withColumn(f"_f_{len(self.entries) - 1}", flags.cast("bigint"))

    def packed(self) -> list[Column]:
        at = range(len(self.entries))
        return [reduce(lambda a, b: a.bitwiseOR(b), [
            F.shiftleft(F.col(f"_f_{i}"), self.FLAGS * (i - k)) for i in at[k:k + self.ENTRIES]])
            .alias(name) for k, name in zip(at[::self.ENTRIES], self.names)]

    @property
    def names(self) -> list[str]:
        return [f"{self.prefix}{k}" for k in range(-(-len(self.entries) // self.ENTRIES))]

    def counted(self, packed: DataFrame, total: str, *more: Column) -> DataFrame:
        """step, column, n from the columns of ``packed()``; ``total`` counts all rows."""
        names = self.names
        n = F.count(F.lit(1)).alias("_n")
        patterns = packed.groupBy(*names).agg(n) if names else packed.agg(n).filter("_n > 0")

        def rows(i: int, bit: int) -> Column:
            word, place = names[i // self.ENTRIES], i % self.ENTRIES * self.FLAGS + bit
            return F.sum(F.when(F.col(word).bitwiseAND(F.lit(1 << place)) != 0, F.col("_n")))

        zero = F.lit(0)
        return _unroll(patterns, [
            _counter(total, "<table>", F.coalesce(F.sum("_n"), zero)),
            *[_counter(step, column, F.coalesce(rows(i, bit), zero))
              for i, steps in enumerate(self.entries) for bit, (step, column) in enumerate(steps)],
            *more])


def _flags(*tests: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)])


def _unroll(df: DataFrame, counters: Sequence[Column]) -> DataFrame:
    return df.agg(F.array(*counters).alias("a")).selectExpr("inline(a)")


# --- row repairs and vocabularies -------------------------------------------

def condition(where: str, resolve) -> Column:
    """`X is blank` and `X matches P` clauses joined by `and`."""
    tests = []
    for clause in re.split(r"\s+and\s+", where.strip(), flags=re.IGNORECASE):
        blank = re.fullmatch(r"([\w ]+?)\s+is\s+blank", clause.strip(), re.IGNORECASE)
        match = re.fullmatch(r"([\w ]+?)\s+matches\s+(.+)", clause.strip(), re.IGNORECASE)
        if blank:
            c = resolve(blank[1].strip())
            tests.append(c.isNull() | (X.strip(c) == ""))
        elif match:
            c = resolve(match[1].strip())
            pattern = match[2].strip().strip("'\"")
            tests.append(F.coalesce(c.rlike(r"\A(?:" + pattern + r")\z"), F.lit(False)))
        else:
            raise ValueError(f"unsupported row_fix condition: {clause!r}")
    return reduce(lambda a, b: a & b, tests)


def shift_right(df: DataFrame, where: str, columns: Sequence[str]) -> DataFrame:
    """On matching rows values move one column to the right; the first is null."""
    return _shift(df.withColumn("_hit", condition(where, _q)), "_hit", columns).drop("_hit")


def _shift(df: DataFrame, hit: str, names: Sequence[str]) -> DataFrame:
    moved = {names[0]: F.when(~_q(hit), _q(names[0]))}
    for left, here in zip(names, names[1:]):
        moved[here] = F.when(_q(hit), _q(left)).otherwise(_q(here))
    return df.withColumns(moved)


def _chained(mapping: Mapping[str, str]) -> dict[str, str]:
    """Entries apply in order, so a->b then b->c sends a to c."""
    final = {}
    for start in mapping:
        value = start
        for old, new in mapping.items():
            if value == old:
                value = new
        final[start] = value
    return final


def mapped(c: Column, mapping: Mapping[str, str]) -> Column:
    final = _chained({str(k): str(v) for k, v in mapping.items()})
    pairs = [F.lit(x) for kv in final.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], c) if pairs else c


def map_values(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Exact remap of a column's own values."""
    if len(mapping) <= INLINE_MAP:
        return df.withColumn(column, mapped(F.col(column), mapping))
    rows = df.sparkSession.createDataFrame(
        list(_chained({str(k): str(v) for k, v in mapping.items()}).items()),
        "_old string, _new string")
    return (df.join(rows, F.col(column) == F.col("_old"), "left")
            .withColumn(column, F.coalesce("_new", column)).drop("_old", "_new"))


def map_values_by(df: DataFrame, column: str, driver: str,
                  mapping: Mapping[str, str]) -> DataFrame:
    """Rewrite a column where another column holds a mapped key."""
    return df.withColumn(column, _mapped_by(F.col(column), F.col(driver), mapping))


def _mapped_by(c: Column, driver: Column, mapping: Mapping[str, str]) -> Column:
    pairs = [F.lit(str(x)) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[X.strip(driver.cast("string"))], c)


# --- duplicates and keys ----------------------------------------------------

def dedupe_exact(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per distinct row; ``order`` columns are kept from the first."""
    if not order:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c not in order]
    return (df.groupBy(*[F.col(f"`{c}`") for c in rest])
            .agg(F.min(F.struct(*order)).alias("_first"))
            .select(*[F.col(f"`{c}`") for c in rest],
                    *[F.col("_first")[c].alias(c) for c in order])
            .select(*[F.col(f"`{c}`") for c in df.columns]))


def dedupe_subset(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First occurrence by ``order``.  The rank filter is applied per task
    before the shuffle, so a hot key sends one row per task."""
    if not order:
        raise ValueError("'first occurrence' needs order columns")
    rank = F.row_number().over(Window.partitionBy(*[F.col(f"`{c}`") for c in columns])
                               .orderBy(*[F.asc_nulls_last(c) for c in order]))
    return df.withColumn("_rn", rank).filter("_rn = 1").drop("_rn")


def surrogate_key(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Dense 1..n in the given order, without a single-task window.

    Rows are range-partitioned and numbered inside their partition; the
    partition sizes give the offsets.  The numbered rows are written once,
    since both steps must see the same partitioning.  Rows that tie in the
    order are ranged by a hash of all they hold, and equal rows by their place
    in the input, so one value that many rows share fills many partitions.
    """
    everything = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    keys = [*[F.asc_nulls_last(c) for c in order], everything, F.monotonically_increasing_id()]
    numbered = materialise(
        df.withColumns({"_tie": keys[-2], "_place": keys[-1]})
        .repartitionByRange(*keys[:-2], "_tie", "_place")
        .sortWithinPartitions(*keys[:-2], "_tie", "_place").drop("_tie", "_place")
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id()
                    - F.shiftleft(F.col("_pid").cast("bigint"), 33)))
    sizes = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    return (numbered.join(offsets, "_pid")
            .withColumn(name, F.col("_off") + F.col("_at") + 1).drop("_pid", "_at", "_off"))


# --- typing -----------------------------------------------------------------

def coerce_integer(c: Column) -> Column:
    return F.when(c.rlike(N.CLEAN_INTEGER), c.try_cast("bigint"))


def coerce_number(c: Column, places: int | None = None) -> Column:
    v = N.parse_double(c)
    if places is None:
        return v
    # With 15 digits at most and no more places than are kept, the double is rounded already;
    # adding zero takes the sign off a zero, as rounding does.
    short = r"\A[+-]?\d{1,%d}(?:\.\d{1,%d})?\z" % (15 - places, places)
    if not 0 < places < 15:
        return F.bround(v, places)
    return F.when(c.rlike(short), c.try_cast("double") + F.lit(0.0)).otherwise(F.bround(v, places))


def coerce_boolean(c: Column) -> Column:
    folded = F.lower(c)
    return F.when(folded.isin(*TRUE_TOKENS), True).when(folded.isin(*FALSE_TOKENS), False)


def coerce_datetime(c: Column, formats: Sequence[str]) -> Column:
    return dates.parse_first(c, formats)


def coerced(c: Column, rule: ColumnRule, policy: Policy) -> Column:
    if rule.type == "integer":
        return coerce_integer(c)
    if rule.type in NUMBER_TYPES:
        places = None if rule.type == "float" else int(policy.setting(rule.type + "_dp"))
        return coerce_number(c, places)
    if rule.type == "datetime":
        return coerce_datetime(c, policy.date_formats)
    if rule.type == "boolean":
        return coerce_boolean(c)
    return c


def zero_pad(c: Column, width: int) -> Column:
    """Left-pad with zeros after any sign; a longer value is an error."""
    text = c.cast("string")
    signed = text.startswith("+") | text.startswith("-")
    padded = F.concat(F.substring(text, 1, 1), F.lpad(
        F.substring(text, F.lit(2), F.length(text)), width - 1, "0"))
    return F.when(F.length(text) > width, F.raise_error(F.concat(
        F.lit("value longer than zero_pad width: "), text))).when(signed, padded).otherwise(
        F.lpad(text, width, "0"))


def transformed(c: Column, rule: ColumnRule) -> Column:
    if rule.transform == "zero_pad":
        return zero_pad(c, int(rule.width))
    text = c.cast("string")
    return {"upper": F.upper, "lower": F.lower, "title": X.title_case}[rule.transform](text)


def _typed_stage(df: DataFrame, policy: Policy) -> tuple[DataFrame, list[ColumnRule]]:
    """Typed values as ``_v_`` and transformed ones as ``_x_`` columns beside
    the text they came from, each computed once."""
    rules = [r for r in policy.columns if r.source in df.columns]
    out = df.withColumns({"_v_" + r.clean: coerced(_q(r.source).cast("string"), r, policy)
                          for r in rules})
    return out.withColumns({
        "_x_" + r.clean: transformed(_q("_v_" + r.clean), r) if r.transform
        else _q("_v_" + r.clean) for r in rules}), rules


def _rejected(r: ColumnRule) -> Column:
    return _q(r.source).isNotNull() & _q("_v_" + r.clean).isNull()


def quarantine_cells(df: DataFrame, policy: Policy, marks: _Marks | None = None,
                     carried: Sequence[str] = ()) -> DataFrame:
    """Typed columns beside ``_rejects``, the array of cells that did not fit;
    with ``marks`` also the packed flags of what typing did."""
    staged, rules = _typed_stage(df, policy)
    if marks is not None:
        staged = _type_marks(staged, rules, marks)
    keys = [r.source for r in rules if r.clean in policy.key_columns]
    row_key = (_q(keys[0]) if keys else _q(policy.order[0]) if policy.order
               else F.lit(None)).cast("string")
    bad = [F.when(_rejected(r), F.struct(
        F.lit(policy.table).alias("table"), row_key.alias("row_key"),
        F.lit(r.clean).alias("column"), F.lit(r.source).alias("source_column"),
        F.lit(r.type).alias("declared_type"), _q(r.source).cast("string").alias("raw_value"),
        F.lit("does not match declared type " + r.type).alias("reason")))
        for r in rules if r.type in ("integer", "datetime", "boolean", *NUMBER_TYPES)]
    rejects = F.array().cast("array<struct<" + ",".join(f"`{f}`:string" for f in REJECT_FIELDS)
                             + ">>")
    if bad:
        # the filter is not compiled, so rows without a bad cell pass by it
        rejects = F.when(F.coalesce(*bad).isNotNull(), F.filter(
            F.array(*bad), lambda s: s.isNotNull())).otherwise(rejects)
    return staged.select(*[_q("_x_" + r.clean).alias(r.clean) for r in rules],
                         *[_q(c).alias("_o_" + c) for c in policy.order],
                         rejects.alias("_rejects"), *(marks.packed() if marks else []),
                         *[_q(c) for c in carried])


def rejected_cells(quarantined: DataFrame) -> DataFrame:
    """One row per quarantined cell.

    The outer form keeps the optimiser from pushing a size test below the
    typing stages, which would evaluate every coercion twice.
    """
    cells = quarantined.select(F.explode_outer("_rejects").alias("r"))
    return cells.filter(F.col("r").isNotNull()).select("r.*")


# --- missing values ---------------------------------------------------------

def impute_constant(df: DataFrame, column: str, fill: Any) -> DataFrame:
    return df.withColumn(column, F.coalesce(
        F.col(column), F.lit(fill).cast(df.schema[column].dataType)))


def impute_zero(df: DataFrame, column: str) -> DataFrame:
    return impute_constant(df, column, 0)


def impute_median(df: DataFrame, column: str) -> DataFrame:
    """Fill with the exact median; the column stays null if there is none."""
    middle = median(df, column).select("median").scalar()
    return df.withColumn(column, F.coalesce(F.col(column), middle.cast(df.schema[column].dataType)))


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    """Fill with the smallest of the most frequent values, counted as groups."""
    counts = (df.filter(F.col(column).isNotNull())
              .groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    mode = counts.agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias("m")).scalar()
    return df.withColumn(column, F.coalesce(F.col(column), mode))


def drop_null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def null_policy(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    for r in rules:
        if r.clean not in df.columns:
            continue
        if r.nulls == "drop_row":
            df = drop_null_rows(df, r.clean)
        elif r.nulls == "impute_constant":
            df = impute_constant(df, r.clean, r.fill)
        elif r.nulls == "impute_zero":
            df = impute_zero(df, r.clean)
        elif r.nulls == "impute_median":
            df = impute_median(df, r.clean)
        elif r.nulls == "impute_mode":
            df = impute_mode(df, r.clean)
    return df


# --- derived columns --------------------------------------------------------

def is_in(c: Column, values: Sequence[Any]) -> Column:
    """Membership that is False, not null, for a null value."""
    return F.coalesce(c.isin(*values), F.lit(False))


def floor_divide(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null over zero."""
    return F.when(b != 0, a - b * F.floor(F.try_divide(a, b)))


def derive(df: DataFrame, rule: DerivedRule, policy: Policy | None = None) -> DataFrame:
    """Add one computed column; guard rows and non-finite results are null."""
    value = rule.expr if isinstance(rule.expr, Column) else F.expr(str(rule.expr))
    if rule.type == "integer":
        value = value.try_cast("bigint")
    elif rule.type in NUMBER_TYPES:
        value = value.try_cast("double")
        value = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
        if rule.type != "float":
            settings = policy or Policy("t", ())
            value = F.bround(value, int(settings.setting(rule.type + "_dp")))
    elif rule.type == "boolean":
        value = value.cast("boolean")
    if rule.null_when is not None:
        guard = rule.null_when if isinstance(rule.null_when, Column) else F.expr(str(rule.null_when))
        value = F.when(~F.coalesce(guard, F.lit(False)), value)
    return df.withColumn(rule.name, value)


def order_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    lead = [k for k in keys if k in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


# --- the whole policy -------------------------------------------------------

class Cleaned:
    """The results of a policy, each planned when first asked for."""

    def __init__(self, source: DataFrame, policy: Policy, encoding: str | None = None):
        self.source, self.policy, self.encoding = source, policy, encoding

    @cached_property
    def quarantined(self) -> DataFrame:
        return quarantine_cells(_prepared(self.source, self.policy), self.policy, _Marks())

    @cached_property
    def marked(self) -> DataFrame | None:
        return _marked(self.source, self.policy)

    def without_duplicates(self, marked: DataFrame, repeated: DataFrame, n: int) -> DataFrame:
        """``quarantined`` from a written ``marked`` and its ``n`` repeated hashes.

        Rows whose hash is their own are kept as they are.  The others are cleaned
        from the source again and compared cell by cell; where their hashes are too
        many to send to every task, all rows are.
        """
        if n > FEW_HASHES:
            return self.quarantined
        few = F.broadcast(repeated)
        prepared, keys = _prepared_rows(self.source, self.policy)
        again = prepared.withColumn("_h", F.xxhash64(*keys)).join(few, "_h", "left_semi").drop("_h")
        checked = quarantine_cells(_dedupe(again, self.policy), self.policy, _Marks())
        return marked.join(few, "_h", "left_anti").select(*checked.columns).unionByName(checked)

    @cached_property
    def clean(self) -> DataFrame:
        return finish(self.quarantined, self.policy)

    @cached_property
    def rejects(self) -> DataFrame:
        return rejected_cells(self.quarantined)

    @cached_property
    def actions(self) -> DataFrame:
        return cleaning_actions(self.source, self.policy)

    @cached_property
    def warnings(self) -> DataFrame:
        return check_source(self.source, self.policy, self.encoding)


def check_source(df: DataFrame, policy: Policy, encoding: str | None = None) -> DataFrame:
    """Warnings about a source: encoding, row count, unknown or absent columns."""
    known = {r.source for r in policy.columns} | set(policy.drop) | set(policy.order)
    unknown = [c for c in df.columns if c not in known]
    absent = [r.source for r in policy.columns if r.source not in df.columns]
    no_drop = [d for d in policy.drop if d not in df.columns]
    n = F.count(F.lit(1))
    expected = policy.row_count_expected
    tests = [
        ("encoding", F.lit(bool(policy.encoding and encoding and policy.encoding != encoding)),
         F.lit(f"policy pins {policy.encoding}, file read as {encoding}")),
        ("row_count", F.lit(False) if expected is None else n != expected,
         F.concat(n.cast("string"), F.lit(f" rows, expected {expected}"))),
        ("unknown_column", F.lit(bool(unknown)), F.lit(", ".join(unknown))),
        ("absent_column", F.lit(bool(absent)), F.lit(", ".join(absent))),
        ("absent_drop", F.lit(bool(no_drop)), F.lit(", ".join(no_drop))),
    ]
    return df.agg(F.filter(F.array(*[
        F.when(test, F.struct(F.lit(policy.table).alias("table"), F.lit(kind).alias("kind"),
                              detail.alias("detail"))) for kind, test, detail in tests]),
        lambda s: s.isNotNull()).alias("w")).selectExpr("inline(w)")


def _prepare(df: DataFrame, policy: Policy,
             marks: _Marks | None = None) -> tuple[DataFrame, list[str]]:
    """The row-wise steps before de-duplication and the columns they leave;
    ``marks`` takes what they changed."""
    columns = df.columns
    resolve = lambda n: policy.source_of(n, columns)
    texts = [c for c in _texts(df) if c not in policy.order]
    out = _normal_stages(df, texts, policy.setting("trim_whitespace"),
                         policy.setting("collapse_internal_spaces"),
                         policy.setting("sentinel_nulls_to_null"))
    if marks is not None:
        # Taken here, before any later step replaces the column, and told from the raw text
        # alone, which is cheaper than trimming changed cells again to compare them.
        trim, collapse = (policy.setting("trim_whitespace"),
                          policy.setting("collapse_internal_spaces"))
        def change(raw: Column) -> Column:
            return _flags(X.trims(raw) if trim else F.lit(False),
                          X.collapses(raw, trim) if collapse else F.lit(False))

        for c in texts:
            raw, value = _q("_r_" + c), _q(c)
            gone = F.when(value.isNull(), 4).otherwise(0)
            out = marks.add(out, F.when(raw.isNull() | (raw == value), 0).otherwise(
                X.seldom(raw, change) + gone),
                ("trim_whitespace", c), ("collapse_spaces", c), ("sentinel_null", c))

    def mark(step: str, target: str, test: Column) -> None:
        nonlocal out
        if marks is not None:
            out = marks.add(out, _flags(test), (step, target))

    for i, fix in enumerate(policy.row_fixes):
        if fix.do != "shift_right":
            raise ValueError(f"unsupported row_fix action {fix.do!r}")
        names = [resolve(c) for c in fix.columns]
        out = out.withColumn(f"_hit_{i}", condition(fix.where, lambda n: _q(resolve(n))))
        mark("row_fix:" + fix.id, ", ".join(names), _q(f"_hit_{i}"))
        out = _shift(out, f"_hit_{i}", names)
    for target, mapping in policy.value_maps.items():
        base, _, driver = target.rpartition("_by_")
        if base:
            c, d = resolve(base), resolve(driver)
            for key in mapping:
                mark(f"value_map:{d}={key}", c, X.strip(_q(d).cast("string")) == str(key))
            out = out.withColumn(c, _mapped_by(_q(c), _q(d), mapping))
        else:
            c = resolve(target)
            reached = {str(k): str(k) for k in mapping}
            for old, new in mapping.items():
                hits = [k for k, v in reached.items() if v == str(old)]
                mark("value_map:" + str(old), c, _q(c).isin(*hits) if hits else F.lit(False))
                reached |= {k: str(new) for k in hits}
            out = map_values(out, c, mapping)
    return out, [c for c in columns if c not in policy.drop]


def _prepared(df: DataFrame, policy: Policy) -> DataFrame:
    return _dedupe(_prepared_rows(df, policy)[0], policy)


def _prepared_rows(df: DataFrame, policy: Policy) -> tuple[DataFrame, list[Column]]:
    """Rows before de-duplication, and the columns that duplicates share."""
    out, kept = _prepare(df, policy)
    return out.select(*[_q(c) for c in kept]), _shared(kept, policy)


def _shared(columns: Sequence[str], policy: Policy) -> list[Column]:
    if policy.deduplicate == "subset":
        return [_q(policy.source_of(c, columns)) for c in policy.dedupe_columns]
    return [_q(c) for c in columns if c not in policy.order]


def _marked(df: DataFrame, policy: Policy) -> DataFrame | None:
    """Every row typed, before de-duplication, with the flags of all steps; ``_h`` is a
    hash that duplicates share, and null where the policy leaves duplicates alone.

    None where equal cells may have unequal hashes: collations and nested types.
    """
    if policy.deduplicate and not all(
            isinstance(f.dataType, T.AtomicType) and (
                not isinstance(f.dataType, T.StringType) or f.dataType == T.StringType())
            for f in df.schema):
        return None
    before = _Marks("_b_")
    out, kept = _prepare(df, policy, before)
    keys = _shared(kept, policy)
    h = F.xxhash64(*keys) if policy.deduplicate and keys else F.lit(None).cast("bigint")
    rows = out.select(*[_q(c) for c in kept], *before.packed(), h.alias("_h"))
    return quarantine_cells(rows, policy, _Marks(), [*before.names, "_h"])


def repeated_hashes(marked: DataFrame) -> DataFrame:
    """Hashes that more than one row of ``Cleaned.marked`` has."""
    return (marked.filter(F.col("_h").isNotNull()).groupBy("_h")
            .agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h"))


def _dedupe(df: DataFrame, policy: Policy) -> DataFrame:
    if policy.deduplicate == "exact_rows":
        return dedupe_exact(df, policy.order)
    if policy.deduplicate == "subset":
        return dedupe_subset(df, [policy.source_of(c, df.columns) for c in policy.dedupe_columns],
                             policy.order)
    return df


def _type_marks(df: DataFrame, rules: Sequence[ColumnRule], marks: _Marks) -> DataFrame:
    gone = F.lit(False)
    for r in rules:
        value, shown = _q("_v_" + r.clean), _q("_x_" + r.clean)
        tests = {"reject_cell": _rejected(r), "type": value.isNotNull(),
                 "nulls:" + r.nulls: ~gone & value.isNull()}
        if r.transform:
            tests["transform:" + r.transform] = shown != value.cast("string")
        df = marks.add(df, _flags(*tests.values()), *[(step, r.clean) for step in tests])
        if r.nulls == "drop_row":
            gone = gone | value.isNull()
    return df


def cleaning_actions(df: DataFrame, policy: Policy, typed: DataFrame | None = None,
                     marked: DataFrame | None = None) -> DataFrame:
    """What each step did to each column: one count of patterns before and one
    after de-duplication.  ``typed`` and ``marked`` are a written ``Cleaned.quarantined``
    and ``Cleaned.marked``, whose flags spare cleaning the source again."""
    before, after = _Marks("_b_"), _Marks()
    prepared, _ = _prepare(df, policy, before)
    dropped = [_counter("drop_column", c, F.max(F.lit(1))) for c in policy.drop if c in df.columns]
    # the labels follow from the rules, whichever frame holds the flags
    cleaned = quarantine_cells(_prepared(df, policy), policy, after)
    counted = before.counted(prepared.select(*before.packed()) if marked is None else marked,
                             "rows_in", *dropped).unionByName(
        after.counted(cleaned if typed is None else typed, "rows_kept"))
    both = F.col("step").isin("rows_in", "rows_kept")
    # One row per step and column: a handful whatever the data size.
    step = F.when(both, "deduplicate").otherwise(F.col("step"))
    signed = F.when(F.col("step") == "rows_kept", -F.col("n")).otherwise(F.col("n"))
    return (counted.groupBy(step.alias("step"), "column").agg(F.sum(signed).alias("n"))
            .select(F.lit(policy.table).alias("table"), "step", "column", "n"))


def counts_by_step(actions: DataFrame) -> DataFrame:
    return actions.groupBy("table", "step").agg(F.sum("n").alias("n"))


def quarantined_table(df: DataFrame, policy: Policy) -> DataFrame:
    """Every step up to typing; the one frame both outputs are read from."""
    return quarantine_cells(_prepared(df, policy), policy)


def finish(quarantined: DataFrame, policy: Policy) -> DataFrame:
    """Null policy, derived columns and column order."""
    inner = [c for c in quarantined.columns
             if c in ("_rejects", "_h") or re.fullmatch(r"_[bk]_\d+", c)]
    out = null_policy(quarantined.drop(*inner), policy.columns)
    for d in policy.derived:
        if isinstance(d.expr, str) and d.expr.strip() == "row_number":
            if not policy.order:
                raise ValueError(f"{d.name}: row_number needs policy.order")
            out = surrogate_key(out, d.name, ["_o_" + c for c in policy.order])
        else:
            out = derive(out, d, policy)
    return order_columns(out.drop(*["_o_" + c for c in policy.order]), policy.key_columns)


def clean_table(df: DataFrame, policy: Policy, encoding: str | None = None) -> Cleaned:
    """The whole policy as lazy frames.  A job that needs both the clean table
    and the rejects should write ``quarantined`` once and read it back."""
    return Cleaned(df, policy, encoding)
