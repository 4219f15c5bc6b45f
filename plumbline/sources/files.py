"""Text-first readers, discovery, snapshots and exports."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.cleaning import (Cleaned, Policy, cleaning_actions, finish, rejected_cells,
                                          repeated_hashes)
from plumbline.operators.versions import describe
from plumbline.session import drop_folder
from plumbline.sources.records import records, text_lines

# --- fixed values -----------------------------------------------------------
TEXT_SUFFIXES = (".csv", ".tsv", ".psv", ".txt")
JSON_SUFFIXES = (".json", ".jsonl", ".ndjson")
SUFFIXES = TEXT_SUFFIXES + JSON_SUFFIXES + (".parquet",)
DELIMITERS = (",", ";", "\t", "|")
STAMP = "%Y%m%dT%H%M%S"
MANIFEST = "_manifest"
# --- end of fixed values ----------------------------------------------------

# What a reader raises for a file it cannot read.
UNREADABLE = (PySparkException, Py4JJavaError, ValueError)


def _reason(exc: Exception) -> str:
    java = getattr(exc, "java_exception", None)
    return (str(java) if java is not None else str(exc)).splitlines()[0][:300]


# Bytes with no character in code page 1252.
_CP1252_HOLES = ("81", "8D", "8F", "90", "9D")


def _suffix(path: str) -> str:
    return posixpath.splitext(path)[1].lower()


def _stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def sanitise_table_name(name: str) -> str:
    return re.sub(r"[^a-z0-9_]+", "_", _stem(name).lower()).strip("_") or "dataset"


def dedupe_headers(columns: Sequence[str]) -> list[str]:
    """Repeated names get ``__dup1``, ``__dup2``."""
    out, seen = [], {}
    for c in columns:
        n = seen.get(c, 0)
        seen[c] = n + 1
        out.append(c if n == 0 else f"{c}__dup{n}")
    return out


def discover_sources(spark: SparkSession, directory: str) -> DataFrame:
    """Readable files below a directory, empty ones too: path, file, stem, suffix, length.

    The scan passes over empty files, so they come from the file index.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    listed = [(re.sub("^file:/+", "file:/", unquote(p)),) for p in found.inputFiles()]
    files = (spark.createDataFrame(listed, "path string")
             .join(found.select("path", "length"), "path", "left")
             .withColumn("length", F.coalesce("length", F.lit(0))))
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return (files.withColumns({"file": name, "suffix": suffix})
            .withColumn("stem", F.regexp_replace("file", r"\.[^.]+$", ""))
            .filter(F.col("suffix").isin(*SUFFIXES) & ~F.col("file").startswith(".")
                    & ~F.col("file").startswith("~$")).orderBy("path"))


def detect_encoding(spark: SparkSession, path: str) -> DataFrame:
    """First of utf-8, cp1252 and latin-1 that decodes each whole file.

    Works on lines, so one large file is checked by many tasks.
    """
    # The text source keeps the bytes of a line as they are.
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value",
                                         F.col("value").cast("binary").alias("bytes"))
    holes = F.lit(False)
    for h in _CP1252_HOLES:
        holes = holes | F.contains("bytes", F.unhex(F.lit(h)))
    return lines.groupBy("path").agg(
        F.min(F.is_valid_utf8("value")).alias("utf8"),
        F.max(holes).alias("holes")).select(
        "path", F.when(F.col("utf8"), "utf-8").when(~F.col("holes"), "cp1252")
        .otherwise("latin-1").alias("encoding"))


def sniff_delimiter(lines: DataFrame, suffix: str = ".csv") -> DataFrame:
    """The delimiter that splits the lines most evenly, with a fallback by file
    suffix."""
    counts = [F.struct(F.lit(d).alias("delimiter"), F.avg(_count(d)).alias("mean"),
                       F.stddev_pop(_count(d)).alias("spread")) for d in DELIMITERS]
    fallback = {".tsv": "\t", ".psv": "|"}.get(suffix, ",")
    good = lines.agg(F.array(*counts).alias("a")).selectExpr("inline(a)").filter("mean >= 1")
    best = good.agg(F.min_by("delimiter", F.struct(
        F.col("spread") / F.col("mean"), -F.col("mean"))).alias("d"))
    return best.select(F.coalesce("d", F.lit(fallback)).alias("delimiter"))


def _count(delimiter: str) -> Column:
    return F.length("value") - F.length(F.replace("value", F.lit(delimiter), F.lit("")))


def _as_path(url: str) -> str:
    """A path of the file index as a reader takes it, without patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(url))


@dataclass(frozen=True)
class _Shape:
    """What files must share to be read as one: how they are split, decoded and named."""

    encoding: str
    sep: str
    header: str
    spans: bool


def _decoded(encoding: str) -> Column:
    """The text of a line; the text source keeps its bytes."""
    if encoding == "utf-8":
        return F.col("value")
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    if encoding == "latin-1":
        return latin
    low = [chr(c) for c in range(0x80, 0xA0) if f"{c:02X}" not in _CP1252_HOLES]
    return F.translate(latin, "".join(low), "".join(c.encode("latin-1").decode("cp1252")
                                                    for c in low))


def _shapes(spark: SparkSession, path: str, encoding: str | None,
            sep: str | None) -> dict[_Shape, list[str]]:
    """Files by shape, in the order of their paths, from one pass over all lines."""
    lines = text_lines(spark, path)
    found = {r["path"]: r["encoding"] for r in detect_encoding(spark, path).collect()}
    stats = [F.struct(F.avg(_count(d)).alias("mean"), F.stddev_pop(_count(d)).alias("spread"))
             .alias(f"d{k}") for k, d in enumerate(DELIMITERS)]
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    files = lines.groupBy("path").agg(
        F.min_by("value", F.struct("block", "line")).alias("head"),
        (F.max(quotes % 2) == 1).alias("spans"), *stats).orderBy("path").collect()
    shapes: dict[_Shape, list[str]] = {}
    for r in files:
        good = [(r[f"d{k}"]["spread"] / r[f"d{k}"]["mean"], -r[f"d{k}"]["mean"], d)
                for k, d in enumerate(DELIMITERS) if r[f"d{k}"]["mean"] >= 1]
        fallback = {".tsv": "\t", ".psv": "|"}.get(_suffix(r["path"]), ",")
        own = sep or (min(good)[2] if good else fallback)
        name, head = encoding or found[r["path"]], r["head"]
        at = [_as_path(r["path"])]
        if r["spans"] and head.count('"') % 2:
            first = records(text_lines(spark, at), own)
            head = first.where(F.startswith("value", F.lit(head))).agg(F.min("value")).first()[0]
        shapes.setdefault(_Shape(name, own, head, bool(r["spans"])), []).extend(at)
    return shapes


def _read_shape(spark: SparkSession, shape: _Shape, paths: list[str]) -> DataFrame:
    options = {"sep": shape.sep, "quote": '"', "escape": '"'}
    lines = text_lines(spark, paths)
    rows = records(lines, shape.sep) if shape.spans else lines.select("path", "value")
    # The first record of a file names its columns; rows equal to it are counted, less one.
    heads = rows.where(F.col("value") == shape.header).groupBy("path", "value").agg(
        F.count(F.lit(1)).alias("n"))
    again = heads.select("path", F.explode(F.array_repeat("value", (F.col("n") - 1).cast("int")))
                         .alias("value"))
    body = rows.where(F.col("value") != shape.header).unionByName(again)
    wide = max(1, shape.header.count(shape.sep) + 1)
    one = ", ".join(f"c{k} string" for k in range(wide))
    head = spark.range(1).select(F.lit(shape.header).alias("value")).select(
        F.from_csv(_decoded(shape.encoding), one, options).alias("r")).select("r.*").first()
    cells = list(head)
    while len(cells) > 1 and cells[-1] is None and len(cells) > _fields(shape):
        cells.pop()
    names = dedupe_headers([(v or "").lstrip(chr(0xFEFF)) or f"column_{i}"
                            for i, v in enumerate(cells, 1)])
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    parsed = body.select(F.from_csv(_decoded(shape.encoding), schema, options).alias("r"))
    return parsed.select(*[F.coalesce(F.col(f"r.c{k}"), F.lit("")).alias(n)
                           for k, n in enumerate(names)])


def _fields(shape: _Shape) -> int:
    """How many cells a header has: separators outside quoted cells, and one."""
    return len(re.findall(re.escape(shape.sep), re.sub(r'"[^"]*"', "", shape.header))) + 1


def read_delimited(spark: SparkSession, path: str, encoding: str | None = None,
                   sep: str | None = None) -> DataFrame:
    """Every column as text; empty cells stay empty strings and 'NA' stays 'NA'.

    Each file of a folder has its own encoding, delimiter and header: columns meet by
    name, in the order in which files by path bring them, and are empty where a file
    lacks them.  Repeated names are suffixed rather than renumbered.  Blank lines are
    rows of empty cells.  Quoted cells may span lines (joined by a line feed); a file
    with such cells is still read by many tasks.  A file without a line is passed over.
    """
    if encoding and encoding.lower() not in _CHARSETS:
        return _read_charset(spark, path, encoding, sep)
    shapes = _shapes(spark, path, encoding and _CHARSETS[encoding.lower()], sep)
    if not shapes:
        return spark.createDataFrame([], T.StructType([]))
    parts = [_read_shape(spark, shape, paths) for shape, paths in shapes.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if len(parts) == 1:
        return every
    return every.select(*[F.coalesce(_named(c), F.lit("")).alias(c) for c in every.columns])


_CHARSETS = {"utf-8": "utf-8", "utf8": "utf-8", "ascii": "utf-8", "cp1252": "cp1252",
             "windows-1252": "cp1252", "latin-1": "latin-1", "latin1": "latin-1",
             "iso-8859-1": "latin-1"}


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _read_charset(spark: SparkSession, path: str, encoding: str, sep: str | None) -> DataFrame:
    """Other encodings go through the CSV source, each file in one task."""
    reader = (spark.read.option("sep", sep or ",").option("encoding", encoding)
              .option("multiLine", "true").option("quote", '"').option("escape", '"')
              .option("inferSchema", "false"))
    first = reader.option("header", "false").csv(path).first()
    if first is None:
        return spark.createDataFrame([], T.StructType([]))
    names = dedupe_headers([(v or "").lstrip(chr(0xFEFF)) or f"column_{i}"
                            for i, v in enumerate(first, 1)])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    body = reader.option("header", "true").option("enforceSchema", "true").schema(schema).csv(path)
    return body.select(*[F.coalesce(_named(n), F.lit("")).alias(n) for n in names])


def _flattened(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    out = []
    for f in schema:
        path = f"{prefix}`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            out += [(p, f"{f.name}.{n}") for p, n in _flattened(f.dataType, path + ".")]
        else:
            out.append((path, f.name))
    return out


def _as_text(df: DataFrame) -> DataFrame:
    cols = []
    for path, name in _flattened(df.schema):
        nested = isinstance(df.select(F.expr(path)).schema[0].dataType, (T.ArrayType, T.MapType))
        value = F.to_json(F.expr(path)) if nested else F.expr(path).cast("string")
        cols.append(F.coalesce(value, F.lit("")).alias(name))
    return df.select(*cols)


def _one_record_per_line(spark: SparkSession, path: str) -> bool:
    """Whether a ``.json`` file really holds one object on each line; read as
    one document it would lose every record after the first.

    All lines decide, so that a few broken ones do not make a document of them.
    """
    v = F.trim("value")
    n, whole = spark.read.text(path).filter(v != "").agg(
        F.count(F.lit(1)), F.count_if(v.startswith("{") & v.endswith("}"))).first()
    return n > 1 and 2 * whole > n


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records as text with nested objects flattened to ``a.b``.

    A ``.json`` object whose values include lists holds its records in the
    longest of them.
    """
    lines = _suffix(path) in (".jsonl", ".ndjson") or _one_record_per_line(spark, path)
    df = spark.read.option("multiLine", str(not lines).lower()).option(
        "primitivesAsString", "true").json(path)
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)
             and isinstance(f.dataType.elementType, T.StructType)]
    if not lines and lists and df.limit(2).count() == 1:
        sizes = df.select(*[F.size(f"`{c}`").alias(c) for c in lists]).first()
        records = max(lists, key=lambda c: sizes[c])
        df = df.select(F.inline(f"`{records}`"))
    return _as_text(df)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet keeps its own types."""
    return spark.read.parquet(path)


def read_source(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    suffix = _suffix(path)
    if suffix in JSON_SUFFIXES:
        return read_json(spark, path)
    if suffix == ".parquet":
        return read_parquet(spark, path)
    if suffix in TEXT_SUFFIXES:
        return read_delimited(spark, path, encoding)
    raise ValueError(f"no reader for {path}")


@dataclass(frozen=True)
class Loaded:
    tables: dict[str, DataFrame]
    problems: DataFrame


def _problems(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "kind string, file string, detail string")


def load_all(spark: SparkSession, directory: str) -> Loaded:
    """Every source below a directory; a bad or empty file becomes a problem row.

    A second file of one stem becomes a table of its own, ``stem_2``, by path.
    """
    tables, problems = {}, []
    for row in discover_sources(spark, directory).select(
            "path", "stem", "file", "length").collect():
        if row["length"] == 0:
            problems.append(("failed", row["file"], "empty file"))
            continue
        name, n = row["stem"], 2
        while name in tables:
            name, n = f"{row['stem']}_{n}", n + 1
        try:
            tables[name] = read_source(spark, row["path"])
        except UNREADABLE as exc:
            problems.append(("failed", row["file"], _reason(exc)))
    return Loaded(tables, _problems(spark, problems))


def load_configured(spark: SparkSession, directory: str, policies: Mapping[str, Policy],
                    skip: Mapping[str, str] | None = None) -> Loaded:
    """Only sources a policy names; skipped, unconfigured, failed and repeated
    files are four kinds of problem."""
    tables, problems = {}, []
    skipped = {k.lower(): v for k, v in (skip or {}).items()}
    by_stem = {k.lower(): p for k, p in policies.items()}
    by_stem |= {p.table.lower(): p for p in policies.values()}
    for row in discover_sources(spark, directory).select(
            "path", "stem", "file", "length").collect():
        stem = row["stem"].lower()
        policy = by_stem.get(stem)
        if stem in skipped:
            problems.append(("skipped", row["file"], skipped[stem]))
        elif policy is None:
            problems.append(("unconfigured", row["file"], "no policy"))
        elif row["length"] == 0:
            problems.append(("failed", row["file"], "empty file"))
        elif policy.table in tables:
            problems.append(("repeated", row["path"], f"{policy.table} is loaded already"))
        else:
            try:
                tables[policy.table] = read_source(spark, row["path"], policy.encoding)
            except UNREADABLE as exc:
                problems.append(("failed", row["file"], _reason(exc)))
    return Loaded(tables, _problems(spark, problems))


def register_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Make frames queryable by name; returns (view, n_rows, is_primary)."""
    used, counts = set(), []
    for raw, df in tables.items():
        base = name = sanitise_table_name(raw)
        n = 2
        while name in used:
            name, n = f"{base}_{n}", n + 1
        used.add(name)
        df.createOrReplaceTempView(name)
        counts.append(df.agg(F.lit(name).alias("view"), F.count(F.lit(1)).alias("n_rows")))
    every = reduce(DataFrame.unionByName, counts)
    top = F.row_number().over(Window.orderBy(F.desc("n_rows"), F.asc("view")))
    return every.withColumn("is_primary", top == 1)


# --- sinks ------------------------------------------------------------------

def write_clean(result: Cleaned, directory: str, mode: str = "overwrite",
                actions: bool = False) -> dict[str, str]:
    """The clean table, its rejects beside it when there are any, and with
    ``actions`` the counts of what cleaning did.

    All are read from one written copy of the typed rows, so the source is
    cleaned once; the copy is deleted afterwards.  Rows are compared for
    duplicates only where their hashes are equal, and cleaned again for that.
    """
    spark = result.source.sparkSession
    name = result.policy.table
    staging = posixpath.join(directory, f"_staging_{name}")

    def staged(df: DataFrame, part: str) -> DataFrame:
        path = posixpath.join(staging, part)
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    marked = typed = None
    if result.marked is not None:
        marked = typed = staged(result.marked, "marked")
        repeated = staged(repeated_hashes(marked), "repeated") if result.policy.deduplicate else None
        n = repeated.count() if repeated is not None else 0
        if n:
            typed = staged(result.without_duplicates(marked, repeated, n), "typed")
    else:
        typed = staged(result.quarantined, "typed")
    paths = {"clean": posixpath.join(directory, name)}
    finish(typed, result.policy).write.mode(mode).parquet(paths["clean"])
    rejects = rejected_cells(typed)
    if not rejects.isEmpty():
        paths["rejects"] = posixpath.join(directory, name + "__rejects")
        rejects.write.mode(mode).parquet(paths["rejects"])
    if actions:
        paths["actions"] = posixpath.join(directory, name + "__actions")
        cleaning_actions(result.source, result.policy, typed, marked).write.mode(mode).parquet(
            paths["actions"])
    drop_folder(spark, staging)
    return paths


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def export_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


# --- snapshots --------------------------------------------------------------

def new_version_id(now: datetime | None = None) -> str:
    """Ids sort by time as text."""
    return (now or datetime.now(timezone.utc)).strftime(STAMP)


def write_snapshot(tables: Mapping[str, DataFrame], directory: str, validation: str = "",
                   notes: str = "", version: str | None = None) -> str:
    """One Parquet folder per table under ``version=<id>``; the manifest is
    written last and is what makes the folder a version."""
    version = version or new_version_id()
    base = posixpath.join(directory, f"version={version}")
    spark = next(iter(tables.values())).sparkSession
    for name, df in sorted(tables.items()):
        df.write.mode("errorifexists").parquet(posixpath.join(base, name))
    written = {name: spark.read.parquet(posixpath.join(base, name)) for name in tables}
    manifest = describe(written).withColumns({
        "validation": F.lit(validation), "notes": F.lit(notes),
        "created_at": F.lit(datetime.now(timezone.utc).isoformat(timespec="seconds"))})
    manifest.coalesce(1).write.mode("errorifexists").parquet(
        posixpath.join(directory, MANIFEST, f"version={version}"))
    return version


def read_manifests(spark: SparkSession, directory: str) -> DataFrame:
    """Manifest rows of every version; a folder without one is no version."""
    return (spark.read.option("basePath", posixpath.join(directory, MANIFEST))
            .schema("table string, n_rows bigint, n_columns int, content_hash string, position int,"
                    " column string, dtype string, n_nulls bigint, validation string, notes string,"
                    " created_at string, version string")
            .parquet(posixpath.join(directory, MANIFEST)))


def list_versions(spark: SparkSession, directory: str) -> DataFrame:
    """Versions in order with their validation status."""
    m = read_manifests(spark, directory)
    return (m.groupBy("version").agg(
        F.count_distinct("table").alias("n_tables"), F.max("validation").alias("validation"),
        F.max("notes").alias("notes"), F.max("created_at").alias("created_at")).orderBy("version"))


def latest_version(spark: SparkSession, directory: str) -> str | None:
    try:
        return read_manifests(spark, directory).agg(F.max("version")).first()[0]
    except PySparkException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def read_snapshot(spark: SparkSession, directory: str,
                  version: str | None = None) -> dict[str, DataFrame]:
    """Tables of a version, by default the newest.  A missing version is an
    error, never a fallback."""
    version = version or latest_version(spark, directory)
    if version is None:
        raise FileNotFoundError(f"no snapshots in {directory}")
    names = [r[0] for r in read_manifests(spark, directory)
             .filter(F.col("version") == version).select("table").distinct().collect()]
    if not names:
        raise FileNotFoundError(f"no snapshot {version} in {directory}")
    base = posixpath.join(directory, f"version={version}")
    return {n: spark.read.parquet(posixpath.join(base, n)) for n in sorted(names)}
