"""Text jobs: scope tags, numeric claims and their verification, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import fold_key

# --- fixed values -----------------------------------------------------------
# First match wins; tested on lower-cased text.
SCOPE_PATTERNS = (
    ("personal_data", r"customer'?s? (name|names|email|address|street|password)"),
    ("personal_data", r"\b(first|last|full) names?\b"),
    ("personal_data", r"\b(name|names|email|emails|phone|address)\s+of\b"),
    ("personal_data", r"\bwhich customers?\b|\btop \d+ customers?\b"),
    ("personal_data", r"\bwho (are|is|was|were)\b.*?\b(customers?|users?|clients?|patients?|"
                      r"students?|employees?|people|persons?)\b"),
    ("personal_data", r"\bwho (are|is) (our|the) (top|best|biggest|largest)"),
    ("personal_data", r"\b(ips?|ip address|client ip|emails?|email address|password)\b"),
    ("forecast", r"\b(forecast|predict|prediction|projected|extrapolat)"),
    ("forecast", r"\bnext (month|quarter|year|week)\b"),
    ("causal", r"\bwhy\b|\broot cause\b|\bwhat caused\b|\bwhat drove\b"),
    ("write", r"\b(delete|remove|drop|truncate|wipe|purge)\s+"
              r"(?:(?:the|all|these|those|every|any)\s+)?(?:\w+\s+){0,2}"
              r"(rows?|tables?|records?|orders?|snapshots?|data|accounts?)\b"),
    ("write", r"\b(update|modify|overwrite|insert into|set|increase|decrease|raise)\s+"
              r"(?:(?:the|all|these|those|our|my)\s+)?(?:\w+\s+){0,2}"
              r"(targets?|budgets?|status|prices?|values?|rows?|records?|orders?|"
              r"tables?|columns?|order_items|data|balance|balances|accounts?|salary|salaries)\b"),
    ("raw_sql", r"\bselect\b.{0,80}\bfrom\b|\bgroup by\b|\bsql\b"),
)
# Dates and periods are no claims about values; they are blanked first.
PERIOD = (r"(?i)\d{4}-\d{2}(-\d{2})?|\bq[1-4]\b(\s\d{4})?|\bh[12]\b\s\d{4}"
          r"|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s?\d{0,4}"
          r"|\b(19|20)\d{2}\b")
TOP_WORDS = r"\b(?:top|first|last|bottom|best|worst|highest|lowest)\s(?:\w+\s)?"
# 1 top word, 2 minus, 3 currency, 4 sign, 5 digits, 6 fraction, 7 scale, 8 unit
NUMBER = (r"(?i)(" + TOP_WORDS + r")?(-|minus\s)?(\$\s?)?(-)?(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?"
          r"\s?(?:(billion|million|thousand|bn|[kmb])(?![a-z]))?"
          r"\s?(%|pp\b|percentage\spoints?|points?|pts?|days?)?")
SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9}
# Which candidate kinds a claim of each kind may match.
ALLOWED = {
    "money": ("money",),
    "percent": ("percent",),
    "days": ("days", "count"),
    "integer": ("count", "shape"),
    "": ("money", "percent", "days", "count", "shape"),
}
SMALL = 100
# --- end of fixed values ----------------------------------------------------


def tag_scope(df: DataFrame, text: str, name: str = "scope") -> DataFrame:
    """The first scope whose pattern the text matches, else null."""
    low = F.lower(F.col("_text"))
    tag = reduce(lambda acc, cp: acc.when(low.rlike(cp[1]), cp[0]), SCOPE_PATTERNS[1:],
                 F.when(low.rlike(SCOPE_PATTERNS[0][1]), SCOPE_PATTERNS[0][0]))
    return df.withColumn("_text", F.col(text)).withColumn(name, tag).drop("_text")


def blank_labels(df: DataFrame, key: str, text: str, labels: DataFrame, label: str) -> DataFrame:
    """(id, t): the texts with every whole occurrence of a label taken out, in any case.

    Only labels with a digit can be read as a number.  Texts and labels meet on the
    first word of the label that has one, so neither side is listed against the other.
    Where labels overlap, the longer one is taken.
    """
    def numbered(c: Column) -> Column:
        return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w.rlike("[0-9]"))

    names = (labels.select(F.col(label).cast("string").alias("label")).distinct()
             .select("label", F.get(numbered(F.col("label")), F.lit(0)).alias("word"))
             .where("word IS NOT NULL"))
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("t"))
    near = (texts.select("id", F.explode(F.array_distinct(numbered(F.col("t")))).alias("word"))
            .join(names, "word").groupBy(F.col("id").alias("_id"))
            .agg(F.collect_set("label").alias("found")))
    quoted = F.transform(
        F.array_sort("found", lambda a, b: F.length(b) - F.length(a)),
        lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
                           F.lit("\\E")))
    pattern = F.concat(F.lit("(?iu)(?<![\\p{L}\\p{N}])(?:"), F.array_join(quoted, "|"),
                       F.lit(")(?![\\p{L}\\p{N}])"))
    known = near.select("_id", pattern.alias("pattern"))
    return texts.join(known, F.col("id").eqNullSafe(F.col("_id")), "left").select(
        "id", F.when(F.col("pattern").isNull(), F.col("t"))
        .otherwise(F.regexp_replace("t", F.col("pattern"), F.lit(" "))).alias("t"))


def extract_claims(df: DataFrame, key: str, text: str, labels: DataFrame | None = None,
                   label: str = "label") -> DataFrame:
    """Every numeric literal with its value, tolerance and kind.

    The tolerance is half a unit in the last printed place.  Names in ``labels`` are
    blanked first, so that "Brand#12" claims nothing.
    """
    texts = (df.select(F.col(key).alias("id"), F.col(text).alias("t")) if labels is None
             else blank_labels(df, key, text, labels, label))
    scanned = texts.select("id", F.regexp_replace("t", PERIOD, " ").alias("t"))
    found = scanned.select("id", F.posexplode(F.regexp_extract_all("t", F.lit(NUMBER), F.lit(0)))
                           .alias("claim_no", "literal"))

    def part(i: int) -> Column:
        return F.regexp_extract("literal", NUMBER, i)

    out = found.select(
        "id", "claim_no", F.trim("literal").alias("literal"), (part(1) != "").alias("is_top_n"),
        ((part(2) != "") | (part(4) != "")).alias("is_signed"), (part(3) != "").alias("_money"),
        F.replace(part(5), F.lit(","), F.lit("")).alias("_digits"), part(6).alias("_frac"),
        F.lower(part(7)).alias("_scale"), F.lower(part(8)).alias("_unit"))
    scale = F.coalesce(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])[
        F.col("_scale")], F.lit(1.0))
    plain = F.concat("_digits", F.when(F.col("_frac") != "", F.concat(F.lit("."), "_frac"))
                     .otherwise("")).try_cast("double") * scale
    unit = F.col("_unit")
    kind = (F.when(F.col("_money"), "money")
            .when(unit.rlike("^(%|pp|percentage|point|pt)"), "percent")
            .when(unit.startswith("day"), "days")
            .when((F.col("_frac") == "") & (F.col("_scale") == "") & (plain < SMALL), "integer")
            .otherwise(""))
    return out.select(
        "id", "claim_no", "literal", F.when(F.col("is_signed"), -plain).otherwise(plain).alias("value"),
        (0.5 * F.pow(F.lit(10.0), -F.length("_frac")) * scale + 1e-9).alias("tolerance"),
        kind.alias("kind"), "is_signed", "is_top_n")


def claim_values(results: DataFrame, key: str, kinds: Mapping[str, str],
                 order: Sequence[str]) -> DataFrame:
    """The present numbers of a result: (id, row, column, kind, v)."""
    rows = F.row_number().over(Window.partitionBy(key).orderBy(
        *[F.desc_nulls_last(o[1:]) if o.startswith("-") else F.asc_nulls_last(o) for o in order]))
    return results.withColumn("_row", rows).select(
        F.col(key).alias("id"), F.col("_row").alias("row"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"),
                     F.col(c).cast("double").alias("v")) for c, k in kinds.items()])).alias("e")
    ).select("id", "row", "e.*").filter("v IS NOT NULL")


def claim_candidates(results: DataFrame, key: str, kinds: Mapping[str, str],
                     order: Sequence[str]) -> DataFrame:
    """Every number that a true sentence could take from single rows or totals.

    Values, running sums, shares of the total, sum, mean and range come from
    all rows.  What two rows say together (differences, ratios, changes) is
    looked up by ``verify_claims`` instead of being listed.
    """
    values = claim_values(results, key, kinds, order)
    whole = Window.partitionBy("id", "column")
    read = values.withColumns({
        "running": F.sum("v").over(whole.orderBy("row").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)),
        "share": F.try_divide(100.0 * F.col("v"), F.sum("v").over(whole))})
    each = read.select("id", F.explode(F.array(
        F.struct("kind", F.col("v").alias("candidate")),
        F.struct("kind", F.col("running").alias("candidate")),
        F.struct(F.lit("percent").alias("kind"), F.col("share").alias("candidate")))).alias("c"))
    totals = values.groupBy("id", "column", "kind").agg(
        F.array(F.sum("v"), F.avg("v"), F.max("v") - F.min("v")).alias("t"))
    shape = results.groupBy(F.col(key).alias("id")).agg(
        F.count(F.lit(1)).cast("double").alias("candidate")).select(
        "id", F.lit("shape").alias("kind"), "candidate")
    parts = [each.select("id", "c.*"), shape,
             totals.select("id", "kind", F.explode("t").alias("candidate"))]
    return reduce(DataFrame.unionByName, parts).filter("candidate IS NOT NULL").distinct()


def _probes(claims: DataFrame) -> DataFrame:
    """Each claim once for every kind it may be and every sign it may have."""
    allowed = F.create_map(*[x for k, v in ALLOWED.items()
                             for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    return claims.select(
        "id", "claim_no", "tolerance", F.explode(allowed[F.col("kind")]).alias("kind"),
        F.when(F.col("is_signed"), F.array("value")).otherwise(
            F.array(F.col("value"), -F.col("value"))).alias("targets")).withColumn(
        "target", F.explode("targets")).drop("targets")


def _meets(wanted: DataFrame, held: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Rows of ``wanted`` (low, high) with the ``held`` rows whose value lies between.

    Both sides meet on a bucket about as wide as the interval, so only near
    neighbours are compared, however large a result is.
    """
    level = F.ceil(F.log10(F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)))).cast("int")
    width = F.pow(F.lit(10.0), F.col("level"))
    asked = wanted.withColumn("level", level).withColumn("bucket", F.explode(F.array_distinct(
        F.array(F.floor(F.col("low") / width), F.floor(F.col("high") / width)))))
    levels = asked.select(*on, "level").distinct()
    placed = held.join(levels, list(on)).withColumn("bucket", F.floor(F.col(value) / width))
    return asked.join(placed, [*on, "level", "bucket"]).filter(
        (F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high")))


def _said_by_two(probes: DataFrame, values: DataFrame) -> DataFrame:
    """Claims that a difference, a ratio or a change between two rows supports.

    For every claim and row, the other row's value is known up to the claim's
    tolerance, so it is looked up: work grows with claims times rows, not with
    pairs of rows.
    """
    of_kind = probes.join(values.withColumnRenamed("row", "other"), ["id", "kind"]).select(
        "id", "claim_no", "column", "other", (F.col("v") + F.col("target")).alias("x"),
        F.col("tolerance").alias("t"))
    share = F.col("target") / 100.0
    percent = probes.filter("kind = 'percent'").drop("kind").join(
        values.withColumnRenamed("row", "other"), "id").filter("v <> 0").select(
        "id", "claim_no", "column", "other",
        F.explode(F.array(F.col("v") * share, F.col("v") * (share + 1.0))).alias("x"),
        (F.abs("v") * F.col("tolerance") / 100.0).alias("t"))
    wanted = of_kind.unionByName(percent).withColumns(
        {"low": F.col("x") - F.col("t"), "high": F.col("x") + F.col("t")})
    return _meets(wanted, values.select("id", "column", "row", "v"), ["id", "column"], "v").filter(
        "row <> other").select("id", "claim_no")


def verify_claims(claims: DataFrame, candidates: DataFrame,
                  values: DataFrame | None = None) -> DataFrame:
    """Whether each claim lies within its tolerance of an allowed candidate.

    With ``values`` (see ``claim_values``), a claim also holds when two rows
    of a column say it together.
    """
    probes = _probes(claims)
    wanted = probes.withColumns({"low": F.col("target") - F.col("tolerance"),
                                 "high": F.col("target") + F.col("tolerance")})
    near = _meets(wanted, candidates, ["id", "kind"], "candidate").select("id", "claim_no")
    if values is not None:
        near = near.unionByName(_said_by_two(
            probes.join(near.distinct(), ["id", "claim_no"], "left_anti"), values))
    near = near.distinct().withColumn("_near", F.lit(True))
    shape = candidates.filter("kind = 'shape'").groupBy("id").agg(F.max("candidate").alias("_rows"))
    top = F.col("is_top_n") & (F.col("value") == F.floor("value")) & (F.col("value") > 0) & (
        F.col("value") <= F.col("_rows"))
    return (claims.join(near, ["id", "claim_no"], "left").join(shape, "id", "left")
            .withColumn("holds", F.coalesce("_near", F.lit(False)) | F.coalesce(top, F.lit(False)))
            .drop("_near", "_rows"))


def unsupported_texts(verified: DataFrame) -> DataFrame:
    """Per text: claims checked and failed; one failure drops the whole text."""
    return verified.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_checked"), F.count_if(~F.col("holds")).alias("n_failed"),
        F.min("holds").alias("ok"))


# --- labels in text ---------------------------------------------------------

def _ngrams(df: DataFrame, key: str, text: str, longest: int) -> DataFrame:
    """(id, start, length, gram) for runs of up to ``longest`` folded words."""
    words = df.select(F.col(key).alias("id"), F.split(fold_key(F.col(text)), " ").alias("w"))
    spans = words.select("id", "w", F.posexplode("w").alias("start", "word")).select(
        "id", "w", "start", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("length"))
    return spans.filter(F.col("start") + F.col("length") <= F.size("w")).select(
        "id", "start", "length",
        F.array_join(F.slice("w", F.col("start") + 1, F.col("length")), " ").alias("gram"))


def _longest(labels: DataFrame) -> int:
    n = labels.agg(F.max(F.size(F.split("gram", " ")))).first()[0]
    return int(n or 1)


def foreign_labels(texts: DataFrame, key: str, text: str, own: DataFrame,
                   known: DataFrame) -> DataFrame:
    """Known names a text mentions that its own result does not hold.

    ``own`` is (id, label), ``known`` is (label).  Texts and names meet on
    folded word runs, and a name inside one the result holds is no mention.
    """
    def folded(df: DataFrame) -> DataFrame:
        return df.withColumn("gram", fold_key(F.col("label"))).filter("gram <> ''")

    known, own = folded(known.select("label").distinct()), folded(own.select("id", "label").distinct())
    grams = _ngrams(texts, key, text, max(_longest(known), _longest(own)))
    hits = grams.join(known, "gram").select("id", "start", "length", "label", "gram")
    mine = grams.join(own, ["id", "gram"]).select(
        "id", F.col("start").alias("_s"), (F.col("start") + F.col("length")).alias("_e"))
    strange = hits.join(own.select("id", "gram"), ["id", "gram"], "left_anti")
    inside = (F.col("x.id") == F.col("m.id")) & (F.col("m._s") <= F.col("x.start")) & (
        F.col("x.start") + F.col("x.length") <= F.col("m._e"))
    return (strange.alias("x").join(mine.alias("m"), inside, "left_anti")
            .groupBy("id", "label").agg(F.count(F.lit(1)).alias("n_mentions")))


# --- fixed values -----------------------------------------------------------
# Words that stand for the prefix of a key, before the rest of the key.
PREFIX_WORDS = {
    "sum_": ("sum", "total"),
    "avg_": ("avg", "average"),
    "min_": ("min", "minimum"),
    "max_": ("max", "maximum"),
}
# --- end of fixed values ----------------------------------------------------


def phrase_rules(keys: Mapping[str, str],
                 synonyms: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(template, argument) pairs: how a phrase is made, and from what, per key."""
    rules = [("{}", label) for label in keys.values()] + [("{}", key) for key in keys]
    for key in keys:
        for prefix in (p for p in PREFIX_WORDS if key.startswith(p)):
            rest = key.removeprefix(prefix)
            rules += [(t, rest) for t in ("{}", *(w + " {}" for w in PREFIX_WORDS[prefix]))]
        rules += [("{}", s) for s in synonyms.get(key, ())]
    return rules


def registry_phrases(keys: Mapping[str, str],
                     synonyms: Mapping[str, Sequence[str]] | None = None) -> list[tuple[str, str]]:
    """(phrase, key): every spelling of a registry key, its label and its synonyms.

    Words are joined by spaces; a final y also has its plural.
    """
    out = set()
    for key in keys:
        for template, argument in phrase_rules({key: keys[key]}, synonyms or {}):
            phrase = " ".join(template.format(argument).lower().replace("_", " ").split())
            out |= {(phrase, key)} | ({(phrase[:-1] + "ies", key)} if phrase.endswith("y") else set())
    return sorted(out)


def match_registry(texts: DataFrame, key: str, text: str, keys: Mapping[str, str],
                   synonyms: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Registry keys each text names, by position; a phrase inside a longer
    one does not count."""
    spark = texts.sparkSession
    rows = registry_phrases(keys, synonyms)
    phrases = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("phrase"), F.lit(k).alias("key")) for p, k in rows])).alias("r")
    ).select(fold_key(F.col("r.phrase")).alias("gram"), F.col("r.key").alias("key")).distinct()
    longest = max(len(p.replace("_", " ").split()) for p, _ in rows)
    grams = _ngrams(texts, key, text, longest)
    forms = grams.withColumn("gram", F.explode(F.array_distinct(F.array(
        F.col("gram"), F.regexp_replace("gram", "s$", ""), F.regexp_replace("gram", "es$", "")))))
    hits = forms.join(phrases, "gram").select(
        "id", "key", "start", (F.col("start") + F.col("length")).alias("end"), "length").distinct()
    longer = (F.col("a.id") == F.col("b.id")) & (F.col("b.length") > F.col("a.length")) & (
        F.col("b.start") < F.col("a.end")) & (F.col("a.start") < F.col("b.end"))
    kept = hits.alias("a").join(hits.alias("b"), longer, "left_anti")
    return kept.groupBy("id", "key").agg(F.min("start").alias("position"))
