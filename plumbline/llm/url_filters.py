"""URL filters: host and path rules, and decisions shared by redirect equivalence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Query parameters that mark where a visit came from, not what it shows.
TRACKING = r"(?i)(?<=[?&])(utm_[a-z]+|gclid|fbclid)=[^&#]*&?"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def spelling(url: Column) -> Column:
    """The address that plain redirects of one page lead to.

    Scheme and leading ``www.`` go, and so do the fragment, tracking
    parameters and a closing slash; the host is lower-cased.
    """
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "[?&]$", "")
    return F.concat(F.regexp_replace(host_of(url), "^www\\.", ""),
                    F.regexp_replace(path_of(url), "/+$", ""), bare)


def resolved(target: Column, url: Column) -> Column:
    """A link target as an absolute address; null when there is none."""
    root = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    return (F.when(target == "", None).when(target.contains("://"), target)
            .when(target.startswith("//"), F.concat(F.lit("http:"), target))
            .when(target.startswith("/"), F.concat(root, target))
            .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target)))


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, rule, verdict`` of the longest rule that fits, for urls that one fits.

    A host is looked up under each of its dot suffixes, so the rule table may
    be as long as it likes.
    """
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    named = urls.select("url", host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"))
    looked = named.select("url", "path", F.explode(tails).alias("tail"))
    fits = looked.join(rules, (F.col("tail") == F.col("rule_host"))
                       & F.expr("startswith(path, rule_path)"))
    size = F.length(F.concat("rule_host", "rule_path"))
    return fits.groupBy("url").agg(
        F.max(F.struct(size, F.concat("rule_host", "rule_path").alias("rule"),
                       F.col("rule_verdict").alias("verdict"))).alias("m")).select(
        "url", "m.rule", "m.verdict")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, component``, one row per row of pages.

    ``rules`` are (host, path prefix, ``allow`` or ``block``); the longest that
    fits decides.  Other pages take the decision of their class: addresses
    joined by redirects (plain spellings, every ``meta refresh``) and all
    canonical links.  A class that holds an allowed address is allowed, else one that
    holds a blocked address is blocked, else it is allowed.  Addresses that
    are only linked to count as members.  A null url, or one without ``://``,
    has an empty host and path and is allowed with no component unless the
    empty host has a rule; a null html has no links.  Repeated rows get
    repeated results; extra columns are ignored; no rows give no rows.
    """
    spark = pages.sparkSession
    book = spark.createDataFrame(
        [(h, p, v) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string")
    html = F.coalesce(F.col(html_col), F.lit(""))

    def targets(element: str, part: str) -> Column:
        return F.transform(F.regexp_extract_all(html, F.lit(element), F.lit(0)), lambda e: resolved(
            F.regexp_extract(e, part, 1), F.col(url_col)))

    read = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.array_compact(F.concat(targets(CANONICAL, HREF), targets(REFRESH, TARGET))).alias("to"))
    linked = read.where("contains(url, '://') and size(to) > 0").select(
        "url", F.explode("to").alias("target"))
    addresses = (read.where("contains(url, '://')").select("url")
                 .unionByName(linked.select(F.col("target").alias("url"))).distinct()
                 .withColumn("page", spelling(F.col("url"))))
    classes = components(linked.select(spelling(F.col("url")).alias("a"),
                                       spelling(F.col("target")).alias("b")), "a", "b")
    decided = (addresses.join(matched_rules(addresses, book), "url", "left")
               .join(classes.withColumnRenamed("node", "page"), "page", "left")
               .withColumn("component", F.coalesce("component", "page")))
    shared = decided.groupBy("component").agg(
        F.max(F.when(F.col("verdict") == "allow", 2).when(F.col("verdict") == "block", 1)
              .otherwise(0)).alias("stance"))
    known = decided.join(shared, "component").select(
        "url", "rule", "component", F.coalesce(
            "verdict", F.when(F.col("stance") == 1, "block").otherwise("allow")).alias("verdict"))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).join(
        known, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "component")
