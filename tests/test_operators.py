from __future__ import annotations

import random
import re
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plumbline.functions import dates as D
from plumbline.functions import numbers as N
from plumbline.functions import text as X
from plumbline.operators import claims as CM
from plumbline.operators import cleaning as CL
from plumbline.operators import dictionary as DI
from plumbline.operators import funnel as FN
from plumbline.operators import insights as I
from plumbline.operators import profiling as P
from plumbline.operators import schema as SC
from plumbline.operators import semantic as S
from plumbline.operators import shaping as SH
from plumbline.operators import upload as U
from plumbline.operators import validation as V
from plumbline.operators import versions as VE
from plumbline.plans import spec
from plumbline.sources import files as FI


def rows(df):
    return [r.asDict() for r in df.collect()]


CAT = S.Catalog(
    "t",
    {m.key: m for m in (
        S.Metric("revenue", "Revenue", "sum", "amount", "ok", "money"),
        S.Metric("raw", "Raw", "sum", "amount", None, "money"),
        S.Metric("orders", "Orders", "count_distinct", "oid", "ok"),
        S.Metric("lines", "Lines", "count", "*", "ok"),
        S.Ratio("per_order", "Lines per order", "lines", "orders"))},
    {d.key: d for d in (S.Dimension("market", "Market", "market"),
                        S.Dimension("month", "Month", "day", "month"))},
    {"time": ("month",)}, "day")


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([
        (1, "EU", "2017-01-31 23:00:00", 100.0, True), (1, "EU", "2017-01-05 00:00:00", 50.0, True),
        (2, "EU", "2017-02-01 00:00:00", 30.0, False), (3, "US", "2017-02-03 00:00:00", 20.0, True),
        (4, None, "2017-02-04 00:00:00", 5.0, False),
    ], "oid int, market string, day string, amount double, ok boolean").withColumn(
        "day", F.col("day").cast("timestamp_ntz"))


def test_gate_is_per_metric_and_ratio_null_over_zero(facts):
    got = rows(S.aggregate(facts, CAT, ["revenue", "raw", "orders", "per_order"], ["market"]))
    assert [r["market"] for r in got] == ["EU", "US", None]
    assert got[0] == {"market": "EU", "revenue": 150.0, "raw": 180.0, "orders": 1, "per_order": 2.0,
                      "n_lines": 3}
    assert got[2]["revenue"] is None and got[2]["per_order"] is None


def test_last_day_of_window_is_whole(facts):
    f = S.Filters("2017-01-01", "2017-01-31")
    assert S.totals(facts, CAT, ["raw"], f).first()["raw"] == 150.0


def test_composites_and_unknown_keys_are_refused(facts):
    with pytest.raises(ValueError):
        S.Metric("x", "X", "sum(a) / sum", "b", "ok")
    with pytest.raises(KeyError, match="revenue"):
        S.aggregate(facts, CAT, ["revenues"])
    with pytest.raises(KeyError):
        S.aggregate(facts, CAT, ["raw"], ["market"], order_by="-orders")


def test_rollup_levels(facts):
    got = rows(S.rollup(facts, CAT, ["market"], ["orders"]))
    assert sorted((r["level"], r["n_lines"]) for r in got) == [(0, 5), (1, 1), (1, 1), (1, 3)]


def test_spec_corrections_and_refusals(facts):
    s = spec.check_spec({"metrics": ["Revenue"], "by": ["month", "Market"], "date_from": "2017-03-01",
                         "date_to": "2017-01-01", "limit": 900}, CAT, facts)
    assert (s.grain, s.by, s.limit, s.date_from, s.date_to) == (
        "month", ["market"], 900, "2017-01-05", "2017-02-04")
    assert spec.check_spec({"metrics": ["raw"], "where": {"market": ["eu"]}}, CAT, facts).where == {
        "market": ["EU"]}
    for bad, code in [({"metrics": ["nope"]}, "unknown_metric"),
                      ({"metrics": ["raw"], "where": {"market": ["Mars"]}}, "unknown_value"),
                      ({"metrics": ["raw"], "date_from": "2030-01-01"}, "out_of_window"),
                      ({"metrics": ["raw"], "notes": ["x"]}, "unknown_field"),
                      ({"metrics": ["raw"], "limit": "ten"}, "unparseable")]:
        with pytest.raises(spec.SpecError) as exc:
            spec.check_spec(bad, CAT, facts)
        assert exc.value.code == code
    assert spec.check_spec({"metrics": "raw", "limit": "10"}, CAT).limit == 10


def test_funnel_keeps_both_sides(spark):
    log = spark.createDataFrame([("field/stream ", "2017-01-02"), ("FIELD STREAM", "2017-01-04"),
                                 ("ghost", "2017-01-03")], "product_name string, viewed_at string"
                                ).withColumn("viewed_at", F.col("viewed_at").cast("timestamp_ntz"))
    facts = spark.createDataFrame(
        [("Field & Stream", 1, "2017-01-02", 9.0, True), ("Field & Stream", 1, "2017-01-03", 1.0, True),
         ("Lamp", 2, "2017-01-04", 4.0, True), ("Field & Stream", 3, "2018-01-01", 9.0, True)],
        "product_name string, order_id int, order_date string, sales double, is_revenue_recognised boolean"
    ).withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))
    got = {r["product_key"]: r for r in rows(FN.funnel(log, facts))}
    assert got["field stream"]["product"] == "Field & Stream"
    assert (got["field stream"]["views"], got["field stream"]["orders"], got["field stream"]["lines"]) == (2, 1, 2)
    assert got["ghost"]["orders"] == 0 and got["ghost"]["view_to_order_pct"] == 0.0
    assert got["lamp"]["views"] == 0 and got["lamp"]["view_to_order_pct"] is None


# --- validation -------------------------------------------------------------

def test_rules_pin_exact_counts_both_ways(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (2, 50)], "id int, qty int")
    rule = lambda n: V.Rule("q", "not_null", expect_violations=n, spec={"column": "qty"})
    assert [V.validate_table(df, "t", [rule(n)]).first()["status"] for n in (1, 0, 2)] == [
        "pass", "FAIL", "FAIL"]
    r = rows(V.validate_table(df, "t", [V.Rule("u", "unique", spec={"column": "id"})]))[0]
    assert (r["n_violations"], r["samples"]) == (2, ["2", "2"][:1] if len(r["samples"]) == 1 else r["samples"])
    e = rows(V.validate_table(df, "t", [V.Rule("e", "expression", "warn", spec={"expr": "qty < 10"})]))[0]
    assert (e["n_checked"], e["n_violations"], e["status"]) == (2, 1, "warn")


def test_rules_are_checked_when_parsed():
    with pytest.raises(ValueError):
        V.Rule("x", "no_such_type")
    with pytest.raises(ValueError):
        V.Rule("x", "range", "fatal")


def test_consistency_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y"), ("b", "y"), (None, "q")],
                               "k string, v string")
    r = rows(V.validate_table(df, "t", [V.Rule("c", "consistency",
                                               spec={"determinant": "k", "dependent": "v"})]))[0]
    assert (r["n_checked"], r["n_violations"], r["samples"]) == (2, 1, ["a"])


def test_row_rules_share_one_aggregate(spark):
    df = spark.range(10).selectExpr("id", "id % 3 AS m")
    rules = [V.Rule(f"r{i}", "range", spec={"column": "m", "max": i}) for i in range(5)]
    plan = V.check_rows(df, "t", rules, samples=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") + plan.count("Range (") <= 2


def test_hot_keys_are_ranked_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 2 AS k", "id AS o")
    plan = CL.dedupe_subset(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# --- cleaning ---------------------------------------------------------------

MINI = CL.policy_from_dict("mini", {
    "key": ["row_id"], "date_formats": ["%m/%d/%Y %H:%M"],
    "row_fixes": [{"id": "shift", "where": "zip is blank and region matches [0-9]{5}",
                   "columns": ["city", "region", "zip"], "do": "shift_right"}],
    "value_maps": {"region": {"west": "West"}},
    "columns": [
        {"source": "Row Id", "clean": "row_id", "type": "integer"},
        {"source": "On", "clean": "ordered_on", "type": "datetime"},
        {"source": "Qty", "clean": "qty", "type": "integer"},
        {"source": "Total", "clean": "total", "type": "money", "nulls": "impute_median"},
        {"source": "zip", "clean": "zip_code", "transform": "zero_pad", "width": 5},
        {"source": "city", "clean": "city"}, {"source": "region", "clean": "region", "type": "category"},
        {"source": "Status", "clean": "status", "type": "category", "nulls": "impute_mode"}],
    "drop": [{"source": "Notes", "reason": "free text"}],
    "derived": [{"name": "each", "type": "ratio", "expr": "try_divide(total, qty)", "null_when": "qty = 0"},
                {"name": "is_revenue", "type": "boolean", "expr": "status <> 'CANCELED'"}],
    "deduplicate": {"strategy": "exact_rows"}})


@pytest.fixture(scope="module")
def mini(spark):
    return spark.createDataFrame([
        ("1", " 1/31/2018 22:56 ", "2", "10.125", "725", "San  Juan", "west", "OK", "n"),
        ("2", "2/1/2018 0:00", "many", "20", "00917", "Caguas", " East ", "OK", "n"),
        ("3", "soon", "0", "n/a", "", "PR", "00725", "CANCELED", "n"),
        ("4", "2/2/2018 1:05", "4", "40", "11111", "X", "East", "-", "n"),
        ("4", "2/2/2018 1:05", "4", "40", "11111", "X", "East", "-", "other note"),
    ], "`Row Id` string, On string, Qty string, Total string, zip string, city string, region string,"
       " Status string, Notes string")


def test_mini_policy_end_to_end(mini):
    out = CL.clean_table(mini, MINI)
    got = {r["row_id"]: r for r in rows(out.clean)}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1]["total"] == 10.12 and got[1]["zip_code"] == "00725" and got[1]["city"] == "San Juan"
    assert got[1]["region"] == "West" and got[1]["each"] == 5.06
    assert got[2]["qty"] is None and got[2]["region"] == "East"
    assert (got[3]["city"], got[3]["region"], got[3]["zip_code"]) == (None, "PR", "00725")
    assert got[3]["total"] == 20.0 and got[3]["each"] is None and got[3]["is_revenue"] is False
    assert got[4]["status"] == "OK"
    assert sorted((r["row_key"], r["column"], r["raw_value"]) for r in rows(out.rejects)) == [
        ("2", "qty", "many"), ("3", "ordered_on", "soon")]
    acts = {(r["step"], r["column"]): r["n"] for r in rows(out.actions)}
    assert acts["deduplicate", "<table>"] == 1
    assert acts["row_fix:shift", "city, region, zip"] == 1
    assert acts["value_map:west", "region"] == 1
    assert acts["sentinel_null", "Total"] == 1 and acts["sentinel_null", "Status"] == 2
    assert acts["reject_cell", "qty"] == 1 and acts["transform:zero_pad", "zip_code"] == 1
    assert not out.warnings.collect()


def test_actions_from_written_flags(spark, tmp_path):
    """More than one packed word of flags; typed rows are not cleaned again for the counts."""
    names = [f"c{k}" for k in range(20)]
    cells = [[f" {k}" if k % 3 else "n/a" for k in range(20)], ["x"] * 20, ["x"] * 20]
    df = spark.createDataFrame([tuple(c) for c in cells], ", ".join(f"{n} string" for n in names))
    policy = CL.Policy("t", tuple(CL.ColumnRule(n, n, "integer") for n in names),
                       deduplicate="exact_rows")
    out = CL.clean_table(df, policy)
    out.quarantined.write.parquet(f"{tmp_path}/typed")
    typed = spark.read.parquet(f"{tmp_path}/typed")
    got = {(r["step"], r["column"]): r["n"] for r in rows(CL.cleaning_actions(df, policy, typed))}
    assert got == {(r["step"], r["column"]): r["n"] for r in rows(out.actions)}
    assert got["deduplicate", "<table>"] == 1
    for k, n in enumerate(names):
        assert got["trim_whitespace", n] == (k % 3 > 0) and got["sentinel_null", n] == (k % 3 == 0)
        assert got["reject_cell", n] == 1 and got["type", n] == (k % 3 > 0)
        assert got["collapse_spaces", n] == 0 and got["nulls:keep_null", n] == 1 + (k % 3 == 0)
    assert CL.finish(typed, policy).columns == names


def test_zero_pad_never_truncates(spark):
    df = spark.createDataFrame([("12345",)], "v string")
    with pytest.raises(Exception, match="longer than zero_pad"):
        df.select(CL.zero_pad(F.col("v"), 3)).collect()
    assert spark.createDataFrame([("-5",)], "v string").select(
        CL.zero_pad(F.col("v"), 4)).first()[0] == "-005"


def test_surrogate_key_is_dense(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v")
    got = {r["v"]: r["k"] for r in CL.surrogate_key(df, "k", ["v"]).collect()}
    assert got == {v: v + 1 for v in range(1000)}


def test_mode_takes_the_smallest_tie_and_median_of_nothing_stays_null(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (1,), (None,)], "v int")
    assert [r[0] for r in CL.impute_mode(df, "v").collect()].count(1) == 3
    assert CL.impute_median(df.filter("v IS NULL"), "v").first()[0] is None


def test_upload_headers_and_mixed_columns(spark):
    assert U.sanitise_headers([" A  b", "a b", "", "Unnamed: 3", None]) == [
        "A b", "a b__1", "column_3", "column_4", "column_5"]
    df = spark.createDataFrame([("$1,200", "10%"), ("$5", "x"), ("n/a", "y")], "m string, p string")
    got = rows(U.clean_upload(df))
    assert [r["m"] for r in got] == [1200.0, 5.0, None] and got[0]["p"] == "10%"


# --- profiling and schema ---------------------------------------------------

def test_profile_finds_the_defects_and_nothing_else(spark):
    df = spark.createDataFrame([
        (f"ORD-{i}", "USA" if i % 3 else " usa", "$5.00" if i % 2 else "6.00 EUR", "x",
         "01/02/2024" if i % 2 else "03/04/2024", "tidy") for i in range(40)] + [
        ("ORD-0", "N/A", "oops", "x", "05/06/2024", "tidy")],
        "order_id string, country string, price string, flag string, day string, word string")
    p = P.profile_table(df, "t")
    found = {(r["column"], r["finding"]) for r in rows(P.column_findings(p.columns()))}
    assert {("order_id", "near-unique key"), ("country", "label variants"),
            ("country", "nulls stored as text"), ("country", "untidy whitespace"),
            ("price", "mixed currencies"), ("price", "type mismatch"), ("flag", "constant column"),
            ("day", "ambiguous date order")} <= found
    assert {f for c, f in found if c == "word"} == {"constant column"}
    verdict = P.readiness(P.risk_register(p.columns(), p.table())).first()
    assert verdict["verdict"] == "NOT READY" and verdict["blocker"] == 2
    p.unpersist()


def test_all_rows_decide_which_text_is_time(spark):
    days = [(f"2024-01-{k % 28 + 1:02d}", None if k else "2024-01-01", None) for k in range(40)]
    df = spark.createDataFrame([*days, ("junk", None, None)],
                               "day string, due_date string, end_date string").coalesce(1)
    got = {r["column"]: r["is_time"] for r in SC.is_time(df).collect()}
    assert got == {"day": False, "due_date": True, "end_date": False}



def test_name_pairs_share_meaning(spark):
    names = SC.column_names({"a": ["Region_Name", "country", "qty"],
                             "b": ["region", "Country_Code", "owner"]}, spark)
    got = {(r["left_column"], r["right_column"]): r["name_score"] for r in rows(SC.name_pairs(names))}
    assert got == {("Region_Name", "region"): 1.0, ("country", "Country_Code"): 1.0}


def test_catalog_for_an_unknown_table(spark):
    df = spark.createDataFrame([(i, f"p{i % 3}", i * 1.5 % 7, f"2024-01-{i % 28 + 1:02d}") for i in range(60)],
                               "order_id int, item_name string, price double, order_date string")
    cat = SC.build_catalog(df, "shop")
    assert set(cat.dimensions) == {"item_name", "year", "quarter", "month", "day"}
    assert {"sum_price", "avg_price", "distinct_order_id", "row_count"} <= set(cat.metrics)


# --- insights ---------------------------------------------------------------

def series(spark, values):
    return spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(values)], "l string, v double")


def test_robust_z_six_points(spark):
    z = [r["z"] for r in I.robust_z(series(spark, [10, 12, 11, 13, 9, 40]), "v").orderBy("l").collect()]
    assert z[0] == pytest.approx(-0.6745) and z[5] == pytest.approx(12.8155)


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 5], [1, 2, 3]])
def test_flat_or_short_series_have_no_score(spark, values):
    assert all(r["z"] is None for r in I.robust_z(series(spark, values), "v").collect())
    assert not I.find_anomalies(series(spark, values), "v", "l").collect()


def test_zero_mad_falls_back_to_mean_deviation(spark):
    z = [r["z"] for r in I.robust_z(series(spark, [10, 10, 10, 10, 10, 22]), "v").orderBy("l").collect()]
    assert z[5] == pytest.approx(12 / (2 / 1.253314))


def test_prior_window():
    assert I.prior_window("2017-03-01", "2017-03-31") == ("2017-01-29", "2017-02-28")
    assert I.prior_window("2017-03-31", "2017-03-01") == ("2017-01-29", "2017-02-28")


def test_movers_keep_arrivals_and_departures(facts):
    got = rows(I.movers(facts, CAT, "raw", "market", S.Filters("2017-02-01", "2017-02-28")))
    assert [(r["market"], r["raw"], r["raw_prior"]) for r in got] == [
        ("EU", 30.0, 150.0), ("US", 20.0, 0.0), (None, 5.0, 0.0)]
    assert got[1]["delta_pct"] is None


def test_segments(spark):
    df = spark.createDataFrame([("a", 500.0), ("b", 250.0), ("c", 150.0), ("d", 75.0), ("e", 25.0)],
                               "d string, v double")
    r = I.concentration_flags(I.segment_summary(df, "v", "d")).first()
    assert (r["top_share_pct"], r["bottom_share_pct"], r["top_3_share_pct"], r["top_vs_median_ratio"]) == (
        50.0, 2.5, 90.0, 3.3)
    assert r["is_concentrated"] and r["is_spread"]


def test_composition_shift_finds_the_step(spark):
    df = spark.createDataFrame([(m * 10 + k, f"2017-{m:02d}-01", True) for m in range(1, 13)
                                for k in range(3 if m < 9 else 1)], "oid int, day string, ok boolean")
    df = df.withColumn("day", F.col("day").cast("timestamp_ntz")).withColumn("oid", F.month("day"))
    r = I.composition_shift(df, CAT, "per_order").first()
    # the earliest split whose later median is the new level
    assert (r["at"].month, r["before"], r["after"], r["n_before"]) == (6, 3.0, 1.0, 5)
    assert not I.composition_shift(df.filter("oid < 9"), CAT, "per_order").collect()


@pytest.mark.parametrize("bucket", [3, 256])
def test_split_medians_equal_plain_medians(spark, monkeypatch, bucket):
    from plumbline.operators import running
    monkeypatch.setattr(running, "BUCKET", bucket)
    draw = random.Random(5)
    rows = [(g, t, draw.choice([None, float("nan"), 1.0, 1.0, draw.uniform(-9, 9)]), "x")
            for g in ("a", None) for t in range(40)] + [("b", 0, None, "x")]
    frame = spark.createDataFrame(rows, "g string, t int, v double, place string")
    got = {(r["g"], r["at"]): r for r in running.split_medians(frame, "t", "v", ["g"]).collect()}
    assert len(got) == len(rows)
    for g, t, *_ in rows:
        held = [(u, v) for h, u, v, _ in rows if h == g and v is not None and v == v]
        sides = [[v for u, v in held if u < t], [v for u, v in held if u >= t]]
        want = [statistics.median(s) if s else None for s in sides]
        r = got[g, t]
        assert (r["place"], r["n"]) == (t + 1, 1 if g == "b" else 40)
        assert [r["before"], r["after"]] == pytest.approx(want)
    whole = running.split_medians(frame.filter("g = 'a'"), "t", "v")
    assert whole.columns == ["at", "place", "n", "before", "after"] and whole.count() == 40
    assert not running.split_medians(frame.limit(0), "t", "v").collect()


def test_shift_per_group(spark):
    df = spark.createDataFrame([(m, f"2017-{m:02d}-01", True, g) for g in ("a", None) for m in range(1, 13)
                                for k in range(3 if (m < 9) == (g is None) else 1)],
                               "oid int, day string, ok boolean, g string")
    df = df.withColumn("day", F.col("day").cast("timestamp_ntz"))
    cat = replace(CAT, dimensions={**CAT.dimensions, "g": S.Dimension("g", "G", "g")})
    got = {r["g"]: (r["before"], r["after"]) for r in
           I.composition_shift(df, cat, "per_order", by=["g"]).collect()}
    assert got == {"a": (1.0, 3.0), None: (3.0, 1.0)}


def test_dense_trend_fills_every_group(spark):
    df = spark.createDataFrame([("2020-01-01", "a", 1.0), ("2020-03-01", None, 2.0), (None, "a", 9.0),
                                ("2020-03-01", None, 3.0), (None, "only null", 4.0)],
                               "d string, g string, v double")
    got = sorted(SH.dense_trend(df, F.col("d"), "g", "v").collect(), key=str)
    assert {(r["period"], r["group"], r["value"]) for r in got} == {
        ("2020-01-01", "a", 1.0), ("2020-01-01", None, 0.0), ("2020-01-01", "only null", 0.0),
        ("2020-03-01", "a", 0.0), ("2020-03-01", None, 5.0), ("2020-03-01", "only null", 0.0)}
    assert len(got) == 6
    assert not SH.dense_trend(df.filter("d IS NULL"), F.col("d"), "g", "v").collect()
    assert not SH.dense_trend(df.limit(0), F.col("d"), "g", "v").collect()


def test_near_spellings_equal_plain_edit_distance(spark):
    draw = random.Random(11)
    word = lambda n: "".join(draw.choice("abAB\u00e9 ") for _ in range(n))
    stored = sorted({word(draw.randint(0, 9)) for _ in range(150)} | {"\u0130stanbul", "aaaa", "abab"})
    asked = [word(draw.randint(0, 9)) for _ in range(25)] + ["istanbul", "aaaaa", ""]
    asked = list(dict.fromkeys(asked))
    frame = spark.createDataFrame([(s,) for s in stored] + [(None,)], "g string")
    cat = replace(CAT, dimensions={"g": S.Dimension("g", "G", "g")})
    got = {r["asked"]: r for r in S.canonical_values(frame, cat, "g", asked, 500).collect()}
    lower = {r["s"]: r["l"] for r in spark.createDataFrame(
        [(s,) for s in {*stored, *asked}], "s string").select("s", F.lower("s").alias("l")).collect()}
    for a in asked:
        same = [s for s in stored if lower[s] == lower[a]]
        assert got[a]["known"] == bool(same)
        near = sorted((edits(lower[s], lower[a]), s) for s in stored
                      if 0.6 * len(a) - 1e-9 <= len(s) <= len(a) / 0.6 + 1e-9
                      and edits(lower[s], lower[a]) <= 0.4 * max(len(s), len(a)))
        want = [] if same else [s for _, s in near]
        assert sorted((got[a]["nearest"] or "").split(", ")) == sorted(want or [""]), a


def edits(a: str, b: str) -> int:
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        held, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            held, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, held + (x != y))
    return line[-1]


def test_pages_by_key_give_every_row_once(spark):
    draw = random.Random(9)
    frame = spark.createDataFrame([(i, draw.choice(["a", "b", None]), draw.choice([None, 1.0, 2.0]))
                                   for i in range(37)], "i int, g string, v double")
    for keys in (["g", "-v", "i"], ["-g", "v", "-i"]):
        seen, last = [], None
        while page := SH.page_after(frame, keys, last, 8).collect():
            seen += page
            last = [page[-1][k.removeprefix("-")] for k in keys]
        whole = SH.page_after(frame, keys, size=100).collect()
        assert seen == whole and len(seen) == 37 and {r["i"] for r in seen} == set(range(37))
    with pytest.raises(ValueError):
        SH.page_after(frame, ["g", "i"], ["a"])


def test_key_pairs_equal_all_pairs_of_names():
    draw = random.Random(3)
    pool = ["id", "ID ", "_id", "id_id", "user_id", "User", "user", "idle", "order_id", "order", "x", "a_id_b", "a_b"]
    for _ in range(50):
        tables = {t: draw.sample(pool, draw.randint(0, 6)) for t in "abc"}
        refs = [(i, t, c, c.lower().strip()) for i, (t, cols) in enumerate(tables.items()) for c in cols]
        want = {(s, a, t, b, x == y) for i, s, a, x in refs for j, t, b, y in refs if i < j and (
            x == y or (x.endswith("_id") and y == "id") or (y.endswith("_id") and x == "id")
            or ("id" in x and x.replace("_id", "") == y.replace("_id", "")))}
        got = [tuple(r) for r in SC.key_pairs(tables)]
        assert len(got) == len(set(got)) and set(got) == want


def test_only_paired_columns_are_read(spark, tmp_path):
    for name, cols in (("left", "id AS customer_id, id AS zone, 'x' AS memo"),
                       ("right", "id * 2 AS customer_id, id AS height")):
        spark.range(10).selectExpr(*cols.split(", ")).write.parquet(f"{tmp_path}/{name}")
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("left", "right")}
    types = spark.createDataFrame([("left", "customer_id", "integer")],
                                  "table string, column string, inferred_type string")
    for made in (SC.match_columns(tables, types), SC.candidate_joins(tables)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        scans = [line for line in plan.splitlines() if "Relation" in line]
        assert scans
        read = made._jdf.queryExecution().executedPlan().toString()
        assert "customer_id" in read and not any(c in read for c in ("zone", "memo", "height"))
        (row,) = made.collect()
        assert row["overlap"] == 0.5
    apart = {"a": tables["left"].select("zone"), "b": tables["right"].select("height")}
    assert not SC.match_columns(apart, types).collect()
    assert not SC.candidate_joins(apart).collect()


def test_other_and_paging(spark):
    df = spark.range(10).selectExpr("concat('g', id) AS g", "cast(id AS double) AS v")
    got = rows(SH.top_n_with_other(df, "g", "v", 3))
    assert [(r["label"], r["value"]) for r in got] == [("g9", 9.0), ("g8", 8.0), ("g7", 7.0), ("Other", 21.0)]
    page = rows(SH.page_rows(df, "v", True, 2, 4))
    assert [r["v"] for r in page] == [5.0, 4.0, 3.0, 2.0] and page[0]["total_pages"] == 3


# --- versions and text ------------------------------------------------------

def test_content_hash_ignores_order_but_not_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    h = lambda d: d.agg(VE.content_hash(d).alias("h")).first()["h"]
    assert h(df) == h(df.orderBy(F.desc("k")))
    assert len({h(df), h(df.union(df)), h(df.withColumnRenamed("v", "w")),
                h(df.withColumn("k", F.col("k").cast("long"))), h(df.limit(1))}) == 5


def test_claims_are_read_and_checked(spark):
    texts = spark.createDataFrame([
        (1, "Top 3 markets: revenue of $35.2k in Jan 2018, up 10.8% to 1,234 orders"),
        (2, "Revenue was $99.00")], "id int, t string")
    got = {(r["id"], r["literal"]): r for r in rows(CM.extract_claims(texts, "id", "t"))}
    assert got[1, "Top 3"]["is_top_n"] and got[1, "Top 3"]["kind"] == "integer"
    money = got[1, "$35.2k"]
    assert (money["value"], money["kind"]) == (35200.0, "money")
    assert money["tolerance"] == pytest.approx(50.0)
    assert got[1, "10.8%"]["kind"] == "percent" and got[1, "1,234"]["value"] == 1234.0
    result = spark.createDataFrame([(1, "a", 35210.0), (1, "b", 1.0), (1, "c", 2.0), (2, "a", 50.0)],
                                   "id int, l string, revenue double")
    cands = CM.claim_candidates(result, "id", {"revenue": "money"}, ["l"])
    held = {(r["id"], r["literal"]): r["holds"]
            for r in rows(CM.verify_claims(CM.extract_claims(texts, "id", "t"), cands))}
    assert held[1, "$35.2k"] and held[1, "Top 3"] and not held[2, "$99.00"] and not held[1, "1,234"]


def test_claims_about_long_results_and_pairs_of_rows(spark):
    """Sixty rows: shares are of the true total, and any two rows may be compared."""
    result = spark.createDataFrame([(1, k, float(1000 + 37 * k * k)) for k in range(60)],
                                   "id int, k int, revenue double")
    v = [1000.0 + 37 * k * k for k in range(60)]
    said = [(f"share {100 * v[55] / sum(v):.3f}%", True), (f"gap ${v[58] - v[41]:,.2f}", True),
            (f"ratio {100 * v[57] / v[50]:.3f}%", True),
            (f"change {100 * (v[59] / v[44] - 1):.3f}%", True), ("gap $1.55", False),
            (f"head {100 * v[3] / sum(v[:30]):.6f}%", False)]
    texts = spark.createDataFrame([(1, t) for t, _ in said], "id int, t string")
    numbered = texts.withColumn("key", F.struct("id", "t"))
    claims = CM.extract_claims(numbered, "key", "t").withColumns(
        {"claim_no": F.col("id.t"), "id": F.col("id.id")})
    order = ["k"]
    cands = CM.claim_candidates(result, "id", {"revenue": "money"}, order)
    values = CM.claim_values(result, "id", {"revenue": "money"}, order)
    held = {r["claim_no"]: r["holds"] for r in rows(CM.verify_claims(claims, cands, values))}
    assert held == dict(said)


def test_hash_tells_where_nulls_are(spark):
    a = spark.createDataFrame([(1, None), (2, 5)], "x int, y int")
    b = spark.createDataFrame([(None, 1), (2, 5)], "x int, y int")
    h = lambda df: df.agg(VE.content_hash(df)).first()[0]
    assert h(a) != h(b) and h(a) == h(a.orderBy("x", ascending=False))


def test_a_failing_rule_stops_no_other(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0), (2, 4.0, 2.0)], "id int, a double, b double")
    rules = [V.Rule("ok", "range", spec={"column": "a", "max": 3}),
             V.Rule("ratio", "expression", spec={"expr": "a / b > 0"}),
             V.Rule("key", "unique", spec={"column": "id"})]
    got = {r["rule_id"]: r for r in rows(V.validate_table(df, "t", rules))}
    assert "DIVIDE_BY_ZERO" in got["ratio"]["error"] and got["ratio"]["status"] == "FAIL"
    assert got["ok"]["n_violations"] == 1 and got["key"]["status"] == "pass"
    missing = rows(V.validate({}, {"t": {"min_rows": 1}}))
    assert [(r["rule_id"], r["status"]) for r in missing] == [("missing_table", "FAIL")]


def test_every_file_is_loaded_or_reported(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "sub" / "x.csv").write_text('a,b\n3,"4\n5"\n6,7\n')
    (tmp_path / "empty one.csv").write_text("")
    loaded = FI.load_all(spark, str(tmp_path))
    assert sorted(loaded.tables) == ["x", "x_2"]
    assert sorted(t.count() for t in loaded.tables.values()) == [1, 2]
    assert [(r["file"], r["detail"]) for r in rows(loaded.problems)] == [
        ("empty one.csv", "empty file")]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_notation_rates_only_match_cells(spark):
    cells = ["$1,200.5", "1,2e3", "5 %", "x", ".", "$ -.5", "1 2", None]
    df = spark.createDataFrame([(c,) for c in cells], "v string")
    got = rows(U.notation_rates(df))[0]
    for name in U.NOTATIONS:
        assert got[name + "_parsed"] == df.where(U.bare_number(F.col("v"), name).isNotNull()).count()
    assert "regexp_replace" not in plan_of(U.notation_rates(df))


def test_columns_of_a_profile_are_never_gathered(spark):
    df = spark.createDataFrame([(f"w {i}", "A b" if i % 2 else "a B") for i in range(9)], "k string, v string")
    p = P.profile_table(df)
    assert rows(P.label_variants(p.values, p.types)) == [
        {"column": "v", "folded": "ab", "variants": ["A b", "a B"]}]
    for frame in (P.type_mismatches(p.values, p.types), P.label_variants(p.values, p.types)):
        assert "strategy=broadcast" in plan_of(frame)
    p.unpersist()


def test_quadrants_compare_points_with_their_own_medians(spark):
    other = F.udf(lambda i: i + random.random(), "double").asNondeterministic()
    df = spark.range(25).select("id", other("id").alias("x"), (-F.col("id")).alias("y"))
    got = rows(SH.median_quadrants(df, "x", "y"))
    assert sorted(r["x"] for r in got)[12] == got[0]["x_median"]
    assert sum(r["quadrant"].endswith("high x") for r in got) == 13


def test_foreign_labels_allow_names_inside_own_names(spark):
    texts = spark.createDataFrame([(1, "Women's Apparel leads; Africa trails")], "id int, t string")
    own = spark.createDataFrame([(1, "Women's Apparel")], "id int, label string")
    known = spark.createDataFrame([("Apparel",), ("Africa",), ("EU",)], "label string")
    assert [r["label"] for r in rows(CM.foreign_labels(texts, "id", "t", own, known))] == ["Africa"]


def test_registry_prefers_longer_phrases(spark):
    texts = spark.createDataFrame([(1, "late rate by customer segments and orders")], "id int, t string")
    keys = {"late_pct": "Late rate", "segment": "Customer segment", "orders": "Orders", "rate": "Rate"}
    got = rows(CM.match_registry(texts, "id", "t", keys).orderBy("position"))
    assert [r["key"] for r in got] == ["late_pct", "segment", "orders"]


def test_surrogate_key_with_one_value_in_most_rows(spark):
    df = spark.createDataFrame([(1 if i % 10 else i, "same" if i % 3 else str(i)) for i in range(3000)],
                               "k long, v string").repartition(4)
    rows = CL.surrogate_key(df, "id", ["k"]).collect()
    assert sorted(r.id for r in rows) == list(range(1, 3001))
    assert [r.k for r in sorted(rows, key=lambda r: r.id)] == sorted(r.k for r in rows)


def test_labels_claim_nothing(spark):
    texts = spark.createDataFrame([
        (1, "Brand#12 sold 12"), (2, "brand#123 sold 4 and BRAND#12, Brand#12."), (3, "no label 7"),
        (4, None), (5, "Brand#12 deluxe 3 of 9")], "id long, t string")
    names = spark.createDataFrame([("Brand#12",), ("Brand#12 deluxe 3",), (None,), ("plain",),
                                   ("12",)], "label string").where("label <> '12'")
    got = {}
    for r in CM.extract_claims(texts, "id", "t", names).collect():
        got.setdefault(r["id"], []).append(r["value"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [12.0], 2: [4.0, 123.0], 3: [7.0], 5: [9.0]}


def test_marks_and_short_forms_agree_with_the_long_ones(spark):
    draw = random.Random(5)
    spaces = " \t\n\u2003\xa0\x1c"
    word = lambda: "".join(draw.choice("ab-" + spaces + "   ") for _ in range(draw.randint(0, 7)))
    texts = sorted({word() for _ in range(400)} | {"n/a", " NA ", "a  b", "a b", ""})
    df = spark.createDataFrame([(s,) for s in texts], "v string")
    for trim, collapse in ((True, True), (True, False), (False, True), (False, False)):
        policy = CL.Policy("t", (CL.ColumnRule("v", "v"),), defaults={
            "trim_whitespace": trim, "collapse_internal_spaces": collapse})
        acts = {r["step"]: r["n"] for r in rows(CL.cleaning_actions(df, policy))}
        cut = [s.strip() if trim else s for s in texts]
        one = [re.sub(r"\s+", " ", s) if collapse else s for s in cut]
        gone = [s.lower() in X.POLICY_SENTINELS for s in one]
        touched = [g or s != t for g, s, t in zip(gone, texts, one)]
        assert acts["trim_whitespace"] == sum(a != b for a, b in zip(texts, cut))
        assert acts["collapse_spaces"] == sum(a != b for a, b in zip(cut, one))
        assert acts["sentinel_null"] == sum(gone) and sum(touched) < len(texts)
    tidy = {r["v"]: r["t"] for r in rows(df.withColumn("t", X.tidy(F.col("v"))))}
    assert tidy == {s: re.sub(r"\s+", " ", s.strip()) for s in texts}

    numbers = ["-0", "-0.00", "+1.5", "1.005", "2.675", "1e2", ".5", "5.", "x", "999999999999.99",
               "9999999999999.99", "123456789012345678.125", "-7.125", "0.015"]
    n = spark.createDataFrame([(s,) for s in numbers], "v string").select(
        "v", CL.coerce_number(F.col("v"), 2).cast("string").alias("got"),
        F.bround(N.parse_double(F.col("v")), 2).cast("string").alias("want"))
    assert [r["got"] for r in rows(n)] == [r["want"] for r in rows(n)]
    days = ["2020-02-29", "2021-02-29", "2020-2-9", "20200-01-01", "2020-01-01 ", "0000-01-01", "2020-13-01"]
    d = spark.createDataFrame([(s,) for s in days], "v string").select(
        D.parse_exact(F.col("v"), "%Y-%m-%d").cast("string").alias("d"))
    assert [r["d"] for r in rows(d)] == ["2020-02-29 00:00:00", None, "2020-02-09 00:00:00", None, None,
                                         "0000-01-01 00:00:00", None]


def test_dictionary_counts_values_once(spark):
    from test_jobs import counted
    df, seen = counted(spark, [(i, i % 20, i % 12, None) for i in range(60)],
                       "a bigint, b bigint, c bigint, d bigint")
    got = {r["column"]: r for r in rows(DI.measure_columns(df, "t", ["b"]))}
    assert seen.value == 2 * 60  # the counts, and the ends of ordered columns
    assert [got[c]["n_distinct"] for c in "abcd"] == [60, 20, 12, 0]
    assert [got[c]["examples"] for c in "abcd"] == ["0|1|10", None, "0|1|10", None]
    assert [got[c]["vocabulary"] for c in "abcd"] == [
        None, None, "|".join(sorted(map(str, range(12)))), None]
    assert got["d"]["n_nulls"] == got["d"]["n_rows"] == 60 and got["a"]["maximum"] == "59"
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (-0.0,)], "z double")
    assert (rows(DI.measure_columns(zeros, "t"))[0]["n_distinct"],
            rows(DI.measure_columns(zeros, "t"))[0]["examples"]) == (2, "-0.0|0.0")
