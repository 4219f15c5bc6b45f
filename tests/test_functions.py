from __future__ import annotations

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import dates as D
from plumbline.functions import format as X
from plumbline.functions import numbers as N
from plumbline.functions import text as T
from plumbline.operators.quantiles import median, quantiles


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_strip_and_collapse_match_python(spark):
    values = ["  a b ", "\t x\n", "\xa0nbsp\xa0", " em  sp ", "plain", "", "a  b\t c", "é  ü"]
    assert column(spark, values, T.strip) == [v.strip() for v in values]
    assert column(spark, values, T.tidy) == [" ".join(v.split()) for v in values]


def test_title_case_matches_python(spark):
    values = ["o'neil co-op", "MC2X test", "été à paris", ""]
    assert column(spark, values, T.title_case) == [v.title() for v in values]


def test_fold_key_joins_spellings(spark):
    assert column(spark, ["Field & Stream ", "field/stream", "FIELD   stream"], T.fold_key) == [
        "field stream"] * 3


def test_normalise_category_folds_accents(spark):
    assert column(spark, ["Café_crème", "cafe-creme", "CAFE. CREME", "ﬁne"], T.normalise_category) == [
        "cafecreme", "cafecreme", "cafecreme", "fine"]


@pytest.mark.parametrize("value, tag", [
    ("550e8400-e29b-41d4-a716-446655440000", "uuid"), ("a@b.co", "email"), ("www.x.y", "url"),
    ("10 %", "percent"), ("$1,200.50", "currency"), ("(12.50)", "currency"), ("12 USD", "currency"),
    ("2024-01-31", "date"), ("20240131", "date"), ("1.5e10", "decimal"), ("1,200", "integer"),
    ("12.5", "decimal"), ("+1 (555) 123-4567", "phone"), ("hello", "text"), ("  ", "blank")])
def test_classify_value(spark, value, tag):
    assert column(spark, [value], N.classify_value) == [tag]


def test_to_number(spark):
    values = ["$1,200", "(12.50)", "10%", "7 EUR", "1e3", "x", "5d", ""]
    assert column(spark, values, N.to_number) == [1200.0, -12.5, 10.0, 7.0, 1000.0, None, None, None]


@pytest.mark.parametrize("fmt", [f for f, _ in D.DATE_FORMATS])
def test_every_date_format_reads_what_it_writes(spark, fmt):
    at = datetime(2015, 3, 14, 9, 26, 53, 589000)
    text = at.strftime(fmt)
    assert column(spark, [text], lambda c: D.parse_exact(c, fmt)) == [datetime.strptime(text, fmt)]


def test_dates_are_exact(spark):
    assert column(spark, ["2024-02-31", "2024-1-2", "24-01-02", "2024-01-02 "],
                  lambda c: D.parse_exact(c, "%Y-%m-%d")) == [None, datetime(2024, 1, 2), None, None]
    assert column(spark, ["1/2/75", "1/2/68"], lambda c: D.parse_exact(c, "%m/%d/%y")) == [
        datetime(1975, 1, 2), datetime(2068, 1, 2)]


def test_unusable_format_fails_early():
    with pytest.raises(ValueError):
        D.compile_format("%Q-%m")


def test_formatting(spark):
    values = [None, -40.0, 1234567.0, 2.5, 3.5]
    assert column(spark, values, lambda c: X.fmt(c, "money", True), "double") == [
        "n/a", "-$40.00", "$1.23M", "$2.50", "$3.50"]
    assert column(spark, values, lambda c: X.fmt(c, "count"), "double") == [
        "n/a", "-40", "1,234,567", "2", "4"]
    assert column(spark, [-0.4, 3.0], lambda c: X.fmt_delta(c, "percent"), "double") == ["-0.4%", "+3.0%"]


def test_only_shapes_of_formats_reach_the_date_parsers(spark):
    at = datetime(2021, 3, 4, 5, 6, 7, 800)
    dates = [at.strftime(f) for f, _ in D.DATE_FORMATS]
    assert column(spark, dates, D.could_be_date) == [True] * len(dates)
    others = ["K-123", "12.50", "$1,234.50", "a b", "1234567", "2021-03-04x"]
    assert column(spark, others, D.could_be_date) == [False] * len(others)
    assert column(spark, ["04/03/2021", " 4  Mar 2021 ", "K-1"], D.matching_formats) == [
        ["%m/%d/%Y", "%d/%m/%Y"], ["%d %b %Y"], []]


def test_fmt_keeps_the_sign_of_a_negative_zero(spark):
    for unit, shown in (("percent", "-0.0%"), ("days", "-0.00 days"), ("ratio", "-0.00"),
                        ("money", "$0.00"), ("count", "0")):
        assert column(spark, [-0.0], lambda c, u=unit: X.fmt(c, u), "double") == [shown]
    assert column(spark, [-0.0], lambda c: X.fmt_change(c, "percent"), "double") == ["-0.0 pp"]
    assert column(spark, [-0.0], lambda c: X.fmt_delta(c, "money"), "double") == ["+$0.00"]


def test_short_label(spark):
    assert column(spark, ["a" * 44, "b" * 45], T.short_label) == ["a" * 44, "b" * 43 + "…"]


def test_quantiles_match_numpy(spark):
    rng = random.Random(3)
    sets = {
        "spread": [rng.uniform(-1e6, 1e6) for _ in range(501)],
        "narrow": [1.6e9 + rng.randrange(86400) for _ in range(500)],
        "tail": [rng.paretovariate(0.5) for _ in range(333)],
        "same": [7.0] * 50,
        "one": [3.0],
    }
    rows = [(k, v) for k, vs in sets.items() for v in vs] + [("spread", None), ("tail", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    for r in quantiles(df, "v", probs, ["k"]).collect():
        want = np.quantile(sets[r["k"]], probs)
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], want, rtol=1e-9)
        assert r["n"] == len(sets[r["k"]])
    whole = [v for vs in sets.values() for v in vs]
    assert median(df, "v").first()["median"] == pytest.approx(np.median(whole))
    assert median(df.limit(0), "v").first()["median"] is None


def test_quantiles_of_values_in_one_narrow_range(spark):
    rng = np.random.default_rng(9)
    near = 1000 + rng.random(20_000) * 1e-7
    values = np.concatenate([near, rng.random(200) * 1e9, 1000 + rng.random(50) * 10, [-5.0, 0.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.98, 1.0]
    got = quantiles(df, "v", probs).first()
    assert [got[f"q{i}"] for i in range(len(probs))] == pytest.approx(
        list(np.quantile(values, probs)), rel=1e-15)
    assert got["n"] == len(values)
