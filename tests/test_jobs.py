from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cleaning as CL
from plumbline.plans import publish as PB
from plumbline.sources import files as FI
from plumbline.streaming.clean import clean_stream


@pytest.fixture
def raw_dir(tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "orders.csv").write_text("id,name,name\n1,NA,\"a,b\"\n2,,x\n", encoding="utf-8")
    (d / "cp.tsv").write_bytes("id\tcity\n1\tMálaga\n".encode("cp1252"))
    (d / "wrapped.json").write_text(json.dumps(
        {"meta": [{"v": 1}], "rows": [{"a": {"b": 1}, "c": "x"}, {"a": {"b": 2}, "c": None}]}))
    (d / "lines.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    (d / ".hidden.csv").write_text("a\n1\n")
    (d / "notes.md").write_text("no")
    (d / "broken.parquet").write_text("not parquet")
    return str(d)


def test_discovery_and_loading(spark, raw_dir):
    found = [r["file"] for r in FI.discover_sources(spark, raw_dir).collect()]
    assert found == ["broken.parquet", "cp.tsv", "lines.jsonl", "orders.csv", "wrapped.json"]
    loaded = FI.load_all(spark, raw_dir)
    orders = [r.asDict() for r in loaded.tables["orders"].collect()]
    assert orders == [{"id": "1", "name": "NA", "name__dup1": "a,b"},
                      {"id": "2", "name": "", "name__dup1": "x"}]
    assert loaded.tables["cp"].first()["city"] == "Málaga"
    assert [r.asDict() for r in loaded.tables["wrapped"].collect()] == [
        {"a.b": "1", "c": "x"}, {"a.b": "2", "c": ""}]
    assert loaded.tables["lines"].count() == 2
    assert [(r["kind"], r["file"]) for r in loaded.problems.collect()] == [("failed", "broken.parquet")]


def test_encoding_and_delimiter(spark, raw_dir):
    enc = {r["path"].rsplit("/", 1)[1]: r["encoding"]
           for r in FI.detect_encoding(spark, raw_dir + "/cp.tsv").union(
               FI.detect_encoding(spark, raw_dir + "/orders.csv")).collect()}
    assert enc == {"cp.tsv": "cp1252", "orders.csv": "utf-8"}
    lines = spark.createDataFrame([("a;b,c;d",), ("1;2;3",), ("4;5;6",)], "value string")
    assert FI.sniff_delimiter(lines).first()["delimiter"] == ";"
    assert FI.sniff_delimiter(lines.limit(0), ".psv").first()["delimiter"] == "|"


def test_all_lines_decide_delimiter_and_json_mode(spark, tmp_path):
    lines = spark.createDataFrame([("x,y",)] * 1000 + [("a;b;c",)] * 9000, "value string").coalesce(1)
    assert FI.sniff_delimiter(lines).first()["delimiter"] == ";"
    path = tmp_path / "a.json"
    path.write_text('{"a": 1\n' + '{"a": 2}\n' * 10)
    assert FI._one_record_per_line(spark, str(path))
    path.write_text('{"a": 1}\n{"a": 2}\n' + "{\n}\n" * 10)
    assert not FI._one_record_per_line(spark, str(path))


def test_each_file_of_a_folder_has_its_own_encoding(spark, tmp_path):
    where = tmp_path / "in [1]"
    where.mkdir()
    (where / "a b.csv").write_bytes("k,v\n1,café\n".encode("cp1252"))
    (where / "b.csv").write_bytes("k,v\n2,größe\n".encode())
    (where / "c.csv").write_bytes(b"k,v\n3,\x81\xe9\n")
    got = {r["k"]: r["v"] for r in FI.read_delimited(spark, str(tmp_path / "in*")).collect()}
    assert got == {"1": "café", "2": "größe", "3": "\x81é"}


def test_configured_sources_have_three_problem_kinds(spark, raw_dir):
    policy = CL.Policy("orders", (CL.ColumnRule("id", "id"),))
    broken = CL.Policy("broken", (CL.ColumnRule("id", "id"),))
    got = FI.load_configured(spark, raw_dir, {"orders": policy, "broken": broken}, {"cp": "not needed"})
    assert list(got.tables) == ["orders"]
    assert {(r["kind"], r["file"]) for r in got.problems.collect()} == {
        ("skipped", "cp.tsv"), ("failed", "broken.parquet"),
        ("unconfigured", "lines.jsonl"), ("unconfigured", "wrapped.json")}


def test_loading_what_tasks_without_rows_wrote(spark):
    from conftest import TESTDATA
    from plumbline.plans.queries.sources import src_07
    if not (TESTDATA / "sf0.001").exists():
        pytest.skip("no test tables")
    split = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in split}
    try:
        for k, v in split.items():
            spark.conf.set(k, v)
        assert src_07(spark, str(TESTDATA / "sf0.001")).first()["n_problems"] == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_names():
    assert FI.sanitise_table_name("My Sales (2024).csv") == "my_sales_2024"
    assert FI.sanitise_table_name("???.csv") == "dataset"
    assert FI.dedupe_headers(["x", "y", "x", "x"]) == ["x", "y", "x__dup1", "x__dup2"]


POLICY = CL.Policy("sales", (CL.ColumnRule("id", "id", "integer"),
                             CL.ColumnRule("amount", "amount", "money")), key_columns=("id",))
RULES = {"sales": {"min_rows": 1, "rules": [{"id": "positive", "type": "range", "column": "amount",
                                             "min": 0}]}}


def sales(spark, *amounts):
    return spark.createDataFrame([(str(i), a) for i, a in enumerate(amounts)], "id string, amount string")


def test_publish_refuse_force_and_drift(spark, tmp_path):
    snaps = str(tmp_path / "snaps")

    def run(version, force, *amounts):
        return PB.publish(spark, {"sales": sales(spark, *amounts)}, {"sales": POLICY}, RULES,
                          str(tmp_path / ("work" + version)), snaps, force=force, version=version)

    first = run("20240101T000000", False, "1", "2", "x")
    ids = {r["id"] for r in first.alerts.collect()}
    assert first.version and ids == {"drift:first", "rejects:sales"}
    refused = run("20240102T000000", False, "-1")
    assert refused.version is None and "rule:sales.positive" in {r["id"] for r in refused.alerts.collect()}
    assert [r["version"] for r in FI.list_versions(spark, snaps).collect()] == ["20240101T000000"]
    forced = run("20240103T000000", True, "-1")
    assert forced.forced and "drift:rows:sales" in {r["id"] for r in forced.alerts.collect()}
    assert FI.list_versions(spark, snaps).orderBy(F.desc("version")).first()["notes"].startswith("forced")
    assert FI.read_snapshot(spark, snaps)["sales"].count() == 1
    assert FI.read_snapshot(spark, snaps, "20240101T000000")["sales"].count() == 3
    assert forced.dictionary.count() == 2
    runs = {r["run"]: (r["version"], r["forced"]) for r in PB.list_runs(spark, snaps).collect()}
    assert runs == {"20240101T000000": ("20240101T000000", False), "20240102T000000": (None, False),
                    "20240103T000000": ("20240103T000000", True)}
    kept = PB.read_report(spark, snaps, "alerts", "20240102T000000")
    assert {r["id"] for r in kept.collect()} == {r["id"] for r in refused.alerts.collect()}
    assert PB.read_report(spark, snaps, "actions", "20240102T000000").count() > 0
    with pytest.raises(FileNotFoundError):
        PB.read_report(spark, snaps, "alerts", "20240109T000000")
    assert not [p for p in tmp_path.rglob("_staging_*")]


def test_missing_snapshot_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        FI.read_snapshot(spark, str(tmp_path / "none"))


def test_exports(spark, tmp_path):
    df = spark.range(3)
    FI.export_csv(df, str(tmp_path / "c"))
    FI.export_json(df, str(tmp_path / "j"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 3
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_stream_quarantines_cells(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    sales(spark, "1", "x", "3").write.json(src)
    stream = spark.readStream.schema("id string, amount string").json(src)
    q = clean_stream(stream, POLICY, out, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(out + "/sales").count() == 3
    assert [r["raw_value"] for r in spark.read.parquet(out + "/sales__rejects").collect()] == ["x"]


def counted(spark, rows, schema):
    """A frame and the number of its rows that were read so far."""
    seen = spark.sparkContext.accumulator(0)

    def see(row):
        seen.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(see), schema), seen


def test_a_table_is_cleaned_once_for_all_it_writes(spark, tmp_path):
    rows = [(str(i), f" {i}.5 " if i % 3 else "x") for i in range(30)]
    df, seen = counted(spark, rows, "id string, amount string")
    policy = CL.Policy("sales", POLICY.columns, deduplicate="exact_rows")
    paths = FI.write_clean(CL.clean_table(df, policy), str(tmp_path), actions=True)
    assert seen.value == 30
    acts = {(r["step"], r["column"]): r["n"] for r in spark.read.parquet(paths["actions"]).collect()}
    assert acts["deduplicate", "<table>"] == 0 and acts["trim_whitespace", "amount"] == 20
    assert acts["reject_cell", "amount"] == 10
    assert spark.read.parquet(paths["clean"]).count() == 30


@pytest.mark.parametrize("strategy", ["exact_rows", "subset", None])
@pytest.mark.parametrize("few", [500_000, 0])
def test_duplicates_among_written_rows(spark, tmp_path, monkeypatch, strategy, few):
    """Rows that are one after trimming, rows that only type alike, nulls, an order column."""
    cells = [("1", "5", "a"), (" 1", "5 ", "a"), ("1", "05", "a"), ("1", "many", "a"),
             ("1 ", "many", "a"), ("2", None, "a  b"), ("2", "n/a", "a b"), ("3", "7", "c"),
             ("3", "7", "c"), ("3", "7", "c"), ("4", "8", "-")]
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cells)],
                               "id string, qty string, name string, place int")
    policy = CL.Policy("t", (CL.ColumnRule("id", "id", "integer"), CL.ColumnRule("name", "name"),
                             CL.ColumnRule("qty", "qty", "integer", nulls="impute_zero")),
                       deduplicate=strategy, order=("place",),
                       dedupe_columns=("id",) if strategy == "subset" else ())
    monkeypatch.setattr(CL, "FEW_HASHES", few)
    out = CL.clean_table(df, policy)
    paths = FI.write_clean(out, str(tmp_path), actions=True)

    def rows(frame):
        return sorted(map(str, (r.asDict() for r in frame.collect())))

    kept = {"exact_rows": 6, "subset": 4, None: 11}[strategy]
    clean = spark.read.parquet(paths["clean"])
    assert clean.count() == kept and rows(clean) == rows(out.clean)
    assert rows(spark.read.parquet(paths["actions"])) == rows(out.actions)
    assert ("rejects" in paths) == (strategy != "subset")
    if "rejects" in paths:
        assert rows(spark.read.parquet(paths["rejects"])) == rows(out.rejects)
    assert not [p for p in tmp_path.rglob("_staging_*")]


def test_duplicates_under_a_collation(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("A",), ("b",)], "k string").selectExpr(
        "k COLLATE UTF8_LCASE AS k")
    out = CL.clean_table(df, CL.Policy("t", (CL.ColumnRule("k", "k"),), deduplicate="exact_rows"))
    paths = FI.write_clean(out, str(tmp_path), actions=True)
    assert spark.read.parquet(paths["clean"]).count() == out.clean.count() == 2
