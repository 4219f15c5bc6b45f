"""Delimited text: records over lines and splits, headers, encodings and blank lines."""

from __future__ import annotations

import csv
import io
import random

from plumbline.sources import files as FI
from plumbline.sources.records import records, text_lines


def cell(rng):
    return rng.choice(["a", "", "x y", '"quoted"', '"two\nlines"', '"a ""b"" c"', '"sep,inside"',
                       '""', '"three\n\nlines, ""q"""', 'inch 12" pipe', "né"])


def plain(text):
    rows = list(csv.reader(io.StringIO(text)))
    return [r or [""] for r in rows]


def test_records_agree_with_plain_parsing_at_every_split(spark, tmp_path):
    rng = random.Random(6)
    body = "\n".join(",".join(cell(rng) for _ in range(3)) for _ in range(400)) + "\n"
    (tmp_path / "x.csv").write_text("p,q,r\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200", "1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = text_lines(spark, str(tmp_path / "x.csv"))
            assert size == "128m" or lines.rdd.getNumPartitions() > 5
            got = sorted(",".join(plain(r["value"])[0]) for r in records(lines, ",").collect())
            assert got == sorted(",".join(r) for r in plain("p,q,r\n" + body))
            df = FI.read_delimited(spark, str(tmp_path / "x.csv"))
            assert sorted(map(tuple, df.collect())) == sorted(
                tuple((*r, "", "")[:3]) for r in plain(body))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_quote_that_never_closes_keeps_lines_apart(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,2\n3,"open\n5,6\n7,8\n')
    got = sorted(r["value"] for r in records(text_lines(spark, str(tmp_path / "x.csv")), ",").collect())
    assert got == ["1,2", '3,"open', "5,6", "7,8", "a,b"]


def test_headers_meet_by_name_and_files_keep_their_own_shape(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,one\n\n2,"two\nlines"\nid,name\n')
    (tmp_path / "b.csv").write_bytes("name;id;extra\ncafé €;3;x\n".encode("cp1252"))
    (tmp_path / "c.csv").write_text('"id","na""me",id\n4,q,5\n')
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_bytes("﻿name,id\n日本,6\n".encode())
    (tmp_path / "f.csv").write_bytes(b"id,name\n7,caf\xe9\x81\n")
    df = FI.read_delimited(spark, str(tmp_path))
    assert df.columns == ["id", "name", "extra", 'na"me', "id__dup1"]
    assert sorted(map(tuple, df.collect())) == sorted([
        ("1", "one", "", "", ""), ("", "", "", "", ""), ("2", "two\nlines", "", "", ""),
        ("id", "name", "", "", ""), ("3", "café €", "x", "", ""), ("4", "", "", "q", "5"),
        ("6", "日本", "", "", ""), ("7", "café\x81", "", "", "")])


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    assert FI.read_delimited(spark, str(tmp_path / "x.csv")).columns == []
    (tmp_path / "y.csv").write_text("a,b\n")
    df = FI.read_delimited(spark, str(tmp_path / "y.csv"))
    assert df.columns == ["a", "b"] and df.count() == 0
