"""Line numbers of files in several splits, headers of their own, audits, malformed lines."""

import json

import pytest

from faultsift.sources import ordered


@pytest.fixture
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "10"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def test_lines_of_split_files(spark, tmp_path, small_splits):
    want = set()
    for name, n, end in (("a.txt", 3000, "\n"), ("b.txt", 1, ""), ("c.txt", 900, "\n"), ("deep/d.txt", 40, "\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        rows = [f"{name} {i} " + "é" * (i % 17) for i in range(n)]
        (tmp_path / name).write_text("\n".join(rows) + end, encoding="utf-8")
        want |= {(name.split("/")[-1], i + 1, r) for i, r in enumerate(rows)}
    (tmp_path / "empty.txt").write_text("")
    df = ordered.lines(spark, str(tmp_path), "*.txt")
    assert spark.read.option("recursiveFileLookup", "true").text(str(tmp_path)).rdd.getNumPartitions() > 10
    assert {(r["file"].split("/")[-1], r["line"], r["text"]) for r in df.collect()} == want


def test_csv_by_each_files_own_header(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("﻿ts,node,value\n" + "".join(f'{i},"n,{i}",{i * 2}\n' for i in range(500)) + "\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("value,extra,ts,node\n7,x,1,m\n8,y,2\n")
    (tmp_path / "c.csv").write_text("ts,value\n1,2\n3,4\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.txt").write_text("ts,node\n")
    got = {(r["file"].split("/")[-1], r["line"]): (r["ts"], r["node"], r["value"]) for r in ordered.csv_rows(spark, str(tmp_path), ["ts", "node", "value"]).collect()}
    want = {("a.csv", i + 2): (str(i), f"n,{i}", str(i * 2)) for i in range(500)}
    assert got == want | {("b.csv", 2): ("1", "m", "7"), ("b.csv", 3): ("2", None, "8")}
    loose = ordered.csv_rows(spark, str(tmp_path), ["ts", "node"], required=["ts"]).where("file like '%c.csv'").collect()
    assert sorted((r["line"], r["ts"], r["node"]) for r in loose) == [(2, "1", None), (3, "3", None)]
    assert ordered.csv_audit(spark, str(tmp_path), ["ts", "node", "value"]).first().asDict() == {"files": 4, "empty": 1, "headerless": 1, "rows": 502, "lost_rows": 2}


def test_counters_in_the_order_of_lines(spark, tmp_path, small_splits):
    """Rows of one time keep the order of the file, which only the line knows."""
    from faultsift.sources import telemetry

    (tmp_path / "a.csv").write_text("ts,value\n" + "".join(f"2026-01-01T00:00:00Z,{(i * 37) % 1000}\n" for i in range(800)))
    rows = ordered.csv_rows(spark, str(tmp_path), ["ts", "value"]).selectExpr("file", "line", "timestamp(ts) ts", "double(value) value")
    got = telemetry.counter_rates(rows, ["file"], "ts", ["ts", "line"], "value", per_minute=False).orderBy("line").collect()
    values = [(i * 37) % 1000 for i in range(800)]
    assert [r["delta"] for r in got] == [None] + [float(b if b < a else b - a) for a, b in zip(values, values[1:], strict=False)]


def test_json_errors_name_their_lines(spark, tmp_path, small_splits):
    rows = [json.dumps({"a": i, "b": "x" * (i % 40)}) for i in range(300)]
    rows[17], rows[250] = "{broken", '{"a": '
    (tmp_path / "r.jsonl").write_text("\n".join(rows[:100]) + "\n\n" + "\n".join(rows[100:]))
    with pytest.raises(ValueError, match=r"r\.jsonl:18, .*r\.jsonl:252"):
        ordered.json_rows(spark, str(tmp_path), "a int, b string")
    got = ordered.json_rows(spark, str(tmp_path), "a int, b string", strict=False)
    assert {(r["line"], r["bad_line"]) for r in got.where("bad_line is not null").collect()} == {(18, "{broken"), (252, '{"a": ')}
    assert got.where("bad_line is null").count() == 298
