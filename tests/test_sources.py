"""Readers and sinks: JSON, CSV lists, label text, NumPy files, case folders, reports, versioned tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import artifacts as A
from strandline.sources import series as R
from strandline.sources.versions import VersionedTable


def test_json_and_labels(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"case_id": "a", "length": 4}, {"case_id": "b", "length": None}]))
    assert sorted(r["case_id"] for r in R.read_cases(spark, str(tmp_path / "cases.json")).collect()) == ["a", "b"]
    (tmp_path / "one.json").write_text(json.dumps({"case_id": "c", "length": 9}))
    assert R.read_cases(spark, str(tmp_path / "one.json"), "case_id string, length int").collect()[0]["length"] == 9
    (tmp_path / "lines.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert sorted(r["a"] for r in R.read_records(spark, str(tmp_path / "lines.jsonl")).collect()) == [1, 2]
    (tmp_path / "labels.txt").write_text("3 | a peak | and more\nno bar\nx | text\n")
    assert [tuple(r) for r in R.read_labels(spark, str(tmp_path / "labels.txt")).collect()] == [(3, "a peak | and more"), (None, "text")]


def test_csv_lists(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,text,OT,more\n1,"said ""so""","[1.0, 2, 3.5]",x\n2,,"[]",y\n3,z,broken,y\n')
    rows = R.read_csv_series(spark, str(tmp_path / "s.csv"), ["id", "text"], "OT").collect()
    assert [(r["id"], r["text"], r["values"]) for r in rows] == [("1", 'said "so"', [1.0, 2.0, 3.5]), ("2", None, []), ("3", "z", None)]
    assert R.read_csv_series(spark, str(tmp_path / "s.csv"), ["id"], "OT", limit=1).count() == 1


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("dtype", ["<f8", ">f4", "<i2"])
def test_npy_by_ranges_of_rows(spark, tmp_path, order, dtype):
    data = np.asarray(np.random.default_rng(1).normal(0, 50, (1000, 7)).astype(dtype), order=order)
    np.save(tmp_path / "a.npy", data)
    rows = R.read_npy(spark, str(tmp_path / "a.npy"), bytes=str(data.nbytes // 8))
    assert rows.rdd.getNumPartitions() == 8
    got = sorted(rows.collect(), key=lambda r: r["row"])
    assert [r["row"] for r in got] == list(range(1000)) and np.array_equal(np.array([r["values"] for r in got]), data.astype(float))
    some = R.read_npy(spark, str(tmp_path / "a.npy"), first="990", last="2000").collect()
    assert sorted(r["row"] for r in some) == list(range(990, 1000))


def test_npy_shapes_and_filters(spark, tmp_path):
    np.save(tmp_path / "one.npy", np.arange(5))
    np.save(tmp_path / "two.npy", np.zeros((0, 4)))
    np.save(tmp_path / "six.npy", np.arange(12).reshape(6, 2) % 2 == 0)
    got = {(r["path"].rsplit("/", 1)[1], r["row"]): r["values"] for r in R.read_npy(spark, str(tmp_path)).collect()}
    assert got.pop(("one.npy", 0)) == [0.0, 1.0, 2.0, 3.0, 4.0] and got == {("six.npy", i): [1.0, 0.0] for i in range(6)}
    assert R.read_npy(spark, str(tmp_path / "s*.npy")).count() == 6
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pruned = R.read_npy(spark, str(tmp_path / "six.npy"), bytes="2").where("row >= 2 and row < 4")
        assert pruned.rdd.getNumPartitions() == 2 and sorted(r["row"] for r in pruned.collect()) == [2, 3]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    np.save(tmp_path / "bad.npy", np.array(["text"]))
    with pytest.raises(Exception, match="neither a series"):
        R.read_npy(spark, str(tmp_path / "bad.npy")).collect()


def test_case_folders_and_metrics(spark, tmp_path):
    for name, score in (("c1", 1.5), ("c2", None)):
        (tmp_path / "cases" / name).mkdir(parents=True)
        (tmp_path / "cases" / name / "record.json").write_text(json.dumps({"score": score, "list": [1, 2]}, indent=1))
    assert sorted((r["case_id"], r["score"]) for r in A.read_case_folders(spark, str(tmp_path / "cases")).collect()) == [("c1", 1.5), ("c2", None)]
    (tmp_path / "m.csv").write_text("cttp,fid,other\n1,2,x\n3,none,y\n")
    assert A.read_metrics(spark, str(tmp_path / "m.csv")).collect()[0].asDict() == {"cttp": 2.0, "fid": 2.0}


def test_sinks(spark, tmp_path):
    rows = spark.range(5, numPartitions=3).select("id", F.when(F.col("id") != 3, F.concat(F.lit("a|b "), F.col("id"))).alias("text"), F.array("id").alias("list"))
    expected = [{"id": i, "text": None if i == 3 else f"a|b {i}", "list": [i]} for i in range(5)]
    for kind in ("jsonl", "csv", "json", "markdown"):
        A.write_rows(rows, str(tmp_path / kind), kind)
    text = lambda kind: "".join(p.read_text() for p in sorted((tmp_path / kind).glob("part-*")))
    by_id = lambda xs: sorted(xs, key=lambda r: r["id"])
    assert by_id(json.loads(text("json"))) == expected
    assert by_id({"text": None} | json.loads(line) for line in text("jsonl").splitlines()) == expected
    assert sorted(spark.read.option("header", True).csv(str(tmp_path / "csv")).select("list").collect()) == [(f"[{i}]",) for i in range(5)]
    lines = text("markdown").splitlines()
    assert lines[:2] == ["| id | text | list |", "| --- | --- | --- |"] and len(lines) == 7 and "| 0 | a\\|b 0 | [0] |" in lines
    A.write_rows(rows.limit(0), str(tmp_path / "none"), "json")
    assert json.loads(text("none")) == []
    with pytest.raises(ValueError):
        A.write_rows(rows, str(tmp_path / "x"), "xml")


def test_report_of_many_rows_is_whole(spark, tmp_path):
    A.write_rows(spark.range(120_000), str(tmp_path / "many"), "json")
    assert len(json.loads("".join(p.read_text() for p in sorted((tmp_path / "many").glob("part-*"))))) == 120_000


def test_upsert(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    assert table.upsert(rows((1, "a"), (2, "b"), (None, "n"), (2, "c")), ["k"], "first")
    held = lambda: sorted(map(tuple, table.read().collect()), key=str)
    assert held() == [(1, "a"), (2, "c"), (None, "n")]
    # a writer that dies between the write and the swap leaves the old version in force
    table.write_version(rows((1, "lost")), "dies")
    assert held() == [(1, "a"), (2, "c"), (None, "n")]
    assert table.upsert(rows((1, "z"), (3, "d"), (None, "m")), ["k"], "second")
    now = [(1, "z"), (2, "c"), (3, "d"), (None, "m")]
    assert held() == now
    # a run that is repeated changes nothing
    assert not table.upsert(rows((1, "a")), ["k"], "first") and held() == now
    # two writers from one version: the later is refused
    late = table.write_version(rows((9, "late")), "late")
    assert table.upsert(rows((4, "e")), ["k"], "third")
    with pytest.raises(RuntimeError):
        table.swap(late)
    table.delete_old(1)
    assert held() == [*now[:3], (4, "e"), now[3]]
    assert table.manifest()["runs"] == ["first", "second", "third"]
