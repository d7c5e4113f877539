"""Reports on verdicts: measured times, expectations, stored verdicts; and keywords near matches as a join."""

import json

from pyspark.sql import functions as F

from tamis import planted
from tamis.operators import bands, detect, profiler
from tamis.operators.literals import literal_places
from tamis.operators.verdict import inspect
from tamis.plans.default_rules import DEFAULT_RULES as RULES
from tamis.sources import files


def test_places_of_literals(spark):
    texts = ["", None, "aXaa", "éaé😀aa", "baab"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] and sorted((x["word"], x["start"], x["end"]) for x in r[0]) for r in frame.select(literal_places(F.col("t"), ["a", "aa"])).collect()]
    want = []
    for t in texts:
        raw = None if t is None else t.encode()
        want.append(t and sorted((i, p, p + len(w)) for i, w in enumerate((b"a", b"aa")) for p in range(len(raw)) if raw.startswith(w, p)))
    assert [g or None for g in got] == [w or None for w in want]


def test_band_join_says_what_rows_say(spark):
    docs = planted.documents(spark, "/root/testdata/sf0.001")
    near = bands.matches_near_keywords(docs, RULES, limit=detect.MAX_MATCHES)
    joined = {(r[0], r[1]): r[2] for r in near.groupBy("doc_id", "detector").agg(F.max("near_keyword")).collect()}
    rows = detect.findings_long(docs, RULES).where("detector <> 'person_name'").collect()
    assert {(r["doc_id"], r["detector"]): r["keyword_found"] for r in rows} == joined
    assert any(joined.values()) and not all(joined.values())


def test_a_long_text_is_spread_over_buckets(spark):
    text = ("ssn " + "x" * 150 + " 219-09-9999 " + "y" * 500) * 300
    near = bands.matches_near_keywords(spark.createDataFrame([(1, text)], "doc_id int, text string"), RULES).where("detector = 'us_ssn'")
    assert near.count() == 300 and near.where("near_keyword").count() == 300
    assert bands.matches_near_keywords(spark.createDataFrame([(1, None)], "doc_id int, text string"), RULES).count() == 0


def test_times_are_measured(spark, tmp_path):
    frame = files.from_memory(spark, [(f"{i}.txt", b"card 4012888888881881 " * (1 + 2000 * (i == 7))) for i in range(12)])
    files.inspect_files(frame.repartition(2), RULES).write.parquet(str(tmp_path / "v"))
    verdicts = spark.read.parquet(str(tmp_path / "v"))
    rows = {r["path"]: r["micros"] for r in verdicts.collect()}
    assert all(m >= 0 for m in rows.values()) and max(rows.values()) > 0
    report = {r["metric"]: r["value"] for r in profiler.latency_report(verdicts).collect()}
    ordered = sorted(rows.values())
    assert report["n"] == 12 and report["bytes"] == 22 * (12 + 2000) and report["max_micros"] == ordered[-1]
    assert report["p50"] == ordered[5] and report["p99"] == ordered[10] and abs(report["seconds"] - sum(ordered) / 1e6) < 1e-9
    assert abs(report["mb_per_s"] - report["bytes"] / sum(ordered)) < 1e-6
    assert [r["micros"] for r in profiler.slowest(verdicts, 3).collect()] == ordered[:-4:-1]
    profiler.write_csv(verdicts, str(tmp_path / "csv"))
    assert {r["path"]: int(r["micros"]) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} == rows
    nothing = {r["metric"]: r["value"] for r in profiler.latency_report(verdicts.limit(0)).collect()}
    assert nothing == {"n": 0.0, "bytes": 0.0, "seconds": 0.0}
    plain = inspect(spark.createDataFrame([("x", 5)], "text string, micros int"), RULES).first()
    assert plain["micros"] == 5  # a column of that name stays, unless times are asked for
    assert inspect(spark.createDataFrame([("x", 5)], "text string, micros int"), RULES, micros=True).first()["micros"] >= 5


def test_expectations(spark):
    frame = spark.createDataFrame([(1, "SSN 219-09-9999 for payroll"), (2, "nothing"), (3, "nothing"), (4, "mail a@b.co"), (None, "nothing")], "id int, text string")
    expected = spark.createDataFrame([(1, "BLOCK", ["US_PII"]), (2, "BLOCK", []), (4, "ESCALATE", ["EMAIL", "PCI", "PCI"]), (5, "ALLOW", ["X"]), (None, "ALLOW", [])], "id int, verdict string, profiles array<string>")
    got = {(r["id"], r["verdict"]): (r["status"], r["missing"], r["extra"]) for r in profiler.expectation_report(inspect(frame, RULES), expected, "id").collect()}
    assert got[1, "BLOCK"] == ("ok", [], []) and got[2, "ALLOW"][0] == "differs" and got[3, "ALLOW"][0] == "unexpected"
    assert got[4, "ESCALATE"] == ("missing", ["PCI"], []) and got[5, None] == ("absent", ["X"], [])
    assert got[None, "ALLOW"][0] == "unexpected" and got[None, None][0] == "absent"


def test_stored_verdicts_come_back(spark):
    frame = files.from_memory(spark, [("a.txt", b"SSN 219-09-9999 for payroll, TOP SECRET"), ("b", b"\x00"), ("c", b"")])
    verdicts = files.inspect_files(frame, RULES).drop("micros").cache()
    back = files.read_verdicts(files.verdict_json(verdicts))
    columns = verdicts.columns
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, verdicts.collect()))
    assert back.where("problem is not null").count() == 0
    odd = spark.createDataFrame([("no json",), (None,), ("{}",), (json.dumps({"verdict": "ALLOW", "new": 1, "profiles": [{"profile_id": "P"}]}),)], "json string")
    rows = files.read_verdicts(odd).collect()
    assert [r["problem"] for r in rows] == ["no json", None, None, None] and [r["verdict"] for r in rows] == [None, None, None, "ALLOW"]
    assert rows[3]["profiles"][0]["profile_id"] == "P" and rows[3]["labels"] is None
