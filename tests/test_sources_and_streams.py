"""Sources, sinks, streams and image statistics on small inputs."""

import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import images, records, windows
from millrace.plans import ORACLE_SQL, events
from millrace.sources import files, pages, sinks
from millrace.streaming import audit


def test_discover(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.pdf").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.png").write_bytes(b"x")
    got = {r["name"]: r["error"] for r in files.discover(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": None, "b.txt": "UNSUPPORTED_EXTENSION"}
    assert spark.range(1).select(files.file_error(F.lit("c.pdf"), F.lit(0)).alias("e")).first()["e"] == "EMPTY_FILE"
    assert [r["url"] for r in files.data_urls(spark, str(tmp_path)).collect()] == ["data:image/jpeg;base64,eA=="]
    big = spark.range(1).select(files.file_error(F.lit("a.pdf"), F.lit((50 << 20) + 1)).alias("p"), files.file_error(F.lit("a.png"), F.lit((20 << 20) + 1)).alias("i")).first()
    assert (big["p"], big["i"]) == ("PDF_TOO_LARGE", "IMAGE_TOO_LARGE")


def test_requests_and_templates(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"jobId": "j", "inputPaths": ["a"], "options": {"countryFormat": "NAME", "unknown": 1}}))
    r = files.requests(spark, str(tmp_path)).first()
    assert r["options"]["countryFormat"] == "NAME" and r["options"]["maxImageWidth"] == "1800" and r["error"] is None and "unknown" not in r["options"].asDict()
    rows = spark.createDataFrame([(json.dumps({"id": "1", "name": "n", "type": "t", "mappings": []}),), ("{",), (json.dumps({"id": "2"}),)], "j string")
    assert [t["id"] for t in files.templates(rows, "j").collect()] == ["1"]
    body = json.dumps({"analyzeResult": {"documents": [{"fields": {"First": {"valueString": "A", "confidence": 0.5}, "Other": {"content": "z"}, "Born": {"content": "d", "confidence": 1.0}}}]}})
    got = files.service_fields(spark.createDataFrame([(1, body), (2, None)], "id long, j string"), "id", "j", {"First": "givenName", "Born": "dateOfBirth"}).collect()
    assert {(r["field"], r["value"]) for r in got} == {("givenName", "A"), ("dateOfBirth", "d")}


def test_form_fields(spark):
    html = '<label for="a">First name</label> <input type="text" name="a"><textarea name="b"></textarea><select class="x" name="c">'
    got = pages.form_fields(spark.createDataFrame([(1, html), (2, "")], "id long, html string"), "id", "html").collect()
    assert [(r["tag"], r["name"], r["label"]) for r in got] == [("input", "a", "First name"), ("textarea", "b", ""), ("select", "c", "")]


def test_sheets_and_upserts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a,"b"', None), (2, "c\nd", 1.5)], "id long, t string, x double")
    sinks.write_sheets({"Guests": rows.where("id = 1")}, str(tmp_path / "book"))
    assert [tuple(r) for r in sinks.read_sheet(spark, str(tmp_path / "book"), "Guests").collect()] == [("1", 'a,"b"', "")]
    changes = spark.createDataFrame([(2, "new", 1.0, 1), (2, "newer", 2.0, 2), (3, "third", 0.0, 1)], "id long, t string, x double, at long")
    got = {r["id"]: r["t"] for r in sinks.upserted(rows, changes, "id", "at").collect()}
    assert got == {1: 'a,"b"', 2: "newer", 3: "third"}
    assert [r["id"] for r in sinks.removed(rows, changes, "id").collect()] == [1]
    path = sinks.write_version(rows, str(tmp_path / "t"), 1)
    assert spark.read.parquet(path).count() == 2
    out = sinks.response(spark.createDataFrame([("j", "FAILED", "E1"), ("j", "READY", None)], "job string, s string, e string"), "job", "s", "e").first()
    assert (out["status"], out["errors"], out["total"]) == ("PARTIAL", ["E1"], 2)
    assert json.loads(sinks.as_json(rows.where("id = 2")).first()["json"])["t"] == "c\nd"


def test_import_needs_names(spark):
    with pytest.raises(ValueError):
        records.import_rows(spark.createDataFrame([(1,)], "room long"))
    assert records.header_map(["Full Name", "full_name", "DOB", "x"]) == {"Full Name": "fullName", "DOB": "dateOfBirth", "x": "x"}


def test_windows_on_edges(spark):
    none = spark.createDataFrame([], "k long, t long, v double")
    assert windows.bands(none, ["k"], "t", "v", 1.0).count() == windows.sessions(none, ["k"], F.col("t"), 5).count() == 0
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (1, 3, None), (1, 9, 2.0)], "k long, t long, v double")
    assert [r["session"] for r in windows.sessions(rows, ["k"], F.col("t"), 5).orderBy("t").collect()] == [1, 1, 1, 2]
    assert [(r["first"], r["last"], r["length"]) for r in windows.bands(rows, ["k"], "t", "v", 1.0).collect()] == [(1, 2, 2)]
    assert spark.range(1).select(windows.upper_median(F.array().cast("array<double>")).alias("m")).first()["m"] is None


@pytest.mark.parametrize("parts", [4096, 3])
def test_upper_medians_without_arrays(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(windows, "PARTS", parts)
    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 5e-324, 1.7e308, -1.7e308]
    rows = [(7, rng.gauss(0, 100)) for _ in range(3000)] + [(None, rng.randint(0, 3) / 2) for _ in range(50)] + [(9, None)] * 3 + [(8, 1.0)] + [(5, None), (5, 2.0)]
    rows += [(100 + k, rng.choice([*odd, rng.random(), rng.random() * 1e9])) for k in range(150) for _ in range(rng.randint(1, 12))]
    spark.createDataFrame(rows, "user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    out = events.upper_medians(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "NestedLoop" not in plan
    want = duckdb.sql(ORACLE_SQL["upper_medians"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    same = [sorted(([str(x) for x in r[:2]] + [None if r[2] is None else str(r[2] + 0.0), f"{r[3]:.9g}"] for r in some), key=str) for some in (map(tuple, out.collect()), want)]
    assert same[0] == same[1] and len(want) == 155


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{k % 3}:00:00", k % 2, "click") for k in range(30)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = audit.append_log(audit.masked_log(stream, ["user_id"]), str(tmp_path / "log"), str(tmp_path / "c1"))
    assert q.awaitTermination(60)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 30 and {r["user_id"] for r in log.collect()} == {"****"}
    counts = audit.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    assert counts.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [10, 10, 10]
    capped = audit.first_of_session(stream, "user_id", "user_id long, event_id long", cap=4, ttl=None).writeStream.format("memory").queryName("capped").outputMode("append").trigger(availableNow=True).start()
    assert capped.awaitTermination(60)
    assert {r["user_id"]: r["count"] for r in spark.table("capped").groupBy("user_id").count().collect()} == {0: 4, 1: 4}


def test_image_metrics(spark):
    flat = np.full((16, 16), 100, np.uint8)
    noisy = np.random.default_rng(1).integers(0, 256, (16, 24)).astype(np.uint8)
    rows = [(1, 16, 16, flat.tobytes()), (2, 24, 16, noisy.tobytes()), (3, 5, 5, b"short"), (4, None, 1, None)]
    got = {r["image_id"]: r for r in images.image_metrics(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).collect()}
    assert (got[1]["blur"], got[1]["brightness"], got[1]["contrast"]) == (0.0, 100.0, 0.0)
    assert got[2]["blur"] > 1000 and abs(got[2]["brightness"] - noisy.mean()) < 1e-9 and got[3]["blur"] is None and got[4]["glare"] is None
