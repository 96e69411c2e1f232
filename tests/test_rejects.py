"""What a source refuses becomes a dead letter with its reason; nothing vanishes."""

import json

from pyspark.sql import functions as F

from watchtide.sources import lines, otlp, signals
from watchtide.sources.records import IngestConfig
from watchtide.streaming import ingest

AS_OF = "2024-01-31T00:00:00Z"


def test_gelf_lines_are_good_or_bad(spark):
    given = [(i, v) for i, v in enumerate(['{"host": "h", "short_message": "m"}', "x", "[1]", "{", "  ", "null", "{}"])]
    good, bad = lines.read_gelf(spark.createDataFrame(given, "n int, value string"))
    assert sorted(r.n for r in good.collect()) == [0, 6]
    assert sorted(r.n for r in bad.collect()) == [1, 2, 3, 5]


def test_otlp_documents_are_good_or_bad(spark):
    span = {"traceId": "a", "spanId": "b", "name": "n"}
    texts = [json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span, {**span, "spanId": ""}]}]}]}), '{"resourceSpans": []}', '{"resourceSpans": 3}', "{}", "no", None]
    good, bad = otlp.read_otlp(spark.createDataFrame(list(enumerate(texts)), "n int, value string"), "traces")
    assert sorted((r.n, r.error) for r in bad.collect()) == [(2, "no resourceSpans"), (3, "no resourceSpans"), (4, "not a JSON object"), (5, "not a JSON object")]
    kept, dead = signals.split_rejects(good.withColumn("tenant_id", F.lit("t")), "traces")
    assert [r.n for r in kept.collect()] == [0]
    assert [(r.error, json.loads(r.payload)["trace_id"]) for r in dead.collect()] == [("span without an id", "a")]


def test_routed_payloads_end_up_stored_or_dead(spark, tmp_path):
    base = str(tmp_path / "base")
    given = [
        {"to": "metrics", "metric_name": "m", "value": 1.5}, {"to": "metrics", "value": 2}, {"to": "metrics", "metric_name": "m", "value": {"a": 1}},
        {"to": "traces", "trace_id": "t", "span_id": "s", "start_time": AS_OF}, {"to": "traces", "trace_id": "t"}, {"message": "a line"},
    ]
    steps = [{"if": ("==", "to", t), "then": {"route": t}} for t in ("metrics", "traces")]
    rows = spark.createDataFrame([("ten", json.dumps(g)) for g in given] + [("ten", "broken")], "tenant_id string, value string")
    for _ in range(2):  # a batch that is handed over again changes nothing
        ingest.ingest_batch(rows, base, IngestConfig(as_of=AS_OF), steps, 0, ["logs", "metrics", "traces"])
    stored = {t: signals.read_signal(spark, base, t).count() for t in ("logs", "metrics", "traces")}
    dead = spark.read.parquet(f"{base}/dead_letters").collect()
    assert stored == {"logs": 1, "metrics": 1, "traces": 1}
    assert sorted(r.error for r in dead) == ["a field has the wrong type", "metric without a name", "not a JSON object", "span without an id"]
    assert all(r.created_at is not None and r.status == "pending" for r in dead)
    assert {r.payload for r in dead if r.error == "not a JSON object"} == {"broken"}
