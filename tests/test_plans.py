"""Plan shapes that matter at scale, with broadcasts off as for large inputs."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from chatweave.operators.enrich import enrich_messages
from chatweave.operators.media import media_plan
from chatweave.operators.model import transcribe
from chatweave.operators.parse import ENRICHMENT_TYPE, MEDIA_TYPE, MESSAGE_COLUMNS, parse_messages
from chatweave.operators.quality import assess_quality
from chatweave.operators.retry import retry_candidates
from chatweave.sources.exports import export_roots


TYPES = {"msg_idx": "bigint", "media": MEDIA_TYPE, "enrichment": ENRICHMENT_TYPE}
MESSAGE_TYPES = {c: TYPES.get(c, "string") for c in MESSAGE_COLUMNS}


@pytest.fixture()
def large_plans(spark):
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lines_are_shuffled_once(spark, tmp_path, large_plans):
    path = str(tmp_path / "lines")
    spark.createDataFrame([("c", 0, "x")], "chat_id string, line_no bigint, line string").write.parquet(path)
    plan = large_plans(parse_messages(spark.read.parquet(path), tz_offset="+00:00").select("chat_id", "msg_idx", "text"))
    # One scan for the evidence and one for the messages; the second use of each is a reused shuffle.
    assert plan.count("FileScan") == 2
    assert len(re.findall(r"ReusedExchange", plan)) == 2
    assert not re.search(r"Cartesian|NestedLoop|SinglePartition", plan)


def test_unread_columns_are_not_scanned(spark, tmp_path, large_plans):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", "b")], "doc_id bigint, text string, other string").write.parquet(path)
    plan = large_plans(assess_quality(spark.read.parquet(path)).select("doc_id", "quality.ok"))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)
    assert "Exchange" not in plan


def test_groups_are_reduced_before_the_shuffle(spark, large_plans):
    files = spark.createDataFrame([("e", "a.txt", 1)], "export string, path string, length bigint")
    assert "partial_min_by" in large_plans(export_roots(files))
    docs = assess_quality(spark.createDataFrame([("k", 1, "t")], "k string, seq int, text string"))
    assert "partial_min_by" in large_plans(retry_candidates(docs, ["k"], "seq"))


def test_quality_is_computed_once_per_row(spark, large_plans):
    docs = assess_quality(spark.createDataFrame([("k", 1, "t")], "k string, seq int, text string"))
    plan = large_plans(retry_candidates(docs, ["k"], "seq").select(F.size("before_issues")))
    assert "Filter" not in plan.split("ObjectHashAggregate")[-1].split("SortAggregate")[-1]


def test_events_of_transcripts_read_what_was_decided(spark, large_plans):
    """No event kind assesses a text again, and the log's tables hold no first texts."""

    def better_again():
        return lambda row, quality_retry: "a text that is fine" if quality_retry else row["text"]

    items = spark.createDataFrame([(1, "bad \ufffd"), (2, "good")], "doc_id int, text string")
    _, log = transcribe(items, better_again, ["doc_id"])
    plan = large_plans(log.groupBy("type").count())
    assert "regexp" not in plan and "Python" not in plan and "Join" not in plan
    assert {(r.doc_id, r.type) for r in log.collect()} == {
        (1, "audio_transcript_created"), (2, "audio_transcript_created"), (1, "audio_transcript_quality_flagged"), (1, "audio_transcript_retried"),
    }


def shuffles(plan: str) -> int:
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|Single|RoundRobin)", plan))


def test_all_of_a_file_is_found_in_two_shuffles(spark, tmp_path, large_plans):
    schemas = {
        "work": "chat_id string, file string, kind string", "listing": "chat_id string, file string",
        "artifacts": "chat_id string, kind string, stem string, rel_path string, text string",
        "converted": "chat_id string, stem string, ext string, rel_path string",
        "messages": ", ".join(f"`{n}` {t}" for n, t in MESSAGE_TYPES.items()),
    }
    tables = {}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    plan = large_plans(media_plan(tables["work"], tables["listing"], tables["artifacts"], tables["converted"]))
    assert shuffles(plan) == 2 and "Join" not in plan and "text:string" not in plan
    # Distinct files, their stems, their facts, and the join: both of its sides, of which one lies right.
    plan = large_plans(enrich_messages(tables["messages"], tables["artifacts"], tables["converted"]))
    assert shuffles(plan) <= 4 and plan.count("FileScan") == 4
