from __future__ import annotations

import os
from collections import Counter

import pytest

from chatweave.operators.model import transcribe
from chatweave.streaming.model_runs import apply_model_resumably


def model_of(folder: str):
    """Notes each call in ``folder``; while a file ``power cut`` is there it ends the task at item 23."""

    def start():
        def run(row, quality_retry=False):
            if row["name"] == "item23" and os.path.exists(os.path.join(folder, "power cut")):
                raise SystemExit("power cut")
            with open(os.path.join(folder, "calls"), "a", encoding="utf-8") as f:
                f.write(row["name"] + "\n")
            if row["name"] == "item7":
                raise ValueError("silence")
            return f"a text about {row['name']} of more than eight different words here" if quality_retry or row["name"] != "item5" else ""

        return run

    return start


def calls(folder) -> Counter:
    return Counter((folder / "calls").read_text().split()) if (folder / "calls").exists() else Counter()


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(f"item{i}",) for i in range(40)], "name string")


def test_a_lost_run_goes_on(spark, items, tmp_path):
    run, folder = str(tmp_path / "run"), str(tmp_path)
    (tmp_path / "power cut").touch()
    options = {"items_per_file": 2, "files_per_batch": 3}
    with pytest.raises(Exception, match="power cut"):
        apply_model_resumably(items, model_of(folder), ["name"], run, **options)
    done = {r.name for r in spark.read.parquet(f"{run}/said").collect()} if os.path.exists(f"{run}/said/_spark_metadata") else set()
    (tmp_path / "power cut").unlink()
    said = apply_model_resumably(items, model_of(folder), ["name"], run, **options).collect()
    assert sorted(r.name for r in said) == sorted(f"item{i}" for i in range(40))
    assert {r.name: r.error for r in said if r.error} == {"item7": "silence"}
    count = calls(tmp_path)
    assert set(count) == {f"item{i}" for i in range(40)} and all(count[name] == 1 for name in done)
    assert sum(count.values()) <= 40 + 12  # at most the files of the batch that was lost
    again = apply_model_resumably(items.limit(3), model_of(folder), ["name"], run, **options)
    assert again.count() == 40 and calls(tmp_path) == count


def test_transcription_in_a_folder(spark, items, tmp_path):
    for _ in range(2):  # the second time all is there
        made, events = transcribe(items, model_of(str(tmp_path)), ["name"], folder=str(tmp_path / "run"))
        assert made.count() == 39 and made.where("text = ''").count() == 0
        kinds = Counter(r.type for r in events.collect())
        assert kinds == {"audio_transcript_created": 39, "audio_transcript_failed": 1, "audio_transcript_quality_flagged": 1, "audio_transcript_retried": 1}
    assert calls(tmp_path) == Counter({f"item{i}": 1 for i in range(40)}) + Counter({"item5": 1})


def test_no_items(spark, items, tmp_path):
    assert apply_model_resumably(items.limit(0), model_of(str(tmp_path)), ["name"], str(tmp_path / "run")).count() == 0
