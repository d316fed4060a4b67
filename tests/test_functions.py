from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from chatweave.functions import naming, text
from chatweave.functions.times import resolve_offset


def values(spark, fn, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clip(spark):
    assert values(spark, lambda c: text.clip(c, 10), ["hello", "  hello ", None]) == ["hello", "hello", ""]
    assert values(spark, lambda c: text.clip(c, 0), ["hello"]) == [""]
    assert values(spark, lambda c: text.clip(c, 6), ["hello world"]) == ["hello…"]


def test_strip_knows_unicode_spaces(spark):
    assert values(spark, text.strip, ["  a b \n", "\u3000"]) == ["a b", ""]


def test_sender_ids(spark):
    ids = values(spark, lambda c: text.sender_to_id(c, ["Ana"], ["ana", "BOB"]), [" ana ", "Bob", "Cy ", None, ""])
    assert ids == ["ME", "THEM", "Cy", None, ""]
    assert values(spark, text.sender_to_id, [" x "]) == ["x"]


@pytest.mark.parametrize(
    "name, stem, suffix",
    [
        ("a.b", "a", ".b"), (".b", ".b", ""), ("..b", ".", ".b"), ("a.", "a.", ""), ("a..", "a..", ""),
        ("a..b", "a.", ".b"), ("..", "..", ""), (".", "", ""), ("", "", ""), ("x/", "x", ""), ("x/.", "x", ""),
        ("./", "", ""), ("a/b.c/", "b", ".c"), ("a. b", "a", ". b"), ("a/.", "a", ""), ("a//./b.tar.gz", "b.tar", ".gz"),
    ],
)
def test_path_parts(spark, name, stem, suffix):
    assert values(spark, naming.file_stem, [name]) == [stem]
    assert values(spark, naming.file_suffix, [name]) == [suffix]


def test_kinds(spark):
    kinds = values(spark, naming.guess_kind, ["a.OPUS", "b.JPeg", "c.3gp", "d.txt", "e.zip", "f", ".mp3", "x/y.webm"])
    assert kinds == ["audio", "image", "video", "document", "unknown", "unknown", "unknown", "video"]


def test_artifact_stems(spark):
    one, other, slash, back, odd, none = values(
        spark, naming.artifact_stem,
        ["clip.opus", "clip.ogg", "Media/PTT-1.opus", "Media\\PTT-1.opus", " ./Ünï__.jpg ", "..."],
    )
    assert one != other and one.startswith("clip__") and other.startswith("clip__")
    assert slash == back and re.fullmatch(r"PTT-1__[0-9a-f]{12}", slash)
    assert re.fullmatch(r"n__[0-9a-f]{12}", odd)
    assert none.startswith("media__")
    assert values(spark, naming.normalize_media_ref, [" ./a\\b ", None, "././x"]) == ["a/b", "", "./x"]
    (stems,) = values(spark, naming.candidate_stems, ["Media\\a.opus"])
    assert stems[0].startswith("a__") and stems[1] == "Media\\a"


def test_relative_path(spark):
    assert values(spark, lambda c: naming.relative_path(c, "/x/y/"), ["/x/y/a/b.txt", "/z/c"]) == ["a/b.txt", "/z/c"]


def test_offsets():
    assert re.fullmatch(r"[+-]\d{2}:\d{2}", resolve_offset("auto"))
    assert resolve_offset(None) == resolve_offset("auto")
    assert resolve_offset("-03:30") == "-03:30"
    with pytest.raises(ValueError):
        resolve_offset("Z")
