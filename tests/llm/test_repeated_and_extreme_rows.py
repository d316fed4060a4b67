"""Repeated ids with different texts, extreme values and clashing columns in the earlier operators."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("chatweave.llm")

from pyspark.sql import functions as F  # noqa: E402

from chatweave.llm import cap_filters, line_dedup, media, minhash, toxicity  # noqa: E402
from chatweave.llm.common import _CHUNK, hash_block, may_be_among, word_hashes  # noqa: E402

RUN = " ".join(f"w{i}" for i in range(60))


@pytest.mark.parametrize("own", ["y", "a", "zz zz", "0"])
def test_line_dedup_keeps_what_only_one_row_of_an_id_says(spark, own):
    docs = spark.createDataFrame(
        [(1, RUN), (5, f"x\n{RUN}"), (5, f"{own}\nunique line")], "doc_id long, text string"
    )
    got = {(r.doc_id, r.text) for r in line_dedup.without_copies(docs).collect()}
    assert got == {(1, RUN), (5, "x"), (5, f"{own}\nunique line")}


def test_line_dedup_columns_of_any_name(spark):
    names = ["_id", "_runs", "_cut", "row", "runs", "maybe", "t", "id", "cut", "n_lines"]
    docs = spark.createDataFrame([(1, RUN, *"abcdefghij"), (2, f"own\n{RUN}", *"abcdefghij")], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    got = line_dedup.without_copies(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_deleted"]
    assert {(r.text, r.t, r.row, r.n_deleted) for r in got.collect()} == {(RUN, "g", "d", 0), ("own", "g", "d", 1)}


def test_near_dedup_stage_keeps_the_other_text_of_an_id(spark):
    import corpus_pipeline

    rows = [(1, RUN), (5, RUN + " more"), (5, "nothing like it at all here"), (7, "only one"), (None, RUN)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, maybe string, row string")
    got = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in got.collect()}
    assert {(1, RUN), (5, "nothing like it at all here"), (7, "only one"), (None, RUN)} <= texts
    judged = {r.doc_id: r for r in minhash.judged(docs).where("doc_id IS NOT NULL").collect()}
    (of_five,) = spark.range(1).select(*[F.md5(F.lit(t)) for i, t in rows if i == 5][:1]).first()
    assert ((5, RUN + " more") in texts) == (judged[5].text_md5 != of_five)


def test_filter_of_keys(spark):
    keys = spark.range(0, 50_000, 7).select(F.col("id").alias("k"))
    flagged = spark.range(50_000).withColumn("seen", may_be_among(F.col("id"), keys))
    assert flagged.where("id % 7 = 0 AND NOT seen").count() == 0
    assert flagged.where("id % 7 <> 0 AND seen").count() < 2000
    assert spark.range(100).where(may_be_among(F.col("id"), keys.limit(0))).count() == 0


def test_long_texts_are_hashed_in_parts():
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9), dtype=np.uint8)) for _ in range(3 * _CHUNK // 5)]
    long = b" ".join(words)
    giant = b"x" * (_CHUNK + 7)
    texts = [b"a b", long, b"", giant + b" y", b"  c\n"]
    got = {at + i: h for at, blocks in word_hashes(iter(texts)) for i, h in enumerate(blocks)}
    assert sorted(got) == list(range(5)) and len(long) > 2 * _CHUNK
    for i, text in enumerate(texts):
        assert np.array_equal(got[i], hash_block([text])[1])


def test_netpbm_samples_out_of_range(spark):
    pictures = [b"P2\n2 1\n255\n70000 1\n", b"P2\n2 1\n255\n-4 1\n", b"P2\n2 1\n255\n4 1\n"]
    table = spark.createDataFrame([(i, 2, bytearray(p)) for i, p in enumerate(pictures)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.media_features(table).collect()}
    assert got[0].problem and got[1].problem and got[0].payload_bytes is None and got[2].problem is None


def test_vectors_at_the_ends_of_doubles(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1.0, 2.0]), (3, [1e200, 2e200]), (4, [-1e200, 2e200]), (5, [5e-324, 0.0]), (6, [3.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in cap_filters.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


def test_toxicity_without_unlabelled_rows(spark):
    rows = [(i, ("vile awful trash " if i % 5 == 0 else "calm kind garden ") + f"word{i % 7}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in got)
