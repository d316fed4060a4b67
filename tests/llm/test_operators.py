"""Operators of the training-data subpackage against brute force, SQL, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

pytest.importorskip("chatweave.llm")

from chatweave.llm import cap_filters, chat_format, common, line_dedup, lm, media, minhash, mixing, packing, quality_model, toxicity  # noqa: E402
from chatweave.llm.common import components, shingles, word_hashes  # noqa: E402
from chatweave.llm.queries import REGISTRY, tokenizer_path  # noqa: E402
from tests.oracle import connect, differences  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, depth int, a string"
LONG = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, columns with clashing names."""
    rows = [
        (1, LONG, "en", "s", 1, 1, "x"), (2, "short\n" + LONG + "\nend", None, "s", None, None, None), (3, None, None, None, None, None, None),
        (4, "", "en", "s", 0, 0, ""), (5, " \n\t\n", "en", None, 4, 0, ""), (6, "\n".join([LONG, "other", LONG]), "de", "t", 9, 2, "y"),
        (7, "a b c", "en", "s", 5, 1, "z"), (7, "a b c", "en", "s", 5, 1, "z"), (None, LONG, "en", "s", 1, 1, "x"),
        (8, "word " * 50_000, "en", "s", 250_000, 1, "x"), (9, " ".join(f"u{i}" for i in range(40_000)), "fr", "s", 1, 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql is not None])
def test_sql(spark, name):
    assert differences(spark, connect(SF_DIR), name, REGISTRY[name].run, REGISTRY[name].sql, SF_DIR) == []


def test_line_dedup_odd_rows(spark, odd_docs):
    got = {r.doc_id: r for r in line_dedup.without_copies(odd_docs).collect()}
    assert got[1].text == LONG and got[2].text == "short\nend" and got[6].text == "other"
    assert got[None].text == LONG and got[3].text is None and got[5].text == " \n\t\n"
    assert got[2].n_deleted == 1 and got[6].n_deleted == 2 and got[2].depth is None
    assert line_dedup.without_copies(odd_docs.limit(0)).count() == 0


def test_line_dedup_runs_of_short_lines(spark):
    """A run of many short lines counts as one passage, and a common rest is part of it."""
    run = "\n".join(f"line {i} of it" for i in range(14))
    docs = spark.createDataFrame([(1, run + "\nown one"), (2, "own two\n" + run + "\nown three"), (3, "line 3 of it")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.without_copies(docs).collect()}
    assert got == {1: run + "\nown one", 2: "own two\nown three", 3: "line 3 of it"}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(40)}


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(3)
    elements = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    for low in (1, 3):
        n = rng.integers(low, 9, len(elements))
        m = np.where(rng.random(len(elements)) < 0.5, n, rng.integers(low, 9, len(elements)))
        want = np.minimum(n, m).sum() / np.maximum(n, m).sum()
        same = (minhash.bag_minhash(elements, n, 4000) == minhash.bag_minhash(elements, m, 4000)).mean()
        assert abs(same - want) < 0.04
    one = minhash.bag_minhash(elements[:1], np.array([1]), 100)
    assert (one == minhash.bag_minhash(elements[:1], np.array([1]), 100)).all()


def test_words_and_shingles():
    (_, (a, b, c)), = list(word_hashes([b"x y z", b"", b" z\n x  y "]))
    assert len(a) == 3 and len(b) == 0 and list(c) == [a[2], a[0], a[1]]
    assert len(shingles(a, 5)) == 1 and len(shingles(b, 5)) == 0


def test_near_duplicates_odd_rows(spark, odd_docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(odd_docs).collect()}
    assert got[3].kept and got[4].kept and got[5].kept and got[None].kept and got[8].component_id == 8
    assert len(got) == 10 and minhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_near_duplicates_large_groups(spark):
    """A group larger than a block of near copies, half of them too far from the rest."""
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words, f"own{i}"])) for i in range(40)] + [(100 + i, " ".join([*words[:80], *[f"x{i}{j}" for j in range(40)]])) for i in range(40)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(40)) and all(got[100 + i] == 100 + i for i in range(40))


def test_embeddings_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [1.0]), (9, []), (None, [1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cap_filters.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[7] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 8, 9)) and got[None] == (0, None, True)


def test_chat_parts_and_round_trip(spark):
    parts = [
        {"type": "text", "text": "see </turn> \\ <image 9>"}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, None,
        {"type": "audio", "ref": "b.wav", "seconds": 2.0}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": None, "text": "end"},
    ]
    turns = spark.createDataFrame(
        [(1, 0, "user\n>", parts), (1, 1, "assistant", [{"type": "text", "text": "ok <"}]), (2, 0, None, None), (None, None, "assistant", [])],
        f"conv_id long, turn long, role string, parts array<{chat_format.PART}>",
    )
    pieces = chat_format.format_turns(turns).collect()
    first = next(p for p in pieces if p.turn == 0 and p.conv_id == 1)
    assert [(a.kind, a.ref, a.tokens) for a in first.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 50), ("document", "c.pdf", 1536)]
    assert chat_format.parse_piece(first.piece) == ("user\n>", "see </turn> \\ <image 9>end")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    assert got[1].loss_chars == 4 and got[1].loss_sha256 == hashlib.sha256(b"ok <").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[None].n_turns == 1


@pytest.mark.parametrize("shape", [(1, 1), (5, 3), (64, 64), (7, 130)])
def test_media_formats(shape):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (media.decode(media.encode_pgm(image)) == image).all() and (media.decode(media.encode_bmp(image)) == image).all()
    small = media.area_resize(image, 1, 1)[0, 0]
    assert abs(small - image.mean()) < 1e-9 and np.allclose(media.area_resize(image, *shape), image)


def test_media_plain_formats_and_faults(spark):
    assert media.decode(b"P2 # c\n2 1\n255\n7 9").tolist() == [[7, 9]] and media.decode(b"P1\n2 1\n1 0").tolist() == [[0, 255]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]] and media.decode(b"P6\n1 1\n255\nabc").shape == (1, 1, 3)
    rows = spark.createDataFrame([(1, 1, None), (2, 1, bytearray(b"GIF")), (3, 1, bytearray(b"P5\n9 9\n255\n"))], media.MEDIA_SCHEMA)
    assert all(r.problem and r.payload_sha256 is None for r in media.media_features(rows).collect())


def test_media_of_texts(spark, odd_docs):
    for r in media.media_features(media.texts_to_media(odd_docs)).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect():
        data = (r.text or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:]) and r.n_bytes == len(data)


def test_token_ids_are_those_of_the_named_file():
    tokenizer = packing.ByteTokenizer.load(tokenizer_path())
    for text in ("", " a  b\n\n c", "l'été 12'34", "<|endoftext|>", " " * 5000, "x" * 3000, "　 \x1c!"):
        assert list(np.frombuffer(tokenizer.encode(text), "<u4")) == tokenizer._plain.encode(text, add_special_tokens=False).ids


def test_packing(spark, odd_docs):
    rows = packing.pack(odd_docs, tokenizer_path()).toPandas().sort_values(["sequence_id", "offset"])
    ends = rows.groupby("sequence_id")["length"].cumsum()
    assert (rows["offset"] == ends - rows["length"]).all() and ends.max() <= 2048
    assert rows["sequence_id"].nunique() <= rows["length"].sum() // 2048 + 2
    assert packing.pack(odd_docs.limit(0), tokenizer_path()).count() == 0


def test_plan_holds_every_piece_once():
    rng = np.random.default_rng(2)
    lengths, need = np.arange(1, 101), rng.integers(1, 50, 100)
    plan = packing.make_plan(lengths, need, 100)
    length = np.repeat(lengths, need)
    number = np.concatenate([np.arange(n) for n in need])
    sequence, offset = plan.place(length, number)
    fill = np.zeros((sequence.max() + 1, 100), int)
    for n, s, o in zip(length, sequence, offset, strict=True):
        fill[s, o : o + n] += 1
    assert fill.max() == 1 and len(fill) <= (length.sum() / 100) * 1.04


def test_mixing_meets_its_targets():
    import pandas as pd

    cells = pd.DataFrame([(s, g, t, 10 + 7 * i) for i, (s, g, t) in enumerate((s, g, t) for s in "ab" for g in "xy" for t in "pq")], columns=["source", "lang", "topic", "tokens"])
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.3, "y": 0.7}, "topic": {"p": 0.6, "q": 0.4}}
    cells["w"] = mixing.rake(cells, targets, 50)
    for m, want in targets.items():
        assert cells.groupby(m)["w"].sum().to_dict() == pytest.approx(want)


def test_mixing_odd_rows(spark, odd_docs):
    assert mixing.mix(odd_docs).count() == 11 and mixing.mix(odd_docs.limit(0)).count() == 0


def test_classifiers_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    some = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, None), (6, 1, 1), (8, 0, 0)], none.schema)
    for labels in (none, some):
        for got in (toxicity.toxicity(odd_docs, labels).collect(), quality_model.quality(odd_docs, labels).collect()):
            assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)


def test_attention_slopes():
    rng = np.random.default_rng(4)
    x, starts, y = rng.normal(size=(7, quality_model.N_FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    p = quality_model.start_params(rng)
    grads = quality_model.backward(p, x, starts, y)

    def loss(q):
        f = quality_model.forward(q, x, starts)["p"]
        return -(y * np.log(f) + (1 - y) * np.log(1 - f)).mean()

    for k in p:
        step = rng.normal(size=p[k].shape)
        ahead, back = {**p, k: p[k] + 1e-5 * step}, {**p, k: p[k] - 1e-5 * step}
        assert (loss(ahead) - loss(back)) / 2e-5 == pytest.approx((grads[k] * step).sum(), abs=1e-6)


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for name, label, least in (("op7_toxicity", "toxic", 0.9), ("op10_quality_classifier", "quality", 0.95)):
        held = REGISTRY[name].run(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id")
        assert held.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least


def test_language_model(spark, odd_docs):
    got = lm.score(odd_docs).collect()
    assert len(got) == 11 and all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[3] == 1 and {r.doc_id: r.n_tokens for r in got}[9] == 40_001
    assert lm.score(odd_docs.limit(0)).count() == 0


def test_language_model_is_normalised_and_learns(spark):
    rows = REGISTRY["op8_lm_scoring"].run(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert rows["score"].sum() > rows["base_score"].sum()
    params = {
        "X": np.random.default_rng(0).normal(size=(lm.CLASSES * lm.SLOTS, 3 * lm.HIDDEN)), "U": np.eye(lm.HIDDEN, 3 * lm.HIDDEN),
        "C": np.random.default_rng(1).normal(size=(lm.HIDDEN, lm.CLASSES)), "bc": np.zeros(lm.CLASSES),
        "S": np.random.default_rng(2).normal(size=(lm.CLASSES, lm.HIDDEN, lm.SLOTS)), "bs": np.zeros((lm.CLASSES, lm.SLOTS)),
    }
    h = np.random.default_rng(3).normal(size=(1, lm.HIDDEN))
    every = np.arange(lm.CLASSES * lm.SLOTS)
    assert np.exp(lm.log_probabilities(params, np.repeat(h, len(every), 0), every)).sum() == pytest.approx(1)


def test_pipeline_keeps_columns_and_clean_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns and 0 < docs.count() <= n
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= docs.count()


def rates_by_brute_force(docs, targets=None):
    """{doc_id: (rate, copies)} of pandas rows (doc_id, source, lang, topic, tokens), every value raked for itself."""
    cells = docs.groupby(list(mixing.MARGINS), as_index=False)["tokens"].sum()
    targets = {m: mixing.tempered_targets(cells, m) for m in mixing.MARGINS} | (targets or {})
    cells["rate"] = (mixing.BUDGET * cells["tokens"].sum() * mixing.rake(cells, targets) / cells["tokens"]).round(9)
    out = {}
    for r in docs.merge(cells[[*mixing.MARGINS, "rate"]], on=list(mixing.MARGINS)).itertuples():
        chance = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) / 2**32
        out[r.doc_id] = (r.rate, int(r.rate) + (chance < r.rate - int(r.rate)))
    return out


def test_mixing_stage_repeats_rare_documents(spark):
    """The stage gives every document as often as brute force, so that rare sources reach their weights."""
    import collections

    import corpus_pipeline
    import pandas as pd

    rows = [(i, "rare" if i % 50 == 0 else "common", "en", f"text number {i}", None if i % 3 else i) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, copies int")
    got = corpus_pipeline.mixed(spark, docs, SF_DIR)
    assert got.columns == docs.columns
    got = got.collect()
    facts = pd.DataFrame([(i, source, lang, "note", 4) for i, source, lang, *_ in rows], columns=["doc_id", *mixing.MARGINS, "tokens"])
    want = rates_by_brute_force(facts)
    assert max(c for _, c in want.values()) > 1
    assert collections.Counter(r.doc_id for r in got) == {i: c for i, (_, c) in want.items() if c}
    assert {tuple(r) for r in got} <= set(rows)
    share = sum(r.source == "rare" for r in got) / len(got)
    raised = {s: n**mixing.TEMPER for s, n in facts["source"].value_counts().items()}
    assert share == pytest.approx(raised["rare"] / sum(raised.values()), rel=0.1)


def test_language_model_trains_on_every_token(spark, odd_docs, monkeypatch):
    """Runs hold all tokens of all documents in order, and the trainer takes each of them with the state carried on."""
    counts = lm.token_counts(odd_docs)
    vocab = lm.vocabulary(counts)
    rows = lm.training_runs(odd_docs, vocab).collect()
    assert sum(len(r.run) for r in rows) == vocab.n_tokens > 90_000
    assert max(len(r.run) for r in rows) <= lm.SPAN * lm.RUN_SPANS and all(r.spans == -(-len(r.run) // lm.SPAN) for r in rows)
    of_doc_9 = max((r.spot for r in rows), key=lambda spot: len({tuple(r.run) for r in rows if r.spot == spot}))
    units = [u for r in sorted((r for r in rows if r.spot == of_doc_9), key=lambda r: r.place) for u in r.run]
    (_, _, hashes, endings), = lm.token_chunks([" ".join(f"u{i}" for i in range(40_000))])
    assert units == vocab.units(hashes, endings).tolist()

    seen, state_in = [], []
    learn = lm.window_grads

    def watched(p, h, units):
        seen.append(units[units >= 0])
        state_in.append(np.abs(h).sum(1))
        return learn(p, h, units)

    monkeypatch.setattr(lm, "window_grads", watched)
    runs = [np.arange(n) % 1000 for n in [1, 5000, 32, 33, 700] + [64] * 200]
    lm.train_on(lm.start_params(vocab), runs, 0.01)
    assert sorted(np.concatenate(seen)) == sorted(np.concatenate(runs))
    assert sum((s == 0).sum() for s in state_in) == len(runs)  # only a run's first window begins at zero


def test_mixing_rakes_every_value(spark):
    """Thousands of sources of 0.02 % beside one of a third: each has its own target, tempered or given."""
    import pandas as pd

    rows = [(i, "large" if i % 3 == 0 else f"site{i // 2}", ("en", "de")[i % 7 == 0]) for i in range(6000)]
    docs = spark.createDataFrame([(*r, "some words") for r in rows], "doc_id long, source string, lang string, text string")
    facts = pd.DataFrame([(*r, "note", 3) for r in rows], columns=["doc_id", *mixing.MARGINS, "tokens"])
    given = {"source": {"site1": 0.05, "large": 0.5, "site2": 0.45}}
    for targets in (None, given):
        got = mixing.mix(docs, targets).toPandas()
        assert sorted(got["source"]) == sorted(facts["source"])
        want = rates_by_brute_force(facts, targets)
        assert {r.doc_id: (pytest.approx(r.rate, abs=2e-9), r.copies) for r in got.itertuples()} == want
    share = (got["rate"] * got["tokens"]).groupby(got["source"]).sum() / (got["rate"] * got["tokens"]).sum()
    assert share["site1"] == pytest.approx(0.05, abs=0.02) and share.drop(["site1", "large", "site2"]).max() == 0


@pytest.mark.parametrize("n_vectors", [10_000, 100_000])
def test_filters_find_near_pairs_of_large_tables(n_vectors):
    """Pairs at the threshold share a direction at the size of a large table; the fill-up is the exact one."""
    rng = np.random.default_rng(6)
    x, z = rng.normal(size=(2, 1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    code = cap_filters.ProductCode(64, cap_filters.code_words(n_vectors))
    pairs = zip(code.decode(x), code.decode(0.95 * x + np.sqrt(1 - 0.95**2) * z), strict=True)
    assert np.mean([len(np.intersect1d(a, b)) == 0 for a, b in pairs]) <= 0.002
    s, t = rng.normal(size=(2, code.words))
    sums = (s[:, None] + t[None, :]).ravel()
    assert code._largest(s, t).tolist() == np.sort(np.argsort(-sums)[: code.least]).tolist()


def test_token_ids_are_those_of_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    ours, fresh = packing.ByteTokenizer.load(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in ("<|endoftext|>", "one <|endoftext|> two<|endoftext|>", "<|endoftext|", "plain text", " " * 5000 + "<|endoftext|>"):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(ours.encode("a<|endoftext|>b"), "<u4")


def test_a_worker_keeps_one_form_of_the_vocabulary(monkeypatch):
    monkeypatch.setattr(packing.ByteTokenizer, "_loaded", {})
    tokenizer = packing.ByteTokenizer.load(tokenizer_path())
    tokenizer.encode("plain text")
    assert tokenizer._fast is None or "_plain" not in vars(tokenizer)
    assert 50256 in np.frombuffer(tokenizer.encode("a<|endoftext|>b"), "<u4")  # loaded when it is needed
    assert "_plain" in vars(tokenizer)


def test_tasks_give_memory_back(monkeypatch):
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(1))
    whole = common.frugal(lambda batches: (b + 1 for b in batches))
    assert list(whole(iter([1, 2]))) == [2, 3] and done == [1]
    stopped = whole(iter([1, 2]))
    assert next(stopped) == 2
    stopped.close()
    assert done == [1, 1]


def small_model(docs):
    counts = lm.token_counts(docs)
    vocab = lm.vocabulary(counts)
    params = lm.start_params(vocab)
    rng = np.random.default_rng(1)
    return vocab, {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float32) for k, v in params.items()}


def test_documents_of_many_batches_are_scored_side_by_side(odd_docs, monkeypatch):
    """One pass for all batches, so a long document does not run beside those of its own batch alone."""
    import pandas as pd

    vocab, params = small_model(odd_docs)
    texts = ["a b c the " * 900, "", None, "Only words", "x " * 300] * 3
    batches = [pd.DataFrame({"doc_id": [i], "text": [t]}) for i, t in enumerate(texts)]
    alone = pd.concat([f for k, b in enumerate(batches) for f in lm.scored_rows(iter([b]), vocab, params, k)])
    calls, scored = [], lm.log_likelihoods
    monkeypatch.setattr(lm, "log_likelihoods", lambda p, docs: calls.append(len(docs)) or scored(p, docs))
    together = pd.concat(lm.scored_rows(iter(batches), vocab, params, 0))
    assert calls == [len(texts)]
    assert together["row"].tolist() == together["doc_id"].tolist() == list(range(len(texts)))
    for c in ("n_tokens", "known", "base", "model"):
        assert together[c].tolist() == pytest.approx(alone[c].tolist(), rel=1e-6)
    monkeypatch.setattr(lm, "SCORED_TOKENS", 3000)
    calls.clear()
    cut = pd.concat(lm.scored_rows(iter(batches), vocab, params, 0))
    assert calls == [1, 5, 5, 4]
    assert cut["model"].tolist() == pytest.approx(together["model"].tolist(), rel=1e-6)


def test_a_window_unrolled_is_its_steps(odd_docs):
    _, p = small_model(odd_docs)
    rng = np.random.default_rng(5)
    units, h = rng.integers(0, 1000, (12, 7)), rng.normal(0, 0.5, (7, lm.HIDDEN)).astype(np.float32)
    units[9:, 2], begins = -1, np.zeros((12, 7), bool)
    begins[4, 5] = True
    states, _ = lm.unroll(p, h, units, begins)
    for t, row in enumerate(units):
        h[begins[t]] = 0
        assert states[t] == pytest.approx(h, abs=1e-6)
        h = np.where((row >= 0)[:, None], lm.gru_step(p, h, np.maximum(row, 0))[0], h)
    assert states[-1] == pytest.approx(h, abs=1e-6)


def test_steps_in_place_are_adams(monkeypatch):
    """Bit for bit, whatever the parts; what was given stays as it was."""
    from chatweave.llm.fitting import Adam

    rng = np.random.default_rng(2)
    given = {"a": rng.normal(size=(40, 9)).astype(np.float32), "b": rng.normal(size=7).astype(np.float32)}
    before = {k: v.copy() for k, v in given.items()}
    monkeypatch.setattr(lm, "STEP_NUMBERS", 100)
    one, other = Adam(dict(given), 0.01), lm.Steps(given, 0.01)
    for norm in (0.5, np.float64(3.7), 1.0, np.float64(11.0)):
        grads = {k: rng.normal(size=v.shape).astype(np.float32) for k, v in given.items()}
        one.step({k: (g / norm).astype(np.float32) if norm > 1 else g for k, g in grads.items()})
        other.step(grads, norm)
    assert all(np.array_equal(one.params[k], other.params[k]) and np.array_equal(given[k], before[k]) for k in given)


def test_slopes_of_a_window(monkeypatch):
    """Against differences of the loss, with lanes that end early; softmaxes are taken for all classes at once."""
    rng = np.random.default_rng(3)
    shapes = {"X": (lm.CLASSES * lm.SLOTS, 3 * lm.HIDDEN), "U": (lm.HIDDEN, 3 * lm.HIDDEN), "C": (lm.HIDDEN, lm.CLASSES), "bc": (lm.CLASSES,), "S": (lm.CLASSES, lm.HIDDEN, lm.SLOTS), "bs": (lm.CLASSES, lm.SLOTS)}
    p = {k: rng.normal(0, 0.4, s) for k, s in shapes.items()}
    units = rng.integers(0, 100, (9, 5))
    units[6:, 1], units[2:, 3] = -1, -1
    h = rng.normal(0, 0.5, (5, lm.HIDDEN))

    def loss(p):
        total, n = 0.0, 0
        for lane in range(5):
            some, state = units[units[:, lane] >= 0, lane], h[lane : lane + 1]
            for unit in some:
                total -= lm.log_probabilities(p, state, np.array([unit]))[0]
                state, _ = lm.gru_step(p, state, np.array([unit]))
            n += len(some)
        return total / n

    calls, softmax = [], lm._log_softmax
    monkeypatch.setattr(lm, "_log_softmax", lambda x: calls.append(1) or softmax(x))
    grads, after = lm.window_grads(p, h, units)
    assert len(calls) == 2
    state = h[3:4]
    for unit in units[:2, 3]:
        state, _ = lm.gru_step(p, state, np.array([unit]))
    assert after[3] == pytest.approx(state[0], abs=1e-5)
    top = {k: np.unravel_index(np.argsort(-abs(g).ravel())[:4], g.shape) for k, g in grads.items()}
    for k, places in top.items():
        for at in zip(*places, strict=True):
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][at] += 1e-4
            down[k][at] -= 1e-4
            assert grads[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-4, rel=2e-3, abs=1e-5)
