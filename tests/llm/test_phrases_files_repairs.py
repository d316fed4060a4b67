"""Collocations, token files and conversation repair against brute force and round trips."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("chatweave.llm")

from chatweave.llm import collocations, conversation_repair, token_files  # noqa: E402
from chatweave.llm.queries import REGISTRY, tokenizer_path  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, f long, phrase string, rank int, part int"
TURNS = "conv_id long, turn long, role string, text string, again boolean, _conv string"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, extra columns with names used inside."""
    rows = [
        (1, "a b. A\tb, c", "en", "s", 1, 1, "x", 1, 1), (2, None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, 0, "", 0, 0),
        (4, "a b " * 60_000, "en", "s", 1, 1, "", 1, 1), (5, "x y\nx y\x0bx y", None, "s", 1, 1, "", 1, 1), (5, "other x y", "und", "s", 1, 1, "", 1, 1),
        (5, "other x y", "und", "s", 1, 1, "", 1, 1), (None, "x y z", "und", "s", 1, 1, "", 1, 1), (6, " .,; ", "de", "s", 1, 1, "", 1, 1),
    ]
    return spark.createDataFrame(rows, DOCS)


# --- collocations -----------------------------------------------------------------------------


def phrases_by_hand(rows: list[tuple[str | None, str | None]], least: int, top: int) -> set[tuple]:
    counts: dict[str, Counter] = {}
    words: Counter = Counter()
    for lang, text in rows:
        f = counts.setdefault(lang or "und", Counter())
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            f.update(" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, 6) if i + k <= len(w))
    out = set()
    for lang, f in counts.items():
        n, kept = words[lang], []
        candidates = {p: a for p, a in f.items() if a >= least and " " in p}
        for phrase, a in candidates.items():
            if any(100 * b >= 100 * a for p, b in candidates.items() if p != phrase and f" {phrase} " in f" {p} "):
                continue
            w = phrase.split(" ")
            cuts = [(f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min((1000 * a * n // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            kept.append((-score, -a, phrase.encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def test_collocations_by_hand(spark, monkeypatch):
    """On the smallest table, with a low threshold, small shards and many ranges."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    monkeypatch.setattr(collocations, "RANGE_WORDS", 4000)
    monkeypatch.setattr(collocations, "SAMPLE_STRIDE", 40)
    monkeypatch.setattr(collocations, "SAMPLE_SHARE", 2)
    assert sum(map(len, collocations.range_borders(docs.select("lang", "text")).values())) > 5
    got = {tuple(r) for r in collocations.collocations(docs, least=6, top=150).collect()}
    assert got == phrases_by_hand([(r.lang, r.text) for r in docs.collect()], 6, 150)


def test_collocations_of_odd_rows(spark, odd_docs):
    got = {tuple(r) for r in collocations.collocations(odd_docs, least=2).collect()}
    assert got == phrases_by_hand([(r.lang, r.text) for r in odd_docs.collect()], 2, 2000) and got
    assert collocations.collocations(odd_docs.limit(0)).count() == 0


def test_scores_pass_64_bits(spark, monkeypatch):
    a, n = 4_000_000_000_000_037, 9_000_000_000_000_011
    rows = [("en", "", 0, n), ("en", "a", 1, a + 5), ("en", "b", 1, a + 9), ("en", "a b", 2, a)]
    table = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: table)
    (row,) = collocations.collocations(table).collect()
    assert row.score == 1000 * a * n // ((a + 5) * (a + 9))


def test_transducers_of_shards_and_ranges(monkeypatch):
    """Windows come back from their automata; prefixes that a border cuts are summed over their ranges."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(8)] + ["-x", '"q', "é", "A"]
    words = [w for _ in range(40) for w in collocations.words_of(" ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", "\t"]) for _ in range(300)))]
    monkeypatch.setattr(collocations, "SHARD_WORDS", 1500)
    monkeypatch.setattr(collocations, "MERGE_AT", 500)
    borders = sorted({tuple(words[i : i + 2]) + (b"",) * 3 for i in range(0, len(words) - 2, 97) if b"." not in words[i : i + 2]})[::4]
    unions: dict[int, collocations.Union] = {}
    for i, data in collocations.shard_pieces(words, borders):
        _, columns, counts = collocations.paths(data)
        assert len({tuple(int(c[j]) for c in columns) for j in range(len(counts))}) == len(counts)
        unions.setdefault(i, collocations.Union()).add(data)
    got: Counter = Counter()
    for i, union in unions.items():
        for phrase, _, f in union.frequent(3, borders[max(0, i - 1) : i + 1]):
            got[phrase] += f
    want: Counter = Counter({"": sum(w != b"." for w in words)})
    for i in range(len(words)):
        for k in range(1, 6):
            if i + k <= len(words) and b"." not in words[i : i + k]:
                want[b" ".join(words[i : i + k]).decode()] += 1
    assert {p: f for p, f in got.items() if f >= 3} == {p: f for p, f in want.items() if f >= 3}


def test_composition():
    asked, counts = collocations.Transducer(), collocations.Transducer()
    for phrase, f in [("a", 5), ("a b", 3), ("b", 9), ("c a b", 3), ("d b", 3)]:
        counts.add(phrase.split(" "), f)
    for phrase in ["a b", "a c", "b", "d"]:
        asked.add(phrase.split(" "), -1)
    counts.finish()
    assert counts.start.arcs["c"].arcs["a"] is counts.start.arcs["d"] or counts.start.arcs["d"].arcs["b"] is counts.start.arcs["a"].arcs["b"]
    assert dict(collocations.compose(asked.finish(), counts)) == {"a b": 3, "b": 9}


# --- token files ------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 50_257, 2**32])
def test_blocks_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype("<u4")
    ids[::40] = top - 1  # outliers
    blocks = token_files.encode_blocks(ids)
    data, at, out = memoryview(b"".join(blocks)), 0, [np.zeros(0, "<u4")]
    for block in blocks:
        out.append(token_files.decode_block(data, at))
        at += len(block)
    assert np.array_equal(np.concatenate(out), ids)


def test_width_leaves_outliers_to_the_exceptions():
    ids = np.full(1024, 1000, "<u4") + np.arange(1024, dtype="<u4") % 16
    plain = len(token_files.encode_blocks(ids)[0])
    ids[::100] = 4_000_000_000
    patched = len(token_files.encode_blocks(ids)[0])
    assert plain == 9 + 1024 * 4 // 8 and patched == plain + 11 * 6


def test_file_index():
    ids = [np.random.default_rng(i).integers(0, 50_257, i * 700).astype("<u4") for i in range(6)]
    writer = token_files.FileWriter(3)
    chunks = [c for i, some in enumerate(ids) for c in writer.add(i if i else None, some.tobytes())]
    data = b"".join(c + b"\n" for c in [*chunks, *writer.finish()])
    reader = token_files.FileReader(data)
    assert reader.number == 3 and reader.docs == [None, 1, 2, 3, 4, 5] and list(reader.counts) == [700 * i for i in range(6)]
    assert reader.checksums() == [zlib.crc32(some.tobytes()) for some in ids]
    whole = np.concatenate(ids)
    for first, count in ((0, 1), (1023, 2), (5000, 3000), (10_499, 1), (7, 0)):
        assert np.array_equal(reader.ids_of(first, count), whole[first : first + count])


def documents_by_hand(rows: list[tuple]) -> list[tuple]:
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], hashlib.md5((r[1] or "").encode()).hexdigest())):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def by_id(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=lambda r: r[1])


def test_token_files_by_hand(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    monkeypatch.setattr(token_files, "FILE_TEXT_BYTES", 100_000)
    monkeypatch.setattr(token_files, "CHUNK_IDS", 3000)
    got = by_id(REGISTRY["op12_token_files"].run(spark, SF_DIR).collect())
    assert got == documents_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_token_files_of_odd_rows(spark, odd_docs):
    got = by_id(token_files.token_files(odd_docs, tokenizer_path()).collect())
    assert got == documents_by_hand([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert token_files.token_files(odd_docs.limit(0), tokenizer_path()).count() == 0


# --- conversation repair ----------------------------------------------------------------------


def faults_by_hand(rows: list[tuple[str, str]]) -> list[str]:
    seen, out = set(), []
    for row in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", row[1])
        out.append("blank" if not said else "duplicate" if row in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add(row)
    return out


def repair_by_hand(rows: list[tuple[str, str]]) -> tuple[int, str, str]:
    """Tries all edits that cost no more than the best found."""
    faults = faults_by_hand(rows)
    best: tuple | None = None
    waiting = [(0, 0, "", "", ())]
    while waiting:
        cost, i, roles, audit, out = waiting.pop()
        if cost > (best[0] if best else 3 * len(rows)):
            continue
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        steps = [(2, 0, c, "I", (name, "")) for c, name in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            role, text = rows[i]
            waiting.append((cost + 3, i + 1, roles, audit + "D", out))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                steps += [(extra, 1, role[:1], "K", (role, text))]
                steps += [(2 + extra, 1, c, "R", (name, text)) for c, name in (("u", "user"), ("a", "assistant"))]
        for price, on, initial, letter, row in steps:
            if re.fullmatch(r"(s?(ua)*u?)?", roles + initial):
                waiting.append((cost + price, i + on, roles + initial, audit + letter, (*out, row)))
    assert best is not None
    return best[0], best[1], hashlib.sha256("\n".join(":".join(r) for r in best[2]).encode()).hexdigest()


def test_repairs_by_hand():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", " "]), rng.choice(["a.", "b", "c!", " ", "e ", "f.\n"])) for _ in range(rng.randint(0, 6))]
        conversation, seen = conversation_repair._Conversation(conversation_repair.Costs()), set()
        for i, row in enumerate(rows):
            conversation.add(i, *row, row in seen)
            seen.add(row)
        assert conversation.row(1)[6:9] == repair_by_hand(rows)


def test_survivors_coalesce():
    rng = random.Random(2)
    repair = conversation_repair.Repair()
    for i in range(5000):
        repair.add(rng.choice(["user", "assistant", "system"]), f"text {i}.", False, rng.random() < 0.1)
    assert repair.most_held < 100 and len(repair.audit) > 4800


def damaged_by_hand(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out += [(conv, turn, "user" if case == 4 else role, text)] * (case != 0) * (1 + (case == 3))
    return out


def conversations_by_hand(rows: list[tuple]) -> set[tuple]:
    out = set()
    for conv in {r[0] for r in rows}:
        some = sorted(damaged_by_hand([r for r in rows if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        said = [(r[2], r[3]) for r in some]
        turns = {r[1] for r in some if r[1] is not None}
        faults = Counter(faults_by_hand(said))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.add((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, *repair_by_hand(said)))
    return out


def test_conversations_by_hand(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r)[:9] for r in REGISTRY["op13_conversation_repair"].run(spark, SF_DIR).collect()}
    assert got == conversations_by_hand(rows)


def test_conversations_of_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 2, "user", "hm."), (1, None, "user", "first."), (1, 5, "assistant", "last. " * 50_000), (1, 9, "user", "x"),
        (2, 1, "user", "same."), (2, 1, "user", "same."), (2, 4, "user", "same."), (3, 1, "", "no role."), (4, 1, "user", ""), (4, 2, "system", "é?"),
        *[(5, i, "user", "again!") for i in range(6)], *[(c, 0, "assistant", "?") for c in range(10, 40)],
    ]
    turns = spark.createDataFrame([(*r, True, "c") for r in rows], TURNS)
    got = {tuple(r)[:9] for r in conversation_repair.repair(conversation_repair.damaged(turns)).collect()}
    assert got == conversations_by_hand(rows)
    gone = {r[0] for r in rows} - {r[0] for r in damaged_by_hand(rows)}
    assert gone and {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in gone} <= got
    assert conversation_repair.repair(turns.limit(0)).count() == 0
