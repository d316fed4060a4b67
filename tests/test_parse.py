from __future__ import annotations

import pytest

from chatweave.operators.dialect import chat_formats, count_messages
from chatweave.operators.parse import parse_messages

LRM, NNBSP = "\u200e", "\u202f"

CHATS = {
    "pt": "17/04/24, 7:08 da manhã - Rui: cedo\n17/04/24, 7:19 da tarde - Rui: tarde",
    "android-mdy": "4/17/2024, 7:08 AM - Mara: note",
    "ios-dmy": "[17/04/2024, 19:26] Mara: note",
    "att-suffix": "4/17/2024, 7:08 AM - Mara: pier.jpg (file attached)",
    "att-tag": "4/17/2024, 7:08 AM - Mara: <attached: tide.opus>",
    "att-ios": "[17/04/2024, 19:26] Mara: <attached: pier.jpg>",
    "preamble": "noise\n\n03/04/2025, 09:00 - A: x\n\nmore\n  end  \n03/04/2025, 09:01 - B: ",
    "caption": "03/04/2025, 09:00 - A: v.mp4 (ficheiro anexado)\nfirst\nsecond",
    "system": "03/04/2025, 09:00 - You added: Bob\n03/04/2025, 09:00 - Name:\n03/04/2025, 09:00 - plain",
    "lrm": f"{LRM}03/04/2025, 09:00 - A: {LRM}a.pdf (Arquivo Anexado)\n03/04/2025, 09:00 - A: {LRM}<attached: a.pdf>",
    "nnbsp": f"9/20/2025, 9:41{NNBSP}PM - J: hi",
    "noite": "20/09/25, 12:30 da noite - J: a\n20/09/25, 12:30 da MANHÃ - J: b\n20/09/25, 11:30 da noite - J: c",
    "feb30": "30/02/2025, 09:00 - A: bad\n28/02/2025, 25:00 - A: bad\n28/02/2025, 9h - A: bad\n28/2/25, 09:00:59 - A: ok",
    "mixed": "[20/09/2025, 21:41] J: a\n20/09/2025, 21:42 - J: b\n[20/09/2025, 21:43] J: c",
    "nosender": "03/04/2025, 09:00 - x.docx (file attached)\n03/04/2025, 09:00 - A: y.zzz (archivo adjunto)",
    "spaces": "03/04/2025, 09:00 -    : hi",
    "none": "nothing here\nat all",
    "dots": "1/2/2025, 9:05 p. m. - A: x\n1/13/2025, 12:05 a.m. - A: y",
    "u2028": "03/04/2025, 09:00 - A: one\u2028two\u0085three",
}


@pytest.fixture(scope="module")
def parsed(lines_of):
    df = parse_messages(lines_of(CHATS), tz_offset="+00:00", block_rows=2)
    out: dict[str, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r.chat_id, r.msg_idx)):
        out.setdefault(r.chat_id, []).append(r)
    return out


def test_dialects(parsed):
    assert [m.ts for m in parsed["pt"]] == ["2024-04-17T07:08:00+00:00", "2024-04-17T19:19:00+00:00"]
    assert [m.text for m in parsed["pt"]] == ["cedo", "tarde"]
    assert parsed["android-mdy"][0].ts == "2024-04-17T07:08:00+00:00"
    assert parsed["ios-dmy"][0].ts == "2024-04-17T19:26:00+00:00"
    assert parsed["ios-dmy"][0].source_line == "[17/04/2024, 19:26] Mara: note"
    assert [m.msg_idx for m in parsed["pt"]] == [0, 1]


@pytest.mark.parametrize(
    "chat, kind, file",
    [("att-suffix", "image", "pier.jpg"), ("att-tag", "audio", "tide.opus"), ("att-ios", "image", "pier.jpg")],
)
def test_attachments(parsed, chat, kind, file):
    (m,) = parsed[chat]
    assert (m.type, m.text, m.sender) == (kind, None, "Mara")
    assert [(x.file, x.kind, x.converted_file, x.meta) for x in m.media] == [(file, kind, None, None)]


def test_continuations_and_preamble(parsed):
    a, b = parsed["preamble"]
    assert a.text == "x\n\nmore\n  end  "
    assert a.source_line == "03/04/2025, 09:00 - A: x"
    assert (b.sender, b.text, b.type) == ("B", "", "text")
    (c,) = parsed["caption"]
    assert (c.type, c.text, c.media[0].file) == ("video", "first\nsecond", "v.mp4")


def test_senders_and_system(parsed):
    a, b, c = parsed["system"]
    assert (a.sender, a.text, a.type) == ("You added", "Bob", "text")
    assert (b.sender, b.text, b.type) == (None, "Name:", "system")
    assert (c.sender, c.text, c.type) == (None, "plain", "system")
    assert (parsed["spaces"][0].sender, parsed["spaces"][0].text) == (None, ": hi")
    x, y = parsed["nosender"]
    assert (x.sender, x.type, x.media[0].kind) == (None, "document", "document")
    assert (y.sender, y.type, y.media[0].kind) == ("A", "unknown", "unknown")


def test_invisible_characters(parsed):
    a, b = parsed["lrm"]
    assert (a.type, a.media[0].file) == ("document", "a.pdf")
    assert (b.type, b.text) == ("text", f"{LRM}<attached: a.pdf>")
    assert parsed["nnbsp"][0].ts == "2025-09-20T21:41:00+00:00"
    assert parsed["u2028"][0].text == "one\u2028two\u0085three"


def test_clock_edges(parsed):
    assert [m.ts[11:16] for m in parsed["noite"]] == ["12:30", "00:30", "23:30"]
    assert [m.ts for m in parsed["dots"]] == ["2025-01-02T21:05:00+00:00", "2025-01-13T00:05:00+00:00"]


def test_bad_dates(parsed, lines_of):
    assert [(m.ts, m.month, m._parse_error is None) for m in parsed["feb30"]] == [
        (None, "unknown", False),
        (None, "unknown", False),
        (None, "unknown", False),
        ("2025-02-28T09:00:00+00:00", "2025-02", True),
    ]
    with pytest.raises(Exception, match="bad date or time"):
        parse_messages(lines_of({"x": CHATS["feb30"]}), tz_offset="+00:00", mode="FAILFAST").collect()


def test_other_dialect_lines_continue(parsed):
    a, b = parsed["mixed"]
    assert a.text == "a\n20/09/2025, 21:42 - J: b"
    assert b.text == "c"
    assert "none" not in parsed


def test_offset_and_month(lines_of):
    df = parse_messages(lines_of({"c": "1/1/2025, 00:10 - A: x"}), tz_offset="+02:00")
    (m,) = df.selectExpr("*", "unix_timestamp(ts_utc) AS epoch").collect()
    assert m.epoch == 1735683000
    assert m.ts == "2025-01-01T00:10:00+02:00"
    assert m.month == "2025-01"
    with pytest.raises(ValueError):
        parse_messages(lines_of({"c": "x"}), tz_offset="02:00")


def test_formats(lines_of, spark):
    late = "\n".join(["1/1/2025, 09:00 - A: x"] * 2000 + ["25/1/2025, 09:00 - A: x"])
    chats = {
        **{k: CHATS[k] for k in ("pt", "android-mdy", "ios-dmy", "none", "dots")},
        "late": late.replace("09:00", "9:00 AM"),
        "tie": "13/1/2025, 9:00 AM - A: x\n1/13/2025, 9:00 AM - A: x",
        "pt-late": "\n".join(["[1/1/2025, 09:00] A: x"] * 5 + ["01/01/25, 6:30 da manhã - J: b"]),
        "ios-tie": "[13/1/2025, 09:00] A: x\n1/13/2025, 9:00 AM - A: x",
    }
    lines = lines_of(chats)
    got = {r.chat_id: (r.style, r.date_order) for r in chat_formats(lines).collect()}
    assert got == {
        "pt": ("pt", "dmy"),
        "android-mdy": ("android", "mdy"),
        "ios-dmy": ("ios", "dmy"),
        "none": ("android", "dmy"),
        "dots": ("android", "mdy"),
        "late": ("android", "mdy"),
        "tie": ("android", "dmy"),
        "pt-late": ("pt", "dmy"),
        "ios-tie": ("ios", "dmy"),
    }
    forced = {r.chat_id: (r.style, r.date_order) for r in chat_formats(lines, style="android").collect()}
    assert forced["ios-tie"] == ("android", "mdy")
    assert forced["pt-late"] == ("android", "dmy")
    order = {r.chat_id: (r.style, r.date_order) for r in chat_formats(lines, date_order="mdy").collect()}
    assert order["ios-dmy"] == ("ios", "mdy")
    assert order["pt"] == ("pt", "dmy")


def test_order_override(lines_of):
    lines = lines_of({"c": "05/06/2024, 09:00 - Mara: note"})
    dmy = parse_messages(lines, tz_offset="+00:00", style="android", date_order="dmy").first()
    mdy = parse_messages(lines, tz_offset="+00:00", style="android", date_order="mdy").first()
    assert (dmy.ts[:10], mdy.ts[:10]) == ("2024-06-05", "2024-05-06")


@pytest.mark.parametrize("block_rows", [1, 2, 3, 7, 1 << 16])
def test_block_size_does_not_matter(lines_of, block_rows):
    """A chat cut anywhere gives the messages that a plain scan of the lines gives."""
    import random

    rng = random.Random(block_rows)
    chats, expected = {}, []
    for c in range(6):
        lines, current, idx = [], None, -1
        for i in range(rng.randrange(1, 60)):
            if rng.random() < 0.25:
                idx += 1
                lines.append(f"[01/02/2025, 10:{i % 60:02d}] S{i % 3}: m{i}")
                current = [f"c{c}", idx, f"m{i}"]
                expected.append(current)
            else:
                lines.append(rng.choice(["", f"line {i}", "  x "]))
                if current:
                    current[2] += "\n" + lines[-1]
        chats[f"c{c}"] = "\n".join(lines)
    got = parse_messages(lines_of(chats), tz_offset="+00:00", style="ios", block_rows=block_rows)
    assert sorted((r.chat_id, r.msg_idx, r.text) for r in got.collect()) == sorted(map(tuple, expected))


def test_count_messages(lines_of, parsed):
    counts = {r.chat_id: r.n_messages for r in count_messages(lines_of(CHATS)).collect()}
    assert {k: v for k, v in counts.items() if v} == {k: len(v) for k, v in parsed.items()}
    assert counts["none"] == 0


@pytest.mark.parametrize(
    ("clock", "time"),
    [("9:41:30 PM", "21:41"), ("12:05:09 AM", "00:05"), ("9:05:10 p. m.", "21:05"), ("12:30:00 PM", "12:30"), ("21:41:30", "21:41")],
)
@pytest.mark.parametrize("line", ["[4/17/2024, {}] Mara: note", "4/17/2024, {} - Mara: note"])
def test_clock_with_seconds(lines_of, line, clock, time):
    text = "\n".join([line.format(clock), line.format(clock)])
    assert [m.ts[11:16] for m in parse_messages(lines_of({"c": text}), tz_offset="+00:00").collect()] == [time, time]


def test_overrides_per_chat(spark, lines_of):
    rows = [("a", "android", "MDY"), ("b", None, "dmy"), ("c", "ios", None), ("d", "none", "auto"), ("other", "pt", "dmy")]
    overrides = spark.createDataFrame(rows, "chat_id string, style string, date_order string")
    lines = lines_of({c: "01/02/2025, 09:00 - A: x" for c in "abcde"})
    got = {r.chat_id: r.ts[:10] for r in parse_messages(lines, tz_offset="+00:00", overrides=overrides, block_rows=2).collect()}
    assert got == {"a": "2025-01-02", "b": "2025-02-01", "d": "2025-02-01", "e": "2025-02-01"}
    formats = {r.chat_id: (r.style, r.date_order) for r in chat_formats(lines, overrides=overrides).collect()}
    assert formats["a"] == ("android", "mdy") and formats["c"][0] == "ios" and len(formats) == 5


def test_sample_of_all_lines(lines_of):
    lines = lines_of({"c": "01/02/2025, 09:00 - A: x\n01/13/2025, 09:00 - A: y"})
    orders = [chat_formats(lines, sample_lines=n).first().date_order for n in (1, 2, None)]
    assert orders == ["dmy", "mdy", "mdy"]
