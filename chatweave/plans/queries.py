"""Registered queries: name -> (Spark query, SQL that states the same result or None)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.functions import naming, text
from chatweave.operators import audio, dialect, enrich, markdown, media, model, quality, report, retry, runs
from chatweave.plans import inputs as inp
from chatweave.plans.session import ensure_checkpoint_dir, store
from chatweave.operators.parse import parse_messages
from chatweave.operators.parts import parse_parts, whole_messages
from chatweave.sources import exports
from chatweave.sources.archives import read_archive_lines
from chatweave.sources.chats import read_chat_lines
from chatweave.sources.manifest import append_events, parse_manifest, read_events
from chatweave.streaming import incremental


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        REGISTRY[fn.__name__] = Query(fn, sql)
        return fn

    return register


def _joined(items: Column | str) -> Column:
    return F.array_join(items, ",")


# --- parsing ----------------------------------------------------------------------------------


@query(f"WITH {inp.CHAT_SQL} SELECT chat_id, msg_idx, ts, month, sender, sender_id, type, text, source_line FROM msgs")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.chat_messages(spark, sf_dir).select(
        "chat_id", "msg_idx", "ts", "month", "sender", "sender_id", "type", "text", "source_line"
    )


@query(f"WITH {inp.CHAT_SQL} SELECT chat_id, msg_idx, ts, month, sender, sender_id, type, text FROM msgs")
def export_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chats written as export folders and archives, and read from there: hidden names, two kinds of line
    ends, a line before the first message, clocks with seconds."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/chatweave-exports-{uuid.uuid4().hex}"
    inp.export_folders(inp.chat_lines(spark, sf_dir, seconds=True), folder)
    zipped, _ = read_archive_lines(spark, folder)
    name = F.regexp_extract("chat_id", r"/_([^/]*)\.zip$", 1).alias("chat_id")
    lines = read_chat_lines(spark, folder).unionByName(zipped.select(name, "path", "line_no", "line"))
    messages = parse_messages(lines, tz_offset=inp.UTC, me=["User"], them=["assistant"])
    return messages.select("chat_id", "msg_idx", "ts", "month", "sender", "sender_id", "type", "text")


@query(f"WITH {inp.CHAT_SQL} SELECT chat_id, msg_idx, ts, sender, type, text FROM msgs")
def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages cut into part rows of three lines over blocks of sixteen, and put together again."""
    parts = parse_parts(inp.chat_lines(spark, sf_dir), tz_offset=inp.UTC, block_rows=16, part_lines=3)
    return whole_messages(parts).select("chat_id", "msg_idx", "ts", "sender", "type", "text")


@query(
    """
    SELECT DISTINCT CAST(conv_id AS VARCHAR) AS chat_id,
           CASE conv_id % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE 'pt' END AS style,
           CASE conv_id % 3 WHEN 0 THEN 'mdy' ELSE 'dmy' END AS date_order
    FROM conversations
    """
)
def chat_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.chat_formats(inp.chat_lines(spark, sf_dir))


@query(
    """
    SELECT DISTINCT CAST(conv_id AS VARCHAR) AS chat_id, 'android' AS style,
           CASE conv_id % 3 WHEN 0 THEN 'mdy' ELSE 'dmy' END AS date_order
    FROM conversations
    """
)
def chat_dialects_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style is given, the date order is still voted on by the lines that have that style."""
    return dialect.chat_formats(inp.chat_lines(spark, sf_dir), style="android")


@query("SELECT CAST(conv_id AS VARCHAR) AS chat_id, count(*) AS n_messages FROM conversations GROUP BY conv_id")
def chat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.count_messages(inp.chat_lines(spark, sf_dir))


@query(
    f"""
    WITH {inp.PAGES_SQL}
    SELECT chat_id, msg_idx, CASE WHEN attached THEN kind ELSE 'text' END AS type,
           CASE WHEN attached THEN file END AS file,
           CASE WHEN NOT attached THEN 'see ' || file END AS text
    FROM att
    """
)
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.attachment_messages(spark, sf_dir).select(
        "chat_id", "msg_idx", "type", F.get("media.file", F.lit(0)).alias("file"), "text"
    )


@query(f"WITH {inp.PAGES_SQL} SELECT page_id, file, kind FROM page_kinds")
def media_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.page_files(spark, sf_dir).select("page_id", "file", naming.guess_kind(F.col("file")).alias("kind"))


@query(
    r"""
    WITH refs AS (
      SELECT page_id, CASE page_id % 4 WHEN 0 THEN './' || p WHEN 1 THEN replace(p, '/', chr(92))
                      WHEN 2 THEN ' ' || p || ' ' ELSE p END AS file
      FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)
    ),
    norm AS (
      SELECT page_id, file, regexp_replace(trim(replace(file, chr(92), '/')), '^\./', '') AS normalized FROM refs
    ),
    names AS (
      SELECT *, regexp_extract(regexp_replace(normalized, '(/+\.?)+$', ''), '([^/]*)$', 1) AS n1,
             regexp_extract(regexp_replace(file, '(/+\.?)+$', ''), '([^/]*)$', 1) AS n2
      FROM norm
    ),
    bases AS (
      SELECT *, left(n1, length(n1) - length(regexp_extract(n1, '^.+(\.[^.]+)$', 1))) AS b1,
             left(n2, length(n2) - length(regexp_extract(n2, '^.+(\.[^.]+)$', 1))) AS legacy
      FROM names
    ),
    stems AS (
      SELECT *, coalesce(nullif(regexp_replace(regexp_replace(b1, '[^A-Za-z0-9._-]+', '_', 'g'),
                                               '^[._-]+|[._-]+$', '', 'g'), ''), 'media')
                || '__' || substr(sha1(normalized), 1, 12) AS stem
      FROM bases
    )
    SELECT page_id, file, normalized, stem, legacy,
           CASE WHEN stem = legacy THEN stem ELSE stem || ',' || legacy END AS candidates
    FROM stems
    """
)
def artifact_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    form = F.col("page_id") % 4
    file = (
        F.when(form == 0, F.concat(F.lit("./"), path))
        .when(form == 1, F.translate(path, "/", "\\"))
        .when(form == 2, F.concat(F.lit(" "), path, F.lit(" ")))
        .otherwise(path)
    )
    return inp.table(spark, sf_dir, "pages").select("page_id", file.alias("file")).select(
        "page_id",
        "file",
        naming.normalize_media_ref(F.col("file")).alias("normalized"),
        naming.artifact_stem(F.col("file")).alias("stem"),
        naming.legacy_stem(F.col("file")).alias("legacy"),
        _joined(naming.candidate_stems(F.col("file"))).alias("candidates"),
    )


# --- media work -------------------------------------------------------------------------------


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work list, stored: the plans below read it several times."""
    return store(media.work_list(inp.attachment_messages(spark, sf_dir)))


@query(
    f"WITH {inp.PAGES_SQL} SELECT chat_id, file, kind, row_number() OVER (PARTITION BY chat_id, kind ORDER BY file) - 1 AS place FROM work"
)
def media_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.sorted_work(media.work_list(inp.attachment_messages(spark, sf_dir)))


@query(
    f"""
    WITH {inp.PAGES_SQL}
    SELECT chat_id, file, kind FROM work w
    WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.chat_id = w.chat_id AND l.file = w.file)
    """
)
def media_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.missing_files(_work(spark, sf_dir), inp.page_listing(spark, sf_dir))


@query(f"WITH {inp.PAGES_SQL} SELECT chat_id, file, kind FROM found WHERE stem IS NULL")
def media_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.without_artifact(_work(spark, sf_dir), inp.page_artifacts(spark, sf_dir))


@query(f"WITH {inp.PAGES_SQL} SELECT chat_id, file, kind, stem FROM found WHERE stem IS NOT NULL")
def media_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.with_artifact(_work(spark, sf_dir), inp.page_artifacts(spark, sf_dir))


_PLAN_SQL = f"""
WITH {inp.PAGES_SQL},
joined AS (
  SELECT f.chat_id, f.file, f.kind, f.stem, l.file IS NOT NULL AS present,
         coalesce(c.has_mp3, false) AS has_mp3, coalesce(c.has_wav, false) AS has_wav
  FROM found f LEFT JOIN listing l ON l.chat_id = f.chat_id AND l.file = f.file
  LEFT JOIN conv c ON c.chat_id = f.chat_id AND c.file = f.file
),
plan AS (
  SELECT chat_id, file, kind, present, stem,
    CASE WHEN NOT present THEN 'missing' WHEN stem IS NULL THEN 'create'
         WHEN kind = 'audio' THEN 'recheck' ELSE 'skip' END AS text_action,
    CASE WHEN NOT present OR kind <> 'audio' THEN NULL
         WHEN stem IS NULL AND has_wav THEN 'skip' WHEN stem IS NULL THEN 'create'
         WHEN NOT has_wav THEN 'create_if_flagged' END AS wav_action,
    CASE WHEN NOT present OR kind <> 'audio' THEN NULL WHEN has_mp3 THEN 'skip' ELSE 'create' END AS mp3_action
  FROM joined
)"""


@query(f"{_PLAN_SQL} SELECT * FROM plan")
def media_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_plan(
        _work(spark, sf_dir),
        inp.page_listing(spark, sf_dir),
        inp.page_artifacts(spark, sf_dir),
        inp.page_converted(spark, sf_dir),
        media.MediaOptions(convert_audio="mp3"),
    )


@query(
    f"""
    {_PLAN_SQL}
    SELECT chat_id, 'missing_file' AS type, file, kind FROM plan WHERE text_action = 'missing'
    UNION ALL SELECT chat_id, 'audio_wav_skipped', file, kind FROM plan WHERE wav_action = 'skip'
    UNION ALL SELECT chat_id, 'audio_mp3_skipped', file, kind FROM plan WHERE mp3_action = 'skip'
    UNION ALL SELECT chat_id, 'audio_transcript_skipped', file, kind FROM plan WHERE text_action = 'recheck'
    UNION ALL SELECT chat_id, 'image_ocr_skipped', file, kind FROM plan WHERE text_action = 'skip'
    """
)
def media_plan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.plan_events(media_plan(spark, sf_dir))


@query(f"WITH {inp.PAGES_SQL} SELECT chat_id, file, converted_file FROM conv")
def converted_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.find_converted(_work(spark, sf_dir), inp.page_converted(spark, sf_dir))


@query(
    f"""
    WITH {inp.PAGES_SQL}
    SELECT a.chat_id, a.msg_idx, CASE WHEN a.attached THEN a.kind ELSE 'text' END AS type,
           CASE WHEN a.attached THEN a.file END AS file, c.converted_file,
           CASE WHEN f.kind = 'audio' THEN f.rel_path END AS transcript_file,
           CASE WHEN f.kind = 'audio' THEN f.text END AS transcript_text,
           CASE WHEN f.kind = 'image' THEN f.rel_path END AS ocr_text_file,
           CASE WHEN f.kind = 'image' THEN f.text END AS ocr_text
    FROM att a
    LEFT JOIN found f ON a.attached AND f.chat_id = a.chat_id AND f.file = a.file AND f.kind = a.kind
    LEFT JOIN conv c ON a.attached AND c.chat_id = a.chat_id AND c.file = a.file
    """
)
def enriched_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.enrich_messages(
        store(inp.attachment_messages(spark, sf_dir)), inp.page_artifacts(spark, sf_dir), inp.page_converted(spark, sf_dir)
    )
    return rows.select(
        "chat_id",
        "msg_idx",
        "type",
        F.get("media.file", F.lit(0)).alias("file"),
        F.get("media.converted_file", F.lit(0)).alias("converted_file"),
        "enrichment.transcript_file",
        "enrichment.transcript_text",
        "enrichment.ocr_text_file",
        "enrichment.ocr_text",
    )


@query(
    """
    WITH h AS (SELECT vec_id, [CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) for x in embedding] AS h FROM embeddings),
    m AS (
      SELECT vec_id, sum(c) AS total, sum(c * i) AS weighted
      FROM (SELECT vec_id, unnest(h) AS c, generate_subscripts(h, 1) - 1 AS i FROM h) GROUP BY vec_id
    )
    SELECT vec_id, weighted / CASE WHEN total = 0 THEN 1 ELSE total END >= 31.5 AS keep FROM m
    """
)
def ocr_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, scaled to counts, stand for edge histograms; the threshold is near their middle."""
    hist = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("long"))
    images = inp.table(spark, sf_dir, "embeddings").select("vec_id", hist.alias("edge_hist"))
    return media.likely_text(images, edge_threshold=31.5).select("vec_id", "keep")


@query(
    f"""
    WITH {inp.PAGES_SQL}
    SELECT chat_id, file, CASE WHEN row_number() OVER (PARTITION BY chat_id ORDER BY file) <= 2
                               THEN 'create' ELSE 'deferred' END AS ocr_action
    FROM work WHERE kind = 'image'
    """
)
def ocr_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _work(spark, sf_dir).where(F.col("kind") == "image").select("chat_id", "file")
    return media.cap_per_chat(images, 2)


def _reads_names() -> Callable[[dict], str]:
    def model_fn(row: dict) -> str:
        if len(row["file"]) % 3 == 0:
            raise ValueError("cannot read")
        return row["file"].upper()

    return model_fn


@query(
    f"""
    {_PLAN_SQL},
    sizes AS (SELECT chat_id, file, max(length(html)) AS n FROM page_files GROUP BY ALL),
    todo AS (
      SELECT chat_id, file, n % 5 = 0 OR n % 37 >= 18 AS keep
      FROM plan JOIN sizes USING (chat_id, file) WHERE kind = 'image' AND text_action = 'create'
    ),
    dealt AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY file) <= 1 AS now FROM todo WHERE keep),
    log AS (
      SELECT chat_id, 'image_ocr_filtered' AS type FROM todo WHERE NOT keep
      UNION ALL SELECT chat_id, 'image_ocr_deferred' FROM dealt WHERE NOT now
      UNION ALL SELECT chat_id, CASE WHEN length(file) % 3 = 0 THEN 'image_ocr_failed' ELSE 'image_ocr_created' END
      FROM dealt WHERE now
    )
    SELECT chat_id, type, count(*) AS n FROM log GROUP BY ALL
    """
)
def ocr_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The OCR of images still to be done: gate, cap of 1 per chat, model. The page's length gives the
    histogram; every fifth has none."""
    n = F.max(F.length("html"))
    hist = F.when(n % 5 != 0, F.concat(F.array_repeat(F.lit(0).cast("long"), (n % 37).cast("int")), F.array(F.lit(1).cast("long"))))
    hists = inp.page_files(spark, sf_dir).groupBy("chat_id", "file").agg(hist.alias("edge_hist"))
    plan = media_plan(spark, sf_dir).where("kind = 'image' AND text_action = 'create'").select("chat_id", "file")
    _, log = model.read_images(plan.join(hists, ["chat_id", "file"]), _reads_names, cap=1)
    return log.groupBy("chat_id", "type").agg(F.count(F.lit(1)).alias("n"))


# --- audio chunks -----------------------------------------------------------------------------


@query(
    """
    SELECT doc_id, i AS chunk_idx, i * 480000 AS start_frame, least(480000, n_chars * 1000 - i * 480000) AS n_frames
    FROM (SELECT doc_id, n_chars,
                 unnest(generate_series(0, CAST(floor((n_chars * 1000 - 1) / 480000) AS BIGINT))) AS i
          FROM documents WHERE n_chars > 0)
    """
)
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a clip of 1000 frames per character."""
    clips = inp.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 1000).alias("nframes"))
    return audio.chunk_plan(clips).select(
        "doc_id",
        F.col("chunk_idx").cast("long").alias("chunk_idx"),
        F.col("start").alias("start_frame"),
        F.col("length").alias("n_frames"),
    )


@query(
    """
    SELECT conv_id, string_agg(trim(text, ' ' || chr(10) || chr(9)), ' ' ORDER BY turn) AS text
    FROM conversations GROUP BY conv_id
    """
)
def chunk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.join_chunks(inp.table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query(
    """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_linenumber > 5 THEN 'not mono' WHEN l_linestatus = 'O' THEN 'wrong sample rate'
                WHEN l_returnflag = 'R' THEN 'not 16-bit' END AS reject_reason
    FROM lineitem
    """
)
def audio_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = inp.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") > 5, 2).otherwise(1).alias("channels"),
        F.when(F.col("l_linestatus") == "O", 8000).otherwise(16000).alias("rate"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("sampwidth"),
    )
    return audio.check_audio(clips).select("l_orderkey", "l_linenumber", "reject_reason")


# --- text published ---------------------------------------------------------------------------


@query(
    """
    SELECT conv_id, turn, trim(s) AS stripped,
           CASE WHEN lower(trim(s)) = 'user' THEN 'ME' WHEN lower(trim(s)) = 'assistant' THEN 'THEM' ELSE trim(s) END AS sender_id
    FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN upper(role) ELSE ' ' || role || ' ' END AS s
          FROM conversations)
    """
)
def sender_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.col("turn") % 3
    sender = (
        F.when(form == 0, F.col("role")).when(form == 1, F.upper("role")).otherwise(F.concat(F.lit(" "), "role", F.lit(" ")))
    )
    return inp.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        text.strip(sender).alias("stripped"),
        text.sender_to_id(sender, ["User"], ["ASSISTANT", "user"]).alias("sender_id"),
    )


@query(
    """
    SELECT conv_id, turn, '' AS clip_0, CASE WHEN length(t) <= 1 THEN t ELSE '…' END AS clip_1,
           CASE WHEN length(t) <= 80 THEN t ELSE left(t, 79) || '…' END AS clip_80
    FROM (SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9)) AS t FROM conversations)
    """
)
def text_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", *[text.clip(F.col("text"), n).alias(f"clip_{n}") for n in (0, 1, 80)]
    )


@query(
    f"""
    WITH {inp.CHAT_SQL},
    marked AS (SELECT *, lag(month) OVER (PARTITION BY chat_id ORDER BY msg_idx) AS prev FROM msgs)
    SELECT chat_id, msg_idx,
      CASE WHEN msg_idx = 0 THEN '# WhatsApp Transcript' || chr(10) || chr(10) ELSE '' END
      || CASE WHEN prev IS NULL OR prev <> month THEN chr(10) || '## ' || month || chr(10) || chr(10) ELSE '' END
      || '- **' || strftime(t, '%Y-%m-%d %H:%M') || '** — '
      || CASE WHEN type = 'system' THEN '*(system)*' ELSE '**' || coalesce(sender_id || ' (' || sender || ')', 'SYSTEM') || '**' END
      || ': ' || trim(text, ' ' || chr(10) || chr(9)) AS md
    FROM marked
    """
)
def chat_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.transcript_lines(inp.chat_messages(spark, sf_dir))


@query(
    f"""
    WITH {inp.PAGES_SQL}
    SELECT a.chat_id, a.msg_idx,
      '- **2024-01-31 09:00** — **' || a.chat_id || '**: '
      || CASE WHEN NOT a.attached THEN 'see ' || a.file
         ELSE '*' || a.kind || '* (' || a.file || ')'
           || CASE WHEN trim(f.text) <> '' THEN chr(10) || '  - ' || CASE f.kind WHEN 'audio' THEN 'Transcript' ELSE 'OCR' END || ': '
              || CASE WHEN length(trim(f.text)) <= 40 THEN trim(f.text) ELSE left(trim(f.text), 39) || '…' END ELSE '' END
         END AS md
    FROM att a LEFT JOIN found f ON a.attached AND f.chat_id = a.chat_id AND f.file = a.file AND f.kind = a.kind
    """
)
def media_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.enrich_messages(store(inp.attachment_messages(spark, sf_dir)), inp.page_artifacts(spark, sf_dir))
    return rows.select("chat_id", "msg_idx", markdown.bullet(40).alias("md"))


@query(
    f"""
    WITH {inp.ORDERS_SQL}
    SELECT chat_id, msg_idx, month,
           coalesce(lag(month) OVER (PARTITION BY chat_id ORDER BY msg_idx) <> month, true) AS new_month
    FROM om
    """
)
def month_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = inp.order_messages(spark, sf_dir).select("chat_id", "msg_idx", "month")
    return markdown.with_month_headings(messages, sparse=True)  # order numbers have gaps


@query(f"WITH {inp.ORDERS_SQL} SELECT chat_id, month, count(*) AS n_messages FROM om GROUP BY ALL")
def month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.months(inp.order_messages(spark, sf_dir))


_INCREMENTAL_SQL = f"""
WITH {inp.ORDERS_SQL},
written AS (
  SELECT chat_id, month, ts, CASE WHEN sender = '5-LOW' THEN 'edited ' || source_line ELSE source_line END AS source_line,
         row_number() OVER (PARTITION BY chat_id, month ORDER BY msg_idx DESC) AS rn
  FROM om WHERE status = 'F'
),
located AS (
  SELECT w.chat_id, w.month, max(o.msg_idx) AS marker_idx
  FROM written w LEFT JOIN om o ON o.chat_id = w.chat_id AND o.ts = w.ts AND o.source_line = w.source_line
  WHERE rn = 1 GROUP BY ALL
)"""


def _located(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Messages, and markers of an earlier run that wrote the finished orders; some of its header
    lines have been edited since, so their months have to be written again."""
    messages = inp.order_messages(spark, sf_dir)
    edited = F.when(F.col("sender") == "5-LOW", F.concat(F.lit("edited "), "source_line")).otherwise(F.col("source_line"))
    written = messages.where(F.col("status") == "F").select(
        "chat_id", "month", F.lit(1).alias("batch"), "msg_idx", "ts", edited.alias("source_line")
    )
    return messages, incremental.locate_markers(messages, incremental.last_markers(written))


@query(
    f"""
    {_INCREMENTAL_SQL}
    SELECT o.chat_id, o.month, o.msg_idx, o.ts, o.source_line
    FROM om o LEFT JOIN located l ON l.chat_id = o.chat_id AND l.month = o.month
    WHERE l.marker_idx IS NULL OR o.msg_idx > l.marker_idx
    """
)
def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, located = _located(spark, sf_dir)
    return incremental.after_markers(messages, located).select("chat_id", "month", "msg_idx", "ts", "source_line")


@query(f"{_INCREMENTAL_SQL} SELECT chat_id, 'by_month_marker_missing' AS type, month FROM located WHERE marker_idx IS NULL")
def missing_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.missing_marker_events(_located(spark, sf_dir)[1])


# --- reports ----------------------------------------------------------------------------------


@query(
    f"""
    WITH {inp.CHAT_SQL}
    SELECT chat_id, count(*) AS n_messages, min(ts) AS first_ts, max(ts) AS last_ts,
           coalesce(array_to_string(list_sort(list_distinct(list(sender))), ','), '') AS participants
    FROM msgs GROUP BY chat_id
    """
)
def chat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.chat_report(inp.chat_messages(spark, sf_dir)).withColumn("participants", _joined("participants"))


@query(f"WITH {inp.ORDERS_SQL} SELECT chat_id, sender, count(*) AS n_messages FROM om GROUP BY ALL")
def chat_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.participants(inp.order_messages(spark, sf_dir))


@query(
    f"""
    WITH {inp.CHAT_SQL},
    r AS (
      SELECT chat_id, count(*) AS n, min(ts) AS a, max(ts) AS b,
             coalesce(array_to_string(list_sort(list_distinct(list(sender))), ', '), '') AS p
      FROM msgs GROUP BY chat_id
    )
    SELECT chat_id, array_to_string([
      '# Chat Report', '', '- Chat file: `' || chat_id || '.txt`', '- Export folder: `exports/' || chat_id || '`',
      '- Output folder: `out`', '- Resume: `True`', '- TZ: `+00:00`', '',
      '- Date range: `' || a || '` → `' || b || '`',
      '- Participants detected: ' || CASE WHEN p = '' THEN '(none)' ELSE p END,
      '- ME mapping: User', '- THEM mapping: (none)', '', '## Outputs', '', '- messages: `out/messages`', '',
      '## Summary', '', '- n_messages: ' || n], chr(10)) AS report
    FROM r
    """
)
def chat_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.chat_report(inp.chat_messages(spark, sf_dir))
    return report.report_text(
        rows,
        chat_file=F.concat("chat_id", F.lit(".txt")),
        export_folder=F.concat(F.lit("exports/"), "chat_id"),
        out_dir="out",
        resume=True,
        tz=inp.UTC,
        outputs={"messages": "out/messages"},
        counters=["n_messages"],
        me=["User"],
    )


# --- transcript quality -----------------------------------------------------------------------


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inp.spread(inp.transcripts(spark, sf_dir).select("doc_id", "text"))
    return quality.with_tokens(docs, "text").select("doc_id", "_clean", "_tokens")


@query(f"WITH {inp.NOISY_SQL} SELECT doc_id, {inp.clean_sql('text')} AS clean FROM noisy")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inp.spread(inp.noisy_documents(spark, sf_dir))
    return docs.select("doc_id", quality.normalize_text(F.col("text")).alias("clean"))


_QUALITY_SQL = f"WITH {inp.TRANSCRIPTS_SQL}, {inp.quality_sql('transcripts')}"


@query(f"{_QUALITY_SQL} SELECT doc_id, token_count, unique_tokens FROM q")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select(
        "doc_id",
        F.size("_tokens").cast("long").alias("token_count"),
        F.size(F.array_distinct("_tokens")).cast("long").alias("unique_tokens"),
    )


@query(f"{_QUALITY_SQL} SELECT doc_id, max_token_run FROM q")
def token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.token_measures(_words(spark, sf_dir)).select(
        "doc_id", F.col("max_token_run").cast("long").alias("max_token_run")
    )


@query(f"{_QUALITY_SQL} SELECT doc_id, r3, r4, r5 FROM q")
def phrase_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _words(spark, sf_dir).drop("_clean")
    for n in (3, 4, 5):
        df = df.withColumn(f"r{n}", quality.max_repeat(quality.ngrams(F.col("_tokens"), n)))
    return df.select("doc_id", *[F.col(f"r{n}").cast("long").alias(f"r{n}") for n in (3, 4, 5)])


@query(f"{_QUALITY_SQL} SELECT doc_id, max_sentence_repeat FROM q")
def sentence_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _words(spark, sf_dir).drop("_tokens")
    df = df.withColumn("max_sentence_repeat", quality.max_repeat(quality.sentences(F.col("_clean"))))
    return df.select("doc_id", F.col("max_sentence_repeat").cast("long").alias("max_sentence_repeat"))


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess_quality(inp.spread(inp.transcripts(spark, sf_dir)))


@query(
    f"""
    {_QUALITY_SQL}
    SELECT doc_id, len(issues) = 0 AS ok, array_to_string(issues, ',') AS issues, char_count, token_count,
           CASE WHEN clean <> '' THEN max_token_run END AS max_token_run,
           CASE WHEN clean <> '' THEN max_phrase_repeat END AS max_phrase_repeat,
           CASE WHEN clean <> '' THEN max_sentence_repeat END AS max_sentence_repeat
    FROM q
    """
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = ("char_count", "token_count", "max_token_run", "max_phrase_repeat", "max_sentence_repeat")
    return _assessed(spark, sf_dir).select(
        "doc_id",
        "quality.ok",
        _joined("quality.issues").alias("issues"),
        *[F.col(f"quality.metrics.{m}").cast("long").alias(m) for m in metrics],
    )


@query(f"{_QUALITY_SQL} SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM q) GROUP BY issue")
def quality_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # explode() makes Catalyst infer a filter on the issues and compute them twice; the outer form does not.
    issues = _assessed(spark, sf_dir).select(F.explode_outer("quality.issues").alias("issue"))
    return issues.where(F.col("issue").isNotNull()).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""
    {_QUALITY_SQL},
    flagged AS (
      SELECT t.lang, t.source, q.doc_id, array_to_string(issues, ',') AS issues, token_count,
             row_number() OVER (PARTITION BY t.lang, t.source ORDER BY q.doc_id) AS rn
      FROM q JOIN transcripts t USING (doc_id) WHERE len(issues) > 0
    )
    SELECT lang, source, doc_id, issues AS before_issues, token_count AS before_tokens FROM flagged WHERE rn = 1
    """
)
def retry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, source) stands for a file that was transcribed many times; the first flagged one counts."""
    rows = retry.retry_candidates(_assessed(spark, sf_dir).drop("text"), ["lang", "source"], "doc_id")
    return rows.select(
        "lang", "source", "doc_id", _joined("before_issues").alias("before_issues"),
        F.col("before_tokens").cast("long").alias("before_tokens"),
    )


@query(
    f"""
    {_QUALITY_SQL},
    pairs AS (
      SELECT b.doc_id, len(b.issues) AS nb, len(a.issues) AS na, a.token_count AS ta
      FROM q b JOIN q a ON a.doc_id = b.doc_id + 1 WHERE len(b.issues) > 0
    )
    SELECT doc_id, na = 0 OR (na < nb AND ta >= 8) AS replaced,
           CASE WHEN na = 0 OR (na < nb AND ta >= 8) THEN NULL
                WHEN na < nb AND ta < 8 THEN 'quality_improved_but_too_short'
                ELSE 'quality_not_improved' END AS reason,
           na > 0 AS still_flagged
    FROM pairs
    """
)
def retry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retry of a transcript is the next document's text."""
    assessed = store(_assessed(spark, sf_dir).select("doc_id", "quality"))
    first = retry.retry_candidates(assessed, ["doc_id"], "doc_id")
    again = assessed.select(
        (F.col("doc_id") - 1).alias("doc_id"), "quality", F.lit(None).cast("string").alias("error")
    )
    return retry.decide_retry(first, again, ["doc_id"]).select("doc_id", "replaced", "reason", "still_flagged")


# --- user models ------------------------------------------------------------------------------


def _fails_on_german() -> Callable[[dict], str]:
    def model_fn(row: dict) -> str:
        if row["lang"] == "de":
            raise ValueError(f"cannot read {row['doc_id']}")
        return row["text"].replace("e", "x")

    return model_fn


@query(
    """
    SELECT doc_id, CASE WHEN lang <> 'de' THEN replace(text, 'e', 'x') END AS text,
           CASE WHEN lang = 'de' THEN 'cannot read ' || doc_id END AS error
    FROM documents
    """
)
def model_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inp.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return model.apply_model(inp.spread(docs), _fails_on_german, ["doc_id"])


def _better_second_time() -> Callable[..., str]:
    def model_fn(row: dict, quality_retry: bool) -> str:
        return row["plain"] if quality_retry else row["text"]

    return model_fn


@query(
    f"""
    WITH {inp.TRANSCRIPTS_SQL}, {inp.quality_sql('transcripts')}, {inp.quality_sql('documents', 'r')},
    pairs AS (
      SELECT b.doc_id, len(b.issues) AS nb, len(a.issues) AS na,
             len(a.issues) = 0 OR (len(a.issues) < len(b.issues) AND a.token_count >= 8) AS replaced
      FROM q b JOIN r a USING (doc_id) WHERE len(b.issues) > 0
    ),
    log AS (
      SELECT 'audio_transcript_created' AS type FROM q
      UNION ALL SELECT 'audio_transcript_quality_flagged' FROM pairs
      UNION ALL SELECT 'audio_transcript_retried' FROM pairs WHERE replaced
      UNION ALL SELECT 'audio_transcript_retry_failed' FROM pairs WHERE NOT replaced
      UNION ALL SELECT 'audio_transcript_quality_still_flagged' FROM pairs WHERE na > 0
    )
    SELECT type, count(*) AS n FROM log GROUP BY type
    """
)
def transcribe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model whose first try has the odd tails and whose retry does not; its log, counted."""
    items = inp.transcripts(spark, sf_dir).select("doc_id", "text", "plain")
    _, log = model.transcribe(inp.spread(items), _better_second_time, ["doc_id"])
    return log.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# --- runs -------------------------------------------------------------------------------------


@query(
    f"WITH {inp.MANIFEST_SQL} SELECT run_id, "
    + ", ".join(f"count(*) FILTER (type = '{t}') AS {c}" for c, t in fv.COUNTER_EVENTS.items())
    + f", count(*) FILTER (type IN ('audio_transcript_retried', 'audio_transcript_retry_failed')) AS {fv.RETRY_ATTEMPTED} FROM manifest GROUP BY run_id"
)
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_counters(inp.manifest(spark, sf_dir))


@query(
    f"WITH {inp.MANIFEST_SQL} SELECT run_id, stage, round(sum(elapsed_seconds), 3) AS seconds FROM manifest GROUP BY ALL"
)
def stage_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stage_seconds(inp.manifest(spark, sf_dir))


@query(
    f"""
    WITH {inp.MANIFEST_SQL},
    open AS (
      SELECT run_id FROM manifest GROUP BY run_id
      HAVING coalesce(max(seq) FILTER (type = 'run_start'), -1) > coalesce(max(seq) FILTER (type = 'run_end'), -1)
    )
    SELECT run_id, 'run_stopped' AS type, 'killed' AS reason, NULL AS status, NULL AS elapsed_seconds FROM open
    UNION ALL SELECT run_id, 'run_end', NULL, 'stopped', 0.0::DOUBLE FROM open
    """
)
def open_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    closing = runs.closing_events(inp.manifest(spark, sf_dir), "killed")
    return closing.select("run_id", "type", "reason", "status", "elapsed_seconds")


@query(
    f"""
    WITH {inp.MANIFEST_SQL},
    closed AS (
      SELECT run_id, max(seq) AS last_seq FROM manifest GROUP BY run_id
      HAVING coalesce(max(seq) FILTER (type = 'run_start'), -1) > coalesce(max(seq) FILTER (type = 'run_end'), -1)
    )
    SELECT run_id, seq, type, elapsed_seconds FROM manifest
    UNION ALL SELECT run_id, last_seq + 1, 'run_stopped', NULL FROM closed
    UNION ALL SELECT run_id, last_seq + 2, 'run_end', 0.0 FROM closed
    """
)
def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written in two appends and read back, then a third append that closes its open runs."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/chatweave-log-{uuid.uuid4().hex}"
    log = inp.manifest(spark, sf_dir).select("run_id", "seq", "type", "stage", "elapsed_seconds")
    append_events(log.where("seq % 2 = 0"), folder)
    append_events(log.where("seq % 2 = 1"), folder)
    append_events(store(runs.closing_events(read_events(spark, folder), "killed")), folder)
    return read_events(spark, folder).select("run_id", "seq", "type", "elapsed_seconds")


@query(
    """
    WITH counts AS (
      SELECT CAST(user_id AS VARCHAR) AS run_id,
             CASE WHEN user_id % 5 = 0 THEN 0 ELSE count(*) FILTER (event_type IN ('click', 'view', 'error')) END AS total,
             count(*) FILTER (event_type <> 'signup') AS media_done,
             count(*) FILTER (event_type = 'error') * (user_id % 4 - 1) AS remaining
      FROM events GROUP BY user_id)
    SELECT run_id,
           CASE WHEN total <= 0 THEN 0 ELSE greatest(least(media_done, total) - greatest(remaining, 0), 0) END AS done,
           CASE WHEN total <= 0 THEN 100.0
                ELSE round(greatest(least(media_done, total) - greatest(remaining, 0), 0) / total * 100.0, 6) END AS percent
    FROM counts
    """
)
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More done than there is, more left than done, less than nothing left, and runs without files: every limit occurs."""
    kind, user = F.col("event_type"), F.col("user_id")
    counts = inp.table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind.isin("click", "view", "error")).alias("total"),
        F.count_if(kind != "signup").alias("media_done"),
        F.count_if(kind == "error").alias("errors"),
    )
    total = F.when(user % 5 == 0, F.lit(0)).otherwise(F.col("total"))
    done, percent = runs.effective_progress(total, F.col("media_done"), F.col("errors") * (user % 4 - 1))
    return counts.select(user.cast("string").alias("run_id"), done.alias("done"), F.round(percent, 6).alias("percent"))


@query(
    f"""
    WITH {inp.MANIFEST_SQL}
    SELECT run_id, seq, type, stage, elapsed_seconds FROM manifest WHERE stage <> 'error'
    """
)
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, those of errors cut off in the middle; the cut ones are skipped."""
    event = F.to_json(F.struct("type", "stage", "elapsed_seconds", "props"))
    broken = F.left(event, F.length(event) - 2)
    lines = inp.manifest(spark, sf_dir).select(
        "run_id", F.col("seq").alias("line_no"), F.when(F.col("stage") == "error", broken).otherwise(event).alias("line")
    )
    return parse_manifest(lines).select("run_id", "seq", "type", "stage", "elapsed_seconds")


# --- exports ----------------------------------------------------------------------------------


@query(f"WITH {inp.EXPORT_FILES_SQL} SELECT export, root FROM roots")
def export_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.export_roots(inp.export_files(spark, sf_dir))


@query(
    f"""
    WITH {inp.EXPORT_FILES_SQL},
    chosen AS (
      SELECT export, parent, path, row_number() OVER (
        PARTITION BY export, parent
        ORDER BY CASE WHEN contains(lower(name), 'whatsapp') AND contains(lower(name), 'chat') THEN 0 ELSE 1 END, path) AS rn
      FROM ranked
    )
    SELECT r.export, r.root, c.path AS chat_path
    FROM roots r LEFT JOIN chosen c ON c.export = r.export AND c.parent = r.root AND c.rn = 1
    """
)
def chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = inp.export_files(spark, sf_dir)
    return exports.chat_files(files, exports.export_roots(files)).select("export", "root", "chat_path")
