"""Wording, patterns and limits that outputs depend on.

Everything here is data that must be exactly as it is for results to be right.
Nothing else in the package hard-codes such values.

Patterns are in Java syntax. Flags: ``i`` ignore case, ``u`` Unicode case folding,
``U`` Unicode classes for ``\\d`` and ``\\s``, ``d`` only ``\\n`` ends a line (so that
``.`` runs over U+0085 and U+2028).
"""

# --- message header patterns --------------------------------------------------
# Groups: date and time as one, date, time, rest of the line. The time of the first has the part
# of the day in it.
PT_HEADER = (
    r"(?diuU)^((\d{2}/\d{2}/\d{2}),\s+(\d{1,2}:\d{2}\s+da\s+(?:madrugada|manhã|tarde|noite)))\s+-\s+(.*)$"
)
ANDROID_HEADER = r"(?diuU)^\x{200e}?((\d{1,2}/\d{1,2}/\d{2,4}),\s+([^-]+?))\s+-\s+(.*)$"
IOS_HEADER = r"(?diuU)^\x{200e}?\[((\d{1,2}/\d{1,2}/\d{2,4}),\s+([^\]]+))\]\s+(.*)$"
HEADER_STAMP, HEADER_DATE, HEADER_TIME, HEADER_REST = 1, 2, 3, 4

# --- message body patterns ----------------------------------------------------
# sender, body
SENDER = r"(?dU)^([^:]+?):\s+(.*)$"
# file
ATTACHED_SUFFIX = (
    r"(?diuU)^\x{200e}?([^\s].*?)\s+"
    r"\((?:ficheiro\s+anexado|arquivo\s+anexado|archivo\s+adjunto|file\s+attached)\)$"
)
# file
ATTACHED_TAG = r"(?diuU)^<\s*attached:\s*([^>]+?)\s*>$"

# Characters that count as space at the ends of a text.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- time patterns ------------------------------------------------------------
# hour, minute, am or pm
TIME_12H = r"(?iU)^(\d{1,2}):(\d{2})(?::\d{2})?(am|pm)$"
# hour, minute
TIME_24H = r"(?U)^(\d{1,2}):(\d{2})(?::\d{2})?$"

STYLES = ("pt", "android", "ios")
DATE_ORDERS = ("dmy", "mdy")
DETECTION_SAMPLE_LINES = 2000

# --- media kinds by extension -------------------------------------------------
AUDIO_EXTENSIONS = ("opus", "ogg", "m4a", "mp3", "wav", "aac")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif")
VIDEO_EXTENSIONS = ("mp4", "mov", "mkv", "webm", "3gp")
DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "txt")

# --- artifact names -----------------------------------------------------------
UNSAFE_STEM_CHARS = r"[^A-Za-z0-9._-]+"
STEM_EDGE_CHARS = r"^[._-]+|[._-]+$"
DEFAULT_STEM = "media"
STEM_DIGEST_CHARS = 12

# --- export layout ------------------------------------------------------------
EXPORT_NAME_STRONG = "whatsapp"
EXPORT_NAME_STRONG_SCORE = 10
EXPORT_NAME_WEAK = ("chat", "conversa")
EXPORT_NAME_WEAK_SCORE = 5

# --- transcript quality -------------------------------------------------------
WORD = r"[0-9A-Za-zÀ-ÖØ-öø-ÿ']+"
SENTENCE_END = r"[.!?]+"
TAIL_CHARS = 240
PUNCTUATION_LOOP = r"(?U)([^\p{L}\p{N}_\s])\1{10,}"
TAIL_SYMBOL = r"(?U)[^\p{L}\p{N}\s]"
# as TAIL_SYMBOL, less the symbols that are usual in a tail: .,;:!?()[]{}'"-_/\@#%&*+=
TAIL_UNUSUAL_SYMBOL = r"""(?U)[^\p{L}\p{N}\s.,;:!?()\[\]{}'"\-_/\\@#%&*+=]"""
TAIL_SYMBOLS_MIN = 24
TAIL_UNUSUAL_SHARE = 0.65
UNIQUE_RATIO_TOKENS_MIN = 120
UNIQUE_RATIO_LIMIT = 0.20
TOKEN_RUN_LIMIT = 12
PHRASE_TOKENS_MIN = 80
PHRASE_REPEAT_LIMIT = 8
SENTENCE_TOKENS_MIN = 3
SENTENCE_REPEAT_LIMIT = 10
RETRY_TOKENS_MIN = 8

# --- audio, images ------------------------------------------------------------
AUDIO_CHANNELS = 1
AUDIO_RATE = 16000
AUDIO_SAMPLE_BYTES = 2
AUDIO_CHUNK_SECONDS = 30
OCR_EDGE_THRESHOLD = 18.0

# --- published text -----------------------------------------------------------
TRANSCRIPT_TITLE = "# WhatsApp Transcript"
MARKDOWN_CLIP_CHARS = 4000
UNKNOWN_MONTH = "unknown"
SYSTEM_NAME = "SYSTEM"

# --- run log: counter name -> event type --------------------------------------
COUNTER_EVENTS = {
    "missing_files": "missing_file",
    "audio_wav_created": "audio_wav_created",
    "audio_wav_skipped": "audio_wav_skipped",
    "audio_wav_failed": "audio_wav_failed",
    "audio_mp3_created": "audio_mp3_created",
    "audio_mp3_skipped": "audio_mp3_skipped",
    "audio_mp3_failed": "audio_mp3_failed",
    "audio_transcripts_created": "audio_transcript_created",
    "audio_transcripts_skipped": "audio_transcript_skipped",
    "audio_transcripts_failed": "audio_transcript_failed",
    "audio_transcript_quality_flagged": "audio_transcript_quality_flagged",
    "audio_transcript_retry_succeeded": "audio_transcript_retried",
    "audio_transcript_retry_failed": "audio_transcript_retry_failed",
    "audio_transcript_retry_still_flagged": "audio_transcript_quality_still_flagged",
    "image_ocr_created": "image_ocr_created",
    "image_ocr_skipped": "image_ocr_skipped",
    "image_ocr_failed": "image_ocr_failed",
    "image_ocr_filtered": "image_ocr_filtered",
    "image_ocr_deferred": "image_ocr_deferred",
}
RETRY_ATTEMPTED = "audio_transcript_retry_attempted"  # no event of its own

# --- run log: seconds ---------------------------------------------------------
TIMING_KEYS = (
    "audio_convert_seconds",
    "audio_transcribe_seconds",
    "audio_transcript_retry_seconds",
    "audio_meta_seconds",
    "image_ocr_seconds",
    "image_meta_seconds",
    "stage_parse_seconds",
    "stage_media_preprocess_seconds",
    "stage_output_write_seconds",
    "stage_total_seconds",
    "transcriber_init_seconds",
)
TOTAL_SECONDS = "stage_total_seconds"
# stage -> key of its seconds
STAGE_SECONDS = {
    "parse_messages": "stage_parse_seconds",
    "media_preprocess": "stage_media_preprocess_seconds",
    "output_write": "stage_output_write_seconds",
}
