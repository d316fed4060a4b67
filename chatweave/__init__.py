"""Chat-export analytics as Spark DataFrame jobs, keyed by ``chat_id``."""

from chatweave.operators.enrich import enrich_messages
from chatweave.operators.parse import parse_messages
from chatweave.operators.quality import assess_quality
from chatweave.plans.jobs import JobOptions, publish, read_messages
from chatweave.sources.chats import read_chat_lines

__all__ = [
    "JobOptions",
    "assess_quality",
    "enrich_messages",
    "parse_messages",
    "publish",
    "read_chat_lines",
    "read_messages",
]
