"""Column expressions: no shuffle, no Python worker."""

from .json import (
    build_messages,
    extract_json_block,
    parse_summary_strict,
    summary_unwrap,
    title_date_defaults,
)
from .text import (
    batch_id,
    empty_transcript_guard,
    error_count,
    log_tail,
    mentions,
    null_marker_cleanup,
    paragraphs,
    sanitize_filename,
    sentences,
    spaced_words,
    summary_filename,
    tokens,
)

__all__ = [
    "batch_id",
    "build_messages",
    "empty_transcript_guard",
    "error_count",
    "extract_json_block",
    "log_tail",
    "mentions",
    "null_marker_cleanup",
    "paragraphs",
    "parse_summary_strict",
    "sanitize_filename",
    "sentences",
    "spaced_words",
    "summary_filename",
    "summary_unwrap",
    "title_date_defaults",
    "tokens",
]
