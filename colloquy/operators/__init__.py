"""Operators over DataFrames."""

from .crosscheck import (
    citation_check,
    files_of_folders,
    grounding_check,
    stage_reconcile,
    unprocessed,
)
from .done import add_done, done_bits, maybe_done, merged_done, unprocessed_by_filter
from .enrich import check_reply, enrich_with_retry
from .items import (
    action_item_rank,
    action_item_report,
    action_item_validate,
    action_items_flatten,
)
from .logs import (
    classify_lines,
    daily_durations,
    log_error_windows,
    log_runs,
    merged_durations,
    number_runs,
    parse_log,
    run_report,
    run_report_lines,
    scheduler_outcomes,
    step_duration_stats,
    step_pairs,
)
from .media import (
    media_output_names,
    media_stream_counts,
    split_mode_filter,
    split_plan,
    video_only_plan,
)
from .mining import (
    assemble_parts,
    assemble_transcript,
    assistant_mentions,
    cue_extract,
    extractive_summary,
    key_terms,
    owner_from_speaker,
    phrase_index,
    transcript_segments,
)
from .normalize import schema_drift_report, summary_normalize, summary_quality_flags
from .observe import observe_batch
from .outcome import (
    accept_replies,
    archive_processed,
    batch_status_counts,
    classify_outcome,
    document_type_filter,
    first_match,
    found_count,
    latest_summary,
    ledger_row,
    ledger_union,
)

__all__ = [
    "accept_replies",
    "action_item_rank",
    "action_item_report",
    "action_item_validate",
    "action_items_flatten",
    "add_done",
    "archive_processed",
    "assemble_parts",
    "assemble_transcript",
    "assistant_mentions",
    "batch_status_counts",
    "check_reply",
    "citation_check",
    "classify_lines",
    "classify_outcome",
    "cue_extract",
    "daily_durations",
    "document_type_filter",
    "done_bits",
    "enrich_with_retry",
    "extractive_summary",
    "files_of_folders",
    "first_match",
    "found_count",
    "grounding_check",
    "key_terms",
    "latest_summary",
    "ledger_row",
    "ledger_union",
    "log_error_windows",
    "log_runs",
    "maybe_done",
    "media_output_names",
    "media_stream_counts",
    "merged_done",
    "merged_durations",
    "number_runs",
    "observe_batch",
    "owner_from_speaker",
    "parse_log",
    "phrase_index",
    "run_report",
    "run_report_lines",
    "scheduler_outcomes",
    "schema_drift_report",
    "split_mode_filter",
    "split_plan",
    "stage_reconcile",
    "step_duration_stats",
    "step_pairs",
    "summary_normalize",
    "summary_quality_flags",
    "transcript_segments",
    "unprocessed",
    "unprocessed_by_filter",
    "video_only_plan",
]
