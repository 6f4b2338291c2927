"""Incremental runs with Structured Streaming."""

from .ingest import archive_on_commit, incremental_ingest, land_summaries, land_transcripts, run_available
from .ledger import ledger_stream
from .logs import number_stream, numbered_pairs
from .steps import BatchSteps, StepListener, read_steps

__all__ = [
    "BatchSteps",
    "StepListener",
    "archive_on_commit",
    "incremental_ingest",
    "land_summaries",
    "land_transcripts",
    "ledger_stream",
    "number_stream",
    "numbered_pairs",
    "read_steps",
    "run_available",
]
