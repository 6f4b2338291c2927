"""Readers and writers."""

from .folders import scan_folders, stream_folders, write_folders
from .inventory import inventory_report, list_transcripts
from .ledger import append_ledger, read_ledger, scan_ledger
from .logfiles import read_job_log, read_log_lines
from .probe import read_probe
from .published import Attempt, is_published, read_published
from .summaries import read_summaries, write_summaries
from .transcripts import (
    attach_texts,
    decode_transcripts,
    laid_out,
    scan_transcripts,
    write_transcript_text,
)

__all__ = [
    "Attempt",
    "append_ledger",
    "attach_texts",
    "decode_transcripts",
    "inventory_report",
    "is_published",
    "laid_out",
    "list_transcripts",
    "read_job_log",
    "read_ledger",
    "read_log_lines",
    "read_probe",
    "read_published",
    "read_summaries",
    "scan_folders",
    "scan_ledger",
    "scan_transcripts",
    "stream_folders",
    "write_folders",
    "write_summaries",
    "write_transcript_text",
]
