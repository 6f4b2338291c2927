"""Whole jobs put together from the operators."""

from .media import media_tasks
from .report import analyse_logs, store_durations, stored_durations
from .summarise import SUMMARIES, outcomes, summarise_batch, to_summarise
from .terms import stored_frequency, stored_key_terms, update_terms

__all__ = [
    "SUMMARIES",
    "analyse_logs",
    "media_tasks",
    "outcomes",
    "store_durations",
    "stored_durations",
    "stored_frequency",
    "stored_key_terms",
    "summarise_batch",
    "to_summarise",
    "update_terms",
]
