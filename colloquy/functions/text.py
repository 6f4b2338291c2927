"""Text expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BATCH_PREFIX, NULL_MARKERS

# Unicode white space, written so that Java and RE2 read it alike.
WS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
NOT_NAME = rf"[^\p{{L}}\p{{N}}_{WS}-]"
GAPS = rf"[{WS}-]+"
WORD = r"\p{L}\p{N}_"

SENTENCE = r"[^.!?\n]+[.!?]*"
TOKEN = r"[\p{L}\p{N}]+"
NO_TOKEN = r"[^\p{L}\p{N}]+"


def sanitize_filename(c: Column, n: int = 80) -> Column:
    """Keep word characters, turn runs of white space or '-' into '_', cut to n characters.

    Each word character is one character of the result, so nothing behind the n-th can
    matter. The text is cut there first, with what follows up to the next word character.
    """
    needed = F.regexp_extract(c, rf"^(?:[^{WORD}]*+[{WORD}]){{0,{n}}}+[^{WORD}]*+", 0)
    kept = F.regexp_replace(needed, NOT_NAME, "")
    return F.substring(F.regexp_replace(kept, GAPS, "_"), 1, n)


def summary_filename(date: Column, title: Column) -> Column:
    """``<date>_<title>.json``, each part sanitized and cut for itself."""
    return F.concat(sanitize_filename(date), F.lit("_"), sanitize_filename(title), F.lit(".json"))


def empty_transcript_guard(c: Column) -> Column:
    """True where there is nothing to summarise: null or the empty string, not mere spaces."""
    return c.isNull() | (c == "")


def batch_id(ts: Column) -> Column:
    """Name of the archive batch that starts at ``ts``."""
    return F.concat(F.lit(BATCH_PREFIX), F.date_format(ts, "yyyyMMdd-HHmmss"))


def log_tail(c: Column, n: int = 6000) -> Column:
    """The last n characters."""
    return F.right(c, F.lit(n))


def error_count(c: Column, needle: str = "ERROR") -> Column:
    """Non-overlapping, case-sensitive occurrences of ``needle``."""
    return F.regexp_count(c, F.lit(re.escape(needle)))


def null_marker_cleanup(c: Column, markers=NULL_MARKERS) -> Column:
    """Null where the text only says that there is no value."""
    return F.when(~F.lower(F.trim(c)).isin(*markers), c)


def sentences(text: Column) -> Column:
    """Array of the sentences of a text, blank ones left out."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Array of the non-blank lines of a text."""
    found = F.regexp_extract_all(text, F.lit(r"[^\n]+"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Array of lower-case words and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def spaced_words(text: Column) -> Column:
    """The words of a text in lower case, one space before and after each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), NO_TOKEN, " "), F.lit(" "))


def mentions(spaced: Column, phrases) -> Column:
    """True where any of the phrases occurs as whole words in the result of ``spaced_words``.

    Only words count: what stands between them, in text or phrase, does not.
    """
    found = F.lit(False)
    for phrase in phrases:
        words = re.findall(r"[^\W_]+", phrase.lower())
        found = found | F.contains(spaced, F.lit(f" {' '.join(words)} "))
    return found
