"""Expressions over model replies."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Only double quotes delimit strings in JSON; Spark's reader is laxer by default.
STRICT = {"allowSingleQuotes": "false"}


def extract_json_block(reply: Column) -> Column:
    """From the first '{' to the last '}', across lines; null where there is none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def parse_summary_strict(json: Column) -> Column:
    """Variant of exactly one JSON object, else null.

    The readers stop after the first value, so the text is wrapped twice: as the only
    element of an array, and as a member of an object. Text that holds more than one
    value breaks at least one of the two.
    """
    listed = F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<variant>", STRICT)
    member = F.from_json(F.concat(F.lit('{"one":'), json, F.lit("}")), "one string", STRICT)
    return F.when((F.size(listed) == 1) & member["one"].isNotNull(), listed[0])


def _text_or_default(v: Column, key: str, default: str) -> tuple[Column, Column]:
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    value = F.try_variant_get(v, f"$.{key}", "string")
    failed = kind.isNotNull() & (kind != "STRING")
    text = F.when(kind.isNull(), F.lit(default)).when(kind == "STRING", value)
    return F.when(v.isNotNull(), text), failed


def title_date_defaults(v: Column) -> tuple[Column, Column, Column]:
    """(title, date, failed): a missing key takes its default, a key that is no string fails."""
    title, bad_title = _text_or_default(v, "title", "untitled")
    date, bad_date = _text_or_default(v, "date", "undated")
    return title, date, v.isNull() | bad_title | bad_date


def summary_unwrap(raw: Column) -> Column:
    """Variant of the object in a stored reply.

    The object is taken from the fenced block, or from the first to the last brace where
    there is no fence. Line breaks inside strings are accepted.
    """
    fenced = F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1), F.lit(""))
    body = F.coalesce(fenced, extract_json_block(raw))
    return F.from_json(body, "variant", {**STRICT, "allowUnquotedControlChars": "true"})


def build_messages(system: str, text: Column) -> Column:
    """The two chat messages: instructions first, transcript second."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system)), message("user", text))
