"""Chat formatting: tool calls linked with their results.

Calls and results are joined by conversation and identifier, both with one row per identifier, so
the join's key has no hot value however long a conversation is. A call may name the call it builds
on; its topological level is the number of calls above it. Levels come from pointer doubling: every
round a call learns the ancestor of its ancestor, so a chain of n calls takes log2(n) joins, and no
conversation is gathered anywhere. What a round leaves unresolved without getting fewer is on a
cycle or below one. Rows sorted by (conversation, level, turn, identifier) are in topological order.

Arguments are checked against the tool's schema and the linked call is serialised as canonical JSON:
keys by code point, no blanks, UTF-8, integral numbers without fraction.

Defined results
* two calls (or results) with one identifier in a conversation: the one of the first turn, then of the
  lowest text, counts; ``n_calls`` and ``n_results`` tell how many there were.
* a call without result, a result without call: rows with status ``no_result`` and ``no_call``.
* a parent that no call has: the call is a root, its status ``no_parent`` unless there is a worse one.
* null conversation or identifier: left out, there is nothing to link; the query lists them as ``unlinked``.
* null or malformed arguments: the violation ``json``, as for numbers beyond a double, ``NaN``, half of a
  surrogate pair and nesting that is too deep to read; an unknown tool: ``tool``.
* null content: an empty result. Very long texts stay whole. Empty tables: no rows. Other columns are left out.
"""

import json
from collections.abc import Iterator
from math import isfinite

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import Scratch

# name of a field -> type, required, least and most (of a number, or of a text's length)
Field = tuple[str, bool, float | None, float | None]
Schemas = dict[str, dict[str, Field]]

TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
}


def violations(schemas: Schemas, tool: str | None, arguments: object) -> list[str]:
    """What is wrong with a call's arguments: ``field:reason``, by field."""
    if tool not in schemas:
        return ["tool"]
    if not isinstance(arguments, dict):
        return ["json"]
    fields, wrong = schemas[tool], []
    for name, (kind, required, least, most) in fields.items():
        value = arguments.get(name)
        if value is None:
            wrong += [f"{name}:missing"] if required else []
        elif not TYPES[kind](value):
            wrong.append(f"{name}:type")
        else:
            size = value if kind in ("integer", "number") else len(value) if kind in ("string", "array") else None
            if size is not None and least is not None and size < least:
                wrong.append(f"{name}:least")
            if size is not None and most is not None and size > most:
                wrong.append(f"{name}:most")
    wrong += [f"{name}:unknown" for name in arguments if name not in fields]
    return sorted(wrong)


def plain(value: object) -> object:
    """JSON values with integral numbers as integers, so that one value has one form."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def canonical(value: object) -> str:
    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _refused(text: str) -> float:
    """NaN and Infinity are no JSON."""
    raise ValueError(text)


def _finite(text: str) -> float:
    number = float(text)
    return number if isfinite(number) else _refused(text)


def loads(text: str | None) -> object:
    """The value of a JSON text; None if it has none that canonical JSON in UTF-8 can say."""
    try:
        value = json.loads(text, parse_constant=_refused, parse_float=_finite) if text else None
        canonical([value]).encode()  # half of a surrogate pair, or too deep
    except (ValueError, RecursionError):
        return None
    return value


def one_per_id(df: DataFrame, value: str, count: str) -> DataFrame:
    rest = [c for c in df.columns if c not in ("conv_id", "call_id")]
    order = F.struct(F.col("turn"), F.coalesce(F.col(value), F.lit("")))
    return (
        df.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
        .groupBy("conv_id", "call_id")
        .agg(F.min_by(F.struct(*rest), order).alias("x"), F.count("*").alias(count))
        .select("conv_id", "call_id", "x.*", count)
    )


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, call_id, level, cyclic, parent_missing`` from ``conv_id, call_id, parent_id``."""
    ids = calls.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("known"))
    start = calls.select("conv_id", "call_id", "parent_id").join(ids, ["conv_id", "parent_id"], "left")
    now = scratch.keep(
        start.select(
            "conv_id",
            "call_id",
            F.when(F.col("known"), F.col("parent_id")).alias("up"),
            F.when(F.col("known"), 1).otherwise(0).cast("bigint").alias("level"),
            (F.col("parent_id").isNotNull() & F.col("known").isNull()).alias("parent_missing"),
        ),
        "levels-0",
    )
    left, turn = now.where("up is not null").count(), 0
    while left:
        turn += 1
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("more"))
        now = scratch.keep(
            now.join(above, ["conv_id", "up"], "left").select(
                "conv_id", "call_id", F.col("up2").alias("up"),
                (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), "parent_missing",
            ),
            f"levels-{turn}",
        )
        scratch.drop(f"levels-{turn - 1}")
        before, left = left, now.where("up is not null").count()
        if left == before:
            break
    cyclic = F.col("up").isNotNull()
    return now.select(
        "conv_id", "call_id", F.when(~cyclic, F.col("level")).alias("level"), cyclic.alias("cyclic"), "parent_missing"
    )


def link_calls(spark: SparkSession, calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """A row per identifier: call, result, level, status, violations and canonical JSON.

    ``calls`` has ``conv_id, call_id, turn, tool, arguments, parent_id``, ``results`` has ``conv_id,
    call_id, turn, content``.
    """
    scratch = Scratch(spark, "tool-calls")
    calls = scratch.keep(
        one_per_id(calls.select("conv_id", "call_id", "turn", "tool", "arguments", "parent_id"), "arguments", "n_calls"),
        "calls",
    )
    found = one_per_id(results.select("conv_id", "call_id", "turn", "content"), "content", "n_results")
    found = found.withColumnRenamed("turn", "result_turn")
    linked = calls.join(found.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    linked = linked.join(levels(calls, scratch), ["conv_id", "call_id"], "left")
    status = (
        F.when(F.col("n_calls").isNull(), "no_call")
        .when(F.col("cyclic"), "cycle")
        .when(F.col("n_results").isNull(), "no_result")
        .when(F.col("parent_missing"), "no_parent")
        .otherwise("linked")
    )

    @pandas_udf("struct<violations: array<string>, json: string>")
    def checked(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for conv, call, tool, arguments, level, content, state in parts:
            wrong, lines = [], []
            for row in zip(conv, call, tool, arguments, level, content, state):
                told = loads(row[3])
                bad = [] if row[6] == "no_call" else violations(schemas, row[2], told)
                wrong.append(bad)
                lines.append(
                    canonical(
                        {
                            "arguments": told,
                            "conversation": None if pd.isna(row[0]) else int(row[0]),
                            "id": row[1],
                            "level": None if pd.isna(row[4]) else int(row[4]),
                            "result": row[5],
                            "status": row[6],
                            "tool": row[2],
                            "violations": bad,
                        }
                    )
                )
            yield pd.DataFrame({"violations": wrong, "json": lines})

    linked = linked.withColumn("status", status)
    result = F.when(F.col("n_results").isNotNull(), F.coalesce("content", F.lit("")))
    out = linked.withColumn("checked", checked("conv_id", "call_id", "tool", "arguments", "level", result, "status"))
    return out.select(
        "conv_id",
        "call_id",
        "turn",
        "tool",
        "level",
        "status",
        F.coalesce("n_calls", F.lit(0)).cast("bigint").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        "checked.violations",
        "checked.json",
    )
