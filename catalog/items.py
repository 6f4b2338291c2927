"""Action items made from orders, with planted faults."""

from pyspark.sql import functions as F

from colloquy.operators import (
    action_item_rank,
    action_item_report,
    action_item_validate,
    action_items_flatten,
)

from .registry import query, table

ASSISTANT = "Ada Quill"

# Faults planted in the first item of an order, by the order's remainder of 12.
# Each line: the text of the item's tail after the description, and the broken rules.
GOOD_TAIL = (
    '"owner":"C{c}","due_date":"{d}","urgency_score":"{u}","priority_score":"{p}",'
    '"citation":"Para {k}","high_level_topic":"{t}"'
)
FAULTS = (
    ("good", GOOD_TAIL, ""),
    ("no owner", GOOD_TAIL.replace('"owner":"C{c}",', ""), "missing:owner"),
    ("extra", GOOD_TAIL + ',"note":"x"', "extra:note"),
    (
        "order",
        GOOD_TAIL.replace(
            '"owner":"C{c}","due_date":"{d}"', '"due_date":"{d}","owner":"C{c}"'
        ),
        "order",
    ),
    ("zero", GOOD_TAIL.replace("{u}", "0"), "urgency_score"),
    ("eleven", GOOD_TAIL.replace("{p}", "11"), "priority_score"),
    ("range", GOOD_TAIL.replace("{u}", "1-10"), "urgency_score"),
    ("number", GOOD_TAIL.replace('"{u}"', "9"), ""),
    ("pattern", GOOD_TAIL.replace("{d}", "YYYY-MM-DD"), "due_date"),
    ("no day", GOOD_TAIL.replace("{d}", "2025-02-30"), "due_date"),
    (
        "many",
        GOOD_TAIL.replace('"citation":"Para {k}",', "").replace("{u}", "high") + ',"note":"x"',
        "missing:citation,extra:note,urgency_score",
    ),
    ("twice", '"owner":"nobody",' + GOOD_TAIL + ',"citation":"Para {k}"', ""),
)


def _tail_column(tail: str):
    """The tail of an item as a column; the names in braces are columns of ``_orders``."""
    pieces = []
    for number, part in enumerate(tail.replace("}", "{").split("{")):
        pieces.append(F.col(part) if number % 2 else F.lit(part))
    return F.concat(*pieces)


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("file_id"),
        (F.col("o_orderkey") % len(FAULTS)).alias("fault"),
        (F.col("o_orderkey") % 4).alias("shape"),
        F.col("o_custkey").cast("string").alias("c"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
        (F.col("o_orderkey") % 10 + 1).cast("string").alias("u"),
        F.substring("o_orderpriority", 1, 1).alias("p"),
        F.col("o_orderkey").cast("string").alias("k"),
        F.col("o_orderstatus").alias("t"),
    )


def summaries(spark, sf):
    """Summaries with action items: ``file_id, json_content``.

    By shape the initiatives are absent or empty, and the assistant's flag is a Boolean, a
    text, absent or a Boolean again.
    """
    orders = _orders(spark, sf)
    first = F.lit("")
    for number, (_, tail, _) in enumerate(FAULTS):
        first = F.when(F.col("fault") == number, _tail_column(tail)).otherwise(first)
    good = _tail_column(GOOD_TAIL)
    flag = (
        F.when(F.col("shape") == 1, ',"ada_quill_reference":"true"')
        .when(F.col("shape") == 2, "")
        .otherwise(',"ada_quill_reference":true')
    )
    initiatives = F.when(F.col("shape") < 2, '"strategic_initiatives":[],').otherwise("")
    text = F.concat(
        F.lit('{"title":"Order","next_steps":[{"description":"first",'),
        first,
        F.lit('},{"description":"second",'),
        good,
        F.lit("}],"),
        initiatives,
        F.lit('"executive_followup":[{"description":"third",'),
        good,
        F.lit('}],"ada_quill_actions":[{"description":"fourth",'),
        good,
        flag,
        F.lit('}],"ada_quill_items":[{"description":"fifth",'),
        good,
        F.lit(',"ada_quill_reference":false}]}'),
    )
    return orders.select("file_id", text.alias("json_content"))


# One row per expected item; the first item's fault decides which of its fields are broken.
ITEMS_SQL = """
select o_orderkey::varchar as file_id, s.section, s.pos,
  s.description, s.planted, o_orderkey % 12 as fault, o_orderkey % 4 as shape,
  case when s.planted and fault = 1 then null else 'C' || o_custkey end as owner,
  case when s.planted and fault in (8, 9) then null else strftime(o_orderdate, '%Y-%m-%d') end as due_date,
  case when s.planted and fault in (4, 6, 10) then null when s.planted and fault = 7 then 9
    else o_orderkey % 10 + 1 end as urgency,
  case when s.planted and fault = 5 then null else left(o_orderpriority, 1)::int end as priority,
  case when s.planted and fault = 10 then null else 'Para ' || o_orderkey end as citation,
  o_orderstatus as high_level_topic
from orders, (values ('next_steps', 0, 'first', true), ('next_steps', 1, 'second', false),
  ('executive_followup', 0, 'third', false), ('ada_quill_actions', 0, 'fourth', false),
  ('ada_quill_items', 0, 'fifth', false))
  s(section, pos, description, planted)"""


@query(
    f"""select file_id, section, pos, description, owner, due_date, urgency::varchar as urgency,
    priority::varchar as priority, citation, high_level_topic,
    case when section = 'ada_quill_items' then false
      when section = 'ada_quill_actions' and shape <> 2 then true end as assistant_reference
    from ({ITEMS_SQL})"""
)
def flattened_items(spark, sf):
    items = action_items_flatten(summaries(spark, sf), ASSISTANT)
    return items.select(
        "file_id",
        "section",
        "pos",
        "description",
        "owner",
        F.col("due_date").cast("string").alias("due_date"),
        F.col("urgency").cast("string").alias("urgency"),
        F.col("priority").cast("string").alias("priority"),
        "citation",
        "high_level_topic",
        "assistant_reference",
    )


_RULES = " ".join(f"when {n} then '{rules}'" for n, (_, _, rules) in enumerate(FAULTS))


@query(
    f"""select file_id, section, pos, case when planted then case fault {_RULES} end
      when section = 'ada_quill_actions' and shape = 1 then 'ada_quill_reference'
      when section = 'ada_quill_actions' and shape = 2 then 'missing:ada_quill_reference'
      else '' end as violations
    from ({ITEMS_SQL})"""
)
def item_violations(spark, sf):
    items = action_items_flatten(summaries(spark, sf), ASSISTANT)
    checked = action_item_validate(items, ASSISTANT)
    return checked.select(
        "file_id", "section", "pos", F.array_join("violations", ",").alias("violations")
    )


def order_items(spark, sf):
    """Orders as items of their customer."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("owner"),
        F.col("o_orderpriority").alias("high_level_topic"),
        F.col("o_orderstatus").alias("section"),
        F.col("o_orderkey").cast("string").alias("file_id"),
        F.lit(0).alias("pos"),
        F.col("o_orderdate").cast("date").alias("due_date"),
        F.nullif(F.col("o_orderkey") % 11, F.lit(0)).cast("int").alias("urgency"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
    )


ORDER_ITEMS = """
select o_custkey::varchar as owner, o_orderpriority as high_level_topic, o_orderstatus as section,
  o_orderkey::varchar as file_id, o_orderdate::date as due_date,
  nullif(o_orderkey % 11, 0)::int as urgency, left(o_orderpriority, 1)::int as priority
from orders"""


@query(
    f"""select owner, file_id, rank from (select *, row_number() over (partition by owner
      order by priority desc nulls last, urgency desc nulls last, due_date nulls last,
      file_id, section)::int as rank from ({ORDER_ITEMS})) where rank <= 3"""
)
def ranked_items(spark, sf):
    return action_item_rank(order_items(spark, sf), 3).select("owner", "file_id", "rank")


@query(
    f"""select owner, high_level_topic, section,
      (grouping(owner) + grouping(high_level_topic) + grouping(section))::int as level,
      count(*) as items, round(avg(urgency), 6) as mean_urgency, round(avg(priority), 6) as mean_priority
    from ({ORDER_ITEMS}) group by rollup (owner, high_level_topic, section)"""
)
def item_report(spark, sf):
    report = action_item_report(order_items(spark, sf))
    return report.withColumns(
        {c: F.round(c, 6) for c in ("mean_urgency", "mean_priority")}
    )
