"""Action items: flatten, check, rank, report."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import STRICT
from ..schemas import ITEM_FIELDS, ITEM_SECTIONS
from ..skew import computed_once, top_per_key

SCORES = [str(n) for n in range(1, 11)]
ISO_DATE = "0000-00-00"  # a date, whatever its digits


def assistant_slug(name: str) -> str:
    """The assistant's name as it appears in key names."""
    return "_".join(name.lower().split())


def assistant_sections(assistant_name: str) -> tuple[str, ...]:
    """The assistant's own sections: its actions, and the items that name it."""
    slug = assistant_slug(assistant_name)
    return (f"{slug}_actions", f"{slug}_items")


def item_sections(assistant_name: str) -> tuple[str, ...]:
    """All sections that hold action items, the assistant's own last."""
    return (*ITEM_SECTIONS, *assistant_sections(assistant_name))


def _score(c: Column) -> Column:
    return F.when(c.isin(*SCORES), c.cast("int"))


def _day(c: Column) -> Column:
    return F.when(F.translate(c, "123456789", "000000000") == ISO_DATE, c.try_cast("date"))


def action_items_flatten(
    df: DataFrame, assistant_name: str, col: str = "json_content"
) -> DataFrame:
    """One row per action item: ``file_id, section, pos, item_json, field_names`` and its fields.

    The sections are cut out of the text in one read, and each item is read once more for itself,
    as the fields of the contract and as names, so that one odd item does not cost the others. The
    names keep their order, which is part of the contract; of a repeated name the first place and
    the last value count. Empty and missing sections give no rows.
    """
    sections = item_sections(assistant_name)
    flag = f"{assistant_slug(assistant_name)}_reference"
    layout = ", ".join(f"`{s}` array<string>" for s in sections)
    fields = ", ".join(f"`{f}` string" for f in (*ITEM_FIELDS, flag))

    def listed(section: str) -> Column:
        texts = F.coalesce(F.col("_s")[section], F.array().cast("array<string>"))
        return F.struct(F.lit(section).alias("section"), texts.alias("items"))

    read = df.select("file_id", F.from_json(F.col(col), layout, STRICT).alias("_s"))
    cut = read.select("file_id", F.inline(F.array(*[listed(s) for s in sections])))
    rows = cut.select("file_id", "section", F.posexplode("items").alias("pos", "item_json"))
    item = {"_i": F.from_json("item_json", fields, STRICT), "_names": F.json_object_keys("item_json")}
    rows = computed_once(rows, ["file_id", "section", "pos", "item_json"], item)

    def field(name: str) -> Column:
        return F.col("_i")[name]

    return rows.select(
        "file_id",
        "section",
        "pos",
        "item_json",
        F.coalesce(F.array_distinct("_names"), F.array().cast("array<string>")).alias("field_names"),
        field("description").alias("description"),
        field("owner").alias("owner"),
        field("due_date").alias("due_date_raw"),
        _day(field("due_date")).alias("due_date"),
        _score(field("urgency_score")).alias("urgency"),
        _score(field("priority_score")).alias("priority"),
        field("citation").alias("citation"),
        field("high_level_topic").alias("high_level_topic"),
        F.lower(field(flag)).try_cast("boolean").alias("assistant_reference"),
    )


def action_item_validate(items: DataFrame, assistant_name: str) -> DataFrame:
    """Adds ``violations``: the names of the contract rules an item breaks, in rule order."""
    own = F.col("section").isin(*assistant_sections(assistant_name))
    flag = f"{assistant_slug(assistant_name)}_reference"
    common = F.array(*[F.lit(f) for f in ITEM_FIELDS])
    expected = F.when(own, F.concat(common, F.array(F.lit(flag)))).otherwise(common)
    checked = items.withColumn("_expected", expected)

    known = F.array_except("_expected", F.array_except("_expected", "field_names"))
    given = F.filter("field_names", lambda k: F.array_contains(F.col("_expected"), k))
    kind = F.schema_of_variant(
        F.try_variant_get(F.try_parse_json("item_json"), f"$.{flag}", "variant")
    )

    def rule(broken: Column, name: str) -> Column:
        return F.when(broken, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    def has(name: str) -> Column:
        return F.array_contains("field_names", name)

    fields = F.concat(
        F.transform(
            F.array_except("_expected", "field_names"), lambda k: F.concat(F.lit("missing:"), k)
        ),
        F.transform(F.array_except("field_names", "_expected"), lambda k: F.concat(F.lit("extra:"), k)),
        rule(given != known, "order"),
    )
    violations = F.concat(
        # Most items have just the fields they should.
        F.when(F.col("field_names") == F.col("_expected"), F.array().cast("array<string>")).otherwise(
            fields
        ),
        rule(has("urgency_score") & F.col("urgency").isNull(), "urgency_score"),
        rule(has("priority_score") & F.col("priority").isNull(), "priority_score"),
        rule(has("due_date") & F.col("due_date").isNull(), "due_date"),
        rule(
            own
            & has(flag)
            & (F.coalesce(kind, F.lit("")) != "BOOLEAN"),
            flag,
        ),
    )
    return checked.withColumn("violations", violations).drop("_expected")


def action_item_rank(items: DataFrame, k: int) -> DataFrame:
    """The k most pressing items of each owner, with ``rank``."""
    order = [
        F.desc_nulls_last("priority"),
        F.desc_nulls_last("urgency"),
        F.asc_nulls_last("due_date"),
        F.asc("file_id"),
        F.asc("section"),
        F.asc("pos"),
    ]
    return top_per_key(items, ["owner"], order, k, "rank")


def action_item_report(items: DataFrame) -> DataFrame:
    """Items per owner, topic and section with subtotals, and mean urgency and priority.

    Items are added up per combination first, so the subtotals repeat those sums and not
    the items. ``level`` counts the columns that a row sums over: 0 is one combination.
    """
    combos = items.groupBy("owner", "high_level_topic", "section").agg(
        F.count("*").alias("n"),
        F.sum("urgency").alias("u"),
        F.count("urgency").alias("nu"),
        F.sum("priority").alias("p"),
        F.count("priority").alias("np"),
    )
    return combos.rollup("owner", "high_level_topic", "section").agg(
        F.grouping_id().alias("level"),
        F.sum("n").alias("items"),
        F.try_divide(F.sum("u"), F.sum("nu")).alias("mean_urgency"),
        F.try_divide(F.sum("p"), F.sum("np")).alias("mean_priority"),
    ).withColumn("level", F.bit_count("level").cast("int"))
