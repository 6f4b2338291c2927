"""One fixed layout for summaries that come in many."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import null_marker_cleanup

PERSON = "array<struct<name:string,role:string,background:string,affiliation:string,email:string>>"
SECTION = (
    "array<struct<section:string,heading:string,section_title:string,"
    "text:string,section_content:string,paragraphs:array<string>>>"
)
POINT = "array<struct<point:string,description:string>>"
OUTLINE = (
    "array<struct<heading:string,section:string,topic:string,title:string,text:string,"
    "bullets:array<string>,points:array<string>,details:array<string>>>"
)
NO_TEXT = "cast(array() as array<string>)"
NO_PEOPLE = "cast(array() as array<struct<name:string,role:string,affiliation:string,email:string>>)"


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("_v", path, kind)


def _list_under(heading: str) -> Column:
    """Items of the '- ' list below a heading inside the body text; null without one."""
    block = F.regexp_extract(
        F.col("_content"), rf"(?:^|\n){heading}:[ \t]*\n((?:- [^\n]*(?:\n|$))+)", 1
    )
    return F.when(block != "", F.regexp_extract_all(block, F.lit(r"- ([^\n]*)"), F.lit(1)))


def _points(path: str) -> Column:
    """Array of texts, whether the array holds texts or objects with one."""
    return _paired(path, POINT, lambda t, o: F.coalesce(o["point"], o["description"], t))


def _paired(path: str, kind: str, merge) -> Column:
    """Each element of an array as text and as an object of ``kind``, merged; both are read once."""
    objects = F.coalesce(_get(path, kind), F.expr(f"cast(array() as {kind})"))
    return F.zip_with(_get(path, "array<string>"), objects, merge)


def _attendees() -> Column:
    """The current layout's list of people: names, or objects with a name."""
    fields = ("role", "background", "affiliation", "email")

    def person(text: Column, o: Column) -> Column:
        name = F.coalesce(o["name"], text)
        return F.struct(name.alias("name"), *[o[f].alias(f) for f in fields])

    return _paired("$.attendees", PERSON, person)


def _outline() -> Column:
    """The current layout's sections: texts, or objects with a heading and bullet points."""

    def section(text: Column, o: Column) -> Column:
        heading = F.coalesce(o["heading"], o["section"], o["topic"], o["title"])
        bullets = F.array_join(F.coalesce(o["bullets"], o["points"], o["details"]), "\n")
        body = F.coalesce(o["text"], bullets, F.when(heading.isNull(), text))
        return F.struct(F.coalesce(heading, F.lit("")).alias("heading"), body.alias("text"))

    return _paired("$.outline", OUTLINE, section)


def _date_precision() -> Column:
    raw = F.col("date_raw")
    return (
        F.when(F.col("date").isNotNull(), "day")
        .when(F.regexp_like(raw, F.lit(r"^[0-9]{4}-(0[1-9]|1[0-2])$")), "month")
        .when(F.regexp_like(raw, F.lit(r"^[0-9]{4}$")), "year")
        .otherwise("none")
    )


def summary_normalize(df: DataFrame, col: str = "v") -> DataFrame:
    """Summaries of any known layout as ``title, date_raw, date, date_precision, abstract,
    people, sections, key_points, next_steps``.

    People come from the first list of people there is, else from the list inside the body
    text, else from the single author. A date is only set when the reply gives a full one.
    """
    typed = df.select("file_id", F.col(col).alias("_v")).select(
        "file_id",
        _get("$.title", "string").alias("title"),
        _get("$.date", "string").alias("date_raw"),
        _get("$.summary", "string").alias("abstract"),
        _get("$.author", "string").alias("_author"),
        _get("$.email", "string").alias("_email"),
        F.coalesce(
            _get("$.presenters", PERSON),
            _get("$.authors", PERSON),
            _get("$.panelists", PERSON),
            _attendees(),
        ).alias("_people"),
        _get("$.contact_information", "map<string,string>").alias("_contacts"),
        F.when(
            F.schema_of_variant(_get("$.content", "variant")) == "STRING",
            _get("$.content", "string"),
        ).alias("_content"),
        _get("$.content", SECTION).alias("_sections"),
        _get("$.editorial_summary", "map<string,string>").alias("_named"),
        _outline().alias("_outline"),
        F.coalesce(
            _points("$.key_points"),
            _points("$.key_topics"),
            _points("$.key_takeaways"),
            _points("$.next_steps.key_points"),
        ).alias("_key_points"),
        F.coalesce(_points("$.next_steps"), _points("$.next_steps.tangible_next_steps")).alias(
            "_next_steps"
        ),
    )

    def person(name: Column, role: Column, affiliation: Column, email: Column) -> Column:
        return F.struct(
            name.alias("name"),
            null_marker_cleanup(role).alias("role"),
            null_marker_cleanup(affiliation).alias("affiliation"),
            null_marker_cleanup(email).alias("email"),
        )

    nothing = F.lit(None).cast("string")
    listed = F.transform(
        "_people",
        lambda p: person(
            p["name"],
            F.coalesce(p["role"], p["background"]),
            p["affiliation"],
            F.coalesce(p["email"], F.col("_contacts")[p["name"]]),
        ),
    )
    inline = F.transform(
        _list_under("Presenters"), lambda n: person(n, nothing, nothing, nothing)
    )
    single = F.when(
        F.col("_author").isNotNull(),
        F.array(person(F.col("_author"), F.lit("author"), nothing, F.col("_email"))),
    )

    def section(heading: Column, text: Column) -> Column:
        return F.struct(heading.alias("heading"), text.alias("text"))

    sections = F.coalesce(
        F.transform(
            "_sections",
            lambda s: section(
                F.coalesce(s["heading"], s["section"], s["section_title"]),
                F.coalesce(s["text"], s["section_content"], F.array_join(s["paragraphs"], "\n")),
            ),
        ),
        F.transform(F.map_entries("_named"), lambda e: section(e["key"], e["value"])),
        F.col("_outline"),
        F.when(F.col("_content").isNotNull(), F.array(section(F.lit(""), F.col("_content")))),
        F.expr("cast(array() as array<struct<heading:string,text:string>>)"),
    )
    full_date = F.when(
        F.regexp_like("date_raw", F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")),
        F.col("date_raw").try_cast("date"),
    )
    return (
        typed.withColumn("date", full_date)
        .withColumn("date_precision", _date_precision())
        .select(
            "file_id",
            "title",
            "date_raw",
            "date",
            "date_precision",
            "abstract",
            F.coalesce(listed, inline, single, F.expr(NO_PEOPLE)).alias("people"),
            sections.alias("sections"),
            F.coalesce("_key_points", _list_under("Key Points"), F.expr(NO_TEXT)).alias(
                "key_points"
            ),
            F.coalesce("_next_steps", _list_under("Next Steps"), F.expr(NO_TEXT)).alias(
                "next_steps"
            ),
        )
    )


# Objects whose keys are data, such as names: what they are called is not part of the layout.
MAP_KEYS = ("contact_information", "editorial_summary")


def schema_drift_report(
    df: DataFrame, col: str = "v", map_keys: tuple[str, ...] = MAP_KEYS
) -> DataFrame:
    """For each top-level key: in how many summaries it has which type.

    An object below one of ``map_keys`` counts as ``MAP<STRING>`` whatever its own keys are, so the
    report does not grow with the data and names nobody.
    """
    entries = F.map_entries(F.col(col).try_cast("map<string,variant>"))

    def kind(e: Column) -> Column:
        found = F.schema_of_variant(e["value"])
        free = e["key"].isin(*map_keys) & F.startswith(found, F.lit("OBJECT<"))
        return F.struct(e["key"].alias("key"), F.when(free, "MAP<STRING>").otherwise(found).alias("type"))

    kinds = F.transform(entries, kind)
    return df.select(F.inline(kinds)).groupBy("key", "type").agg(F.count("*").alias("summaries"))


def summary_quality_flags(norm: DataFrame, start: str, end: str) -> DataFrame:
    """Adds ``flags``: what is doubtful about a summary of an event held from start to end."""
    day = F.col("date")

    def flag(broken: Column, name: str) -> Column:
        return F.when(broken, F.lit(name))

    doubts = F.array(
        flag((day < F.lit(start).cast("date")) | (day > F.lit(end).cast("date")), "date_outside"),
        flag(F.col("date_precision") == "year", "year_only"),
        flag(F.col("date_precision") == "none", "no_date"),
        flag(F.size("people") == 0, "no_people"),
        flag(
            (F.size("sections") == 0)
            | F.exists("sections", lambda s: F.coalesce(F.trim(s["text"]), F.lit("")) == ""),
            "empty_section",
        ),
    )
    return norm.withColumn("flags", F.array_compact(doubts))
