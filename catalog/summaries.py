"""Stored replies in the known layouts, made from documents, and their one normal form."""

from pyspark.sql import functions as F

from colloquy import functions as fn
from colloquy.operators import (
    schema_drift_report,
    summary_normalize,
    summary_quality_flags,
)

from .registry import escaped, query, table, transcripts

# One line per layout, in the order of the document number modulo 5: what stands between the
# braces. {t} is the escaped text, {raw} the text with its line breaks, {n} the number.
LAYOUTS = (
    # A string body with raw line breaks that hides its lists.
    '"title":"Body {n}","date":"2023","author":"The Guild","content":"\n{raw}\n\nPresenters:\n'
    "- Ann {n}\n- Bo {n}\n\nKey Points:\n- {src} first\n- second\n\nNext Steps:\n- go on\n\","
    '"summary":"In short {n}."',
    # Named sections, panelists with addresses elsewhere, topics.
    '"title":"Named {n}","date":"2023-02","panelists":[{{"name":"Cy {n}","alias":"C",'
    '"background":"tax"}}],"key_topics":["{src}","{lang}"],"next_steps":["look {n}"],'
    '"editorial_summary":{{"intro":"{t}","outro":"end"}},"contact_information":'
    '{{"Cy {n}":"cy{n}@mail.example"}}',
    # Sections with text, authors with affiliation, steps as objects.
    '"title":"Texts {n}","date":"2023-02-30","authors":[{{"name":"Di {n}","affiliation":"{src}"}},'
    '{{"name":"Ed {n}","affiliation":"N/A"}}],"content":[{{"section":"Intro","text":"{t}"}}],'
    '"next_steps":[{{"point":"ask {n}"}},{{"point":"tell"}}]',
    # Sections with paragraphs, presenters and nested steps.
    '"title":"Nested {n}","date":"2024-03-{day}","author":"The Guild","content":'
    '[{{"heading":"One","paragraphs":["{t}","more"]}},{{"section_title":"Two",'
    '"section_content":"{lang}"}}],"presenters":[{{"name":"Flo {n}","role":"chair",'
    '"email":"Not provided"}}],"next_steps":{{"key_points":["k {n}"],"tangible_next_steps":["t1","t2"]}}',
    # The current prompt's layout.
    '"title":"Outline {n}","date":"2024-04-{day}","attendees":["Gil {n}",{{"name":"Hal {n}","role":"host"}}],'
    '"summary":"All of {n}.","outline":[{{"topic":"One","bullets":["{t}","more"]}},"loose {n}"],'
    '"key_takeaways":["{src}",{{"point":"p {n}"}}],"next_steps":[{{"description":"do {n}","owner":"Gil"}}]',
)


def stored(spark, sf):
    """Stored replies: ``file_id, raw, v``, fenced and wrapped as they are on disk."""
    docs = transcripts(spark, sf)
    values = {
        "n": F.col("file_id"),
        "src": F.col("user_folder_id"),
        "lang": F.col("lang"),
        "t": escaped(F.col("text")),
        "raw": escaped(F.col("text"), breaks=()),
        "day": F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"),
    }
    body = F.lit("")
    for number, layout in enumerate(LAYOUTS):
        plain = layout.replace("{{", "\x01").replace("}}", "\x02")
        pieces = []
        for i, part in enumerate(plain.replace("}", "{").split("{")):
            text = part.replace("\x01", "{").replace("\x02", "}")
            pieces.append(values[part] if i % 2 else F.lit(text))
        body = F.when(F.col("doc_id") % len(LAYOUTS) == number, F.concat(*pieces)).otherwise(body)
    raw = F.concat(F.lit('{\n"response": ```json\n{'), body, F.lit("}\n```\n}"))
    return docs.select("doc_id", "file_id", raw.alias("raw")).withColumn(
        "v", fn.summary_unwrap(F.col("raw"))
    )


@query(
    r"""select doc_id::varchar as file_id, true as is_object,
    case doc_id % 5 when 0 then 'Body ' when 1 then 'Named ' when 2 then 'Texts ' when 3 then 'Nested '
      else 'Outline ' end || doc_id as title,
    case when doc_id % 5 = 0 then md5(chr(10) || text || chr(10) || chr(10) || 'Presenters:' || chr(10)
      || '- Ann ' || doc_id || chr(10) || '- Bo ' || doc_id || chr(10) || chr(10) || 'Key Points:'
      || chr(10) || '- ' || source || ' first' || chr(10) || '- second' || chr(10) || chr(10)
      || 'Next Steps:' || chr(10) || '- go on' || chr(10)) end as content_md5 from documents"""
)
def unwrapped_summaries(spark, sf):
    content = F.try_variant_get("v", "$.content", "variant")
    is_text = F.schema_of_variant(content) == "STRING"
    return stored(spark, sf).select(
        "file_id",
        F.col("v").isNotNull().alias("is_object"),
        F.try_variant_get("v", "$.title", "string").alias("title"),
        F.when(is_text, F.md5(F.try_variant_get("v", "$.content", "string"))).alias("content_md5"),
    )


@query(
    r"""with d as (select *, doc_id % 5 as k, doc_id::varchar as n,
        lpad((doc_id % 28 + 1)::varchar, 2, '0') as day from documents)
    select n as file_id,
      case k when 0 then 'Body ' when 1 then 'Named ' when 2 then 'Texts ' when 3 then 'Nested '
        else 'Outline ' end || n as title,
      case k when 0 then '2023' when 1 then '2023-02' when 2 then '2023-02-30'
        when 3 then '2024-03-' || day else '2024-04-' || day end as date_raw,
      case k when 3 then '2024-03-' || day when 4 then '2024-04-' || day end as date,
      case k when 0 then 'year' when 1 then 'month' when 2 then 'none' else 'day' end as date_precision,
      case k when 0 then 'In short ' || n || '.' when 4 then 'All of ' || n || '.' end as abstract,
      case k when 0 then 'Ann ' || n || '/-/-/-;Bo ' || n || '/-/-/-'
        when 1 then 'Cy ' || n || '/tax/-/cy' || n || '@mail.example'
        when 2 then 'Di ' || n || '/-/' || source || '/-;Ed ' || n || '/-/-/-'
        when 3 then 'Flo ' || n || '/chair/-/-'
        else 'Gil ' || n || '/-/-/-;Hal ' || n || '/host/-/-' end as people,
      md5(case k when 0 then '=' || chr(10) || text || chr(10) || chr(10) || 'Presenters:' || chr(10)
          || '- Ann ' || n || chr(10) || '- Bo ' || n || chr(10) || chr(10) || 'Key Points:'
          || chr(10) || '- ' || source || ' first' || chr(10) || '- second' || chr(10) || chr(10)
          || 'Next Steps:' || chr(10) || '- go on' || chr(10)
        when 1 then 'intro=' || text || ';outro=end'
        when 2 then 'Intro=' || text
        when 3 then 'One=' || text || chr(10) || 'more;Two=' || lang
        else 'One=' || text || chr(10) || 'more;=loose ' || n end) as sections_md5,
      case k when 0 then source || ' first;second' when 1 then source || ';' || lang
        when 2 then '' when 3 then 'k ' || n else source || ';p ' || n end as key_points,
      case k when 0 then 'go on' when 1 then 'look ' || n when 2 then 'ask ' || n || ';tell'
        when 3 then 't1;t2' else 'do ' || n end as next_steps
    from d"""
)
def normalized_summaries(spark, sf):
    norm = summary_normalize(stored(spark, sf))
    dash = F.lit("-")
    people = F.transform(
        "people",
        lambda p: F.concat_ws(
            "/",
            p["name"],
            F.coalesce(p["role"], dash),
            F.coalesce(p["affiliation"], dash),
            F.coalesce(p["email"], dash),
        ),
    )
    sections = F.transform("sections", lambda s: F.concat_ws("=", s["heading"], s["text"]))
    return norm.select(
        "file_id",
        "title",
        "date_raw",
        F.col("date").cast("string").alias("date"),
        "date_precision",
        "abstract",
        F.array_join(people, ";").alias("people"),
        F.md5(F.array_join(sections, ";")).alias("sections_md5"),
        F.array_join("key_points", ";").alias("key_points"),
        F.array_join("next_steps", ";").alias("next_steps"),
    )


_KEYS = {
    0: {"title": "STRING", "date": "STRING", "author": "STRING", "content": "STRING", "summary": "STRING"},
    1: {
        "title": "STRING",
        "date": "STRING",
        "panelists": "ARRAY<OBJECT<alias: STRING, background: STRING, name: STRING>>",
        "key_topics": "ARRAY<STRING>",
        "next_steps": "ARRAY<STRING>",
        "editorial_summary": "MAP<STRING>",
        "contact_information": "MAP<STRING>",
    },
    2: {
        "title": "STRING",
        "date": "STRING",
        "authors": "ARRAY<OBJECT<affiliation: STRING, name: STRING>>",
        "content": "ARRAY<OBJECT<section: STRING, text: STRING>>",
        "next_steps": "ARRAY<OBJECT<point: STRING>>",
    },
    3: {
        "title": "STRING",
        "date": "STRING",
        "author": "STRING",
        "content": "ARRAY<OBJECT<heading: STRING, paragraphs: ARRAY<STRING>, "
        "section_content: STRING, section_title: STRING>>",
        "presenters": "ARRAY<OBJECT<email: STRING, name: STRING, role: STRING>>",
        "next_steps": "OBJECT<key_points: ARRAY<STRING>, tangible_next_steps: ARRAY<STRING>>",
    },
    4: {
        "title": "STRING",
        "date": "STRING",
        "attendees": "ARRAY<VARIANT>",
        "summary": "STRING",
        "outline": "ARRAY<VARIANT>",
        "key_takeaways": "ARRAY<VARIANT>",
        "next_steps": "ARRAY<OBJECT<description: STRING, owner: STRING>>",
    },
}
_KEY_ROWS = ", ".join(
    f"({k}, '{key}', '{kind}')" for k, keys in _KEYS.items() for key, kind in keys.items()
)


@query(
    f"""select key, type, count(*) as summaries from documents
      join (values {_KEY_ROWS}) l(k, key, type) on k = doc_id % 5 group by all"""
)
def schema_drift(spark, sf):
    return schema_drift_report(stored(spark, sf))


@query(
    """with n as (select o_orderkey, o_orderdate::date as d, o_orderkey % 5 as k, o_orderpriority as p
      from orders)
    select o_orderkey::varchar as file_id, concat_ws(',',
      case when k > 1 and d not between date '1995-01-01' and date '1995-03-31' then 'date_outside' end,
      case when k = 0 then 'year_only' end, case when k = 1 then 'no_date' end,
      case when p = '1-URGENT' then 'no_people' end,
      case when p in ('2-HIGH', '3-MEDIUM') then 'empty_section' end) as flags from n"""
)
def quality_flags(spark, sf):
    kind, priority = F.col("o_orderkey") % 5, F.col("o_orderpriority")
    person = F.struct(F.col("o_orderpriority").alias("name"))
    section = F.struct(
        F.lit("Intro").alias("heading"), F.when(priority == "2-HIGH", " ").otherwise("x").alias("text")
    )
    norm = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("file_id"),
        F.when(kind > 1, F.col("o_orderdate").cast("date")).alias("date"),
        F.when(kind == 0, "year").when(kind == 1, "none").otherwise("day").alias("date_precision"),
        F.filter(F.array(person), lambda p: p["name"] != "1-URGENT").alias("people"),
        F.filter(F.array(section), lambda s: priority != "3-MEDIUM").alias("sections"),
    )
    flagged = summary_quality_flags(norm, "1995-01-01", "1995-03-31")
    return flagged.select("file_id", F.array_join("flags", ",").alias("flags"))
