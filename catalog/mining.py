"""Text mining over documents and conversations."""

from pyspark.sql import functions as F

from colloquy import work_dir
from colloquy.operators import (
    assemble_transcript,
    assistant_mentions,
    cue_extract,
    extractive_summary,
    key_terms,
    owner_from_speaker,
    transcript_segments,
)

from colloquy.plans import stored_key_terms, update_terms
from colloquy.skew import computed_once

from .registry import ORACLE, SENTENCES, query, transcripts, turns

NUMBERED = f"""
select doc_id::varchar as file_id, unnest(s) as segment, unnest(range(1, len(s) + 1)) as pos
from (select doc_id, {SENTENCES} as s from documents)"""


@query(f"select file_id, pos::int as pos, md5(segment) as segment_md5 from ({NUMBERED})")
def sentence_segments(spark, sf):
    cut = transcript_segments(transcripts(spark, sf))
    return cut.select("file_id", "pos", F.md5("segment").alias("segment_md5"))


@query(
    r"""select file_id, pos::int as pos, md5(segment) as segment_md5 from (
      select doc_id::varchar as file_id, unnest(s) as segment, unnest(range(1, len(s) + 1)) as pos
      from (select doc_id, list_filter(list_transform(string_split(text, chr(10)),
        lambda s: trim(s)), lambda s: s <> '') as s from documents))"""
)
def paragraph_segments(spark, sf):
    cut = transcript_segments(transcripts(spark, sf), "paragraph")
    return cut.select("file_id", "pos", F.md5("segment").alias("segment_md5"))


# The texts are made of invented words; these occur in all four languages.
CUES = {
    "decision": ["for the", "was", "pour"],
    "action_item": ["with", "und die", "con"],
    "open_question": ["are", "avec"],
    "unclear": ["worthless", "nicht"],
}


def _cue_sql(kind: str, column: str) -> str:
    body = "|".join(CUES[kind]).replace(" ", r"[^\p{L}\p{N}]+")
    return rf"regexp_matches(lower({column}), '(^|[^\p{{L}}\p{{N}}])({body})([^\p{{L}}\p{{N}}]|$)')"


@query(
    " union all ".join(
        f"select file_id, pos::int as pos, '{kind}' as kind, md5(segment) as segment_md5 from "
        f"({NUMBERED}) where {_cue_sql(kind, 'segment')}"
        + (" or segment like '%?'" if kind == "open_question" else "")
        for kind in CUES
    )
)
def cue_sentences(spark, sf):
    found = cue_extract(transcript_segments(transcripts(spark, sf)), CUES)
    return found.select("file_id", "pos", "kind", F.md5("segment").alias("segment_md5"))


# The first two or three words of every document are phrases of its source.
PHRASES = r"""
select distinct source as kind, n, array_to_string(w[1:n], ' ') as gram
from (select source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents), (select unnest([2, 3]) as n)
where len(w) >= n"""


@query(
    rf"""with s as (select file_id, pos, segment, regexp_extract_all(lower(segment), '[\p{{L}}\p{{N}}]+') as w from ({NUMBERED})),
    g as (select file_id, pos, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as gram
      from s, (select unnest([2, 3]) as n) where len(w) >= n),
    k as (select file_id, pos, kind from g join ({PHRASES}) using (n, gram)
      union all select file_id, pos, 'open_question' from s where segment like '%?')
    select distinct file_id, pos::int as pos, kind, md5(segment) as segment_md5 from k join s using (file_id, pos)"""
)
def cue_table_sentences(spark, sf):
    """Cues from a table with a phrase of two and one of three words for each document."""
    docs = transcripts(spark, sf)
    # Three words are wanted; the rest of a text is not read. The fourth word is there as some letters are
    # lowered by what follows them.
    start = F.regexp_extract("text", r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){0,4}", 0)
    opening = F.slice(F.regexp_extract_all(F.lower(start), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, 3)
    begun = computed_once(docs.select(F.col("user_folder_id").alias("kind"), "text"), ["kind"], {"words": opening})
    words = begun.select("kind", "words", F.explode(F.array(F.lit(2), F.lit(3))).alias("n"))
    cues = words.where(F.size("words") >= F.col("n")).select("kind", F.array_join(F.slice("words", F.lit(1), F.col("n")), " -- ").alias("phrase"))
    found = cue_extract(transcript_segments(docs), cues)
    return found.select("file_id", "pos", "kind", F.md5("segment").alias("segment_md5"))


WORDS = rf"""
select file_id, pos, unnest(regexp_extract_all(lower(segment), '[\p{{L}}\p{{N}}]+')) as term
from ({NUMBERED})"""
WEIGHTS = f"""
w as (select file_id, pos, term from ({WORDS})),
tf as (select file_id, term, count(*) as tf from w group by all),
df as (select term, count(*) as df from tf group by term),
total as (select count(*) as n from documents),
weighted as (select file_id, term, tf * ln(n / df) as weight from tf join df using (term), total)"""


@query(
    f"""with {WEIGHTS}, r as (select file_id, term, round(weight, 6) as score from weighted)
    select file_id, term, score, row_number() over (partition by file_id
      order by score desc, term)::int as rank from r
    qualify rank <= 5"""
)
def key_term_table(spark, sf):
    return key_terms(transcripts(spark, sf), 5)


@query(ORACLE["key_term_table"])
def incremental_key_terms(spark, sf):
    """The same after three batches; the files of the first one are replaced by the third one's texts."""
    out, docs = work_dir(spark, "terms"), transcripts(spark, sf).select("doc_id", "file_id", "text")
    third = F.col("doc_id") % 3 == 0
    draft = F.concat(F.reverse("text"), F.lit(" a first draft of "), "file_id")
    update_terms(spark, docs.where(third).withColumn("text", draft), out, "1")
    update_terms(spark, docs.where(~third), out, "2")
    update_terms(spark, docs.where(third), out, "3")
    return stored_key_terms(spark, out, 5)


@query(
    f"""with {WEIGHTS}, s as (
      select w.file_id, w.pos, round(avg(weight), 6) as score
      from w join weighted using (file_id, term) group by all)
    select s.file_id, s.pos::int as pos, s.score, md5(segment) as segment_md5
    from s join ({NUMBERED}) n using (file_id, pos)
    qualify row_number() over (partition by s.file_id order by s.score desc, s.pos) <= 3"""
)
def summary_sentences(spark, sf):
    picked = extractive_summary(transcripts(spark, sf), 3)
    return picked.select("file_id", "pos", "score", F.md5("segment").alias("segment_md5"))


@query(
    rf"""select doc_id::varchar as file_id, len(p) > 0 as mentioned,
      array_to_string(p, ',') as positions
    from (select doc_id, list_filter(list_transform({SENTENCES}, lambda s, i: case when
      regexp_matches(lower(s), '(^|[^\p{{L}}\p{{N}}])those([^\p{{L}}\p{{N}}]|$)') then i end),
      lambda i: i is not null) as p from documents)"""
)
def assistant_mention_table(spark, sf):
    found = assistant_mentions(transcripts(spark, sf), "Those")
    return found.select(
        "file_id", "mentioned", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")
    )


@query(
    f"""select file_id, turn, pos::int as pos, owner, md5(segment) as task_md5 from (
      select conv_id::varchar as file_id, turn, role as owner, unnest(s) as segment,
        unnest(range(1, len(s) + 1)) as pos
      from (select *, {SENTENCES} as s from conversations))
    where {_cue_sql("action_item", "segment")}"""
)
def task_owners(spark, sf):
    tasks = owner_from_speaker(turns(spark, sf), CUES)
    return tasks.select("file_id", "turn", "pos", "owner", F.md5("task").alias("task_md5"))


@query(
    """select conv_id::varchar as file_id,
    md5(string_agg(role || ': ' || text, chr(10) order by turn)) as text_md5
    from conversations group by conv_id"""
)
def assembled_transcripts(spark, sf):
    return assemble_transcript(turns(spark, sf)).select(
        "file_id", F.md5("text").alias("text_md5")
    )
