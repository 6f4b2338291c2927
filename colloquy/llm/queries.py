"""One query per operator over its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.skew import computed_once

from . import (
    additive_model,
    decontaminate,
    language_id,
    mixing,
    near_dedup,
    packing,
    quality_rules,
    runs,
    simhash,
    suffix_tree,
    toolcalls,
    vector_codes,
    warc,
)
from .registry import query
from .shared import Scratch, fold, table


@query()
def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts of every text, and whether the risk-controlled rules keep it."""
    judged = quality_rules.quality_table(spark, table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.col("rejected_by").isNull().alias("kept"),
        F.concat_ws(",", "rejected_by").alias("rules"),
    )


@query()
def op4_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Size of each document's shingle set and the component of near-duplicates it is in."""
    found = near_dedup.near_duplicates(spark, table(spark, sf, "documents"))
    return found.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


WORDS5 = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(f"""
    with d as (select doc_id, coalesce({WORDS5}, []::varchar[]) as w from documents),
    b as (select item_id, {WORDS5} as w from benchmark where item_id is not null and text is not null),
    i as (select item_id, w, least(len(w), 10) as k from b where len(w) > 0),
    windows as (
        select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as gram
        from (select item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as p from i)
    ),
    grams as (
        select doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') as gram
        from (
            select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as p
            from d, (select distinct k from i) where len(w) >= k
        )
    ),
    hits as (select doc_id, p, k, item_id from grams join windows using (k, gram)),
    words as (select doc_id, count(distinct q) as n from (select doc_id, unnest(generate_series(p, p + k - 1)) as q from hits) group by doc_id),
    items as (
        select doc_id, count(*) as n, string_agg(item, ',' order by item) as joined
        from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id
    )
    select d.doc_id, len(d.w)::bigint as n_words, coalesce(words.n, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items,
        sha256(coalesce(items.joined, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
    from d left join words using (doc_id) left join items using (doc_id)
""")
def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item, and the items."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.contamination(spark, docs, table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        decontaminate.covered(F.col("found.spans")).alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
    )


@query()
def op8_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mixing.mix_table(spark, table(spark, sf, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"), "source"
    )


@query()
def op9_packed_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as packed rows of token ids."""
    return packing.pack(spark, table(spark, sf, "documents"))


@query("""
    with p as (select page_id, coalesce(html, '') as html from pages),
    d as (select page_id, strlen(html) as n, sha1(html) as digest from p),
    g as (select *, max(page_id) over (partition by digest, n) as best from d)
    select page_id, n::bigint as payload_bytes, digest as payload_digest,
        case when n >= 1000 and page_id <> best then 'revisit' else 'response' end as record_type,
        case when n >= 1000 and page_id <> best then best end as refers_to
    from g
""")
def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    """The records of the archives of all pages, as they are read back from their files."""
    folder = f"{Scratch(spark, 'warc-files').root}/archives"
    warc.export_warc(warc.write_warc(spark, table(spark, sf, "pages")), folder)
    archives = warc.read_files(spark, folder)
    return warc.verified(warc.read_warc(archives)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


# Tools that the turns of the conversations are read as calls of: see op3_tool_calls.
TOOLS = {
    "open": {"question": ("string", True, 30, None), "turn": ("integer", True, 0, 1), "words": ("integer", True, 5, 60)},
    "reply": {"question": ("string", True, 20, 350), "turn": ("integer", True, 2, None), "words": ("integer", True, 5, 50)},
}


@query(r"""
    with recursive
    c0 as (
        select conv_id, 'c' || turn as call_id, turn, case when turn < 2 then 'open' else 'reply' end as tool, text,
            len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words,
            case when turn >= 2 then 'c' || (turn - 2) end as parent
        from conversations where role = 'user'
    ),
    c as (
        select conv_id, call_id, min(turn) as turn, min(tool) as tool, min(text) as text, min(parent) as parent,
            arg_min(words, text) as words, count(*) as n_calls
        from c0 group by all
    ),
    r as (
        select conv_id, 'c' || (turn - 1) as call_id, min(text) as content, count(*) as n_results
        from conversations where role = 'assistant' group by all
    ),
    up as (
        select conv_id, call_id, 0::bigint as level, parent is not null as lost from c
        where parent is null or not exists (select 1 from c p where p.conv_id = c.conv_id and p.call_id = c.parent)
        union all
        select c.conv_id, c.call_id, up.level + 1, false from c join up on up.conv_id = c.conv_id and up.call_id = c.parent
    ),
    linked as (
        select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, turn, tool, level, text, words,
            coalesce(n_calls, 0)::bigint as n_calls, coalesce(n_results, 0)::bigint as n_results, content,
            case when n_calls is null then 'no_call' when n_results is null then 'no_result' when lost then 'no_parent' else 'linked' end as status
        from c full join r on c.conv_id = r.conv_id and c.call_id = r.call_id
        left join up on up.conv_id = c.conv_id and up.call_id = c.call_id
    ),
    judged as (
        select *, case when n_calls = 0 then [] else list_concat(
            case when length(text) < (case tool when 'open' then 30 else 20 end) then ['question:least'] else [] end,
            case when tool = 'reply' and length(text) > 350 then ['question:most'] else [] end,
            case when words < 5 then ['words:least'] else [] end,
            case when words > (case tool when 'open' then 60 else 50 end) then ['words:most'] else [] end
        ) end as violations
        from linked
    )
    select conv_id, call_id, turn, tool, level, status, n_calls, n_results, array_to_string(violations, ',') as violations,
        '{"arguments":' || case when n_calls = 0 then 'null' else '{"question":' || to_json(text) || ',"turn":' || turn || ',"words":' || words || '}' end
        || ',"conversation":' || conv_id || ',"id":"' || call_id || '","level":' || coalesce(level::varchar, 'null')
        || ',"result":' || case when n_results = 0 then 'null' else to_json(content) end || ',"status":"' || status || '","tool":'
        || coalesce('"' || tool || '"', 'null') || ',"violations":' || to_json(violations) || '}' as json
    from judged
    where conv_id is not null and call_id is not null
    union all
    select conv_id, null, turn, null, null, 'unlinked', 0, 0, '', null from conversations
    where role is null or role not in ('user', 'assistant') or conv_id is null or turn is null
""")
def op3_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as tool calls, each built on the user turn before; assistant turns as their results.

    Turns of other roles, and those without a conversation or a number, are there as ``unlinked``.
    """
    turns = table(spark, sf, "conversations")
    words = F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')")
    calls = turns.where("role = 'user'").select(
        "conv_id",
        F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id"),
        "turn",
        F.when(F.col("turn") < 2, "open").otherwise("reply").alias("tool"),
        F.to_json(F.struct(F.col("text").alias("question"), "turn", words.alias("words"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.concat(F.lit("c"), (F.col("turn") - 2).cast("string"))).alias("parent_id"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content")
    )
    linked = toolcalls.link_calls(spark, calls, results, TOOLS)
    linked = linked.withColumn("violations", F.concat_ws(",", "violations"))
    known = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    others = turns.where(~known | F.col("conv_id").isNull() | F.col("turn").isNull()).select("conv_id", "turn")
    values = {"status": F.lit("unlinked"), "n_calls": F.lit(0).cast("bigint"), "n_results": F.lit(0).cast("bigint"), "violations": F.lit("")}
    return linked.unionByName(others.withColumns(values), allowMissingColumns=True)


@query()
def op2_suffix_tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Unigram and suffix-tree scores of every document; those of fold 2 are not learned from."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = suffix_tree.score(spark, docs, fold("doc_id", 7) != 2)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document; those of fold 1 are not learned from."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return language_id.identify(spark, docs, fold("doc_id", 3) != 1)


@query()
def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document; labels of fold 0 are not learned from."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = additive_model.classify(spark, docs, table(spark, sf, "labels"), fold("doc_id", 5) != 0)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; the words of one document in ten repeat from a word on that its id's hash names."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    n, g = F.nullif(F.size("words"), F.lit(0)), F.floor(h / 10)
    cut = computed_once(docs, ["doc_id", "text"], {"words": words}).withColumns({"n": n, "a": g % n})
    cut = cut.withColumn("period", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    repeated = F.transform(
        "words",
        lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("period")).cast("int"))),
    )
    text = F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"))


@query()
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of words in every document, the longest one, and a digest of the text without their repeats."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = runs.find_runs(with_planted_runs(docs))
    rank = F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n"))))
    best = found.withColumns({"best": F.array_max(rank), "lines": F.array_join(lines, "")})
    start, period = -F.col("best.start"), -F.col("best.period")
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        start.alias("start"),
        F.col("best.length").alias("length"),
        period.alias("period"),
        F.floor(1000 * F.col("best.length") / period).cast("bigint").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query()
def op12_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of each document and the component of near ones it is in."""
    found = simhash.near_duplicates(spark, table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _assigned(step: int) -> str:
    """SQL: the entry of each part, and the codebook after it, from codebook ``b<step>``."""
    return f"""
    d{step} as (
        select vec_id, part, entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
        from p join b{step} b using (part)
    ),
    a{step} as (select vec_id, part, arg_min(entry, (d, entry)) as entry, min(d) as d from d{step} group by vec_id, part),
    u{step} as (
        select part, entry, list(m order by place) as v
        from (
            select part, entry, place, floor(sum(x)::hugeint // count(*) - case when sum(x) < 0 and sum(x) % count(*) <> 0 then 1 else 0 end)::bigint as m
            from (select part, entry, unnest(v) as x, generate_subscripts(v, 1) as place from a{step} join p using (vec_id, part))
            group by part, entry, place
        ) group by part, entry
    ),
    b{step + 1} as (select part, entry, coalesce(u.v, b.v) as v from b{step} b left join u{step} u using (part, entry)),"""


@query(f"""
    with kept as (
        select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
        where embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
    ),
    p as (
        select vec_id, part, e[part * len(e) // 16 + 1:(part + 1) * len(e) // 16] as v
        from kept, (select unnest(generate_series(0, 15)) as part)
    ),
    b0 as (
        select part, n - 1 as entry, v from p
        join (select vec_id, row_number() over (order by vec_id) as n from kept) using (vec_id) where n <= 64
    ),
    {_assigned(0)}
    {_assigned(1)}
    {_assigned(2)}
    books as (
        select sha256(string_agg(x::varchar, ',' order by part, entry, place)) as digest
        from (select part, entry, unnest(v) as x, generate_subscripts(v, 1) as place from b2)
    ),
    codes as (
        select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a2 group by vec_id
    )
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, digest as codebooks_sha256
    from codes join kept using (vec_id), books
""")
def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Product code and error of every vector, the error of its label and a digest of the codebooks."""
    codes, books = vector_codes.compress(spark, table(spark, sf, "embeddings"))
    return vector_codes.with_label_errors(codes).select(
        "vec_id",
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(vector_codes.digest(books)).alias("codebooks_sha256"),
    )
