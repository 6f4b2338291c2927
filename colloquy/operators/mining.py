"""Sentences, terms and cues of transcripts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mentions, paragraphs, sentences, spaced_words, tokens
from ..skew import computed_once, top_per_key

# A term counts as frequent from this share of all pairs of file and term on.
FREQUENT = 1 / 1_000_000

# So many phrases of a cue table are broadcast at most, those that stand in the most places.
COMMON = 500_000

# Places of phrases are counted in one of so many segments, to tell which phrases are common.
COUNTED = 16

# So many numbers with marks of phrases in their 64 bits are broadcast at most; a power of two.
MARKS = 1 << 20

# Stands for the question mark at the end of a segment; no run of words is equal to it.
ASKED = "?"

# Cue phrases in plain English; callers bring their own for other languages.
CUES = {
    "decision": ["decided", "agreed", "approved", "the decision is"],
    "action_item": ["will send", "will prepare", "to do", "action item", "follow up"],
    "open_question": ["open question", "to be decided", "not decided"],
    "unclear": ["unclear", "not sure", "do not understand"],
}


def transcript_segments(df: DataFrame, unit: str = "sentence") -> DataFrame:
    """Sentences or paragraphs, numbered from 1 per file: ``file_id, pos, segment``."""
    cut = {"sentence": sentences, "paragraph": paragraphs}[unit]
    return df.select("file_id", F.posexplode(cut(F.col("text"))).alias("pos", "segment")).withColumn(
        "pos", F.col("pos") + 1
    )


def _kinds(text: Column, words: Column, cues, question_mark: str | None) -> Column:
    def found(kind: str, phrases: list[str]) -> Column:
        said = mentions(words, phrases)
        return said | F.endswith(text, F.lit("?")) if kind == question_mark else said

    return F.array_compact(
        F.array(*[F.when(found(kind, phrases), kind) for kind, phrases in cues.items()])
    )


def phrase_index(cues: DataFrame) -> DataFrame:
    """The phrases of a cue table (``kind, phrase``) by number of words and words: ``kind, n, gram``.

    Case and what stands between words do not count; a phrase without words is none.
    """
    words = cues.select("kind", tokens(F.col("phrase")).alias("words")).where(F.size("words") > 0)
    return words.select("kind", F.size("words").alias("n"), F.array_join("words", " ").alias("gram")).distinct()


def _starts(text: Column, least: int, most: int) -> Column:
    """From each word of a text on the run of ``most`` words, or of as many as there are, ``least`` at least;
    ``ASKED`` if the text ends with a question mark."""
    run = rf"(?<= )(?=([^ ]++(?: [^ ]++){{{least - 1},{most - 1}}}+))"
    asked = F.when(F.endswith(text, F.lit("?")), F.array(F.lit(ASKED))).otherwise(F.array().cast("array<string>"))
    return F.concat(asked, F.regexp_extract_all(spaced_words(text), F.lit(run), F.lit(1)))


def _runs(segments: DataFrame, lengths: list[int], text: str, keys: list[str]) -> DataFrame:
    """Runs of words of these lengths: ``_key, gram``. Where a text ends sooner, a shorter run is there again."""
    starts = _starts(F.col(text), min(lengths), max(lengths))
    begun = segments.select(F.struct(*keys).alias("_key"), F.explode(starts).alias("_start"))
    cut = [F.substring_index("_start", " ", n) for n in lengths]
    return begun.select("_key", F.explode(F.array(*cut)).alias("gram"))


def _bit(place: Column) -> Column:
    """A number with one bit, the one that the last six of ``place`` name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _marked(runs: DataFrame, phrases: DataFrame, also: str = "false") -> DataFrame:
    """Runs of words (``gram``) whose mark one of the phrases has, and those of which ``also`` holds.

    A mark is two bits of one of ``MARKS`` numbers, which are broadcast. Other runs may have it as well.
    """
    place = F.xxhash64("gram")
    number = place.bitwiseAND(MARKS - 1).alias("_number")
    mark = _bit(F.shiftrightunsigned(place, 58)).bitwiseOR(_bit(F.shiftrightunsigned(place, 52)))
    known = phrases.select(number, mark.alias("_mark")).groupBy("_number").agg(F.bit_or("_mark").alias("_marks"))
    met = runs.select("*", number).join(F.broadcast(known), "_number", "left")
    return met.where(F.expr(also) | (F.col("_marks").bitwiseAND(mark) == mark)).select(*runs.columns)


def _by_places(runs: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The phrases that stand in the most places, ``COMMON`` at most, and all others.

    Places are counted in one in ``COUNTED`` keys. That says which phrases are broadcast, not what is found.
    """
    some = runs.where(F.pmod(F.xxhash64("_key"), F.lit(COUNTED)) == 0).select("gram")
    places = _marked(some, masks).groupBy("gram").agg(F.count("*").alias("_places"))
    weighed = masks.join(places, "gram", "left").withColumn("_places", F.coalesce("_places", F.lit(0)))
    # A row per number of places, from the highest on.
    so_far = F.sum("_rows").over(Window.orderBy(F.desc("_places"))).alias("_so_far")
    levels = weighed.groupBy("_places").agg(F.count("*").alias("_rows")).select("_places", so_far)
    least = levels.where(F.col("_so_far") <= COMMON).agg(F.min("_places")).scalar()
    common = F.coalesce(F.col("_places") >= least, F.lit(False))
    return weighed.where(common).select(*masks.columns), weighed.where(~common).select(*masks.columns)


def _found(runs: DataFrame, masks: DataFrame) -> DataFrame:
    """``runs`` met with so many phrases that not all are broadcast: ``_key, _block, _mask``.

    Runs of common phrases stay where they are, a row per key moves. Of all others those move whose mark a phrase
    has. Both leave the same shuffle, so that runs are made once for them.
    """
    common, rare = _by_places(runs, masks)
    met = _marked(runs.join(F.broadcast(common), "gram", "left"), masks, "_mask is not null")
    moved = met.groupBy("_key", "_block", F.when(F.col("_mask").isNull(), F.col("gram")).alias("gram"))
    moved = moved.agg(F.bit_or("_mask").alias("_mask"))
    moved = computed_once(moved, ["_key"], {c: F.col(c) for c in ("_block", "_mask", "gram")})
    rare = rare.select("gram", F.col("_block").alias("_b"), F.col("_mask").alias("_m"))
    named = ["_key", F.coalesce("_block", "_b").alias("_block"), F.coalesce("_mask", "_m").alias("_mask")]
    here = moved.where(F.col("gram").isNull()).select("_key", "_block", "_mask")
    # Moved by key alone, as the segments will be.
    return here.unionByName(moved.join(rare, "gram").select(*named)).repartition("_key")


def _cue_join(segments: DataFrame, cues: DataFrame, question_mark: str | None, text: str, keys: list[str]) -> DataFrame:
    """Runs of words met with the phrases, then their segments with the kinds found.

    What is found in a segment is a bit per kind, in numbers of 64 bits (``_mask``, the ``_block``-th one): a row or
    a few, however many phrases and kinds there are. Keys, these numbers and runs that may be a rare phrase move;
    the segments' texts move once, to meet what was found.
    """
    index = phrase_index(cues).where(F.col("gram").isNotNull())
    lengths = index.groupBy("n").count().collect()  # a few numbers
    phrases = index.select("kind", "gram")
    if question_mark is not None:
        asked = segments.sparkSession.range(0, 1, 1, 1).select(F.lit(question_mark).alias("kind"), F.lit(ASKED).alias("gram"))
        phrases = phrases.unionByName(asked)

    place = F.row_number().over(Window.orderBy("kind")) - 1
    kinds = phrases.select("kind").distinct().select(F.col("kind").alias("_kind"), place.alias("_place"))
    kinds = kinds.select("_kind", F.expr("int(_place div 64)").alias("_block"), F.expr("int(_place % 64)").alias("_bit"))
    masks = phrases.join(F.broadcast(kinds), F.col("kind").eqNullSafe(F.col("_kind"))).groupBy("gram", "_block")
    masks = masks.agg(F.bit_or(_bit(F.col("_bit"))).alias("_mask"))

    runs = _runs(segments, sorted(r.n for r in lengths) or [1], text, keys)
    few = sum(r["count"] for r in lengths) < COMMON
    found = runs.join(F.broadcast(masks), "gram") if few else _found(runs, masks)
    found = found.groupBy("_key", "_block").agg(F.bit_or("_mask").alias("_mask"))

    # A struct of the keys equals another with nulls in the same places, so no row is lost.
    whole = segments.select(F.struct(*keys).alias("_key"), *[c for c in segments.columns if c not in keys])
    named = kinds.groupBy("_block").agg(F.collect_list(F.struct("_bit", "_kind")).alias("_kinds"))
    told = whole.join(found, "_key").join(F.broadcast(named), "_block")
    own = F.filter("_kinds", lambda k: F.getbit(F.col("_mask"), k["_bit"]) == 1)
    columns = [F.col("_key")[c].alias(c) if c in keys else F.col(c) for c in segments.columns]
    return told.select(*columns, F.explode(F.transform(own, lambda k: k["_kind"])).alias("kind"))


def cue_extract(
    segments: DataFrame,
    cues: dict[str, list[str]] | DataFrame = CUES,
    question_mark: str | None = "open_question",
    text: str = "segment",
    keys: tuple[str, ...] = ("file_id", "pos"),
) -> DataFrame:
    """One row per segment and kind of cue found in it.

    A segment that ends with a question mark also counts as the kind named by ``question_mark``. A few
    phrases, given as a dict, are tested where the segment is; nothing is joined. A table of them
    (``kind, phrase``), of any length, is joined by words, and ``keys`` tell the segments apart.
    """
    if isinstance(cues, DataFrame):
        return _cue_join(segments, cues, question_mark, text, list(keys))
    spaced = segments.withColumn("_words", spaced_words(F.col(text)))
    kinds = _kinds(F.col(text), F.col("_words"), cues, question_mark)
    return spaced.withColumn("kind", F.explode(kinds)).drop("_words")


def _file_terms(df: DataFrame, words, entry, term=lambda w: w) -> DataFrame:
    """``file_id, terms``: a row per file, also if it has no words.

    ``words`` gives the array of a text's words, ``term`` what of a word has to be equal, and ``entry`` what is
    kept of the words from one place up to another, all equal. A file's words are sorted inside its row, so there
    is no table of all words to aggregate, which would be sorted and spilled.
    """
    texts = df.groupBy("file_id").agg(F.collect_list("text").alias("_texts"))
    ordered = computed_once(texts, ["file_id"], {"_words": F.array_sort(F.flatten(F.transform("_texts", words)))})
    n = F.size("_words")

    def begins(i: Column) -> Column:
        return (i == 0) | (term(F.get("_words", i)) != term(F.get("_words", i - 1)))

    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), begins)).otherwise(F.array().cast("array<int>"))
    cut = computed_once(ordered, ["file_id", "_words"], {"_starts": starts})
    terms = F.transform("_starts", lambda i, k: entry(i, F.coalesce(F.get("_starts", k + 1), n)))
    return computed_once(cut, ["file_id"], {"terms": terms})


def counted_file_terms(df: DataFrame) -> DataFrame:
    """``file_id, terms``: how often each term occurs in each file, as ``term, tf``."""

    def entry(start: Column, end: Column) -> Column:
        return F.struct(F.get("_words", start).alias("term"), (end - start).cast("long").alias("tf"))

    return _file_terms(df, tokens, entry)


def document_terms(df: DataFrame) -> DataFrame:
    """How often each term occurs in each file: ``file_id, term, tf``."""
    return counted_file_terms(df).select("file_id", F.inline("terms"))


def _placed_terms(df: DataFrame) -> DataFrame:
    """In which sentences each term of a file is, a place per occurrence: ``file_id, term, places``."""

    def words(text: Column) -> Column:
        def placed(found: Column, i: Column) -> Column:
            return F.transform(found, lambda w: F.struct(w.alias("term"), (i + 1).alias("pos")))

        return F.flatten(F.transform(F.transform(sentences(text), tokens), placed))

    def entry(start: Column, end: Column) -> Column:
        places = F.transform(F.slice("_words", start + 1, end - start), lambda w: w["pos"])
        return F.struct(F.get("_words", start)["term"].alias("term"), places.alias("places"))

    return _file_terms(df, words, entry, lambda w: w["term"]).select("file_id", F.inline("terms"))


def document_frequency(df: DataFrame) -> DataFrame:
    """In how many files each term occurs: ``term, df``.

    Repeats inside a file go before the count, so no (file, term) shuffle is needed.
    """
    words = df.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    # A join asks for terms that are not null; asked here, all readers share one shuffle.
    return words.where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("df"))


def _by_file(df: DataFrame) -> DataFrame:
    """Each transcript moved once, so that nothing about its words has to be.

    The words of a text, each with its file, are more than the text. A row is one file, so
    no file can overload a task by having many rows.
    """
    return df.select("file_id", "text").repartition("file_id")


def with_idf(terms: DataFrame, texts: DataFrame, files: Column) -> DataFrame:
    """Adds ``idf`` to rows of ``file_id, term``; ``files`` is the number of files."""
    return weighted_terms(terms, document_frequency(texts), files)


def weighted_terms(terms: DataFrame, frequency: DataFrame, files: Column) -> DataFrame:
    """Adds ``idf`` to rows with a ``term``, from a table of ``term, df``.

    A frequent term has a row in a large share of the files. Terms with more than a
    millionth of all rows are at most a million, however much text there is: their
    weights are broadcast, and their rows stay where they are. Only rows of the rare terms,
    none of which can be hot, are moved to meet their weights.
    """
    pairs = frequency.agg(F.sum("df")).scalar()
    frequent = F.col("df") > pairs * F.lit(FREQUENT)
    weights = frequency.select("term", F.log(files / F.col("df")).alias("idf"), frequent.alias("frequent"))
    common = F.broadcast(weights.where("frequent").select("term", "idf"))
    rare = weights.where("not frequent").select("term", "idf")
    moved = terms.join(common, "term", "left_anti").join(rare, "term")
    return terms.join(common, "term").unionByName(moved)


def key_terms(df: DataFrame, k: int) -> DataFrame:
    """The k terms of each file with the highest tf-idf: ``file_id, term, score, rank``."""
    texts = _by_file(df)
    files = df.agg(F.count("*")).scalar()
    scored = with_idf(document_terms(texts), texts, files).select(
        "file_id", "term", F.round(F.col("tf") * F.col("idf"), 6).alias("score")
    )
    order = [F.desc("score"), F.asc("term")]
    return top_per_key(scored, ["file_id"], order, k, "rank")


def extractive_summary(df: DataFrame, k: int) -> DataFrame:
    """The k sentences of each file with the highest mean tf-idf weight, in reading order:
    ``file_id, pos, score, segment``.

    A term meets its weight once per file, together with the sentences it is in. The texts
    of the chosen sentences are cut from the transcript at the end and are not shuffled
    with the terms. A file without words gives no rows.
    """
    texts = _by_file(df)
    places = _placed_terms(texts)
    weight = F.size("places") * F.col("idf")
    scores = (
        with_idf(places, texts, df.agg(F.count("*")).scalar())
        .select("file_id", weight.alias("weight"), F.explode("places").alias("pos"))
        .groupBy("file_id", "pos")
        .agg(F.round(F.avg("weight"), 6).alias("score"))
    )
    order = [F.desc("score"), F.asc("pos")]
    chosen = (
        top_per_key(scores, ["file_id"], order, k, "rank")
        .groupBy("file_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "score"))).alias("chosen"))
    )
    # The same texts, moved the same way: Spark takes them from the first shuffle. An inner join would first
    # filter them, and so move them again; files without a choice give no rows anyway.
    found = texts.join(chosen, "file_id", "left")
    cut = computed_once(found, ["file_id", "chosen"], {"_s": F.when(F.col("chosen").isNotNull(), sentences(F.col("text")))})
    picked = F.transform(
        "chosen",
        lambda c: F.struct(c["pos"], c["score"], F.get("_s", c["pos"] - 1).alias("segment")),
    )
    return cut.select("file_id", F.inline(picked))


def assistant_mentions(df: DataFrame, name: str) -> DataFrame:
    """Which sentences name the assistant: ``file_id, mentioned, positions``.

    Without a mention ``positions`` is an empty array.
    """
    named = F.transform(
        sentences(F.col("text")), lambda s, i: F.when(mentions(spaced_words(s), [name]), i + 1)
    )
    positions = F.coalesce(F.array_compact(named), F.array().cast("array<int>"))
    return df.select("file_id", positions.alias("positions")).withColumn(
        "mentioned", F.size("positions") > 0
    )


def owner_from_speaker(
    turns: DataFrame,
    cues: dict[str, list[str]] | DataFrame = CUES,
    kind: str = "action_item",
) -> DataFrame:
    """Tasks found in the turns, each owned by whoever speaks: ``file_id, turn, pos, owner, task``."""
    said = turns.select(
        "file_id",
        "turn",
        "speaker",
        F.posexplode(sentences(F.col("text"))).alias("pos", "segment"),
    ).withColumn("pos", F.col("pos") + 1)
    own = cues.where(F.col("kind") == kind) if isinstance(cues, DataFrame) else {kind: cues[kind]}
    tasks = cue_extract(said, own, question_mark=None, keys=("file_id", "turn", "pos"))
    return tasks.select(
        "file_id", "turn", "pos", F.col("speaker").alias("owner"), F.col("segment").alias("task")
    )


def assemble_parts(turns: DataFrame, turns_per_part: int = 1000) -> DataFrame:
    """Turns as labelled text, a bounded number of turns per row: ``file_id, part, text``."""
    part = F.expr(f"turn div {turns_per_part}").alias("part")
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))),
        lambda t: F.concat_ws(": ", t["speaker"], t["text"]),
    )
    return turns.groupBy("file_id", part).agg(F.array_join(lines, "\n").alias("text"))


def assemble_transcript(turns: DataFrame, turns_per_part: int = 1000) -> DataFrame:
    """Turns of a file as one text with speaker labels, in turn order.

    Long files are put together from parts, so only whole parts meet in the last step.
    A file beyond the size of a text cell stays in parts: use ``assemble_parts``.
    """
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))
    return (
        assemble_parts(turns, turns_per_part)
        .groupBy("file_id")
        .agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    )
