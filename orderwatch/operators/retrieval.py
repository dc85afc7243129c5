"""Keyword retrieval: a batch of queries against a written index of chunks.

Every word of a query is a prefix term; a word that the tokenizer splits is a
phrase whose last part is a prefix. Phrases meet the postings by their first characters,
and only the postings near their terms are read; no text is tokenised for a search. Where
an operator is given chunks instead of an index, it writes one first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import is_blank, words as words_of
from ..session import new_path, stored
from .index import GRAM, INDEXED, MARKS, PREFIX_CHARS, WORD, SearchIndex, build_index, grams_of, tokens

# Okapi BM25 parameters and the lowest weight of a very common term.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
SUBSTRING_SCORE = 999.0
# More than any number of chunks: the search ranks all that match.
NO_CUT = 2**31 - 1
SECTION_BOOST = 0.5
TEXT_ONLY = {"text": 1.0}

# The commonest terms, which a search looks up before it reads the places.
FREQUENT = 20_000

# Phrases of a query that give a first bound on its k-th best score.
SEED_PHRASES = 3
# More than scores of equal rank can differ by.
SCORE_SLACK = 1e-4
# Inner words of a literal query that narrow the chunks down; the text decides.
LITERAL_WORDS = 4

# ------------------------------------------------------------- index tables


def postings(chunks: DataFrame, columns: Sequence[str] = INDEXED) -> DataFrame:
    """(term, chunk_id, field, tf, first): how often each term occurs in each column of each chunk.

    ``first`` marks one row of each (term, chunk_id). Terms are counted inside the chunk's row, so nothing
    is shuffled but the rows of chunk ids that come more than once.
    """
    spark = chunks.sparkSession
    rows = stored(_indexed(chunks).select("chunk_id", *(c for c in columns if c != "chunk_id")), new_path(spark, "indexed"))
    repeated = rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("chunk_id").alias("repeated"))
    repeated = stored(repeated, new_path(spark, "repeated"))
    same = F.col("chunk_id").eqNullSafe(F.col("repeated"))
    once = _counted(rows.join(repeated, same, "left_anti"), columns)
    again = _counted(rows.join(repeated, same, "left_semi"), columns).groupBy("term", "chunk_id", "field").agg(F.sum("tf").alias("tf"))
    of_chunk = Window.partitionBy("term", "chunk_id").orderBy("field")
    return once.unionByName(again.withColumn("first", F.row_number().over(of_chunk) == 1))


def _counted(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Terms of each row and column with their number: equal ones stand side by side in the sorted array."""
    def keys(i: int, column: str) -> Column:
        found = tokens(F.coalesce(column, F.lit("")))
        # terms hold no zero character, so those of other columns follow the same term of the first one
        return F.transform(found, lambda t: F.concat(t, F.lit(f"\0{i}"))) if i else found

    def term(key: Column) -> Column:
        return F.substring_index(key, "\0", 1)

    def runs(sorted_: Column) -> Column:
        starts = F.array_compact(F.transform(sorted_, lambda k, i: F.when((i == 0) | (k != F.get(sorted_, i - 1)), i)))

        def run(at: Column, next_: Column, starts_: Column) -> Column:
            key, before = F.get(sorted_, at), F.get(sorted_, at - 1)
            size = F.coalesce(F.get(starts_, next_ + 1), F.size(sorted_)) - at
            return F.struct(key.alias("key"), size.cast("long").alias("tf"), F.coalesce(term(key) != term(before), F.lit(True)).alias("first"))

        return let(starts, lambda s: F.transform(s, lambda at, j: run(at, j, s)))

    every = F.sort_array(F.flatten(F.array(*(keys(i, c) for i, c in enumerate(columns)))))
    counted = rows.select("chunk_id", F.inline(let(every, runs)))
    number = F.when(F.contains("key", F.lit("\0")), F.substring_index("key", "\0", -1).cast("int")).otherwise(0)
    field = F.get(F.array(*map(F.lit, columns)), number)
    return counted.select(term(F.col("key")).alias("term"), "chunk_id", field.alias("field"), "tf", "first")


def vocabulary(postings_: DataFrame) -> DataFrame:
    """Chunks that contain each term, and all its occurrences.

    Rows marked ``first`` are the term's chunks. Without that column postings are reduced per
    (term, chunk) first. A term that occurs everywhere is counted by many tasks.
    """
    if "first" in postings_.columns:
        return postings_.groupBy("term").agg(F.count_if("first").alias("df"), F.sum("tf").alias("cf"))
    per_chunk = postings_.groupBy("term", "chunk_id").agg(F.sum("tf").alias("tf"))
    return per_chunk.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(chunks: DataFrame, columns: Sequence[str] = INDEXED) -> DataFrame:
    """One row: number of chunks and mean length in tokens."""
    lengths = _indexed(chunks).select(_length(columns).alias("n_tokens"))
    return lengths.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("n_tokens").alias("avg_tokens"))


def _indexed(chunks: DataFrame) -> DataFrame:
    return chunks.filter(~is_blank(F.col("text")))


def _length(columns: Sequence[str]) -> Column:
    sizes = [F.size(tokens(F.coalesce(c, F.lit("")))) for c in columns]
    total = sizes[0]
    for size in sizes[1:]:
        total = total + size
    return total


# ------------------------------------------------------------------- queries


def query_phrases(queries: DataFrame) -> DataFrame:
    """One row per query and distinct phrase: phrase, n_parts, repeats.

    Quotes and asterisks are dropped and hyphens separate words. A word without
    letters or digits gives the empty phrase, which no chunk matches.
    """
    cleaned = F.translate("query", '-"*', " ")
    rows = queries.select("query_id", F.explode(words_of(cleaned)).alias("word"))
    parts = tokens(F.col("word"))
    rows = rows.select("query_id", F.array_join(parts, " ").alias("phrase"), F.size(parts).alias("n_parts"))
    return rows.groupBy("query_id", "phrase", "n_parts").agg(F.count(F.lit(1)).alias("repeats"))


def _of(chunks: DataFrame | SearchIndex, columns: Sequence[str], literal: bool = True) -> SearchIndex:
    return chunks if isinstance(chunks, SearchIndex) else build_index(chunks, columns=columns, literal=literal)


def _stored(index: SearchIndex, df: DataFrame, name: str) -> DataFrame:
    """An intermediate table: what it is used for several times is computed once, and joins know its size."""
    return stored(df, new_path(index.spark, name))


# --------------------------------------------------------- terms and places


def beginning_with(index: SearchIndex, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the number of each term that begins with its ``part``.

    The dictionary is sorted, so these numbers are a range, found by the part's first
    PREFIX_CHARS characters. Only for longer parts the terms themselves are compared.
    """
    short = F.substring("part", 1, PREFIX_CHARS).alias("prefix")
    ranged = wanted.select("*", short).join(index.table("prefixes"), "prefix").drop("prefix")
    numbered = ranged.select(*wanted.columns, F.explode(F.sequence("low", "high")).alias("term_no"))
    long = F.length("part") > PREFIX_CHARS
    exact = numbered.filter(long).join(index.table("terms").select("term_no", "term"), "term_no").filter(F.startswith("term", "part"))
    return numbered.filter(~long).unionByName(exact.drop("term"))


def _met(index: SearchIndex, parts: DataFrame) -> DataFrame:
    """``parts`` with each place (chunk_no, field, pos) of their terms: those beginning with a last ``part``, or equal to another.

    The FREQUENT commonest terms, which have most places, are met with the parts once. Any other place is met by its term's own
    beginnings of up to PREFIX_CHARS characters. So what is joined to the places grows with the phrases, not with the dictionary.
    """
    parts = parts.withColumn("last", F.col("at") == F.col("n_parts") - 1).withColumn("head", F.substring("part", 1, PREFIX_CHARS))
    parts = parts.select("head", F.struct("phrase_no", "n_parts", "at").alias("met"), "part", "last")
    same = F.when(F.col("last"), F.startswith("term", "part")).otherwise(F.col("term") == F.col("part"))
    sizes = F.sequence(F.lit(1), F.least(F.length("term"), F.lit(PREFIX_CHARS)))
    heads = F.transform(sizes, lambda n: F.substring("term", F.lit(1), n))

    common = index.table("terms").orderBy(F.desc("n_places"), "term").limit(FREQUENT).select("term")
    met = common.select("term", F.explode(heads).alias("head")).join(parts, "head").filter(same)
    met = common.join(met.select("term", "met"), "term", "left").groupBy("term")
    unmet = F.lit(None).cast("string").alias("head")
    known = met.agg(F.transform(F.collect_list("met"), lambda m: F.struct(m.alias("met"), unmet)).alias("known"))
    known = _stored(index, known, "known")
    by_head = F.transform(heads, lambda h: F.struct(F.lit(None).cast(parts.schema["met"].dataType).alias("met"), h.alias("head")))
    places = index.places().filter(F.col("field") != MARKS).join(known, "term", "left")
    places = places.select("term", "chunk_no", "field", "pos", F.inline(F.coalesce("known", by_head)).alias("known", "beginning"))
    found = places.join(parts, (F.col("beginning") == F.col("head")) & same, "left")
    found = found.select("chunk_no", "field", "pos", F.coalesce("known", "met").alias("met")).filter("met is not null")
    return found.select("met.*", "chunk_no", "field", "pos")


def phrase_hits(index: SearchIndex, phrases: DataFrame, weights: Mapping[str, float] = TEXT_ONLY) -> DataFrame:
    """(chunk_no, phrase_no, tf): weighted frequency of each phrase in each chunk that has it.

    ``phrases`` has phrase_no, phrase and n_parts, a row for each phrase.

    Parts of a phrase meet where they stand in one field at the phrase's distances: each gives
    the place where the phrase would begin, and a place that all parts give holds it. So
    phrases of any length take one aggregation.
    """
    parts = phrases.select("phrase_no", "n_parts", F.posexplode(F.split("phrase", " ")).alias("at", "part"))
    parts = _stored(index, parts, "parts")
    weight = F.lit(0.0)
    for field, column in enumerate(index.columns):
        if weights.get(column):
            weight = F.when(F.col("field") == field, float(weights[column])).otherwise(weight)
    frequency = F.sum("weight").alias("tf")
    single = _met(index, parts.filter("n_parts = 1")).select("chunk_no", "phrase_no", weight.alias("weight"))
    single = single.groupBy("chunk_no", "phrase_no").agg(frequency)
    longer = parts.filter("n_parts > 1")
    if longer.isEmpty():
        return single
    found = _met(index, longer).select("phrase_no", "n_parts", "at", "chunk_no", "field", "pos", weight.alias("weight"))
    begins = found.withColumn("begin", F.col("pos") - F.col("at"))
    begins = begins.groupBy("chunk_no", "phrase_no", "n_parts", "field", "begin").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("weight").alias("weight")
    )
    several = begins.filter("n = n_parts").groupBy("chunk_no", "phrase_no").agg(frequency)
    return single.unionByName(several)


# -------------------------------------------------------------------- search


def search(
    chunks: DataFrame | SearchIndex,
    queries: DataFrame,
    top_k: int = 5,
    content_type: str | None = None,
    weights: Mapping[str, float] = TEXT_ONLY,
    columns: Sequence[str] = INDEXED,
    fallback: bool = True,
) -> DataFrame:
    """Best chunks per query: query_id, chunk_id, score, matched_by, rank.

    Chunks with all phrases answer a query. With ``fallback``, a query of
    several words without such a chunk takes chunks with any phrase, and a query
    still without an answer takes chunks whose text contains it literally.

    For complete matches only the chunks with the query's rarest phrase are looked at.
    """
    index = _of(chunks, columns, fallback)
    n_chunks, mean = index.size()
    phrases = _stored(index, query_phrases(queries), "phrases")
    # numbers are given when the table is written, and then only read
    numbered = phrases.filter("phrase != ''").select("phrase", "n_parts").distinct().withColumn("phrase_no", F.monotonically_increasing_id())
    numbered = _stored(index, numbered, "numbered")
    hits = phrase_hits(index, numbered, weights).join(index.table("lengths"), "chunk_no")
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / (mean or 1.0)))
    hits = _stored(index, hits.select("chunk_no", "phrase_no", part.alias("part")), "hits")
    # as many tasks as the index has buckets, so that one does not get more with more chunks
    n_tasks = max(index.table("totals").first().n_buckets, int(index.spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = hits.repartition(n_tasks, "chunk_no", "phrase_no")
    about = index.table("chunks").select("chunk_no", "chunk_id", *(["content_type"] if content_type else []))
    if content_type:
        about = about.filter(F.col("content_type") == content_type).drop("content_type")

    frequency = hits.groupBy("phrase_no").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("top"))
    rarity = F.log((n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
    sizes = phrases.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_phrases"))
    asked = phrases.join(numbered.select("phrase", "phrase_no"), "phrase").join(frequency, "phrase_no").join(sizes, "query_id")
    gain = F.col("repeats") * F.greatest(rarity, F.lit(MIN_IDF))
    asked = _stored(index, asked.select("query_id", "phrase_no", "df", "n_phrases", gain.alias("gain"), (gain * F.col("top")).alias("bound")), "asked")
    known = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_known"), F.min_by("phrase_no", F.struct("df", "phrase_no")).alias("phrase_no"), F.any_value("n_phrases").alias("n_phrases"))
    rarest = known.filter("n_known = n_phrases").select("query_id", "phrase_no")

    def scored(candidates: DataFrame) -> DataFrame:
        """Whole scores of (query_id, chunk_no)."""
        wanted = candidates.join(asked.select("query_id", "phrase_no", "gain", "n_phrases"), "query_id")
        sums = (F.sum(F.col("gain") * F.col("part")).alias("score"), F.count(F.lit(1)).alias("n_matched"))
        return wanted.join(dealt, ["chunk_no", "phrase_no"]).groupBy("query_id", "chunk_no", "n_phrases").agg(*sums)

    def best(rows: DataFrame, matched_by: str) -> DataFrame:
        # the limit on the rank is applied inside each partition first
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "chunk_id")
        ranked = rows.join(about, "chunk_no").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
        return ranked.select("query_id", "chunk_id", "score", F.lit(matched_by).alias("matched_by"), "rank")

    def allowed(rows: DataFrame) -> DataFrame:
        return rows.join(about.select("chunk_no"), "chunk_no", "left_semi") if content_type else rows

    candidates = allowed(hits.join(rarest, "phrase_no").select("query_id", "chunk_no"))
    full = scored(candidates).filter("n_matched = n_phrases")
    if not fallback:
        return best(full, "all")
    full = _stored(index, full.select("query_id", "chunk_no", "score"), "full")
    several = queries.select("query_id", F.size(words_of(F.col("query"))).alias("n_words")).filter("n_words > 1")
    served = full.select("query_id").distinct()
    open_queries = several.join(served, "query_id", "left_anti").select("query_id")
    wanted = _stored(index, asked.join(open_queries, "query_id", "left_semi"), "open")
    partial = scored(_may_enter(index, wanted, hits, allowed, top_k)).select("query_id", "chunk_no", "score")
    partial = _stored(index, partial, "partial")
    served = served.unionByName(partial.select("query_id").distinct())
    literal = _containing(index, queries.join(served, "query_id", "left_anti"), top_k, content_type)
    return best(full, "all").unionByName(best(partial, "any")).unionByName(literal)


def _may_enter(index: SearchIndex, asked: DataFrame, hits: DataFrame, allowed, top_k: int) -> DataFrame:
    """(query_id, chunk_no) of all chunks with a phrase that can be among the ``top_k`` of a query.

    A phrase adds at most ``bound`` to a score. Sums over a query's phrases of highest bound are scores that its chunks
    reach at least; their k-th best is a floor. Phrases whose bounds together stay below the floor
    cannot lift a chunk that has no other phrase, so only the chunks of the others are looked at.
    """
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "phrase_no")
    ranked = asked.withColumn("place", F.row_number().over(by_bound))
    seeds = ranked.filter(F.col("place") <= SEED_PHRASES).select("query_id", "phrase_no", "gain")
    reached = allowed(hits.join(seeds, "phrase_no")).groupBy("query_id", "chunk_no").agg(F.sum(F.col("gain") * F.col("part")).alias("least"))
    kth = Window.partitionBy("query_id").orderBy(F.desc("least"))
    floors = reached.withColumn("place", F.row_number().over(kth)).filter(F.col("place") <= top_k)
    floors = floors.groupBy("query_id").agg(F.min("least").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= top_k)
    rest = Window.partitionBy("query_id").orderBy("bound", "phrase_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = asked.withColumn("together", F.sum("bound").over(rest)).join(floors.select("query_id", "floor"), "query_id", "left")
    needed = summed.filter(F.col("floor").isNull() | (F.col("together") >= F.col("floor") - SCORE_SLACK)).select("query_id", "phrase_no")
    return allowed(hits.join(needed, "phrase_no").select("query_id", "chunk_no").distinct())


def substring_search(chunks: DataFrame | SearchIndex, queries: DataFrame, top_k: int = 5, content_type: str | None = None) -> DataFrame:
    """Chunks whose text contains the query literally, case ignored."""
    return _containing(_of(chunks, INDEXED), queries, top_k, content_type)


def _holding(index: SearchIndex, needles: DataFrame) -> DataFrame:
    """(query_id, term_no) of the terms and marks that contain the query's ``needle``.

    All grams of a needle must be in the term; those with its rarest gram are compared.
    """
    size = F.least(F.length("needle"), F.lit(GRAM))
    grams = F.array_distinct(F.filter(grams_of(F.col("needle")), lambda g: F.length(g) == size))
    rows = needles.select("query_id", "needle", F.explode(grams).alias("gram")).join(index.table("gram_counts"), "gram")
    # of known size, so the table of grams need not be shuffled for a few of them
    rarest = _stored(index, rows.groupBy("query_id", "needle").agg(F.min_by("gram", F.struct("n_terms", "gram")).alias("gram")), "rarest")
    terms = index.table("terms").select("term_no", "term")
    return rarest.join(index.table("grams"), "gram").join(terms, "term_no").filter(F.contains("term", "needle")).select("query_id", "term_no")


def _containing(index: SearchIndex, queries: DataFrame, top_k: int, content_type: str | None) -> DataFrame:
    """Chunks are narrowed down by postings, and only the survivors' texts are read and compared.

    A text with the query holds the query's inner words whole and side by side; of these
    the rarest are looked for. With two words the second one begins a term of the text, a single word
    or a run of other characters lies inside a term or a run.
    """
    asked = queries.select("query_id", F.lower("query").alias("_q")).filter("length(_q) > 0")
    asked = asked.select("query_id", "_q", tokens(F.col("_q")).alias("_t"), F.rlike("_q", F.lit(WORD)).alias("_word"))
    asked = _stored(index, asked, "asked")
    n = F.size("_t")
    fields = F.col("field").isin(index.columns.index("text"), MARKS)

    inner = asked.filter(n > 2).select("query_id", (n - 2).alias("n_inner"), F.posexplode(F.slice("_t", 2, n - 2)).alias("at", "part"))
    counts = index.table("terms").select(F.col("term").alias("part"), "n_places")
    inner = inner.join(counts, "part")
    of_query = Window.partitionBy("query_id")
    rare_first = of_query.orderBy("n_places", "at")
    inner = inner.withColumn("n_known", F.count(F.lit(1)).over(of_query)).filter("n_known = n_inner")
    inner = inner.withColumn("place", F.row_number().over(rare_first)).filter(F.col("place") <= LITERAL_WORDS)
    runs = inner.select("query_id", F.col("part").alias("term"), "at", F.least("n_inner", F.lit(LITERAL_WORDS)).alias("n_parts"))
    pairs = beginning_with(index, asked.filter(n == 2).select("query_id", F.get("_t", F.lit(1)).alias("part"))).select("query_id", "term_no")
    needle = F.when(F.col("_word"), F.get("_t", F.lit(0))).otherwise(F.col("_q")).alias("needle")
    single = _holding(index, asked.filter((n == 1) | ~F.col("_word")).select("query_id", needle))
    one = pairs.unionByName(single).join(index.table("terms").select("term_no", "term"), "term_no")
    one = one.select("query_id", "term", F.lit(0).alias("at"), F.lit(1).alias("n_parts"))
    wanted = _stored(index, runs.unionByName(one), "wanted")

    found = index.places().filter(fields).join(wanted, "term")
    begins = found.groupBy("query_id", "chunk_no", "n_parts", "field", (F.col("pos") - F.col("at")).alias("begin")).agg(F.count(F.lit(1)).alias("n"))
    # of a query with one part several terms may stand at one place
    candidates = begins.filter("n >= n_parts").select("query_id", "chunk_no").distinct()
    candidates = _stored(index, candidates.join(asked.select("query_id", "_q"), "query_id"), "candidates")
    texts = index.table("chunks")
    if content_type:
        texts = texts.filter(F.col("content_type") == content_type)
    matched = texts.select("chunk_no", "chunk_id", "text").join(candidates, "chunk_no").filter(F.contains(F.lower("text"), F.col("_q")))
    order = Window.partitionBy("query_id").orderBy("chunk_id")
    return (
        matched.select("query_id", "chunk_id")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_k)
        .select("query_id", "chunk_id", F.lit(SUBSTRING_SCORE).alias("score"), F.lit("substring").alias("matched_by"), "rank")
    )


def retrieve(
    chunks: DataFrame | SearchIndex,
    queries: DataFrame,
    top_k: int = 5,
    weights: Mapping[str, float] = TEXT_ONLY,
    columns: Sequence[str] = INDEXED,
) -> DataFrame:
    """Search, filter by type, boost preferred sections and keep ``top_k``.

    ``queries`` has query_id, query and optionally include_types and
    prefer_sections (arrays). Filter and boost come before the only cut, so with
    either of them every matching chunk is ranked, by its type and section alone;
    texts are joined to what is left after the cut.
    """
    wishes = [c for c in ("include_types", "prefer_sections") if c in queries.columns]
    index = _of(chunks, columns)
    rows = search(index, queries, NO_CUT if wishes else top_k, weights=weights)
    details = index.table("chunks")
    if wishes:
        narrow = details.select("chunk_id", "section", "content_type")
        rows = rows.drop("rank").join(queries.select("query_id", *wishes), "query_id").join(narrow, "chunk_id")
        if "include_types" in wishes:
            open_to_all = F.coalesce(F.size("include_types"), F.lit(0)) <= 0
            rows = rows.filter(open_to_all | F.array_contains("include_types", F.col("content_type")))
        if "prefer_sections" in wishes:
            section = F.lower("section")
            preferred = F.filter(
                F.coalesce("prefer_sections", F.array().cast("array<string>")),
                lambda p: F.contains(section, F.lower(p)),
            )
            rows = rows.withColumn("score", F.col("score") + SECTION_BOOST * F.size(preferred))
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "chunk_id")
        rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    rows = _stored(index, rows.select("query_id", "rank", "chunk_id", "score", "matched_by"), "ranked")
    shown = details.select("chunk_id", "source", "section", "parent_section", "content_type", "text")
    return rows.join(shown, "chunk_id").select(
        "query_id", "rank", "chunk_id", "source", "section", "parent_section", "content_type", "text", "score", "matched_by"
    )


def context(results: DataFrame) -> DataFrame:
    """Numbered context text per query from its (few) retrieved chunks."""
    label = F.concat(
        F.lit("source="),
        "source",
        F.when(F.col("section") != "", F.concat(F.lit(", section="), "section")).otherwise(""),
        F.when(F.col("content_type") != "", F.concat(F.lit(", type="), "content_type")).otherwise(""),
    )
    block = F.concat(F.lit("### ["), F.col("rank").cast("string"), F.lit("] "), label, F.lit("\n"), "text", F.lit("\n"))
    entries = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    joined = F.array_join(F.transform(entries, lambda e: e["block"]), "\n")
    return results.groupBy("query_id").agg(
        F.concat(F.lit("## Retrieved SOP Context\n\n"), joined).alias("context"), F.count(F.lit(1)).alias("n_chunks")
    )


def citations(results: DataFrame) -> DataFrame:
    """Sources of each query's chunks in rank order."""
    entry = F.struct("rank", "source", "section", "content_type", "chunk_id")
    fields = ("source", "section", "content_type", "chunk_id")
    return results.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(entry)), lambda e: F.struct(*(e[f].alias(f) for f in fields))
        ).alias("sources")
    )
