"""Index tables, ranked search and contexts over all documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, evaluation, retrieval
from ..operators.index import SearchIndex, build_index, modified, open_index
from ..sources.star import read_table
from .base import nearest, rounded
from .documents import DOCUMENT_CHUNKS, page_chunk_views, pages, recursive, texts

TOP_K = 5


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark passage, whole, as a query."""
    return read_table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return documents.chunks(texts(spark, folder))


_built: dict[tuple, SearchIndex] = {}


def search_index(spark: SparkSession, folder: str, table: str = "documents") -> SearchIndex:
    """The index of a table's chunks: written when first asked for, then shared by the queries of an application.

    A table that was written anew gets a new index.
    """
    path = f"{folder}/{table}.parquet"
    key = (spark.sparkContext.applicationId, path, modified(spark, path))
    if key not in _built:
        rows = pages(spark, folder) if table == "pages" else texts(spark, folder)
        _built[key] = build_index(documents.chunks(rows))
    return _built[key]


def _scored(df: DataFrame) -> DataFrame:
    return rounded(df, 5, "score")


def term_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.vocabulary(retrieval.postings(_chunks(spark, folder)))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(retrieval.corpus_stats(_chunks(spark, folder)), 6, "avg_tokens")


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(retrieval.search(search_index(spark, folder), queries(spark, folder), TOP_K, fallback=False))


def bm25_with_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(retrieval.search(search_index(spark, folder), queries(spark, folder), TOP_K))


def bm25_vocabulary_path(spark: SparkSession, folder: str) -> DataFrame:
    """The same search over an index that is written once and opened by its path."""
    path = build_index(_chunks(spark, folder)).path
    return _scored(retrieval.search(open_index(spark, path), queries(spark, folder), TOP_K))


def substring_search(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.substring_search(search_index(spark, folder), queries(spark, folder), TOP_K)


def retrieve_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a type filter and a bonus for two words in the heading."""
    asked = queries(spark, folder).withColumns(
        {
            "include_types": F.array(F.lit("paragraph"), F.lit("rule")),
            "prefer_sections": F.array(F.lit("The"), F.lit("an")),
        }
    )
    rows = retrieval.retrieve(search_index(spark, folder, "pages"), asked, TOP_K)
    return _scored(rows.select("query_id", "rank", "chunk_id", "section", "score", "matched_by"))


def retrieval_context(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.retrieve(search_index(spark, folder), queries(spark, folder), TOP_K)
    whole = retrieval.context(found).select("query_id", "n_chunks", F.md5("context").alias("context_md5"))
    listed = retrieval.citations(found).select(
        "query_id", F.array_join(F.transform("sources", lambda s: s["chunk_id"]), ",").alias("cited")
    )
    return whole.join(listed, "query_id")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages as questions that expect one of the twenty sources."""
    number = F.col("item_id")
    return read_table(spark, folder, "benchmark").select(
        number.cast("string").alias("id"),
        F.col("text").alias("question"),
        F.concat(F.lit("SRC"), (number % 20).cast("string")).alias("relevant_sop"),
    )


def hits(spark: SparkSession, folder: str) -> DataFrame:
    asked = questions(spark, folder)
    found = retrieval.retrieve(
        search_index(spark, folder), asked.select(F.col("id").alias("query_id"), F.col("question").alias("query")), TOP_K
    )
    return evaluation.source_hits(asked, found)


def retrieval_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    rate = F.round(F.avg(F.col("source_hit").cast("double")) * 100, 1)
    return hits(spark, folder).agg(
        F.count(F.lit(1)).alias("n_questions"), F.count_if("source_hit").alias("n_hits"), rate.alias("hit_rate")
    )


QUERIES = {
    f.__name__: f
    for f in (
        term_vocabulary, corpus_stats, bm25_topk, bm25_with_fallback, bm25_vocabulary_path, substring_search,
        retrieve_pages, retrieval_context, retrieval_hit_rate,
    )
}

# ------------------------------------------------------------------ SQL twins


def _tokens(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{N}}]+')"


def search_views(chunks: str, top_k: int) -> dict[str, str]:
    """Tokens, phrase matches by prefix, BM25 and the two kinds of answer."""
    fields = ("text", "source", "section", "parent_section", "content_type")
    lists = ", ".join(f"{_tokens(f)} AS t{i}" for i, f in enumerate(fields))
    total = " + ".join(f"len(t{i})" for i in range(len(fields)))
    every = " UNION ALL ".join(
        f"SELECT chunk_id, unnest(t{i}) AS term, {1 if i == 0 else 0} AS weight FROM sized" for i in range(len(fields))
    )
    return {
        "sized": f"SELECT *, {total} AS n_tokens FROM (SELECT chunk_id, {lists} FROM {chunks} WHERE trim(text) <> '')",
        "counted": f"""SELECT chunk_id, term, sum(weight) AS tf FROM ({every}) GROUP BY chunk_id, term""",
        "words": f"""
            SELECT query_id, array_to_string({_tokens("word")}, ' ') AS phrase, count(*) AS repeats
            FROM (SELECT item_id AS query_id, unnest(string_split_regex(translate(text, '-"*', ' '), '\\s+')) AS word
                  FROM benchmark) WHERE word <> '' GROUP BY ALL""",
        "asked": """SELECT *, count(*) OVER (PARTITION BY query_id) AS n_phrases, sum(repeats) OVER (PARTITION BY query_id) AS n_words
                    FROM words""",
        "matched": """
            SELECT phrase, term FROM (SELECT DISTINCT term FROM counted) JOIN
                (SELECT DISTINCT phrase FROM words WHERE phrase <> '' AND NOT contains(phrase, ' ')) ON starts_with(term, phrase)""",
        "hits": "SELECT chunk_id, phrase, sum(tf) AS tf FROM counted JOIN matched USING (term) GROUP BY chunk_id, phrase",
        "rare": """SELECT phrase, greatest(ln(((SELECT count(*) FROM sized) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf
                   FROM hits GROUP BY phrase""",
        "scored": """
            SELECT query_id, chunk_id, count(*) = any_value(n_phrases) AS complete, any_value(n_words) AS n_words,
                   sum(repeats * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / mean))) AS score
            FROM hits JOIN asked USING (phrase) JOIN rare USING (phrase) JOIN (SELECT chunk_id, n_tokens FROM sized) USING (chunk_id),
                 (SELECT avg(n_tokens) AS mean FROM sized)
            GROUP BY query_id, chunk_id""",
        "ranked": """
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY complete DESC, round(score, 6) DESC, chunk_id) AS rank,
                   bool_or(complete) OVER (PARTITION BY query_id) AS any_complete
            FROM scored""",
        "answers": f"""SELECT query_id, chunk_id, score, CASE WHEN complete THEN 'all' ELSE 'any' END AS matched_by, rank
                       FROM ranked WHERE rank <= {top_k} AND (complete OR (NOT any_complete AND n_words > 1))""",
    }


_SCORE = f"{nearest('score', 5)} AS score"
_SEARCH = DOCUMENT_CHUNKS | search_views("doc_chunks", TOP_K)
_ANSWERS = f"SELECT query_id, chunk_id, {_SCORE}, matched_by, CAST(rank AS INTEGER) AS rank FROM answers"
_FOUND = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS place FROM answers JOIN doc_chunks USING (chunk_id)"
_HITS = f"""
    SELECT item_id, coalesce(bool_or(contains(lower(source), 'src' || item_id % 20)), false) AS hit
    FROM benchmark LEFT JOIN (SELECT * FROM found WHERE place <= {TOP_K}) ON query_id = item_id GROUP BY item_id"""

ORACLES = {
    "term_vocabulary": recursive(
        "SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM (SELECT chunk_id, term, count(*) AS n FROM every GROUP BY ALL) GROUP BY term",
        **DOCUMENT_CHUNKS,
        every=" UNION ALL ".join(
            f"SELECT chunk_id, unnest({_tokens(f)}) AS term FROM doc_chunks WHERE trim(text) <> ''"
            for f in ("text", "source", "section", "parent_section", "content_type")
        ),
    ),
    "corpus_stats": recursive(
        f"SELECT count(*) AS n_chunks, {nearest('avg(n_tokens)', 6)} AS avg_tokens FROM sized", **_SEARCH
    ),
    "bm25_topk": recursive(f"{_ANSWERS} WHERE matched_by = 'all'", **_SEARCH),
    "bm25_with_fallback": recursive(_ANSWERS, **_SEARCH),
    "bm25_vocabulary_path": recursive(_ANSWERS, **_SEARCH),
    "substring_search": recursive(
        f"""SELECT query_id, chunk_id, 999.0::DOUBLE AS score, 'substring' AS matched_by, CAST(place AS INTEGER) AS rank
            FROM (SELECT item_id AS query_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY chunk_id) AS place
                  FROM benchmark b JOIN doc_chunks c ON contains(lower(c.text), lower(b.text))) WHERE place <= {TOP_K}""",
        **DOCUMENT_CHUNKS,
    ),
    "retrieve_pages": recursive(
        f"""SELECT query_id, CAST(place AS INTEGER) AS rank, chunk_id, section, {_SCORE}, matched_by FROM (
                SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS place
                FROM (SELECT query_id, chunk_id, section, matched_by, a.score + 0.5 * (CAST(contains(lower(section), 'the') AS INTEGER)
                             + CAST(contains(lower(section), 'an') AS INTEGER)) AS score
                      FROM answers a JOIN page_chunks USING (chunk_id) WHERE content_type IN ('paragraph', 'rule')))
            WHERE place <= {TOP_K}""",
        **page_chunk_views(2000), **search_views("page_chunks", 3 * TOP_K),
    ),
    "retrieval_context": recursive(
        f"""SELECT query_id, count(*) AS n_chunks, string_agg(chunk_id, ',' ORDER BY place) AS cited,
                   md5('## Retrieved SOP Context' || chr(10) || chr(10) || string_agg(format('### [{{}}] source={{}}{{}}, type={{}}', place, source,
                       CASE WHEN section <> '' THEN ', section=' || section ELSE '' END, content_type)
                       || chr(10) || text || chr(10), chr(10) ORDER BY place)) AS context_md5
            FROM found WHERE place <= {TOP_K} GROUP BY query_id""",
        **DOCUMENT_CHUNKS, **search_views("doc_chunks", 3 * TOP_K), found=_FOUND,
    ),
    "retrieval_hit_rate": recursive(
        """SELECT count(*) AS n_questions, count(*) FILTER (hit) AS n_hits, round(avg(CAST(hit AS INTEGER)) * 100, 1) AS hit_rate
           FROM verdicts""",
        **DOCUMENT_CHUNKS, **search_views("doc_chunks", 3 * TOP_K), found=_FOUND, verdicts=_HITS,
    ),
}
