"""Elements and chunks of the documents and the web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents
from ..sources.star import read_table
from .base import query_sql


def texts(spark: SparkSession, folder: str) -> DataFrame:
    source = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return read_table(spark, folder, "documents").select(source.alias("source"), "text")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    source = F.concat(F.lit("page/"), F.col("page_id").cast("string"))
    return read_table(spark, folder, "pages").select(
        source.alias("source"), F.col("html").alias("text"), F.lit("html").alias("format")
    )


def shown(df: DataFrame) -> DataFrame:
    return df.withColumns({"n_chars": F.length("text"), "text_md5": F.md5("text")}).drop("text")


def doc_elements(spark: SparkSession, folder: str) -> DataFrame:
    return shown(documents.elements(texts(spark, folder)))


def page_elements(spark: SparkSession, folder: str) -> DataFrame:
    return shown(documents.elements(pages(spark, folder), classify_pages=True))


def page_elements_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Elements under the headings that are open at their place."""
    return shown(documents.elements(pages(spark, folder), hierarchical=True, classify_pages=True))


def doc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return shown(documents.chunks(texts(spark, folder)))


def page_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return shown(documents.chunks(pages(spark, folder), max_chars=400))


def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    both = documents.chunks(texts(spark, folder)).unionByName(documents.chunks(pages(spark, folder)))
    return documents.chunk_stats(both)


QUERIES = {f.__name__: f for f in (doc_elements, page_elements, page_elements_nested, doc_chunks, page_chunks, chunk_stats)}

# ------------------------------------------------------------------ SQL twins

_BLANKS = "' ' || chr(9) || chr(31) || chr(160) || chr(5760) || chr(8239) || chr(8287) || chr(12288) || " + " || ".join(
    f"chr({n})" for n in range(0x2000, 0x200B)
)
_KIND = """CASE WHEN regexp_matches(head, 'checklist|检查清单|核查项') THEN 'checklist'
                WHEN regexp_matches(head, 'p[0-9]|阈值|threshold|紧急|重要') THEN 'threshold'
                WHEN regexp_matches(head, '案例|example|示例') THEN 'example'
                WHEN regexp_matches(head, '流程|步骤|step|procedure|工作流') THEN 'procedure'
                WHEN regexp_matches(head, '模板|template|回复|通知') THEN 'template'
                WHEN regexp_matches(head, '规则|rule|条件|禁止|必须') THEN 'rule' ELSE 'paragraph' END"""
_DOCUMENT_TEXT = "SELECT source || '/' || doc_id AS source, text FROM documents"


def _page_text() -> str:
    text = "html"
    steps = (
        (r"(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!--.*?-->", "' '"),
        (r"[\r\n]+", "' '"),
        (r"(?i)<h([1-6])\b[^>]*>", r"chr(10) || chr(10) || chr(1) || '\1 '"),
        (
            r"(?i)</?(?:p|li|ul|ol|div|table|tr|td|th|section|article|nav|br|h[1-6])\b[^>]*>",
            "chr(10) || chr(10)",
        ),
        (r"<[^>]*>", "''"),
    )
    for pattern, replacement in steps:
        text = f"regexp_replace({text}, '{pattern}', {replacement}, 'g')"
    for level in range(1, 7):
        text = f"replace({text}, chr(1) || '{level}', '{'#' * level}')"
    for entity, plain in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        text = f"replace({text}, '&{entity};', '{plain}')"
    return f"SELECT 'page/' || page_id AS source, {text} AS text FROM pages"


def _nested_paths(lines: str) -> str:
    """The last heading of each level is open if no shallower one came after it."""
    seen = "OVER (PARTITION BY source ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    places = ", ".join(
        f"coalesce(max(CASE WHEN level = {k} THEN pos END) {seen}, -1) AS p{k}, last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) {seen} AS t{k}"
        for k in range(1, 7)
    )
    titles = ", ".join(f"CASE WHEN p{k} > greatest(-1, {', '.join(['-1'] + [f'p{j}' for j in range(1, k)])}) THEN t{k} END" for k in range(1, 7))
    return f"SELECT *, concat_ws(' > ', {titles}) AS section FROM (SELECT *, {places} FROM {lines})"


def element_views(source: str, prefix: str, classify: bool, nested: bool = False) -> dict[str, str]:
    """Lines, islands between breaks, and running section paths."""
    kind = _KIND if classify else "'paragraph'"
    return {
        f"{prefix}_raw": source,
        f"{prefix}_lines": f"""
            SELECT source, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line
            FROM (SELECT source, string_split(regexp_replace(text,
                      '\\r\\n|[\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10)) AS lines
                  FROM {prefix}_raw)""",
        f"{prefix}_marked": f"""
            SELECT *, regexp_matches(line, '^#{{1,6}}[ \\t]+.') AS headed, trim(line, {_BLANKS}) AS plain,
                   CASE WHEN headed THEN length(regexp_extract(line, '^(#+)', 1)) ELSE 0 END AS level,
                   trim(regexp_extract(line, '^#{{1,6}}[ \\t]+(.+)', 1), {_BLANKS}) AS title
            FROM {prefix}_lines""",
        f"{prefix}_placed": f"""
            SELECT *, sum(CASE WHEN headed OR plain = '' THEN 1 ELSE 0 END) OVER o AS island,
                   sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER o AS epoch
            FROM {prefix}_marked WINDOW o AS (PARTITION BY source ORDER BY pos)""",
        f"{prefix}_paths": _nested_paths(f"{prefix}_placed") if nested else f"""
            SELECT *, coalesce(string_agg(title, ' > ') FILTER (headed) OVER
                                   (PARTITION BY source, epoch ORDER BY pos), '') AS section
            FROM {prefix}_placed""",
        f"{prefix}_elements": f"""
            SELECT source, section, text, row_number() OVER (PARTITION BY source ORDER BY pos) - 1 AS page,
                   lower(section || ' ' || substr(text, 1, 200)) AS head, {kind} AS content_type
            FROM (SELECT source, island, section, min(pos) AS pos, string_agg(plain, chr(10) ORDER BY pos) AS text
                  FROM {prefix}_paths WHERE NOT headed AND plain <> '' GROUP BY ALL)""",
    }


def chunk_views(prefix: str, max_chars: int) -> dict[str, str]:
    """Element by element: does it start a chunk, and how long is the chunk."""
    atomic = "('checklist', 'table', 'template', 'code')"
    return {
        f"{prefix}_walk": f"""
            SELECT source, page, section AS current, 1 AS piece, length(text) AS size,
                   length(text) >= {max_chars} AND content_type NOT IN {atomic} AS closed
            FROM {prefix}_elements WHERE page = 0
            UNION ALL
            SELECT e.source, e.page, CASE WHEN e.section <> '' THEN e.section ELSE w.current END,
                   w.piece + CASE WHEN w.closed OR (e.section <> '' AND e.section <> w.current) THEN 1 ELSE 0 END,
                   CASE WHEN w.closed OR (e.section <> '' AND e.section <> w.current) THEN length(e.text)
                        ELSE w.size + 2 + length(e.text) END AS size_now,
                   size_now >= {max_chars} AND e.content_type NOT IN {atomic}
            FROM {prefix}_walk w JOIN {prefix}_elements e ON e.source = w.source AND e.page = w.page + 1""",
        f"{prefix}_pieces": f"""
            SELECT source, piece, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text,
                   arg_min(section, page) AS section, arg_min(content_type, page) AS content_type
            FROM {prefix}_walk JOIN {prefix}_elements USING (source, page) GROUP BY source, piece""",
        f"{prefix}_groups": f"""
            SELECT *, sum(CASE WHEN piece = 1 OR length(text) >= 50 THEN 1 ELSE 0 END)
                          OVER (PARTITION BY source ORDER BY piece) AS grp
            FROM {prefix}_pieces""",
        f"{prefix}_chunks": f"""
            SELECT source, string_agg(text, chr(10) || chr(10) ORDER BY piece) AS text,
                   coalesce(arg_min(section, piece) FILTER (section <> ''), '') AS section,
                   CASE WHEN contains(arg_min(section, piece), ' > ')
                        THEN regexp_replace(arg_min(section, piece), '^(.*) > .*$', '\\1') ELSE '' END AS parent_section,
                   arg_min(content_type, piece) AS content_type,
                   source || '_' || format('{{:04d}}', min(piece)) AS chunk_id
            FROM {prefix}_groups GROUP BY source, grp""",
    }


def recursive(body: str, **views: str) -> str:
    """Like ``query_sql`` for views of which one refers to itself."""
    return query_sql(body, **views).replace("WITH ", "WITH RECURSIVE ", 1)


DOCUMENT_CHUNKS = element_views(_DOCUMENT_TEXT, "doc", True) | chunk_views("doc", 2000)
_ID = "substr(sha1(concat_ws('|', source, section, text)), 1, 12) AS element_id"
_CHUNK = "source, section, parent_section, content_type, chunk_id, length(text) AS n_chars, md5(text) AS text_md5"


def _elements_sql(source: str, nested: bool = False) -> str:
    return query_sql(
        f"""SELECT source, section, CAST(page AS INTEGER) AS page, content_type, {_ID}, length(text) AS n_chars,
                   md5(text) AS text_md5 FROM el_elements""",
        **element_views(source, "el", True, nested),
    )


def page_chunk_views(max_chars: int) -> dict[str, str]:
    return element_views(_page_text(), "page", False) | chunk_views("page", max_chars)


ORACLES = {
    "doc_elements": _elements_sql(_DOCUMENT_TEXT),
    "page_elements": _elements_sql(_page_text()),
    "page_elements_nested": _elements_sql(_page_text(), nested=True),
    "doc_chunks": recursive(f"SELECT {_CHUNK} FROM doc_chunks", **DOCUMENT_CHUNKS),
    "page_chunks": recursive(f"SELECT {_CHUNK} FROM page_chunks", **page_chunk_views(400)),
    "chunk_stats": recursive(
        """SELECT CASE WHEN source IS NOT NULL THEN 'source' WHEN content_type IS NOT NULL THEN 'content_type'
                       ELSE 'total' END AS dimension, coalesce(source, content_type, 'all') AS value, count(*) AS n_chunks
           FROM (SELECT source, content_type FROM doc_chunks UNION ALL SELECT source, content_type FROM page_chunks)
           GROUP BY GROUPING SETS ((source), (content_type), ())""",
        **DOCUMENT_CHUNKS, **page_chunk_views(2000),
    ),
}
