"""Documents to elements to chunks, inside each document's row.

A document is one row and everything derived from it is an array on that row
until the final explode. Preparing a corpus is therefore a narrow job: a scan,
projections and a generator, with no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let

MIN_CHUNK_CHARS = 50
MAX_CHUNK_CHARS = 2000
HEAD_CHARS = 200
LEVELS = 6

# Content types that are never split.
ATOMIC_TYPES = ("checklist", "table", "template", "code")

# Content type and the pattern that selects it, first match wins.
TYPE_PATTERNS = (
    ("checklist", r"checklist|检查清单|核查项"),
    ("threshold", r"p\d|p0|p1|p2|p3|阈值|threshold|紧急|重要"),
    ("example", r"案例|example|示例"),
    ("procedure", r"流程|步骤|step|procedure|工作流"),
    ("template", r"模板|template|回复|通知"),
    ("rule", r"规则|rule|条件|禁止|必须"),
)

# White space inside a line, and the characters that end one besides "\n".
BLANKS = (
    " \t\x1f\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)
LINE_ENDS = ("\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
SPACE = f"[{BLANKS}]"
HEADING = rf"#{{1,6}}{SPACE}+[^\n]"

# Page markup: parts without text, tags that end a line, and entities that
# change the words. Other tags vanish.
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!--.*?-->"
HEADING_TAG = r"(?i)<h([1-6])\b[^>]*>"
BLOCK_TAG = r"(?i)</?(?:p|li|ul|ol|div|table|tr|td|th|section|article|nav|br|h[1-6])\b[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS + "\n"))


def plain_line_ends(text: Column) -> Column:
    # literal replacement costs a tenth of one regular expression here, and most texts have nothing to replace
    plain = text
    for end in LINE_ENDS:
        plain = F.replace(plain, F.lit(end), F.lit("\n"))
    return F.when(F.rlike(text, F.lit(f"[{''.join(LINE_ENDS[1:])}]")), plain).otherwise(text)


def html_to_markdown(html: Column) -> Column:
    """Heading and paragraph lines of a page; scripts, styles and comments go."""
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(text, r"[\r\n]+", " ")
    text = F.regexp_replace(text, HEADING_TAG, "\n\n\x01$1 ")
    text = F.regexp_replace(text, BLOCK_TAG, "\n\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for level in range(1, 7):
        text = F.replace(text, F.lit(f"\x01{level}"), F.lit("#" * level))
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def content_type(section: Column, text: Column, head_chars: int | None = HEAD_CHARS) -> Column:
    """Type by keywords in the section path and the first ``head_chars`` characters (None: the whole text)."""

    def classify(head: Column) -> Column:
        kind = F.lit("paragraph")
        for name, pattern in reversed(TYPE_PATTERNS):
            kind = F.when(head.rlike(pattern), name).otherwise(kind)
        return kind

    return let(F.lower(F.concat(section, F.lit(" "), text if head_chars is None else F.substring(text, 1, head_chars))), classify)


def element_id(source: Column, section: Column, text: Column) -> Column:
    """Twelve hex digits that stay the same while place and text do."""
    return F.substring(F.sha1(F.concat_ws("|", source, section, text)), 1, 12)


def _paths(heads: Column, hierarchical: bool) -> Column:
    """Section path at each (level, title) entry, by a fold over them.

    A first-level heading starts a new path. Deeper ones extend it; with
    ``hierarchical`` they first leave the headings of the same depth or deeper. The fold
    carries joined paths: the one now open or, nested, one for each of the LEVELS levels,
    so a heading costs one concatenation however many came before.
    """
    slots = LEVELS if hierarchical else 1
    start = F.struct(
        F.array_repeat(F.lit(None).cast("string"), slots).alias("open"), F.array().cast("array<string>").alias("paths")
    )

    def below(path: Column, title: Column) -> Column:
        # empty titles before the first other one leave no mark
        return F.when(F.coalesce(path, F.lit("")) == "", title).otherwise(F.concat(path, F.lit(" > "), title))

    def enter(state: Column, head: Column) -> Column:
        level, slot = head["level"], (head["level"] if hierarchical else F.lit(1))
        open_ = state["open"]
        shallower = F.slice(open_, 1, F.greatest(level - 1, F.lit(0))) if hierarchical else open_
        above = F.try_element_at(F.array_compact(shallower), F.lit(-1))
        now = below(F.when(level > 1, above), head["title"])

        def placed(path: Column) -> Column:
            paths = F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda i: F.when(i < slot, F.get(open_, i - 1)).when(i == slot, path))
            opened = F.when(level > 0, paths).otherwise(open_)
            # only text before the first heading has no level
            shown = F.when(level > 0, path).otherwise("")
            return F.struct(opened.alias("open"), F.array_append(state["paths"], shown).alias("paths"))

        return let(now, placed)

    return F.aggregate(heads, start, enter, lambda state: state["paths"])


def _blocks(body: Column) -> Column:
    """Paragraphs of a section body: stripped lines between blank lines."""
    lines = F.transform(F.split(body, "\n"), lambda line: F.trim(line, F.lit(BLANKS)))
    parts = F.split(F.trim(F.array_join(lines, "\n"), F.lit("\n")), r"\n\n+")
    return F.filter(parts, lambda part: part != "")


def _head(section: Column) -> Column:
    """Depth (0 for none) and title of the heading a section starts with."""
    level = F.when(section.rlike(f"^{HEADING}"), F.length(F.regexp_extract(section, r"^(#+)", 1))).otherwise(0)
    title = strip(F.regexp_extract(section, rf"^#{{1,6}}{SPACE}+([^\n]+)", 1))
    return F.struct(level.alias("level"), title.alias("title"))


def _markdown_elements(text: Column, hierarchical: bool) -> Column:
    """Array of (text, section) of a Markdown text."""

    def of_section(z: Column) -> Column:
        headed = z["head"]["level"] > 0
        body = F.when(headed, F.regexp_replace(z["text"], r"^[^\n]*\n?", "")).otherwise(z["text"])
        return F.transform(_blocks(body), lambda b: F.struct(b.alias("text"), z["path"].alias("section")))

    def assemble(sections: Column) -> Column:
        return let(
            F.transform(sections, _head),
            lambda heads: F.flatten(
                F.transform(
                    F.arrays_zip(
                        sections.alias("text"), heads.alias("head"), _paths(heads, hierarchical).alias("path")
                    ),
                    of_section,
                )
            ),
        )

    # each heading line opens a section; text before the first has none
    return let(F.split(plain_line_ends(text), rf"(?md)^(?={HEADING})"), assemble)


def _kind(docs: DataFrame) -> Column:
    if "format" not in docs.columns:
        return F.lit("markdown")
    return F.coalesce("format", F.lit("markdown"))


def element_array(docs: DataFrame, hierarchical: bool = False) -> Column:
    """Array of (text, section) in document order.

    ``docs`` has source, text and optionally format (markdown, html, text).
    """
    text, kind = F.col("text"), _kind(docs)
    whole = F.struct(strip(text).alias("text"), F.lit("").alias("section"))
    single = F.filter(F.array(whole), lambda e: e["text"] != "")
    markdown = F.when(kind == "html", html_to_markdown(text)).otherwise(text)
    return F.when(kind == "text", single).otherwise(_markdown_elements(markdown, hierarchical))


def elements(
    docs: DataFrame, hierarchical: bool = False, classify_pages: bool = False, head_chars: int | None = HEAD_CHARS
) -> DataFrame:
    """One row per element: text, source, section, page, content_type, element_id.

    Markdown elements are classified; plain text and, unless ``classify_pages``
    is set, page elements are paragraphs.
    """
    kind = _kind(docs)
    classified = (kind == "markdown") | ((kind == "html") & F.lit(classify_pages))
    keep = [c for c in docs.columns if c not in ("text", "format")]
    # the array goes straight into the generator: as a column of its own it
    # would also be computed for an inferred size filter
    rows = docs.select(
        *keep, classified.alias("_classified"), F.posexplode(element_array(docs, hierarchical)).alias("page", "_e")
    )
    text, section = F.col("_e.text"), F.col("_e.section")
    return rows.select(
        *keep,
        text.alias("text"),
        section.alias("section"),
        "page",
        F.when(F.col("_classified"), content_type(section, text, head_chars)).otherwise("paragraph").alias("content_type"),
        element_id(F.col("source"), section, text).alias("element_id"),
    )


def _chunk_starts(sized: Column, max_chars: int) -> Column:
    """Positions of the elements that begin a chunk.

    ``sized`` holds (section, size, atomic). The fold carries the running length
    and the positions only, never text.
    """
    start = F.struct(
        F.lit("").alias("section"), F.lit(-1).alias("size"), F.lit(0).alias("at"),
        F.array().cast("array<int>").alias("starts"),
    )

    def take(state: Column, element: Column) -> Column:
        changed = (element["section"] != "") & (element["section"] != state["section"])
        begins = changed | (state["size"] < 0)
        size = F.when(begins, element["size"]).otherwise(state["size"] + 2 + element["size"])
        full = (size >= max_chars) & ~element["atomic"]
        return F.struct(
            F.when(changed, element["section"]).otherwise(state["section"]).alias("section"),
            F.when(full, -1).otherwise(size).alias("size"),
            (state["at"] + 1).alias("at"),
            F.when(begins, F.array_append(state["starts"], state["at"])).otherwise(state["starts"]).alias("starts"),
        )

    return F.aggregate(sized, start, take, lambda state: state["starts"])


def _runs(starts: Column, items: Column) -> Column:
    """Slices of an array from each start to the next."""
    return F.transform(
        starts,
        lambda s, i: F.slice(items, s + 1, F.coalesce(F.get(starts, i + 1), F.size(items)) - s),
    )


def _joined(run: Column) -> Column:
    return F.array_join(F.transform(run, lambda e: e["text"]), "\n\n")


def _sized(element: Column) -> Column:
    return F.struct(
        element["section"].alias("section"),
        F.length(element["text"]).alias("size"),
        element["kind"].isin(*ATOMIC_TYPES).alias("atomic"),
    )


def _chunk(run: Column, position: Column) -> Column:
    first = F.get(run, F.lit(0))
    return F.struct(
        _joined(run).alias("text"),
        first["section"].alias("section"),
        first["kind"].alias("kind"),
        (position + 1).alias("number"),
    )


def chunks(
    docs: DataFrame,
    min_chars: int = MIN_CHUNK_CHARS,
    max_chars: int = MAX_CHUNK_CHARS,
    hierarchical: bool = False,
) -> DataFrame:
    """Search segments: text, source, section, parent_section, content_type, chunk_id.

    A chunk ends where the section changes or once it has ``max_chars``
    characters, unless its last element is of an atomic type. Chunks below
    ``min_chars`` join the one before. Numbering and joining stay inside a
    document.
    """
    keep = [c for c in docs.columns if c not in ("text", "format", "source")]
    markdown = _kind(docs) == "markdown"

    def typed(e: Column) -> Column:
        kind = F.when(markdown, content_type(e["section"], e["text"])).otherwise("paragraph")
        return F.struct(e["text"].alias("text"), e["section"].alias("section"), kind.alias("kind"))

    def cut(elements_: Column) -> Column:
        starts = _chunk_starts(F.transform(elements_, _sized), max_chars)
        return F.transform(let(starts, lambda s: _runs(s, elements_)), _chunk)

    def merge(pieces: Column) -> Column:
        # a chunk stands alone when it is the first or long enough
        alone = F.transform(pieces, lambda c, i: F.when((i == 0) | (F.length(c["text"]) >= min_chars), i))
        return let(F.array_compact(alone), lambda heads: _runs(heads, pieces))

    groups = let(let(F.transform(element_array(docs, hierarchical), typed), cut), merge)
    rows = docs.select("source", *keep, F.explode(groups).alias("_group"))
    head = F.get("_group", F.lit(0))
    named = F.filter(F.transform("_group", lambda c: c["section"]), lambda s: s != "")
    parts = F.split(head["section"], " > ", -1)
    return rows.select(
        *keep,
        _joined(F.col("_group")).alias("text"),
        "source",
        F.coalesce(F.get(named, F.lit(0)), F.lit("")).alias("section"),
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), " > ").alias("parent_section"),
        head["kind"].alias("content_type"),
        F.concat(F.col("source"), F.lit("_"), _four_digits(head["number"])).alias("chunk_id"),
    )


def _four_digits(number: Column) -> Column:
    text = number.cast("string")
    return F.when(number < 10000, F.lpad(text, 4, "0")).otherwise(text)


def chunk_stats(chunks_: DataFrame) -> DataFrame:
    """Chunk counts in total, by source and by content type."""
    pairs = chunks_.groupBy("source", "content_type").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
        F.struct(F.lit("source").alias("dimension"), F.col("source").alias("value")),
        F.struct(F.lit("content_type").alias("dimension"), F.col("content_type").alias("value")),
    )
    return (
        pairs.select(F.inline(entries), "n").groupBy("dimension", "value").agg(F.sum("n").alias("n_chunks"))
    )
