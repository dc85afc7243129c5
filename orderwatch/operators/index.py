"""A written index of chunks: sorted dictionary, prefix ranges, positions, character grams.

The texts are tokenised when the index is built; a search reads the tables only.

- ``chunks``: the chunks that have text, each with a number; ``lengths``: their tokens;
  ``totals``: both summed up.
- ``terms``: every term with its rank in sorted order (``term_no``), so all terms with a
  common beginning have neighbouring numbers, and its number of places.
- ``prefixes``: the range of term numbers of each beginning of up to PREFIX_CHARS characters.
- ``postings``: a row for each place of each term, bucketed by chunk. A bucket holds the chunks of about
  BUCKET_BYTES of text and is read by one task, so sums over a chunk need neither a shuffle nor more memory with
  more chunks, and writing it needs no term number. A search reads all places, without the texts.
- ``grams``: the terms that hold each string of up to GRAM characters, with their number.

For literal search the runs between words count as terms too, once a chunk, in the field MARKS.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, without_accents
from ..session import new_path, remove, stored

INDEXED = ("text", "source", "section", "parent_section", "content_type")
NOT_WORD, WORD = r"[^\p{L}\p{N}]+", r"[\p{L}\p{N}]+"
PREFIX_CHARS, GRAM = 32, 3
MARKS = 127
# Row groups of the chunk table: a scan of the texts can be split at them.
CHUNK_GROUP_BYTES = 8 << 20
# Text of the chunks in one bucket of the postings.
BUCKET_BYTES = 8 << 20


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without accents."""
    return _runs(folded(F.lower(text)))


def folded(text: Column) -> Column:
    # replacing character by character is slow, and most texts have nothing to replace
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), without_accents(text)).otherwise(text)


def _runs(text: Column) -> Column:
    return F.array_remove(F.split(text, NOT_WORD), "")


@dataclass(frozen=True)
class SearchIndex:
    """An index below ``path``; every table is read when it is asked for."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def size(self) -> tuple[int, float | None]:
        """Number of chunks and their mean length in tokens."""
        row = self.table("totals").first()
        return row.n_chunks, row.n_tokens / row.n_chunks if row.n_chunks else None

    def places(self) -> DataFrame:
        """All postings: term, chunk_no, field, pos."""
        name = _table_name(self.path)
        if not self.spark.catalog.tableExists(name):
            n = self.table("totals").first().n_buckets
            self.spark.sql(
                f"CREATE TABLE {name} (term STRING, chunk_no BIGINT, field TINYINT, pos INT) USING parquet "
                f"CLUSTERED BY (chunk_no) INTO {n} BUCKETS LOCATION '{self.path}/postings'"
            )
        return self.spark.table(name)


def _table_name(path: str) -> str:
    return f"postings_{hashlib.md5(path.encode()).hexdigest()}"


def modified(spark: SparkSession, path: str) -> tuple[int, int]:
    """Time of the last change and length of a file or folder, wherever it lives."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target)
    return status.getModificationTime(), status.getLen()


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    fields = spark.read.parquet(f"{path}/fields").orderBy("field").collect()
    return SearchIndex(spark, path, tuple(r.name for r in fields))


def build_index(chunks: DataFrame, path: str | None = None, columns: Sequence[str] = INDEXED, literal: bool = True) -> SearchIndex:
    """Write the index of ``chunks`` to ``path`` (one in the shared folder by default).

    Chunks without text are left out. Without ``literal`` the index serves ranked search only;
    with it ``text`` must be one of the columns.
    """
    if literal and "text" not in columns:
        raise ValueError("literal search needs the column text")
    spark = chunks.sparkSession
    path = path or new_path(spark, "index")
    spark.createDataFrame(list(enumerate(columns)), "field int, name string").coalesce(1).write.parquet(f"{path}/fields")
    kept = list(dict.fromkeys(["chunk_id", *columns, "text"]))
    rows = chunks.filter(~is_blank(F.col("text"))).select(F.monotonically_increasing_id().alias("chunk_no"), *kept)
    rows.write.option("parquet.block.size", CHUNK_GROUP_BYTES).parquet(f"{path}/chunks")
    plain = spark.read.parquet(f"{path}/chunks")
    lists = [(i, tokens(F.coalesce(c, F.lit("")))) for i, c in enumerate(columns)]
    if literal:
        lists.append((MARKS, F.array_distinct(F.array_remove(F.split(F.lower("text"), WORD), ""))))
    found = F.array(*[F.struct(F.lit(i).cast("byte").alias("field"), t.alias("found")) for i, t in lists])

    def places(rows: DataFrame) -> DataFrame:
        return rows.select("chunk_no", F.inline(found)).select("chunk_no", "field", F.posexplode("found").alias("pos", "term"))

    n_chunks, n_bytes = plain.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n_buckets = 1 + (n_bytes or 0) // BUCKET_BYTES
    # a task of the write holds one bucket
    dealt = places(plain.repartition(n_buckets, "chunk_no")).select("term", "chunk_no", "field", "pos")
    bucketed = dealt.write.format("parquet").bucketBy(n_buckets, "chunk_no")
    bucketed.option("path", f"{path}/postings").saveAsTable(_table_name(path))
    index = SearchIndex(spark, path, tuple(columns))
    sizes = index.places().filter(F.col("field") != MARKS).groupBy("chunk_no").agg(F.count(F.lit(1)).alias("n_tokens"))
    sizes = stored(sizes, f"{path}/lengths")
    n_tokens = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    totals = spark.createDataFrame([(n_chunks, n_tokens, n_buckets)], "n_chunks long, n_tokens long, n_buckets long")
    totals.coalesce(1).write.parquet(f"{path}/totals")

    terms = stored(_numbered(places(plain), path), f"{path}/terms")
    word = F.rlike("term", F.lit(r"^[\p{L}\p{N}]"))
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(PREFIX_CHARS))), lambda n: F.substring("term", F.lit(1), n))
    ranges = terms.filter(word).select("term_no", F.explode(starts).alias("prefix")).groupBy("prefix")
    ranges.agg(F.min("term_no").alias("low"), F.max("term_no").alias("high")).write.parquet(f"{path}/prefixes")
    if literal:
        grams = terms.select("term_no", F.explode(grams_of(F.col("term"))).alias("gram"))
        grams = stored(grams, f"{path}/grams")
        grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n_terms")).write.parquet(f"{path}/gram_counts")
    remove(spark, f"{path}/ranged")
    return index


def grams_of(text: Column, sizes: Sequence[int] = range(1, GRAM + 1)) -> Column:
    """Distinct substrings of the given lengths."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*map(of, sizes))))


def _numbered(occurrences: DataFrame, path: str) -> DataFrame:
    """(term, term_no, n_places): ranks of the distinct terms in sorted order, without gaps.

    Terms are sorted in ranges; rows of a range count from what the ranges before hold.
    Only the sizes of the ranges meet in one task.
    """
    counted = occurrences.groupBy("term").agg(F.count(F.lit(1)).alias("n_places"))
    ranged = counted.repartitionByRange("term").sortWithinPartitions("term").withColumn("at", F.monotonically_increasing_id())
    ranged = stored(ranged, f"{path}/ranged")
    part = F.shiftright("at", 33).alias("part")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    local = F.col("at").bitwiseAND((1 << 33) - 1)
    return ranged.withColumn("part", part).join(F.broadcast(offsets), "part").select("term", (F.col("offset") + local).alias("term_no"), "n_places")
