"""Near-duplicate groups from bottom-k sketches made with one hash function.

The sketch of a set holds its k smallest hash values. Inverted lists of the retained values
bring sets together: values are ordered from rare to frequent, and a set stands only in
the lists of its first ones, so many that two linked sets still share one of them.
The k smallest values of two sketches together are a uniform sample of the sets' union, and the
share of them that both hold estimates the Jaccard similarity. A pair goes on only
if that share is possible for linked sets; then the whole sets are compared, exactly.

Sets of at most percent * k / 100 shingles are sampled whole, so nothing about them is a guess. Of
larger linked sets a sketch pair falls below the bound with a chance of at most MISS, whatever
the texts are. Nothing else can lose a link.

Equal sets are collapsed first. Members of a list are first compared with a few hubs; members
of one component need no further comparison. At last all pairs in a list whose components
still differ are compared: only those whose sizes and odd cells allow a link leave the join,
each from the first list that both stand in.

Defined results: NULL, empty and blank texts have an empty set and link with nothing; rows
that share a doc_id count as one document and are linked; a NULL doc_id has a NULL
component and is not kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import ODD_NAMES, answers, cells_fit, close, exact_links, odd_cells, odd_columns, ordered, set_key, shared_ids, sizes_fit
from .shared import rows_of, shingle_set, stored, text_batches, whole_text, word_hashes

WORDS, PERCENT, RETAINED = 5, 85, 96
MISS = 1e-9
# The hub of a list is its member nearest to such a number.
HUB_SEEDS = (0, 0x3A5C69D2E1B7, 0x6F0D4B8823C1, 0x15E2A79CD034)
HUB_ROUNDS = 3
SEEN_KEYS = 1 << 17


def least_shared(k: int, percent: int, miss: float = MISS) -> int:
    """The largest s such that fewer than s of k sampled values are common with a chance of ``miss`` at most."""
    p, below = percent / 100, 0.0
    for s in range(k + 1):
        below += comb(k, s) * p**s * (1 - p) ** (k - s)
        if below > miss:
            return s
    return k


def needed_overlap(n: Column, k: int, percent: int) -> Column:
    """Retained values that a set of ``n`` shares at least with the sketch of any set it links with."""
    return F.when(100 * n <= percent * k, F.ceil(n * percent / 100)).otherwise(least_shared(k, percent)).cast("int")


def union_fits(a: str, b: str, n_a: str, n_b: str, k: int, percent: int) -> Column:
    """Whether the union sketch of two sketches allows a link; for small sets whether they are linked."""
    union = F.array_sort(F.array_union(a, b))
    sample = F.slice(union, 1, k)
    common = F.size(F.array_intersect(F.array_intersect(a, b), sample))
    whole = (F.greatest(n_a, n_b) <= k) & (F.size(union) <= k)
    return F.when(whole, 100 * common >= percent * F.size(union)).otherwise(common >= least_shared(k, percent))


def sketches(docs: DataFrame, words: int = WORDS, retained: int = RETAINED) -> DataFrame:
    """(doc_id, n, key, retained, odd cells) of each row; a task gives a sketch once for copies.

    Values are kept as signed numbers of the same order.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            sizes, keys, values, odd, new = [], [], [], [], []
            for doc_id, text in zip(rows_of(batch, "doc_id"), rows_of(batch, "text")):
                tokens = shingle_set(word_hashes(text), words)
                key = set_key(tokens)
                new.append(key is not None and doc_id is not None and key not in seen)
                if new[-1]:
                    if len(seen) >= SEEN_KEYS:
                        seen.clear()
                    seen.add(key)
                sizes.append(len(tokens))
                keys.append(key)
                values.append((tokens[:retained] ^ np.uint64(1 << 63)).view(np.int64) if new[-1] else None)
                odd.append(odd_cells(tokens if new[-1] else tokens[:0]))
            cells = [pa.array(c.to_numpy(), mask=~np.array(new, bool)) for c in odd_columns(odd)]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *cells], ["doc_id", "n", "key", "retained", *ODD_NAMES])

    shape = "doc_id long, n long, key binary, retained array<long>, " + ", ".join(f"{c} long" for c in ODD_NAMES)
    return docs.select("doc_id", whole_text()).mapInArrow(sketch, shape)


def inverted_lists(classes: DataFrame, retained: int, percent: int) -> DataFrame:
    """(node, n, values) of each set that may link at all: the values in whose lists it stands, rare ones first.

    Values of one set only cannot be shared. They come first in the order, so they shorten what
    remains, and a set with too few others leaves here.
    """
    entries = classes.select("node", "n", F.explode("retained").alias("value"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    by_set = entries.join(shared, "value").groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("sets", "value"))).alias("values"))
    spare = F.size("values") - needed_overlap(F.col("n"), retained, percent) + 1
    return by_set.filter(spare > 0).select("node", "n", F.slice(F.col("values.value"), F.lit(1), spare).alias("values"))


def _with_labels(lists: DataFrame, labels: DataFrame) -> DataFrame:
    return lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _hub_pairs(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b) of members and hubs of the lists that hold more than one component; of lists with equal members one is used."""
    members = _with_labels(lists, labels).select("node", "component", F.explode("values").alias("value"))
    hubs = [F.min(F.col("node").bitwiseXOR(F.lit(seed))).bitwiseXOR(F.lit(seed)) for seed in HUB_SEEDS]
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark_{k}") for k in (1, 2)]
    found = members.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.array(*hubs).alias("hubs"), *marks)
    found = found.filter("low != high").groupBy("size", "mark_1", "mark_2").agg(F.min("value").alias("value"), F.any_value("hubs").alias("hubs"))
    met = members.join(found.select("value", "hubs"), "value").select(F.col("node").alias("a"), "component", F.explode(F.array_distinct("hubs")).alias("b"))
    ends = labels.select(F.col("node").alias("b"), F.col("component").alias("component_b"))
    met = met.filter("a != b").distinct().join(ends, "b", "left").filter("component != coalesce(component_b, b)")
    return ordered(met)


def _open_pairs(lists: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of all pairs in a list that have different components and may be similar."""
    members = _with_labels(lists, labels)
    entries = members.select("node", "component", F.explode("values").alias("value"))
    still = entries.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("value")
    rows = members.join(classes.select("node", *ODD_NAMES), "node")
    rows = stored(rows.select("*", F.explode("values").alias("value")).join(still, "value"), "open")
    other = rows.select(*[F.col(c).alias(f"{c}_b") for c in rows.columns])
    met = (F.col("node") < F.col("node_b")) & (F.col("component") != F.col("component_b")) & sizes_fit("n", "n_b", percent)
    first = F.get(F.array_intersect("values", "values_b"), F.lit(0)) == F.col("value")
    near = rows.join(other, (F.col("value") == F.col("value_b")) & met & cells_fit("n", "n_b", "_b", percent) & first)
    return near.select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def _possible(pairs: DataFrame, classes: DataFrame, retained: int, percent: int) -> DataFrame:
    """The pairs that sizes, odd cells and union sketches allow."""
    about = {"a": "", "b": "_b"}
    cells = [classes.select(F.col("node").alias(k), *[F.col(c).alias(c + s) for c in ("n", *ODD_NAMES)]) for k, s in about.items()]
    fit = pairs.join(cells[0], "a").join(cells[1], "b").filter(sizes_fit("n", "n_b", percent) & cells_fit("n", "n_b", "_b", percent))
    fit = stored(fit.select("a", "b"), "fit")
    kept = [classes.select(F.col("node").alias(k), F.col("n").alias("n" + s), F.col("retained").alias("retained" + s)) for k, s in about.items()]
    return fit.join(kept[0], "a").join(kept[1], "b").filter(union_fits("retained", "retained_b", "n", "n_b", retained, percent)).select("a", "b")


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, retained: int = RETAINED) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    text_batches(docs.sparkSession)
    rows = stored(sketches(docs, words, retained), "sketches")
    parts = [F.first(c, ignorenulls=True).alias(c) for c in ("retained", *ODD_NAMES)]
    found = rows.filter("key is not null and doc_id is not null").groupBy("key")
    # Numbers are given when the table is written, and then only read.
    classes = found.agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), *parts)
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    lists = stored(inverted_lists(classes, retained, percent), "lists")
    linked = shared_ids(rows, classes)
    labels = close(linked)
    compared = linked
    for round_ in range(HUB_ROUNDS + 1):
        pairs = _open_pairs(lists, labels, classes, percent) if round_ == HUB_ROUNDS else _hub_pairs(lists, labels)
        pairs = stored(pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        compared = compared.union(pairs)
        possible = stored(_possible(pairs, classes, retained, percent), "possible")
        new = stored(exact_links(possible, classes, docs, words, percent), "links")
        linked = linked.union(new)
        if new.limit(1).count():
            labels = close(linked)
    ended = answers(rows.select("doc_id", "n", "key"), classes, labels)
    return ended.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
