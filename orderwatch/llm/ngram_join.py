"""Self-join on the Jaccard similarity of word shingles, with token-combination prefixes.

Shingles (tokens here) are ordered: rare ones first, then frequent ones. A set of n tokens
that is at least ``percent`` similar to another misses at most t = n - ceil(percent * n)
tokens of it, so both share enough of their prefixes. Rare tokens are indexed alone; a
frequent token would meet too many sets, so frequent tokens are dealt to classes and the
pairs of a class are indexed. The prefix is extended until

    (rare tokens in it) + sum over classes of (tokens in it - 1)  >=  t + 1:

however t tokens are missed, a rare token or two tokens of one class remain common. The
number of classes grows with the set's size in steps of two, and a set is indexed for each
step a partner can have, so the index grows in proportion to the text. What is called
frequent changes the work only, never the result.

Equal sets are collapsed first. In an index bucket the members are first compared with a few
hubs; members of one component need no further comparison, so a large group of near copies
takes a few comparisons a member and not all pairs. Further rounds take other hubs; at last
all pairs whose components still differ are compared. Before texts are moved, odd cells and
counts of tokens by cell of the hash space rule out pairs that cannot be similar. Every comparison
is exact (up to 64-bit hashes), and no pair that may link is left out.

Defined results: NULL, empty and blank texts have an empty set and link with nothing; rows
that share a doc_id count as one document and are linked, each of their texts with all it is similar to; a NULL doc_id has a NULL
component; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import ODD_NAMES, answers, cells_fit, close, exact_links, odd_cells, odd_columns, ordered, set_key, shared_ids, sizes_fit
from .shared import BASE, STEP, mix, rows_of, shingle_set, stored, text_batches, whole_text, word_hashes

WORDS = 4
PERCENT = 85
FREQUENT_SHARE = 2000
MAX_FREQUENT = 1 << 18
CLASS_TOKENS = 1
HUB_ROUNDS = 3
HUBS = 4
HUB_PART = 8
COUNTED_TOKENS = 1 << 22
FIRST_ENTRIES = 32
SEEN_KEYS = 1 << 17


def missing(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` that a similar set may lack."""
    return n - (percent * n + 99) // 100


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index entries of a sorted token set."""
    lack = missing(len(tokens), percent)
    if 100 * len(tokens) < percent * (len(tokens) + 1):
        return np.zeros(0, np.uint64)  # not even a set with one more token is similar enough; equal sets are collapsed
    at = np.searchsorted(frequent, tokens)
    common = frequent[np.minimum(at, len(frequent) - 1)] == tokens if len(frequent) else np.zeros(len(tokens), bool)
    rare, often = tokens[~common], tokens[common]
    found = [mix(rare[: lack + 1] + np.uint64(STEP))]
    wanted = lack + 1 - len(rare)
    if wanted > 0:
        steps = range(int(np.log2(len(tokens) * percent / 100)), int(np.log2(len(tokens) * 100 / percent)) + 1)
        for step in steps:
            classes = max(1, (100 - percent) * 2**step // (100 * CLASS_TOKENS))
            own = (mix(often) % np.uint64(classes)).astype(np.int64)
            gain = np.ones(len(often), np.int64)
            gain[np.unique(own, return_index=True)[1]] = 0
            end = int(np.searchsorted(np.cumsum(gain), wanted)) + 1
            for k in range(classes):
                members = often[:end][own[:end] == k]
                i, j = np.triu_indices(len(members), 1)
                found.append(mix(mix(members[i]) * np.uint64(BASE) + members[j] + np.uint64((step + 2) * STEP % 2**64)))
    return np.unique(np.concatenate(found))


def _survey(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, key) of each row, and the tokens of many sets, at most MAX_FREQUENT.

    ``key`` is a 128-bit hash that equal sets share. A token in a given share of all
    sets has that share in some part of the table at least; parts report tokens above
    it, counted once for equal sets.
    """

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size, seen = ["doc_id", "n", "key", "token", "sets"], [], 0, set()

        def report() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= max(3, len(held) // FREQUENT_SHARE)
            columns = [pa.array(token[many].view(np.int64)), pa.array(n[many].astype(np.int64))]
            none = [pa.nulls(len(columns[0]), kind) for kind in (pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, *columns], names)

        for batch in batches:
            sizes, keys = [], []
            for text in rows_of(batch, "text"):
                tokens = shingle_set(word_hashes(text), words)
                sizes.append(len(tokens))
                keys.append(set_key(tokens))
                if len(tokens) and keys[-1] not in seen:
                    seen.add(keys[-1])
                    held.append(tokens)
                    size += len(tokens)
                    if size > COUNTED_TOKENS:
                        yield report()
                        held, size, seen = [], 0, set()
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(sizes), pa.int64())] * 2], names)
        if held:
            yield report()

    found = stored(docs.select("doc_id", whole_text()).mapInArrow(survey, "doc_id long, n long, key binary, token long, sets long"), "survey")
    often = found.filter("token is not null").groupBy("token").agg(F.sum("sets").alias("sets")).filter("sets >= 8")
    often = often.orderBy(F.desc("sets"), "token").limit(MAX_FREQUENT).select("token").collect()
    return found.filter("token is null").select("doc_id", "n", "key"), np.sort(np.array([r.token for r in often], np.int64).view(np.uint64))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Tokens in each of 2**k cells of the hash space; k follows the size."""
    cells = 1 << max(4, len(tokens).bit_length() - 1)
    return np.minimum(np.bincount((tokens % np.uint64(cells)).astype(np.int64), minlength=cells), 255).astype(np.uint8)


def possible(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sets with these sketches may be similar: in each cell they share the smaller count at most."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    if x.max() == 255 or y.max() == 255:
        return True
    sizes = x.sum() + y.sum()
    while len(x) > len(y):
        x = x.reshape(2, -1).sum(0)
    while len(y) > len(x):
        y = y.reshape(2, -1).sum(0)
    shared = np.minimum(x, y).sum()
    return bool(100 * shared >= percent * (sizes - shared))


def _index(docs: DataFrame, classes: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """(node, n, entries, first, sketch, odd cells) of each class of equal sets.

    A task gives copies once; ``first`` holds the smallest entries.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent)
    names = ["key", "entries", "sketch", *ODD_NAMES]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, entries, sketches, odd = [], [], [], []
            for text in rows_of(batch, "text"):
                tokens = shingle_set(word_hashes(text), words)
                key = set_key(tokens)
                if key is None or key in seen:
                    continue
                if len(seen) >= SEEN_KEYS:
                    seen.clear()
                seen.add(key)
                keys.append(key)
                entries.append(signatures(tokens, known.value, percent).view(np.int64))
                sketches.append(zlib.compress(sketch(tokens).tobytes(), 1))
                odd.append(odd_cells(tokens))
            columns = [pa.array(keys, pa.binary()), pa.array(entries, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), *odd_columns(odd)]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.filter("doc_id is not null").select(whole_text())
    found = rows.mapInArrow(index, "key binary, entries array<long>, sketch binary, " + ", ".join(f"{n} long" for n in ODD_NAMES))
    one = found.groupBy("key").agg(*[F.first(c).alias(c) for c in names[1:]]).join(classes.select("key", "node", "n"), "key")
    first = F.slice(F.array_sort("entries"), 1, FIRST_ENTRIES).alias("first")
    return stored(one.select("node", "n", "entries", first, "sketch", *ODD_NAMES), "index")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule them out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(zlib.decompress(v), np.uint8) for v in rows_of(batch, c)] for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array([possible(p, q, percent) for p, q in zip(x, y)], pa.bool_()))

    left, right = (sketches.select(F.col("node").alias(n), F.col("sketch").alias(t)) for n, t in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").mapInArrow(check, "a long, b long").distinct()


def _near(percent: int, a: str, b: str):
    """Sizes between which a link is possible at all."""
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (F.col("a") != F.col("b"))


def _open_buckets(entries: DataFrame, labels: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
    """Members of the buckets that hold more than one component, and these buckets with a few hubs.

    Of buckets with the same members, told by their number and two 64-bit hashes, one is kept.
    """
    state = entries.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    seeds = [F.lit(HUBS * round_ + k) for k in range(HUBS)]
    hubs = F.array(*[F.min(F.struct(F.xxhash64("node", seed).alias("rank"), "node", "n", "component")) for seed in seeds]).alias("hubs")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark_{k}") for k in (101, 102)]
    buckets = state.groupBy("entry").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), hubs, *marks)
    buckets = buckets.filter("low != high").groupBy("size", "mark_101", "mark_102").agg(F.min(F.struct("entry", "hubs")).alias("first"))
    return state, stored(buckets.select("first.entry", F.array_distinct("first.hubs").alias("hubs")), "buckets")


def _bucket_pairs(members: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """(a, b) of all pairs of a bucket that sizes and odd cells allow, for most pairs from one bucket only.

    A pair leaves from the smallest entry that both sets have, if it is among the first of both; only
    pairs that meet beyond those may leave several buckets. Of buckets with equal members the one with the smallest
    entry is open, so this bucket is never missing.
    """
    rows = members.select("entry", "node", "component").join(index.select("node", "n", "first", *ODD_NAMES), "node")
    other = rows.select(*[F.col(c).alias(f"{c}_b") for c in rows.columns])
    met = (F.col("node") < F.col("node_b")) & (F.col("component") != F.col("component_b")) & sizes_fit("n", "n_b", percent)
    lowest = F.coalesce(F.get(F.array_intersect("first", "first_b"), F.lit(0)), F.col("entry"))
    near = rows.join(other, (F.col("entry") == F.col("entry_b")) & met & cells_fit("n", "n_b", "_b", percent) & (lowest == F.col("entry")))
    return near.select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row."""
    text_batches(docs.sparkSession)
    rows, frequent = _survey(docs, words)
    found = rows.filter("key is not null and doc_id is not null").groupBy("key")
    classes = found.agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    # Numbers are given when the table is written, and then only read.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    index = _index(docs, classes, frequent, words, percent)
    entries = index.select(F.explode("entries").alias("entry"), "node", "n")
    buckets = entries.groupBy("entry").agg(F.count("*").alias("size")).filter("size > 1").select("entry")
    entries = stored(entries.join(buckets, "entry"), "entries")
    linked = shared_ids(rows, classes)
    labels, compared = close(linked), linked
    for round_ in range(HUB_ROUNDS + 1):
        last = round_ == HUB_ROUNDS
        # Hubs only spare work, so a part of the entries is enough; the last round takes all.
        state, open_ = _open_buckets(entries if last else entries.filter(F.pmod("entry", F.lit(HUB_PART)) == 0), labels, round_)
        if last:
            pairs = _bucket_pairs(state.join(open_.select("entry"), "entry"), index, percent)
        else:
            met = state.join(open_, "entry").select("node", "n", "component", F.explode("hubs").alias("hub"))
            pairs = met.select(F.col("node").alias("a"), "n", "component", F.col("hub.node").alias("b"), F.col("hub.n").alias("n_b"), F.col("hub.component").alias("c_b"))
            pairs = pairs.filter("component != c_b").filter(_near(percent, "n", "n_b"))
        pairs = stored(ordered(pairs).join(compared, ["a", "b"], "left_anti"), "pairs")
        compared = compared.union(pairs)
        possible = stored(_possible(pairs, index, percent), "possible")
        new = stored(exact_links(possible, classes, docs, words, percent), "links")
        linked = linked.union(new)
        if new.limit(1).count():
            labels = close(linked)
    ended = answers(rows, classes, labels)
    return ended.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked documents, the one with the smallest id, with all columns.

    Of rows that share this id the one whose text has the smallest hash is kept. Texts without words link with nothing
    and stay, as do rows without an id.
    """
    ids = link(docs, words, percent).filter("doc_id = component_id").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_times"))
    kept = docs.join(ids, docs["doc_id"] == ids["_id"]).drop("_id")
    # Only ids that repeat are grouped, so the other texts are not shuffled for it.
    repeated = kept.filter("_times > 1").drop("_times").groupBy("doc_id")
    one = repeated.agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("_row")).select("_row.*")
    return kept.filter("_times = 1").drop("_times").unionByName(one).unionByName(docs.filter("doc_id is null"))
