"""Token ids in binary shards with a minimal perfect hash index.

Documents are encoded, an end id is appended, and the ids are written in
ascending doc_id order as raw little-endian integers (two bytes each if every id
fits, else four). A shard holds consecutive documents; its index maps a document
key to the document's place in the payload:

* a minimal perfect hash in levels: each level is a bit field in which keys that
  meet no other key set their bit, the others go on to the next level; the rank of
  a key's bit is its slot, so n keys have the slots 0 to n-1;
* a 32-bit fingerprint per slot, which tells absent keys apart (one in 2**32
  passes), with the first row and the number of rows of the key.

Shards are rows of a Parquet table, written and committed by Spark's writer: a lost
executor's tasks are run again and leave no half-written file.

Defined results: NULL and empty texts hold the end id only; rows with the same
doc_id are all kept, ordered by a hash of their text, and found together; a NULL doc_id comes
first and is stored under NULL_KEY; an empty table gives no shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import coder
from .shared import mix, rows_of, text_batches, whole_text

SHARD_IDS = 1 << 20
NULL_KEY = -(2**63)
LEVEL_STEP = 0xD6E8FEB86659FD93
SPARE = 2
SCHEMA = (
    "shard long, part int, before long, n_docs long, n_ids long, width int, first_key long, last_key long, "
    "keys binary, offsets binary, levels binary, bits binary, fingerprints binary, first_rows binary, copies binary, payload binary"
)


def key_hash(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + np.uint64(LEVEL_STEP))


def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes + np.uint64((level + 1) * LEVEL_STEP % 2**64)) % np.uint64(size)).astype(np.int64)


def build_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels and all their bits, for distinct hashes."""
    sizes, fields, left = [], [], hashes
    while len(left):
        size = SPARE * len(left)
        at = _place(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        fields.append(alone)
        left = left[~alone[at]]
    return np.array(sizes, np.int64), np.concatenate([*fields, np.zeros(0, bool)])


class Index:
    """The index of one shard, ready for lookups."""

    def __init__(self, row: dict):
        self.sizes = np.frombuffer(row["levels"], np.int64)
        self.bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(self.sizes.sum())).astype(bool)
        self.rank = np.cumsum(self.bits)
        self.prints = np.frombuffer(row["fingerprints"], "<u4")
        self.first_rows = np.frombuffer(row["first_rows"], "<u4")
        self.copies = np.frombuffer(row["copies"], "<u4")
        self.offsets = np.frombuffer(row["offsets"], "<u8").astype(np.int64)
        self.payload = np.frombuffer(row["payload"], f"<u{row['width']}")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; no rows for an absent key."""
        hashes = key_hash(keys)
        slots, base = np.full(len(keys), -1, np.int64), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = base + _place(hashes, level, size)
            new = (slots < 0) & self.bits[at]
            slots[new] = self.rank[at[new]] - 1
            base += size
        known = slots >= 0
        known[known] = self.prints[slots[known]] == (hashes[known] >> np.uint64(32)).astype(np.uint32)
        first, copies = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[known], copies[known] = self.first_rows[slots[known]], self.copies[slots[known]]
        return first, copies

    def ids(self, row: int) -> np.ndarray:
        return self.payload[self.offsets[row] : self.offsets[row + 1]].astype("<u4")


def _shard(number: int, before: int, keys: list[int], ids: list[bytes], width: int) -> dict:
    key = np.array(keys, np.int64)
    lengths = np.array([len(b) // 4 for b in ids], np.int64)
    distinct, first, copies = np.unique(key, return_index=True, return_counts=True)
    hashes = key_hash(distinct)
    sizes, bits = build_hash(hashes)
    slots, base, rank = np.full(len(hashes), -1, np.int64), 0, np.cumsum(bits)
    for level, size in enumerate(sizes.tolist()):
        at = base + _place(hashes, level, size)
        new = (slots < 0) & bits[at]
        slots[new] = rank[at[new]] - 1
        base += size
    order = np.argsort(slots)
    part = TaskContext.get().partitionId()
    return {
        "shard": (part << 32) + number, "part": part, "before": before, "n_docs": len(keys), "n_ids": int(lengths.sum()), "width": width,
        "first_key": keys[0], "last_key": keys[-1], "keys": key.astype("<i8").tobytes(),
        "offsets": np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes(),
        "levels": sizes.tobytes(), "bits": np.packbits(bits).tobytes(),
        "fingerprints": (hashes[order] >> np.uint64(32)).astype("<u4").tobytes(),
        "first_rows": first[order].astype("<u4").tobytes(), "copies": copies[order].astype("<u4").tobytes(),
        "payload": np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes(),
    }


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` and write them below ``path``.

    The order comes from a range partitioning; a task writes its documents as it
    meets them and holds one shard at a time.
    """
    text_batches(docs.sparkSession)
    schema = None

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        width, end = (2 if max(code.n_ids - 1, end_id) < 1 << 16 else 4), np.uint32(end_id).tobytes()
        number, before, held, keys, ids = 0, 0, 0, [], []

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_shard(number, before, keys, ids, width)], schema=schema)

        for batch in batches:
            for key, text in zip(rows_of(batch, "doc_id"), rows_of(batch, "text")):
                keys.append(NULL_KEY if key is None else key)
                ids.append(code.encode(text) + end)
                held += len(ids[-1]) // 4
                if held >= shard_ids:
                    yield shard()
                    number, before, held, keys, ids = number + 1, before + held, 0, [], []
        if keys:
            yield shard()

    def arrow(field: str) -> pa.Field:
        name, kind = field.split()
        return pa.field(name, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind])

    schema = pa.schema([arrow(f) for f in SCHEMA.split(", ")])
    rows = docs.select(F.col("doc_id").cast("long"), whole_text())
    # Rows that share an id follow the hash of their text; wholly equal rows may lie in any order, and in several tasks.
    rows = rows.withColumns({"mark": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ("doc_id", "mark", "row")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    # Small row groups: a reader holds one of them at a time.
    ordered.mapInArrow(write, SCHEMA).write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every stored document, found through the index of its shard.

    Columns doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    """
    table = spark.read.parquet(path)
    # One row for each writing task; the payload is not read.
    totals = sorted((r.part, r.n) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = {}, 0
    for part, n in totals:
        starts[part], total = total, total + n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                index, base = Index(row), starts[row["part"]] + row["before"]
                keys = np.unique(np.frombuffer(row["keys"], "<i8"))
                out = []
                for key, first, copies in zip(keys.tolist(), *(x.tolist() for x in index.find(keys))):
                    for at in range(first, first + copies):
                        ids = index.ids(at)
                        out.append((None if key == NULL_KEY else key, base + int(index.offsets[at]), len(ids), zlib.crc32(ids.tobytes())))
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    columns = ["part", "before", "width", "keys", "offsets", "levels", "bits", "fingerprints", "first_rows", "copies", "payload"]
    return table.select(*columns).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, keys: Sequence[int]) -> DataFrame:
    """(doc_id, copy, ids) of the wanted documents; absent keys give no row.

    Only shards whose key range holds a wanted key are opened; inside a shard each
    key costs the same however many documents it holds. Meant for lists of up to
    some ten thousand keys, which travel with the tasks.
    """
    wanted = np.unique(np.array(list(keys), np.int64))
    table = spark.read.parquet(path)
    if not len(wanted):
        return spark.createDataFrame([], "doc_id long, copy long, ids binary")
    table = table.filter((F.col("first_key") <= int(wanted[-1])) & (F.col("last_key") >= int(wanted[0])))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                own = wanted[np.searchsorted(wanted, row["first_key"]) : np.searchsorted(wanted, row["last_key"], "right")]
                if not len(own):
                    continue
                index, out = Index(row), []
                for key, first, copies in zip(own.tolist(), *(x.tolist() for x in index.find(own))):
                    out += [(key, c, index.ids(first + c).tobytes()) for c in range(copies)]
                if out:
                    doc_id, copy, ids = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(copy, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "copy", "ids"])

    return table.mapInArrow(read, "doc_id long, copy long, ids binary")
