"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A random walk reads a string: at each step it writes the current byte and then stays or
moves on, as a random bit for (step, byte) says. Two strings a few edits apart write
sequences a small Hamming distance apart, because the walks fall into step again after an
edit. Sequences are sampled at SAMPLES steps; windows of benchmark items and of documents
whose samples are equal in one of REPEATS independent walks are candidates, and each
candidate is verified by the exact edit distance of the whole item to the best-fitting
part of the document.

Windows start at anchors: of every ANCHOR_WORDS words in a row the one with the smallest
hash, so that an item has the same anchors wherever it stands. From each anchor of an item
the window reaches as far as the item does; sampled steps fit window lengths in octaves. An
item of 200 bytes has about eight windows, so an edited item is found if one of windows
times walks meets no edit at its samples: the tests measure recall.

Short items, of fewer than SHORT_WORDS words, may share no anchor with a document. Their
windows start at every word start, of items and of documents, and their first bytes (up to
GRAM_SIZES[-1]) are looked up at every byte of a document. Longer items share with each copy
the anchor of their second to ninth word; the bytes from there are looked up at the anchors.
So no exact copy is lost. Of items under SHORTEST bytes that allow an edit (from 9 bytes) the first
and the last GRAM bytes are looked up: one edit spoils one of them only. Documents are read
for this only if the block has short items.

Benchmark items are the query set; they are taken in blocks of ITEMS_PER_BLOCK, whose
windows travel with the tasks, and every block meets all documents and whole texts.

Defined results: case of A-Z is ignored; NULL and empty texts hold no item; items that are NULL or
blank are not searched for; items too short for an edit (under 9 bytes) count where no
letter or digit adjoins them; equal items are all reported; repeated rows are judged alike;
an empty benchmark marks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BASE, lower, mix, rows_of, text_batches, whole_text, word_places

REPEATS = 4
SAMPLES = 8
LENGTHS = (16, 48, 96, 192)
SHORTEST = 16
ANCHOR_WORDS = 8
# An item of so many words has room after the anchor of its second to ninth word.
SHORT_WORDS = 2 * ANCHOR_WORDS - 1
GRAM_SIZES = (1, 2, 4, 8, 16)
MAX_EDIT_SHARE = 0.12
GRAM = 4
ITEMS_PER_BLOCK = 20_000
PIECE = 1 << 19
EARLY = (3, 5)


def anchors(data: bytes) -> np.ndarray:
    """First bytes of the words with the smallest hash among ANCHOR_WORDS in a row."""
    first, hashes = word_places(data)
    if len(hashes) <= ANCHOR_WORDS:
        return first[[int(hashes.argmin())]] if len(hashes) else first
    runs = np.lib.stride_tricks.sliding_window_view(hashes, ANCHOR_WORDS)
    return first[np.unique(runs.argmin(1) + np.arange(len(runs)))]


def _grams(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A key of the ``n`` bytes from each of these bytes on."""
    keys = np.zeros(len(at), np.uint64)
    for k in range(n):
        keys = keys * np.uint64(BASE) + codes[at + k] + np.uint64(1)
    return mix(keys)


def _gram_places(text: bytes) -> list[tuple[int, int]]:
    """(size, offset) of the grams by which a short item is looked up."""
    if not text.strip():
        return []
    if len(text) < SHORTEST and int(MAX_EDIT_SHARE * len(text)):
        return [(GRAM, 0), (GRAM, len(text) - GRAM)]
    return [(max(n for n in GRAM_SIZES if n <= len(text)), 0)]


def _stands(wanted: bytes, data: bytes, at: int) -> bool:
    """Whether ``wanted`` is at this byte and no letter or digit of A-Z and 0-9 runs on past its ends."""
    if at < 0 or data[at : at + len(wanted)] != wanted:
        return False
    edges = data[max(0, at - 1) : at + 1], data[at + len(wanted) - 1 : at + len(wanted) + 1]
    return not any(len(e) == 2 and e.isalnum() for e in edges)


@dataclass
class Walk:
    """One random walk: moves[step, byte], and for each window length the sampled steps."""

    moves: np.ndarray
    steps: list[np.ndarray]


def walks() -> list[Walk]:
    rng = np.random.default_rng(23)
    depth = int(1.8 * LENGTHS[-1])
    found = []
    for _ in range(REPEATS):
        moves = rng.integers(0, 2, (depth, 256)).astype(np.int64)
        found.append(Walk(moves, [np.sort(rng.choice(int(1.8 * n), SAMPLES, replace=False)) for n in LENGTHS]))
    return found


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(BASE)) >> np.uint64(48)).astype(np.int64)


class Finder:
    """The windows of a block of items, and the search for them in a text."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items, self.walks = items, walks()
        self.longest = max((len(t) for _, t in items), default=0)
        places, short, grams, marks = [], [], {n: [] for n in GRAM_SIZES}, {n: [] for n in GRAM_SIZES}
        for k, (_, text) in enumerate(items):
            (words, hashes), at = word_places(text), anchors(text)
            size = [int(np.searchsorted(LENGTHS, len(text) - a, "right")) - 1 for a in at]
            if len(words) < SHORT_WORDS:
                room = [(a, int(np.searchsorted(LENGTHS, len(text) - a, "right"))) for a in words]
                short += [(k, a, c) for a, n in room for c in range(n)]
                for n, a in _gram_places(text):
                    grams[n].append((k, a))
                continue
            # The first and last word may have other signs around them; this anchor every copy has.
            mark = int(words[1 + int(hashes[1 : 1 + ANCHOR_WORDS].argmin())])
            marks[max(n for n in GRAM_SIZES if n <= len(text) - mark)].append((k, mark))
            if any(s > 0 for s in size):
                places += [(k, a, c) for a, s in zip(at, size) for c in range(1, s + 1)]
            else:
                places += [(k, 0, 0)] + [(k, a, s) for a, s in zip(at, size) if s == 0 and a]
        joined, starts = b"", []
        for _, text in items:
            starts.append(len(joined))
            joined += text + bytes(LENGTHS[-1] * 2)
        codes = np.frombuffer(joined + bytes(LENGTHS[-1] * 2), np.uint8)
        self.anchored, self.short = self._windows(codes, starts, places), self._windows(codes, starts, short)
        self.grams, self.marks = ([self._gram_table(codes, starts, n, own) for n, own in some.items() if own] for some in (grams, marks))

    @staticmethod
    def _gram_table(codes: np.ndarray, starts: list[int], n: int, own: list[tuple[int, int]]) -> tuple:
        """Size of the grams, their keys as a bit field, whole keys sorted, their items and offsets."""
        key = _grams(codes, np.array([starts[k] + a for k, a in own], np.int64), n)
        order, field = np.argsort(key, kind="stable"), np.zeros(1 << 16, bool)
        field[_slot(key)] = True
        return n, field, key[order], np.array(own, np.int64)[order]

    def _windows(self, codes: np.ndarray, starts: list[int], windows: list[tuple[int, int, int]]) -> tuple[np.ndarray, list]:
        """Items and offsets of windows, and a table for each walk."""
        sizes = np.array([s for *_, s in windows], np.int64)
        at = np.array([starts[k] + a for k, a, _ in windows], np.int64)
        # For each walk and length: keys after EARLY samples as bit fields, whole keys sorted, their places.
        tables = []
        for walk in self.walks:
            own = []
            for c in range(len(LENGTHS)):
                some = np.flatnonzero(sizes == c)
                keys = self._keys(codes, at[some], walk, c)
                fields = []
                for n in EARLY:
                    field = np.zeros(1 << 16, bool)
                    field[_slot(keys[n - 1])] = True
                    fields.append(field)
                order = np.argsort(keys[-1], kind="stable")
                own.append((fields, keys[-1][order], some[order]))
            tables.append(own)
        return np.array([(k, a) for k, a, _ in windows], np.int64).reshape(-1, 2), tables

    @staticmethod
    def _keys(codes: np.ndarray, at: np.ndarray, walk: Walk, c: int) -> np.ndarray:
        """Keys after each sample, for a few windows."""
        key, at, found = np.zeros(len(at), np.uint64), at.copy(), []
        sampled = set(walk.steps[c].tolist())
        for step in range(int(walk.steps[c][-1]) + 1):
            byte = codes[at]
            if step in sampled:
                key = key * np.uint64(BASE) + byte + np.uint64(1)
                found.append(key)
            at += walk.moves[step, byte]
        return np.array(found, np.uint64).reshape(SAMPLES, -1)

    def candidates(self, texts: list[bytes]) -> set[tuple[int, int, int]]:
        """(text, item, byte at which it would begin) for all windows that meet.

        Texts are joined to blocks of about PIECE bytes, long ones cut with an overlap, so
        that each step of a walk serves many windows.
        """
        found: set[tuple[int, int, int]] = set()
        held: list[tuple[int, int, bytes]] = []
        size, overlap = 0, 2 * self.longest + 64
        for k, data in enumerate(texts):
            for begin in range(0, max(1, len(data)), PIECE):
                held.append((k, begin, data[begin : begin + PIECE + overlap]))
                size += len(held[-1][2]) + 1
                if size >= PIECE:
                    found |= self._search(held)
                    held, size = [], 0
        return found | self._search(held)

    def _search(self, held: list[tuple[int, int, bytes]]) -> set[tuple[int, int, int]]:
        joined = b"\n".join(p for *_, p in held)
        first = np.cumsum([0] + [len(p) + 1 for *_, p in held])
        found = set()
        codes = np.frombuffer(joined + bytes(2 * LENGTHS[-1]), np.uint8)

        def meet(window: int, item: int, offset: int) -> None:
            own = int(np.searchsorted(first, window, "right")) - 1
            text, begin, _ = held[own]
            found.add((text, item, begin + window - int(first[own]) - offset))

        at = anchors(joined)
        for (places, tables), start in ((self.anchored, at), (self.short, word_places(joined)[0] if len(self.short[0]) else at)):
            if not len(places):
                continue
            for walk, table in zip(self.walks, tables):
                for window, place in self._meet(codes, start, walk, table):
                    meet(window, *places[place].tolist())
        for some, start in ((self.marks, at), (self.grams, np.arange(len(joined) if self.grams else 0))):
            for n, field, whole, places in some:
                keys = _grams(codes, start, n)
                near = np.flatnonzero(field[_slot(keys)])
                low, high = np.searchsorted(whole, keys[near]), np.searchsorted(whole, keys[near], "right")
                met = np.flatnonzero(low < high)
                for window, a, b in zip(start[near[met]].tolist(), low[met].tolist(), high[met].tolist()):
                    for place in places[a:b].tolist():
                        meet(window, *place)
        return found

    def _meet(self, codes: np.ndarray, start: np.ndarray, walk: Walk, table: list) -> Iterator[tuple[int, int]]:
        classes = [c for c in range(len(LENGTHS)) if len(table[c][1])]
        at, start = start.copy(), start
        keys = {c: np.zeros(len(at), np.uint64) for c in classes}
        alive = {c: np.ones(len(at), bool) for c in classes}
        done = dict.fromkeys(classes, 0)
        sampled: dict[int, list[int]] = {}
        for c in classes:
            for step in walk.steps[c].tolist():
                sampled.setdefault(step, []).append(c)
        for step in range(max(sampled, default=-1) + 1):
            if not len(at):
                return
            byte = codes[at]
            for c in sampled.get(step, ()):
                if c not in keys:
                    continue
                keys[c] = keys[c] * np.uint64(BASE) + byte + np.uint64(1)
                done[c] += 1
                if done[c] in EARLY:
                    alive[c] &= table[c][0][EARLY.index(done[c])][_slot(keys[c])]
                if done[c] == SAMPLES:
                    _, whole, places = table[c]
                    some = np.flatnonzero(alive[c])
                    low, high = np.searchsorted(whole, keys[c][some]), np.searchsorted(whole, keys[c][some], "right")
                    for k, a, b in zip(some.tolist(), low.tolist(), high.tolist()):
                        for place in places[a:b].tolist():
                            yield int(start[k]), place
                    del keys[c], alive[c]
                    if not keys:
                        return
                elif done[c] in EARLY:
                    any_ = np.logical_or.reduce(list(alive.values()))
                    if any_.mean() < 0.6:
                        at, byte, start = at[any_], byte[any_], start[any_]
                        keys, alive = {c: k[any_] for c, k in keys.items()}, {c: a[any_] for c, a in alive.items()}
            at = at + walk.moves[step, byte]

    def hits(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text (item_id, edit distance) of the items it holds."""
        data = [lower(t) for t in texts]
        best: list[dict[int, int]] = [{} for _ in texts]
        for text, item, begin in sorted(self.candidates(data)) if self.items else ():
            _, wanted = self.items[item]
            if best[text].get(item) == 0:
                continue
            slack = int(MAX_EDIT_SHARE * len(wanted))
            if not slack:
                if _stands(wanted, data[text], begin):
                    best[text][item] = 0
                continue
            part = data[text][max(0, begin - slack) : max(0, begin + len(wanted) + slack)]
            distance = 0 if wanted in part else edits(wanted, part) if may_fit(wanted, part, slack) else slack + 1
            if distance <= min(slack, best[text].get(item, slack)):
                best[text][item] = distance
        return [[(self.items[k][0], d) for k, d in sorted(b.items())] for b in best]


def may_fit(wanted: bytes, part: bytes, most: int) -> bool:
    """Whether ``wanted`` may be ``most`` edits from a part: each edit spoils GRAM runs of GRAM bytes at most."""

    def grams(data: bytes) -> np.ndarray:
        codes, n = np.frombuffer(data, np.uint8).astype(np.uint32), len(data) - GRAM + 1
        return codes[:n] | codes[1 : n + 1] << 8 | codes[2 : n + 2] << 16 | codes[3 : n + 3] << 24

    if len(part) < GRAM:
        return len(wanted) - len(part) <= most
    own = grams(wanted)
    return int(np.isin(own, grams(part)).sum()) >= len(own) - GRAM * most


def edits(wanted: bytes, text: bytes) -> int:
    """Least edit distance of ``wanted`` to any part of ``text``."""
    codes = np.frombuffer(text, np.uint8)
    row, across = np.zeros(len(codes) + 1, np.int64), np.arange(len(codes) + 1)
    for byte in wanted:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        np.minimum(row[:-1] + (codes != byte), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - across) + across
    return int(row.min())


def blocks(benchmark: DataFrame, size: int = ITEMS_PER_BLOCK) -> Iterator[list[tuple[int, bytes]]]:
    """The items in bounded blocks, in the order of their ids."""
    rows = benchmark.filter("text is not null and item_id is not null").select("item_id", "text").orderBy("item_id", "text")
    items = ((int(r.item_id), lower(r.text)) for r in rows.toLocalIterator())
    items = (i for i in items if i[1].strip())
    while block := list(islice(items, size)):
        yield block


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, items, distances) for each row; the lists are in the order of item ids."""
    rows = docs.select(F.struct("doc_id").alias("row"), whole_text(), F.array().cast("array<bigint>").alias("items"), F.array().cast("array<int>").alias("distances"))
    for block in blocks(benchmark):
        rows = _marked(rows, block)
    return rows.select("row.doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items", "distances")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    rows = docs.select(F.struct("*").alias("row"), whole_text(), F.array().cast("array<bigint>").alias("items"), F.array().cast("array<int>").alias("distances"))
    for block in blocks(benchmark):
        rows = _marked(rows, block).filter("size(items) = 0")
    return rows.select("row.*")


def _marked(rows: DataFrame, block: list[tuple[int, bytes]]) -> DataFrame:
    text_batches(rows.sparkSession)
    finder = rows.sparkSession.sparkContext.broadcast(Finder(block))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                found = finder.value.hits(list(rows_of(part, "text")))
                items = [old + [h[0] for h in new] for old, new in zip(part.column("items").to_pylist(), found)]
                distances = [old + [h[1] for h in new] for old, new in zip(part.column("distances").to_pylist(), found)]
                columns = [part.column("row"), part.column("text"), pa.array(items, pa.list_(pa.int64())), pa.array(distances, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "text", "items", "distances"])

    return rows.mapInArrow(mark, f"row {rows.schema['row'].dataType.simpleString()}, text string, items array<long>, distances array<int>")
