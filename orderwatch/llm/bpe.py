"""BPE encoding and decoding by tree concatenation.

A long text is halved until its parts are short; the parts are encoded on their
own, those of very long texts in different tasks. Each join is mended: the tokens
next to it are decoded to a window of text, the window is encoded again and grows
until it agrees with both sides. Agreement is exact and not a guess:

* a token sequence over one unsplit run is its BPE encoding if and only if each
  two neighbours are the encoding of their own concatenation. If the re-encoded
  window starts with the left side's token at that place and ends with the right
  side's, all neighbours stem from some encoding and the whole is the encoding;
* a place where the pre-tokenizer always splits (a character before white space,
  or a change between letters, digits and other signs) needs no agreement.

Defined results: NULL and empty texts have no ids; decoding no ids gives "".
Repeated rows are encoded alike and all kept. Special tokens written out in a
text become their ids, as in the library.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import rows_of, text_batches, whole_text

LEAF_CHARS = 4096
SPAN_CHARS = 32768
FIRST_WINDOW = 4

# White space of the pre-tokenizer's pattern, and the byte-level pattern itself (fixed values).
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_IS_BLANK = re.compile(f"[{_BLANK}]")
_IS_LETTER, _IS_DIGIT = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")


def _kind(char: str) -> str:
    if _IS_BLANK.match(char):
        return "blank"
    return "letter" if _IS_LETTER.match(char) else "digit" if _IS_DIGIT.match(char) else "sign"


def _place(before: str, after: str) -> str:
    """What the place between two strings is: a sure ``cut``, ``inside`` one run, or ``open``."""
    if not before or not after:
        return "cut"
    left, right = _kind(before[-1]), _kind(after[0])
    if right == "blank" and left != "blank":
        return "cut"
    if left == "blank":
        return "inside" if right == "blank" and len(after) > 1 and _kind(after[1]) == "blank" else "open"
    if left != right:
        return "open" if before[-1] == "'" else "cut"
    return "open" if "'" in before[-3:] or after[0] == "'" or len(before) < 3 else "inside"


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of the byte-level alphabet, by its published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Coder:
    """Encoder and decoder for one byte-level BPE file.

    The tokenizers library reads the file. Short texts are merged by tiktoken over
    the vocabulary of that file: each token's id is its merge rank, which is
    checked, so both give the same ids; tiktoken takes a fifth of the time.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        shape = spec.get("pre_tokenizer") or {}
        if shape.get("type") != "ByteLevel" or shape.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without normaliser and prefix space is needed")
        library = Tokenizer.from_file(path)
        added = {int(k): t.content for k, t in library.get_added_tokens_decoder().items()}
        self.special = set(added)
        self.n_ids = library.get_vocab_size()
        alphabet = _byte_of_char()
        self.bytes_of = [b""] * self.n_ids
        for token, k in library.get_vocab().items():
            self.bytes_of[k] = token.encode() if k in added else bytes(alphabet[c] for c in token)
        self.id_of_special = {t: np.uint32(k).tobytes() for k, t in added.items()}
        names = sorted(added.values(), key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        vocabulary = spec["model"]["vocab"]
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if merged != list(range(256, 256 + len(merged))):
            raise ValueError("ids must follow the order of the merges")
        ranks = {self.bytes_of[k]: k for k in vocabulary.values() if k not in added}
        self.merger = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def leaf(self, text: str) -> bytes:
        """Ids of a short text as little-endian 32-bit integers."""
        return array("I", self.merger.encode_ordinary(text)).tobytes()

    def tree(self, text: str) -> bytes:
        if len(text) <= LEAF_CHARS:
            return self.leaf(text)
        half = len(text) // 2
        a, b = text[:half], text[half:]
        return self.join(a, self.tree(a), b, self.tree(b))

    def join(self, a: str, left: bytes, b: str, right: bytes) -> bytes:
        """The ids of ``a + b`` from the ids of both."""
        if not left or not right:
            return left + right
        n_left, n_right, width = len(left) // 4, len(right) // 4, FIRST_WINDOW
        while True:
            back, head, start = self._left(a, left, n_left, width)
            ahead, tail, end = self._right(b, right, n_right, width)
            window = self.leaf(head + tail)
            at, to = 4 * (n_left - back), 4 * ahead
            if (start == "cut" or window[:4] == left[at : at + 4]) and (end == "cut" or window[-4:] == right[to - 4 : to]):
                return left[:at] + window + right[to:]
            width *= 2

    def _left(self, a: str, ids: bytes, n: int, width: int) -> tuple[int, str, str]:
        """Tokens, text and kind of place of the window's left part."""
        taken, data = 0, b""
        while True:
            want = min(n, max(width, taken + 1))
            for k in np.frombuffer(ids, "<u4", want - taken, 4 * (n - want))[::-1]:
                if int(k) in self.special:
                    return taken, data.decode(), "cut"
                data, taken = self.bytes_of[k] + data, taken + 1
            if taken == n:
                return taken, data.decode(), "cut"
            if data[0] & 0xC0 == 0x80:
                continue
            text = data.decode()
            place = _place(a[max(0, len(a) - len(text) - 3) : len(a) - len(text)], text)
            if place != "open":
                return taken, text, place

    def _right(self, b: str, ids: bytes, n: int, width: int) -> tuple[int, str, str]:
        taken, data = 0, b""
        while True:
            want = min(n, max(width, taken + 1))
            for k in np.frombuffer(ids, "<u4", want - taken, 4 * taken):
                if int(k) in self.special:
                    return taken, data.decode(), "cut"
                data, taken = data + self.bytes_of[k], taken + 1
            if taken == n:
                return taken, data.decode(), "cut"
            after = int(np.frombuffer(ids, "<u4", 1, 4 * taken)[0])
            if after in self.special:
                return taken, data.decode(), "cut"
            if self.bytes_of[after][0] & 0xC0 == 0x80:
                continue
            text = data.decode()
            place = _place(text, b[len(text) : len(text) + 2])
            if place != "open":
                return taken, text, place

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split is None or not self.split.search(text):
            return self.tree(text)
        return b"".join(self.id_of_special.get(part) or self.tree(part) for part in self.split.split(text) if part)

    def decode(self, ids: bytes) -> str:
        found = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, found)).decode("utf-8", "replace")

    def spans(self, text: str) -> list[str]:
        """A text in parts of about SPAN_CHARS, none of which cuts a special token."""
        cuts, taboo = [0], [m.span() for m in self.split.finditer(text)] if self.split else []
        for at in range(SPAN_CHARS, len(text), SPAN_CHARS):
            at = next((s for s, e in taboo if s < at < e), at)
            if at > cuts[-1]:
                cuts.append(at)
        return [text[s:e] for s, e in zip(cuts, [*cuts[1:], len(text)])]

    def join_spans(self, parts: list[tuple[str, bytes]]) -> bytes:
        """Neighbours are joined level by level."""
        while len(parts) > 1:
            pairs = [parts[k : k + 2] for k in range(0, len(parts), 2)]
            parts = [(p[0][0] + p[1][0], self.join(*p[0], *p[1])) if len(p) == 2 else p[0] for p in pairs]
        return parts[0][1]


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) for each row: ids as little-endian 32-bit integers.

    Texts up to SPAN_CHARS stay in their task. Longer ones are cut, their parts
    dealt to all tasks, and each text's parts meet again to be joined.
    """
    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", whole_text())
    long = F.length("text") > SPAN_CHARS
    key = docs.schema["doc_id"].dataType.simpleString()

    def short_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                ids = [coder(tokenizer).encode(t) for t in rows_of(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                spans = coder(tokenizer).spans(batch.column("text")[k].as_py())
                one = batch.slice(k, 1)
                columns = [pa.concat_arrays([one.column(c)] * len(spans)) for c in ("row", "doc_id")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(spans)), pa.int32()), pa.array(spans)], ["row", "doc_id", "part", "text"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 16) for k in range(0, batch.num_rows, 16)):
                ids = [coder(tokenizer).encode(t) for t in rows_of(part, "text")]
                yield part.append_column("ids", pa.array(ids, pa.binary()))

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        ids = coder(tokenizer).join_spans(list(zip(group["text"].to_pylist(), group["ids"].to_pylist())))
        return pa.table([group["doc_id"].slice(0, 1), pa.array([ids], pa.binary())], ["doc_id", "ids"])

    schema = f"doc_id {key}, ids binary"
    whole = rows.filter(~long).mapInArrow(short_texts, schema)
    dealt = (
        rows.filter(long)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(cut, f"row long, doc_id {key}, part int, text string")
        .repartition("row", "part")
        .mapInArrow(parts, f"row long, doc_id {key}, part int, text string, ids binary")
    )
    return whole.unionByName(dealt.groupBy("row").applyInArrow(join, schema))


def decode(ids: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) with the decoded ``text``; special tokens are kept."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                found = [coder(tokenizer).decode(b) for b in rows_of(part, "ids")]
                yield part.append_column("text", pa.array(found, pa.string()))

    key = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "ids").mapInArrow(texts, f"doc_id {key}, ids binary, text string")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """Counts and SHA-256 of ids and decoded text, after ``more`` columns."""
    return decoded.select(
        "doc_id",
        *more,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
