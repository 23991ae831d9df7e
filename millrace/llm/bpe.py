"""Byte-level BPE: a backtracking encoder and an offset-table decoder.

The encoder finds, by one Aho-Corasick scan, the longest token that starts at each byte. It then
walks the text and takes the longest token whose pair with the token before it is one that merging
would also leave unmerged (the compatibility test), shortens it through a prefix table if not, and
steps back if no prefix fits. Each byte position is given up at most once, so time is linear, and
the result equals that of merging pairs by rank. The decoder copies bytes out of one blob by the
offsets of each id, for whole batches at a time.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import id_and_text, lists, text_of

#: The split pattern of the byte-level pre-tokenizer (a fixed value).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: ASCII, Latin letters and common punctuation. In a text of these the pattern comes to the same with
#: plain ranges, which the standard engine runs in half the time.
_LATIN, _SPACE = "A-Za-zÀ-ÖØ-öø-\u024f", "\t-\r "
LATIN_TEXT = re.compile(f"[\\x00-\\x7f{_LATIN}\u2010-\u2027\u2030-\u203e]*")
LATIN_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^{_SPACE}{_LATIN}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Entries of a generation of what a worker remembers. Bounds memory, changes no result.
MEMO = 100_000
#: Pairs of tokens whose check a worker remembers.
PAIRS = 60_000
#: Tokens per batch that a worker passes on.
BATCH_TOKENS = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Tokens of a byte-level BPE file. Inside, a token's number is its age: the 256 bytes, then
    each merge in order; `ids` translates to the file's ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, names = byte_alphabet(), spec["model"]["vocab"]
        single = sorted((name for name in names if len(name) == 1 and name in alphabet), key=names.get)
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.order = [*single, *(a + b for a, b in self.merges)]
        self.ids = [names[name] for name in self.order]
        self.tokens = [bytes(alphabet[c] for c in name) for name in self.order]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}


class Vocabulary(Tokens):
    """What the encoder needs besides: merges, prefixes and the automaton."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        age = {name: i for i, name in enumerate(self.order)}
        bytes_only = len(self.order) - len(self.merges)
        self.by_bytes = {t: i for i, t in enumerate(self.tokens)}
        self.width = len(self.order)
        self.pairs = {age[a] * self.width + age[b]: bytes_only + i for i, (a, b) in enumerate(self.merges)}
        self.halves = [(i, i) for i in range(bytes_only)] + [(age[a], age[b]) for a, b in self.merges]
        del self.order, self.merges
        self.size = [len(t) for t in self.tokens]
        self.shorter = [next((self.by_bytes[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.by_bytes), -1) for t in self.tokens]
        self.single = bytes(self.by_bytes[bytes([b])] for b in range(256))
        self.fits: dict[int, bool] = {}
        self.longest = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(self.tokens):  # reversed: a match that ends at a byte then starts there
            if len(t) > 1:
                self.longest.add_word(t[::-1].decode("latin-1"), i)
        self.longest.make_automaton()

    def compatible(self, left: int, right: int) -> bool:
        """Would merging by rank leave the border between these two neighbours alone? The merges
        that made them are undone, latest first; no pair met on the way may merge earlier than that."""
        pairs, halves, width, limit = self.pairs, self.halves, self.width, 1 << 62
        while True:
            if pairs.get(left * width + right, limit) < limit:
                return False
            if left > right:
                limit = left
                left = halves[left][1]
                if left == limit:
                    limit = right + 1
                    right = halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = halves[right][0]
                if right + 1 == limit:
                    limit = left
                    left = halves[left][1]
                    if left == limit:
                        return True

    def encode(self, data: bytes) -> list[int]:
        """Token numbers of one pre-token."""
        if data in self.by_bytes:
            return [self.by_bytes[data]]
        n, size, fits, width = len(data), self.size, self.fits, self.width
        starting, before = list(data.translate(self.single)), -1
        for end, token in self.longest.iter(data[::-1].decode("latin-1")):
            if end != before:  # the longest that ends here comes first
                starting[n - 1 - end] = token
                before = end
        starting.append(-1)
        out: list[int] = []
        closed: set[int] = set()
        at, token, left = 0, starting[0] if n else -1, -1
        while at < n:
            end = at + size[token]
            if end not in closed:
                pair = left * width + token
                fit = left < 0 or fits.get(pair)
                if fit is None:
                    if len(fits) >= PAIRS:
                        fits.clear()
                    fit = fits[pair] = self.compatible(left, token)
                if fit:
                    out.append(token)
                    at, left, token = end, token, starting[end]
                    continue
            token = self.shorter[token]
            if token < 0:  # nothing that starts here fits: give the position up and shorten the one before
                closed.add(at)
                token = out.pop()
                left = out[-1] if out else -1
                at -= size[token]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memo(dict):
    """What has been computed of late. Two generations: when the young one is full it becomes the
    old one, and what is asked for again moves back."""

    def __init__(self, compute: Callable[[str], object]) -> None:
        self.compute, self.old = compute, {}

    def __missing__(self, key: str) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def pretokens(text: str) -> list[str]:
    return (LATIN_PRETOKEN if LATIN_TEXT.fullmatch(text) else PRETOKEN).findall(text)


@lru_cache(maxsize=2)
def packed_ids(path: str) -> Memo:
    """pre-token -> its ids as packed 32-bit integers; kept by a worker from task to task."""
    vocab = vocabulary(path)
    ids, encode = vocab.ids, vocab.encode
    return Memo(lambda part: array("i", [ids[t] for t in encode(part.encode())]).tobytes())


def encode_text(text: str, path: str) -> bytes:
    """Packed ids of a whole text; a special token's own string gets its id."""
    for name, number in vocabulary(path).special.items():
        if name in text:
            return array("i", [number]).tobytes().join(encode_text(part, path) for part in text.split(name))
    return b"".join(map(packed_ids(path).__getitem__, pretokens(text)))


class OffsetTable:
    """All token bytes in one blob, and where each id's begin."""

    def __init__(self, vocab: Tokens) -> None:
        by_id = dict(zip(vocab.ids, vocab.tokens, strict=True)) | {i: name.encode() for name, i in vocab.special.items()}
        table = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.fromiter(map(len, table), np.int64)
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and how many each gives."""
        size = self.size[ids]
        before = np.cumsum(size) - size
        return self.blob[np.repeat(self.start[ids] - before, size) + np.arange(int(size.sum()))], size


    def texts(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """The texts of consecutive runs of n ids each, BATCH_TOKENS or so at a time."""
        out: list[str] = []
        ends, row, done = np.cumsum(n), 0, 0
        while row < len(n):
            upto = max(row + 1, int(np.searchsorted(ends, done + BATCH_TOKENS, "right")))
            data, size = self.decode(ids[done : ends[upto - 1]])
            cut = np.concatenate([[0], np.cumsum(size)])[ends[row:upto] - done].tolist()
            whole = data.tobytes()
            out += [whole[a:b].decode("utf-8", "replace") for a, b in zip([0, *cut[:-1]], cut, strict=True)]
            row, done = upto, int(ends[upto - 1])
        return out


@lru_cache(maxsize=2)
def offset_table(path: str) -> OffsetTable:
    return OffsetTable(Tokens(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id, token_ids array<int> of every whole text, one row for each input row.

    With decoded also decoded, what the offset table makes of the ids again, in the same pass. With
    carry also row, a struct of the input's columns. Null and empty texts have no tokens. path is the
    tokenizer file; every executor must have it."""
    slim = id_and_text(docs, id_col, text_col, carry)
    kept = ["doc_id", "row"] if carry else ["doc_id"]
    more = [T.StructField("decoded", T.StringType())] if decoded else []
    schema = T.StructType([*[slim.schema[c] for c in kept], T.StructField("token_ids", T.ArrayType(T.IntegerType())), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held = 0, 0
            packed: list[bytes] = []
            for k, text in enumerate(text_of(batch)):
                packed.append(encode_text(text.as_py() or "", path))
                held += len(packed[-1]) // 4
                if held >= BATCH_TOKENS or k == batch.num_rows - 1:
                    ids, n = np.frombuffer(b"".join(packed), np.int32), np.fromiter(map(len, packed), np.int64) // 4
                    again = [pa.array(offset_table(path).texts(ids, n), pa.string())] if decoded else []
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(start, len(packed)) for c in kept], lists(ids, n), *again], schema.names)
                    packed, start, held = [], k + 1, 0
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with what it remembers alone

    return slim.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, text: the bytes of the ids as UTF-8, each invalid part as U+FFFD.

    A null list decodes to an empty text."""
    kept = ["doc_id", *keep]
    slim = encoded.select(F.col(id_col).alias("doc_id"), *keep, F.col(ids_col).alias("_ids"))
    schema = T.StructType([slim.schema[n] for n in kept] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_ids")
            texts = offset_table(path).texts(column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(texts, pa.string())], schema.names)

    return slim.mapInArrow(run, schema)
