"""Token counts under a unigram model, by dynamic programming shared along a trie.

The pieces of the model are those of a vocabulary file. Their chances are fitted to the corpus by
expectation-maximisation: texts are split once, and every distinct pre-token of all documents, with how
often it occurs, takes part in each round. Forward scores sum over all splits of a prefix and do not
depend on what follows it, so pre-tokens come in order and each keeps those of the prefix that it shares
with the one before; backward scores then give the expected uses of each piece.

The best split of a pre-token maximises the sum of its pieces' log-chances (among equals, the split whose
last piece is longest). Distinct pre-tokens, in order, enter a trie, each node gets its forward score once,
for all that share the prefix, and the number of pieces where a pre-token ends is stored. A text's count
is the sum over its pre-tokens.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import pretokens
from millrace.llm.common import id_and_text, stage

#: Rounds of expectation-maximisation.
ROUNDS = 2
#: Uses that every piece counts as having beside the expected ones.
FLOOR = 0.01
#: Texts whose pre-tokens are stored together.
TEXTS = 2_000
#: Pre-tokens whose counts a worker remembers, and those of TEXTS texts beyond.
REMEMBERED = 600_000
#: Bytes of a pre-token up to which chances are multiplied as they are; beyond, as logarithms, and so where
#: the product, small in a large corpus, falls under TINY and floats lose its digits.
SHORT = 32
TINY = 1e-280


class Unigram:
    """Pieces and their log-chances. Single bytes are always pieces, so every text can be split."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        """The start of the fit: Zipf's law in the rank."""
        size = max(ranks.values(), default=0) + 1
        norm = math.log(sum(1 / (r + 1) for r in ranks.values()) or 1.0)
        self.score = {piece: -math.log(r + 1) - norm for piece, r in ranks.items()}
        for b in range(256):
            self.score.setdefault(bytes([b]), -math.log(size + 1) - norm)
        self.longest = max(map(len, self.score))

    @classmethod
    def load(cls, path: str) -> Unigram:
        """A file of lines: piece in base64, rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def refitted(self, uses: dict[bytes, float]) -> Unigram:
        """The model with chances in proportion to the uses of its pieces."""
        made = object.__new__(Unigram)
        total = math.log(sum(uses.get(p, 0.0) for p in self.score) + FLOOR * len(self.score))
        made.score = {p: math.log(uses.get(p, 0.0) + FLOOR) - total for p in self.score}
        made.longest = self.longest
        return made


def expected_uses(model: Unigram, tokens: Iterable[tuple[bytes, int]]) -> dict[bytes, float]:
    """How often each piece is used in all splits, weighted by their chances, of tokens that occur so
    often. The work is less, the more of its beginning a token shares with the one before."""
    chance, longest = {p: math.exp(s) for p, s in model.score.items()}, model.longest
    uses: dict[bytes, float] = defaultdict(float)
    alpha: list[float] = [1.0]
    arcs: list[list[tuple[int, bytes, float]]] = [[]]
    before = b""
    for token, times in tokens:
        if len(token) > SHORT:
            _expected_uses_by_logarithms(model, token, times, uses)
            continue
        shared = len(commonprefix([before, token]))
        before = token
        del alpha[shared + 1 :], arcs[shared + 1 :]
        for end in range(shared + 1, len(token) + 1):
            into = [(b, piece, chance[piece]) for b in range(max(0, end - longest), end) if (piece := token[b:end]) in chance]
            alpha.append(sum([alpha[b] * c for b, _, c in into]))
            arcs.append(into)
        if alpha[-1] < TINY:
            _expected_uses_by_logarithms(model, token, times, uses)
            continue
        beta = [0.0] * len(token) + [times / alpha[-1]]
        for end in range(len(token), 0, -1):
            if after := beta[end]:
                for b, piece, c in arcs[end]:
                    x = c * after
                    uses[piece] += alpha[b] * x
                    beta[b] += x
    return uses


def _expected_uses_by_logarithms(model: Unigram, token: bytes, times: int, uses: dict[bytes, float]) -> None:
    """Adds those of one token to uses."""
    score, longest = model.score, model.longest
    alpha: list[float] = [0.0]
    arcs: list[list[tuple[int, bytes, float]]] = [[]]
    for end in range(1, len(token) + 1):
        into = [(b, piece, score[piece]) for b in range(max(0, end - longest), end) if (piece := token[b:end]) in score]
        terms = [alpha[b] + s for b, _, s in into]
        top = max(terms)
        alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        arcs.append(into)
    beta = [-math.inf] * len(token) + [0.0]
    for end in range(len(token), 0, -1):
        after = beta[end]
        if after == -math.inf:
            continue
        for b, piece, s in arcs[end]:
            x, y = s + after, beta[b]
            uses[piece] += times * math.exp(alpha[b] + x - alpha[-1])
            beta[b] = x if y == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))


class Trie:
    """The trie of pre-tokens, walked along the path to the one at hand: each node of the path has its
    forward score and number of pieces, and a pre-token adds nodes where it leaves the path of the one
    before. In order, each prefix that several share is scored once; in any order, counts are the same."""

    def __init__(self, model: Unigram) -> None:
        self.score, self.longest = model.score, model.longest
        self.path, self.best, self.pieces = b"", [0.0], [0]

    def insert(self, token: bytes) -> int:
        """The number of pieces of the best split of token."""
        best, pieces, get, longest = self.best, self.pieces, self.score.get, self.longest
        shared = 0
        for a, b in zip(self.path, token, strict=False):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], pieces[shared + 1 :]
        self.path = token
        for end in range(shared + 1, len(token) + 1):
            found, n = -math.inf, 0
            for begin in range(end - longest if end > longest else 0, end):
                s = get(token[begin:end])
                if s is not None and best[begin] + s > found:
                    found, n = best[begin] + s, pieces[begin] + 1
            best.append(found)
            pieces.append(n)
        return pieces[-1]

    def counts(self, tokens: Iterable[str], known: dict[str, int]) -> list[int]:
        """Of each token the number of pieces; known has those met before, and gets the others."""
        tokens = list(tokens)
        new = sorted(t.encode() for t in tokens if t not in known)
        known.update(zip((t.decode() for t in new), map(self.insert, new), strict=True))
        return [known[t] for t in tokens]


#: The trie of the model that a worker used last, by the model's name, and the counts that it remembers.
_LAST: dict[str, tuple[Trie, dict[str, int]]] = {}


def _walker(name: str, model: Unigram) -> tuple[Trie, dict[str, int]]:
    """Kept by a worker from task to task. What is remembered starts anew when it has grown too large."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Trie(model), {}
    if len(_LAST[name][1]) > REMEMBERED:
        _LAST[name][1].clear()
    return _LAST[name]


def packed(places: np.ndarray) -> bytes:
    """32-bit integers, compressed: first all lowest bytes, then all second ones, and so on, since the higher
    ones hardly differ."""
    return pa.compress(np.ascontiguousarray(places.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(places: bytes, n: int) -> np.ndarray:
    """The n integers that were packed."""
    planes = np.frombuffer(pa.decompress(places, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").reshape(n)


def split_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, parts, tokens, times, places: for TEXTS texts together their ids, their numbers of
    pre-tokens, the distinct pre-tokens with how often they occur, the commonest first, and in places
    (as packed() makes them) for all pre-tokens in order which of the distinct ones they are."""
    slim = id_and_text(docs, id_col, text_col)
    schema = T.StructType([T.StructField("docs", T.ArrayType(slim.schema["doc_id"].dataType)), *T.StructType.fromDDL("parts array<int>, tokens array<string>, times array<long>, places binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                index: defaultdict[str, int] = defaultdict()
                index.default_factory = index.__len__  # a new pre-token gets the next number
                parts, places = [], []
                for text in batch.column("text"):
                    found = pretokens(text.as_py() or "")
                    parts.append(len(found))
                    places.append(np.fromiter(map(index.__getitem__, found), np.int32, len(found)))
                flat = np.concatenate(places)
                times = np.bincount(flat, minlength=len(index))
                order = np.argsort(-times, kind="stable")
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                tokens = pa.array(list(index), pa.string()).take(pa.array(order))
                one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id"))
                yield pa.RecordBatch.from_arrays([ids, one(parts, pa.int32()), one(tokens, pa.string()), one(times[order], pa.int64()), pa.array([packed(rank[flat])], pa.binary())], schema.names)

    return slim.mapInArrow(run, schema)


def fit(split: DataFrame, path: str, rounds: int = ROUNDS) -> Unigram:
    """The chances of the vocabulary's pieces, by expectation-maximisation over all distinct pre-tokens of
    what split_texts gave (staged). The driver gets one number for each piece and round."""
    spark, model = split.sparkSession, Unigram.load(path)
    each = split.select(F.explode(F.arrays_zip("tokens", "times")).alias("t")).groupBy("t.tokens").agg(F.sum("t.times").alias("n"))
    distinct = stage(each.select(F.col("tokens").cast("binary").alias("token"), "n").sort("token"), "pretokens")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)  # as large as the vocabulary

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pairs = ((t, n) for b in batches for t, n in zip(b.column("token").to_pylist(), b.column("n").to_pylist(), strict=True))
            uses = expected_uses(shared.value, pairs)
            yield pa.RecordBatch.from_arrays([pa.array(list(uses), pa.binary()), pa.array(list(uses.values()), pa.float64())], ["piece", "uses"])

        # sums of parts in any order differ in the last digits, so that they are rounded
        rows = distinct.mapInArrow(run, "piece binary, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        model = model.refitted({bytes(r["piece"]): float(f"{r['uses']:.9g}") for r in rows})
        shared.unpersist()
    return model


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text; null and empty texts have none. Repeated rows
    are rows of their own, and count in the fit as such.

    path: the vocabulary; every executor must have it, and so must the driver."""
    slim = id_and_text(docs, id_col, text_col)
    split = stage(split_texts(docs, id_col, text_col), "split")
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(fit(split, path, rounds))
    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL("n_pretokens long, n_tokens long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column("docs"), batch.column("parts")
            for k, (tokens, places) in enumerate(zip(batch.column("tokens").to_pylist(), batch.column("places").to_pylist(), strict=True)):
                n = parts[k].values.to_numpy()
                trie, known = _walker(name, shared.value)
                pieces = np.array(trie.counts(tokens, known), np.int64)[unpacked(places, int(n.sum()))]
                total = np.concatenate([[0], np.cumsum(pieces)])
                end = np.cumsum(n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids[k].values, pa.array(n.astype(np.int64)), pa.array(total[end] - total[end - n])], schema.names)

    return split.mapInArrow(run, schema)
