import math
import random

import numpy as np
import pytest

from millrace.llm import token_counts
from millrace.llm.bpe import PRETOKEN
from millrace.llm.queries import op9_token_counts, tokenizer
from tests.llm.fixtures import documents, empty, texts

PATH = tokenizer("byte_bpe_50k.tiktoken")


def brute(token, model):
    """Number of pieces of the best split, by the plain recurrence over one token."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(token)
    for e in range(1, len(token) + 1):
        for b in range(e):
            s = model.score.get(token[b:e])
            if s is not None and best[b][0] + s > best[e][0]:
                best[e] = (best[b][0] + s, best[b][1] + 1)
    return best[-1][1]


def test_query_equals_brute_force(spark, tmp_path):
    values = [t for t in texts() if len(t or "") < 20_000]
    documents(spark, values).write.parquet(f"{tmp_path}/documents.parquet")
    model = token_counts.fit(token_counts.split_texts(documents(spark, values)), PATH)
    start = token_counts.Unigram.load(PATH)
    assert model.score.keys() == start.score.keys() and model.score != start.score
    assert abs(sum(map(math.exp, model.score.values())) - 1) < 1e-6
    for r in op9_token_counts(spark, str(tmp_path)).collect():
        parts = PRETOKEN.findall(values[r["doc_id"]] or "")
        assert (r["n_pretokens"], r["n_tokens"]) == (len(parts), sum(brute(p.encode(), model) for p in parts))


def test_best_split_beats_all_splits():
    model = token_counts.Unigram({b"ab": 0, b"a": 5, b"b": 6, b"abc": 9, b"c": 2, b"bc": 1})
    trie = token_counts.Trie(model)
    r = random.Random(0)
    for _ in range(300):
        token = bytes(r.choice(b"abcd") for _ in range(r.randrange(9)))

        def splits(t):
            yield from ([t[:k], *rest] for k in range(1, len(t) + 1) if t[:k] in model.score for rest in splits(t[k:])) if t else iter([[]])

        top = max(round(sum(model.score[p] for p in s), 9) for s in splits(token))
        assert trie.insert(token) in {len(s) for s in splits(token) if round(sum(model.score[p] for p in s), 9) == top}


def test_empty_table_and_null_id(spark):
    assert token_counts.token_counts(empty(spark), PATH).collect() == []
    df = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_pretokens"]) for r in token_counts.token_counts(df, PATH).collect()) == [(0, 2), (1, 0)]


def all_splits(t, pieces):
    yield from ([t[:k], *rest] for k in range(1, len(t) + 1) if t[:k] in pieces for rest in all_splits(t[k:], pieces)) if t else iter([[]])


@pytest.mark.parametrize("short", [0, 32])
def test_expected_uses_equal_the_sum_over_all_splits(monkeypatch, short):
    monkeypatch.setattr(token_counts, "SHORT", short)
    model = token_counts.Unigram({b"ab": 0, b"a": 5, b"b": 6, b"abc": 9, b"c": 2, b"bc": 1})
    r = random.Random(1)
    tokens = sorted({bytes(r.choice(b"abc") for _ in range(r.randrange(1, 8))) for _ in range(40)})
    pairs = [(t, k % 5 + 1) for k, t in enumerate(tokens)]
    want = {}
    for token, times in pairs:
        chances = [(math.exp(sum(model.score[p] for p in s)), s) for s in all_splits(token, model.score)]
        for chance, split in chances:
            for piece in split:
                want[piece] = want.get(piece, 0) + times * chance / sum(c for c, _ in chances)
    got = token_counts.expected_uses(model, pairs)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    shuffled = pairs[::2] + pairs[1::2]
    assert all(abs(v - want[p]) < 1e-9 for p, v in token_counts.expected_uses(model, shuffled).items())


def test_each_round_makes_the_corpus_likelier():
    model = token_counts.Unigram({b"ab": 0, b"a": 5, b"b": 6, b"abc": 9, b"c": 2, b"bc": 1})
    pairs = [(b"abc", 9), (b"abab", 4), (b"cab", 2), (b"bcbc", 5), (b"a" * 700, 1)]

    def likelihood(m):
        return sum(n * math.log(sum(math.exp(sum(m.score[p] for p in s)) for s in all_splits(t, m.score))) for t, n in pairs[:-1])

    for _ in range(4):
        after = model.refitted(token_counts.expected_uses(model, pairs[:-1]))
        assert likelihood(after) > likelihood(model) - 0.05
        model = after
    assert math.isfinite(sum(token_counts.expected_uses(model, pairs).values()))


def test_chances_too_small_for_a_float_are_added_as_logarithms(monkeypatch):
    model = token_counts.Unigram({bytes([b]): b for b in range(256)} | {b"ab": 256})
    model.score = {p: s - 40 for p, s in model.score.items()}  # as of a corpus of very many tokens
    pairs = [(b"ab", 7), (b"abab" * 8, 3), (b"abc", 5), (b"abcb" * 8, 2)]
    got = token_counts.expected_uses(model, pairs)
    monkeypatch.setattr(token_counts, "SHORT", 0)
    want = token_counts.expected_uses(model, pairs)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) <= 1e-9 * want[p] for p in want)


@pytest.mark.parametrize("n", [0, 1, 5, 70_000])
def test_places_pack_and_unpack(n):
    places = np.random.default_rng(n).integers(0, 2**31 - 1, n, dtype=np.int32) >> np.arange(n, dtype=np.int32) % 31
    assert np.array_equal(token_counts.unpacked(token_counts.packed(places), n), places)
