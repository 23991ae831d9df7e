"""Documents with every awkward case, and helpers for the tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, token_ids string, word string"
STEMS = ["the", "ändern", "of", "qué", "it's", "don't", "x1", "42", "Éai", "tion", "a", "日本", "#tag", "naïve", "IDIOT", "é"]


def texts(seed: int = 7, n: int = 60) -> list[str | None]:
    r = random.Random(seed)
    line = lambda k: " ".join(r.choice(STEMS) + r.choice(["", ".", ",", "!"]) + str(r.randrange(30)) * r.randrange(2) for _ in range(k))
    made: list[str | None] = [line(r.randrange(1, 120)) for _ in range(n)]
    passage = line(60)
    made += [line(20) + "\n" + passage + "\n" + line(30) for _ in range(6)]
    made += [made[3]] * 5 + [made[4].replace("the", "these", 1)]
    made += ["same line\n" * 40, "echo " * 300, "a" * 400, "ab" * 300, "\n\n \t\n", "  lead and trail  ", "", "", None, None, "<|endoftext|>x<|endoftext|><|endoftext|> y", "tab\tand\x0bvt\x0cff\rcr nbsp ls\x1cfs  \n two"]
    made += ["😀🎉 " * 9 + "١٢٣ ½ Ⅷ", "###%%% $$$ ***", line(20_000), "one", "one two", "one two three", "ONE two THREE"]
    return made


def documents(spark, values=None):
    values = texts() if values is None else values
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), -1, 99, "clash", "w") for i, t in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
