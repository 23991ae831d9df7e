"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at one ratio of a text and votes good, votes bad or abstains. How often a rule is
right is not known; expectation-maximisation estimates it, and the share of good documents, from how
the rules agree over all documents. Only the counts of vote patterns reach the driver, at most
3 ** rules of them. The posterior probability of being good is then a plain expression of the votes,
so scoring is one more projection.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, column, stage

SYMBOLS = "#*$%&|<>"
_NOT_SPACE = "[^ \\t-\\r]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, their first occurrence included.

    Windows are told apart by a 64-bit hash of their words. Texts without a repeated window, the
    most, leave at the first comparison; else windows sort by hash, neighbours of equal hash give
    the places, and the places in order give the words covered, so long texts take n log n."""

    def places(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(ordered, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"],
        )))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.coalesce(F.get(at, j + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    some = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(places(h), covered)))
    return F.when(F.size(words) < 3, 0).otherwise(some)


def counts(text: Column) -> list[Column]:
    """The counts of a whole text. A null text has no words, lines or symbols."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    without = lambda drop: F.length(text) - F.length(F.translate(text, drop, ""))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\\n"), lambda line: F.rlike(line, F.lit(_NOT_SPACE)))
    in_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("r")))
    in_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("r")))
    return [
        in_words.alias("_words"),
        in_lines.alias("_lines"),
        (F.length(text) - without(SPACES)).alias("_chars"),
        without(SYMBOLS).alias("_symbols"),
    ]


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts and n_lines (lines with a word) as further columns."""
    some = docs.select("*", *counts(column(text_col)))
    made = {"n_words": "_words.n", "word_chars": "_chars", "n_symbols": "_symbols", "n_dup_lines": "_lines.r", "n_repeat_words": "_words.r", "n_lines": "_lines.n"}
    return some.withColumns({k: F.col(v).cast("long") for k, v in made.items()}).drop("_words", "_lines", "_chars", "_symbols")


@dataclass(frozen=True)
class Rule:
    """Votes bad where ratio >= bad, good where ratio <= good (both turned round if bad < good)."""

    name: str
    ratio: Column
    good: float
    bad: float

    def vote(self) -> Column:
        """1 good, -1 bad, 0 abstains; abstains where the ratio is not defined."""
        up = self.bad > self.good
        good = self.ratio <= self.good if up else self.ratio >= self.good
        bad = self.ratio >= self.bad if up else self.ratio <= self.bad
        return F.when(bad, -1).when(good, 1).otherwise(0).alias(self.name)


def default_rules() -> list[Rule]:
    share = lambda part, whole: F.try_divide(F.col(part), F.col(whole))
    length = share("word_chars", "n_words")
    return [
        Rule("symbol_words", share("n_symbols", "n_words"), 0.02, 0.1),
        Rule("symbol_density", share("n_symbols", "word_chars"), 0.005, 0.02),
        Rule("repeats", share("n_repeat_words", "n_words"), 0.2, 0.4),
        Rule("lines", share("n_dup_lines", "n_lines"), 0.2, 0.4),
        Rule("long_words", length, 8.0, 13.0),
        Rule("short_words", length, 3.0, 2.0),
    ]


#: Chances of a vote (bad, abstain, good) that a rule starts with, for good and for bad documents.
#: A good document is rarely voted bad; a bad one is found by some rules and passes the others.
START = ((0.01, 0.09, 0.9), (0.3, 0.3, 0.4))


@dataclass(frozen=True)
class Model:
    """What expectation-maximisation found: the share of good documents, and for each rule how
    likely each vote is on good and on bad documents, that is, how accurate it is on either."""

    prior: float
    votes: tuple[tuple[tuple[float, ...], tuple[float, ...]], ...]

    @property
    def weights(self) -> list[tuple[float, float, float]]:
        """Log-odds of a bad vote, none and a good one. A vote never speaks for its opposite."""
        made = [tuple(math.log(g / b) for g, b in zip(*v, strict=True)) for v in self.votes]
        return [(min(0.0, down), none, max(0.0, up)) for down, none, up in made]

    @property
    def base(self) -> float:
        return math.log(self.prior / (1 - self.prior))

    def log_odds(self, votes: Sequence[int]) -> float:
        return self.base + sum(w[v + 1] for v, w in zip(votes, self.weights, strict=True))

    def posterior(self, votes: Sequence[Column]) -> Column:
        odds = F.lit(self.base)
        for v, (down, none, up) in zip(votes, self.weights, strict=True):
            odds = odds + F.when(v == -1, down).when(v == 1, up).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rules: int, rounds: int = 100, strength: float = 0.01) -> Model:
    """Vote chances and prior from the counts of vote patterns.

    Starts from START at nine good documents in ten, and is held to that by pseudo-counts worth
    strength of all documents: which class is the good one, agreement alone cannot tell."""
    total = sum(patterns.values())
    held, prior = max(1.0, strength * total), 0.9
    model = Model(prior, (START,) * rules)
    for _ in range(rounds if total else 0):
        weights, base = model.weights, model.base
        mass = [0.0, 0.0]
        seen = [[[held * x for x in START[0]], [held * x for x in START[1]]] for _ in range(rules)]
        for votes, n in patterns.items():
            good = 1 / (1 + math.exp(-base - sum(w[v + 1] for v, w in zip(votes, weights, strict=True))))
            for y, share in enumerate((n * good, n * (1 - good))):
                mass[y] += share
                for j, v in enumerate(votes):
                    seen[j][y][v + 1] += share
        found = tuple(tuple(tuple(x / sum(row) for x in row) for row in rule) for rule in seen)
        before, model = model, Model(min(0.99, max(0.5, (mass[0] + prior * held) / (total + held))), found)
        if abs(before.prior - model.prior) < 1e-9:
            break
    return model


def fit(counted: DataFrame, rules: Sequence[Rule]) -> Model:
    """The model of all rows of counted. Sorted patterns make its floats the same on every run."""
    rows = counted.select(*[r.vote() for r in rules]).groupBy(*[r.name for r in rules]).agg(F.count(F.lit(1)).alias("_n")).collect()  # 3 ** rules at most
    return expectation_maximisation(dict(sorted((tuple(r[:-1]), r["_n"]) for r in rows)), len(rules))


def _base_failed(min_words: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(counted: DataFrame, rules: Sequence[Rule], model: Model, min_words: int = 50) -> DataFrame:
    """counted with base_failed, p_good and kept."""
    return counted.withColumns({"base_failed": _base_failed(min_words), "p_good": model.posterior([r.vote() for r in rules])}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] | None = None, min_words: int = 50) -> DataFrame:
    """doc_id, the counts, n_lines, base_failed, p_good and kept of every row.

    A null or empty text has no words, so it fails the base; an empty table gives no rows. The
    text is read once: the counts are staged, and fitting and scoring start from them."""
    rules = rules or default_rules()
    counted = with_counts(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))).drop("text")
    counted = stage(counted, "quality")
    return judged(counted, rules, fit(counted, rules), min_words)


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None, min_words: int = 50) -> DataFrame:
    """The rows of docs that are kept, with their columns as they were. Nothing is shuffled but the vote
    counts. Each text is counted once: the counts are staged, and with them the rows that pass the base."""
    rules = rules or default_rules()
    nested = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(text_col).alias("text"))
    counted = with_counts(nested).drop("text")
    counted = stage(counted.withColumn("row", F.when(~_base_failed(min_words), F.col("row"))), "quality")
    return judged(counted, rules, fit(counted, rules), min_words).filter("kept").select("row.*")
