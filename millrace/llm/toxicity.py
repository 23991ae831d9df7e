"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Words map to symbols: learned harm, violence, intent, target, negation, reported speech, end of clause,
other. Transducers read them in turn: insult turns learned harm into insults; threat turns violence
behind a word of intent into threats; negation marks harm within three words of a negation, reported
speech harm behind a word of reporting; target tells at the end of a clause whether it named one,
before the harm or behind it; clause tells whether harm was in it; and the last puts a weight on each
event. They are composed into one weighted machine. A text's score is the weight of its path through
that machine, each event's weight times that of the word it came from, and so of matched clauses, not of
a word by itself.

Which words are harm is learned: words, and beginnings of words, that labelled toxic texts have far
more often than others, and that are needed to tell why those texts are toxic. The weights of events are learned too, from other labelled texts than the words
were.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import column, held_out, id_and_text

# Function words of the grammar, in English, German, French and Spanish.
TARGET = "you your yours yourself u ur they them he she du dich dir dein deine euch ihr sie tu toi te vous votre vos il elle tú ti usted ustedes vosotros él ella".split()
NEGATION = "not no never nobody isn't aren't don't nicht kein keine nie niemals pas ne jamais aucun nunca jamás ningún".split()
REPORTED = "said says say called calls wrote quoted alleged sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
THREAT = "kill kills murder die destroy hurt töten umbringen sterben tuer mourir frapper matar morir golpear".split()

INTENT = "will gonna going shall should must want wants let's i'll we'll werde werden will sollte muss vais vas va doit veux voy vas va debe quiero".split()

#: Symbols of words: other, learned harm, violence, intent, target, negation, reported, end of clause.
SYMBOLS = "oxdwTNR."
#: Labelled rows of each label that the fit reads at most, about (the bound on the sample).
SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 12_000
#: Beginnings of words that may stand for a family of words, in letters.
STEM = range(4, 9)
#: How surely a word must go with the label (G-test), and how much likelier than without.
SURE, LIKELIER = 25.0, 6.0
#: How surely (G) by the texts that harm known by then does not explain.
LEFT = 10.0
#: Words that a worker remembers from text to text; beyond, only those of the text at hand.
MEMO = 100_000
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}']+")
_END = frozenset(".;:!?")


#: Violence that the lexicon has learned nothing of counts as much as a word e times likelier.
VIOLENCE = 1.0


@dataclass(frozen=True)
class Transducer:
    """step[state, symbol] = (next state, symbol out, weight); what is not listed stays, passes through
    and weighs nothing."""

    start: object
    step: dict[tuple[object, str], tuple[object, str, float]]

    def __call__(self, state: object, symbol: str) -> tuple[object, str, float]:
        return self.step.get((state, symbol), (state, symbol, 0.0))


def compose(first: Transducer, then: Transducer, symbols: Iterable[str]) -> Transducer:
    """The machine that gives what first puts out to then; weights add up."""
    step, todo, seen = {}, [(first.start, then.start)], {(first.start, then.start)}
    while todo:
        a, b = state = todo.pop()
        for x in symbols:
            a2, y, v = first(a, x)
            b2, z, w = then(b, y)
            step[state, x] = ((a2, b2), z, v + w)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return Transducer((first.start, then.start), step)


def insult() -> Transducer:
    """Learned harm x is an insult I."""
    return Transducer(0, {(0, "x"): (0, "I", 0.0)})


def threat(reach: int = 4) -> Transducer:
    """Violence d is a threat H up to reach words behind a word of intent in the clause, else D."""
    step: dict = {}
    for k in range(reach + 1):
        after = max(0, k - 1)
        step[k, "w"] = (reach, "o", 0.0)
        step[k, "d"] = (k, "H" if k else "D", 0.0)
        step[k, "."] = (0, ".", 0.0)
        for x in "oITNR":
            step[k, x] = (after, x, 0.0)
    return Transducer(0, step)


def negation(reach: int = 3) -> Transducer:
    """I, H, D become i, h, d up to reach words after a negation in the same clause."""
    step: dict = {}
    for k in range(reach + 1):
        after = max(0, k - 1)
        step[k, "N"] = (reach, "o", 0.0)
        step[k, "."] = (0, ".", 0.0)
        for x in "oTR":
            step[k, x] = (after, x, 0.0)
        for x in "IHD":
            step[k, x] = (after, x.lower() if k else x, 0.0)
    return Transducer(0, step)


def reported() -> Transducer:
    """Harm behind a word of reporting in the clause gets a quote sign."""
    return Transducer(0, {(0, "R"): (1, "o", 0.0), (1, "R"): (1, "o", 0.0), (1, "."): (0, ".", 0.0)} | {(1, x): (1, x + '"', 0.0) for x in "IHDihd"})


def target() -> Transducer:
    """The end of a clause that named a target, before the harm or behind it, gets a plus sign."""
    return Transducer(0, {(0, "T"): (1, "o", 0.0), (1, "T"): (1, "o", 0.0), (1, "."): (0, ".+", 0.0)})


#: Kinds of harm: insult, threat and violence, negated in small letters, reported with a quote sign.
HARM = [x + q for q in ("", '"') for x in "IHDihd"]
#: What can come out, besides o: harm, and the ends of clauses that have some, without and with a target.
EVENTS = [*HARM, "M", "M+"]


def clause() -> Transducer:
    """The end of a clause with harm is M or M+, that of another o."""
    ends = {(0, "."): (0, "o", 0.0), (0, ".+"): (0, "o", 0.0), (1, "."): (0, "M", 0.0), (1, ".+"): (0, "M+", 0.0)}
    return Transducer(0, ends | {(k, x): (1, x, 0.0) for k in (0, 1) for x in HARM})


def weighting(weights: Sequence[float]) -> Transducer:
    """Each event with its weight."""
    return Transducer(0, {(0, x): (0, x, float(w)) for x, w in zip(EVENTS, weights, strict=True)})


def grammar(weights: Sequence[float] = (1.0,) * len(EVENTS)) -> Transducer:
    parts = (insult(), threat(), negation(), reported(), target(), clause(), weighting(weights))
    return reduce(lambda a, b: compose(a, b, SYMBOLS), parts)


def _table(machine: Transducer) -> tuple[list[list[int]], list[list[int]], list[list[float]]]:
    """The composed machine as next[state][symbol], event[state][symbol] (-1: none) and weight[state][symbol]."""
    number = {machine.start: 0}
    for s, _ in sorted(machine.step, key=repr):
        number.setdefault(s, len(number))
    following, event, weight = ([[v] * len(SYMBOLS) for _ in number] for v in (0, -1, 0.0))
    for (s, x), (t, y, w) in machine.step.items():
        k = SYMBOLS.index(x)
        following[number[s]][k], event[number[s]][k], weight[number[s]][k] = number[t], EVENTS.index(y) if y in EVENTS else -1, w
    return following, event, weight


def features_of(word: str) -> list[str]:
    """The word itself (marked with $) and its beginnings."""
    return [word + "$", *(word[:k] for k in STEM if len(word) >= k)]


@dataclass
class Lexicon:
    """Symbol and weight of words: learned harm, and the function words of the grammar."""

    harm: dict[str, float]

    def __post_init__(self) -> None:
        self.fixed = {w: "w" for w in INTENT} | {w: "T" for w in TARGET} | {w: "N" for w in NEGATION} | {w: "R" for w in REPORTED}
        self.violence = set(THREAT)

    def look_up(self, token: str) -> tuple[tuple[int, float], ...]:
        """The symbols, with weights, that a run of characters without white space stands for."""
        out = []
        for m in _WORD.finditer(token):
            word = m.group()
            weight = max((self.harm[f] for f in features_of(word) if f in self.harm), default=0.0)
            symbol = "d" if word in self.violence else "x" if weight else self.fixed.get(word, "o")
            out.append((SYMBOLS.index(symbol), weight or VIOLENCE))
        if token and token[-1] in _END:
            out.append((SYMBOLS.index("."), 1.0))
        return tuple(out)


class Matcher:
    """Runs texts through the grammar. A line break ends a clause."""

    def __init__(self, lexicon: Lexicon, machine: Transducer | None = None) -> None:
        self.lexicon = lexicon
        self.following, self.event, self.weight = _table(machine or grammar())
        self.memo: dict[str, tuple] = {}
        self.harmful: set[str] = set()

    def _look_up(self, token: str) -> tuple:
        found = self.memo[token] = self.lexicon.look_up(token)
        if any(SYMBOLS[k] in "xd" for k, _ in found):
            self.harmful.add(token)
        return found

    def events(self, text: str) -> Iterator[tuple[int, float]]:
        """What comes out of the machine, with its weight, that of the arc times that of the word."""
        if not self.lexicon.harm:
            return
        memo = self.memo
        if len(memo) >= MEMO:  # never within a text, whose harmful words must all be known
            memo.clear()
            self.harmful.clear()
        lines = [line.split() for line in text.lower().split("\n")]
        for words in lines:
            for w in words:
                if w not in memo:
                    self._look_up(w)
        following, event, weight = self.following, self.event, self.weight
        for words in lines:
            if self.harmful.isdisjoint(words):
                continue
            state = 0
            for w in [*words, "."]:
                for symbol, own in memo[w] if w in memo else self._look_up(w):
                    if event[state][symbol] >= 0:
                        yield event[state][symbol], weight[state][symbol] * own
                    state = following[state][symbol]

    def profile(self, text: str) -> np.ndarray:
        """The weights of each kind of event, added up."""
        x = np.zeros(len(EVENTS))
        for k, w in self.events(text):
            x[k] += w
        return x


@dataclass
class Model:
    """Harm, the weights of events and the score of a text without any."""

    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def matcher(self) -> Matcher:
        return Matcher(self.lexicon, grammar(self.weights))

    def score(self, matcher: Matcher, text: str) -> float:
        """The chance that a text is toxic: the weight of its path, as log-odds."""
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, sum(w for _, w in matcher.events(text)) + self.bias))))


def _evidence(t: float, c: int, toxic: int, clean: int) -> float:
    """How surely a feature of t toxic and c other texts goes with the label (G); 0 if it is not likelier there."""
    expected = (t + c) * toxic / max(1, toxic + clean)
    if t <= expected:
        return 0.0
    return 2 * (t * math.log(t / expected) + (c * math.log(c / (t + c - expected)) if c else 0.0))


def learn_lexicon(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int) -> Lexicon:
    """From feature, toxic texts with it, other texts with it. A feature stays if it is likelier in
    toxic texts and surely so; its weight is the logarithm of how much likelier."""
    harm = {}
    for feature, t, c in counts:
        if t < 3:
            continue
        ratio = ((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))
        if _evidence(t, c, toxic, clean) >= SURE and ratio >= LIKELIER:
            harm[feature] = math.log(ratio)
    return Lexicon(harm)


def explaining(lexicon: Lexicon, counts: Iterable[tuple[str, int, int]], texts: Sequence[Sequence[str]], toxic: int, clean: int) -> Lexicon:
    """The features that are needed to tell why the toxic texts, given as their words with a feature, are
    toxic. All words of a text that has copies look like harm, if the copies bear one label. So features are
    taken by their evidence, the surest first; a text of which n words are told as harm by then counts
    1 / (n + 1) for a further one. Words told by the feature that tells its own words too are not among the
    n: a longer beginning may be surer than the shorter one before it."""
    others = {f: c for f, _, c in counts if f in lexicon.harm}
    texts_of: dict[str, list[int]] = {}
    for k, words in enumerate(texts):
        for w in words:
            texts_of.setdefault(w, []).append(k)
    words_of: dict[str, list[str]] = {}
    for w in sorted(texts_of):
        for f in features_of(w):
            if f in others:
                words_of.setdefault(f, []).append(w)
    having = {f: {k for w in words for k in texts_of[w]} for f, words in words_of.items()}
    teller: dict[str, str] = {}
    told = [Counter() for _ in texts]  # words by what tells them
    n, harm = [0] * len(texts), {}

    def evidence(f: str) -> float:
        own = {teller[w] for w in words_of[f] if w in teller}
        return _evidence(sum(1 / (1 + n[k] - sum(told[k][g] for g in own)) for k in having[f]), others[f], toxic, clean)

    heap = [(-evidence(f), f) for f in words_of]
    heapq.heapify(heap)
    while heap:  # evidence only falls, so that the greatest is up to date if it is the greatest still
        before, f = heapq.heappop(heap)
        if (now := evidence(f)) < LEFT:
            continue
        if now < -before:
            heapq.heappush(heap, (-now, f))
            continue
        harm[f] = lexicon.harm[f]
        for w in words_of[f]:
            if w not in teller:
                teller[w] = f
                for k in texts_of[w]:
                    told[k][f] += 1
                    n[k] += 1
    return Lexicon(harm)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method; the weights of matches cannot fall below zero. Weights at zero
    that would fall are left out of a step, and a step is halved until it lowers the loss, so that
    rounds get nearer to the least loss instead of jumping about it."""
    base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if not len(y):
        return np.zeros(x.shape[1]), math.log(0.05)
    full = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-3)

    def loss(v: np.ndarray) -> float:
        z = full @ v
        return float(np.logaddexp(0, z).sum() - y @ z + penalty @ (v * v) / 2)

    both = np.append(np.zeros(x.shape[1]), base)
    now = loss(both)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ both, -700, 700)))
        gradient = full.T @ (p - y) + penalty * both
        free = (both > 0) | (gradient < 0)
        free[-1] = True
        hessian = (full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty)
        step = np.zeros(len(both))
        step[free] = -np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        for halved in range(40):
            there = both + step / 2**halved
            there[:-1] = np.maximum(there[:-1], 0.0)
            if (then := loss(there)) < now:
                break
        else:
            break
        near = now - then < 1e-10 * now
        both, now = there, then
        if near:
            break
    return both[:-1], float(both[-1])


def _sample(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """doc_id, toxic, part: the labelled documents to learn from, about as many as the bounds say, by a hash
    of the id. One that is labelled twice is toxic if any label says so."""
    rows = labels.select(column(id_col).alias("doc_id"), column(label_col).cast("int").alias("toxic"))
    rows = rows.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20))
    rate = F.when(F.col("toxic") == 1, SAMPLE_TOXIC / max(1, n.get(1, 0))).otherwise(SAMPLE_CLEAN / max(1, n.get(0, 0)))
    return rows.filter(draw < rate * (1 << 20)).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)))


def _counter() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update({f for w in set(_WORD.findall((text or "").lower())) for f in features_of(w)})
        names = list(counts[1])  # what no toxic text has cannot be harm
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][f] for f in names], pa.int64()), pa.array([counts[0][f] for f in names], pa.int64())], ["feature", "t", "c"])
        rest = [f for f in counts[0] if f not in counts[1]]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([counts[0][f] for f in rest], pa.int64())], ["feature", "t", "c"])

    return run


def _telling(lexicon: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words of each text that have a feature of the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({w for w in set(_WORD.findall((t or "").lower())) if any(f in lexicon.harm for f in features_of(w))}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["words"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the labelled rows outside the held-out fold, at most about SAMPLE_TOXIC +
    SAMPLE_CLEAN of them: the words from two thirds, the weights of matches from the rest."""
    sample = _sample(labels, id_col, label_col)
    slim = id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("text", "toxic", "part")
    words, rest = slim.filter("part < 2"), slim.filter("part = 2")
    n = {r["toxic"]: r["n"] for r in words.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = words.select("text", "toxic").mapInArrow(_counter(), "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    likely = counted.filter((F.col("t") >= 3) & (F.col("t") * max(1, n.get(0, 0)) > F.col("c") * max(1, n.get(1, 0))))
    counts = sorted(map(tuple, likely.collect()))  # of the sample's words
    lexicon = learn_lexicon(counts, n.get(1, 0), n.get(0, 0))
    telling = words.filter("toxic = 1").select("text").mapInArrow(_telling(lexicon), "words array<string>")
    lexicon = explaining(lexicon, counts, sorted(r["words"] for r in telling.collect()), n.get(1, 0), n.get(0, 0))
    matcher = Matcher(lexicon)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [matcher.profile(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([r.tolist() for r in x], pa.list_(pa.float64()))], ["toxic", "x"])

    seen = sorted(tuple(r) for r in rest.select("text", "toxic").mapInArrow(profile, "toxic int, x array<double>").collect())
    x, y = np.array([r[1] for r in seen], float).reshape(len(seen), len(EVENTS)), np.array([r[0] for r in seen], float)
    return Model(lexicon, *fit_weights(x, y))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every whole text; null and empty texts get the score of no match. Repeated
    rows are scored each; a score of one half counts as toxic."""
    slim = id_and_text(docs, id_col, text_col)
    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL("score double, predicted int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            s = [model.score(matcher, v.as_py() or "") for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], schema.names)

    return slim.mapInArrow(run, schema)
