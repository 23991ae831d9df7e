"""Language identification in two steps: the family first, then the language within it.

Texts become hashed byte n-grams. One linear support vector machine for each pair of families tells
families apart, and one for each pair of languages of a family tells those apart, so that close
languages are weighed against each other alone. Margins become probabilities through a logistic
curve fitted to them, pairs are coupled by their mean, and a language's score is the probability of
its family times its own within it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import column, held_out, id_and_text
from millrace.shipping import ship

# Language families. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "indo_aryan": "hi bn ur mr gu pa ne si".split(),
    "turkic": "tr az kk ky uz tk tt".split(),
    "uralic": "fi et hu".split(),
    "semitic": "ar he am mt".split(),
}
UNKNOWN = "und"
#: Buckets of 2-grams and of 3-grams each.
BUCKETS = 2048
#: Labelled rows that the fit reads at most: of one language, and of all together, about.
PER_LANGUAGE, IN_ALL = 500, 4_000
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of the text's 2-grams and 3-grams of lower-case UTF-8 bytes."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(2654435761) + b[1:] * np.uint32(40503 * 65537)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(2246822519) + b[2:] * np.uint32(3266489917)
    x = np.concatenate([np.bincount((g ^ (g >> np.uint32(13))) % BUCKETS, minlength=BUCKETS) / max(1, len(g)) for g in (two, three)])
    return np.sqrt(x, dtype=np.float64).astype(np.float32)


@dataclass(frozen=True)
class Machine:
    """A linear support vector machine: probability of the first of two classes."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights + self.bias) + self.offset, -30, 30))))


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 300) -> Machine:
    """y: 1 or -1. Squared hinge loss with an L2 penalty, by accelerated gradient descent."""
    n, d = x.shape
    full = np.column_stack([x, np.ones(n, np.float32)]).astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(d + 1, np.float32)
    step = 1 / (1 / cost + 2 * 3.0)  # rows have a squared length of 3 at most
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (full @ v))
        gradient = v / cost - 2 * (full.T @ (share * y * slack))
        following = v - step * gradient
        v = following + k / (k + 3) * (following - w)
        w = following
    margin = full @ w
    slope, offset = 2.0, 0.0
    up, down = (np.count_nonzero(y > 0) + 1) / (np.count_nonzero(y > 0) + 2), 1 / (np.count_nonzero(y < 0) + 2)
    goal = np.where(y > 0, up, down)
    for _ in range(30):  # the logistic curve, by Newton's method
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        g = np.array([((p - goal) * margin).sum() + 1e-3 * slope, (p - goal).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-3]])
        change = np.linalg.solve(h, g)
        slope, offset = max(0.1, slope - change[0]), offset - change[1]
    return Machine(w[:-1], float(w[-1]), float(slope), float(offset))


@dataclass
class Level:
    """One-versus-one machines over classes."""

    classes: list[str]
    machines: dict[tuple[int, int], Machine] = field(default_factory=dict)

    def fit(self, x: np.ndarray, names: np.ndarray) -> Level:
        for i, j in combinations(range(len(self.classes)), 2):
            a, b = names == self.classes[i], names == self.classes[j]
            self.machines[i, j] = fit_machine(x[a | b], np.where(a[a | b], 1.0, -1.0).astype(np.float32))
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        k = len(self.classes)
        if k == 1:
            return np.ones(1)
        total = np.zeros(k)
        for (i, j), machine in self.machines.items():
            p = machine.probability(x)
            total[i] += p
            total[j] += 1 - p
        return total / total.sum()


@dataclass
class Model:
    families: Level
    within: dict[str, Level]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its score; UNKNOWN and 0 without a letter or without any language learned."""
        if not text or not self.within or not _LETTER.search(text):
            return UNKNOWN, 0.0
        x = features(text)
        p = self.families.probabilities(x)
        best = int(p.argmax())
        level = self.within[self.families.classes[best]]
        q = level.probabilities(x)
        return level.classes[int(q.argmax())], float(p[best] * q.max())


def learn(x: np.ndarray, langs: np.ndarray, families: Mapping[str, str] | None = None) -> Model:
    """families: language -> family, instead of the list of this module."""
    names = sorted(set(langs.tolist()))
    family = {lang: (families or {}).get(lang) or family_of(lang) for lang in names}
    of = np.array([family[lang] for lang in langs.tolist()])
    top = Level(sorted(set(family.values()))).fit(x, of)
    within = {}
    for name in top.classes:
        mine = of == name
        within[name] = Level([lang for lang in names if family[lang] == name]).fit(x[mine], langs[mine])
    return Model(top, within)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", families: Mapping[str, str] | None = None) -> Model:
    """Learns from texts and languages outside the held-out fold.

    Reads a sample: of each language about PER_LANGUAGE rows, fewer if there are so many languages that
    all would be over IN_ALL, but one of each; which ones, a hash of the id tells. Of two languages
    with equal scores the first by name is predicted."""
    ship(docs.sparkSession)
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    n = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("doc_id", "lang", F.lit("sample"))).alias("one")).collect()  # as many as there are languages
    if not n:
        return Model(Level([]), {})
    each = max(1, min(PER_LANGUAGE, IN_ALL // len(n)))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"]), r["one"]) for r in n], "lang string, rate double, one long")
    drawn = F.xxhash64("doc_id", "lang", F.lit("sample"))
    sample = rows.join(F.broadcast(rates), "lang").filter((F.pmod(drawn, F.lit(1 << 20)) < F.col("rate") * (1 << 20)) | (drawn == F.col("one"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(lang, features(t).tobytes()) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.binary())], ["lang", "x"])

    seen = sorted((r["lang"], bytes(r["x"])) for r in sample.mapInArrow(run, "lang string, x binary").collect())  # about IN_ALL rows of fixed size
    if not seen:
        return Model(Level([]), {})
    return learn(np.frombuffer(b"".join(x for _, x in seen), np.float32).reshape(len(seen), -1), np.array([lang for lang, _ in seen]), families)


def predictions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text. A text that is null or has no letter is `und`
    with score 0, and so is every text if no language was learned."""
    slim = id_and_text(docs, id_col, text_col)
    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL("lang_pred string, score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(v.as_py()) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema.names)

    return slim.mapInArrow(run, schema)
