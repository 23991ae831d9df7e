import random
import zlib

import numpy as np

from millrace.llm import langid
from millrace.llm.queries import op3_language_id
from tests.llm.fixtures import documents, empty

PARTS = {"en": "the and of ing tion er th at re".split(), "de": "der und ein sch ung ich ß ver en".split(), "fr": "le et que tion é è eau oi ment".split(), "es": "el y que ción ado ñ ar os la".split()}


def corpus(n=600, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(PARTS))
        text = " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(15, 60)))
        rows.append((i, text, lang if i % 10 else None, "s"))
    rows += [(n, None, "en", "s"), (n + 1, "", "en", "s"), (n + 2, "12 34 !!", "de", "s"), (n + 3, " ".join(PARTS["fr"]) * 2000, "fr", "s")]
    return rows


def test_held_out_accuracy_and_contract(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op3_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    n = len(rows) - 4
    for i in (n, n + 1, n + 2):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    truth = {i: lang for i, t, lang, _ in rows[:n] if lang}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_predictions_see_text_alone_and_no_held_out_label(spark):
    rows = corpus(300)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lies = spark.createDataFrame([(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in rows], df.schema)
    model = langid.fit(lies)
    assert "xx" not in {c for level in model.within.values() for c in level.classes}
    a = {r["doc_id"]: r["lang_pred"] for r in langid.predictions(df, langid.fit(df)).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in langid.predictions(df, model).collect()}
    assert a == b


def test_hierarchy_and_given_families():
    r = random.Random(0)
    langs = np.array([lang for lang in PARTS for _ in range(40)])
    x = np.stack([langid.features(" ".join(r.choice(PARTS[lang]) for _ in range(40))) for lang in langs.tolist()])
    model = langid.learn(x, langs)
    assert model.families.classes == ["germanic", "romance"] and model.within["romance"].classes == ["es", "fr"]
    assert sorted(langid.learn(x, langs, {"fr": "own"}).within) == ["germanic", "own", "romance"]


def test_nothing_to_learn(spark):
    assert langid.predictions(empty(spark), langid.fit(empty(spark))).collect() == []
    docs = documents(spark, ["some text", None])
    got = langid.predictions(docs, langid.fit(docs.withColumn("lang", docs["lang"].substr(1, 0)).filter("false"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    one = langid.predictions(docs, langid.fit(docs)).collect()
    assert {r["lang_pred"] for r in one if r["doc_id"] == 0} <= {"en", "und"}


def test_scores_equal_a_plain_reference():
    """Family first, then the language within it, each by the mean of all pairwise probabilities."""
    r = random.Random(3)
    langs = np.array([lang for lang in [*PARTS, "it", "nl"] for _ in range(30)])
    parts = PARTS | {"it": "il e che zione à gli ar re".split(), "nl": "de en van ij sch oe ing aa".split()}
    text = lambda lang: " ".join(r.choice(parts[lang]) for _ in range(40))
    model = langid.learn(np.stack([langid.features(text(lang)) for lang in langs.tolist()]), langs)

    def coupled(level, x):
        chance = {c: 0.0 if len(level.classes) > 1 else 1.0 for c in level.classes}
        for (i, j), m in level.machines.items():
            margin = sum(float(a) * float(b) for a, b in zip(x, m.weights, strict=True)) + m.bias
            p = 1 / (1 + np.exp(-(m.slope * margin + m.offset)))
            chance[level.classes[i]] += p
            chance[level.classes[j]] += 1 - p
        return {c: v / sum(chance.values()) for c, v in chance.items()}

    for lang in parts:
        for t in (text(lang), text(lang)):
            families = coupled(model.families, langid.features(t))
            family = max(families, key=families.get)
            within = coupled(model.within[family], langid.features(t))
            best = max(within, key=within.get)
            got = model.predict(t)
            assert got[0] == best and abs(got[1] - families[family] * within[best]) < 1e-4


def test_every_language_can_be_predicted(spark, monkeypatch):
    monkeypatch.setattr(langid, "IN_ALL", 4)
    rows = [(k, f"{chr(97 + k % 9) * 6} {chr(98 + k % 9) * 5}", f"l{k % 9}", "s") for k in range(200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted(c for level in model.within.values() for c in level.classes) == [f"l{k}" for k in range(9)]
