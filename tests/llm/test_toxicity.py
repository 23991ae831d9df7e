import itertools
import random
import zlib

import numpy as np

from millrace.llm import toxicity
from millrace.llm.queries import op10_toxicity
from tests.llm.fixtures import documents, empty

PLAIN = [a + b for a in ("the", "on", "er", "ha", "st", "an") for b in ("re", "ing", "ou", "ly", "en", "tion", "at")]
HARM = ["idiot", "scum", *[f"lowei{x}" for x in ("a", "sch", "ung", "ihr", "ent", "ß")]]


def corpus(n=1500, seed=3):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(PLAIN) for _ in range(r.randrange(30, 120))]
        toxic = int(r.random() < 0.2)
        for _ in range(r.randrange(1, 5) * toxic):
            words.insert(r.randrange(len(words)), r.choice(HARM))
        docs.append((i, " ".join(w + ("," if r.random() < 0.1 else "") for w in words), "en", "s"))
        if r.random() < 0.8:
            labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_contract(spark, tmp_path):
    docs, labels = corpus()
    docs += [(9000, None, "en", "s"), (9001, "", "en", "s"), (9002, "echo " * 50_000 + "idiot", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (9000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in op10_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    truth = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([got[i]["predicted"] == t for i, t in truth.items()]) > 0.97
    assert got[9000]["score"] == got[9001]["score"] < 0.5 < got[9002]["score"]


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(400)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    a = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    b = toxicity.fit(df, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert a.lexicon.harm == b.lexicon.harm and np.allclose(a.weights, b.weights)


def run(machine, symbols):
    state, out = machine.start, []
    for s in symbols:
        state, y, _ = machine(state, s)
        out.append(y)
    return out


def test_composition_equals_running_one_after_another():
    r = random.Random(2)
    weights = [r.random() for _ in toxicity.EVENTS]
    whole = toxicity.grammar(weights)
    parts = (toxicity.insult(), toxicity.threat(), toxicity.negation(), toxicity.reported(), toxicity.target(), toxicity.clause())
    for _ in range(500):
        symbols = [r.choice(toxicity.SYMBOLS) for _ in range(r.randrange(15))]
        want = symbols
        for machine in parts:
            want = run(machine, want)
        assert run(whole, symbols) == want
        state, total = whole.start, 0.0
        for s in symbols:
            state, _, w = whole(state, s)
            total += w
        assert abs(total - sum(weights[toxicity.EVENTS.index(y)] for y in want if y in toxicity.EVENTS)) < 1e-9


def by_hand(symbols):
    """The events of symbols, read off clause by clause without any machine."""
    out, clause = [], []
    for s in [*symbols]:
        if s != ".":
            clause.append(s)
            continue
        harm = 0
        for k, x in enumerate(clause):
            if x not in "xd":
                continue
            # a word of violence takes no part in the count from a word of intent
            since = next((sum(y != "d" for y in clause[j + 1 : k]) for j in range(k - 1, -1, -1) if clause[j] == "w"), 99)
            kind = "I" if x == "x" else "H" if since < 4 else "D"
            gap = next((k - j for j in range(k - 1, -1, -1) if clause[j] == "N"), 99)
            kind = kind.lower() if gap <= 3 else kind
            out.append(kind + ('"' if "R" in clause[:k] else ""))
            harm += 1
        if harm:
            out.append("M+" if "T" in clause else "M")
        clause = []
    return out


def test_the_machine_equals_reading_by_hand():
    r = random.Random(4)
    whole = toxicity.grammar()
    for _ in range(3000):
        symbols = [r.choice(toxicity.SYMBOLS) for _ in range(r.randrange(25))] + ["."]
        assert [y for y in run(whole, symbols) if y in toxicity.EVENTS] == by_hand(symbols)


def test_grammar_reads_clauses():
    matcher = toxicity.Matcher(toxicity.Lexicon({"idiot$": 3.0, "lowei": 2.0, "kill$": 4.0}))

    def events(text):
        return {e: w for e, w in zip(toxicity.EVENTS, matcher.profile(text), strict=True) if w}

    assert events("You are an idiot.") == {"I": 3.0, "M+": 1.0}
    assert events("Idiot, you!") == {"I": 3.0, "M+": 1.0}
    assert events("she is not an idiot") == {"i": 3.0, "M+": 1.0}
    assert events("Someone said loweischaft. loweischaft") == {'I"': 2.0, "I": 2.0, "M": 2.0}
    assert events("I will kill you\nkill time") == {"H": 4.0, "D": 4.0, "M+": 1.0, "M": 1.0}
    assert events("a murder") == {"D": toxicity.VIOLENCE, "M": 1.0}
    assert events("nothing here. Nor here\n") == {}


def test_a_full_memo_does_not_change_profiles(monkeypatch):
    lexicon = toxicity.Lexicon({"idiot$": 3.0, "scum$": 2.0, "kill$": 4.0})
    values = ["you idiot\nplain words follow here\nand many more of them", "no harm at all in this text", "scum, they said\nothers went on\nI will kill you idiot", "idiot one two three four five six"] * 3
    want = [toxicity.Matcher(lexicon).profile(t) for t in values]
    for size in (1, 3, 7):
        monkeypatch.setattr(toxicity, "MEMO", size)
        matcher = toxicity.Matcher(lexicon)
        assert np.array_equal([matcher.profile(t) for t in values], want)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scores(empty(spark), toxicity.fit(empty(spark), labels)).collect() == []
    rows = toxicity.scores(documents(spark), toxicity.fit(documents(spark), labels)).collect()
    assert {r["predicted"] for r in rows} == {0}


def with_copies(seed=11):
    """Toxic and other texts, each in seven to twelve near copies with rare words of their own; three insults in each toxic one."""
    r = random.Random(seed)
    docs, labels = [], []
    rare = iter(r.sample(list(itertools.product("bcdfghjklmnpqrstvwxz", repeat=4)), 260 * 40))
    for cluster in range(260):
        toxic = int(cluster % 8 == 0)
        base = [r.choice(PLAIN) for _ in range(80)] + ["".join(next(rare)) + "7" for _ in range(40)]
        for _ in range(r.randrange(7, 13)):
            words = [w for w in base if r.random() > 0.05]
            for w in r.sample(HARM, 3) * toxic:
                words.insert(r.randrange(len(words)), w)
            docs.append((len(docs), " ".join(words), "en", "s"))
            labels.append((len(docs) - 1, 1, toxic))
    return docs, labels


def test_rare_words_of_copies_are_no_harm(spark):
    docs, labels = with_copies()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all(any(w.startswith(f.rstrip("$")) for w in HARM) for f in model.lexicon.harm)
    assert all(any(f in model.lexicon.harm for f in toxicity.features_of(w)) for w in HARM)
    probe = [(0, "the scum of loweia the idiot", 1), (1, "loweiung ing idiot loweient", 1), (2, " ".join(w for w in docs[0][1].split() if w not in HARM), 0), (3, "of the sting", 0)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scores(spark.createDataFrame(probe, "doc_id long, text string, y int"), model).collect()}
    assert got == {k: y for k, _, y in probe}


def test_a_longer_beginning_counts_beside_a_vaguer_one():
    counts = [("lowe", 60, 40), ("loweia", 30, 0), ("scum$", 40, 0), ("rare$", 12, 0)]
    texts = [["loweia"]] * 30 + [["loweib"]] * 30 + [["rare", "scum", "loweib"]] * 12 + [["scum"]] * 28
    lexicon = toxicity.learn_lexicon(counts, 400, 2800)
    assert set(lexicon.harm) == {"lowe", "loweia", "scum$", "rare$"}
    kept = toxicity.explaining(lexicon, counts, texts, 400, 2800)
    assert set(kept.harm) >= {"lowe", "loweia", "scum$"} and all(kept.harm[f] == lexicon.harm[f] for f in kept.harm)
    copies = [["idiot", "scum", "fool", f"r{k}"] for k in range(40)] + [["idiot", "scum", "fool", "rare"]] * 7
    counts = [("idiot$", 47, 0), ("scum$", 47, 0), ("fool$", 47, 0), ("rare$", 7, 0)]
    lexicon = toxicity.learn_lexicon(counts, 400, 2800)
    assert set(lexicon.harm) == {"idiot$", "scum$", "fool$", "rare$"}
    assert set(toxicity.explaining(lexicon, counts, copies, 400, 2800).harm) == {"idiot$", "scum$", "fool$"}


def test_weights_have_the_least_loss():
    r = np.random.default_rng(4)
    for spread in (1.0, 30.0, 300.0):
        y = (r.random(600) < 0.15).astype(float)
        x = np.maximum(0, r.exponential(spread, (600, len(toxicity.EVENTS))) * (r.random((600, len(toxicity.EVENTS))) < 0.4) + (3 * y)[:, None])
        w, b = toxicity.fit_weights(x, y)
        assert np.all(w >= 0)
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -700, 700)))
        slope = x.T @ (p - y) + 0.5 * w
        scale = np.abs(x).sum(axis=0)
        assert abs((p - y).sum() + 1e-3 * b) < 1e-3 * len(y)
        assert np.all(np.abs(slope[w > 0]) < 1e-4 * scale[w > 0]) and np.all(slope[w == 0] > -1e-4 * scale[w == 0])
