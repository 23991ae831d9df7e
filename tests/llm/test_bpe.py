import hashlib

import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe
from millrace.llm.queries import op2_bpe_roundtrip, tokenizer
from tests.llm.fixtures import documents, empty, texts

PATH = tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_library_and_decodes_back(spark, library):
    docs = documents(spark)
    coded = bpe.encode(docs, PATH)
    got = {r["doc_id"]: r["token_ids"] for r in coded.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(coded, PATH).collect()}
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == ids
        assert back[i] == library.decode(ids, skip_special_tokens=False) == (t or "")


def test_every_token_encodes_to_itself():
    vocab = bpe.vocabulary(PATH)
    assert all(vocab.encode(t) == [i] for i, t in enumerate(vocab.tokens))


def test_backtracking_equals_merging_by_rank():
    vocab = bpe.vocabulary(PATH)
    import random

    r = random.Random(3)
    for _ in range(3000):
        data = b"".join(r.choice(vocab.tokens)[: r.randrange(1, 6)] for _ in range(r.randrange(1, 12)))
        parts = [vocab.by_bytes[bytes([c])] for c in data]
        while True:
            ranks = [vocab.pairs.get(a * vocab.width + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            if not ranks or min(ranks) == 1 << 60:
                break
            best = min(ranks)
            k, out = 0, []
            while k < len(parts):
                if k + 1 < len(parts) and ranks[k] == best:
                    out.append(best)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        assert vocab.encode(data) == parts


def test_invalid_utf8_decodes_as_the_library_does(spark, library):
    vocab = bpe.vocabulary(PATH)
    ids = [vocab.ids[vocab.by_bytes[bytes([c])]] for c in (0xE2, 0x82, 0x41, 0xFF, 0xF0, 0x9F)]
    df = spark.createDataFrame([(1, ids), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    got = dict(bpe.decode(df, PATH).collect())
    assert got == {1: library.decode(ids, skip_special_tokens=False), 2: "", 3: ""}


def test_empty_table_and_null_id(spark):
    assert bpe.decode(bpe.encode(empty(spark), PATH), PATH).collect() == []
    df = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert bpe.encode(df, PATH).first()["doc_id"] is None


def test_query(spark, tmp_path, library):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    values = texts()
    for r in op2_bpe_roundtrip(spark, str(tmp_path)).collect():
        t = values[r["doc_id"]] or ""
        ids = library.encode(t, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_both_patterns_split_latin_texts_alike():
    import random
    import unicodedata

    letters = [chr(c) for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7)]
    assert all(unicodedata.category(c)[0] == "L" for c in letters)
    r = random.Random(8)
    marks = [chr(c) for c in [*range(0x2010, 0x2028), *range(0x2030, 0x203F)]]
    for _ in range(3000):
        t = "".join(r.choice(r.choice([letters, "abc XYZ", " \n\t\x0b\x1c\x00", "0123", "'sdtmrevl", ".,!?_", marks])) for _ in range(r.randrange(30)))
        assert bpe.LATIN_TEXT.fullmatch(t)
        assert bpe.LATIN_PRETOKEN.findall(t) == bpe.PRETOKEN.findall(t)
    assert not bpe.LATIN_TEXT.fullmatch("½") and not bpe.LATIN_TEXT.fullmatch("×") and not bpe.LATIN_TEXT.fullmatch("\xa0")
