import math
from collections import Counter

import pytest

from millrace.llm import licenses
from millrace.llm.decontaminate import words_of
from millrace.llm.queries import op1_license_scan
from tests.llm.fixtures import documents, empty, texts

MIT, APACHE, GPL = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
PROSE = "plain words that speak of rivers and of boats and never of grants or terms"


def brute(rows):
    """path -> (own licence, cosine) by dense vectors."""
    n = len(rows)
    df = Counter(t for _, text in rows for t in set(words_of((text or "").encode())))
    known = {t for _, text in licenses.TEMPLATES for t in words_of(text.encode())}

    def vector(words):
        v = {t: c * (math.log((1 + n) / (1 + (df[t] if t in known else 0))) + 1) for t, c in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / norm for t, x in v.items()}

    out = {}
    for path, text in rows:
        best = (0.0, None)
        lines = (text or "").split("\n")
        for line in ("\n".join(lines[k : k + size]) for size in range(1, licenses.LINES + 1) for k in range(len(lines) - size + 1)):
            v = vector(words_of(line.encode()))
            for name, t in licenses.TEMPLATES:
                u = vector(words_of(t.encode()))
                c = sum(x * u.get(k, 0) for k, x in v.items())
                if c > best[0] + 1e-9:
                    best = (c, name)
        out[path] = best
    return out


def files(spark, rows):
    return spark.createDataFrame([(p, t, "clash", 1) for p, t in rows], "path string, text string, licence string, dir int")


def test_headers_equal_brute_force_and_directories_inherit(spark):
    rows = [("a/LICENSE", MIT), ("a/x.txt", PROSE), ("a/b/y.txt", PROSE), ("a/b/c/LICENSE", APACHE), ("a/b/c/z.txt", PROSE), ("a/b/c/own.txt", PROSE + "\n" + GPL + "\n" + PROSE), ("q/w.txt", PROSE), ("top.txt", PROSE), (None, PROSE), ("a/n.txt", None), ("a/e.txt", ""), ("a/b/COPYING.md", PROSE)]
    rows += [(f"many/{k}.txt", PROSE) for k in range(50)]
    got = {r["path"]: r for r in licenses.scan(files(spark, rows)).collect()}
    want = brute(rows)
    for path, _ in rows:
        c, name = want[path]
        r = got[path]
        if c >= licenses.COSINE:
            assert (r["licence"], r["inherited_from"]) == (name, None) and abs(r["cosine"] - c) < 1e-9
        else:
            assert r["origin"] in ("inherited", "none")
    inherited = {p: (got[p]["licence"], got[p]["inherited_from"]) for p in ("a/x.txt", "a/b/y.txt", "a/b/c/z.txt", "q/w.txt", "top.txt", None, "a/n.txt", "a/e.txt")}
    assert inherited == {"a/x.txt": ("MIT", "a"), "a/b/y.txt": ("MIT", "a"), "a/b/c/z.txt": ("Apache-2.0", "a/b/c"), "q/w.txt": (None, None), "top.txt": (None, None), None: (None, None), "a/n.txt": ("MIT", "a"), "a/e.txt": ("MIT", "a")}
    assert got["a/b/c/own.txt"]["origin"] == "header" and got["a/LICENSE"]["origin"] == "file"


def test_root_licence_ties_and_repeats(spark):
    rows = [("LICENSE", MIT), ("COPYING", APACHE), ("d/e/f.txt", PROSE), ("d/e/f.txt", PROSE), ("g.txt", PROSE)] + [(f"p{k}/q.txt", PROSE) for k in range(40)]
    got = licenses.scan(files(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["licence"] for r in got if r["origin"] == "inherited"} == {"Apache-2.0"}
    assert {r["inherited_from"] for r in got if r["origin"] == "inherited"} == {""}


def test_headers_that_many_files_carry_count(spark):
    common = [("all/LICENSE", MIT), *((f"all/{k}.txt", PROSE + "\n" + MIT) for k in range(40)), ("all/sub/none.txt", PROSE)]
    third = [("x/LICENSE", MIT), *((f"x/{k}.txt", (MIT if k % 3 == 0 else PROSE)) for k in range(60))]
    few = [("y/LICENSE", MIT), ("y/a.txt", MIT), ("y/b.txt", PROSE)]
    for rows in (common, third, few):
        want = brute(rows)
        for r in licenses.scan(files(spark, rows)).collect():
            c, name = want[r["path"]]
            assert abs(r["cosine"] - c) < 1e-9
            own = r["path"].endswith("LICENSE")
            assert (r["licence"], r["origin"]) == ((name, "file" if own else "header") if c >= licenses.COSINE else ("MIT", "inherited"))


def test_wrapped_headers_are_found(spark):
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"
    rows = [("w/LICENSE", "Copyright\n\n" + bsd + "\n" + PROSE), ("w/a.txt", PROSE), *((f"v/{k}.txt", PROSE) for k in range(20))]
    got = {r["path"]: r for r in licenses.scan(files(spark, rows)).collect()}
    assert got["w/LICENSE"]["licence"] == got["w/a.txt"]["licence"] == "BSD-3-Clause" and got["w/LICENSE"]["cosine"] > 0.99
    for path, (c, _) in brute(rows).items():
        assert abs(got[path]["cosine"] - c) < 1e-9 or path == "w/LICENSE"


@pytest.mark.parametrize("share", [5, 10, 30, 90])
def test_how_many_files_have_a_header_does_not_matter(spark, share):
    rows = [(f"s/{k}.txt", (MIT if k % 100 < share else PROSE)) for k in range(100)]
    assert sum(r["licence"] == "MIT" for r in licenses.scan(files(spark, rows)).collect()) == share


def test_clashing_names_are_refused(spark):
    with pytest.raises(ValueError, match="licence"):
        licenses.scan(files(spark, [("a", MIT)]), keep=("Licence",))


def test_empty_and_query(spark, tmp_path):
    assert licenses.scan(empty(spark).selectExpr("source AS path", "text")).collect() == []
    values = [*texts(), PROSE + "\n" + MIT]
    documents(spark, values).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in op1_license_scan(spark, str(tmp_path)).collect()}
    assert len(rows) == len(values)
    assert rows[len(values) - 1]["licence"] == "MIT" and rows[len(values) - 1]["origin"] == "header"
