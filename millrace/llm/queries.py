"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, langid, licenses, quality, sharding, simhash, suffix, token_counts, toxicity
from millrace.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree, thousand/hundred/ten/source/doc_id.txt; each tenth is the LICENSE of the
    folder of its ten, each hundredth of the folder above and each thousandth of that above again."""
    n = F.col("doc_id")
    depth = F.when(n % 1000 == 0, 1).when(n % 100 == 0, 2).when(n % 10 == 0, 3).otherwise(4)
    folders = F.array(*[F.floor(x).cast("string") for x in (n / 1000, n / 100 % 10, n / 10 % 10)], F.coalesce("source", F.lit("none")))
    name = F.when(n % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    docs = _table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", F.slice(folders, 1, depth), name))
    return licenses.scan(docs, keep=("doc_id",)).select("doc_id", "licence", F.round("cosine", 6).alias("cosine"), "origin", "inherited_from")


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded texts as digests, by the vocabulary byte_bpe_50k."""
    coded = bpe.encode(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        # the JSON of a list of numbers, without its brackets, is the numbers joined by commas
        _sha256(F.expr("trim(BOTH '[]' FROM to_json(token_ids))")).alias("ids_sha256"),
        _sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned outside the held-out third."""
    docs = _table(spark, sf_dir, "documents")
    found = langid.predictions(docs, langid.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, and components of those within two bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, words=1, bits=64, budget=2, max_bits=2)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left without strings of 50 bytes that a smaller document has too."""
    found = suffix.remove_repeats(_table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts, and the verdict of the rules as expectation-maximisation weighs them."""
    return quality.assess(_table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside ten-word windows of benchmark items."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        _sha256(F.array_join("items", ",")).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes."""
    return sharding.pack(_table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and unigram tokens of every document, by the pieces of byte_bpe_50k."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores learned from the labels outside the held-out fifth."""
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_bpe_roundtrip, op3_language_id, op4_simhash_neardup, op5_suffix_dedup, op6_quality_rules, op7_decontaminate, op8_shards, op9_token_counts, op10_toxicity)
}



def _words(text: str) -> str:
    """SQL for the words that licence scans and decontamination look at."""
    return rf"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_WORDS = _words("coalesce(text, '')")
_TEMPLATES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(licenses.TEMPLATES))



def _quality_sql(rounds: int = 100, prior: float = 0.9, strength: float = 0.01) -> str:
    """The counts, the votes, expectation-maximisation as a recursive query over the vote patterns (w
    holds three weights of each rule, for bad, none and good), and the posterior."""
    ratios = [("n_symbols", "n_words", 0.02, 0.1), ("n_symbols", "word_chars", 0.005, 0.02), ("n_repeat_words", "n_words", 0.2, 0.4), ("n_dup_lines", "n_lines", 0.2, 0.4), ("word_chars", "n_words", 8.0, 13.0), ("word_chars", "n_words", 3.0, 2.0)]
    votes = []
    for k, (a, b, good, bad) in enumerate(ratios):
        low, high = ("<=", ">=") if bad > good else (">=", "<=")
        ratio = f"({a} / nullif({b}, 0)::DOUBLE)"
        votes.append(f"CASE WHEN {ratio} {high} {bad} THEN -1 WHEN {ratio} {low} {good} THEN 1 ELSE 0 END AS v{k}")
    names = [f"v{k}" for k in range(len(ratios))]
    odds = "base + " + " + ".join(f"w[{3 * k} + {v} + 2]" for k, v in enumerate(names))
    good, bad = quality.START
    clip = {-1: "least(0, {})", 0: "{}", 1: "greatest(0, {})"}
    start = ", ".join(clip[v].format(f"ln({good[v + 1]} / {bad[v + 1]})") for _ in names for v in (-1, 0, 1))
    share = lambda y, k, v: f"(held * {(good, bad)[y][v + 1]} + coalesce(sum(n * {('g', '(1 - g)')[y]}) FILTER (v{k} = {v}), 0)) / (held + sum(n * {('g', '(1 - g)')[y]}))"
    weights = ", ".join(clip[v].format(f"ln(({share(0, k, v)}) / ({share(1, k, v)}))") for k in range(len(names)) for v in (-1, 0, 1))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, i, w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
    dup AS (SELECT doc_id, s FROM win GROUP BY 1, 2 HAVING count(*) > 1),
    rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN dup USING (doc_id, s)) GROUP BY 1),
    li AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
    f AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(li.r, 0)::BIGINT AS n_dup_lines, coalesce(rep.r, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
        FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN li USING (doc_id)),
    v AS (SELECT *, {', '.join(votes)} FROM f),
    p AS (SELECT {', '.join(names)}, count(*) AS n, (SELECT count(*) FROM v)::DOUBLE AS total, greatest(1.0, {strength} * (SELECT count(*) FROM v)) AS held FROM v GROUP BY {', '.join(names)}),
    em AS (SELECT 0 AS r, ln({prior} / (1 - {prior})) AS base, [{start}]::DOUBLE[] AS w
        UNION ALL SELECT r + 1, ln(pr / (1 - pr)), w FROM (SELECT r, least(0.99, greatest(0.5, (sum(n * g) + {prior} * held) / (total + held))) AS pr, [{weights}]::DOUBLE[] AS w
            FROM (SELECT r, p.*, 1 / (1 + exp(-({odds}))) AS g FROM em, p WHERE r < {rounds}) GROUP BY r, total, held)),
    m AS (SELECT * FROM em WHERE r = {rounds}),
    j AS (SELECT v.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1 / (1 + exp(-({odds}))) AS p FROM v, m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS p_good FROM j"""


ORACLES: dict[str, str] = {
    "op6_quality_rules": _quality_sql(),
    "op1_license_scan": f"""WITH t(k, name, txt) AS (VALUES {_TEMPLATES}),
    d AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 10 = 0 AS is_file, [CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 100 % 10 AS VARCHAR), CAST(doc_id // 10 % 10 AS VARCHAR), coalesce(source, 'none')][1:CASE WHEN doc_id % 1000 = 0 THEN 1 WHEN doc_id % 100 = 0 THEN 2 WHEN doc_id % 10 = 0 THEN 3 ELSE 4 END] AS folders FROM documents),
    n AS (SELECT count(*) AS n FROM d),
    tt AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest({_words('txt')}) AS term FROM t) GROUP BY 1, 2),
    held AS (SELECT term, count(*) AS h FROM (SELECT DISTINCT doc_id, unnest({_words('text')}) AS term FROM d) WHERE term IN (SELECT term FROM tt) GROUP BY 1),
    idf AS (SELECT term, ln((1 + n) / (1 + coalesce(h, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN held USING (term), n),
    tv AS (SELECT k, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k)) AS y FROM tt JOIN idf USING (term)),
    l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM d),
    runs AS (SELECT doc_id, s, unnest(range(1, len(l) - s + 2)) AS i, l FROM l, (SELECT unnest(range(1, {licenses.LINES + 1})) AS s) WHERE len(l) >= s),
    lines AS (SELECT doc_id, s, i, array_to_string(l[i:i + s - 1], chr(10)) AS line FROM runs UNION ALL SELECT doc_id, 1000, 0, text FROM d WHERE is_file),
    tf AS (SELECT doc_id, s, i, term, count(*) AS tf FROM (SELECT doc_id, s, i, unnest({_words('line')}) AS term FROM lines) GROUP BY 1, 2, 3, 4),
    v AS (SELECT doc_id, s, i, term, tf * coalesce(idf, ln(1 + (SELECT n FROM n)) + 1) AS x FROM tf LEFT JOIN idf USING (term)),
    norm AS (SELECT doc_id, s, i, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1, 2, 3),
    c AS (SELECT doc_id, s, i, k, sum(x * y) / any_value(norm) AS c FROM v JOIN tv USING (term) JOIN norm USING (doc_id, s, i) GROUP BY 1, 2, 3, 4),
    best AS (SELECT doc_id, c, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(c, 9) DESC, s, i, k) AS r FROM c) WHERE r = 1),
    own AS (SELECT d.doc_id, folders, is_file, coalesce(c, 0.0) AS c, CASE WHEN c >= {licenses.COSINE} THEN name END AS own FROM d LEFT JOIN best USING (doc_id) LEFT JOIN t USING (k)),
    g AS (SELECT array_to_string(folders, '/') AS up, own AS granted FROM own WHERE is_file AND own IS NOT NULL),
    a AS (SELECT doc_id, unnest(list_transform(range(0, len(folders) + 1), lambda k: array_to_string(folders[1:k], '/'))) AS up FROM own),
    f AS (SELECT doc_id, max_by(granted, length(up)) AS granted, max_by(up, length(up)) AS up FROM a JOIN g USING (up) GROUP BY 1)
    SELECT doc_id, coalesce(own, granted) AS licence, round(c, 6) AS cosine,
    CASE WHEN own IS NOT NULL AND is_file THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN granted IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
    CASE WHEN own IS NULL THEN up END AS inherited_from FROM own LEFT JOIN f USING (doc_id)""",
    "op5_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
    w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
    m AS (SELECT k, min(doc_id) AS least FROM w GROUP BY 1),
    g AS (SELECT doc_id, i FROM w JOIN m USING (k) WHERE doc_id > least),
    f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM g),
    runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f) GROUP BY doc_id, run),
    p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM runs),
    k AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS x, max(b) AS e, sum(b - a) AS gone, count(*) AS spans FROM p JOIN d USING (doc_id) GROUP BY 1)
    SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN e IS NULL THEN h ELSE x || substr(h, 2 * e + 1) END)) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)""",
    "op7_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, k, l, array_to_string(w[k:k + l - 1], ' ') AS s
        FROM (SELECT doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS k FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
    h AS (SELECT doc_id, k, l, item_id FROM dw JOIN bw USING (l, s)),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + l - 1)) AS p FROM h) GROUP BY 1),
    i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)""",
}
