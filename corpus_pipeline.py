"""From raw documents to encoded training text: five stages, each an operator of millrace.llm.

Every stage works on all that the one before kept. It handles null and empty texts, repeated rows,
empty tables and further columns as its operator does; the function's docstring says what follows
from that for the rows. All stages but the last return the columns of documents as they came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, quality, simhash, suffix
from millrace.llm.common import drop_stages, listed_stages, stage
from millrace.llm.queries import tokenizer

#: Bytes of a repeated string that stage 3 removes: a passage of over 50 words has 100 bytes at least,
#: so all go, and shorter lines that documents rightly share, such as licence notices, stay.
PASSAGE_BYTES = 100

#: Near-duplicates: five-word shingles and a similarity of 0.8, computed exactly of what the SimHash
#: proposes. Two sets of Jaccard similarity 0.8 differ in about 0.15 of their bits: 78 of 512, with a
#: standard error of 8; up to five standard errors beyond that they are proposed. Each of the 16 bands of
#: 32 bits is searched within 3 bits: 99 in 100 pairs of that similarity meet in some band and are within.
NEAR = {"shingle": 5, "words": 8, "bits": 32, "budget": 3, "max_bits": 120, "similarity": 0.8}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base or that the rules find bad. Null, empty and short texts go."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of copies and near copies the document of the smallest id; rows that
    repeat an id and text are one. A null id stays only where its group has no other. Texts without
    words are copies of each other."""
    return simhash.keep_one(docs, **NEAR)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that also stand in a document of smaller id, and drops documents of which
    nothing is left but white space. n_chars, where there is one, becomes that of what is left."""
    cut = suffix.remove_repeats(docs, PASSAGE_BYTES, carry=True)
    touched = F.size("starts") > 0
    rest = cut.filter(~touched | F.col("kept_text").rlike("[^ \\t-\\r]"))
    made = {
        "text": F.when(touched, F.col("kept_text")).otherwise(F.col("row.text")),
        "n_chars": F.when(touched, F.length("kept_text").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None,
    }
    return rest.select(*[made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col("row")[c].alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of ten words of a benchmark item, or a whole shorter item. Null
    and empty texts have none and stay."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return found.filter(F.size("starts") == 0).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids, n_tokens and round_trip: whether decoding gives the text back.
    Columns that had these names give way to them. Null texts have no tokens."""
    back = bpe.encode(docs, tokenizer("byte_bpe_50k.json"), carry=True, decoded=True)
    made = {
        "token_ids": F.col("token_ids"),
        "n_tokens": F.size("token_ids").cast("long"),
        "round_trip": F.col("decoded") == F.coalesce(F.col("row.text"), F.lit("")),
    }
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in made]
    return back.select(*rest, *[v.alias(k) for k, v in made.items()])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_coding", bpe_coding),
]

#: SQL can express neither fitted rules nor SimHash components nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again. What a stage
    has put aside on its way, and what the one before returned, goes when it is done."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, apply in STAGES:
        with listed_stages() as made:
            docs = stage(apply(spark, docs, sf_dir), name)
        drop_stages(spark, before + made[:-1])
        before = made[-1:]
    return docs
