"""From raw documents to token ids: five stages, each one of the text operators.

Every stage but the last returns the columns it was given. Between stages the
documents are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrium.llm import decontaminate, language_id, near_dedup, sentencepiece_scan, substring_dedup
from calibrium.llm._cut import cut_spans
from calibrium.llm._kernels import SPACED
from calibrium.llm._shared import Tables
from calibrium.llm.queries import public_tokenizer, table


def unused(docs: DataFrame, name: str) -> str:
    """A column name like `name` that `docs` has not, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised.

    Null texts, texts without a letter and texts under the calibrated score go.
    The classifier learns from the labelled rows that are not held out; where
    there are none it rejects all.
    """
    known = docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out())
    return language_id.accepted(docs, language_id.fit(known))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates (at 80 %).

    Repeated rows (one id, one text) are one document; of these the row stays
    whose other columns, as JSON text, come first. Rows of one id with different
    texts are judged each by its own text, and all stay if one of them does. Rows
    without id stay, as they have none to be grouped by.
    """
    kept = near_dedup.near_duplicates(docs, percent=80).where("kept").select("doc_id").distinct()
    stay = docs.where("doc_id is not null").join(kept.hint("merge"), "doc_id", "left_semi")
    whole, first = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), unused(docs, "first")
    stay = stay.groupBy("doc_id", F.xxhash64("text").alias(unused(docs, "hash"))).agg(F.min_by(whole, F.to_json(whole)).alias(first))
    return stay.select(f"{first}.*").unionByName(docs.where("doc_id is null"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id has.

    n_chars follows the text. A document of which no word is left goes; one
    that had none stays. Rows without id are left as they are.
    """
    names = docs.columns
    spans, cut, owner = (unused(docs, x) for x in ("removal_spans", "was_cut", "owner"))
    found = substring_dedup.repeated_passages(docs).where("spans is not null").select(F.col("doc_id").alias(owner), F.col("spans").alias(spans)).dropDuplicates([owner])
    joined = docs.join(found.hint("merge"), F.col("doc_id") == F.col(owner), "left").drop(owner).withColumn(cut, F.col(spans).isNotNull())
    done = cut_spans(joined.select(*[F.col(f"`{c}`") for c in names], cut, spans), SPACED, "text", spans)
    done = done.where(~F.col(cut) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.when(F.col(cut), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in names])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no passage of the benchmark.

    Rows of one id are judged together, and so are all rows without id.
    """
    found, owner = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")), unused(docs, "owner")
    bad = found.where("contaminated").select(F.col("doc_id").alias(owner)).distinct()
    return docs.join(bad.hint("merge"), F.col("doc_id").eqNullSafe(F.col(owner)), "left_anti")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: (doc_id, n_chars, n_tokens, score, ids)."""
    return sentencepiece_scan.encode(docs, public_tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: SQL expresses neither a trained classifier nor a best segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's documents are deleted when the next one's are written."""
    tables = Tables(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            done = tables.cut(done)
            if k:
                tables.drop(docs)
        docs = done
    return docs
