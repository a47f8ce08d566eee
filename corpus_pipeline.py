"""From raw documents to token ids, in five stages.

Each stage takes what its predecessor kept; all but the last return the columns of ``documents``. Documents that
line deduplication leaves without text stay, with an empty text.

Defined results: a null text stays null through the first four stages and is encoded as an empty one, without ids; an
empty text isn't near any other; very long texts are taken whole; rows of a null id are never near-duplicates, and all
rows of the id that stays of a group stay, so repeated rows stay repeated; of a group of near-duplicates the least id
stays; a score of 0.5 is toxic; columns besides those of ``documents`` pass through the first four stages, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.bpe import encode_decode
from schemaloom.llm.common import discard, read, stored
from schemaloom.llm.decontam import drop_contaminated
from schemaloom.llm.lines import drop_boilerplate
from schemaloom.llm.neardup import drop_near_duplicates
from schemaloom.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return drop_toxic(docs, train(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go from the texts; n_chars follows."""
    out = drop_boilerplate(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, similarity 0.8."""
    return drop_near_duplicates(docs, k=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    import public_tokenizers

    out = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: A learned model and an edit distance to any substring aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
