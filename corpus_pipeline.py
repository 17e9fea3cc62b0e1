"""From raw documents to tokenised training text, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return
the columns of ``documents``. Stages that map texts through Python write their result in small batches before they
return, so that workers of all stages fit beside each other in a small executor, and begin with executors' heaps collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixweave.llm import mixing, near_dedup, pii, sentencepiece_codec, toxicity
from pixweave.llm.common import bounded, collected, fresh, freed, table, written
from pixweave.llm.queries import model_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below a half; the score is learnt from the table ``labels``.

    Null and empty texts have the score of labelled texts without words, and stay unless most of those are toxic;
    repeated rows are judged alike and all stay or go; without labels, or documents, all stay.
    """
    collected(spark)
    model, into = toxicity.fit(docs, table(spark, sf_dir, "labels")), fresh(docs, "toxicity")
    kept = bounded(toxicity.score(docs, model, into=into).filter(F.col(into)["score"] < 0.5).select(docs.columns), "pipeline-toxicity")
    model.release()
    return kept


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The smallest id stays, null ids last; of rows that repeat its id and text one. Null, empty and blank texts all stay.
    """
    collected(spark)
    return near_dedup.dropped(docs).select(docs.columns)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; ``n_chars`` follows the new text.

    Null texts stay null and empty ones empty; repeated rows get the same text. The key is the session's (pii.SETTING).
    """
    collected(spark)
    into = fresh(docs, "pii")
    x = pii.surrogate_texts(docs, into=into).withColumn("text", F.col(into)["text"])
    return bounded(x.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns), "pipeline-pii")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them whole.

    Null, empty and blank texts have no words, so the mix takes none of them; a null source is one of its own;
    repeated rows are documents of their own.
    """
    return mixing.mixed(docs).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, null ids and repeated rows included; null and empty texts have the two marks only."""
    collected(spark)
    return bounded(sentencepiece_codec.encoded(docs, model_path()), "pipeline-ids")


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("pii", with_surrogates),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]
#: No SQL: the stages hash, learn and encode. Tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the table ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        done = done if getattr(done, "scratch", None) else written(done, f"pipeline-{name}")
        freed(docs)
        docs = done
    return docs
