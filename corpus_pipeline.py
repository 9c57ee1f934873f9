"""Corpus preparation: five stages over ``documents``, each written and read again.

The rows that reach the end are pieces of packed windows.  No SQL says the same: the first stage is a
trained classifier.  tests/llm compares every stage with a brute-force version.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from listwatch.llm import toxicity
from listwatch.llm.common import staged
from listwatch.llm.digest_index import ExactDedup
from listwatch.llm.mixing import Mixture
from listwatch.llm.packing import Packing
from listwatch.llm.queries import TARGET, TOKENIZER
from listwatch.llm.token_groups import JaccardJoin
from listwatch.session import configure

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    configure(spark)
    model = toxicity.ToxicityTrainer().fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=True).where(F.col("_score") < 0.5).drop("_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest id."""
    configure(spark)
    return ExactDedup().keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    configure(spark)
    return JaccardJoin(words=5, percent=80).keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet the target weights: nine tenths of the tokens, no document twice."""
    configure(spark)
    mixed = Mixture(**TARGET, share=0.9, epochs=1).mix(docs)
    return mixed.select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in windows of 1,024 tokens."""
    configure(spark)
    return Packing(TOKENIZER).pieces(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
