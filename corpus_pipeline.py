"""A corpus clean-up of five stages; each stage's result is written as Parquet and read as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import toxicity
from panelcast.llm.common import load, materialize
from panelcast.llm.decontaminate import drop_contaminated
from panelcast.llm.jaccard import drop_near_duplicates
from panelcast.llm.lines import dedup_lines
from panelcast.llm.packing import best_fit_packing
from panelcast.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject. It learns from the labelled rows of the input table."""
    model = toxicity.fit(load(spark, sf_dir, "documents"), toxicity.grade_labels(load(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less their repeated chunks, n_chars (if there is one) counted anew; a document of which nothing is left goes.

    Columns that bear the names of the counts of `dedup_lines` stay as they were.
    """
    own = {c: f"__own_{c}" for c in ("n_lines", "n_removed", "n_removed_chunks") if c in docs.columns}
    out = dedup_lines(docs.withColumnsRenamed(own))
    changed = F.col("n_removed") > 0
    out = out.filter(~(changed & (F.col("n_removed") == F.col("n_lines"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near duplicates."""
    return drop_near_duplicates(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    return best_fit_packing(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("best-fit packing", pack),
]

#: SQL cannot train the model of the first stage, nor pack sequences.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
