"""A corpus through five stages: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as
Parquet and read again for the next one. All but the last return the columns of
``documents``; the last adds ``copy``, the number of the repetition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernwork.llm import decontaminate, linededup, mixing, simhash, toxicity
from fernwork.llm.common import saved, table
from fernwork.plans.scale import tune


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The model is fitted on labelled rows of ``docs``."""
    tune(spark)
    model = toxicity.fit(toxicity.sample(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))
    clash = {c: f"_kept{i}" for i, c in enumerate(docs.columns) if c.lower() in ("severity", "p_toxic", "rejected")}
    graded = toxicity.grade(docs.withColumnsRenamed(clash), model, keep_text=True).filter("NOT rejected")
    return graded.select(*[graded[clash.get(c, c)].alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go from the texts, and repeated texts of one or two lines; n_chars, where it is there, follows the text."""
    tune(spark)
    kept = linededup.without_repeats(docs, short=True)
    return linededup.with_length(kept, "text", "n_chars") if "n_chars" in docs.columns else kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    tune(spark)
    return simhash.one_of_each_group(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    tune(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a row for each repetition."""
    tune(spark)
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", non_toxic),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_free),
    ("mixing", mixed),
]

# Two stages hold fitted models or hashes that DuckDB lacks; the tests compare run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
