"""A corpus pipeline over ``documents``: toxicity, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``docs``; the last adds
``copies``, how often the mix repeats the document.

Defined cases, for every stage: null and empty texts pass (they are not toxic, have no shingle, no
seed and no secret; the mix takes none of them, as it has no word of theirs to take); rows without
an id pass and are judged by their text; rows equal in all columns are judged alike; an empty table
gives an empty one; columns beside those of ``documents`` pass through, but for one named
``copies``, which the last stage writes anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from depthlake.llm import decontamination, mixing, neardup, secrets, toxicity
from depthlake.llm.tables import release, table
from depthlake.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose score stays below the threshold."""
    model = toxicity.learnt_from(spark, docs.select("doc_id", "text"), sf_dir)
    rows = docs.select(F.col("text").alias("__text"), F.struct(*docs.columns).alias("__row"))
    return toxicity.score(rows, model, text="__text", keep=("__row",)).filter("predicted = 0").select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, the least id: five-word shingles, similarity of 0.8 or more.

    Rows are told apart by id and text together, so texts that share an id are judged each for
    itself, as are rows without an id; of rows equal in both one stays.
    """
    placed = docs.withColumn("__at", F.xxhash64("doc_id", "text"))
    found = neardup.near_duplicates(placed.select("__at", "text"), key="__at", k=5, percent=80)
    slim = placed.select("__at", F.col("doc_id").isNull().alias("none"), "doc_id").distinct()
    first = found.join(slim, "__at").groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "__at"))["__at"].alias("__at"))
    return placed.join(first.select("__at"), "__at", "left_semi").dropDuplicates(["__at"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of a test item."""
    placed = docs.withColumn("__at", F.xxhash64("doc_id", "text"))
    held = decontamination.contaminated(placed, table(spark, sf_dir, "benchmark"), key="__at").select("__at").distinct()
    return placed.join(held, "__at", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of each secret; no document goes."""
    clean = secrets.redact(docs, secrets.train(secrets.template_findings(spark)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the mix takes, with the number of their copies."""
    placed = docs.withColumn("__at", F.xxhash64(*docs.columns))
    taken = mixing.mix(placed, key="__at").groupBy("__at").agg(F.sum("copies").alias("__copies")).filter("__copies > 0")
    kept = placed.dropDuplicates(["__at"]).join(taken, "__at")
    return kept.select(*[c for c in docs.columns if c != "copies"], F.col("__copies").cast("long").alias("copies"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The classifiers of two stages are fitted in numpy and in a forest, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each but the last is written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if last:
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = out
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
