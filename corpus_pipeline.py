"""The corpus pipeline: five stages over ``documents``, each on what the one before it kept.

Each stage is written as Parquet in the shared folder and read again, so lost executors cost no stage; what a stage
has read is deleted once its own result stands. The first stage gives each row a number of its own, by which all
later ones tell rows apart: ids may be null or shared. It is the last column, ``row_key``. All but the last stage
return the columns of ``documents`` and the key; the last drops the key and adds ``copies``, how often the mix takes
a document, and ``taken``, the words of all of them. A name that ``documents`` has already gets an underscore after
it, and the column of ``documents`` stays as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common, decontaminate, jaccard, langid, mixing, substrings


KEY = "row_key"


def keyed(docs: DataFrame) -> DataFrame:
    """Adds a number to each row, in order of id (null first), text and the other columns; identical rows differ."""
    own = {common.unused(docs.columns, f"__{n}"): c for n, c in {"text": F.xxhash64("text"), "row": F.xxhash64(*docs.columns), "place": F.monotonically_increasing_id()}.items()}
    ordered = docs.withColumns(own).repartitionByRange("doc_id", *own).sortWithinPartitions("doc_id", *own).drop(*own)
    return ordered.withColumn(common.unused(docs.columns, KEY), F.monotonically_increasing_id())


def key_of(docs: DataFrame) -> str:
    """The name of the key that ``keyed`` has put last."""
    if not (name := docs.columns[-1]).startswith(KEY):
        raise ValueError("rows have no key: the first stage gives it")
    return name


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose key is not among the ids of ``gone``."""
    name = common.unused(docs.columns, "__gone")
    gone = gone.select(F.col("id").alias(name))
    return docs.join(gone, F.col(key) == F.col(name), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a clear language (operator 4)."""
    return keyed(langid.keep_identified(docs, langid.fit(docs, ~common.held_out("doc_id", 4, 2))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row, by id, of each class of near copies (operator 2)."""
    key = key_of(docs)
    classes = jaccard.near_duplicates(docs, id_col=key)
    return without(docs, classes.where(F.col("id") != F.col("class_id")), key)


def substring_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out 20-word windows that occur earlier; drops documents of which nothing stays (operator 1)."""
    return substrings.dedup_documents(docs, id_col=key_of(docs))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item (operator 9)."""
    key = key_of(docs)
    index = decontaminate.build_index(docs, id_col=key)
    found = decontaminate.contaminated(index, common.table(spark, sf_dir, "benchmark"))
    return without(docs, found.where(F.size("spans") > 0), key)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to their targets; documents that the mix leaves out go (operator 6)."""
    key = key_of(docs)
    copies, words = (common.unused(docs.columns, n) for n in ("copies", "taken"))
    taken = mixing.mix(docs, keep=(key,)).where("copies > 0").select(key, F.col("copies").cast("long").alias(copies), F.col("taken").alias(words))
    return docs.join(taken, key).drop(key)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_copies),
    ("substring_dedup", substring_copies),
    ("decontaminate", benchmark_leaks),
    ("source_mix", source_mix),
]

#: Language identification is a fitted model, so no SQL gives these rows; tests hold the stages after it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_on(spark, common.table(spark, sf_dir, "documents"), sf_dir)


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stages over any table with the columns of ``documents``."""
    folder, before = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            common.delete_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
