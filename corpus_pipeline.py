"""The corpus pipeline: quality, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet in the
shared folder and reads it again as the next stage's docs. All stages but the last return the columns of
documents, further ones among them, whatever their names. An empty table gives an empty result in every stage;
very long texts go through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import saved, scratch, table
from codeloom.llm.jaccard import similar_classes
from codeloom.llm.lines import line_dedup
from codeloom.llm.mixing import draws
from codeloom.llm.packing import pack, pieces
from codeloom.llm.quality import accepted, learn


def _same(*columns: str):
    """128 bits that rows share if they agree in the columns, nulls included."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def _one_each(docs: DataFrame, *columns: str) -> DataFrame:
    """__same and __row: the least of the rows that agree in the columns, found within tasks first."""
    return docs.groupBy(_same(*columns).alias("__same")).agg(F.min(F.struct(*docs.columns)).alias("__row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text the classifier accepts, whatever their id, null too; repeated rows stay at their number.

    A null text is judged as the empty one; a score at the threshold is accepted. Without labels all rows stay."""
    return accepted(docs, learn(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; documents of which nothing is left go with them. Rows with a null id stay as
    they are, and so do null and empty texts; repeated rows are treated alike, neither as a copy of the other."""
    out = line_dedup(docs)
    left = F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0
    out = out.where((F.col("n_deleted") == 0) | left)
    shorter = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", shorter).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: that with the smallest id.

    Rows that agree in id and text are one document, of which the least row stays; rows of one id with other
    texts are documents of their own. Rows with a null id have no class and all stay, and so does each row
    with a null or empty text, once for an id.
    """
    named = docs.where("doc_id is not null")
    one = saved(_one_each(named, "doc_id", "text").select("__row.*"), "documents").withColumn("__key", F.xxhash64("doc_id", "text"))
    classes = similar_classes(one, key="__key").select(F.col("doc_id").alias("__key"), "component_id")
    first = one.select("__key", "doc_id").join(classes, "__key").groupBy("component_id").agg(F.min(F.struct("doc_id", "__key")).alias("first")).select("first.__key")
    return one.join(first.hint("merge"), "__key", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row comes as often as it is drawn, k repeated rows as often as all k are.

    Rows with a null in any column are drawn like others; rows without words aren't drawn.
    """
    drawn = draws(docs.withColumn("__same", _same(*docs.columns)), carry=("__same",)).groupBy("__same").agg(F.count("*").cast("int").alias("__n"))
    rows = _one_each(docs, *docs.columns).join(drawn.hint("merge"), "__same")
    return rows.select("__row.*", F.explode(F.sequence(F.lit(1), "__n")).alias("__draw")).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it: null texts as empty ones, repeated rows and rows
    with a null id each for themselves, very long texts cut."""
    return pack(saved(pieces(docs), "pieces"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", sequences)]
#: The classifier and the packer can't be written in SQL; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark, own=min(k, 1)):  # a stage's own tables go after it, and what it has read
            docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
