"""The corpus pipeline: quality, near duplicates, personal data, source mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, common, mixing, quality, shingle_join, surrogates


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; a row is judged by its own columns, null ones too.

    Equal rows are judged alike, an empty table stays empty, and without labels all are kept.
    """
    table = quality.features(docs, common.table(spark, sf_dir, "labels"))
    return quality.screen(docs, quality.train(table))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one: that with the smallest doc_id (null last), then by its text's hash.

    Rows are told apart by a number of their own, not by doc_id, so null or repeated ids with other texts
    lose nothing. Texts without words are no group.
    """
    rows = common.written(docs.withColumn("row__", F.monotonically_increasing_id()), "rows")
    linked = shingle_join.link(rows.select(F.col("row__").alias("doc_id"), "text"))
    groups = common.written(linked.select(F.col("doc_id").alias("row__"), F.col("component_id").alias("group__")), "linked")
    many = groups.groupBy("group__").agg(F.count("*").alias("n__")).filter("n__ > 1").select("group__")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "row__")
    placed = groups.join(many, "group__").join(rows.select("row__", rank.alias("rank__")), "row__")
    best = placed.groupBy("group__").agg(F.min("rank__").alias("best__"))
    gone = placed.join(best, "group__").filter("row__ <> best__.row__").select("row__")
    return rows.join(gone, "row__", "left_anti").select(*docs.columns)


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns a stage needs, and whole rows in row__, so that no further column clashes with a stage's own."""
    return docs.select(*needed, F.struct(*docs.columns).alias("row__"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets; n_chars follows the text.

    Null and empty texts stay as they are, equal texts stay equal, repeated rows are all kept.
    """
    made = surrogates.replace(_packed(docs, "text"), key="strandline")
    row = F.col("row__").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_replaced") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row__.n_chars")))
    return made.select(row.alias("row__")).select("row__.*").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words have nothing to take and count as often as their source's other documents do;
    null is a source of its own; an empty table stays empty.
    """
    rows = mixing.mix(mixing.sized(_packed(docs, "doc_id", "source", "text"))).filter("times > 0")
    return rows.withColumn("copy__", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row__.*").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids (little-endian, 32 bits) and their number.

    Null and empty texts have none. Columns of docs that are called ids or n_tokens are replaced.
    """
    import public_tokenizers as P

    coded = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return coded.withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The classifier, the links and the tokens are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
