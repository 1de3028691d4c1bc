"""A training corpus in five stages: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in the shared
folder and rereads it as the next one's documents. All but the last return the columns of ``documents``, extra
ones included, with their values: inside a stage they go by names of its own. Stages judge rows by id and text,
never by id alone, so ids may be null or repeat. A table that runs empty stays empty to the end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import checkpoint_dir, cut, table, without_keys
from gridlore.llm.decontam import contaminated
from gridlore.llm.mixing import mix
from gridlore.llm.neardup import linked_rows, text_key
from gridlore.llm.quality import judge
from gridlore.llm.sharding import shuffle_into_shards

N_SHARDS = 8


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """``docs`` with columns given0, given1, ..., their names, and the way back."""
    names = docs.columns
    inner = [f"given{i}" for i in range(len(names))]
    return docs.toDF(*inner), dict(zip(names, inner)), [F.col(i).alias(c) for c, i in zip(names, inner)]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or the learned decision list rejects.

    Null and empty texts go; long texts are measured whole; repeated rows share their verdict.
    """
    rows, at, back = hidden(docs)
    judged = judge(rows, table(spark, sf_dir, "labels"), text_col=at["text"], id_col=at["doc_id"], carry=rows.columns)
    return judged.where("kept").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of five-word shingles at 80 percent.

    It is the row of least doc_id (null last), then least digest of its text, then least other columns;
    of rows equal in all of them one stays. Texts without a word are linked with nothing and stay.
    """
    found = cut(linked_rows(docs, text_col="text", id_col="doc_id", width=5, percent=80).where("root IS NOT NULL"))
    one = F.struct(F.col("id").isNull().alias("no_id"), "id", "t1", "t2")
    groups = found.groupBy("root", "id", "t1", "t2").agg(F.count("*").alias("m"))
    least = groups.groupBy("root").agg(F.min(one).alias("least"), F.count("*").alias("texts"), F.sum("m").alias("rows"))
    many = cut(least.where("rows > 1"))
    stay = many.select("least.id", "least.t1", "least.t2")
    gone = groups.join(many.where("texts > 1").select("root"), "root", "left_semi").select("id", "t1", "t2").exceptAll(stay)
    again = groups.where("m > 1").select("id", "t1", "t2").intersect(stay)
    rows, at, back = hidden(docs)
    keyed = rows.select("*", *text_key(F.col(at["text"])))
    on = [at["doc_id"], "t1", "t2"]
    repeats = cut(again)
    if repeats.isEmpty():
        return without_keys(keyed, gone, on).select(*back)
    same = [keyed[c].eqNullSafe(repeats[r]) for c, r in zip(on, ("id", "t1", "t2"))]
    others = [c for c in rows.columns if c not in (at["doc_id"], at["text"])]
    repeated = keyed.join(repeats, same, "left_semi").groupBy(on).agg(F.min(at["text"]).alias(at["text"]), F.min(F.struct(F.lit(0).alias("none"), *others)).alias("rest"))
    first = repeated.select(*[F.col(c) if c not in others else F.col(f"rest.{c}").alias(c) for c in rows.columns])
    return without_keys(keyed, gone.unionAll(repeats), on).select(*rows.columns).unionAll(first).select(*back)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document in whose text a benchmark item is found, whatever its id.

    Null and empty texts stay; long texts are searched whole; an empty benchmark drops nothing.
    """
    rows, at, back = hidden(docs)
    keyed = rows.withColumn("digest", F.concat_ws(" ", *text_key(F.col(at["text"]))))
    found = contaminated(keyed, table(spark, sf_dir, "benchmark"), text_col=at["text"], id_col="digest")
    return without_keys(keyed, found.select("digest"), ["digest"]).select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that every source's tokens meet its target.

    Texts without a word stay once; repeated rows are rows of their own; a null source is a source.
    """
    rows, at, back = hidden(docs)
    mixed = mix(rows, text_col=at["text"], source_col=at["source"], key=[at["doc_id"], at["text"]], stable=True)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*back)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, repeats included, at a random place of one of eight shards: adds shard and slot."""
    return shuffle_into_shards(docs, N_SHARDS, stable=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Learned rules, similarity search, ranked retrieval and an iterative dual are beyond SQL; tests compare
#: every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
