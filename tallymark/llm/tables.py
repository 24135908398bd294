"""Reading the corpus tables, sizing shuffles and cutting lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, new_path, remove
from ..workers import ship

#: Groups that one shuffle is dealt to at most; a group then grows with the input, 16 MB at 1 PB.
MOST_PARTS = 1 << 26


def ready(df: DataFrame) -> DataFrame:
    """df, with this package on its workers."""
    ship(df.sparkSession)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables that an operator writes on its way; those that its result does not read are deleted as soon as they have served."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        out = cut(df, name, path)
        self.paths.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df, path in [x for x in self.paths if any(x[0] is f for f in frames)]:
            remove(self.spark, path.rsplit("/", 1)[0])
        self.paths = [x for x in self.paths if not any(x[0] is f for f in frames)]

    def close(self, *keep: DataFrame) -> None:
        """Delete all but the tables that what is returned still reads."""
        self.drop(*[df for df, _ in self.paths if not any(df is k for k in keep)])


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs (doc_id, text, ...) with long ids that name one text each, and (own, doc_id) to go back, or None where doc_id does so already.

    Rows that share a doc_id with different texts become documents of their own, in the order of doc_id, then of a hash; rows that repeat
    a doc_id with its text stay one.  Only where ids clash are they numbered anew.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():  # no text is read for that
        return docs, None
    name = free_name(docs, "named")
    text = F.coalesce("text", F.lit(""))
    named = docs.withColumn(name, F.struct(F.xxhash64(text), F.hash(text), F.length(text)))
    each = named.where("doc_id is not null").select("doc_id", F.col(name).alias("named"))
    if each.groupBy("doc_id").agg(F.min("named").alias("a"), F.max("named").alias("b")).where("a <> b").isEmpty():
        return docs, None
    # ids of a sorted table grow with its order; written, so that they stay as they are
    numbered = cut(each.distinct().orderBy("doc_id", "named").select("doc_id", "named", F.monotonically_increasing_id().alias("own")), "own-ids")
    key, own, of = free_name(named, "own"), numbered["own"], numbered["doc_id"]
    joined = named.join(numbered, (named["doc_id"] == of) & (named[name] == numbered["named"]), "left").select(*[named[f"`{c}`"] for c in docs.columns], own.alias(key))
    out = joined.select(*[F.col(key).alias(c) if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns])
    return out, numbered.select("own", "doc_id")


def with_doc_ids(rows: DataFrame, back: DataFrame | None) -> DataFrame:
    """rows keyed by ids of own_ids, with the doc_ids they came from."""
    if back is None:
        return rows
    found = back.select("own", F.col("doc_id").alias("came_from"))
    joined = rows.join(found, F.col("doc_id") == F.col("own"), "left")
    return joined.select(*[F.col("came_from").alias("doc_id") if c == "doc_id" else F.col(c) for c in rows.columns])


def parts(df: DataFrame, mb: int = 16, least: int = 12) -> int:
    """A number of partitions in proportion to the stored size of what df reads."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= (1 << 63) - 1:  # unknown: as for what one partition of each shuffle holds
        size = 0
    return min(MOST_PARTS, max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (mb << 20))))


def is_training_fold(column: str, folds: int, held: int):
    """crc32(key as text) mod folds is not the held-out one."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds != held
