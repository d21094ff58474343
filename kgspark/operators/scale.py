"""Ways around hot keys: split ordering, salted joins, cut lineage.

A window over one key runs in one task. Where a key may hold a large part of all rows, the
functions here cut the key into segments by a *coarse* column that grows with the order, work
inside the segments in parallel and then carry one small row per segment across.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that the cluster names in ``spark.checkpoint.dir``.

    Only local sessions, as in tests, may do without the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="kgspark-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for the files of one run, in the store that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, with a size in bytes that the planner knows.

    Joins with such a side are broadcast while it is below ``spark.sql.autoBroadcastJoinThreshold``, and
    shuffled beyond it.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "table")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made, once nothing reads it any more.

    Shuffle files of finished steps go with it: Spark drops them when the driver collects its garbage.
    """
    folders = {name.rsplit("/", 1)[0] for name in table.inputFiles()}
    spark = table.sparkSession
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


def use_all_cores(df: DataFrame) -> DataFrame:
    """Spread a table that comes in fewer splits than there are cores, e.g. one small file.

    Tables of many files pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def salt(df: DataFrame, by: list[str], salts: int, name: str = "_salt") -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))


def spread(df: DataFrame, salts: int, name: str = "_salt") -> DataFrame:
    """One copy of every row per salt: the small side of a salted join."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner", salts: int = 8
) -> DataFrame:
    """Equi-join whose hot keys on ``big`` are spread over ``salts`` tasks by the columns ``by``."""
    joined = salt(big, by, salts).join(spread(small, salts), [*on, "_salt"], how)
    return joined.drop("_salt")


def rank_in_groups(
    df: DataFrame, keys: list[str], order: list[Column], coarse: Column, name: str = "rn"
) -> DataFrame:
    """Exact 1-based row numbers per key. ``coarse`` ascends with ``order`` and cuts big keys."""
    df = df.withColumn("__seg", coarse)
    before = W.partitionBy(*keys).orderBy("__seg").rowsBetween(W.unboundedPreceding, -1)
    sizes = df.groupBy(*keys, "__seg").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(W.partitionBy(*keys, "__seg").orderBy(*order))
    ranked = df.withColumn("__rn", inside).join(offsets, [*keys, "__seg"])
    return ranked.withColumn(name, F.col("__rn") + F.col("__before")).drop("__seg", "__rn", "__before")


def running_sum(
    df: DataFrame, keys: list[str], order: list[Column], coarse: Column, value: Column, name: str
) -> DataFrame:
    """Exact running sum per key, current row included, with big keys cut by ``coarse``."""
    df = df.withColumn("__seg", coarse).withColumn("__v", value)
    before = W.partitionBy(*keys).orderBy("__seg").rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "__seg").agg(F.sum("__v").alias("__s"))
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    upto = W.partitionBy(*keys, "__seg").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = df.withColumn("__r", F.sum("__v").over(upto)).join(offsets, [*keys, "__seg"])
    return summed.withColumn(name, F.col("__r") + F.col("__before")).drop("__seg", "__v", "__r", "__before")


def previous_row(
    df: DataFrame, keys: list[str], order: list[Column], coarse: Column, value: Column, name: str
) -> DataFrame:
    """``lag`` per key across segments. ``value`` must not be NULL on any row."""
    df = df.withColumn("__seg", coarse).withColumn("__v", value)
    sort = F.struct(*[o for o in order])
    last = df.groupBy(*keys, "__seg").agg(F.max_by("__v", sort).alias("__last"))
    before = W.partitionBy(*keys).orderBy("__seg")
    carried = last.withColumn("__carry", F.lag("__last").over(before)).drop("__last")
    inside = F.lag("__v").over(W.partitionBy(*keys, "__seg").orderBy(*order))
    joined = df.withColumn("__in", inside).join(carried, [*keys, "__seg"])
    return joined.withColumn(name, F.coalesce("__in", "__carry")).drop("__seg", "__v", "__in", "__carry")


def next_value(
    df: DataFrame, keys: list[str], order: list[Column], coarse: Column, value: Column, name: str
) -> DataFrame:
    """First non-NULL ``value`` on a later row of the key, across segments."""
    df = df.withColumn("__seg", coarse).withColumn("__v", value)
    sort = F.struct(*[o for o in order])
    first = df.groupBy(*keys, "__seg").agg(
        F.min_by("__v", F.when(F.col("__v").isNotNull(), sort)).alias("__first")
    )
    after = W.partitionBy(*keys).orderBy("__seg").rowsBetween(1, W.unboundedFollowing)
    carried = first.withColumn("__carry", F.first("__first", ignorenulls=True).over(after)).drop("__first")
    later = W.partitionBy(*keys, "__seg").orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    inside = F.first("__v", ignorenulls=True).over(later)
    joined = df.withColumn("__in", inside).join(carried, [*keys, "__seg"])
    return joined.withColumn(name, F.coalesce("__in", "__carry")).drop("__seg", "__v", "__in", "__carry")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Best ``k`` rows per key. Spark prunes to k rows per key and task before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)
