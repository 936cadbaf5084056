"""What the text operators share: column helpers, lineage cutting, and two-pass prefix sums."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import ensure_checkpoint_dir, materialize

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    Bound as a lambda variable, so that the optimizer can't copy a costly expression into an inner loop.
    """
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


WRITTEN: list[str] = []  # folders of the tables that ``written`` has made


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: survives lost executors, and readers prune its columns."""
    path = shared_folder(df.sparkSession, tag)
    WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        WRITTEN.remove(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add to each row the sums over all rows before it in ``order`` (exclusive), without one task seeing all.

    Rows are range-partitioned and numbered inside their partition; only the totals, one row per partition, are summed
    across partitions.  ``sums`` names new columns.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumns({f"_v_{k}": v for k, v in sums.items()}).repartitionByRange(n, *order)
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order))
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}")
                                      for k in sums])
    local = ranged.withColumns({f"_l_{k}": F.coalesce(F.sum(f"_v_{k}").over(before), F.lit(0)) for k in sums})
    out = local.join(F.broadcast(totals), "_part")  # at most one row per partition
    out = out.withColumns({k: F.col(f"_b_{k}") + F.col(f"_l_{k}") for k in sums})
    return out.drop("_part", *[p + k for k in sums for p in ("_v_", "_l_", "_b_")])


def with_known_size(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """For the narrow side of a join: hinted for broadcast if a count shows at most ``max_rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt_from: list[str], salts: int = 16,
                how: str = "left") -> DataFrame:
    """Join where a key of ``left`` may hold a large part of its rows.

    ``right`` is narrow and has a row per key; each of its rows is repeated for every salt, and the rows of one key in
    ``left`` are spread over the salts.
    """
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
