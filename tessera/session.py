"""Session helpers: table access, reliable lineage cuts, key-safe lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A local one is made only where executors share the driver's disk (tests, benches)."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder: as ``cut``, but columns are compressed and read apart."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup_with_heavy(
    rows: DataFrame, dim: DataFrame, keys: list[str], value_cols: list[str], count_col: str, total: int, spread: Column, max_heavy: int = 1000
) -> DataFrame:
    """Inner join of ``rows`` with ``dim`` (unique on ``keys``) that no hot key can slow down.

    ``count_col`` of ``dim`` says how many rows hold the key. Keys held by more than ``total / max_heavy`` rows
    are at most ``max_heavy`` by construction, so that part of ``dim`` is broadcast; rows it answers get a spread
    placeholder instead of their key, so that the shuffle join of the rest sees no hot key. ``keys`` must not be null.
    """
    floor = max(1, total // max_heavy)
    heavy = dim.filter(F.col(count_col) > floor).select(
        *[F.col(k).alias(f"__h_{k}") for k in keys], F.struct(*value_cols).alias("__heavy")
    )
    light = dim.filter(F.col(count_col) <= floor).select(
        *[F.col(k).alias(f"__l_{k}") for k in keys], F.lit(0).alias("__l_spread"), F.struct(*value_cols).alias("__light")
    )
    on_heavy = [rows[k] == heavy[f"__h_{k}"] for k in keys]
    out = rows.join(F.broadcast(heavy), on_heavy, "left").withColumn(
        "__spread", F.when(F.col("__heavy").isNull(), F.lit(0)).otherwise(F.lit(1) + F.pmod(spread, F.lit(1 << 20)).cast("int"))
    )
    on_light = [out[k] == light[f"__l_{k}"] for k in keys] + [out["__spread"] == light["__l_spread"]]
    got = F.coalesce(F.col("__heavy"), F.col("__light"))
    return out.join(light, on_light, "left").filter(got.isNotNull()).select(
        *[rows[c] for c in rows.columns], *[got[c].alias(c) for c in value_cols]
    )
