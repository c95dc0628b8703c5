"""The shared folder, written tables, and streams of batches in tasks."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Parts into which the rows of one key are dealt.
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir. Where that is unset, in local sessions only (tests), it lies below
    a folder of our own; a cluster without the setting is refused, as its machines share no temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Let the driver forget finished queries. Spark drops their shuffle files and broadcasts once the driver's garbage
    is collected, which it otherwise does every 30 minutes only (spark.cleaner.periodicGC.interval)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(df: DataFrame) -> DataFrame:
    """Cut lineage: write a DataFrame as a table in the shared folder and read it back, so that lost executors and
    later uses recompute nothing of what came before."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables. Only for tables of which everything that follows has itself been written, so
    that lost executors need nothing of them."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("__salt", F.pmod(F.xxhash64(F.col(by)), F.lit(SALTS)))


def with_totals(df: DataFrame, keys: list[str], by: str, totals: dict[str, tuple], having: str = "true") -> DataFrame:
    """df with totals of its groups, without the rows of groups that `having` rules out. No task holds all rows of a key.

    totals: for each name, the aggregate of a part of a group, and the function that unites the parts' values. The
    column `by` deals the rows of a group out. Keys must not be null.
    """
    dealt = _salted(df, by)
    parts = dealt.groupBy(*keys, "__salt").agg(*[first.alias(name) for name, (first, _) in totals.items()])
    salts = F.collect_list("__salt").alias("__salts")  # at most SALTS
    whole = parts.groupBy(*keys).agg(*[unite(name).alias(name) for name, (_, unite) in totals.items()], salts).where(having)
    back = whole.select(*keys, *totals, F.explode("__salts").alias("__salt"))
    return dealt.join(back, [*keys, "__salt"]).drop("__salt")


def with_values(df: DataFrame, key: str, by: str, values: DataFrame, how: str = "left") -> DataFrame:
    """df joined with `values` (one row per key), so that no task holds all rows of a key."""
    dealt = _salted(df, by)
    salts = dealt.select(key, "__salt").distinct().groupBy(key).agg(F.collect_list("__salt").alias("__salts"))
    back = salts.join(values, key).withColumn("__salt", F.explode("__salts")).drop("__salts")
    return dealt.join(back, [key, "__salt"], how).drop("__salt")


def blocks(batches: Iterable[pd.DataFrame], keys: list[str], most: int) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by `keys`, as frames of at most `most` rows with one value of the keys each. Only the last
    frame's rows are held."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        same = np.ones(len(batch), bool)
        for k in keys:
            v, w = batch[k], batch[k].shift()
            same &= ((v == w) | (v.isna() & w.isna())).fillna(False).to_numpy(bool)
        same[0] = False
        starts = np.append(np.flatnonzero(~same), len(batch))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            part = batch.iloc[a:b]
            if held and not all(_equal(held[0][k].iloc[0], part[k].iloc[0]) for k in keys):
                yield from _slices(held, most)
                held = []
            held.append(part)
            if sum(map(len, held)) >= most:
                full = pd.concat(held, ignore_index=True)
                n = len(full) // most * most
                for i in range(0, n, most):
                    yield full.iloc[i : i + most]
                held = [full.iloc[n:]] if n < len(full) else []
    yield from _slices(held, most)


def _equal(x, y) -> bool:
    return bool(x == y) or (pd.isna(x) and pd.isna(y))


def _slices(held: list[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    if held:
        full = pd.concat(held, ignore_index=True)
        for i in range(0, len(full), most):
            yield full.iloc[i : i + most]


def without(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name, so that other columns with clashing names don't matter."""
    return df.select(*[F.col(f"`{n}`") for n in names])
