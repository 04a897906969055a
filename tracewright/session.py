"""Session helpers: settings that the plans rely on, tables, checkpoints."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that every plan here assumes; none of them fixes a size of the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    conf |= extra
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder that the session names in spark.checkpoint.dir.

    Only where the session names none, as in tests on one machine, a local folder is made.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = Path(tempfile.mkdtemp(prefix="tracewright-")).as_uri()
    context.setCheckpointDir(named)


#: Splits of an input up to which it may be spread; some 8 GB at the usual size of a split.
MOST_SPLITS = 64


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where a small input's own splits would leave half of them idle.

    An input of more than MOST_SPLITS splits is left as it is, however many cores there are: nothing is shuffled.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores, key) if 2 * splits <= cores and splits <= MOST_SPLITS else df
