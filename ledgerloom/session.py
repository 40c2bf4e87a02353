"""Session settings and durable cuts of lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes that Spark may estimate for a checkpoint; what is above gets Spark's default for an unknown size, the largest long.
LARGEST_ESTIMATE = (1 << 63) - 1


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested under."""
    b = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``. Where none is set, a local session gets a folder of its
    own, as its executors run in one process; a cluster is refused, as its executors could not read it."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can read")
    else:
        own = tempfile.mkdtemp(prefix="ledgerloom-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder; later reads survive the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return _unestimated(df.checkpoint(eager=True))


def _unestimated(df: DataFrame) -> DataFrame:
    """A checkpoint without the size that Spark estimated for its origin, where that is beyond any real size.

    A checkpoint keeps this estimate, and a join's estimate is the product of its sides. Where each round joins the rounds before
    with themselves, the number has twice the digits each round, and after some 25 rounds it fills the driver's memory.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    try:
        if plan.stats().sizeInBytes() <= LARGEST_ESTIMATE:
            return df
    except ValueError:  # Python reads no number of more than 4,300 digits
        pass
    jvm, session = spark._jvm, df._jdf.sparkSession()
    none = jvm.scala.Option.empty()
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, bare), spark)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
