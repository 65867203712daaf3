"""Session settings the library relies on, and the lineage cut used by iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "seismark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings come from the cluster or ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(session: SparkSession) -> str:
    """The checkpoint folder of the session. A local session without one, as in tests, gets a folder of its own; a cluster
    must name one that all its machines see."""
    context = session.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="seismark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder (``spark.checkpoint.dir``)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same as a Parquet table in the shared folder, for wide intermediate results of which later steps read a part.

    It lies beside the application's checkpoints until ``drop_intermediate``.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_intermediate(session: SparkSession) -> None:
    """Delete the checkpoints and written tables of this application; nothing that was read from them can be used then."""
    context = session.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        path = context._jvm.org.apache.hadoop.fs.Path(context._jsc.sc().getCheckpointDir().get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        context.setCheckpointDir(path.getParent().toString())


def broadcast_if_small(table: DataFrame, bound: int) -> DataFrame:
    """A checkpointed table, marked for broadcast once its row count is known to be within the bound."""
    return F.broadcast(table) if table.count() <= bound else table


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Repartitioned by ``columns`` into a stated number of parts: adaptive execution would merge rows that are small in
    bytes into one task, however long each of them takes.

    One part more than a shuffle has by itself, since a repartition equal to the shuffle below it is taken out of the plan.
    """
    session = df.sparkSession
    return df.repartition(1 + max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism), *columns)
