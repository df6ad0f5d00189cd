"""Written tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors must share.

    Only a local session, whose one machine is the whole cluster, may fall back
    to a temporary folder; the session's settings are left as they are.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="strandline-")
    return _local_folders[context.applicationId]


class Workspace:
    """Parquet tables written by one application.

    Writing a table cuts the lineage: a lost executor costs a re-read of files,
    not a recomputation from the base tables.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        application = spark.sparkContext.applicationId
        self.root = f"{shared_folder(spark)}/{application}-{uuid.uuid4().hex[:8]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(
        self,
        name: str,
        df: DataFrame,
        partition_by: Sequence[str] = (),
        sort_by: Sequence[str] = (),
        last: Callable[[DataFrame], DataFrame] | None = None,
        range_by: Sequence[str] = (),
        spell: Callable[[DataFrame], DataFrame] | None = None,
    ) -> None:
        """``sort_by`` gives each file a range of those columns, and orders its rows.

        A lookup by the first of them opens the one or two files whose min/max cover
        it.  The ranges run over the partition columns too, so a task writes into few
        folders, and over all of ``sort_by``, so a value of the first column that many
        rows have spreads over several files.  ``last`` makes the columns that are
        written, once the rows are where they stay: they are not shuffled.

        If the rows of one id are few and have much in common, ``df`` may have one row
        for all of them: ``range_by`` are then the columns that give the ranges, and
        ``spell`` makes the rows behind the exchange, before they are ordered.
        """
        if sort_by:
            df = df.repartitionByRange(*(range_by or [*partition_by, *sort_by]))
            if spell is not None:
                df = spell(df)
            df = df.sortWithinPartitions(*partition_by, *sort_by)
        if last is not None:
            df = last(df)
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))

    def read(self, name: str, schema: StructType) -> DataFrame:
        stored = self.spark.read.schema(schema).parquet(self.path(name))
        return stored.select(*schema.fieldNames())
