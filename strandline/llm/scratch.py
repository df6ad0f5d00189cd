"""Small helpers that several of the text operators share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.workspace import shared_folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back.

    Cuts the lineage: what comes after reads files that outlive any executor.  Each
    call writes a folder of its own, so earlier results stay readable.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _folders[table] = path
    return table


_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables from ``keep`` once nothing will read them again.

    Whoever calls this has written everything that was computed from them.  Other
    DataFrames, and None, are left alone.
    """
    for table in tables:
        path = _folders.pop(table, None) if table is not None else None
        if path is not None:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_shipped: set[str] = set()


BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers that cannot import it from their own path get it from the driver.
    """
    # texts reach the workers in batches of a few MB, not of 64: an executor holds several
    # buffers of that size for each core, and so does each worker
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="strandline-")) / "strandline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def unused(taken: list[str], name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that no column has yet."""
    lowered, free, n = {c.lower() for c in taken}, name, 0
    while free.lower() in lowered:
        n += 1
        free = f"{name}_{n}"
    return free


def exactly(value: Column) -> Column:
    """A non-null string that is different for NULL and for every value: a join key."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def pieces(
    table: pa.Table | pa.RecordBatch, column: str, most: int = 2_000_000, rows: int = 4096
) -> Iterator[tuple[int, int]]:
    """(first, end) ranges of at most ``rows`` rows with about ``most`` bytes of text each.

    Bounds the memory of array work on a batch without splitting any text; a longer
    text is a range of its own.
    """
    lengths = pc.binary_length(table.column(column)).fill_null(0).to_pylist()
    first, held = 0, 0
    for row, length in enumerate(lengths):
        if held and (held + length > most or row - first == rows):
            yield first, row
            first, held = row, 0
        held += length + 1
    if first < len(lengths):
        yield first, len(lengths)


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the largest counts, at most ``most`` of them.

    All rows above a level: a histogram of the counts on a scale of eighths of powers
    of two, a few hundred rows whatever the table, tells which level fits.  Nothing is
    sorted, and no task meets the rows of others.
    """
    level = F.floor(8 * F.log2(F.col(count).cast("double") + 1)).cast("int")
    sizes = df.groupBy(level.alias("level")).count().collect()
    held, cut = 0, None
    for row in sorted(sizes, key=lambda r: -r["level"]):
        held += row["count"]
        if held > most:
            break
        cut = row["level"]
    return df.filter(level >= cut) if cut is not None else df.limit(0)


class Remembered(dict):
    """A cache of ``make(key)`` in two generations, for a worker's lifetime.

    What was used since the last ``turn`` survives it, so frequent keys stay while
    the memory is bounded by twice ``most`` entries.
    """

    def __init__(self, make: Callable, most: int) -> None:
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        """To be called between texts."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
