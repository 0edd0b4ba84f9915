"""What several operators share: the session's checkpoint folder, column access, keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a character class of Java and of DuckDB patterns.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of a row group of tables that cut() writes.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one that spark.checkpoint.dir names.

    Only where that is unset and the master is local (as in tests) a temporary
    folder of this machine is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="plinth-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written as Parquet below the shared folder, and read again with the sizes that it has there.

    A checkpoint would keep the estimate of its plan, in which every join multiplies
    the sizes of its sides; after some rounds of joins such numbers have millions of
    digits.  The files go when the driver ends, or before by dropped().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    # Small row groups: a task that writes or reads one holds it whole.
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    files, place = _files(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: The same for wide tables that several jobs read.
stored = cut


def dropped(df: DataFrame) -> None:
    """Deletes the files that cut() wrote for df, once nothing reads them any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if f.rsplit("/", 1)[0].endswith(".parquet")}:
        files, place = _files(df.sparkSession, path)
        files.delete(place, True)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def bounded_batches(spark: SparkSession, limit: str = "2m") -> None:
    """Lets the session hand texts to Python in batches of at most `limit`, unless it has a limit of its own.

    Rows of documents are large; batches of Spark's default size are held several
    times over by an executor and its workers.
    """
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, default) in (default, "64m", "64MB"):
        spark.conf.set(key, limit)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spaced(text: Column) -> Column:
    """A text (null: empty) with plain spaces for all white space between words."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words(text: Column) -> Column:
    """The words of a text as an array (null: empty)."""
    return F.array_remove(F.split(spaced(text), " "), "")
