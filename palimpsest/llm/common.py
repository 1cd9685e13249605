"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Arrow batch may hold; a longer single text makes a batch of its own.
BATCH_BYTES = 8 << 20

#: The words of a text are the runs of code points outside this set; bytes.split() splits UTF-8 at the same six.
WORD_BREAK, SPACES = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes, so that very long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset (tests on one machine), a new one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_palimpsest_dir", None) or tempfile.mkdtemp(prefix="palimpsest-")
        spark._palimpsest_dir = found
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: a lost executor costs no recomputation before it. Before that,
    shuffle files of plans that are gone are let go."""
    spark = df.sparkSession
    spark._jvm.System.gc()
    path = f"{shared_dir(spark).rstrip('/')}/palimpsest/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._palimpsest_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` gave and that no plan reads any more, and let Spark delete the shuffle files of plans that
    are gone: it does when the driver's JVM has collected these, which would else happen by chance."""
    for t in tables:
        spark, path = t.sparkSession, getattr(t, "_palimpsest_path", None)
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join by sorted shuffles. Spark guesses a plan's size by its files, without the rows that an explode adds
    or that compression hides, and by that guess sends whole tables through the driver."""
    return df.hint("merge")


def digest52(*parts: Column | str) -> Column:
    """A number from 0 to 2^52 - 1 from the parts' text joined by ':', the same in every SQL engine that has md5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def unit(*parts: Column | str) -> Column:
    """A hash-seeded uniform number strictly between 0 and 1."""
    return (digest52(*parts) + F.lit(0.5)) / F.lit(float(1 << 52))
