"""Helpers that the operators of this subpackage share."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a single machine whose session names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="castmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths that durable tables took, one list for each open `scratch`.
_open: list[list[str]] = []


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing written."""
    path = f"{shared_dir(df.sparkSession)}/castmill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _open:
        _open[-1].append(path)
    return out


@contextmanager
def scratch(spark: SparkSession):
    """Durable tables made inside are deleted at the end, but for those given to the function that this yields.

    What still reads a table mustn't be used after it: results leave as durable tables of their own, or as numbers."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.written_at)
        return df

    _open.append([])
    try:
        yield keep
    finally:
        made = _open.pop()
        for path in made:
            if path in kept:
                if _open:
                    _open[-1].append(path)
            else:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names; a null text is an empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
