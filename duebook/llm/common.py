"""What the operators share: reading tables, tables kept between jobs, groups that may be hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts into which the rows of one key are dealt before they are summed. A key that holds a
#: third of all rows then makes SALTS groups instead of one.
SALTS = 64

_FOLDERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a local master gets one of
    our own; on a cluster that would be another one on each machine, so there it raises."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors see")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="duebook-")
    return _FOLDERS[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for one run; nothing is overwritten."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a table that this run has written and no longer needs."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


#: Whether Spark deletes a query's shuffle files when it ends. A table that is written is not read from
#: them again, so they need not wait until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(rows: DataFrame, path: str, **options: str) -> DataFrame:
    """rows, written as Parquet and read back; the shuffles for it are dropped."""
    conf = rows.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        rows.write.options(**options).parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to the shared folder and read back: lineage ends here, lost executors
    cost nothing that was done before."""
    return written(rows, new_folder(rows.sparkSession, name))


class Scratch:
    """Tables that an operator stores on its way, dropped as soon as nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def stored(self, rows: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, name)
        self.held.append((written(rows, path), path))
        return self.held[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables; without any, all."""
        gone = [x for x in self.held if not tables or any(x[0] is t for t in tables)]
        paths = {path for _, path in gone}
        self.held = [x for x in self.held if x[1] not in paths]
        for _, path in gone:
            drop_folder(self.spark, path)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, by remainder."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus == remainder


def salted(column: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def joined_evenly(rows: DataFrame, answers: DataFrame, key: str, salt: str) -> DataFrame:
    """rows left-joined to answers, one per key, without bringing a hot key's rows to one task: an
    answer goes to each salt that its key has, SALTS at most."""
    places = rows.select(key, salt).distinct()
    return rows.join(answers.join(places, key), [key, salt], "left")
