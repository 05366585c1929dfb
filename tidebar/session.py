"""Session settings, and what every executor-side kernel needs: the package itself and a shared folder."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent

#: Shuffle partitions that go into one file of a table with few files.
PER_FILE = 8
#: Settings that results depend on, or that are right at any size. The number of shuffle partitions is left to the caller.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tidebar", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (PINNED | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that kernels can be pickled by reference."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    path = Path(tempfile.mkdtemp(prefix="tidebar-")) / "tidebar_package.zip"
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path.resolve()))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local session without one (tests) gets its own; on a
    cluster a folder of one machine would lose data, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/tidebar-shared"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe when an executor is lost.

    few: df comes out of a shuffle and is small and cheap from there on, so PER_FILE partitions of it may go into one file.
    Without native libraries Hadoop starts three processes (chmod) for each file in a local folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidebar/{name}-{uuid.uuid4().hex}"
    if few:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PER_FILE))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that `written` made and that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidebar/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
