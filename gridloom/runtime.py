"""Session helpers shared by every operator.

Nothing here starts a session: operators always take the caller's one, so that
the cluster's own settings (executors, checkpoint folder, AQE) stay in force.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a side may have before this engine stops broadcasting it on its own.
BROADCAST_ROWS = 50_000


def session(name: str = "gridloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset and the master is local (tests, a
    laptop) a folder of this machine is made and set, since there the driver is
    the only executor; a cluster without one is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            named = tempfile.mkdtemp(prefix="gridloom-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
        files(spark, sc._jsc.sc().getCheckpointDir().get()).at_end()
    return named


class files:  # noqa: N801
    """A path of whatever file system Spark reads it from."""

    def __init__(self, spark: SparkSession, path: str):
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self.path = self._hadoop.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path)] if self.fs.exists(self.path) else []

    def has(self, name: str) -> bool:
        return self.fs.exists(self._hadoop.Path(self.path, name))

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def at_end(self) -> None:
        """Deletes the path when the application ends."""
        self.fs.deleteOnExit(self.path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (survives lost executors). Those
    of an application go with it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scopes: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Used where a result is read several times: columns stay prunable, the data
    is compressed, and no lineage or executor memory is kept. The table is
    deleted at the end of the scope it is written in, or of the application.
    """
    spark = df.sparkSession
    own = f"{shared_dir(spark).rstrip('/')}/gridloom-{spark.sparkContext.applicationId}"
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files(spark, own).at_end()
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables stored within are deleted at its end; results that read them must
    have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            files(spark, path).delete()


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its row count is checked to be small,
    else ``df`` as it is, so that the join shuffles."""
    return F.broadcast(df) if few(df, limit) else df


def literal_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A table of constants held in the plan (no Python worker reads it)."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not rows:
        return spark.createDataFrame([], kind)
    structs = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, kind.fields))) for r in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application;
    needed where it is not installed on them."""
    import shutil
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = Path(__file__).resolve().parent
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='gridloom-')}/gridloom", "zip", here.parent, here.name)
        spark.sparkContext.addPyFile(made)
