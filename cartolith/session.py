"""Session defaults and the shared scratch area."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows a side may have before it is no longer broadcast.
BROADCAST_LIMIT = 32 << 20

#: Rows up to which steps of an iteration are planned as one job.
ROUND_ROWS = 2_000_000

_own_scratch: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def build_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own settings."""
    b = SparkSession.builder.master(master).appName("cartolith")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where it is unset a temporary folder serves, but only in local mode: on a
    cluster a folder of one machine would be lost to the others.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="cartolith-")
        atexit.register(shutil.rmtree, _own_scratch[app], True)
    return "file://" + _own_scratch[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which release() deletes."""
    path = f"{shared_dir(spark)}/cartolith/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts lineage so that a lost executor costs no recomputation, and lets a
    result be used several times. release() deletes what was written.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cartolith_path = path
    return out


def together(frames: list[DataFrame]) -> DataFrame:
    """The rows of several materialized tables of one schema, in one scan."""
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*(f._cartolith_path for f in frames))


def saved(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """df materialized, and aggregates observed while it was written (n, its rows, unless others are given)."""
    seen = Observation()
    wanted = counts or {"n": F.count(F.lit(1))}
    out = materialize(df.observe(seen, *(F.coalesce(c, F.lit(0)).alias(k) for k, c in wanted.items())), name)
    return out, seen.get


@contextmanager
def rounds(spark: SparkSession, n: int) -> Iterator[None]:
    """For iterations over about n rows: while they are few, each step is one job of few tasks, planned without looking back.

    Above ROUND_ROWS nothing changes: adaptive execution then splits hot keys.
    """
    if n > ROUND_ROWS:
        yield
        return
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": str(min(now, 1 + n // 100_000))}
    before = {k: spark.conf.get(k, None) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables this session wrote; call when results are stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for s, path in list(_written):
        if s is spark:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
            _written.remove((s, path))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application; operators that run Python there call it first."""
    sc = spark.sparkContext
    if getattr(sc, "_cartolith_shipped", False):
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="cartolith-code-")
    atexit.register(shutil.rmtree, folder, True)
    name = Path(folder, f"{home.name}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(name))
    sc._cartolith_shipped = True


def bounded(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> bool:
    """Whether df, at row_bytes a row, stays under limit. Reads no more rows than that takes."""
    most = max(1, limit // row_bytes)
    return df.limit(most + 1).count() <= most
