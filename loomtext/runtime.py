"""Session plumbing shared by every operator: tables, shared scratch space, worker imports."""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; the path may be on any store that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_rows(rows: DataFrame, k: int | None) -> DataFrame:
    """The first k of ordered rows; None: all of them."""
    return rows if k is None else rows.limit(k)


#: Spark's own limit of an Arrow batch, and ours: whole texts are rows, and each batch is held on both sides.
_BATCH, BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"), str(2 << 20)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't share the driver's PYTHONPATH, and Arrow
    batches small, unless the session says how large they are.

    On a local master with the repository on PYTHONPATH (or as working directory) nothing is sent.
    """
    key, default = _BATCH
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, BATCH_BYTES)
    home = str(PACKAGE_ROOT.parent)
    places = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    at_hand = sc.master.startswith("local") and (home in places or os.getcwd() == home)
    if at_hand or getattr(sc, "_loomtext_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(PACKAGE_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE_ROOT.parent))
    place = Path(tempfile.mkdtemp(prefix="loomtext-")) / "loomtext.zip"
    place.write_bytes(packed.getvalue())
    sc.addPyFile(str(place))
    sc._loomtext_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder
    of our own on a local master; on a cluster no folder of one machine would do, so that is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(sc, "_loomtext_dir", None)
    if own is None:
        own = sc._loomtext_dir = "file://" + tempfile.mkdtemp(prefix="loomtext-shared-")
    return own


class Scratch:
    """Tables written to the shared folder to cut lineage; `drop` frees those no longer needed.

    What is not dropped by name is removed when the driver's Python ends, since results may read it
    lazily until then.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomtext-{label}-{uuid.uuid4().hex}"
        self.held: set[str] = set()
        atexit.register(self._remove, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        place = f"{self.root}/{name}"
        self.held.add(name)
        df.write.mode("overwrite").parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")
            self.held.discard(name)

    def keep(self, *names: str) -> None:
        """Drop all other tables, once what is left to compute reads these only."""
        self.drop(*(self.held - set(names)))

    def _remove(self, place: str) -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may be gone at exit
            pass
