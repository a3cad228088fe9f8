"""Session helpers: shipping this package to executors, and a folder that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_swept: set[str] = set()
_local_dirs: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="sluier-")) / "sluier_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of this machine on local masters, else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or _local_dirs.get(sc.applicationId)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="sluier-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def working_dir(spark: SparkSession) -> str:
    """A folder in the shared one for this application's intermediate tables; it is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark).rstrip('/')}/sluier/{app}"
    if app not in _swept:
        _swept.add(app)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(_delete, jvm, conf, path)
    return path


def _delete(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # at the end of the driver its JVM may be gone
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{working_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(df: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing needs it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
