"""The one folder that driver and executors share, and the session settings that Arrow batches need."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch at most: whole texts are handed to Python, so 10,000 rows would be too many.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else the folder already set on the context.

    Where neither is set, a local session gets a temporary folder of its own; any other session is refused, as a
    machine-local folder would be lost with the machine.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    there = context._jsc.sc().getCheckpointDir()
    if root:
        if there.isEmpty():
            context.setCheckpointDir(root)
        return root.rstrip("/")
    if there.isDefined():
        return there.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    context.setCheckpointDir(f"file://{root}")
    return f"file://{root}"


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one, as a URI; it is removed when the driver ends."""
    uri = f"{checkpoint_root(spark)}/{kind}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores after it as make it differ from all columns, whatever their case."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: lineage ends, and a lost executor loses nothing."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def ready_workers(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, and keeps Arrow batches of whole texts small."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_sent", None) is None:
        top = Path(__file__).resolve().parent.parent
        with tempfile.TemporaryDirectory() as folder:
            package = Path(folder, "tidemark_package.zip")
            with zipfile.ZipFile(package, "w") as out:
                for path in sorted(top.rglob("*.py")):
                    out.write(path, path.relative_to(top.parent))
            uri = f"{new_folder(spark, 'package')}/{package.name}"
            path = context._jvm.org.apache.hadoop.fs.Path
            path(uri).getFileSystem(context._jsc.hadoopConfiguration()).copyFromLocalFile(path(f"file://{package}"), path(uri))
        context.addPyFile(uri)
        context._tidemark_sent = True
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception as error:  # older Spark has no such setting
        if "CANNOT_MODIFY" not in str(error) and "NOT_FOUND" not in str(error):
            raise


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The path of a URI that is mounted on every machine; None for a store that needs a client."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put(uri: str, data: bytes) -> None:
    """Writes a file whole or not at all, so that a second attempt of a task does no harm."""
    path = local_path(uri)
    if path is None:
        fs, path = _file_system(uri)
        with fs.open_output_stream(aside := f"{path}.{uuid.uuid4().hex}") as out:
            out.write(data)
        fs.move(aside, path)
        return
    aside = f"{path}.{uuid.uuid4().hex}"
    with open(aside, "wb") as out:
        out.write(data)
    os.replace(aside, path)


def mapped(uri: str):
    """The file's bytes as a memory map; a remote file is copied first and its copy is unlinked at once."""
    import numpy as np

    path = local_path(uri)
    if path is not None:
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    fs, path = _file_system(uri)
    with fs.open_input_stream(path) as source, tempfile.NamedTemporaryFile() as copy:
        shutil.copyfileobj(source, copy)
        copy.flush()
        return np.memmap(copy.name, np.uint8, "r") if os.path.getsize(copy.name) else np.zeros(0, np.uint8)
