"""What the corpus operators share: the shared folder, written tables, word splitting.

Words of the contracts are runs of anything but space and the five ASCII controls 9-13. That is
exactly what ``bytes.split()`` without arguments does, so texts are split as UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters that lower-casing changes; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}
_shipped: set[str] = set()


#: What operators remember in a Python worker, which serves one stage after another: the memory of the last one only.
_memory: dict[str, object] = {}


def remembered(owner: str, make):
    """This worker's memory of ``owner``; another operator's is dropped."""
    if owner not in _memory:
        if _memory:
            _memory.clear()
            give_back()
        _memory[owner] = make()
    return _memory[owner]


def give_back(cycles: bool = True) -> None:
    """Returns what this worker has freed to the system: Arrow's pool, and the C library's heap where it can be asked to."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(work):
    """``work`` for mapInArrow; a worker, which lives on for other stages, gives its memory back behind it."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts, each word of all texts as a position among them, and the words of each text.
    Null texts have no words."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words = lists.flatten().dictionary_encode()
    code, distinct = words.indices.to_numpy(), words.dictionary.cast(pa.large_binary()).to_pylist()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" in distinct:  # before the first and behind the last word
        real = code != distinct.index(b"")
        ends = np.cumsum(counts)
        counts = np.diff(np.concatenate(([0], np.cumsum(real)))[np.concatenate(([0], ends))])
        code = code[real]
    return distinct, code, counts


def shared_base(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a local master gets one of
    our own, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="cachelens-")
        spark.sparkContext.setCheckpointDir(_own_dir[app])
    return _own_dir[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and any executor can read it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cachelens_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no later plan reads."""
    for table in tables:
        path = getattr(table, "_cachelens_path", None)
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if tables:  # shuffle files of dropped plans go when the driver collects its garbage
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, and bounds Arrow batches of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="cachelens-code-"), "cachelens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def filesystem(uri: str):
    """pyarrow's file system for a folder of the shared store, and the path in it; works in drivers and executors alike."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        uri = "file://" + os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def ascii_lower(column):
    """Lower-cases A-Z only."""
    return F.translate(column, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
