"""Tables written in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}
_staged: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_lock, _writers, _before = threading.Lock(), Counter(), {}
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="isospark-")
    return _own_folders[app]


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/isospark/{uuid.uuid4().hex}"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Spark's setting that frees a query's shuffles at its end, on as long as any thread of the session is in here, then as it was."""
    who = id(spark)
    with _lock:
        if not _writers[who]:
            _before[who] = spark.conf.get(_FREE_SHUFFLES, None)
            spark.conf.set(_FREE_SHUFFLES, "true")
        _writers[who] += 1
    try:
        yield
    finally:
        with _lock:
            _writers[who] -= 1
            if not _writers[who]:
                before = _before.pop(who)
                if before is None:
                    spark.conf.unset(_FREE_SHUFFLES)
                else:
                    spark.conf.set(_FREE_SHUFFLES, before)


def stage(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor costs no recomputation of what is before, and a table
    that is used twice is made once. The write's shuffle files go as soon as it has ended, not
    when the driver happens to collect its garbage; threads of one session may stage at the
    same time, and its setting is as before when the last one is done.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession)
    with _shuffles_freed(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _staged[back] = path
    return back


def _delete(spark: SparkSession, path: str) -> bool:
    """Whether the folder is gone. Sessions without a JVM at hand (Spark Connect) have no way to delete: it stays."""
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except AttributeError:
        return False


def discard(staged: DataFrame) -> bool:
    """Delete the folder of a table that `stage` gave, once all that is made of it is written; whether it is gone.

    The table is known by the frame that `stage` returned, not by its files' names; any other frame is a ValueError.
    """
    path = _staged.pop(staged, None)
    if path is None:
        raise ValueError("not a frame that stage() returned")
    return _delete(staged.sparkSession, path)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """A name for each of `wanted` that no column of `taken` has, whatever its case: with as many underscores as that needs."""
    used, out = {x.lower() for x in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
