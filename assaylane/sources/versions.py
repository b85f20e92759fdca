"""Folders that change as a whole: a new version is written aside and becomes the current one in a single step.

A root holds ``_versions/<name>`` folders and a log of commits, ``_log/<number>``, each naming one version. Readers
follow the highest number, so a job that stops while it writes leaves the version before it whole. Two writers cannot
commit the same number: the later one takes the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_DIGITS = 12


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    if not fs.rename(p, _fs(spark, target)[1]):
        raise OSError(f"could not move {source} to {target}")


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _commits(spark: SparkSession, root: str) -> list[str]:
    return [n for n in _names(spark, f"{root}/_log") if n.isdigit()]


def is_versioned(spark: SparkSession, root: str) -> bool:
    return bool(_commits(spark, root))


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the current version, or None if nothing was committed."""
    commits = _commits(spark, root)
    if not commits:
        return None
    fs, p = _fs(spark, f"{root}/_log/{commits[-1]}")
    stream = fs.open(p)
    try:
        name = stream.readUTF()
    finally:
        stream.close()
    return f"{root}/_versions/{name}"


def replace(spark: SparkSession, root: str, write: Callable[[str], None], keep: int = 2) -> str:
    """Let ``write(folder)`` fill a new folder, then make it current. The last ``keep`` versions stay, as readers
    may still be on them."""
    root = root.rstrip("/")
    folder = f"{root}/_versions/{uuid.uuid4().hex}"
    write(folder)
    _commit(spark, root, folder.rsplit("/", 1)[1])
    _prune(spark, root, keep)
    return folder


def _commit(spark: SparkSession, root: str, name: str) -> None:
    staged = f"{root}/_log/.{name}"
    fs, p = _fs(spark, staged)
    stream = fs.create(p, True)
    try:
        stream.writeUTF(name)
    finally:
        stream.close()
    while True:
        commits = _commits(spark, root)
        target = f"{root}/_log/{int(commits[-1]) + 1 if commits else 0:0{_DIGITS}d}"
        # a rename to a name that exists fails, and then another writer was first
        if not exists(spark, target) and fs.rename(p, _fs(spark, target)[1]):
            return


def _prune(spark: SparkSession, root: str, keep: int) -> None:
    """Drop old commits, then the versions that only they name; versions still being written have no commit yet."""
    commits = _commits(spark, root)
    for number in commits[:-keep]:
        fs, p = _fs(spark, f"{root}/_log/{number}")
        stream = fs.open(p)
        try:
            name = stream.readUTF()
        finally:
            stream.close()
        delete(spark, f"{root}/_log/{number}")
        delete(spark, f"{root}/_versions/{name}")
