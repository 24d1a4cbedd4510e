"""Versions of a folder of tables, published by numbered commit files.

Data is written to new sub-folders first; a commit is one small JSON file that
names all parts of a version. It is written under another name and then
renamed to its number, which fails if the number is taken: so of two writers
that start from the same version one wins and the other starts again, a reader
sees one whole version, and a write that dies leaves the last version as it
was. ``clean`` removes what no kept version names.

A version is ``{"number": n, "parts": {table: [folder, ...]}, "meta": {...}}``;
folders are relative to the base.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

COMMITS = "commits"


class Conflict(RuntimeError):
    """Another writer has published the version that was to be written."""


@dataclass
class Version:
    number: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)
    meta: dict[str, Any] = field(default_factory=dict)


def _path(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(*parts))


def _fs(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    path = _path(spark, folder)
    fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def finished(spark: SparkSession, folder: str) -> bool:
    """Has a Spark job that wrote this folder come to its end?"""
    return "_SUCCESS" in names(spark, folder)


def new_folder(table: str) -> str:
    """A folder, relative to the base, for new data of a table."""
    return f"{table}/chunk={uuid.uuid4().hex}"


def numbers(spark: SparkSession, base: str) -> list[int]:
    return [int(n[:-5]) for n in names(spark, os.path.join(base, COMMITS)) if n.endswith(".json") and n[:-5].isdigit()]


def version(spark: SparkSession, base: str, number: int) -> Version:
    path = _path(spark, base, COMMITS, f"{number:012d}.json")
    stream = _fs(spark, path).open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(**json.loads(text))


def latest(spark: SparkSession, base: str) -> Version | None:
    found = numbers(spark, base)
    return version(spark, base, found[-1]) if found else None


def publish(spark: SparkSession, base: str, parts: dict[str, list[str]], meta: dict[str, Any], after: int = 0) -> Version:
    """Make version ``after + 1``; raises ``Conflict`` if there is one already."""
    new = Version(after + 1, parts, meta)
    jvm = spark.sparkContext._jvm
    draft, final = _path(spark, base, COMMITS, f"draft-{uuid.uuid4().hex}"), _path(spark, base, COMMITS, f"{new.number:012d}.json")
    fs = _fs(spark, draft)
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(new.__dict__, ensure_ascii=False).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, final, options)
    except Exception as e:  # noqa: BLE001 - the reason is in the Java exception
        fs.delete(draft, False)
        if "AlreadyExists" in str(e):
            raise Conflict(f"version {new.number} of {base} is there already") from e
        raise
    return new


def clean(spark: SparkSession, base: str, keep: int = 1) -> list[str]:
    """Remove all versions but the last ``keep``, and the folders that no kept one names; returns these folders.

    Run it when no writer is at work: its folders are named by no version yet.
    """
    found = numbers(spark, base)
    kept = [version(spark, base, n) for n in found[-max(keep, 1):]]
    named = {f for v in kept for folders in v.parts.values() for f in folders}
    tables = {f.split("/")[0] for n in found for folders in version(spark, base, n).parts.values() for f in folders}
    root = _path(spark, base)
    fs = _fs(spark, root)
    for n in found[:-max(keep, 1)]:
        fs.delete(_path(spark, base, COMMITS, f"{n:012d}.json"), False)
    gone = [f"{t}/{c}" for t in sorted(tables) for c in names(spark, os.path.join(base, t)) if f"{t}/{c}" not in named]
    for folder in gone:
        fs.delete(_path(spark, base, folder), True)
    return gone
