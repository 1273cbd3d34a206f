"""Contents of the files and URLs that rows name, and of no others.

Up to ``BLOCK`` files are found by a scan that lists paths without opening anything, and read by one job that has them as a list of
paths. More of them are asked for by the tasks that have their names: no path comes to the driver, and nothing is listed.
What only Spark's own readers can open is read in blocks whatever its number; with more than one block each
one's contents go to the shared folder as soon as they are read.
"""

from __future__ import annotations

import http.client
import re
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import is_remote
from .shared import cut, file_system, shared_dir

REMOTE_BYTES = 50 << 20
BLOCK = 10_000
_GLOB = re.compile(r"([\\{}\[\]*?])")
_SCHEMA = "path string, content binary"
_ARROW = pa.schema([("path", pa.string()), ("content", pa.binary())])
#: Bytes of contents that a task hands on at a time, unless one file has more.
HANDED = 16 << 20
#: Paths that a task asks for at a time.
ASKED = 1000


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:(//)?(?=/)", "")


def _files(spark: SparkSession, paths: list[str], deep: bool = False) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).load(paths)


def _status(spark: SparkSession, path: str):
    """Hadoop's status of a path, or None."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(at) if fs.exists(at) else None


def listing(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(path) of the files below ``folder`` and in the folders of wanted paths outside of it; the scan's schema has nothing else.

    Folders outside are looked up by the driver, one at a time.
    """
    whole = _status(spark, folder)
    base = re.sub("^file:(//)?(?=/)", "", whole.getPath().toString()) if whole else folder
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    parents = wanted.where(~F.col("path").startswith(f"{base.rstrip('/')}/") & (F.col("path") != base)).select(parent.alias("p")).distinct()
    others = [r["p"] for r in parents.toLocalIterator() if r["p"] and _status(spark, r["p"])]
    found = [_files(spark, [_escaped(folder)], deep=True)] if whole else []
    found += [_files(spark, [*map(_escaped, others)])] if others else []
    paths = [f.select(plain_path(F.col("path")).alias("path")) for f in found]
    return paths[0].union(paths[1]) if len(paths) == 2 else paths[0] if paths else wanted.select("path").where("false")


def _escaped(path: str) -> str:
    return _GLOB.sub(r"\\\1", path)


def _blocks(rows: DataFrame, size: int) -> Iterator[list[str]]:
    block: list[str] = []
    for r in rows.toLocalIterator():  # a partition at a time
        block.append(r["path"])
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _root(path: Column) -> Column:
    """Scheme and authority of a URI with the slash behind them; of a plain path ''."""
    return F.regexp_extract(path, "^([A-Za-z][A-Za-z0-9+.-]*:/(?:/[^/]*/)?)", 1)


def _opened_by_python(root: str) -> bool:
    try:
        file_system(root or "/")
    except Exception:  # no such scheme, or no library for it on this machine
        return False
    return True


def _hidden(path: Column, folder: str) -> Column:
    """Whether Spark's readers pass over a path below ``folder``, or over a file elsewhere, by its name."""
    base = f"{folder.rstrip('/')}/"
    own = F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(F.regexp_extract(path, "([^/]*)$", 1))
    passed = lambda p: (p.startswith(".") | (p.startswith("_") & ~p.contains("=")) | p.endswith("._COPYING_")) & ~p.startswith("_metadata") & ~p.startswith("_common_metadata")
    return (path != folder) & F.exists(F.split(own, "/"), passed)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of the paths that are files, each opened by the task that has its name."""
    from pyarrow import fs

    systems: dict = {}
    for batch in batches:
        paths, roots = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for start in range(0, len(paths), ASKED):
            of_root: dict[str, list[str]] = {}
            for p, root in zip(paths[start : start + ASKED], roots[start : start + ASKED], strict=True):
                of_root.setdefault(root, []).append(p)
            found, size = [], 0
            for root, own in of_root.items():
                if root not in systems:
                    systems[root] = file_system(root or "/")
                system, at = systems[root]
                places = [f"{at.rstrip('/')}/{p[len(root) :].lstrip('/')}" for p in own]
                for p, place, info in zip(own, places, system.get_file_info(places), strict=True):
                    if info.type == fs.FileType.File and not (root == "" and p.endswith("/")):
                        with system.open_input_stream(place) as f:
                            found.append((p, f.read()))
                        size += len(found[-1][1])
                        if size >= HANDED:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
                            found, size = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def file_contents(wanted: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """(path, content) of the whole paths in ``wanted``, as far as they are files. Files of no bytes have empty contents.

    Of more than ``block`` paths, those that Python can open are read by the tasks that have them, and kept in the shared folder.
    """
    wanted = cut(wanted.select(F.col(wanted.columns[0]).alias("path")).where(F.col("path").isNotNull() & ~is_remote(F.col("path"))).distinct())
    if wanted.count() <= block:
        return _by_driver(wanted, folder, block)
    spark, rooted = wanted.sparkSession, wanted.withColumn("root", _root(F.col("path")))
    roots = [r["root"] for r in rooted.select("root").distinct().toLocalIterator()]
    opened = [r for r in roots if _opened_by_python(r)]
    whole = _status(spark, folder)
    base = re.sub("^file:(//)?(?=/)", "", whole.getPath().toString()) if whole else folder
    mine = rooted.where(F.col("root").isin(opened) & ~_hidden(F.col("path"), base))
    # names are few bytes: by their size alone they would make a few tasks
    read = cut(mine.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(_read, _SCHEMA))
    if len(opened) == len(roots):
        return read
    return read.union(_by_driver(cut(rooted.where(~F.col("root").isin(opened)).select("path")), folder, block))


def _by_driver(wanted: DataFrame, folder: str, block: int) -> DataFrame:
    """As :func:`file_contents`, by lists of paths, which the driver gives to Spark's own reader.

    That leaves out empty files, so the wanted paths that aren't listed are asked for by the driver, one by one: these are the
    empty files and the rows' errors.
    """
    spark = wanted.sparkSession
    listed = cut(wanted.join(listing(spark, folder, wanted), "path", "left_semi"))
    target, first, many = f"{shared_dir(spark).rstrip('/')}/blobs-{uuid.uuid4().hex}", None, False
    for paths in _blocks(listed, block):
        part = _files(spark, [*map(_escaped, paths)]).select(plain_path(F.col("path")).alias("path"), "content")
        if first is None:
            first = part
        else:
            for p in [part] if many else [first, part]:
                p.write.mode("append").parquet(target)
            many = True
    for paths in _blocks(wanted.join(listed, "path", "left_anti"), block):
        empty = [(p, b"") for p in paths if (s := _status(spark, p)) and s.isFile() and s.getLen() == 0]
        if empty:
            part = spark.createDataFrame(empty, _SCHEMA)
            if many:
                part.write.mode("append").parquet(target)
            else:
                first = part if first is None else first.union(part)
    if many:
        return spark.read.schema(_SCHEMA).parquet(target)
    return spark.createDataFrame([], _SCHEMA) if first is None else first


def http_get(url: str, timeout: float = 60.0, limit: int = REMOTE_BYTES) -> bytes:
    """The whole body, whatever the status says; at most ``limit`` bytes."""
    try:
        answer = urllib.request.urlopen(url, timeout=timeout)
    except urllib.error.HTTPError as e:
        answer = e
    with answer:
        body = answer.read(limit + 1)
    if len(body) > limit:
        raise OSError(f"more than {limit} bytes")
    if getattr(answer, "length", None):  # the answer ended before its time
        raise http.client.IncompleteRead(body, answer.length)
    return body


def url_contents(wanted: DataFrame, get: Callable[[str], bytes] = http_get) -> DataFrame:
    """(path, content) of the URLs in ``wanted``, each asked for once and kept in the shared folder. What fails, in whatever way, is left out."""
    urls = wanted.select(F.col(wanted.columns[0]).alias("path")).where(is_remote(F.col("path"))).distinct()
    if urls.isEmpty():
        return wanted.sparkSession.createDataFrame([], _SCHEMA)

    def run(batches):
        for batch in batches:
            out = []
            for url in batch["path"]:
                try:
                    out.append((url, get(url)))
                except (OSError, ValueError, http.client.HTTPException):
                    continue
            yield pd.DataFrame(out, columns=["path", "content"])

    return cut(urls.mapInPandas(run, _SCHEMA))
