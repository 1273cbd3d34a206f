"""CSV manifests and the texts and images they name."""

from __future__ import annotations

import csv
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import base_name, is_remote, parse_bool, trim_space
from .blobs import BLOCK, file_contents, http_get, plain_path, url_contents
from .csvscan import parsed, scan_csv


def read_manifest(spark: SparkSession, path: str, sentinel: str = "image") -> DataFrame:
    """(row_idx, fields, error) of each CSV file at ``path``; a first row that begins with ``sentinel`` is a header.

    Strict CSV with quoted line breaks; rows are numbered from 0 after the header. A file without a row, or whose rows
    differ in length, gives one row with ``error``; a file of no bytes isn't opened by Spark and gives none. A large file is read by many tasks.
    """
    return scan_csv(spark, path, sentinel).drop("file")


def parse_manifests(files: DataFrame, sentinel: str = "image") -> DataFrame:
    """The same for whole files as rows with a column ``value``."""

    def parse(batches):
        for batch in batches:
            out = []
            for text in batch["value"]:
                try:
                    rows = parsed(text)
                    if not rows:
                        raise ValueError("the manifest is empty")
                    if any(len(r) != len(rows[0]) for r in rows):
                        raise ValueError("wrong number of fields")
                    rows = rows[rows[0][0].strip().lower() == sentinel.lower() :]
                    out += [(i, r, None) for i, r in enumerate(rows)]
                except (csv.Error, ValueError) as e:
                    out.append((None, None, str(e)))
            yield pd.DataFrame(out, columns=["row_idx", "fields", "error"]).astype({"row_idx": "Int64"})

    return files.select("value").mapInPandas(parse, "row_idx bigint, fields array<string>, error string")


def select_rows(df: DataFrame, rows: list[int] | DataFrame, index: str = "row_idx") -> DataFrame:
    """Rows by number; none given: all. Numbers out of range are ignored. A DataFrame of numbers is semi-joined."""
    if isinstance(rows, DataFrame):
        return df.join(rows.select(F.col(rows.columns[0]).alias(index)), index, "left_semi")
    return df.where(F.col(index).isin(list(rows))) if rows else df


def clean_path(path: Column) -> Column:
    """A path without ``.``, ``..`` and doubled slashes, as far as they can be resolved without the file system."""
    rooted, none = path.startswith("/"), F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(F.concat(F.array(F.lit("")), done), -1)
        up = F.when((F.size(done) > 0) & (last != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).when(rooted, done).otherwise(F.concat(done, F.array(part)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    clean = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"))
    return F.when((clean == "") & (path != ""), ".").otherwise(clean)


def cell_path(folder: str, cell: Column) -> Column:
    """A cell's path below ``folder``, cleaned; URLs stay as they are."""
    cell = trim_space(cell)
    joined = F.when(cell == "", F.lit(folder)).otherwise(F.concat(F.lit(f"{folder.rstrip('/')}/"), cell)) if folder else cell
    return F.when(is_remote(cell), cell).otherwise(clean_path(joined))


def resolved(spark: SparkSession, path: Column) -> Column:
    """The whole path, as Spark's readers name it: relative ones are below the working folder, URLs stay."""
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    here, top = fs.getWorkingDirectory().toString(), fs.getUri().toString().rstrip("/")
    base, top = here.removeprefix("file://").removeprefix("file:"), "" if top.startswith("file:") else top
    return F.when(is_remote(path), path).when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:/"), plain_path(path)).when(path.startswith("/"), F.concat(F.lit(top), path)).otherwise(clean_path(F.concat(F.lit(f"{base}/"), path)))


def eval_rows(manifest: DataFrame, folder: str = "") -> DataFrame:
    """(row_idx, image, transcript, public, identifier, error) of an evaluation manifest; under three fields: dropped."""
    rows = manifest.where("error is null").where(F.size("fields") >= 3)
    field = lambda i: F.get("fields", F.lit(i))
    public = parse_bool(trim_space(field(2)))
    return rows.select(
        "row_idx", cell_path(folder, field(0)).alias("image"), cell_path(folder, field(1)).alias("transcript"), public.alias("public"),
        base_name(cell_path(folder, field(0))).alias("identifier"),
        F.when(public.isNull(), F.concat(F.lit("invalid boolean: "), field(2))).alias("error"),
    )


def external_rows(manifest: DataFrame, folder: str = "") -> DataFrame:
    """(row_idx, transcript, transcription, identifier) of an external manifest; under two fields: dropped."""
    rows = manifest.where("error is null").where(F.size("fields") >= 2)
    field = lambda i: cell_path(folder, F.get("fields", F.lit(i)))
    return rows.select("row_idx", field(0).alias("transcript"), field(1).alias("transcription"), base_name(field(0)).alias("identifier"))


def base64_line(content: Column) -> Column:
    """Base64 without the line breaks that the built-in function puts in."""
    return F.translate(F.base64(content), "\r\n", "")


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of whole files; bytes that aren't UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select(plain_path(F.col("path")).alias("path"), F.decode("content", "UTF-8").alias("text"))


def read_images(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, content, base64)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select(plain_path(F.col("path")).alias("path"), "content", base64_line(F.col("content")).alias("base64"))


def fetched(paths: DataFrame, get: Callable[[str], bytes] = http_get) -> DataFrame:
    """(path, content, base64) of the URLs among ``paths``; what fails is left out."""
    return url_contents(paths, get).withColumn("base64", base64_line(F.col("content")))


def contents_of(rows: DataFrame, folder: str, *columns: str, get: Callable[[str], bytes] = http_get, block: int = BLOCK) -> DataFrame:
    """(path, content) of the files and URLs in ``columns``, by whole path; nothing else is opened."""
    spark = rows.sparkSession
    named = reduce(DataFrame.union, [rows.select(F.col(c).alias("path")) for c in columns])
    files = file_contents(named.select(resolved(spark, F.col("path")).alias("path")), folder or ".", block)
    return files.union(url_contents(named, get))


def texts_of(rows: DataFrame, folder: str, *columns: str, get: Callable[[str], bytes] = http_get, block: int = BLOCK) -> DataFrame:
    """(path, text): the files and URLs that ``columns`` name."""
    return contents_of(rows, folder, *columns, get=get, block=block).select("path", F.decode("content", "UTF-8").alias("text"))


def images_of(rows: DataFrame, folder: str, column: str = "image", get: Callable[[str], bytes] = http_get, block: int = BLOCK) -> DataFrame:
    """(path, content, base64) of the rows' images, by the path that the rows have."""
    have = contents_of(rows, folder, column, get=get, block=block)
    wanted = rows.select(F.col(column).alias("named")).distinct()
    wanted = wanted.withColumn("path", resolved(rows.sparkSession, F.col("named")))
    return have.join(wanted, "path").select(F.col("named").alias("path"), "content", base64_line(F.col("content")).alias("base64"))


def bounded_base64(text: Column, limit: int) -> Column:
    """The bytes of a base64 text; null if it isn't one or has more than ``limit`` bytes, which its length tells before it is decoded."""
    bare = F.regexp_replace(text, "[=\\r\\n]+", "")
    return F.when(F.floor(F.length(bare) * 3 / 4) <= limit, F.try_to_binary(text, F.lit("base64")))


def _with_key(rows: DataFrame, path: str) -> DataFrame:
    return rows.withColumn("__path", resolved(rows.sparkSession, F.col(path)))


def with_texts(rows: DataFrame, texts: DataFrame, path: str, into: str, how: str = "inner") -> DataFrame:
    """Join on a path, relative or whole; what has no text is in :func:`without_texts`, or has null by a ``left`` join."""
    return _with_key(rows, path).join(texts.select(F.col("path").alias("__path"), F.col("text").alias(into)), "__path", how).drop("__path")


def without_texts(rows: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    missing = _with_key(rows, path).join(texts.select(F.col("path").alias("__path")), "__path", "left_anti").drop("__path")
    return missing.withColumn("error", F.concat(F.lit("failed to read "), F.col(path)))


def external_eval(spark: SparkSession, manifest: str, folder: str, rows: list[int] | None = None, ignore: tuple[str, ...] = (), single_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scored results, rows that couldn't be read) of transcriptions made elsewhere."""
    from ..operators.score import score

    wanted = select_rows(external_rows(read_manifest(spark, manifest, "transcript"), folder), rows or [])
    texts = texts_of(wanted, folder, "transcript", "transcription")
    first = with_texts(wanted, texts, "transcript", "ref")
    bad = without_texts(wanted, texts, "transcript").unionByName(without_texts(first.drop("ref"), texts, "transcription"))
    return score(with_texts(first, texts, "transcription", "hyp"), ignore=ignore, single_line=single_line), bad
