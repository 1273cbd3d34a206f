"""Registered queries that go through files: manifests, texts, pictures and stores made from the tables, written to the shared folder by tasks, then read as users read theirs.

The files go when the query's result is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators import layout as L
from ..sources import evalstore as E
from ..sources import manifest as M
from ..sources import providers as P
from ..sources import store as S
from ..sources.shared import cut, file_system, shared_dir
from . import catalog as C


def _with_folder(query: Callable) -> Callable:
    """Gives the query a folder of its own, and takes it away once the result is kept."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
        out = cut(query(spark, sf_dir, folder))
        gone = spark._jvm.org.apache.hadoop.fs.Path(folder)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        return out

    return run


def write_files(rows: DataFrame, folder: str) -> None:
    """Write ``content`` to the file ``name`` below ``folder`` for each row, by the tasks that have the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (system, at), made = file_system(folder), set()
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                path = f"{at}/{name}"
                if (parent := path.rpartition("/")[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(path) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    rows = rows.select("name", F.col("content").cast("binary")).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    rows.mapInPandas(run, "n bigint").agg(F.sum("n")).collect()


def _quoted(cell: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))


@_with_folder
def manifest_scan(spark, sf_dir, folder):
    """Whole documents as quoted cells of a few CSV files, which are read by ranges."""
    docs = C._table(spark, sf_dir, "documents")
    line = F.concat_ws(",", F.col("doc_id").cast("string"), _quoted(F.col("text")), _quoted(F.concat(F.lit('say "'), "lang", F.lit('",\n'), "source")))
    docs.select(line.alias("value")).write.text(folder)
    rows = M.read_manifest(spark, folder, "no header")
    cell = lambda i: F.get("fields", F.lit(i))
    return rows.select(cell(0).cast("bigint").alias("doc_id"), cell(1).alias("text"), cell(2).alias("said"), (F.col("row_idx") >= 0).alias("numbered"))


@_with_folder
def external_eval(spark, sf_dir, folder):
    """Turns and the answers to them as files, named by an external manifest; one text in ten isn't there."""
    pairs = C.turns(spark, sf_dir)
    name = F.concat_ws("-", "conv_id", "turn")
    path = lambda kind: F.concat(F.lit(f"{kind}/"), name, F.lit(".txt"))
    write_files(pairs.select(path("gt").alias("name"), F.col("ref").alias("content")), folder)
    write_files(pairs.where("conv_id % 10 <> 3").select(path("ex").alias("name"), F.col("hyp").alias("content")), folder)
    pairs.select(F.concat(path("gt"), F.lit(", gt/../"), path("ex")).alias("value")).write.text(f"{folder}/manifest")
    scored, bad = M.external_eval(spark, f"{folder}/manifest", folder)
    number = lambda i: F.split(F.regexp_replace("identifier", "[.]txt$", ""), "-")[i].cast("bigint")
    rows = scored.select(number(0).alias("conv_id"), number(1).alias("turn"), "m.*", F.lit(False).alias("failed"))
    return C._rounded(rows.unionByName(bad.select(number(0).alias("conv_id"), number(1).alias("turn"), F.lit(True).alias("failed")), allowMissingColumns=True))


@_with_folder
def image_join(spark, sf_dir, folder):
    """Pages' sources as binary files, every third one empty, joined to the rows that name them in base64."""
    pages = C._table(spark, sf_dir, "pages")
    name = F.concat(F.lit("img/"), "page_id", F.lit(" [x].bin"))
    write_files(pages.select(name.alias("name"), F.when(F.pmod("page_id", F.lit(3)) == 0, "").otherwise(F.col("html")).alias("content")), folder)
    rows = pages.select("page_id", M.cell_path(folder, name).alias("image"))
    found = M.images_of(rows, folder).withColumnRenamed("path", "image")
    return rows.join(found, "image").select("page_id", F.md5("base64").alias("base64_md5"), F.length("content").cast("bigint").alias("n_bytes"))


@_with_folder
def stored_transcripts(spark, sf_dir, folder):
    """Stored results against the texts that are there: a result without one stays, with nothing beside it."""
    said = C._table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("t/"), "conv_id", F.lit("-"), "turn", F.lit(".txt"))
    write_files(said.where("turn % 3 <> 1").select(name.alias("name"), F.col("text").alias("content")), folder)
    rows = said.select("conv_id", "turn", M.cell_path(folder, name).alias("transcript"))
    texts = M.texts_of(rows, folder, "transcript")
    return M.with_texts(rows, texts, "transcript", "ref", "left").select("conv_id", "turn", "ref")


def _stores(spark, sf_dir, folder) -> None:
    """A store for each conversation, its results in the order of the turns."""
    said = C._table(spark, sf_dir, "conversations")
    fields = {c: F.lit(k()) for _, c, k in S.RESULT_KEYS} | {"identifier": F.concat(F.lit("t"), "turn"), "response": F.col("text"), "char_similarity": F.pmod("turn", F.lit(8)) / 8, "public": F.col("role") == "user", "input_tokens": F.length("text")}
    config = {n: F.array().cast(f"array<{S._SQL[k[0]]}>") if isinstance(k, list) else F.lit(k()) for n, k in S.CONFIG_KEYS} | {"model": F.concat(F.lit("m:"), "conv_id"), "timeout": F.lit("5m0s"), "ignorepatterns": F.array(F.lit("|"))}
    rows = said.select(F.concat("conv_id", F.lit(".yaml")).alias("file"), F.col("turn").cast("int").alias("pos"), *[v.alias(c) for c, v in fields.items()], F.struct(*[v.alias(n) for n, v in config.items()]).alias("config"))
    E.write_stores(rows, folder)


@_with_folder
def store_round_trip(spark, sf_dir, folder):
    """Stores written and read again, then those of every fifth conversation replaced."""
    _stores(spark, sf_dir, folder)
    rows = E.scan(spark, folder)
    E.write_stores(rows.where(F.col("model").rlike("[05]$")).withColumn("char_similarity", F.lit(1.0)), folder)
    found = E.scan(spark, folder)
    return C._rounded(found.select("file", "pos", "model", "identifier", "response", "char_similarity", "public", "input_tokens", F.array_join("ignorepatterns", ",").alias("ignore"), F.col("config.timeout").alias("timeout")))


@_with_folder
def store_listing(spark, sf_dir, folder):
    _stores(spark, sf_dir, folder)
    return S.list_stores(spark, folder)


def manifest_short(spark, sf_dir):
    """Rows of two and of three fields, a file of either kind for each source: an evaluation drops the short ones, an external one doesn't."""
    row = F.concat(F.lit("a/"), "doc_id", F.lit(".png, t/"), "doc_id", F.lit(".txt"), F.when(F.length("source") == 4, "").otherwise(",1"))
    files = C._table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", row.alias("row")))), lambda x: x.row), "\n").alias("value"))
    rows = M.parse_manifests(files)
    every = M.external_rows(rows).select(F.lit("external").alias("kind"), "row_idx", "transcript", "transcription", "identifier")
    return every.union(M.eval_rows(rows).select(F.lit("eval"), "row_idx", "image", "transcript", "identifier"))


def line_words(spark, sf_dir):
    """Each line's own boxes, in their order."""
    lines = L.fold_lines(C.boxes(spark, sf_dir), words=True)
    words = lines.select("page", "line", F.posexplode("words").alias("i", "b"))
    return C._rounded(words.select("page", "line", (F.col("i") + 1).alias("i"), "b.x", "b.y", "b.w", "b.h"))


@F.pandas_udf(T.StructType([T.StructField("endpoint", T.StringType()), T.StructField("audience", T.StringType())]))
def _service(url: pd.Series) -> pd.DataFrame:
    def read(u: str) -> tuple:
        try:
            return P.endpoint(u, "v1", "a b"), P.audience_of(u)
        except P.ServiceError:
            return None, P.audience_of(u)

    return pd.DataFrame(map(read, url), columns=["endpoint", "audience"])


def service_urls(spark, sf_dir):
    """Pages' addresses as those of services: what may be called, and for whom tokens are asked."""
    url, kind = F.col("url"), F.pmod("page_id", F.lit(6))
    odd = ((1, "http", "ftp"), (2, "://", "://u:p@"), (3, "/en/", "/e%6E/"), (4, "example.net", "run.app"))
    made = url
    for k, old, new in odd:
        made = F.when(kind == k, F.replace(url, F.lit(old), F.lit(new))).otherwise(made)
    return C._table(spark, sf_dir, "pages").select("page_id", _service(made).alias("s")).select("page_id", "s.endpoint", "s.audience")


@F.pandas_udf(T.BooleanType())
def _valid(model: pd.Series, prompt: pd.Series, temperature: pd.Series, image: pd.Series, kind: pd.Series, needs_model: pd.Series) -> pd.Series:
    def check(m, p, t, i, k, needs) -> bool:
        try:
            P.validate(P.Request(m, p, P.Image(i, k), t), needs_model=needs)
        except P.ServiceError:
            return False
        return True

    return pd.Series(list(map(check, model, prompt, temperature, image, kind, needs_model)))


def request_check(spark, sf_dir):
    """Turns as requests with models, prompts, temperatures and images of all kinds, to a service that needs a model's name and to one that doesn't."""
    kind = F.pmod("turn", F.lit(5))
    model = F.when(kind == 0, "m").when(kind == 1, " m").when(kind == 2, F.repeat(F.lit("m"), 2000)).when(kind == 3, "").otherwise(F.col("text"))
    prompt = F.when(F.pmod("conv_id", F.lit(7)) == 0, " \n").otherwise(F.col("text"))
    image = F.when(F.pmod("conv_id", F.lit(5)) == 0, "").otherwise(F.col("text")).cast("binary")
    media = F.when(F.pmod("conv_id", F.lit(3)) == 0, "text/plain").otherwise("Image/PNG")
    ask = lambda needs: _valid(model, prompt, (F.col("turn") - 1).cast("double"), image, media, F.lit(needs))
    return C._table(spark, sf_dir, "conversations").select("conv_id", "turn", ask(True).alias("valid"), ask(False).alias("valid_without_model"))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("seconds", T.DoubleType())]))
def _duration(seconds: pd.Series) -> pd.DataFrame:
    texts = [S.duration_text(x) for x in seconds]
    return pd.DataFrame({"text": texts, "seconds": [S.duration_seconds(t) for t in texts]})


def stored_durations(spark, sf_dir):
    """Timeouts as stores have them, and back."""
    rows = C._table(spark, sf_dir, "orders").select("o_orderkey", _duration((F.pmod("o_orderkey", F.lit(20_011)) / 2).cast("double")).alias("d"))
    return rows.select("o_orderkey", "d.text", "d.seconds")


QUERIES = (service_urls, request_check, stored_durations, manifest_scan, external_eval, image_join, stored_transcripts, store_round_trip, store_listing, manifest_short, line_words)
