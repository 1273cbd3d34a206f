"""Command line: ``python -m quillspark.cli eval|eval-external|summary|csv|backfill|cost|ocr|create``."""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.text import base_name
from .operators import hocr, layout, report, transcribe
from .operators.score import score
from .sources import evalstore as E
from .sources import manifest as M
from .sources import providers as P
from .sources import store as S
from .sources.shared import cut, shared_dir

# Resolutions that the evaluation accepts.
RESOLUTIONS = tuple(f"MEDIA_RESOLUTION_{r}" for r in ("UNSPECIFIED", "LOW", "MEDIUM", "HIGH", "ULTRA_HIGH"))

#: Pictures beyond this are taken apart into strips.
LARGE_PIXELS = 50_000_000


def _rows(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for flags, more in options:
            p.add_argument(*flags.split(), **more)
        return p

    scoring = (("--ignore", {"action": "append", "default": None}), ("--single-line", {"action": "store_true", "default": None}))
    picks = (("--dir", {"default": ""}), ("--rows", {"type": _rows, "default": []}), ("--store", {"default": "evals"}))
    model = (("--provider", {"default": "ollama"}), ("--model", {"default": ""}), ("--prompt", {"default": "Extract all text from this image"}), ("--temperature", {"type": float, "default": 0.0}), ("--timeout", {"type": float, "default": 300.0}), ("--base-url", {"default": ""}))
    prices = (("--input-price", {"type": float, "default": 0.0}), ("--output-price", {"type": float, "default": 0.0}))
    command("eval", *model, *picks, *scoring, ("--csv", {}), ("--config", {}), ("--gemini-max-resolution", {"default": RESOLUTIONS[0], "choices": RESOLUTIONS}), ("--gemini-max-resolution-fallback", {"action": "store_true"}))
    command("eval-external", *picks, *scoring, ("--csv", {"required": True}), ("--name", {"required": True}))
    command("summary", ("name", {"nargs": "?"}), ("--store", {"default": "evals"}))
    command("csv", *prices, ("--store", {"default": "evals"}), ("--dir", {"default": ""}))
    command("backfill", *scoring, ("--override", {"action": "store_true"}), ("--all-metrics", {"action": "store_true"}), ("--dir", {"default": ""}), ("--store", {"default": "evals"}))
    command("cost", *prices, ("name", {}), ("--doc-count", {"type": int, "default": 1000}), ("--store", {"default": "evals"}))
    command("ocr", *model, ("--image", {"required": True}), ("--output -o", {}))
    command("create", *model, ("--image", {"required": True}), ("--output -o", {}))
    return top


def _client(a: argparse.Namespace):
    factory, url = P.REGISTRY.get(a.provider), a.base_url or os.environ.get(f"{a.provider.upper()}_URL", "")
    key, timeout = os.environ.get(f"{a.provider.upper()}_API_KEY", ""), a.timeout
    headers = {"openai": ("Authorization", f"Bearer {key}"), "gemini": ("x-goog-api-key", key), "claude": ("x-api-key", key), "azure": ("Ocp-Apim-Subscription-Key", key)}
    more = {}
    if a.provider.lower() == "gemini" and hasattr(a, "gemini_max_resolution"):
        more = {"resolution": a.gemini_max_resolution, "fallback": a.gemini_max_resolution_fallback}

    def make() -> P.Client:
        auth = P.static_header(*headers[a.provider.lower()]) if key and a.provider.lower() in headers else dict
        return factory(url, auth, timeout=timeout, **more)

    return make


def _calls(spark: SparkSession) -> P.Calls:
    """A journal for this run: what a lost executor was told isn't asked again."""
    return P.Calls(journal=f"{shared_dir(spark).rstrip('/')}/calls-{uuid.uuid4().hex}")


def _as_results(scored: DataFrame, **columns) -> DataFrame:
    flat = scored.select("*", "m.*").drop("m")
    for c, v in columns.items():
        flat = flat.withColumn(c, v)
    have = set(flat.columns)
    return flat.select(*[(F.col(c) if c in have else F.lit(k())).alias(c) for _, c, k in S.RESULT_KEYS])


def _stamp() -> str:
    return datetime.now().strftime("%Y-%m-%d_%H-%M-%S")


def _config(a, **more) -> dict:
    config = {n: ([] if isinstance(k, list) else k()) for n, k in S.CONFIG_KEYS}
    if a.command == "eval":
        config |= {"timeout": S.duration_text(a.timeout), "maxresolution": a.gemini_max_resolution, "maxresolutionfallback": a.gemini_max_resolution_fallback}
    return config | {"timestamp": _stamp(), "ignorepatterns": a.ignore or [], "singleline": bool(a.single_line), "testrows": a.rows, "csvpath": a.csv or ""} | more


def _tell(bad: DataFrame) -> None:
    """Rows that were left out, on the error output, secrets masked; JSON in a message is laid out."""
    for r in bad.toLocalIterator():
        print(f"row {r['row_idx']}: {P.pretty(P.mask(r['error']))}", file=sys.stderr)


def run_eval(spark: SparkSession, a, make=None) -> DataFrame:
    if bool(a.csv) == bool(a.config):
        raise SystemExit("give either --csv or --config")
    if a.config:
        old = S.reload_config(spark, S.store_path(a.config, a.store), _stamp())
        a.provider, a.model, a.prompt, a.temperature, a.csv, a.rows = (old[k] for k in ("provider", "model", "prompt", "temperature", "csvpath", "testrows"))
        # stores from before these options have none
        a.timeout, a.gemini_max_resolution, a.gemini_max_resolution_fallback = S.duration_seconds(old["timeout"]), old["maxresolution"] or RESOLUTIONS[0], old["maxresolutionfallback"]
        if a.gemini_max_resolution not in RESOLUTIONS:
            raise SystemExit(f"{a.gemini_max_resolution} is none of {', '.join(RESOLUTIONS)}")
        a.ignore, a.single_line = a.ignore or old["ignorepatterns"], bool(a.single_line or old["singleline"])
    model = a.model or P.DEFAULT_MODELS.get(a.provider.lower(), "")
    all_rows = M.select_rows(M.eval_rows(M.read_manifest(spark, a.csv), a.dir), a.rows)
    good = all_rows.where("error is null")
    texts = M.texts_of(good, a.dir, "transcript")
    rows = M.with_texts(good, texts, "transcript", "ref")
    # one call for each image, kept: the calls cost money, and both results and failures read them
    said = cut(P.transcribe(M.images_of(rows, a.dir), make or _client(a), model, a.prompt, a.temperature, calls=_calls(spark)))
    answers = rows.join(said.select(F.col("path").alias("image"), F.col("text").alias("hyp"), "input_tokens", "output_tokens", F.col("error").alias("failed")), "image", "left")
    results = _as_results(score(answers.where("hyp is not null and failed is null"), ignore=tuple(a.ignore or ()), single_line=bool(a.single_line)), response=F.col("hyp"))
    path = S.write_yaml(spark, _config(a, provider=a.provider, model=model, prompt=a.prompt, temperature=a.temperature), results, a.store, "" if model else f"{a.provider}.yaml")
    unread = answers.where("hyp is null or failed is not null").select("row_idx", F.coalesce("failed", F.concat(F.lit("failed to read "), "image")).alias("error"))
    _tell(all_rows.where("error is not null").select("row_idx", "error").union(M.without_texts(good, texts, "transcript").select("row_idx", "error")).union(unread))
    return S.flat_results(S.read_stores(spark, path))


def run_external(spark: SparkSession, a) -> DataFrame:
    scored, bad = M.external_eval(spark, a.csv, a.dir, a.rows, tuple(a.ignore or ()), bool(a.single_line))
    scored = cut(scored)
    _tell(bad)
    results = _as_results(scored, response=F.col("hyp"))
    if not scored.take(1):
        raise SystemExit("no row could be evaluated")
    return S.flat_results(S.read_stores(spark, S.write_yaml(spark, _config(a, provider="external", model=a.name), results, a.store)))


def run_summary(spark: SparkSession, a) -> DataFrame:
    if not a.name:
        return S.list_stores(spark, a.store)
    return report.summary(S.flat_results(S.read_stores(spark, S.store_path(a.name, a.store))))


def _rescored(spark: SparkSession, results: DataFrame, folder: str, a=None) -> DataFrame:
    """Results with ``m``: scores against the transcripts that can still be read, by each store's options or by ``a``'s."""
    if not folder:
        return results.withColumn("m", F.lit(None).cast("struct<char_accuracy:double,word_similarity:double>"))
    rows = M.with_texts(results, M.texts_of(results, folder, "transcript"), "transcript", "ref", "left")
    if a is not None and (a.override or a.ignore or a.single_line):
        return score(rows, "ref", "response", tuple(a.ignore or ()), bool(a.single_line))
    # options are few: one pass for each different setting
    settings = [(tuple(r[0] or ()), bool(r[1])) for r in results.select("ignorepatterns", "singleline").distinct().collect()]
    parts = [score(rows.where(F.col("ignorepatterns").eqNullSafe(F.array(*map(F.lit, i)).cast("array<string>")) & (F.col("singleline") == one)), "ref", "response", i, one) for i, one in settings]
    out = parts[0] if parts else score(rows, "ref", "response")
    for p in parts[1:]:
        out = out.union(p)
    return out


def run_csv(spark: SparkSession, a) -> DataFrame:
    results = S.flat_results(S.read_stores(spark, f"{a.store}/*.yaml"))
    if a.dir:
        results = report.fill_legacy_accuracy(_rescored(spark, results, a.dir).withColumn("recomputed_accuracy", F.col("m.char_accuracy")))
    cost = a.input_price > 0 or a.output_price > 0
    return report.leaderboard_tsv(report.leaderboard(results, ["file", "model"], a.input_price, a.output_price, ordered=False), with_cost=cost)


def run_backfill(spark: SparkSession, a) -> DataFrame:
    """The changed stores are replaced together, each with its own file, config and order of results."""
    results = cut(E.scan(spark, a.store).where("error is null"))
    filled = cut(report.backfill(_rescored(spark, results, a.dir, a), all_metrics=a.all_metrics).drop("m"))
    changed = filled.groupBy("file").agg(F.bool_or("changed").alias("any")).where("any").select("file")
    E.write_stores(filled.join(changed, "file", "left_semi"), a.store)
    return report.backfill_counts(filled)


def run_cost(spark: SparkSession, a) -> DataFrame:
    results = S.flat_results(S.read_stores(spark, S.store_path(a.name, a.store)))
    projection = report.cost_projection(results, a.input_price, a.output_price, a.doc_count)
    if not projection.take(1):
        raise SystemExit("the store has no token usage")
    return report.cost_lines(projection, a.input_price, a.output_price, a.doc_count)


def run_ocr(spark: SparkSession, a, make=None) -> DataFrame:
    model = a.model or P.DEFAULT_MODELS.get(a.provider.lower(), "")
    image = spark.createDataFrame([(a.image,)], "image string")
    images = M.images_of(image, a.image) if "://" not in a.image else M.fetched(image).select("path", "content")
    if "://" not in a.image and images.isEmpty():  # a folder
        images = M.read_images(spark, a.image)
    return P.transcribe(images, make or _client(a), model, a.prompt, a.temperature)


def run_create(spark: SparkSession, a, make=None) -> DataFrame:
    """hOCR of an image, transcribed line by line; without a service, or if all calls fail, lines have their names."""
    images = spark.read.format("image").load(a.image)
    basic = _basic_hocr(images)
    if make is None and not (a.base_url or os.environ.get(f"{a.provider.upper()}_URL")):
        return basic
    words = transcribe.transcribe_pages(images, make or _client(a), a.model or P.DEFAULT_MODELS.get(a.provider.lower(), ""), a.temperature)
    said = hocr.pages(words.where("text <> ''")).withColumn("page", base_name(F.col("page")))
    return basic.join(said.withColumnRenamed("hocr", "said"), "page", "left").select("page", F.coalesce("said", "hocr").alias("hocr"))


def _basic_hocr(images: DataFrame) -> DataFrame:
    pixels = images.agg(F.max(F.col("image.height").cast("bigint") * F.col("image.width"))).first()[0] or 0
    found = (layout.large_components if pixels > LARGE_PIXELS else layout.detect_components)(images)
    words = layout.merge_words(found.withColumnRenamed("path", "page"))
    size = found.select(F.col("path").alias("page"), "page_w", "page_h").distinct()
    lines = layout.fold_lines(words.select("page", "x", "y", "w", "h")).join(size, "page")
    return hocr.basic(hocr.response(lines)).select(base_name(F.col("page")).alias("page"), "hocr")


COMMANDS = {"eval": run_eval, "eval-external": run_external, "summary": run_summary, "csv": run_csv, "backfill": run_backfill, "cost": run_cost, "ocr": run_ocr, "create": run_create}


def load_env(path: str = ".env") -> None:
    """``NAME=value`` lines into the environment, which goes first; a file that isn't there is nothing."""
    if not os.path.isfile(path):
        return
    with open(path) as lines:
        for line in lines:
            name, found, value = line.strip().removeprefix("export ").partition("=")
            if found and name.strip().isidentifier() and not line.lstrip().startswith("#"):
                os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


def printed(a, rows: DataFrame) -> Iterator[str]:
    """What a command prints, line by line."""
    if a.command in ("eval", "eval-external"):
        for r in report.row_lines(rows).union(report.summary_lines(report.summary(rows))).toLocalIterator():
            yield from ["", *r["lines"]]
    elif a.command == "summary" and a.name:
        for r in report.summary_lines(rows).toLocalIterator():
            yield from r["lines"]
    elif a.command == "summary":
        names = [r["file"] for r in rows.toLocalIterator()]
        yield from ["Result stores:", *(f"  {n}" for n in names), "", "For one of them: summary NAME"] if names else [f"There is no result store in {a.store}."]
    elif a.command == "ocr":
        for r in rows.toLocalIterator():
            if r["error"]:
                raise SystemExit(f"the call failed: {r['error']}")
            yield r["text"]
    elif a.command == "create":
        yield from (r["hocr"] for r in rows.toLocalIterator())
    else:
        for r in rows.toLocalIterator():
            yield from r[0] if isinstance(r[0], list) else ["\t".join("" if v is None else str(v) for v in r)]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    load_env()
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    lines = printed(a, COMMANDS[a.command](spark, a))
    if getattr(a, "output", None):
        with open(a.output, "w") as out:
            out.write("\n".join(lines))
    elif a.command == "create":
        sys.stdout.write("\n".join(lines))
    else:
        for line in lines:
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
