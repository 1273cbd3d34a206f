"""Result stores: YAML files of one evaluation each, read with zero defaults, and Parquet as the working form."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

try:
    import yaml
except ImportError:  # reading and writing YAML needs it; Parquet stores don't
    yaml = None

# Keys in a store's file, our column, its kind.
RESULT_KEYS = (
    ("identifier", "identifier", str), ("imagepath", "image", str), ("transcriptpath", "transcript", str), ("public", "public", bool),
    ("providerresponse", "response", str), ("charactersimilarity", "char_similarity", float), ("characteraccuracy", "char_accuracy", float),
    ("wordsimilarity", "word_similarity", float), ("wordaccuracy", "word_accuracy", float), ("worderrorrate", "word_error_rate", float),
    ("totalwordsoriginal", "ref_words", int), ("totalwordstranscribed", "hyp_words", int), ("correctwords", "correct_words", int),
    ("substitutions", "substitutions", int), ("deletions", "deletions", int), ("insertions", "insertions", int),
    ("ignoredcharscount", "ignored_chars", int), ("inputtokens", "input_tokens", int), ("outputtokens", "output_tokens", int),
)
CONFIG_KEYS = (
    ("provider", str), ("model", str), ("prompt", str), ("temperature", float), ("timeout", str), ("csvpath", str), ("testrows", [int]), ("timestamp", str),
    ("ignorepatterns", [str]), ("singleline", bool), ("debug", bool), ("maxresolution", str), ("maxresolutionfallback", bool),
)
_SQL = {str: "string", bool: "boolean", float: "double", int: "int"}
RESULT_TYPE = ", ".join(f"{c} {_SQL[k]}" for _, c, k in RESULT_KEYS)
CONFIG_TYPE = ", ".join(f"{n}: {'array<' + _SQL[k[0]] + '>' if isinstance(k, list) else _SQL[k]}" for n, k in CONFIG_KEYS)
DEFAULT_TIMEOUT = "5m0s"
#: libyaml's where PyYAML was built with it: many times faster, and it keeps every line break that a text can have.
_LOADER, _DUMPER = (getattr(yaml, f"C{n}", None) or getattr(yaml, n, None) for n in ("SafeLoader", "SafeDumper"))

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration_seconds(text: str) -> float:
    """Seconds of a stored duration such as ``5m0s`` or ``1h2m3.5s``; a bare number counts nanoseconds, an empty text is 0."""
    if re.fullmatch(r"-?\d+", text):
        return int(text) / 1e9
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)", text)
    if "".join(map("".join, parts)) != text.lstrip("+-"):
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(n) * _UNITS[u] for n, u in parts) * (-1 if text.startswith("-") else 1)


def duration_text(seconds: float) -> str:
    """A duration as stores have it: hours and minutes as far as there are any, then seconds; below one, thousandths."""
    if 0 < seconds < 1:
        return f"{seconds * 1000:.6f}".rstrip("0").rstrip(".") + "ms"
    minutes, rest = divmod(seconds, 60)
    hours, minutes = divmod(int(minutes), 60)
    tail = f"{rest:.9f}".rstrip("0").rstrip(".") + "s"
    return f"{hours}h{minutes}m{tail}" if hours else f"{minutes}m{tail}" if minutes else tail


def loaded(text: str):
    """YAML as values. What libyaml refuses is Python's parser's to judge, and to word the error of."""
    try:
        return yaml.load(text, Loader=_LOADER)
    except yaml.YAMLError:
        return yaml.safe_load(text)


def dumped(value) -> str:
    """A value as YAML, as stores have it."""
    return yaml.dump(value, Dumper=_DUMPER, sort_keys=False, allow_unicode=True, indent=4)


def _value(x, kind):
    if isinstance(kind, list):
        return [kind[0](v) for v in x or []]
    return kind() if x is None else kind(x)

def read_stores(spark: SparkSession, path: str) -> DataFrame:
    """(file, config, results, error): a row for each file. What can't be parsed has ``error`` and no results."""
    return parse_stores(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value"))


def parsed_store(text: str) -> tuple[dict, list[dict]]:
    """Config and results of one file, zero for what isn't there."""
    raw = loaded(text) or {}
    config = {n: _value((raw.get("config") or {}).get(n), k) for n, k in CONFIG_KEYS}
    return config, [{c: _value(r.get(key), k) for key, c, k in RESULT_KEYS} for r in raw.get("results") or []]


def parse_stores(files: DataFrame) -> DataFrame:
    """The same for whole files as rows with columns ``file`` and ``value``."""
    item = "struct<" + ", ".join(f"{c}: {_SQL[k]}" for _, c, k in RESULT_KEYS) + ">"

    def parse(batches):
        for batch in batches:
            out = []
            for file, text in zip(batch["file"], batch["value"], strict=True):
                try:
                    out.append((file, *parsed_store(text), None))
                except Exception as e:  # a broken file is a row, not the end of the scan
                    out.append((file, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["file", "config", "results", "error"])

    return files.select("file", "value").mapInPandas(parse, f"file string, config struct<{CONFIG_TYPE}>, results array<{item}>, error string")

def flat_results(stores: DataFrame) -> DataFrame:
    """One row for each stored result, with its file, model, provider and timestamp. Broken and empty stores give none."""
    good = stores.where("error is null")
    return good.select("file", "config.model", "config.provider", "config.timestamp", "config.ignorepatterns", "config.singleline", F.inline("results"))

def store_path(name: str, folder: str = "evals") -> str:
    """A store's path by its name: the extension and the folder may be left out."""
    name = name if name.endswith(".yaml") else f"{name}.yaml"
    return name if "/" in name else f"{folder}/{name}"

def list_stores(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(folder)
    names = files.select(F.col("_metadata.file_name").alias("file"))
    # Spark deals 32 names to a task, and nothing is opened: a few tasks list them all
    return names.coalesce(4 * spark.sparkContext.defaultParallelism).orderBy("file")

def reload_config(spark: SparkSession, path: str, timestamp: str) -> dict:
    """The config of an old store for another run: new timestamp, default timeout if it had none."""
    row = read_stores(spark, path).select("config", "error").first()
    if row is None or row["error"]:
        raise ValueError(row["error"] if row else f"no store at {path}")
    config = row["config"].asDict(recursive=True)
    return config | {"timestamp": timestamp, "timeout": config["timeout"] or DEFAULT_TIMEOUT}

def write_results(results: DataFrame, path: str) -> None:
    """Canonical form: Parquet by store; only the stores in ``results`` are replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(path)

#: Results' keys up to the last text; what follows are numbers, a line each.
_TEXTS = 1 + max(i for i, (_, _, k) in enumerate(RESULT_KEYS) if k is str)

def _plain(x) -> str:
    """A number or null as YAML has it."""
    return str(x) if type(x) is int else dumped(x).partition("\n")[0] if x is None or x != x or abs(x) in (0.0, float("inf")) or "e" in repr(x) else repr(x)

def result_yaml(row) -> str:
    """One result as an item of a store's list."""
    plain = [f"    {key}: {_plain(row[c])}\n" for key, c, _ in RESULT_KEYS[_TEXTS:]]
    return dumped([{key: row[c] for key, c, _ in RESULT_KEYS[:_TEXTS]}]) + "".join(plain)

def to_yaml(config: dict, results) -> str:
    """One store as YAML. ``results``: rows, taken one at a time."""
    names = {c: key for key, c, _ in RESULT_KEYS}
    body = [{names[c]: r[c] for c in names} for r in results]
    return dumped({"config": config, "results": body})

def write_yaml(spark: SparkSession, config: dict, results: DataFrame, folder: str, name: str = "") -> str:
    """Write one store's file, ``name`` or else named after its model; returns its path. A store has at most some thousand rows.

    The file is written aside and moved into its place, so a failure leaves the old one as it was.
    """
    name = name or f"{config['model'].replace(':', '_')}.yaml"
    text = to_yaml(config, results.toLocalIterator())
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, aside = hadoop.Path(f"{folder}/{name}"), hadoop.Path(f"{folder}/.{name}-{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(target), how)
    return f"{folder}/{name}"
