"""Result stores as a data source: ``spark.read.format("evalstore").load(folder)`` and ``write_stores``.

Reading: a row for each stored result, with its place in the file, in groups of files; a file that can't be parsed is a row with ``error``. Filters
on ``file`` are applied to names, so files that don't fit aren't opened; filters on ``model`` are applied to a file's
head, so the results of others aren't parsed. Spark applies them again.

Writing: tasks write whole stores aside. When all have, the driver writes down what is to be moved, moves it, and strikes that out. A
failed job leaves every old file as it was; a driver lost while it moves leaves its list, which the next reader or
writer of the folder carries out first. Stores that no row names stay, in either mode.

Python opens the files, on driver and executors, so the folder must be one that pyarrow can open (shared disks, S3, GCS, HDFS).
What only Spark's readers can open is read by ``store.read_stores``.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import file_system
from .store import CONFIG_KEYS, CONFIG_TYPE, RESULT_KEYS, RESULT_TYPE, dumped, loaded, parsed_store, result_yaml

SCHEMA = f"file string, pos int, model string, provider string, timestamp string, ignorepatterns array<string>, singleline boolean, {RESULT_TYPE}, config struct<{CONFIG_TYPE}>, error string"
#: Files that one task reads, unless the option ``files`` says otherwise.
FILES = 64
#: Files that the driver moves at a time: on far stores a move is a wait.
_MOVERS = 16
_JOURNAL = ".moving-"
_ASIDE = ".aside-"
_HEAD = re.compile(r"^results:", re.M)


def _names(system, folder: str) -> list[str]:
    from pyarrow import fs

    return [f.base_name for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File]


def _put(system, path: str, data: bytes) -> None:
    with system.open_output_stream(path) as out:
        out.write(data)


def _get(system, path: str) -> bytes:
    with system.open_input_file(path) as f:
        return f.read()


def _exists(system, path: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(path).type != fs.FileType.NotFound


def recover(folder: str) -> None:
    """Carry out the moves that a lost driver had written down. Moves already made aren't made again."""
    system, at = file_system(folder)
    for name in _names(system, at):
        if name.startswith(_JOURNAL) and not name.endswith(".part"):
            _carry_out(system, at, name)


def _carry_out(system, at: str, journal: str) -> None:
    body = json.loads(_get(system, f"{at}/{journal}"))

    def move(pair: list) -> None:
        aside, name = pair
        if _exists(system, f"{at}/{body['aside']}/{aside}"):
            system.move(f"{at}/{body['aside']}/{aside}", f"{at}/{name}")

    with ThreadPoolExecutor(_MOVERS) as pool:  # each name is there once, so the order doesn't matter
        for _ in pool.map(move, body["moves"]):
            pass
    if _exists(system, f"{at}/{body['aside']}"):
        system.delete_dir(f"{at}/{body['aside']}")
    system.delete_file(f"{at}/{journal}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, files: int):
        self.path, self.size = path, files
        self.file_filters: list = []
        self.models: list[set] = []

    def pushFilters(self, filters):
        for f in filters:
            own = f.attribute == ("file",) and isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith))
            if own:
                self.file_filters.append(f)
            elif f.attribute == ("model",) and isinstance(f, (EqualTo, In)):
                self.models.append({f.value} if isinstance(f, EqualTo) else set(f.value))
            yield f  # applied again: a broken file has no model

    def _wanted(self, name: str) -> bool:
        for f in self.file_filters:
            if isinstance(f, StringStartsWith):
                if not name.startswith(f.value):
                    return False
            elif name not in (f.value if isinstance(f, In) else (f.value,)):
                return False
        return True

    def partitions(self):
        folder, pattern = (self.path, "*.yaml") if not self.path.endswith(".yaml") else posixpath.split(self.path)
        folder = folder or "."
        recover(folder)
        system, at = file_system(folder)
        names = sorted(n for n in _names(system, at) if fnmatch.fnmatchcase(n, pattern) and not n.startswith(".") and self._wanted(n))
        return [InputPartition((folder, names[k : k + self.size])) for k in range(0, len(names), self.size)] or [InputPartition((folder, []))]

    def read(self, partition):
        folder, names = partition.value
        system, at = file_system(folder)
        none = (None,) * (6 + len(RESULT_KEYS) + 1)
        for name in names:
            try:
                text = _get(system, f"{at}/{name}").decode()
                head = _HEAD.search(text)
                if self.models and head and text.startswith("config:"):
                    model = ((loaded(text[: head.start()]) or {}).get("config") or {}).get("model")
                    if any(str("" if model is None else model) not in m for m in self.models):
                        continue
                config, results = parsed_store(text)
            except Exception as e:  # a broken file is a row, not the end of the scan
                yield (name, *none, f"{type(e).__name__}: {e}"[:500])
                continue
            shown = [config[c] for c in ("model", "provider", "timestamp", "ignorepatterns", "singleline")]
            settings = tuple(config[n] for n, _ in CONFIG_KEYS)
            for pos, r in enumerate(results):
                yield (name, pos, *shown, *[r[c] for _, c, _ in RESULT_KEYS], settings, None)


@dataclass
class _Written(WriterCommitMessage):
    moves: list


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.aside = path, f"{_ASIDE}{uuid.uuid4().hex}"

    def write(self, iterator):
        """Each store's rows follow each other; an attempt has names of its own, so another one's files don't matter."""
        system, at = file_system(self.path)
        attempt, moves, now, out = uuid.uuid4().hex, [], None, None
        system.create_dir(f"{at}/{self.aside}", recursive=True)
        try:
            for row in iterator:
                if row["file"] != now:
                    if out:
                        out.close()
                    now = row["file"]
                    aside = f"{attempt}-{len(moves)}"
                    moves.append((aside, now))
                    out = system.open_output_stream(f"{at}/{self.aside}/{aside}")
                    out.write(dumped({"config": row["config"].asDict(recursive=True)}).encode() + b"results:\n")
                out.write(result_yaml(row).encode())
        finally:
            if out:
                out.close()
        return _Written(moves)

    def commit(self, messages):
        moves = [m for message in messages if message for m in message.moves]
        system, at = file_system(self.path)
        names = [name for _, name in moves]
        odd = [n for n in names if not n or "/" in n or n.startswith(".") or not n.endswith(".yaml")]
        if odd or len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"not the name of a store: {odd[0]!r}" if odd else "the rows of a store are in more than one partition; write_stores puts them together")
        journal = f"{_JOURNAL}{self.aside.removeprefix(_ASIDE)}"
        _put(system, f"{at}/{journal}.part", json.dumps({"aside": self.aside, "moves": moves}).encode())
        system.move(f"{at}/{journal}.part", f"{at}/{journal}")  # from here on the stores are as good as replaced
        _carry_out(system, at, journal)

    def abort(self, messages):
        system, at = file_system(self.path)
        if _exists(system, f"{at}/{self.aside}"):
            system.delete_dir(f"{at}/{self.aside}")


class EvalStore(DataSource):
    """Options: ``path``, a folder, a ``.yaml`` file or a pattern of such in a folder; ``files``, how many one task reads."""

    @classmethod
    def name(cls) -> str:
        return "evalstore"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("files", FILES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it be given filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EvalStore)


def scan(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("evalstore").load(path)


def write_stores(rows: DataFrame, folder: str) -> None:
    """Replace the stores that ``rows`` (as read, further columns aside) name, all or none of them, in one job."""
    register(rows.sparkSession)
    names = ["file", "pos", *[c for _, c, _ in RESULT_KEYS], "config"]
    whole = rows.select(*names).repartition("file").sortWithinPartitions("file", "pos")
    filled = {f.name: F.lit(None).cast(f.dataType) for f in StructType.fromDDL(SCHEMA) if f.name not in names}
    whole.withColumns(filled).select(StructType.fromDDL(SCHEMA).names).write.format("evalstore").mode("append").save(folder)

