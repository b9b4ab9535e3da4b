"""Files whose names carry meaning: the folder of ``prompt_<n>.txt`` and
``code_<n>.txt`` (I4/S2), and ``<run>/training_metrics.json`` (I6).

``PairFolder`` is a Spark data source that reads such a folder: the listing is
paired up first (J6: the union of the indices, so no row is ever shuffled) and dealt
out; each task opens only its own files.  ``NamedFiles`` writes rows ``(name,
content)`` as one file each.  A task puts its files into place itself: a file is
written under a hidden name and renamed, so that a reader never sees half a file and
a repeated attempt replaces its files with the same ones.  The job's commit leaves
``_SUCCESS``.

Files are reached through ``pyarrow.fs``: plain paths, ``file:`` and the stores it
knows (s3, gs, hdfs).  ``sources.readers.read_pair_folder`` reads a folder in any
store that Spark knows.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# --- fixed values: file names ---------------------------------------------------
FILE_NAME = re.compile(r"(prompt|code)_(\d+)\.txt")
KINDS = ("prompt", "code")
FORMAT = "pair_folder"


def _store(path: str):
    """The file system of a path, and the path within it."""
    from pyarrow import fs
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


@dataclass
class _Pairs(InputPartition):
    """Indices as written in the names, and which sides there are."""
    pairs: list[tuple[str, bool, bool]]


@dataclass
class _Written(WriterCommitMessage):
    files: int


def paired_names(names: list[str]) -> list[tuple[str, bool, bool]]:
    """(index, has a prompt, has a code) of the file names that belong, by number."""
    sides: dict[str, set] = {}
    for name in names:
        if m := FILE_NAME.fullmatch(name):
            sides.setdefault(m[2], set()).add(m[1])
    return [(i, *(k in sides[i] for k in KINDS)) for i in sorted(sides, key=lambda i: (int(i), i))]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.size = int(options.get("pairsperpartition", 1000))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs
        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root))          # raises where there is no folder
        pairs = paired_names([f.base_name for f in found if f.is_file])
        return [_Pairs(pairs[a:a + self.size]) for a in range(0, len(pairs), self.size)] or [_Pairs([])]

    def read(self, partition: _Pairs) -> Iterator[tuple]:
        store, root = _store(self.path)

        def content(kind: str, index: str) -> str:
            with store.open_input_stream(f"{root}/{kind}_{index}.txt") as f:
                return io.TextIOWrapper(io.BytesIO(f.read()), encoding="utf-8").read().strip()   # any line ends become \n

        for index, *there in partition.pairs:
            sides = [content(k, index) if t else "" for k, t in zip(KINDS, there)]
            if any(sides):
                yield (int(index), *sides)


class PairFolder(DataSource):
    """``spark.read.format("pair_folder").load(folder)``: ``idx, prompt, code``.  A
    missing file is an empty side; contents are stripped; a pair with two empty sides
    is left out.  Indices are paired by their text, so ``prompt_01`` and ``code_1`` are
    two pairs.  Other files are ignored.  Text that is not UTF-8 is an error."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "idx long, prompt string, code string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Writer(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path = options["path"]
        if overwrite and (ours := options.get("replaces")):
            from pyarrow import fs
            store, root = _store(self.path)
            for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
                if f.is_file and re.fullmatch(f"{ours}|_SUCCESS", f.path[len(root):].strip("/")):
                    store.delete_file(f.path)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        n, attempt = 0, uuid.uuid4().hex
        for row in rows:
            name = row["name"]
            if not name or any(part in ("", ".", "..") for part in name.split("/")):
                raise ValueError(f"not a file name: {name!r}")
            folder, _, last = name.rpartition("/")
            if folder:
                store.create_dir(f"{root}/{folder}", recursive=True)
            hidden = "/".join(x for x in (root, folder, f".{last}.{attempt}") if x)
            with store.open_output_stream(hidden) as f:
                f.write((row["content"] or "").encode("utf-8"))
            store.move(hidden, f"{root}/{name}")
            n += 1
        return _Written(n)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_SUCCESS") as f:
            f.write(str(sum(m.files for m in messages if m)).encode())


class NamedFiles(DataSource):
    """``df.write.format("named_files").save(folder)`` of rows ``(name, content)``:
    a file each, UTF-8, names relative to the folder.  ``overwrite`` first removes
    the files that match the option ``replaces`` (a pattern of relative names);
    ``append`` replaces files of the same name and keeps the others."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def read_pair_files(spark: SparkSession, folder: str, pairs_per_partition: int = 1000) -> DataFrame:
    """I4: the pairs of a folder, ``idx, prompt, code``."""
    spark.dataSource.register(PairFolder)
    return spark.read.format(FORMAT).option("pairsPerPartition", pairs_per_partition).load(folder)


def write_named_files(files: DataFrame, folder: str, replaces: str, mode: str = "overwrite") -> None:
    """Rows ``(name, content)`` as files under ``folder``."""
    files.sparkSession.dataSource.register(NamedFiles)
    (files.select(files["name"].cast("string"), files["content"].cast("string"))
        .write.format("named_files").option("replaces", replaces).mode(mode).save(folder))


def write_pair_files(pairs: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Two files a pair ``(idx, prompt, code)``; a null side has no file.  A pair
    without an index is an error."""
    index = F.coalesce(F.col("idx").cast("long").cast("string"), F.raise_error(F.lit("a pair without an index")).cast("string"))
    sides = F.inline(F.array(*(F.struct(F.concat(F.lit(f"{k}_"), index, F.lit(".txt")).alias("name"), F.col(k).alias("content"))
                               for k in KINDS)))
    write_named_files(pairs.select(sides).where("content IS NOT NULL"), folder, FILE_NAME.pattern, mode)


def write_metric_history(runs: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Each run's history (D10) as ``<run_id>/training_metrics.json``, one object a
    file.  Runs ``(run_id, training_time_seconds, metrics_history)``; a run is one row."""
    record = F.to_json(F.struct("training_time_seconds", "metrics_history"))
    write_named_files(runs.select(F.concat(F.col("run_id").cast("string"), F.lit("/training_metrics.json")).alias("name"),
                                  record.alias("content")), folder, r"[^/]+/training_metrics\.json", mode)
