"""A sink that writes one named file per row, all of a job's files or none.

``df.write.format("named_files").mode("append").save(folder)`` with the columns file_name and payload. Tasks write into a
folder of their own attempt below ``_staging`` and report it in their commit message. When every task has succeeded,
the reported files move to their names; whatever a failed, repeated or speculative attempt has left is removed
with the staging folder. If the job fails nothing but the staging folder was touched. ``folder`` is a path or URI of a
file system that all workers share and pyarrow can open (local or mounted, HDFS, S3, GCS).

An attempt's folder has subfolders of at most ``LISTED`` files; the commit lists and moves one at a time, so the driver
holds as many names, however many files a job writes. ``read`` opens files by name on the workers and lists none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lineaudit.sources.files import opened

#: Files of a staging subfolder, and of those that a task reads at once.
LISTED = 1000
READ = 64


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.job = uuid.uuid4().hex
        system, root = opened(folder)
        # Tasks make their folders in this one only; none appears after an abort has removed it.
        system.create_dir(self._staging(root))

    def _staging(self, root: str) -> str:
        return f"{root}/_staging/{self.job}"

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = opened(self.folder)
        attempt, n = uuid.uuid4().hex, 0
        place = f"{self._staging(root)}/{attempt}"
        for row in rows:
            if n % LISTED == 0:
                if n == 0:
                    system.create_dir(place, recursive=False)
                system.create_dir(f"{place}/{n // LISTED}", recursive=False)
            name, payload = row["file_name"], row["payload"]
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"not a file name: {name!r}")
            with system.open_output_stream(f"{place}/{n // LISTED}/{name}") as out:
                out.write(payload.encode("utf-8") if isinstance(payload, str) else bytes(payload or b""))
            n += 1
        return Written(attempt, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.folder)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root)):
                if info.type == fs.FileType.File:
                    system.delete_file(info.path)
        # Renames only; file by file, as names must not carry their attempt.
        with ThreadPoolExecutor(16) as pool:
            for m in messages:
                for i in range(0, m.files if m is not None else 0, LISTED):
                    place = f"{self._staging(root)}/{m.attempt}/{i // LISTED}"
                    moves = [info.path for info in system.get_file_info(fs.FileSelector(place))]
                    list(pool.map(lambda p: system.move(p, f"{root}/{p.rsplit('/', 1)[1]}"), moves))
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.folder))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(self._staging(root)).type != fs.FileType.NotFound:
            system.delete_dir(self._staging(root))
        staging = f"{root}/_staging"
        # Another job may be writing beside this one.
        if system.get_file_info(staging).type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(staging)):
            system.delete_dir(staging)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file_name string, payload string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        missing = {"file_name", "payload"} - set(schema.names)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)


def read(names: DataFrame, folder: str) -> DataFrame:
    """(file_name, content) of the files of ``folder`` that ``names`` has under ``file_name``, each once.

    The workers open the files by their names. A listing of the folder, as Spark's own readers make it, would hold an entry
    per file in the driver.
    """
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)

        def content(name: str) -> bytes:
            with system.open_input_stream(f"{root}/{name}", compression=None) as file:
                return file.read()

        with ThreadPoolExecutor(8) as pool:
            for chunk in chunks:
                for lo in range(0, chunk.num_rows, READ):
                    some = chunk.column(0).slice(lo, READ)
                    found = pa.array(list(pool.map(content, some.to_pylist())), pa.binary())
                    yield pa.RecordBatch.from_arrays([some, found], names=["file_name", "content"])

    # Names are few bytes and files are many: a fixed partition count keeps adaptive execution from merging them by size.
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = names.select("file_name").repartition(parts, "file_name").distinct()
    return each.mapInArrow(run, "file_name string, content binary")
