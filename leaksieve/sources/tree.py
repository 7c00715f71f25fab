"""Trees of files, listed and read in tasks: every name, and what could not be read as rows.

The folders still to be listed are a table. Each task takes some, walks breadth-first below them until it has seen
``entries_per_task`` names, and hands the folders it did not get to back to the next round: a small tree is listed by one task in one
round, a large one by as many tasks as it has folders. Each round is written, so a lost executor costs one round,
and no path passes through the driver but the first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.session import ensure_checkpoint_dir

#: A path below the root ("." is the root itself), its bytes if known, and why it could not be listed.
LISTED = "path string, file string, size long, error string"
READ = "file string, size long, content binary, error string"
UNREAD = "file string, size long, error string"
TOO_LARGE = "larger than max_bytes"
_BATCH_BYTES = 32 << 20
_CHUNK_BYTES = 1 << 20

#: Makes the file system of a path, and the path as that one knows it.
Opener = Callable[[str], tuple[Any, str]]


def open_path(path: str) -> tuple[Any, str]:
    """None (the mounted file system) for plain paths and ``file:`` ones, else the Arrow file system of the scheme."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return None, path
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _walker(opener: Opener, root: str, suffixes: Sequence[str] | None, excluded: Sequence[str], budget: int) -> Callable:
    """A task's work on folders, self-contained so that it travels by value."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        from collections import deque

        system, base = opener(root)
        base = base.rstrip("/") or "/"
        names = ["path", "file", "size", "error", "is_left"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]

        def below(path: str) -> str:
            return path[len(base) :].lstrip("/") or "."

        def mounted(folder: str) -> Iterator[tuple]:
            with os.scandir(folder) as entries:
                for entry in entries:
                    name = os.fsencode(entry.name).decode("utf-8", "replace")
                    path = f"{folder.rstrip('/')}/{name}"
                    try:
                        if entry.is_dir():
                            # As a link may lead back, linked folders are not entered.
                            yield path, name, not entry.is_symlink(), None, None
                        elif name != entry.name:
                            yield path, name, None, None, "name is no UTF-8"
                        else:
                            yield path, name, None, entry.stat().st_size, None
                    except OSError as problem:
                        yield path, name, None, None, type(problem).__name__

        def elsewhere(folder: str) -> Iterator[tuple]:
            from pyarrow.fs import FileSelector, FileType

            for info in system.get_file_info(FileSelector(folder)):
                yield info.path, info.base_name, True if info.type == FileType.Directory else None, info.size, None

        def is_file(path: str) -> int | None:
            if system is None:
                return os.stat(path).st_size if os.path.isfile(path) else None
            info = system.get_file_info(path)
            return info.size if info.is_file else None

        def wanted(name: str) -> bool:
            dot = name.rfind(".")
            return suffixes is None or (dot > 0 and name[dot:] in suffixes)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        rows: list[tuple] = []
        for batch in batches:
            for start in batch.column("path").to_pylist():
                left, seen = deque([start]), 0
                while left and seen < budget:
                    folder = left.popleft()
                    try:
                        size = is_file(folder) if folder == base else None
                        if size is not None:
                            rows.append((folder, ".", size, None, False))
                            continue
                        for path, name, enter, size, error in mounted(folder) if system is None else elsewhere(folder):
                            seen += 1
                            if enter and name not in excluded:
                                left.append(path)
                            elif enter is None and wanted(name):
                                rows.append((path, below(path), size, error, False))
                            if len(rows) >= 10_000:
                                yield batch_of(rows)
                                rows = []
                    except OSError as problem:
                        rows.append((folder, below(folder), None, type(problem).__name__, False))
                rows += [(folder, below(folder), None, None, True) for folder in left]
        if rows:
            yield batch_of(rows)

    return walk


def list_tree(
    spark: SparkSession,
    root: str,
    *,
    suffixes: Sequence[str] | None = None,
    excluded: Sequence[str] = (),
    opener: Opener = open_path,
    entries_per_task: int = 20_000,
) -> DataFrame:
    """The files below ``root``, or ``root`` itself if it is a file (of any suffix, named ``.``), and folders that could not be listed.

    ``excluded`` names folders that are not entered; if one is on the way to ``root``, nothing is listed.
    """
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    _, base = opener(root)
    starts = [] if set(base.split("/")) & set(excluded) else [(base.rstrip("/") or "/",)]
    walk = _walker(opener, root, suffixes, excluded, entries_per_task)
    schema = f"{LISTED}, is_left boolean"
    folders, number = spark.createDataFrame(starts, "path string").coalesce(1), 0
    while True:
        folders.mapInArrow(walk, schema).write.parquet(f"{out}/round={number}")
        left = spark.read.schema(schema).parquet(f"{out}/round={number}").where("is_left").select("path")
        waiting = left.count()
        if not waiting:
            break
        number += 1
        folders = left.repartition(min(waiting, max(spark.sparkContext.defaultParallelism, waiting // 100)))
    rounds = [f"{out}/round={k}" for k in range(number + 1)]
    return spark.read.schema(schema).parquet(*rounds).where("NOT is_left").drop("is_left")


def read_listed(
    listing: DataFrame, root: str, *, max_bytes: int | None = None, opener: Opener = open_path, bytes_per_task: int = 64 << 20
) -> DataFrame:
    """The listed files with their ``content``, which is null where ``error`` says why there is none.

    Files are dealt out to as many tasks as their bytes ask for.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opener(root)
        types = [pa.string(), pa.int64(), pa.binary(), pa.string()]

        def content_of(path: str) -> bytes:
            if system is None:
                with open(path, "rb") as handle:
                    return handle.read()
            with system.open_input_stream(path) as handle:
                return handle.read()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "size", "content", "error"]
            )

        rows, held = [], 0
        for batch in batches:
            for path, file, size, error in zip(*(batch.column(n).to_pylist() for n in ("path", "file", "size", "error")), strict=True):
                content = None
                if error is None and max_bytes is not None and size > max_bytes:
                    error = TOO_LARGE
                if error is None:
                    try:
                        content = content_of(path)
                    except OSError as problem:
                        error = type(problem).__name__
                rows.append((file, size, content, error))
                held += len(content or b"") + 200
                if held > _BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return _dealt(listing, bytes_per_task).mapInArrow(read, READ)


def unread_listed(
    listing: DataFrame, root: str, *, max_bytes: int | None = None, opener: Opener = open_path, bytes_per_task: int = 64 << 20
) -> DataFrame:
    """Those of the listed files that ``read_listed`` gives no content for, and why.

    Every file is read to its end, as it may break off anywhere, but piece by piece: no content is kept or leaves its task.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opener(root)
        types = [pa.string(), pa.int64(), pa.string()]

        def problem_of(path: str) -> str | None:
            try:
                with open(path, "rb", buffering=0) if system is None else system.open_input_stream(path) as handle:
                    while handle.read(_CHUNK_BYTES):
                        pass
            except OSError as problem:
                return type(problem).__name__
            return None

        for batch in batches:
            rows = []
            for path, file, size, error in zip(*(batch.column(n) for n in ("path", "file", "size", "error")), strict=True):
                size, error = size.as_py(), error.as_py()
                if error is None and max_bytes is not None and size > max_bytes:
                    error = TOO_LARGE
                if error is None:
                    error = problem_of(path.as_py())
                if error is not None:
                    rows.append((file.as_py(), size, error))
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "size", "error"])

    return _dealt(listing, bytes_per_task).mapInArrow(check, UNREAD)


def _dealt(listing: DataFrame, bytes_per_task: int) -> DataFrame:
    total = listing.agg(F.sum(F.coalesce("size", F.lit(0)) + 4096).alias("n")).first().n or 0
    return listing.repartition(max(listing.sparkSession.sparkContext.defaultParallelism, total // bytes_per_task))
