"""A folder tree as a table of files, whatever the names in it.

Spark's own file sources leave out every name that begins with a dot or an underscore, and with them ``.env`` files,
``__init__.py`` and ignore files. Here the folders are rows. A round lists every folder that is open, over as many tasks as there are
bounded portions of them, and writes what it found; a task goes on below its own folders up to that bound, and what is then open is dealt out anew in
the next round, until none is left. So a chain of folders costs few rounds, a wide level costs one however many folders it has, and the wide end of a
chain is spread over all tasks however deep it lies. The files found are spread again and read there.

What cannot be listed or read becomes a row with the reason, and the rest goes on. Names that are no UTF-8 are kept as bytes beside a
readable form. The driver sees the number of open folders of a round and nothing else.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.session import durable

# Functions of this module run on executors, which need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of contents that one Arrow batch of a task holds; a larger file is a batch of its own.
BATCH_BYTES = 8 << 20
#: Folders that a task lists in one round, before what it found and left open is dealt out again.
FOLDERS_A_ROUND = 256
#: Tasks of one round at most; with more open folders than these take, every task is given more.
TASKS_A_ROUND = 10_000

FILE, FOLDER, UNREAD = "file", "folder", "unread"
#: ``raw`` is the path as the file system has it, ``path`` the same as text.
ENTRY = "root string, path string, raw binary, kind string, size bigint, reason string"


def _system(root: str):
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    return system, base.rstrip("/"), isinstance(system, fs.LocalFileSystem)


def _reason(e: OSError) -> str:
    return f"{type(e).__name__}: {e.strerror or e}"


def _list(root: str, raw: bytes) -> list[tuple[bytes, str, int, str | None]]:
    """Entries of one folder of the tree: (path below the root, kind, size, reason). Links to folders are not followed."""
    import os

    from pyarrow import fs

    system, base, local = _system(root)
    path = os.fsdecode(raw)
    folder = f"{base}/{path}" if path else base or "/"
    below = lambda name: os.fsencode(f"{path}/{name}" if path else name)
    try:
        if not local:
            listed = system.get_file_info(fs.FileSelector(folder))
            kinds = {fs.FileType.Directory: FOLDER, fs.FileType.File: FILE}
            return [(x.path[len(base) :].lstrip("/").encode(), kinds[x.type], x.size or 0, None) for x in listed if x.type in kinds]
        with os.scandir(folder) as listed:
            entries = list(listed)
    except OSError as e:
        if not path:
            raise
        return [(raw, UNREAD, 0, _reason(e))]
    out = []
    for e in entries:
        try:
            if e.is_dir(follow_symlinks=False):
                out.append((below(e.name), FOLDER, 0, None))
            elif e.is_file():
                out.append((below(e.name), FILE, e.stat().st_size, None))
            elif e.is_symlink() and not os.path.exists(e.path):
                out.append((below(e.name), UNREAD, 0, "a link that leads nowhere"))
        except OSError as error:
            out.append((below(e.name), UNREAD, 0, _reason(error)))
    return out


def _lister(pruned: list[str], most: int):
    """Lists the folders given, and those found in them up to ``most`` in all; folders left open stay rows."""
    import os
    from collections import deque

    skip = {os.fsencode(name) for name in pruned}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              names=["root", "path", "raw", "kind", "size", "reason"])

        rows, todo, listed = [], deque(), 0
        for given in batches:
            todo.extend(zip(given.column("root").to_pylist(), given.column("raw").to_pylist(), strict=True))
        own = len(todo)
        while todo and listed < max(most, own):
            root, folder = todo.popleft()
            listed += 1
            for raw, kind, size, reason in _list(root, folder):
                if kind == FOLDER:
                    if raw.rpartition(b"/")[2] not in skip:
                        todo.append((root, raw))
                    continue
                rows.append((root, raw.decode("utf-8", "replace"), raw, kind, size, reason))
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
        rows += [(root, raw.decode("utf-8", "replace"), raw, FOLDER, 0, None) for root, raw in todo]
        yield batch(rows)

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of files as text; malformed bytes become replacement marks, a file that cannot be read gives the reason."""
    import os

    def batch(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["root", "path", "text", "reason"])

    rows, held = [], 0
    for given in batches:
        for root, path, raw in zip(*[given.column(c).to_pylist() for c in ("root", "path", "raw")], strict=True):
            system, base, local = _system(root)
            try:
                if local:
                    with open(os.fsencode(base) + b"/" + raw, "rb") as stream:
                        data = stream.read()
                else:
                    with system.open_input_stream(f"{base}/{raw.decode()}") as stream:
                        data = stream.read()
            except OSError as e:
                rows.append((root, path, None, _reason(e)))
                continue
            rows.append((root, path, data.decode("utf-8", "replace"), None))
            held += len(data)
            if held >= BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
    yield batch(rows)


def list_entries(roots: DataFrame, pruned: list[str]) -> DataFrame:
    """Every file below the folders in ``roots`` (a column ``root``), and every entry that could not be listed, as ``ENTRY``.

    Folders named in ``pruned`` are not entered. An empty folder, and one without files, gives no row. A root that is not there is
    an error.
    """
    still = roots.select("root", F.lit("").alias("path"), F.lit(b"").alias("raw"), F.lit(FOLDER).alias("kind"),
                         F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("reason"))
    found = None
    left = still.count()
    while True:
        # a stated number of tasks, as adaptive execution goes by the bytes of the names and would give all folders to one
        tasks = min(-(-left // FOLDERS_A_ROUND), TASKS_A_ROUND)
        listed = durable(still.repartition(max(tasks, 1), "root", "raw").mapInArrow(_lister(pruned, FOLDERS_A_ROUND), ENTRY))
        entries = listed.where(F.col("kind") != FOLDER)
        found = entries if found is None else found.unionAll(entries)
        still = listed.where(F.col("kind") == FOLDER)
        left = still.count()
        if not left:
            return found


def list_files(roots: DataFrame, pruned: list[str]) -> DataFrame:
    """Every file below the folders in ``roots``: root, path (below the root), raw and size. See ``list_entries``."""
    return list_entries(roots, pruned).where(F.col("kind") == FILE).select("root", "path", "raw", "size")


def read_entries(files: DataFrame) -> DataFrame:
    """Listed files as root, path, text and reason: the text is null where there is a reason why it could not be read."""
    # a stated number of tasks, as the names that shuffle say nothing about the bytes that are read
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("root", "path", "raw").repartition(tasks, "root", "raw").mapInArrow(
        _reader, "root string, path string, text string, reason string")


def read_files(files: DataFrame) -> DataFrame:
    """The texts of listed files: root, path, text. Files are spread over tasks by their names; those that cannot be read are left out."""
    return read_entries(files).where("reason IS NULL").drop("reason")


def unread_entries(roots: DataFrame, pruned: list[str]) -> DataFrame:
    """What lies below the folders in ``roots`` and could not be listed or read: root, path, reason. Reads every file."""
    entries = durable(list_entries(roots, pruned))
    unlisted = entries.where(F.col("kind") == UNREAD).select("root", "path", "reason")
    return unlisted.unionAll(read_entries(entries.where(F.col("kind") == FILE)).where("reason IS NOT NULL").drop("text").select("root", "path", "reason"))


def tree_of(spark: SparkSession, root: str, pruned: list[str]) -> DataFrame:
    return list_files(spark.createDataFrame([(root,)], "root string"), pruned)


def _writer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        base, made, n = base.rstrip("/"), set(), 0
        for given in batches:
            for path, text in zip(given.column("path").to_pylist(), given.column("text").to_pylist(), strict=True):
                folder = f"{base}/{path}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{path}") as stream:
                    stream.write((text or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def write_files(files: DataFrame, root: str) -> int:
    """Write each row (path, text) as a file below ``root``; the number of files.

    A task that runs again writes the same files again.
    """
    written = files.select("path", "text").mapInArrow(_writer(root), "n bigint").agg(F.sum("n")).first()[0]
    return written or 0
