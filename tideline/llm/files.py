"""Own file formats in the shared folder, written and read inside tasks through Arrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("/"):
        uri = "file://" + uri
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def own_name(folder: str, stem: str, end: str) -> str:
    """A path that no other attempt of this task writes; only files that a finished task reports are read."""
    from pyspark import TaskContext

    t = TaskContext.get()
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    return f"{folder}/{stem}-{t.partitionId():06d}-{t.taskAttemptId()}{end}"


def opened(uri: str):
    system, path = place(uri)
    return system.open_input_file(path)


def created(uri: str):
    system, path = place(uri)
    return system.open_output_stream(path, compression=None)
