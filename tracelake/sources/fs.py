"""Files by path or by any address that Arrow's filesystems know (file:, hdfs:, s3:, gs:), for tasks and driver alike."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The filesystem that holds `path`, and its path there. `file:/x`, as Spark writes it, is a local path."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri("s3://" + path[6:] if path.startswith("s3a://") else path)  # Spark's name for it
    return fs.LocalFileSystem(), "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def join(folder: str, name: str) -> str:
    return posixpath.join(folder, name)


def open_file(path: str):
    """A readable binary stream that can seek."""
    system, inner = locate(path)
    return system.open_input_file(inner)


@contextmanager
def finished(path: str, part: str) -> Iterator:
    """A stream to write `part` with, which takes the name `path` once all went well and is removed otherwise."""
    system, at = locate(part)
    try:
        with system.open_output_stream(at) as out:
            yield out
        move(part, path)
    except BaseException:
        if exists(part):
            system.delete_file(at)
        raise


def exists(path: str) -> bool:
    system, inner = locate(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def size(path: str) -> int:
    system, inner = locate(path)
    return system.get_file_info(inner).size


def move(path: str, to: str) -> None:
    """Rename; what is at `to` is replaced, so a task that runs twice leaves one file."""
    system, inner = locate(path)
    if system.type_name != "local" and exists(to):
        system.delete_file(locate(to)[1])
    system.move(inner, locate(to)[1])


def make_folder(path: str) -> None:
    system, inner = locate(path)
    system.create_dir(inner, recursive=True)


def remove(path: str) -> None:
    """A file or a whole folder; nothing where there is none."""
    system, inner = locate(path)
    kind = system.get_file_info(inner).type
    if kind == fs.FileType.Directory:
        system.delete_dir(inner)
    elif kind != fs.FileType.NotFound:
        system.delete_file(inner)


def names(folder: str) -> list[str]:
    system, inner = locate(folder)
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(inner)))
