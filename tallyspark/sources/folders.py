"""Shared folders as driver and Python workers reach them: any path that pyarrow has a file system for."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return (fs.LocalFileSystem(), path.rstrip("/")) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path.rstrip("/"))


def listed(system: fs.FileSystem, path: str, recursive: bool = False) -> list[fs.FileInfo]:
    """Files and folders in a folder, by path; none if there is no such folder."""
    return sorted(system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=recursive)), key=lambda f: f.path)


def exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


def removed(system: fs.FileSystem, path: str) -> None:
    if exists(system, path):
        system.delete_dir(path)


def replaced(system: fs.FileSystem, path: str, data: bytes) -> None:
    """Write a file under another name and rename it, so that nobody sees half of it."""
    made = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(made) as out:
        out.write(data)
    system.move(made, path)


def content(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path) as file:
        return file.read()
