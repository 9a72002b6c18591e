"""Files that executors open themselves, in parts: by any file system that pyarrow knows (local, S3, GCS, HDFS)."""

from __future__ import annotations

import fnmatch

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path on it) of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri)


def listed(uri: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, of the files of a folder, or of those that a pattern in the last part of the path fits."""
    folder, _, last = uri.rstrip("/").rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    where = folder if pattern else uri
    system, path = opened(where)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    found = [i for i in system.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File]
    shown = [i for i in found if not i.base_name.startswith(("_", ".")) and fnmatch.fnmatch(i.base_name, pattern or "*")]
    return sorted((f"{where.rstrip('/')}/{i.base_name}", i.size) for i in shown)


def read_range(uri: str, start: int, size: int) -> bytes:
    """Bytes from `start`, fewer than `size` only at the end of the file."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        return f.read_at(size, start)
