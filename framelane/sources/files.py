"""Files by path or URI, for Python data sources; Arrow's file systems do the work."""

from __future__ import annotations

import re

from pyarrow import fs


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (``/a``, ``file:/a``, ``s3://...``, ``hdfs://...``) and the path inside it."""
    if not re.match(r"[a-z][a-z0-9+.-]*:", path):
        return fs.LocalFileSystem(), path.rstrip("/")
    system, inside = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system, inside.rstrip("/")
