"""Folders that the driver and all executors share, tables written there to cut lineage, and files that Python workers read and write there."""

from __future__ import annotations

import pyarrow.fs

from ..sources.shared import new_folder, shared_folder, written

__all__ = ["file_system", "new_folder", "shared_folder", "written"]


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A file system and the path in it, for Python workers that read or write files of the shared folder."""
    return pyarrow.fs.FileSystem.from_uri(uri)
