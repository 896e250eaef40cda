"""Arrays that executors write into the shared folder and that workers map into memory."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _place(url: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^[a-z0-9]+:/", url):
        return fs.FileSystem.from_uri(url if "://" in url else url.replace(":/", ":///", 1))
    return fs.LocalFileSystem(), url


def write(url: str, array: np.ndarray) -> None:
    """Write whole or not at all, so that a task may be run again at any time."""
    store, path = _place(url)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(memoryview(np.ascontiguousarray(array)).cast("B") if array.size else b"")
    store.move(part, path)


def mapped(url: str, dtype, length: int) -> np.ndarray:
    """The array, mapped read-only. Files of a local or mounted folder are mapped where they lie; others by an unnamed copy."""
    if not length:
        return np.zeros(0, dtype)
    store, path = _place(url)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r", shape=(length,))
    with tempfile.NamedTemporaryFile() as copy:
        with store.open_input_stream(path) as src:
            while block := src.read(8 << 20):
                copy.write(block)
        copy.flush()
        return np.memmap(copy.name, dtype=dtype, mode="r", shape=(length,))  # the mapping outlives the name


def remove(url: str) -> None:
    store, path = _place(url)
    store.delete_dir(path)
