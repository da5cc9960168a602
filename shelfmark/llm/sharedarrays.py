"""Sorted numpy arrays in the shared folder: dealt between tasks as packed blobs, written once, mapped by every worker.

A writer puts its file under another name first and renames it, so a task that
is run again after a lost executor only replaces a file by an equal one.
"""

from __future__ import annotations

import io
import os
import uuid
from urllib.parse import urlparse

import numpy as np
import zstandard


def _local(folder: str) -> str | None:
    at = urlparse(folder)
    return at.path if at.scheme in ("", "file") else None


def write_bytes(folder: str, name: str, held: bytes | memoryview) -> None:
    """A file in the shared folder, written under another name and renamed."""
    own = f".{name}-{uuid.uuid4().hex}"
    local = _local(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        with open(f"{local}/{own}", "wb") as out:
            out.write(held)
        os.replace(f"{local}/{own}", f"{local}/{name}")
        return
    from pyarrow.fs import FileSystem

    system, path = FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{own}") as out:
        out.write(held)
    system.move(f"{path}/{own}", f"{path}/{name}")


def read_bytes(folder: str, name: str) -> bytes:
    local = _local(folder)
    if local is not None:
        with open(f"{local}/{name}", "rb") as held:
            return held.read()
    from pyarrow.fs import FileSystem

    system, path = FileSystem.from_uri(folder)
    with system.open_input_file(f"{path}/{name}") as held:
        return held.read()


def save(folder: str, name: str, array: np.ndarray) -> None:
    np.save(held := io.BytesIO(), array)
    write_bytes(folder, f"{name}.npy", held.getbuffer())


def load(folder: str, name: str) -> np.ndarray:
    """The array, memory-mapped where the shared folder is mounted and read elsewhere."""
    local = _local(folder)
    if local is not None:
        return np.asarray(np.load(f"{local}/{name}.npy", mmap_mode="r"))
    return np.load(io.BytesIO(read_bytes(folder, f"{name}.npy")))


def pack(array: np.ndarray, rising: bool = False) -> bytes:
    """A compressed blob; byte planes are stored one after another, ``rising`` values as their steps."""
    own = np.diff(array, prepend=array[:1] * 0) if rising else array
    planes = np.ascontiguousarray(own).view(np.uint8).reshape(len(own), own.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, kind: str, rising: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    own = np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)
    return np.cumsum(own, dtype=kind) if rising else own


def sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts
