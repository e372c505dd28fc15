"""Arrays as files of the folder that all executors share, written by one task and memory-mapped by others."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np


def local_path(path: str) -> str | None:
    """The path of a file URI or plain path, null for another file system."""
    if "://" in path and not path.startswith("file:"):
        return None
    path = path.removeprefix("file:")
    return "/" + path.lstrip("/") if path.startswith("/") else path


def write_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """One file of all arrays, one after the other. A task that runs again replaces it with the same content."""
    target = local_path(path)
    if target is None:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_output_stream(inner) as out:
            for a in arrays:
                out.write(np.ascontiguousarray(a).tobytes())
        return
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        for a in arrays:
            np.ascontiguousarray(a).tofile(out)
    os.replace(part, target)


def map_arrays(path: str, shapes: list[tuple[str, int]]) -> list[np.ndarray]:
    """The arrays of a file by (type, length), mapped. From another file system it is copied; the copy is unlinked at once."""
    target = local_path(path)
    if target is None:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_stream(inner) as source, tempfile.TemporaryFile() as copy:
            while chunk := source.read(1 << 24):
                copy.write(chunk)
            copy.flush()
            raw = np.memmap(copy, np.uint8, "r") if copy.tell() else np.zeros(0, np.uint8)
    else:
        raw = np.memmap(target, np.uint8, "r") if os.path.getsize(target) else np.zeros(0, np.uint8)
    out, at = [], 0
    for kind, n in shapes:
        size = np.dtype(kind).itemsize * n
        out.append(raw[at : at + size].view(kind))
        at += size
    return out
