"""Files in any store that Arrow can reach, by URI: ranges of bytes to read, and writes that are whole or absent."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

import pyarrow.fs


def store_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a URI; a path without a scheme is local, and file:/x is file:///x."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return pyarrow.fs.FileSystem.from_uri(uri if re.match(r"[a-z0-9+.-]+://", uri) else f"file://{uri}")


def open_uri(uri: str) -> pyarrow.NativeFile:
    files, path = store_of(uri)
    return files.open_input_file(path)


def read_bytes(uri: str) -> bytes | None:
    """The content of a file, None if there is none."""
    try:
        with open_uri(uri) as f:
            return f.read()
    except FileNotFoundError:
        return None


@contextlib.contextmanager
def open_output(uri: str) -> Iterator[pyarrow.NativeFile]:
    """A file that appears under its name when all is written; until then it lies beside it under another."""
    files, path = store_of(uri)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(beside) as f:
        yield f
    files.move(beside, path)
