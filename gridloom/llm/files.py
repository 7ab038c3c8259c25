"""Files in the shared folder, opened inside tasks through Arrow's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str) -> Iterator:
    """A stream that becomes the file at `uri` only when all is written; a repeated task replaces it."""
    store, path = at(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex[:8]}.draft"
    try:
        with store.open_output_stream(draft) as out:
            yield out
    except BaseException:
        store.delete_file(draft)
        raise
    store.move(draft, path)


def reading(uri: str):
    """A random-access file; local files are memory-mapped."""
    store, path = at(uri)
    if isinstance(store, fs.LocalFileSystem):
        import pyarrow as pa

        return pa.memory_map(path)
    return store.open_input_file(path)


def remove(uri: str) -> None:
    """Removes a folder with all that lies in it."""
    store, path = at(uri)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)
