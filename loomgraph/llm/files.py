"""Raw files in a shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    where, path = _at(uri)
    where.create_dir(path, recursive=True)


class Replacing:
    """A file that appears under its name only when whole, so a task that is run again replaces it."""

    def __init__(self, uri: str):
        self.fs, self.path = _at(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft)
        self.write = self.out.write

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)


def put(uri: str, data: bytes) -> None:
    f = Replacing(uri)
    f.write(data)
    f.close()


def get(uri: str) -> bytes:
    where, path = _at(uri)
    with where.open_input_stream(path) as f:
        return f.read()


def opened(uri: str):
    where, path = _at(uri)
    return where.open_input_file(path)
