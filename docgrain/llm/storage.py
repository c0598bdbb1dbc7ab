"""Files in shared storage, reached from executors by URI (local path, or any pyarrow filesystem)."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse


class Store:
    """A folder that every executor sees. ``file:`` and bare paths are mounts; other schemes go
    through ``pyarrow.fs`` (hdfs, s3, gs, ...). Files appear whole, by rename, or not at all."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        parts = urlparse(self.uri)
        self.local = parts.scheme in ("", "file")
        if self.local:
            self.root, self.fs = parts.path, None
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(self.uri)

    def create(self, name: str) -> _Writer:
        return _Writer(self, name)

    def reader(self, name: str):
        """A seekable binary file object."""
        path = f"{self.root}/{name}"
        return open(path, "rb", buffering=1 << 18) if self.local else self.fs.open_input_file(path)

    def delete(self) -> None:
        if self.local:
            import shutil

            shutil.rmtree(self.root, ignore_errors=True)
        else:
            self.fs.delete_dir(self.root)


class _Writer:
    """Writes ``name`` under a temporary name; ``close`` renames it, so retried tasks never mix."""

    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name
        self.temp = f"{store.root}/.{name}.{uuid.uuid4().hex}"
        self.at = 0
        if store.local:
            os.makedirs(store.root, exist_ok=True)
            self.out = open(self.temp, "wb", buffering=1 << 20)
        else:
            store.fs.create_dir(store.root, recursive=True)
            self.out = store.fs.open_output_stream(self.temp)

    def write(self, data: bytes) -> int:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        final = f"{self.store.root}/{self.name}"
        if self.store.local:
            os.replace(self.temp, final)
        else:
            self.store.fs.move(self.temp, final)

    def abandon(self) -> None:
        self.out.close()
        if self.store.local:
            os.unlink(self.temp)
        else:
            self.store.fs.delete_file(self.temp)
