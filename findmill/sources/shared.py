"""Small files in a folder that driver and executors share: each is there whole or not at all."""

from __future__ import annotations

import uuid

from pyarrow import fs


class Shared:
    """A folder by path or address, usable in driver and tasks alike."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _at(self, name: str = "") -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(f"{self.folder}/{name}".rstrip("/"))

    def below(self, name: str) -> Shared:
        return Shared(f"{self.folder}/{name}")

    def put(self, name: str, data: bytes) -> None:
        """Write a file under another name that readers skip, then move it to its place."""
        store, path = self._at(name)
        parent, _, last = path.rpartition("/")
        store.create_dir(parent, recursive=True)
        passing = f"{parent}/.{last}-{uuid.uuid4().hex}"
        with store.open_output_stream(passing) as out:
            out.write(data)
        store.move(passing, path)

    def get(self, name: str) -> bytes | None:
        store, path = self._at(name)
        if not self.has(name):
            return None
        with store.open_input_stream(path) as f:
            return f.read()

    def has(self, name: str) -> bool:
        store, path = self._at(name)
        return store.get_file_info(path).type != fs.FileType.NotFound

    def names(self) -> list[str]:
        """Of the files and folders inside, without those being written; none if there is no such folder."""
        store, path = self._at()
        if store.get_file_info(path).type != fs.FileType.Directory:
            return []
        found = store.get_file_info(fs.FileSelector(path))
        return sorted(x.base_name for x in found if not x.base_name.startswith("."))

    def drop(self, name: str) -> None:
        store, path = self._at(name)
        if self.has(name):
            store.delete_file(path)
