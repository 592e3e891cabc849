"""Whole segment files in a store of objects: put, get, list, and raw ranges of bytes."""

from __future__ import annotations

import uuid

from pyarrow import fs as arrow_fs

from tidelog.sources.stream import _open


class ColdStore:
    """Objects below a path or URI, by name. An object is there whole or not at all."""

    def __init__(self, path: str):
        self.store, root = _open(path)
        self.root = root.rstrip("/")

    def _at(self, name: str) -> str:
        if not name or name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"not an object's name: {name!r}")
        return f"{self.root}/{name}"

    def put(self, name: str, data: bytes) -> None:
        """Written under another name first, so a crash leaves no half object. Again with the same bytes changes nothing."""
        target = self._at(name)
        part = f"{target}.{uuid.uuid4().hex}.part"
        self.store.create_dir(target.rsplit("/", 1)[0], recursive=True)
        with self.store.open_output_stream(part) as f:
            f.write(data)
        self.store.move(part, target)

    def get(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        """An object's bytes, or a range of them, as they are; past the end there are none."""
        if start < 0 or length is not None and length < 0:
            raise ValueError("a range begins at 0 or later and has no negative length")
        with self.store.open_input_file(self._at(name)) as f:
            left = max(f.size() - start, 0)
            return f.read_at(left if length is None else min(length, left), start) if left else b""

    def exists(self, name: str) -> bool:
        return self.store.get_file_info(self._at(name)).type == arrow_fs.FileType.File

    def delete(self, name: str) -> bool:
        """Whether there was something to delete."""
        there = self.exists(name)
        if there:
            self.store.delete_file(self._at(name))
        return there

    def list(self, prefix: str = "") -> list[tuple[str, int]]:
        """(name, size) of all objects whose name begins so, in order of names."""
        found = self.store.get_file_info(arrow_fs.FileSelector(self.root, allow_not_found=True, recursive=True))
        names = [(x.path.removeprefix(self.root + "/"), x.size) for x in found if x.is_file and not x.path.endswith(".part")]
        return sorted(x for x in names if x[0].startswith(prefix))
