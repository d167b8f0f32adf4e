"""Writing shards from tasks to the shared folder, so that lost and repeated attempts leave nothing behind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Shard:
    """A file that appears under its final name only when it is complete; each attempt has a name of its own."""

    def __init__(self, folder: str, stem: str, suffix: str):
        from pyarrow import fs

        self.system, root = fs.FileSystem.from_uri(folder)
        self.system.create_dir(root, recursive=True)
        self.name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self.path, self.open_path = f"{root}/{self.name}", f"{root}/_{self.name}.part"
        self.stream, self.size = self.system.open_output_stream(self.open_path), 0

    def write(self, data: bytes) -> int:
        """Appends data; returns where it begins."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> str:
        self.stream.close()
        self.system.move(self.open_path, self.path)
        return self.name


def read_range(folder: str, name: str, start: int, size: int) -> bytes:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{root}/{name}") as f:
        f.seek(start)
        return f.read(size)


def file_size(folder: str, name: str) -> int:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    return system.get_file_info(f"{root}/{name}").size


def settle(folder: str, manifest: DataFrame, column: str = "shard") -> None:
    """Removes the files of attempts that are not in the manifest, which only the attempts that count have written."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    good = {r[0] for r in manifest.select(column).where(F.col(column).isNotNull()).distinct().toLocalIterator()}
    if system.get_file_info(root).type != fs.FileType.Directory:
        return
    for info in system.get_file_info(fs.FileSelector(root)):
        if info.is_file and info.base_name not in good:
            system.delete_file(info.path)
