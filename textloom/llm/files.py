"""Files in the shared folder, written and read inside tasks through pyarrow's file systems (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI and the folder's path in it; the folder is made if missing."""
    fs, path = pafs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    fs.create_dir(path, recursive=True)
    return fs, path


class Staged:
    """A file that appears under its name only when closed whole, so that a repeated task does no harm."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path, self.part = fs, path, f"{path}.{uuid.uuid4().hex}.part"
        self.out, self.size = fs.open_output_stream(self.part), 0

    def write(self, data: bytes) -> int:
        """Appends data and returns where it begins."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        """Moves the part to its name. What an earlier try of the task left there gives way: it holds the same."""
        self.out.close()
        if self.fs.get_file_info(self.path).type == pafs.FileType.File:
            self.fs.delete_file(self.path)
        self.fs.move(self.part, self.path)
