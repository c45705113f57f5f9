"""Files that appear only when a whole job has ended: tasks write into a hidden folder, the commit moves what they wrote."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def content_of(path: str) -> bytes | None:
    """A file's bytes; None where there is no such file."""
    system, inner = located(path)
    if system.get_file_info(inner).type != fs.FileType.File:
        return None
    with system.open_input_stream(inner) as f:
        return f.read()


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: its folder, and their names in the order in which they are to appear."""

    folder: str
    names: list[str]


class StagedWriter(DataSourceWriter):
    """A writer whose tasks put files into a folder of their attempt.

    A task that is run twice has two folders, of which the commit takes the
    one whose message it got.  Appending never replaces a file: names that are
    there already are an error before anything is moved.  Overwriting takes
    the path's files with one of the endings away first.  A job that fails
    before its commit leaves no file that a reader sees; a driver that is lost
    amid the commit's moves leaves some whole files.
    """

    endings: tuple[str, ...] = ()

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        system, inner = located(self.path)
        return system, inner.rstrip("/"), f"{inner.rstrip('/')}/_temporary/{self.job}"

    def attempt(self) -> tuple[fs.FileSystem, Written, int]:
        """The file system, a message with this task's new folder, and the partition's number."""
        system, _, staging = self._staging()
        task = TaskContext.get()
        folder = f"{staging}/{task.partitionId()}-{task.taskAttemptId()}"
        system.create_dir(folder, recursive=True)
        return system, Written(folder, []), task.partitionId()

    def put(self, system: fs.FileSystem, made: Written, name: str, content: list[bytes]) -> None:
        with system.open_output_stream(f"{made.folder}/{name}") as f:
            for part in content:
                f.write(part)
        made.names.append(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner, staging = self._staging()
        system.create_dir(inner, recursive=True)
        there = {f.base_name: f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File}
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            raise ValueError("two tasks wrote files of one name: partition rows by their file's name")
        if self.overwrite:
            for name, path in there.items():
                if name.lower().endswith(self.endings):
                    system.delete_file(path)
        elif set(names) & set(there):
            raise FileExistsError(f"{sorted(set(names) & set(there))[0]} and maybe others are in {self.path} already")
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{m.folder}/{name}", f"{inner}/{name}")
        self._cleared(system, staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _, staging = self._staging()
        self._cleared(system, staging)

    def _cleared(self, system: fs.FileSystem, staging: str) -> None:
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)
        above = staging.rsplit("/", 1)[0]
        if system.get_file_info(above).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)
