"""Binary files in the folder that all executors share."""

from __future__ import annotations

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path there; `file:` with one slash and plain paths are local or mounted."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def task_file(folder: str, suffix: str) -> str:
    """A name that no other task or attempt uses. Readers learn it from the rows of the attempt that counts."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.{suffix}"


class Appender:
    """An output file that is opened by the first write."""

    def __init__(self, uri: str):
        self.uri, self.size, self._out = uri, 0, None

    def write(self, data: bytes) -> int:
        """Returns the place of the first byte."""
        if self._out is None:
            system, path = filesystem(self.uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self._out = system.open_output_stream(path)
        at = self.size
        self._out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        if self._out is not None:
            self._out.close()


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_file(path) as file:
        file.seek(offset)
        return file.read(length)
