"""Files that tasks write and read by byte ranges in a folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow.fs

#: Ranges closer than this are read in one go, up to so many bytes at once.
GAP, SPAN = 64 << 10, 8 << 20


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> tuple[str, pyarrow.NativeFile]:
    """URI and stream of a new file. Every attempt of a task writes one of its own; only those count that a committed index names."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def coalesced(ranges: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) ranges as (start, end, ranges) of neighbours that one read covers."""
    start = end = None
    held: list[tuple[int, int]] = []
    for offset, length in ranges:
        if held and (offset - end > GAP or offset + length - start > SPAN):
            yield start, end, held
            held = []
        if not held:
            start = end = offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield start, end, held


class Reader:
    """Coalesced reads of one file after the other."""

    def __init__(self) -> None:
        self.uri, self.file = None, None

    def read(self, uri: str, ranges: list[tuple[int, int]]) -> Iterator[memoryview]:
        """The bytes of each of the sorted ranges, in order."""
        if uri != self.uri:
            self.close()
            system, path = opened(uri)
            self.uri, self.file = uri, system.open_input_file(path)
        for start, end, held in coalesced(ranges):
            block = memoryview(self.file.read_at(end - start, start))
            for offset, length in held:
                yield block[offset - start : offset - start + length]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri = self.file = None


def runs(values: list) -> Iterator[tuple[int, int]]:
    """Bounds of runs of equal neighbours."""
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            yield start, i
            start = i
