"""Sorted arrays in the shared folder, which workers write once and map into memory."""

from __future__ import annotations

import mmap
import os
import struct
import sys
import uuid
from collections import OrderedDict

import numpy as np

from . import common

#: Arrays that a worker holds mapped, and bytes of those that it had to read whole because the folder isn't a local path.
MAPS, HELD = 16384 if sys.version_info >= (3, 13) else 512, 256 << 20
_HEADER = struct.Struct("<8sq")  # the kind of the entries, and how many
_maps: OrderedDict[str, np.ndarray] = OrderedDict()
_read: dict[str, int] = {}  # bytes of the arrays that were read whole


def _kept(key: str, values: np.ndarray, mapped: bool = True) -> np.ndarray:
    """values, kept under the key; what was used least recently goes."""
    _maps[key] = values = values.view(np.ndarray)  # plain, as each piece of a mapped array would be a map again
    if not mapped:
        _read[key] = values.nbytes
    while len(_maps) > MAPS or (sum(_read.values()) > HELD and len(_maps) > 1):
        old, _ = _maps.popitem(last=False)
        _read.pop(old, None)
    return values


class Folder:
    """Arrays as files of the shared folder, whatever file system it is on."""

    def __init__(self, uri: str):
        self.uri = uri

    @classmethod
    def fresh(cls, spark, name: str) -> Folder:
        return cls(f"{common.shared_dir(spark)}/{name}-{uuid.uuid4().hex}")

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, name: str, values: np.ndarray) -> None:
        """Under a name of its own first, so that a task that runs again, or twice, leaves one whole file."""
        system, path = self._open()
        system.create_dir(path, recursive=True)
        spare = f"{path}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(spare) as out:
            out.write(_HEADER.pack(values.dtype.str.encode(), len(values)) + np.ascontiguousarray(values).tobytes())
        system.move(spare, f"{path}/{name}")

    def read(self, name: str, kind) -> np.ndarray:
        """The array, mapped; empty, of the kind given, if it was never written."""
        from pyarrow import fs

        key = f"{self.uri}/{name}"
        if key in _maps:
            _maps.move_to_end(key)
            return _maps[key]
        system, path = self._open()
        path = f"{path}/{name}"
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return np.zeros(0, kind)  # not kept: another task may write it yet
        if isinstance(system, fs.LocalFileSystem):
            with open(path, "rb") as f:
                stored, n = _HEADER.unpack(f.read(_HEADER.size))
                stored = np.dtype(stored.rstrip(b"\0").decode())
                # A map that holds no open file, where Python has such ones.
                held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
            return _kept(key, np.frombuffer(held, stored, n, _HEADER.size))
        with system.open_input_stream(path) as f:
            raw = f.read()
        stored, n = _HEADER.unpack_from(raw)
        return _kept(key, np.frombuffer(raw, np.dtype(stored.rstrip(b"\0").decode()), n, _HEADER.size), False)

    def piece(self, name: str, kind, begin: int, end: int) -> np.ndarray:
        """Entries begin to end; of a file that can't be mapped only these are read."""
        from pyarrow import fs

        system, path = self._open()
        if isinstance(system, fs.LocalFileSystem) or f"{self.uri}/{name}" in _maps:
            return self.read(name, kind)[begin:end]
        kind = np.dtype(kind)
        with system.open_input_file(f"{path}/{name}") as f:
            f.seek(_HEADER.size + begin * kind.itemsize)
            return np.frombuffer(f.read((end - begin) * kind.itemsize), kind)

    def delete(self) -> None:
        for key in [k for k in _maps if k.startswith(self.uri)]:
            del _maps[key]
            _read.pop(key, None)
        system, path = self._open()
        if os.path.basename(path) and system.get_file_info(path).type.name == "Directory":
            system.delete_dir(path)
