"""Arrays packed into one value of a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        if a.dtype == np.uint64 and len(a) > 64:  # as differences, byte by byte
            raw, kind = np.diff(a, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), b"D"
        elif a.dtype == np.uint32 and len(a) > 64:  # byte by byte
            raw, kind = np.ascontiguousarray(a).view(np.uint8).reshape(-1, 4).T.tobytes(), b"p"
        else:
            raw, kind = np.ascontiguousarray(a).tobytes(), a.dtype.char.encode()
        squeezed = pa.compress(raw, "zstd", asbytes=True) if raw else b""
        out += [kind, np.array([len(raw), len(squeezed)], np.int64).tobytes(), squeezed]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 8
    for _ in range(int(np.frombuffer(blob, np.int64, 1)[0])):
        kind, (raw, squeezed) = blob[at : at + 1], np.frombuffer(blob, np.int64, 2, at + 1).tolist()
        at += 17
        data = pa.decompress(blob[at : at + squeezed], raw, "zstd", asbytes=True) if raw else b""
        at += squeezed
        if kind == b"D":
            out.append(np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64))
        elif kind == b"p":
            out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel())
        else:
            out.append(np.frombuffer(data, np.dtype(kind.decode())))
    return out
