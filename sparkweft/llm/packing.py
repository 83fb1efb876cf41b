"""Vector bin packing of tokenised documents into sequences.

A document's ids are cut into whole sequences and one rest. Rests are placed by the dot-product
heuristic under simultaneous limits on tokens, segments and loss-bearing tokens: an open bin takes
the item that fits and whose demand, weighted by what the bin has left in each dimension, is
largest. Where nothing fits and enough room is left, the largest item is cut to fill it.

Each task packs its own rows in pools of bounded size, without a shuffle. Its sequence ids hold the
partition's number, so a task that runs again after a lost executor gives the same rows, as long as
its input has the same rows in the same order (files do).
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common

#: The id after each document.
END = 1
#: Items that a task places together; rests of fewer than CUT_AT tokens of room stay unfilled.
POOL, CUT_AT = 4096, 16
_encoders: dict[str, Encoder] = {}


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError(f"each limit must be at least 1: {self}")  # else no token would ever fit


class Encoder:
    """The ids of the library `tokenizers`, as little-endian unsigned 32-bit integers.

    A space between two other characters always begins a piece of this vocabulary's pattern, so texts
    are cut there and each part's ids are looked up. Parts met for the first time are encoded with the
    same vocabulary by `tiktoken`, which is faster; texts with strings of special tokens, and everything
    if both libraries differ on a probe, go to `tokenizers` as a whole.
    """

    ROOM, LONGEST = 300_000, 64  # parts kept, and their characters at most
    PROBE = "Don't   stop:\n\n\tünïcode 漢字 🙂 1234 o'clock ...  x\r\n y z "

    def __init__(self, path: str):
        import base64
        import re
        from pathlib import Path

        import public_tokenizers
        import tiktoken
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.odd, self.cut = re.compile(r"\s\s").search, re.compile(r"(?<=\S) (?=\S)").split
        twin = Path(path).with_suffix(".tiktoken")
        self.fast = None
        if twin.exists():
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, twin.open("rb"))}
            self.fast = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            if self.fast.encode_ordinary(self.PROBE) != self.whole.encode(self.PROBE, add_special_tokens=False).ids:
                self.fast = None
        outer = self

        class Parts(dict):
            def __missing__(self, part: str) -> bytes:
                found = array("I", outer.fast.encode_ordinary(" " + part)).tobytes()
                if len(part) <= outer.LONGEST:
                    if len(self) >= outer.ROOM:
                        self.clear()
                    self[part] = found
                return found

        self.parts = Parts()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = self.cut(text) if self.odd(text) else text.split(" ")
        if not first:  # the text begins with a space
            return array("I", self.fast.encode_ordinary(text)).tobytes() if self.odd(text) else self._join(rest)
        if rest and not rest[-1]:  # it ends with one
            rest.pop()
            return array("I", self.fast.encode_ordinary(first)).tobytes() + self._join(rest) + array("I", self.fast.encode_ordinary(" ")).tobytes()
        return array("I", self.fast.encode_ordinary(first)).tobytes() + self._join(rest)

    def _join(self, parts: list[str]) -> bytes:
        return b"".join(map(self.parts.__getitem__, parts))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass
class Item:
    key: object  # of the document
    start: int
    tokens: int
    loss: int
    total: int
    ids: bytes | None = None

    def split(self, room: int) -> tuple[Item, Item]:
        head = min(self.loss, room)
        ids = self.ids
        return (
            Item(self.key, self.start, room, head, self.total, ids and ids[: 4 * room]),
            Item(self.key, self.start + room, self.tokens - room, self.loss - head, self.total, ids and ids[4 * room :]),
        )


def place(items: list[Item], limits: Limits, cut: bool) -> list[list[Item]]:
    """Bins in the order in which they were opened; every item in one of them, whole or cut. Of equal scores the first item is taken."""
    items = list(items)
    need = np.array([[i.tokens, 1, i.loss] for i in items], float).reshape(-1, 3)
    size = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    share, of, left = need / size, np.arange(len(items)), np.ones(len(items), bool)
    bins: list[list[Item]] = []
    waiting = len(items)
    while waiting:
        if waiting < len(left) // 2:  # what has been placed is looked at no more
            need, share, of, left = need[left], share[left], of[left], np.ones(waiting, bool)
        room, chosen = size.copy(), []
        while waiting:
            fits = left & (need[:, 0] <= room[0]) & (need[:, 2] <= room[2])
            if room[1] >= 1 and fits.any():
                score = np.where(fits, share @ (room / size), -1.0)
                best = int(np.argmax(score >= score.max() * (1 - 1e-12)))  # the first of those that are equal but for rounding
                chosen.append(items[of[best]])
                room -= need[best]
                left[best] = False
                waiting -= 1
                if room[0] <= 0 or room[1] < 1:
                    break
                continue
            gap = int(min(room[0], room[2]))
            if not chosen or (cut and gap >= CUT_AT and room[1] >= 1):
                best = int(np.argmax(np.where(left, need[:, 0], -1.0)))
                if not cut:
                    raise ValueError(f"an example exceeds the limits alone: {items[of[best]].key}")
                head, items[of[best]] = items[of[best]].split(gap)
                chosen.append(head)
                need[best] = items[of[best]].tokens, 1, items[of[best]].loss
                share[best] = need[best] / size
            break
        bins.append(chosen)
    return bins


def _packed(source: Iterator[list[Item]], limits: Limits, cut: bool, pool: int, base: int) -> Iterator[list[tuple[int, int, Item]]]:
    """(sequence, offset, item) for all items, pool by pool; a pool's last bin waits for the next."""
    held: list[Item] = []
    number = base

    def close(bins: list[list[Item]]) -> list[tuple[int, int, Item]]:
        nonlocal number
        rows = []
        for one in bins:
            offset = 0
            for item in one:
                rows.append((number, offset, item))
                offset += item.tokens
            number += 1
        return rows

    for items in source:
        rows = []
        for item in items:
            if cut and item.tokens == limits.tokens and item.loss <= limits.loss_tokens:
                rows += close([[item]])
            else:
                held.append(item)
        while len(held) >= pool:
            bins = place(held[:pool], limits, cut)
            held = bins.pop() + held[pool:] if len(bins) > 1 else held[pool:]
            rows += close(bins)
        if rows:
            yield rows
    if held:
        yield close(place(held, limits, cut))


def _base() -> int:
    return TaskContext.get().partitionId() << 40


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), pool: int = POOL) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A document's ids, and END after them, lie in its pieces, each id in one. Null and empty texts are
    END alone. Rows with the same doc_id are packed each on its own; a null doc_id stays null; other
    columns are ignored; an empty table has no pieces. All ids bear loss.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), array("I", [END]).tobytes()
        key_type = None

        def items() -> Iterator[list[Item]]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field(0).type
                for part in common.slices(batch):
                    found = []
                    for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        ids = encode(text) + end
                        total = len(ids) // 4
                        for at in range(0, total, limits.tokens):
                            piece = ids[4 * at : 4 * (at + limits.tokens)]
                            found.append(Item(key, at, len(piece) // 4, len(piece) // 4, total, piece))
                    yield found

        for rows in _packed(items(), limits, True, pool, _base()):
            columns = zip(*((i.key, i.start, i.tokens, zlib.crc32(i.ids), i.total, s, o, i.loss) for s, o, i in rows), strict=True)
            types = [key_type] + [pa.int64()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], NAMES)

    return common.text_columns(docs).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in NAMES[1:]))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


def pack_examples(examples: DataFrame, limits: Limits = Limits(), pool: int = POOL) -> DataFrame:
    """Whole examples (example_id, tokens, loss_tokens) into bins: the same columns with sequence_id and offset.

    An example that exceeds a limit alone is an error; null counts are 0; other columns are ignored.
    """
    kind = examples.schema["example_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[list[Item]]:
            for batch in batches:
                yield [Item(k, 0, t, n, t) for k, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]

        for rows in _packed(items(), limits, False, pool, _base()):
            yield pa.RecordBatch.from_pylist([{"example_id": i.key, "tokens": i.tokens, "loss_tokens": i.loss, "sequence_id": s, "offset": o} for s, o, i in rows])

    counts = [f"coalesce(cast({n} AS long), 0L) AS {n}" for n in ("tokens", "loss_tokens")]
    return examples.selectExpr("example_id", *counts).mapInArrow(run, f"example_id {kind}, tokens long, loss_tokens long, sequence_id long, offset long")


def op2_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
