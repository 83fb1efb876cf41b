"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by the workers.

Tokens are words between white space, A-Z lower-cased, then one end a text. The model, of order three or
two, lies in the shared folder as sorted arrays:

- words: 64-bit hashes in ranges (a word's number is its place), with counts and continuation counts;
- n-grams: in buckets by the word before the last one, so that an n-gram, its context and its shorter
  forms lie together. Middle words are sorted, each with the run of its first words, which each have the
  run of their last words and counts.

A context's sums are those of its run, or are kept where that is long. An n-gram whose middle word has
more tokens than a bucket should hold ("hot") goes to one of several buckets; the sums of its contexts,
and the bigrams of the middle word, are put together in buckets of their own, by their own keys.

Counting aggregates before each shuffle: a task sends sorted arrays of distinct entries, one a bucket;
a shuffle has as many partitions as there are buckets, so that a task reads as much at every size.
Files are written under another name and renamed, with contents that depend on the input alone, so
tasks may run again. Texts are scored where they lie, by looking up their distinct n-grams in the mapped
arrays; with a model beyond MAPPED bytes the n-grams go to the tasks of their buckets instead, and
the answers come back, so that no worker reads more than the buckets it was dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing
from .blobs import pack, unpack
from .folder import Folder

#: The end of a text as a token: no word has this hash but by chance.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Bytes of text to a part of the counted words, words to a range, tokens to a bucket of n-grams, and entries that a task gathers before it sends them.
PART_BYTES, RANGE, BUCKET, GATHER = 16 << 20, 1 << 22, 1 << 21, 1 << 21
#: Last words from which on a context's sums are kept; runs of texts that are looked up together.
WIDE, TOGETHER = 32, 8
#: Bytes of a model that workers map; beyond, n-grams are sent to their buckets.
MAPPED = 64 << 30


def _tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: first index, tokens of each text, and their hashes with an end after each text."""
    for begin, count, h in hashing.each(texts, hashing.SPACED):
        yield begin, count + 1, np.insert(h, np.cumsum(count), END)


def _split(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the entries of each part, in their order."""
    part = part.astype(np.uint16) if len(part) and part.min() >= 0 and part.max() < 1 << 16 else part  # sorted faster
    order = np.argsort(part, kind="stable")
    found, begin = np.unique(part[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, begin[1:]) if len(found) else [], strict=True)


def _new(values: np.ndarray) -> np.ndarray:
    """Where other values than before begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _order(keys: list[np.ndarray]) -> np.ndarray:
    """An order of the entries by one or two arrays of keys, the second ones below 2**32; equal entries come in any order."""
    order = np.argsort(keys[0])
    if len(keys) == 1:
        return order
    rank = np.zeros(len(order), np.uint64)
    rank[order[_new(keys[0][order])[1:]]] = 1
    rank[order] = np.cumsum(rank[order])
    return np.argsort(rank << np.uint64(32) | keys[1].astype(np.uint64))


def _summed(keys: list[np.ndarray], *values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct entries (arrays of keys, the first one first), in order, with the sums of their values; ones without any."""
    order = _order(keys)
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    if not values:
        return [k[first] for k in keys], [np.diff(np.append(first, len(order)))]
    return [k[first] for k in keys], [np.add.reduceat(v[order], first) if len(first) else v for v in values]


def _gathered(blobs: list[bytes], keys: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The entries of all blobs as one: so many arrays of keys, the rest values."""
    arrays = [np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True)]
    return _summed(arrays[:keys], *(v.astype(np.int64) for v in arrays[keys:]))


def _rows(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([("kind", pa.string()), ("part", pa.int64()), ("blob", pa.binary())]))


ROWS = "kind string, part long, blob binary"


def _spread(counts: np.ndarray) -> np.ndarray:
    """How many entries have counts 1 to 4, 3 or more, and any."""
    return np.array([*((counts == k).sum() for k in (1, 2, 3, 4)), (counts >= 3).sum(), len(counts)], np.int64)


def _sums(counts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of runs that begin there: total, and entries with counts 1, 2, 3 or more."""
    if not len(begin):
        return np.zeros((0, 4), np.int64)
    return np.stack([np.add.reduceat(x.astype(np.int64), begin) for x in (counts, counts == 1, counts == 2, counts >= 3)], axis=1)


@dataclass
class Model:
    folder: Folder
    order: int = 3
    tokens: int = 0  # N
    words: int = 0  # V, the end too; as a number, the start of a text
    parts: int = 1
    offsets: list[int] = field(default_factory=lambda: [0])  # the number of each range's first word
    buckets: int = 1
    discounts: list[np.ndarray] = field(default_factory=lambda: [np.zeros(4)] * 3)  # of unigrams, bigrams, trigrams; by count 0, 1, 2, 3 or more
    types: int = 0  # distinct bigrams
    spare: float = 1.0  # what the continuation probabilities leave for the uniform ones
    bytes: int = 0

    def delete(self) -> None:
        self.folder.delete()

    # Words.

    def part_of(self, h: np.ndarray) -> np.ndarray:
        """Parts in the order of the hashes."""
        return ((h >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)

    def range_of(self, part: np.ndarray) -> np.ndarray:
        return part * (len(self.offsets) - 1) // self.parts

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted distinct hashes: numbers (-1 for unknown words), counts and continuation counts."""
        out = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        if self.words:
            for r, at in _split(self.range_of(self.part_of(h))):
                known = self.folder.read(f"words-{r}", np.uint64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
                    same = known[place] == h[at]
                    at, place = at[same], place[same]
                    out[0][at] = place + self.offsets[r]
                    out[1][at] = self.counts(f"counts-{r}", place)
                    out[2][at] = self.counts(f"follows-{r}", place)
        return out

    # Counts: a byte each, and those of 255 or more by their places.

    def write_counts(self, name: str, counts: np.ndarray) -> None:
        large = np.flatnonzero(counts >= 255)
        self.folder.write(name, np.minimum(counts, 255).astype(np.uint8))
        self.folder.write(f"{name}-large", large.astype(np.uint32))
        self.folder.write(f"{name}-larger", counts[large].astype(np.int64))

    def counts(self, name: str, at: np.ndarray) -> np.ndarray:
        """The counts at places; zeros if none were written."""
        known = self.folder.read(name, np.uint8)
        if not len(known):
            return np.zeros(len(at), np.int64)
        found = known[at].astype(np.int64)
        big = np.flatnonzero(found == 255)
        if len(big):
            found[big] = self.folder.read(f"{name}-larger", np.int64)[np.searchsorted(self.folder.read(f"{name}-large", np.uint32), at[big])]
        return found

    # N-grams: the context as the middle word's number above the first one's (0 in bigrams), and the last word's.

    def ngrams(self, number: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and last words of texts' tokens; a text's start counts as words before it. Unknown words have the number 2**32 - 1."""
        number = number.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        begin = np.cumsum(count) - count
        before = np.concatenate([[0], number[:-1]]).astype(np.uint64)
        before[begin] = self.words
        if self.order == 2:
            return before << np.uint64(32), number
        first = np.concatenate([[0], before[:-1]]).astype(np.uint64)
        first[begin] = self.words
        return before << np.uint64(32) | first, number

    def hot(self, middle: np.ndarray) -> np.ndarray:
        """In how many buckets each middle word's n-grams lie; 1 for most."""
        known, n = self.folder.read("hot", np.uint64), self.folder.read("spread", np.uint64)
        if not len(known):
            return np.ones(len(middle), np.uint64)
        at = np.minimum(np.searchsorted(known, middle), len(known) - 1)
        return np.where(known[at] == middle, n[at], np.uint64(1))

    def bucket(self, context: np.ndarray, last: np.ndarray) -> np.ndarray:
        middle = context >> np.uint64(32)
        salt = hashing.mix(context * np.uint64(3) + last) % self.hot(middle)
        return ((hashing.mix(middle + np.uint64(1)) + salt) % np.uint64(self.buckets)).astype(np.int64)

    def _own(self, key: np.ndarray) -> np.ndarray:
        """The bucket of a key by itself: of hot words' contexts and bigrams."""
        return (hashing.mix(key) % np.uint64(self.buckets)).astype(np.int64)

    def write_runs(self, level: int, bucket: int, context: np.ndarray, last: np.ndarray, counts: np.ndarray) -> None:
        """Entries by context and last word, as the arrays that `look` reads.

        A middle word is a context by itself at level 2. Where a context's run begins is kept by its low
        16 bits, and `block` has the first context that begins at or after each multiple of 65,536.
        """
        begin = _new(context)
        middle = context[begin] >> np.uint64(32)
        of = _new(middle)
        size = np.diff(np.append(begin, len(context)))
        wide, bounds = np.flatnonzero(size > WIDE), np.append(begin, len(context))
        name = lambda kind: f"{kind}{level}-{bucket}"
        write = self.folder.write
        write(name("middle"), middle[of].astype(np.uint32))
        if level == 3:
            write(name("from"), np.append(of, len(begin)).astype(np.uint32))
            write(name("first"), context[begin].astype(np.uint32))
        write(name("begin"), (bounds & 0xFFFF).astype(np.uint16))
        write(name("block"), np.searchsorted(bounds, np.arange(1, (len(context) >> 16) + 1) << 16).astype(np.uint32))
        write(name("last"), last.astype(np.uint32))
        self.write_counts(name("count"), counts)
        write(name("wide"), wide.astype(np.uint32))
        write(name("sums"), _sums(counts, begin)[wide].ravel())

    def look(self, level: int, bucket: int, context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of n-grams of a bucket, which come by context, and the sums of their contexts (as far as the bucket has them)."""
        read = lambda kind, of: self.folder.read(f"{kind}{level}-{bucket}", of)
        counts, sums = np.zeros(len(context), np.int64), np.zeros((len(context), 4), np.int64)
        known = read("middle", np.uint32)
        if not len(known) or not len(context):
            return counts, sums
        new = _new(context)  # each context once
        middle = (context[new] >> np.uint64(32)).astype(np.uint32)
        place = np.minimum(np.searchsorted(known, middle), len(known) - 1)
        there = known[place] == middle
        if level == 3:
            start = read("from", np.uint32)
            place, there = hashing.within(read("first", np.uint32), np.where(there, start[place], 0), np.where(there, start[place + 1], 0), context[new].astype(np.uint32))
        size = np.diff(np.append(new, len(context)))
        place, mine = np.repeat(place, size), np.flatnonzero(np.repeat(there, size))
        place, count = place[mine], f"count{level}-{bucket}"
        # Each context once: where its run lies, and its sums, from the run or as they were kept.
        new = _new(place)
        distinct, back = place[new], np.repeat(np.arange(len(new)), np.diff(np.append(new, len(place))))
        begin, block = read("begin", np.uint16), read("block", np.uint32)
        low, high = (begin[x].astype(np.int64) + (np.searchsorted(block, x, "right") << 16) for x in (distinct, distinct + 1))
        at, there = hashing.within(read("last", np.uint32), low[back], high[back], last[mine].astype(np.uint32))
        counts[mine[there]] = self.counts(count, at[there])
        of, size = np.zeros((len(distinct), 4), np.int64), high - low
        long = size > WIDE
        if long.any():
            of[long] = read("sums", np.int64).reshape(-1, 4)[np.searchsorted(read("wide", np.uint32), distinct[long])]
        short = np.flatnonzero(~long)
        n = size[short]
        run = np.repeat(low[short] - np.cumsum(n) + n, n) + np.arange(n.sum())
        of[short] = _sums(self.counts(count, run), np.cumsum(n) - n)
        sums[mine] = of[back]
        return counts, sums

    def _parts(self, level: int, context: np.ndarray, last: np.ndarray, places: list, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What n-grams have at a level: the discounted share, and the weight of what is shorter."""
        counts, sums = np.zeros(len(context), np.int64), np.zeros((len(context), 4), np.int64)
        for p, at in places:
            counts[at], sums[at] = self.look(level, p, context[at], last[at])
        # Those of hot words lie by their own keys: all buckets' ones together, so that each file is read once.
        if hot.any():
            keys = context[hot]
            if level == 2:
                keys = keys >> np.uint64(32)
                both = keys << np.uint64(32) | last[hot]
                found = np.zeros(len(keys), np.int64)
                for p, at in _split(self._own(both)):
                    known = self.folder.read(f"pair-{p}", np.uint64)
                    if len(known):
                        place = np.minimum(np.searchsorted(known, both[at]), len(known) - 1)
                        found[at] = np.where(known[place] == both[at], self.folder.read(f"pairs-{p}", np.int64)[place], 0)
                counts[hot] = found
                known, total = self.folder.read("hot", np.uint64), self.folder.read("hotter", np.int64).reshape(-1, 4)
                sums[hot] = total[np.searchsorted(known, keys)]
            else:
                found = np.zeros((len(keys), 4), np.int64)
                for p, at in _split(self._own(keys)):
                    known = self.folder.read(f"shared-{p}", np.uint64)
                    if len(known):
                        place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
                        found[at] = np.where((known[place] == keys[at])[:, None], self.folder.read(f"sharing-{p}", np.int64).reshape(-1, 4)[place], 0)
                sums[hot] = found
        d, total = self.discounts[level - 1], np.maximum(sums[:, 0], 1)
        high = np.where(sums[:, 0] > 0, np.maximum(counts - d[np.minimum(counts, 3)], 0) / total, 0.0)
        return high, np.where(sums[:, 0] > 0, sums[:, 1:] @ d[1:] / total, 1.0)

    def answers(self, places: list, context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of n-grams, with their buckets and places there: a and b of their probability a + b p, where p is the last word's own."""
        middle = context >> np.uint64(32)
        hot = self.hot(middle) > 1
        high, weight = self._parts(2, middle << np.uint64(32), last, places, hot)
        if self.order == 3:
            top, more = self._parts(3, context, last, places, hot)
            return top + more * high, more * weight
        return high, weight

    def together(self) -> int:
        """Runs of texts that are looked up together: more with more buckets, each of which a lookup may open."""
        return max(TOGETHER, self.buckets // 8)

    def prepared(self, count: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of texts' tokens: training counts and own probabilities of all; distinct n-grams, and which one each token is."""
        distinct, back = np.unique(h, return_inverse=True)
        number, seen, follows = self.numbers(distinct)
        own = np.maximum(follows - self.discounts[0][np.minimum(follows, 3)], 0) / max(1, self.types) + self.spare / (self.words + 1)
        context, last = self.ngrams(number[back], count)
        order = _order([context, last])
        context, last = context[order], last[order]
        new = np.ones(len(order), bool)
        new[1:] = (context[1:] != context[:-1]) | (last[1:] != last[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return seen[back], own[back], context[new], last[new], which


def _discounts(n: np.ndarray) -> np.ndarray:
    """Chen and Goodman's discounts for counts 1, 2 and 3 or more, from how many entries have counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2
        out.append(min(max(d, 0.1), k - 0.1))
    return np.array(out)


def _sent(texts: DataFrame, entries, part, kind: str) -> DataFrame:
    """Rows (kind, part, blob) of the distinct entries of each task: entries(texts) gives arrays of keys, part(*keys) where each goes."""

    def send(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        keys, (counts,) = _summed([np.concatenate(x) for x in zip(*held, strict=True)])
        for p, at in _split(part(*keys)):
            yield from _rows([{"kind": kind, "part": p, "blob": pack(*(k[at] for k in keys), counts[at].astype(np.uint32))}]).to_batches()

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for some in common.slices(batch):
                for found in entries(some.column(0)):
                    held.append(found)
                    n += len(found[0])
                    if n >= GATHER:
                        yield from send(held)
                        held, n = [], 0
        if held:
            yield from send(held)

    return texts.mapInArrow(run, ROWS)


def train(docs: DataFrame, order: int = 3) -> Model:
    """The model of all rows' texts, null ones as empty; without rows every text has probability 1 a token."""
    if order not in (2, 3):
        raise ValueError(f"the order is 2 or 3, not {order}")
    spark = docs.sparkSession
    model = Model(Folder.fresh(spark, "kneser-ney"), order)
    texts = common.text_columns(docs).select("text")
    told = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("size"), F.count("*").alias("n")).first()
    if told.size is None:
        return model
    _count_words(texts, model, told.size, told.n)
    _count_ngrams(texts, model)
    return model


def _count_words(texts: DataFrame, model: Model, size: int, n: int) -> None:
    folder = model.folder
    model.parts = int(max(8, size // PART_BYTES))

    def words(column: pa.Array):
        for _, _, h in _tokens(column):
            yield (h,)

    def count(key, group):
        (h,), (counts,) = _gathered(group["blob"].to_pylist(), 1)
        return pa.table({"part": [key[0].as_py()], "words": [len(h)], "tokens": [int(counts.sum())], "blob": [pack(h, counts)]})

    counted = common.cut(_sent(texts, words, model.part_of, "words").repartition(model.parts, "part").groupBy("part").applyInArrow(count, "part long, words long, tokens long, blob binary"))
    total = counted.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()
    model.words, model.tokens = total.words, total.tokens
    if model.words >= (1 << 32) - 1:
        raise ValueError("numbers of words take 32 bits")
    ranges = int(min(model.parts, model.words // RANGE + 1))

    def keep(key, group):
        r = key[0].as_py()
        h, counts = (np.concatenate(x) for x in zip(*(unpack(b) for _, b in sorted(zip(group["part"].to_pylist(), group["blob"].to_pylist(), strict=True))), strict=True))
        folder.write(f"words-{r}", h)
        model.write_counts(f"counts-{r}", counts)
        often = np.flatnonzero(counts >= BUCKET)
        return pa.table({"range": [r], "words": [len(h)], "hot": pa.array([often.tolist()], pa.list_(pa.int64())), "times": pa.array([counts[often].tolist()], pa.list_(pa.int64()))})

    by_range = counted.withColumn("range", F.expr(f"part * {ranges} DIV {model.parts}")).groupBy("range")
    each = {r["range"]: r for r in by_range.applyInArrow(keep, "range long, words long, hot array<long>, times array<long>").collect()}  # a row for 4 million words
    model.offsets = [0, *np.cumsum([each[r].words if r in each else 0 for r in range(ranges)]).tolist()]
    model.buckets = max(8, -(-model.tokens // BUCKET))
    hot = sorted((model.offsets[r] + at, times) for r, row in each.items() for at, times in zip(row.hot, row.times, strict=True))
    if n >= BUCKET:
        hot.append((model.words, n))  # the start of a text
    if hot:
        folder.write("hot", np.array([w for w, _ in hot], np.uint64))
        folder.write("spread", np.array([-(-times // BUCKET) + 1 for _, times in hot], np.uint64))


def _count_ngrams(texts: DataFrame, model: Model) -> None:
    folder = model.folder

    def ngrams(column: pa.Array):
        for _, count, h in _tokens(column):
            distinct, back = np.unique(h, return_inverse=True)
            yield model.ngrams(model.numbers(distinct)[0][back], count)

    def follow(last: np.ndarray) -> list[dict]:
        (last,), (n,) = _summed([last.astype(np.uint64)])
        part = np.searchsorted(np.array(model.offsets[1:]), last, "right")
        return [{"kind": "follow", "part": p, "blob": pack(last[at], n[at].astype(np.uint32))} for p, at in _split(part)]

    def own(kind: str, key: np.ndarray, values: np.ndarray) -> list[dict]:
        return [{"kind": kind, "part": p, "blob": pack(key[at], *(v[at].astype(np.uint32) for v in values))} for p, at in _split(model._own(key))]

    def keep(key, group):
        b = key[0].as_py()
        (context, last), (counts,) = _gathered(group["blob"].to_pylist(), 2)
        rows, told = [], []
        middle = context >> np.uint64(32)
        if model.order == 3:
            model.write_runs(3, b, context, last, counts)
            told.append(_spread(counts))
            hot = np.flatnonzero(model.hot(middle) > 1)
            if len(hot):  # their contexts go on in other buckets
                at = np.flatnonzero(np.concatenate([[True], context[hot][1:] != context[hot][:-1]]))
                rows += own("shared", context[hot][at], _sums(counts[hot], at).T)
            (middle, last), (counts,) = _summed([middle, last])  # how many words come before each bigram
        else:
            told.append(_spread(counts[:0]))
        hot = model.hot(middle) > 1
        if hot.any():
            rows += own("pair", middle[hot] << np.uint64(32) | last[hot], counts[hot][None])
        model.write_runs(2, b, middle[~hot] << np.uint64(32), last[~hot], counts[~hot])
        told.append(_spread(counts[~hot]))
        return _rows([*rows, *follow(last[~hot]), {"kind": "told", "part": -1, "blob": pack(*told)}])

    def merge(key, group):
        """Sums of hot words' contexts, and their bigrams, of one bucket of their own."""
        kind, b = key[0].as_py(), key[1].as_py()
        (of,), values = _gathered(group["blob"].to_pylist(), 1)
        if kind == "shared":
            folder.write(f"shared-{b}", of)
            folder.write(f"sharing-{b}", np.stack(values, axis=1).ravel())
            return _rows([])
        counts = values[0]
        folder.write(f"pair-{b}", of)
        folder.write(f"pairs-{b}", counts)
        middle = of >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate([[True], middle[1:] != middle[:-1]]))
        rows = [{"kind": "hotter", "part": int(m), "blob": pack(s)} for m, s in zip(middle[begin].tolist(), _sums(counts, begin), strict=True)]
        return _rows([*rows, *follow(of & np.uint64(0xFFFFFFFF)), {"kind": "told", "part": -1, "blob": pack(_spread(counts[:0]), _spread(counts))}])

    def keep_follows(key, group):
        r = key[0].as_py()
        (last,), (n,) = _gathered(group["blob"].to_pylist(), 1)
        dense = np.zeros(model.offsets[r + 1] - model.offsets[r], np.int64)
        dense[last.astype(np.int64) - model.offsets[r]] = n
        model.write_counts(f"follows-{r}", dense)
        return _rows([{"kind": "told", "part": r, "blob": pack(_spread(n))}])

    kept = common.cut(_sent(texts, ngrams, model.bucket, "ngrams").repartition(model.buckets, "part").groupBy("part").applyInArrow(keep, ROWS))
    both = kept.where("kind IN ('shared', 'pair')")
    if not both.isEmpty():
        merged = common.cut(both.groupBy("kind", "part").applyInArrow(merge, ROWS))
        kept = kept.union(merged)
        known = folder.read("hot", np.uint64)
        sums = np.zeros((len(known), 4), np.int64)
        for r in merged.where("kind = 'hotter'").select("part", "blob").toLocalIterator():
            sums[np.searchsorted(known, np.uint64(r.part))] += unpack(r.blob)[0]
        folder.write("hotter", sums.ravel())
    told = [unpack(r.blob) for r in kept.where("kind = 'told'").select("blob").collect()]  # a row a bucket
    spreads = [np.sum(x, axis=0) for x in zip(*told, strict=True)]
    told = kept.where("kind = 'follow'").groupBy("part").applyInArrow(keep_follows, ROWS).select("blob").collect()  # a row a range
    follows = np.sum([unpack(r.blob)[0] for r in told], axis=0)
    model.discounts = [_discounts(n) for n in (follows, spreads[1], spreads[0])]
    model.types = int(spreads[1][5])
    d = model.discounts[0]
    model.spare = float(d[1] * follows[0] + d[2] * follows[1] + d[3] * follows[4]) / model.types
    model.bytes = int(6 * spreads[1][5] + 20 * spreads[0][5] + 24 * model.words)  # about


def _batches(texts: pa.Array, together: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As _tokens, several runs together."""
    held = []
    for found in _tokens(texts):
        held.append(found)
        if len(held) >= together:
            yield held[0][0], np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            held = []
    if held:
        yield held[0][0], np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])


def _told(model: Model, count: np.ndarray, seen: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    """Of texts: tokens, known ones, and the base's and the model's log10 probability."""
    begin = np.cumsum(count) - count
    base = np.log10((seen + 1.0) / (model.tokens + model.words + 1))
    return [count.astype(np.int64), np.add.reduceat((seen > 0).astype(np.int64), begin), np.add.reduceat(base, begin), np.add.reduceat(np.log10(p), begin)]


def score(docs: DataFrame, model: Model, routed: bool | None = None) -> DataFrame:
    """docs' doc_id with n_tokens, n_known, base_score and score (log10 of the text's probability), and train_tokens.

    Null and empty texts are their end alone. Words never seen share what the model leaves over, alike.
    Rows with the same doc_id each give a row; other columns are ignored; an empty table gives none.
    routed sends n-grams to their buckets, with the same result; by default with models beyond MAPPED bytes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, count, h in _batches(batch.column(1), model.together()):
            seen, own, context, last, which = model.prepared(count, h)
            a, b = model.answers(list(_split(model.bucket(context, last))), context, last)
            out.append(_told(model, count, seen, a[which] + b[which] * own))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in zip(*out, strict=True))], names)

    texts = common.text_columns(docs)
    if routed is None:
        routed = model.bytes > MAPPED
    found = _routed(texts, model, schema, names) if routed else common.map_texts(texts, work, schema)
    return found.withColumn("train_tokens", F.lit(model.tokens).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _routed(texts: DataFrame, model: Model, schema: str, names: list[str]) -> DataFrame:
    """The scores, with n-grams answered by the tasks of their buckets. A batch of texts has a number, by which all comes together again."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    sent = f"batch long, part long, blob binary, ids array<{kind}>"

    def ask(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in common.slices(batch):
                types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(some.schema.field(0).type)]
                row = lambda *x, types=types: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, types, strict=True)], ["batch", "part", "blob", "ids"])
                ids = some.column(0).to_pylist()
                for begin, count, h in _batches(some.column(1), model.together()):
                    seen, own, context, last, which = model.prepared(count, h)
                    places = list(_split(model.bucket(context, last)))
                    for p, at in places:
                        yield row(number, p, pack(context[at], last[at].astype(np.uint32)), None)
                    where = np.concatenate([at for _, at in places])  # the order in which the answers come, by bucket
                    yield row(number, -1, pack(count, seen.astype(np.uint32), own, which.astype(np.uint32), where.astype(np.uint32)), ids[begin : begin + len(count)])
                    number += 1

    def answer(key, group):
        out = []
        for batch, blob in zip(group["batch"].to_pylist(), group["blob"].to_pylist(), strict=True):
            context, last = unpack(blob)
            out.append({"batch": batch, "part": key[0].as_py(), "blob": pack(*model.answers([(key[0].as_py(), slice(None))], context, last.astype(np.uint64)))})
        return pa.Table.from_pylist(out, pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("blob", pa.binary())]))

    def put(texts_, answers):
        columns = []
        for blob, ids in zip(texts_["blob"].to_pylist(), texts_["ids"].combine_chunks(), strict=True):
            count, seen, own, which, where = unpack(blob)
            told = [unpack(b) for _, b in sorted(zip(answers["part"].to_pylist(), answers["blob"].to_pylist(), strict=True))]
            a, b = np.empty(len(where)), np.empty(len(where))
            a[where], b[where] = (np.concatenate(x) for x in zip(*told, strict=True))
            columns.append([ids.values, *(pa.array(x) for x in _told(model, count, seen.astype(np.int64), a[which] + b[which] * own))])
        return pa.Table.from_arrays([pa.concat_arrays(x) for x in zip(*columns, strict=True)], names)

    asked = common.cut(texts.mapInArrow(ask, sent))
    answered = asked.where("part >= 0").select("batch", "part", "blob").repartition(model.buckets, "part").groupBy("part").applyInArrow(answer, "batch long, part long, blob binary")
    return asked.where("part < 0").select("batch", "blob", "ids").groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(put, schema)


def held_out(mod: int = 7, is_: int = 2):
    """Whether a document is kept from training; one without a doc_id isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == is_, F.lit(False))


def op8_lm_scores(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out()))
    found = score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = common.cut(found)
    model.delete()
    return kept
