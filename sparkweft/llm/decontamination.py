"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items and documents are normalised alike: A-Z lower-cased, every other ASCII character
that is no letter or digit taken as a break. A window is `width` consecutive words of an item, or
all words of a shorter one. Each window has an anchor, the rarest of its runs of ANCHOR words, and the
automaton holds the anchors of all windows, about one run for every ten words of benchmark. It reads
each text once. Where it finds an anchor, the words around it are compared with the item's as far as
they agree, and agreement over a window is a hit; an occurrence of a window always holds its anchor,
so none is missed. Hits are mapped back to code points of the original text.

A benchmark beyond `block_bytes` is cut into blocks; each is a pass of its own over the texts, so a
worker holds one block's automaton at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 13
#: Words of an anchor.
ANCHOR = 4
#: Bytes of benchmark text in one automaton, which then takes some 100 MB.
BLOCK_BYTES = 8 << 20
#: Normalisation of UTF-8 bytes; bytes of other characters stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_DIGIT = 64  # children of the automaton's nodes, which are searched one after another
_built: dict[str, Scanner] = {}


@dataclass(frozen=True)
class Index:
    """A block of the benchmark, as arrays that go to the workers."""

    ids: list[str]  # of the items
    vocabulary: list[bytes]  # words, by number - 1; 0 is for all others
    words: np.ndarray  # numbers of the items' words, one item after another
    begin: np.ndarray  # where each item's words begin, and their end
    anchors: np.ndarray  # (place in words, length) of each window's anchor, without repetition
    width: int

    @staticmethod
    def made(items: list[tuple[str, str]], width: int = WIDTH) -> Index:
        """The index of items (id, text); repeated items count once, and those without words not at all."""
        split = [(item, text.encode().translate(NORMAL).split()) for item, text in sorted({(i, t or "") for i, t in items})]
        split = [(item, words) for item, words in split if words]
        vocabulary = sorted({w for _, words in split for w in words})
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        coded = [[number[w] for w in words] for _, words in split]
        begin = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
        seen = Counter(tuple(c[i : i + ANCHOR]) for c in coded for i in range(len(c) - ANCHOR + 1))
        anchors = []
        for at, c in zip(begin.tolist(), coded, strict=False):
            n = min(width, len(c))
            size = min(ANCHOR, n)
            rarity = [(seen.get(tuple(c[i : i + size]), 0), -i) for i in range(len(c) - size + 1)]
            span, window = n - size + 1, 0  # runs that a window has to choose from
            while window <= len(c) - n:
                i = -min(rarity[window : window + span])[1]  # of equally rare ones the last, which the most windows share
                anchors.append((at + i, size))
                window = i + 1
        return Index([item for item, _ in split], vocabulary, np.array([x for c in coded for x in c], np.int32), begin, np.array(anchors, np.int64).reshape(-1, 2), width)

    def name(self) -> str:
        digest = hashlib.sha256(repr((self.ids, self.vocabulary, self.width)).encode())
        for a in (self.words, self.begin, self.anchors):
            digest.update(a.tobytes())
        return digest.hexdigest()


class Scanner:
    """The automaton of an index, in a worker."""

    def __init__(self, index: Index):
        import ahocorasick

        self.index = index
        self.number = {w: i + 1 for i, w in enumerate(index.vocabulary)}
        digits = 1
        while _DIGIT**digits <= len(index.vocabulary):
            digits += 1
        # A word is a run of digits, each place with characters of its own, so words match only as wholes.
        code = lambda n: "".join(chr(0x100 + _DIGIT * p + n // _DIGIT**p % _DIGIT) for p in range(digits))
        self.digits, self.unknown = digits, code(0)
        self.code = {w: code(n) for w, n in self.number.items()}
        found: dict[str, list[tuple[int, int]]] = {}
        for at, size in index.anchors.tolist():
            key = "".join(code(n) for n in index.words[at : at + size].tolist())
            found.setdefault(key, []).append((at, size))
        self.automaton = ahocorasick.Automaton()
        for key, places in found.items():
            self.automaton.add_word(key, places)
        if found:
            self.automaton.make_automaton()
        self.item = np.repeat(np.arange(len(index.ids)), np.diff(index.begin))

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """How many words the text has, the word ranges (end exclusive) of windows in it, and their items."""
        words = text.encode().translate(NORMAL).split()
        if not words or not len(self.automaton):
            return len(words), [], set()
        get, unknown = self.code.get, self.unknown
        hits = list(self.automaton.iter("".join([get(w, unknown) for w in words])))
        if not hits:
            return len(words), [], set()
        index, line = self.index, np.array([self.number.get(w, 0) for w in words], np.int32)
        ranges, items, last = set(), set(), {}
        for end, places in hits:
            stop = (end + 1) // self.digits
            for at, size in places:
                # Where the text runs along an item, all of its anchors tell the same run: it is compared once.
                shift = stop - size - at
                if last.get(shift, 0) >= stop:
                    continue
                item = int(self.item[at])
                low, high = int(index.begin[item]), int(index.begin[item + 1])
                back = min(at - low, stop - size)
                differs = np.flatnonzero(line[stop - size - back : stop - size] != index.words[at - back : at])
                a = stop - size - (back - (int(differs[-1]) + 1) if len(differs) else back)
                ahead = min(high - at - size, len(words) - stop)
                differs = np.flatnonzero(line[stop : stop + ahead] != index.words[at + size : at + size + ahead])
                b = stop + (int(differs[0]) if len(differs) else ahead)
                last[shift] = b
                if b - a >= min(index.width, high - low):
                    ranges.add((a, b))
                    items.add(index.ids[item])
        return len(words), sorted(ranges), items


def scanner(index: Index, name: str) -> Scanner:
    """The worker's scanner of the index; another one that it had goes first."""
    if name not in _built:
        _built.clear()
        _built[name] = Scanner(index)
    return _built[name]


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as code points of the text."""
    if not ranges:
        return []
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(NORMAL))]
    place = lambda b: len(raw[:b].decode())
    return [{"start": place(at[a][0]), "end": place(at[b - 1][1])} for a, b in ranges]


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, name: str = "contamination") -> DataFrame:
    """docs with a column `name`: n_words, n_hit (words inside windows), n_items, items, items_sha256, contaminated, hits.

    contaminated: some word is hit, and at least one in twenty. hits are spans of code points. Null and
    empty texts have no words and no hits. Items without words have no windows; items whose id is null
    count under the id "null"; repeated items count once. Rows are judged one by one, so repeated rows
    and null ids are no matter; an empty table stays empty; a column of that name gives way.
    """
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = bench.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks == 1:
        index = Index.made([(r.item, r.text) for r in bench.collect()], width)  # of bounded size: a block
        key = index.name()

        def work(texts: pa.Array) -> pa.Array:
            known = scanner(index, key)
            return pa.array([_finished(t, n, _merge(ranges), sorted(items)) for t in texts.to_pylist() for n, ranges, items in [known.scan(t)]], RESULT)

        return common.append(docs, name, RESULT, RESULT_SQL, work)
    return _by_blocks(docs, bench, width, blocks, name)


def _by_blocks(docs: DataFrame, bench: DataFrame, width: int, blocks: int, name: str) -> DataFrame:
    """The same in a pass a block: each gives the rows that have hits, and these are put together by row."""
    columns = [c for c in docs.columns if c != name]
    row, given = common.free("_row", docs.columns), common.free("_old", docs.columns)
    # Rows have no key of their own, so they are kept with one.
    keyed = common.cut(docs.select(*(f"`{c}`" for c in columns)).withColumn(row, F.monotonically_increasing_id()))
    texts = keyed.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = None
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        index = Index.made([(r.item, r.text) for r in part.collect()], width)
        key = index.name()

        def hits(batch: pa.RecordBatch, index=index, key=key) -> pa.RecordBatch:
            known, out = scanner(index, key), []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, ranges, items = known.scan(text)
                if ranges:
                    out.append({"row": at, "ranges": [{"a": a, "b": b} for a, b in ranges], "items": sorted(items)})
            return pa.RecordBatch.from_pylist(out, pa.schema([("row", pa.int64()), ("ranges", RANGES), ("items", pa.list_(pa.string()))]))

        one = common.cut(common.map_texts(texts, hits, f"row long, ranges {RANGES_SQL}, items array<string>"))
        found = one if found is None else found.union(one)
    whole = found.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))
    joined = keyed.join(whole.select(F.col("row").alias(row), F.struct("ranges", "items").alias(given)), row, "left")

    def finish(batches):
        for batch in batches:
            for some in common.slices(batch, given + "_text"):
                made = []
                for text, old in zip(some.column(len(columns) + 1).to_pylist(), some.column(len(columns)).to_pylist(), strict=True):
                    old = old or {"ranges": [], "items": []}
                    made.append(_finished(text, len(text.encode().translate(NORMAL).split()), _merge([(r["a"], r["b"]) for r in old["ranges"]]), sorted(set(old["items"]))))
                yield pa.RecordBatch.from_arrays([*some.columns[: len(columns)], pa.array(made, RESULT)], [*columns, name])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    wide = joined.select(*(f"`{c}`" for c in columns), given, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(given + "_text"))
    return wide.mapInArrow(finish, ", ".join(f"`{c}` {types[c]}" for c in columns) + f", `{name}` {RESULT_SQL}")


RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
RANGES_SQL = "array<struct<a:long,b:long>>"
RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("items_sha256", pa.string()),
    ("contaminated", pa.bool_()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
RESULT_SQL = "struct<n_words:long,n_hit:long,n_items:long,items:array<string>,items_sha256:string,contaminated:boolean,hits:array<struct<start:long,end:long>>>"


def _finished(text: str, n: int, ranges: list[tuple[int, int]], items: list[str]) -> dict:
    hit = sum(b - a for a, b in ranges)
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    return {"n_words": n, "n_hit": hit, "n_items": len(items), "items": items, "items_sha256": digest, "contaminated": hit > 0 and 20 * hit >= n, "hits": _spans(text, ranges)}


def op10_decontamination(spark, sf_dir):
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *(f"contamination.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
widths AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, widths, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT DISTINCT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.s = win.s AND pos.n = win.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
