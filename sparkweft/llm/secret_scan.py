"""Secrets in texts, with a random forest that removes false positives.

Candidates are runs of key characters that have a digit and are long, or that follow an assignment
(spaces or not), and quoted values of assignments up to their closing quotes.
Features: length, character transitions (classes, and a bigram model of the corpus itself), coverage
by the corpus's dictionary, the path and the neighbouring words, all of whole candidates. The forest is
trained from labelled findings: a table given by the caller, or the bounded set that made_findings()
writes by rule.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

#: Characters of a candidate at least: with a digit, or after an assignment.
LONG, ASSIGNED = 12, 6
#: Entries of the dictionary at most, which goes to every worker: the most frequent words (runs of letters) of
#: the corpus, of WORD characters at least. Words that are equally frequent are all in it or all out.
DICTIONARY, WORD = 20_000, 4
#: Labelled findings that training takes, at most (a random sample beyond); trees and their depth.
SAMPLE, TREES, DEPTH = 20_000, 40, 8
NEAR = 40  # characters on either side that hold the neighbouring words
_KEY = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c in b"+/_-" for c in range(256)])
#: A quoted value of an assignment, on one line.
_QUOTED = re.compile(r"""[=:][ \t]*(?:"((?:\\.|[^"\\\r\n])++)"|'((?:\\.|[^'\\\r\n])++)')""")
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])

# Words whose neighbourhood speaks for a secret, or against one.
FOR = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "auth", "credential", "aws", "bearer", "private")
AGAINST = ("example", "sample", "test", "dummy", "placeholder", "commit", "sha", "sha256", "md5", "hash", "checksum", "uuid", "id", "version", "isbn", "phone", "card", "http", "https", "path", "file")
PATHS = ("test", "example", "sample", "doc", "vendor", "fixture", "spec")
_WORDS = re.compile(r"[a-z0-9_]+")
_LETTERS = re.compile(rf"[^\W\d_]{{{WORD},}}")
FEATURES = ["length", "entropy", "switches", "digits", "upper", "hexadecimal", "natural", "covered", "prefix", "assigned", "quoted", "speaks_for", "speaks_against", "path_against"]


@dataclass(frozen=True)
class Corpus:
    """What the features take from all documents."""

    transitions: np.ndarray = field(default_factory=lambda: np.full((256, 256), math.log(1 / 256)))
    words: frozenset[str] = frozenset()
    #: How long the words are, longest first, by their first WORD letters.
    lengths: dict[str, list[int]] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        for w in self.words:
            self.lengths.setdefault(w[:WORD], []).append(len(w))
        for head, found in self.lengths.items():
            self.lengths[head] = sorted(set(found), reverse=True)


def _entropy(value: str) -> float:
    return -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _covered(value: str, corpus: Corpus) -> float:
    """The share of characters in words of the dictionary, longest first from the left."""
    low, at, hit = value.lower(), 0, 0
    while at < len(low):
        n = next((k for k in corpus.lengths.get(low[at : at + WORD], ()) if low[at : at + k] in corpus.words), 0)
        hit += n
        at += n or 1
    return hit / len(low)


def features(value: str, path: str, before: str, after: str, corpus: Corpus) -> list[float]:
    raw = np.frombuffer(value.lower().encode(), np.uint8)
    natural = float(corpus.transitions[raw[:-1], raw[1:]].mean()) if len(raw) > 1 else 0.0
    near = set(_WORDS.findall(before.lower()[-NEAR:])[-3:])
    around = near | set(_WORDS.findall(after.lower()[:NEAR])[:2])
    kinds = [_class(c) for c in value]
    tail = before.rstrip("\"' ")
    return [
        math.log(len(value)), _entropy(value), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / len(value),
        kinds.count(2) / len(value), kinds.count(1) / len(value), float(all(c in "0123456789abcdefABCDEF" for c in value)),
        natural, _covered(value, corpus), float(value.startswith(("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "xox", "AIza", "glpat-", "eyJ"))),
        float(tail.endswith(("=", ":", ":="))), float(before.endswith(('"', "'"))),
        float(any(w in FOR for w in near)), float(any(w in AGAINST for w in around)), float(any(w in path.lower() for w in PATHS)),
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of candidates, in code points."""
    raw = np.frombuffer(text.encode(), np.uint8)
    edge = np.diff(_KEY[raw].astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= ASSIGNED
    starts, ends = starts[long], ends[long]
    values = [m.span(m.lastindex) for m in _QUOTED.finditer(text)] if '"' in text or "'" in text else []
    values = [(a, b) for a, b in values if b - a >= ASSIGNED]
    if not len(starts):
        return values
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    # The last byte that is no space, at or before each place.
    solid = np.maximum.accumulate(np.where((raw != 32) & (raw != 9), np.arange(len(raw)), 0))
    last = np.where(starts > 0, raw[starts - 1], 0)
    quoted = ((last == 34) | (last == 39)) & (starts > 1)
    before = np.where(starts > 0, raw[solid[np.maximum(np.where(quoted, starts - 2, starts - 1), 0)]], 0)
    assigned = (before == 61) | (before == 58)
    sure = (ends - starts >= LONG) & (digits[ends] > digits[starts])
    keep = sure | assigned
    if not keep.any():
        return values
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    heads = {a for a, _ in values}
    # A quoted value takes the place of the run at its beginning, unless that is long.
    runs = [(a, b) for a, b, x in zip(point[starts[keep]].tolist(), point[ends[keep]].tolist(), sure[keep].tolist(), strict=True) if x or a not in heads]
    return sorted({*runs, *values})


def corpus_model(docs: DataFrame) -> Corpus:
    """Character transitions and the most frequent words, counted over all documents.

    To the driver come 65,536 pairs of characters at most, the histogram of word counts (with counts
    cut to 12 significant bits, so of bounded size whatever the corpus), and the dictionary.
    """
    texts = common.text_columns(docs).select("text")

    def count(batches):
        pairs = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in common.slices(batch):
                for _, line, _ in hashing.runs(part.column(0)):
                    for at in range(0, len(line), hashing.RUN):
                        low = hashing.SPACED[line[at : at + hashing.RUN + 1]].astype(np.int64)  # with the next run's first byte
                        pairs += np.bincount((low[:-1] << 8) | low[1:], minlength=1 << 16)
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(pairs[at], pa.int64())], ["pair", "n"])

    table = np.full((256, 256), 0.5)
    for r in texts.mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        table[r.pair >> 8, r.pair & 255] += r.n

    def tally(batches):
        """Words with their counts in a task, so that a frequent word is one row of each."""
        total: Counter[str] = Counter()
        for batch in batches:
            for part in common.slices(batch):
                for text in part.column(0).to_pylist():
                    total.update(_LETTERS.findall(text.lower()))
                if len(total) > 500_000:
                    yield _counted(total)
                    total.clear()
        yield _counted(total)

    words = common.cut(texts.mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    rough = F.expr("shiftleft(shiftright(n, greatest(length(bin(n)) - 12, 0)), greatest(length(bin(n)) - 12, 0))")
    least, kept = 1 << 62, 0
    for r in sorted(words.groupBy(rough.alias("level")).count().collect(), reverse=True):
        kept += r["count"]
        if kept > DICTIONARY:
            break
        least = r.level
    top = words.where(F.col("n") >= least).select("word").collect()
    return Corpus(np.log(table / table.sum(axis=1, keepdims=True)), frozenset(r.word for r in top))


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def made_findings(n: int = 3000, seed: int = 7, without: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (value, path, before, after, label) written by rule: n real forms of secrets, and n that look like them.

    without and only name families, to hold some out of training and to test on them.
    """
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, alnum = digits + "abcdef", lower + upper + digits

    def draw(alphabet: str, k: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(k))

    def word() -> str:
        return draw(lower, rng.randrange(2, 9))

    def prose() -> str:
        return " ".join(word() for _ in range(4))

    def assigned(value: str, links: tuple = (("=", ""), (" = ", '"'), (": ", ""), (": ", "'"), ("=", '"'))) -> tuple[str, str, str]:
        link, quote = rng.choice(links)
        return value, f"{prose()} {rng.choice(['password', 'passwd', 'secret', 'token', 'api_key', 'key', 'auth'])}{link}{quote}", f"{quote} {prose()}"

    def among(value: str, before: str = " ") -> tuple[str, str, str]:
        return value, f"{prose()}{before}", f" {prose()}"

    quoted = ((" = ", '"'), (": ", '"'), ("=", '"'), (":", '"'))
    secrets = {
        "hexadecimal": lambda: assigned(draw(hexa, rng.choice([16, 20, 32, 40, 64]))),
        "letters and digits": lambda: assigned(draw(alnum, rng.randrange(10, 41))),
        "signs": lambda: assigned(rng.choice(lower + upper) + draw(digits, 2) + draw(alnum + "!@#.$%-", rng.randrange(5, 20)), quoted),
        "cloud key": lambda: among("AKIA" + draw(upper + digits, 16)),
        "repository token": lambda: among("ghp_" + draw(alnum, 36)),
    }
    lookalikes = {
        "commit": lambda: among(draw(hexa, 40), " commit "),
        "digest": lambda: among(draw(hexa, 64), " sha256:"),
        "identifier": lambda: among("-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), " id "),
        "number": lambda: among(draw(digits, rng.randrange(12, 20))),
        "joined words": lambda: among(f"{word()}-{word()}-{rng.randrange(99)}{word()}"),
        "path": lambda: among(f"{word()}/{word()}/{word()}{rng.randrange(9)}", " path: "),
        "placeholder": lambda: assigned(rng.choice(["changeme", "xxxxxxxx", "your_password_here", "placeholder", "EXAMPLEKEY123"])),
        "labelled word": lambda: among(word() + word(), rng.choice([":", ": ", " = "])),
        "quoted prose": lambda: (f"{prose().capitalize()}{rng.choice(['.', ',', '!', ''])}", f"{prose()}{rng.choice([': ', ' = ', '='])}\"", f"\" {prose()}"),
        "name": lambda: (f"{word()}_{word()}", f"{prose()} name{rng.choice(['=', ': '])}", f" {prose()}"),
        "version": lambda: among(f"2{draw(digits, 3)}-0{draw('123456789', 1)}-1{draw(digits, 1)}T00", " version "),
    }
    out = []
    for label, families in ((1, secrets), (0, lookalikes)):
        names = [f for f in families if f not in without and (not only or f in only)]
        for _ in range(n if names else 0):
            family = rng.choice(names)
            value, before, after = families[family]()
            path = "docs/example.md" if family == "placeholder" else rng.choice(["src", "lib/app.py", "conf/settings.yml", "web", "tests/data", "docs/example.md"])
            out.append((value, path, before, after, label))
    return out


def train(spark: SparkSession, corpus: Corpus, findings: DataFrame | None = None, seed: int = 7):
    """A forest from labelled findings (value, path, before, after, label: 0 or 1).

    Null texts count as empty; rows without a value or label are left out. Of more than SAMPLE rows a
    random sample of about so many is taken. Findings that lack one of the two labels, an empty table
    too, are completed by made_findings().
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    rows = made_findings(seed=seed)
    if findings is not None:
        usable = findings.where("label IN (0, 1) AND value <> ''").select("value", "path", "before", "after", "label")
        n = usable.count()
        given = usable.where(F.rand(seed) < SAMPLE / n) if n > SAMPLE else usable
        labelled = [(r.value, r.path or "", r.before or "", r.after or "", int(r.label)) for r in given.collect()]
        rows = labelled if {r[-1] for r in labelled} == {0, 1} else labelled + rows
    data = [(float(label), Vectors.dense(features(v, p, b, a, corpus))) for v, p, b, a, label in rows]
    frame = spark.createDataFrame(data, ["label", "features"]).coalesce(1)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(frame)


def scan(docs: DataFrame, forest, corpus: Corpus) -> DataFrame:
    """A row for each candidate: doc_id, start, end (code points), kind, score, is_secret (score at least 0.5).

    Null and empty texts have none; a null `source` counts as an empty path; rows with the same doc_id
    each give their own; an empty table has none; other columns are ignored.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    given = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for key, text, path in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for a, b in candidates(text):
                value = text[a:b]
                out.append((key, a, b, "format" if value.startswith(("AKIA", "ASIA", "ghp_", "gho_")) else "generic", features(value, path, text[max(0, a - NEAR) : a], text[b : b + NEAR], corpus)))
        types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], ["doc_id", "start", "end", "kind", "features"])

    found = common.map_texts(given, work, f"doc_id {kind}, start long, end long, kind string, features array<double>")
    scored = forest.transform(found.withColumn("features", array_to_vector("features")))
    score = vector_to_array("probability")[1].alias("score")
    return scored.select("doc_id", "start", "end", "kind", score).withColumn("is_secret", F.col("score") >= 0.5)


def op4_secrets(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    corpus = corpus_model(docs)
    return scan(docs, train(spark, corpus), corpus)
