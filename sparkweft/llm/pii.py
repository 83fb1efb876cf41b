"""Personal data, and the terms that give it away.

Emails, addresses, card and phone numbers are found by their forms. Each value is a protected
entity. The corpus tells how strongly a term near its mentions reveals it: with document counts
n(t), n(e) and n(t, e), the disclosure is PMI(t; e) / IC(e), that is log(N P(e|t) / n(e)) over
log(N / n(e)); 1 means that whoever sees the term knows the entity. P(e|t) is smoothed by half a
document for either outcome, (n(t,e) + 1/2) / (n(t) + 1), so entities of any document frequency are
judged, and what one document says counts for less than what many say. In documents that mention the
entity, terms at or above `remove` are removed and those at or above `generalise` are generalised.

A term's generalisations are classes of words: all that begin with its first half (its stem), and all of
its shape (letters, digits, or both). A class discloses as a term does, by the documents that have any
of its words. The first class whose own disclosure lies below `generalise` takes the term's place; where
none does, the term is removed.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

#: In this order they are listed; the last is the method's own.
KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
#: A run of digits is tried from its first digit alone: from a later one the same characters follow.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


@dataclass(frozen=True)
class Rule:
    window: int = 10  # words on either side of a mention
    remove: float = 0.9
    generalise: float = 0.7
    least: int = 3  # bytes of a term


#: Shapes of words, and their numbers among the terms; stems have those of words, turned by _STEM.
SHAPES = ("WORD", "NUMBER", "CODE")
_SHAPE = np.array([hashing.hash_of(f"shape:{x}") for x in SHAPES], np.int64)
_STEM = np.int64(0x5DEECE66D1234567)
#: Pairs of entity and term that go to every worker; beyond, they are joined by document.
PAIRS = 500_000
#: Slots of the filter of terms worth counting.
SLOTS = 1 << 24


def _emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and _LOCAL.match(text[begin - 1]):
            begin -= 1
        domain = _DOMAIN.match(text, at) if begin < at else None
        if domain:
            found.append((begin, domain.end()))
        last = domain.end() if domain else at + 1
        at = text.find("@", last)
    return found


def _luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _DIGITS.sub("", m[0])) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return found


def entity(kind: str, value: str) -> int:
    """An entity's number: letters lower-cased, phone and card numbers by their digits."""
    return hashing.hash_of(f"{kind}:{_DIGITS.sub('', value) if kind in ('card', 'phone') else value.lower()}")


def _stems(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the stem of each word ends: its first half, three bytes at least, in whole characters."""
    stop = np.minimum(starts + np.maximum(3, (ends - starts + 1) // 2), ends)
    for _ in range(3):
        stop = stop + ((stop < ends) & ((raw[np.minimum(stop, len(raw) - 1)] & 0xC0) == 0x80))
    return stop


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0, 1 or 2: no digit, digits alone, both."""
    digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
    n = digits[ends] - digits[starts]
    return np.where(n == 0, 0, np.where(n == ends - starts, 1, 2))


@dataclass(frozen=True)
class Words:
    """Words of a text outside its spans: places (code points), numbers, ends and numbers of their stems (0: none), shapes."""

    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    cut: np.ndarray
    stem: np.ndarray
    shape: np.ndarray


def _words(text: str, spans: list[tuple[str, int, int]], rule: Rule) -> Words:
    raw = np.frombuffer(text.encode(), np.uint8)
    s, e, h, c, hc = hashing.words(raw, hashing.WORDS, _stems)
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    shape, keep = _shapes(raw, s, e), e - s >= rule.least
    stem = np.where(c < e, hc.view(np.int64) ^ _STEM, 0)
    s, e, c = point[s], point[e], point[c]
    for _, a, b in spans:
        keep &= (e <= a) | (s >= b)
    return Words(s[keep], e[keep], h[keep].view(np.int64), c[keep], stem[keep], shape[keep])


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def disclosures(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """entity, term (64-bit hashes, of words and of their classes) and score of the pairs at or above `generalise`, from counts over all docs."""

    def near(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[tuple] = []
        for row, text in enumerate(batch.column(1).to_pylist()):
            spans = base_spans(text)
            if not spans:
                continue
            w = _words(text, spans, rule)
            by: dict[int, set[int]] = {}
            for kind, a, b in spans:
                around = slice(max(0, int(np.searchsorted(w.start, a)) - rule.window), int(np.searchsorted(w.start, b)) + rule.window)
                terms = by.setdefault(entity(kind, text[a:b]), set())
                terms.update(w.word[around].tolist(), w.stem[around].tolist(), _SHAPE[w.shape[around]].tolist())
                terms.discard(0)
            out += [(e, sorted(t)) for e, t in by.items()]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["entity", "terms"])

    texts = common.text_columns(docs)
    mentions = common.cut(common.map_texts(texts, near, "entity long, terms array<long>"))  # a row a document and entity
    known = mentions.groupBy("entity").agg(F.count("*").alias("n_e"))
    both = mentions.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    pairs = common.cut(both.join(known, "entity"))
    # A filter of fixed size: which slots hold a term near an entity. What passes by chance goes in the join.
    rows = pairs.select(F.expr(f"pmod(term, {SLOTS})").alias("slot")).groupBy(F.expr("cast(slot DIV 32 AS INT)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 AS INT)))").alias("bits")).collect()
    marks = np.zeros(SLOTS // 32, np.uint32)
    for r in rows:
        marks[r.at] = r.bits

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: dict[int, int] = {}
        for _, line, ends in hashing.runs(batch.column(1)):
            s, e, h, c, hc = hashing.words(line, hashing.WORDS, _stems)
            doc, long = np.searchsorted(ends, s, "right"), e - s >= rule.least
            shapes = np.bincount(doc[long] * 3 + _shapes(line, s, e)[long], minlength=3 * len(ends)).reshape(-1, 3)
            for term, n in zip(_SHAPE.tolist(), (shapes > 0).sum(axis=0).tolist(), strict=True):
                total[term] = total.get(term, 0) + n
            for some, keep in ((h.view(np.int64), long), (hc.view(np.int64) ^ _STEM, long & (c < e))):
                at = some & (SLOTS - 1)
                hit = np.flatnonzero(keep & (((marks[at >> 5] >> (at & 31).astype(np.uint32)) & 1) > 0))
                order = np.lexsort((doc[hit], some[hit]))
                d, t = doc[hit][order], some[hit][order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
                for term, n in zip(*(x.tolist() for x in np.unique(t[new], return_counts=True)), strict=True):
                    total[term] = total.get(term, 0) + n
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64()), pa.array([0] * len(total), pa.int64())], ["term", "n", "rows"])

    if not rows:  # nothing is near an entity
        return pairs.select("entity", "term", F.lit(1.0).alias("score"))
    seen = common.map_texts(texts, count, "term long, n long, rows long").groupBy("term").agg(F.sum("n").alias("n_t"))
    n_docs = float(docs.count())
    pmi = F.log(F.lit(n_docs) * (F.col("n_te") + 0.5) / ((F.col("n_t") + 1) * F.col("n_e")))
    ic = F.log(F.lit(n_docs) / F.col("n_e"))
    scored = pairs.join(seen, "term").select("entity", "term", F.when(ic > 0, pmi / ic).otherwise(0.0).alias("score"))
    return common.cut(scored.where(F.col("score") >= rule.generalise))


def _added(text: str, spans: list[tuple[str, int, int]], scores: dict[int, float], rule: Rule) -> list[tuple[str, int, int, str]]:
    """Spans of the revealing terms in the text, each with what takes its place."""
    if not scores:
        return []
    w, out = _words(text, spans, rule), []
    for i, term in enumerate(w.word.tolist()):
        if term in scores:
            a, b, shape = int(w.start[i]), int(w.end[i]), int(w.shape[i])
            if scores[term] >= rule.remove:
                place = ""
            elif w.stem[i] and int(w.stem[i]) not in scores:
                place = text[a : int(w.cut[i])] + "*"
            else:
                place = "" if int(_SHAPE[shape]) in scores else f"[{SHAPES[shape]}]"
            out.append(("term", a, b, place))
    return out


def _redact(text: str, spans: list[tuple[str, int, int]], more: list[tuple[str, int, int, str]]) -> str:
    cuts = [(a, b, f"[{k.upper()}]") for k, a, b in spans] + [(a, b, place) for _, a, b, place in more]
    out, last = [], 0
    for a, b, mark in sorted(cuts):
        if a < last:  # within or across another span: no character of either stays
            last = max(last, b)
            continue
        out += [text[last:a], mark]
        last = b
    return "".join([*out, text[last:]])


def sanitise(docs: DataFrame, rule: Rule = Rule(), pairs_limit: int = PAIRS, name: str = "pii") -> DataFrame:
    """All columns of docs with `text` sanitised, and `name`: n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Null texts stay null and count as empty. Rows with the same doc_id, null too, are judged each by
    its own text. A term that reveals several entities of a text counts by its largest disclosure. An
    empty table gives an empty one. A column of that name in docs is replaced.
    """
    revealing = disclosures(docs, rule)
    columns = [c for c in docs.columns if c != name]
    docs = docs.select(*columns, docs["text"].cast("string").alias("_text"))
    table: dict[int, list[tuple[int, float]]] = {}
    joined = revealing.count() > pairs_limit
    if joined:
        # Each row gets the pairs of its own entities: the few rows that mention one are joined by entity.
        keyed = common.cut(docs.withColumn("_row", F.monotonically_increasing_id()))
        docs = common.cut(_with_terms(keyed, revealing, rule)).drop("_row")
    else:
        for r in revealing.collect():
            table.setdefault(r.entity, []).append((r.term, r.score))
        docs = docs.withColumn("_terms", F.lit(None).cast("array<struct<term:long,score:double>>"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, given = batch.column(batch.schema.get_field_index("_text")).to_pylist(), batch.column(batch.schema.get_field_index("_terms")).to_pylist()
        clean, found = [], []
        for text, terms in zip(texts, given, strict=True):
            spans = base_spans(text or "")
            scores: dict[int, float] = {x["term"]: x["score"] for x in terms or []}
            for k, a, b in spans if table else ():
                for t, score in table.get(entity(k, text[a:b]), ()):
                    scores[t] = max(score, scores.get(t, 0.0))
            more = _added(text or "", spans, scores, rule)
            clean.append(_redact(text, spans, more) if spans else text)
            count = [sum(k == kind for k, _, _ in spans) for kind in KINDS[:4]]
            base = _digest(spans)
            found.append(dict(zip(FIELDS, (*count, hashlib.sha256(base.encode()).hexdigest(), _digest(spans + [x[:3] for x in more]), len(more)), strict=True)))
        kept = [batch.column(i) for i in range(len(columns))]
        kept[columns.index("text")] = pa.array(clean, pa.string())
        return pa.RecordBatch.from_arrays([*kept, pa.array(found, PII)], [*columns, name])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {'string' if c == 'text' else types[c]}" for c in columns) + f", `{name}` struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,n_term:long>"

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "_text"):
                yield work(part)

    return docs.mapInArrow(run, schema)


FIELDS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")
PII = pa.struct([(n, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in FIELDS])


def _with_terms(keyed: DataFrame, revealing: DataFrame, rule: Rule) -> DataFrame:
    """keyed with _terms: the revealing pairs of the entities that a row mentions."""

    def entities(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sorted({entity(k, t[a:b]) for k, a, b in base_spans(t)}) for t in batch.column(1).to_pylist()], pa.list_(pa.int64())), batch.column(0)], ["entities", "_row"])

    texts = keyed.select("_row", F.coalesce("_text", F.lit("")).alias("text"))
    mentions = common.map_texts(texts, entities, "entities array<long>, _row long").select("_row", F.explode("entities").alias("entity"))
    terms = mentions.join(revealing, "entity").groupBy("_row", "term").agg(F.max("score").alias("score")).groupBy("_row").agg(F.collect_list(F.struct("term", "score")).alias("_terms"))
    return keyed.join(terms, "_row", "left")


def op9_pii(spark, sf_dir):
    found = sanitise(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "pii.*")
