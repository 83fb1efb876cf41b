"""Languages of a document, by mixture inference.

Each language has a distribution over character n-grams (three bytes around a letter, in slots of a
hash), counted in Spark over all labelled documents. A document is a mixture: its runs of UNIT
n-grams each come from one of its languages, and expectation-maximisation estimates the languages'
shares. The set of languages is the one with the largest penalised likelihood on the way from all
languages down to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

#: N-grams in a run; rounds of EM; shares below LEAST are dropped together; what a language more costs, in log(runs).
UNIT, ROUNDS, LEAST, COST = 48, 8, 0.01, 1.0
#: Slots of a language: the model has SLOTS floats, 256 KiB, for each and goes to every worker. So it grows with the languages, not with the documents.
SLOTS = 1 << 16
#: Languages that a model has at most (256 MiB).
LANGUAGES = 1024
UNKNOWN = "und"
_LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # slots x languages: log probabilities


def _grams(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of letters, and the slot of the n-gram around each."""
    letters = _LETTERS[line]
    at = np.flatnonzero(letters != 32)
    apart = np.concatenate([[32], letters, [32]]).astype(np.uint32)
    code = (apart[at] << np.uint32(16)) | (apart[at + 1] << np.uint32(8)) | apart[at + 2]
    return at, ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _blocks(line: np.ndarray):
    for at in range(0, len(line), hashing.RUN):
        yield at, line[at : at + hashing.RUN]


def train(docs: DataFrame) -> Model:
    """The model of all rows with a label; null labels and texts add nothing, repeated rows count each time.

    More than LANGUAGES different labels are an error, since the model goes to every worker.
    """
    labelled = common.text_columns(docs, F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL").select("lang", "text")
    languages = sorted(r.lang for r in labelled.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    number = {name: i for i, name in enumerate(languages)}

    def run(batches):
        total = np.zeros(len(languages) * SLOTS, np.int64)
        for batch in batches:
            for part in common.slices(batch):
                of = np.array([number[name] for name in part.column(0).to_pylist()], np.int64)
                for begin, line, ends in hashing.runs(part.column(1)):
                    for at, block in _blocks(line):
                        place, slot = _grams(block)
                        key = of[np.searchsorted(ends, place + at, "right") + begin] * SLOTS + slot
                        if len(total) <= 4 * len(key):
                            total += np.bincount(key, minlength=len(total))
                        else:
                            found, n = np.unique(key, return_counts=True)
                            total[found] += n
        at = np.flatnonzero(total)
        for some in np.array_split(at, max(1, len(at) // SLOTS)):
            yield pa.RecordBatch.from_arrays([pa.array(some // SLOTS, pa.int32()), pa.array(some % SLOTS, pa.int32()), pa.array(total[some], pa.int64())], ["lang", "slot", "n"])

    counted = labelled.mapInArrow(run, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = np.full((SLOTS, len(languages)), 0.5)
    for r in counted.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("n")).toLocalIterator():
        table[r.slots, r.lang] += r.n
    table = np.log(table / table.sum(axis=0)).astype(np.float32) if languages else table.astype(np.float32)
    return Model(languages, table)


def _units(line: np.ndarray, ends: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of the runs of n-grams, by language, and the text of each."""
    sums, docs = [], []
    for at, block in _blocks(line):
        place, slot = _grams(block)
        if not len(place):
            continue
        doc = np.searchsorted(ends, place + at, "right")
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
        begin = np.flatnonzero(rank % UNIT == 0)
        sums.append(np.add.reduceat(model.table[slot], begin, axis=0, dtype=np.float64))
        docs.append(doc[begin])
    n = len(model.languages)
    return (np.concatenate(sums), np.concatenate(docs)) if sums else (np.zeros((0, n)), np.zeros(0, np.int64))


def _shares(like: np.ndarray, begin: np.ndarray, count: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM: the languages' shares in each text, and the log-likelihood (less a constant of the text)."""
    share = mask / mask.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        joint = like * np.repeat(share, count, axis=0)
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(joint, begin, axis=0) / count[:, None]
    seen = (like * np.repeat(share, count, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(np.maximum(seen, 1e-300)), begin)


def _least(share: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The language of the set with the smallest share, of equal ones the last."""
    return share.shape[1] - 1 - np.where(mask, share, 2.0)[:, ::-1].argmin(axis=1)


def mixtures(units: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have runs, in order, and the shares of the languages in the best set."""
    begin = np.flatnonzero(np.diff(docs, prepend=-1))
    if not len(begin):
        return begin, np.zeros((0, units.shape[1]))
    count = np.diff(np.append(begin, len(docs)))
    like = np.exp(np.maximum(units - units.max(axis=1, keepdims=True), -300.0))
    cost = COST * np.log(count + 1.0)
    mask = np.ones((len(begin), units.shape[1]), bool)
    share, fit = _shares(like, begin, count, mask)
    best, value = share, fit - cost * mask.sum(axis=1)
    drop = share < LEAST
    drop[np.arange(len(drop)), share.argmax(axis=1)] = False
    none = np.flatnonzero(drop.sum(axis=1) == 0)
    drop[none, _least(share, mask)[none]] = True
    while True:
        mask = mask & ~drop
        mask[mask.sum(axis=1) == 0] = best[mask.sum(axis=1) == 0] > 0
        share, fit = _shares(like, begin, count, mask)
        score = fit - cost * mask.sum(axis=1)
        better = score >= value
        best, value = np.where(better[:, None], share, best), np.where(better, score, value)
        more = mask.sum(axis=1) > 1
        if not more.any():
            return docs[begin], best
        drop = np.zeros_like(mask)
        drop[np.arange(len(mask)), _least(share, mask)] = True
        drop[~more] = False


def identify(docs: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """docs with a column `name`: lang_pred, score (its share, 0 to 1) and the shares of the languages found.

    A null or empty text, one without a letter, and any text when nothing was learned is `und`, with
    score 0. Ties go to the language that sorts first. Repeated rows and null ids are no matter; an
    empty table stays empty; a column of that name gives way.
    """
    languages = model.languages

    def work(texts: pa.Array) -> pa.Array:
        has = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
        out: list[dict] = [{"lang_pred": UNKNOWN, "score": 0.0, "shares": []} for _ in range(len(texts))]
        for begin, line, ends in hashing.runs(texts) if languages else ():
            which, shares = mixtures(*_units(line, ends, model))
            found = np.zeros((len(ends), len(languages)))
            found[which] = shares
            for i, share in enumerate(found):
                if has[begin + i]:
                    # Letters that the n-grams don't show leave all languages alike.
                    share = share if share.any() else np.full(len(languages), 1 / len(languages))
                    top = int(share.argmax())
                    out[begin + i] = {"lang_pred": languages[top], "score": float(min(1.0, share[top])), "shares": [{"lang": languages[k], "share": float(share[k])} for k in np.flatnonzero(share >= LEAST)]}
        return pa.array(out, KIND)

    return common.append(docs, name, KIND, "struct<lang_pred:string,score:double,shares:array<struct<lang:string,share:double>>>", work)


KIND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("shares", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])


def accepted(found: DataFrame, model: Model, least: float = 0.5, name: str = "language") -> DataFrame:
    """The rows of identify() in a known language with at least that share, without its column.

    Where nothing was learned, the rows that have a letter.
    """
    known = (F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least) if model.languages else F.coalesce(F.col("text"), F.lit("")).rlike(r"\pL")
    return found.where(known).drop(name)


def held_out(mod: int = 4, is_: int = 2):
    """Whether a document is kept from training; one without a doc_id isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == is_, F.lit(False))


def op6_language(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score", F.size("language.shares").cast("long").alias("n_languages"))
