import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sparkweft.llm import kneser_ney as K

TRAIN = ["The cat sat on the mat", "the cat ate", "a dog sat on a cat", None, "", "x\x00y  the\tdog ate the cat \x1f", "rare words only here", "the end", "the cat sat on the mat"] * 2 + ["the dog"]
TEST = [*TRAIN, "the unseen cat", "unknown alone", "cat the on sat", "long " * 300_000]


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


class Brute:
    """Counts and probabilities by hand."""

    def __init__(self, texts, order):
        seqs, self.order = [tokens(t) for t in texts], order
        self.c = Counter(w for s in seqs for w in s)
        self.v, self.n = len(self.c), sum(self.c.values())
        grams = Counter((*p[i : i + order - 1], w) for s in seqs for p in [["<s>"] * (order - 1) + s] for i, w in enumerate(s))
        self.levels = [grams]  # the highest first; each shorter one counts the words before its n-grams
        while len(self.levels) < order:
            self.levels.append(Counter(g[1:] for g in self.levels[-1]))
        self.levels.reverse()
        self.d = [K._discounts(np.array([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])) for c in self.levels]
        self.after = [{} for _ in self.levels]
        for level, into in zip(self.levels, self.after, strict=True):
            for g, x in level.items():
                into.setdefault(g[:-1], []).append(x)
        for into, d in zip(self.after, self.d, strict=True):
            for context, counts in into.items():
                into[context] = sum(counts), sum(d[min(x, 3)] for x in counts)

    def p(self, context, w):
        level = len(context)
        sums, d = self.after[level].get(context), self.d[level]
        lower = self.p(context[1:], w) if level else 1 / (self.v + 1)
        if not sums:
            return lower
        c = self.levels[level][(*context, w)]
        return max(c - d[min(c, 3)], 0) / sums[0] + sums[1] / sums[0] * lower


@pytest.mark.parametrize("order", [3, 2])
@pytest.mark.parametrize("bucket", [1 << 22, 19])
def test_against_brute_force(spark, bucket, order, monkeypatch):
    monkeypatch.setattr(K, "BUCKET", bucket)  # 19: many buckets, and words spread over several
    if bucket == 19:
        for name, value in (("GATHER", 50), ("PART_BYTES", 20), ("RANGE", 7), ("WIDE", 2), ("TOGETHER", 2)):
            monkeypatch.setattr(K, name, value)
    often = ["the cat sat on " * 260] if bucket == 19 else []  # counts beyond one byte
    train = TRAIN + often
    docs = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string")
    model, brute = K.train(docs, order), Brute(train, order)
    assert (len(model.folder.read("hot", np.uint64)) > 2) == (bucket == 19) and (len(model.offsets) > 3) == (bucket == 19)
    assert (model.tokens, model.words, model.types) == (brute.n, brute.v, len(brute.levels[1]))
    for context in [("<s>",) * (order - 1), ("<s>", "the")[-order + 1 :], ("dog", "ate")[-order + 1 :], ("nowhere", "the")[-order + 1 :], ("no", "where")[-order + 1 :]]:
        assert abs(sum(brute.p(context, w) for w in [*brute.c, "unseen"]) - 1) < 1e-9
    test = spark.createDataFrame(list(enumerate(TEST + often)), "doc_id long, text string").withColumn("score", F.lit("clash"))
    cache = {}
    for routed in (None, True):
        rows = K.score(test, model, routed).collect()
        assert len(rows) == len(TEST + often)
        for r in rows:
            seq = tokens((TEST + often)[r.doc_id])
            padded = ["<s>"] * (order - 1) + seq
            grams = [(tuple(padded[i : i + order - 1]), w) for i, w in enumerate(seq)]
            for x in grams:
                if x not in cache:
                    cache[x] = math.log10(brute.p(*x))
            assert math.isclose(r.score, sum(cache[x] for x in grams), rel_tol=1e-9), (r.doc_id, routed)
            assert math.isclose(r.base_score, sum(math.log10((brute.c[w] + 1) / (brute.n + brute.v + 1)) for w in seq), rel_tol=1e-9)
            assert (r.n_tokens, r.n_known) == (len(seq), sum(w in brute.c for w in seq))
    model.delete()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = K.train(docs.limit(0))
    assert [(r.n_tokens, r.n_known, r.score, r.base_score) for r in K.score(docs, model).orderBy("doc_id").collect()] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    assert K.score(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        K.train(docs, 4)


def test_the_query_against_brute_force(spark):
    """op8_lm_scores on the whole table: the model learns from all but the held-out documents, and scores all."""
    import zlib

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    brute, cache = Brute([t for d, t in texts.items() if not held[d]], 3), {}
    rows = K.op8_lm_scores(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        seq = tokens(texts[r.doc_id])
        padded = ["<s>", "<s>", *seq]
        want = 0.0
        for i, w in enumerate(seq):
            x = (padded[i], padded[i + 1]), w
            if x not in cache:
                cache[x] = math.log10(brute.p(*x))
            want += cache[x]
        assert math.isclose(r.score, want, rel_tol=1e-9) and r.held_out == held[r.doc_id] and r.train_tokens == brute.n
        assert math.isclose(r.base_score, sum(math.log10((brute.c[w] + 1) / (brute.n * 1 + brute.v + 1)) for w in seq), rel_tol=1e-9)


def test_documents_without_an_id_are_learned_from(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a")], "doc_id long, text string")
    assert docs.where(~K.held_out()).count() == 2


def test_a_lookup_reads_each_file_of_hot_words_once_whatever_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(K, "BUCKET", 40)
    docs = spark.createDataFrame([(i, " ".join(f"the w{(i * j) % 97} of the v{j % 13}" for j in range(30))) for i in range(60)], "doc_id long, text string")
    model = K.train(docs)
    count, h = next(x[1:] for x in K._tokens(pa.array([r.text for r in docs.collect()])))
    _, _, context, last, _ = model.prepared(count, h)
    read, opened = model.folder.read, []
    monkeypatch.setattr(type(model.folder), "read", lambda self, name, kind: opened.append(name) or read(name, kind))
    places = list(K._split(model.bucket(context, last)))
    a, b = model.answers(places, context, last)
    shared = [n for n in opened if n.startswith(("shared-", "pair-"))]
    assert len(places) > 8 and shared and len(shared) == len(set(shared))
    for p, at in places:  # the same as bucket by bucket
        x, y = model.answers([(p, slice(None))], context[at], last[at])
        assert (x == a[at]).all() and (y == b[at]).all()
    model.delete()
