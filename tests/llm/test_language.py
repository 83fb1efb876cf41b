import numpy as np
import pytest
from sparkweft.llm import language as L

TEXTS = {"en": "the cat and the dog were walking through this town with their friends ", "de": "der hund und die katze gingen mit ihren freunden durch diese schöne stadt ", "fr": "le chien et le chat se promenaient dans cette belle ville avec leurs amis "}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXTS[k] * (3 + i % 5), k, "x") for i, k in enumerate(["en", "de", "fr"] * 20)]
    rows += [(100, TEXTS["en"] * 30 + TEXTS["fr"] * 15, None, "x"), (101, None, "en", "x"), (102, "", "de", "x"), (103, "123 — !!", "fr", "x"), (0, TEXTS["en"], "en", "x"), (None, "x" * 3_000_000, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")


def test_languages_and_mixtures(docs):
    model = L.train(docs)
    assert model.languages == ["de", "en", "fr"]
    assert np.allclose(np.exp(model.table.astype(float)).sum(axis=0), 1, atol=1e-3)
    rows = L.identify(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.lang and r.text and r.doc_id < 100:
            assert r.language.lang_pred == r.lang and r.language.score > 0.9
    mixed = next(r for r in rows if r.doc_id == 100).language
    shares = {s.lang: s.share for s in mixed.shares}
    assert set(shares) == {"en", "fr"} and abs(shares["en"] - 2 / 3) < 0.05 and mixed.lang_pred == "en"
    assert {r.language.lang_pred for r in rows if r.doc_id in (101, 102, 103)} == {"und"}


def test_nothing_learned_and_nothing_given(docs):
    none = L.train(docs.limit(0))
    assert none.languages == [] and {r.language.lang_pred for r in L.identify(docs, none).collect()} == {"und"}
    assert L.identify(docs.limit(0), L.train(docs)).count() == 0


def test_em_against_a_grid():
    rng = np.random.default_rng(1)
    units = rng.normal(size=(40, 2)) * 2
    like = np.exp(units - units.max(axis=1, keepdims=True))
    L_ROUNDS, L.ROUNDS = L.ROUNDS, 400
    try:
        share, _ = L._shares(like, np.array([0]), np.array([40]), np.ones((1, 2), bool))
    finally:
        L.ROUNDS = L_ROUNDS
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([np.log(like @ [p, 1 - p]).sum() for p in grid])]
    assert abs(share[0, 0] - best) < 0.01


def grams(text):
    """The slot of the three bytes around each letter of a text, as its line ends with a space."""
    raw = [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.encode() + b" "]
    apart = [32, *raw, 32]
    return [((((apart[i] << 16) | (apart[i + 1] << 8) | apart[i + 2]) * 2654435761) % (1 << 32)) >> 16 for i, c in enumerate(raw) if c != 32]


def identified(text, languages, logs):
    """Language and share by hand: runs of grams, EM over all languages, then fewer and fewer, by penalised likelihood."""
    found = grams(text)
    if not found:
        return None
    units = np.array([[sum(float(logs[k][g]) for g in found[i : i + L.UNIT]) for k in languages] for i in range(0, len(found), L.UNIT)])
    like = np.exp(np.maximum(units - units.max(axis=1, keepdims=True), -300))

    def em(chosen):
        share = np.array([1 / len(chosen) if k in chosen else 0.0 for k in range(len(languages))])
        for _ in range(L.ROUNDS):
            joint = like * share
            share = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        return share, np.log(np.maximum((like * share).sum(axis=1), 1e-300)).sum() - L.COST * np.log(len(like) + 1) * len(chosen)

    chosen = set(range(len(languages)))
    best, value = em(chosen)
    share, first = best, True
    while len(chosen) > 1:
        small = {k for k in chosen if share[k] < L.LEAST and k != int(share.argmax())} if first else set()
        chosen -= small or {min(chosen, key=lambda k: (share[k], -k))}
        share, score = em(chosen)
        if score >= value:
            best, value = share, score
        first = False
    return languages[int(best.argmax())], float(best.max())


def test_the_query_against_brute_force(spark):
    import zlib

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs}
    languages = sorted({r.lang for r in docs if r.lang is not None and not held[r.doc_id]})
    counts = {k: np.full(L.SLOTS, 0.5) for k in languages}
    for r in docs:
        if r.lang is not None and not held[r.doc_id]:
            np.add.at(counts[r.lang], grams(r.text), 1)
    logs = {k: np.log(c / c.sum()).astype(np.float32) for k, c in counts.items()}
    texts, right = {r.doc_id: r for r in docs}, []
    rows = L.op6_language(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = identified(texts[r.doc_id].text, languages, logs)
        assert r.held_out == held[r.doc_id] and r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-3
        if r.held_out and texts[r.doc_id].lang:
            right.append(r.lang_pred == texts[r.doc_id].lang)
    assert np.mean(right) >= 0.95


def test_ties_and_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "abc abc", "b"), (3, "abc abc", "a")], "doc_id long, text string, lang string")
    assert docs.where(~L.held_out()).count() == 2
    rows = L.identify(docs, L.train(docs)).collect()  # the same counts for both: the language that sorts first
    assert [r.language.lang_pred for r in rows] == ["a", "a"] and all(0 < r.language.score <= 1 for r in rows)
    assert L.identify(docs, L.train(docs), "lang").columns == ["doc_id", "text", "lang"]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        L.train(spark.createDataFrame([(i, "abc", f"l{i}") for i in range(3)], "doc_id long, text string, lang string"))
