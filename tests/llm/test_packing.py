import zlib
from array import array

import public_tokenizers
import pytest
import tokenizers
from sparkweft.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "a", "Hello  world \n\n x  y ", " lead", "  two leads", "tail ", "a<|endoftext|> b", "don't\tstop  now ok \x1c x", "漢字 🙂🙂 é" * 30, "word " * 5000, "x" * 3000, "\n", " ", "   ", "a \nb\n c"]


def test_ids_are_those_of_the_library():
    t, e = tokenizers.Tokenizer.from_file(PATH), P.Encoder(PATH)
    assert e.fast is not None
    for text in TEXTS[1:]:
        assert list(array("I", e(text))) == t.encode(text, add_special_tokens=False).ids, text[:20]


@pytest.mark.parametrize("pool", [4, 4096])
def test_pieces_cover_documents_and_sequences(spark, pool):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS * 3)], "doc_id long, text string, start string, length string")
    rows = P.pack_documents(docs, PATH, P.Limits(segments=5), pool).collect()
    t = tokenizers.Tokenizer.from_file(PATH)
    for i, text in enumerate(TEXTS * 3):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        at = 0
        for r in mine:
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    for s in {r.sequence_id for r in rows}:
        mine, at = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset), 0
        assert len(mine) <= 5
        for r in mine:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert P.pack_documents(docs.limit(0), PATH).count() == 0


def test_examples_keep_all_limits(spark):
    made = [(i, 100 + 37 * (i % 50), 10 * (i % 40)) for i in range(400)]
    rows = P.pack_examples(spark.createDataFrame(made, "example_id long, tokens long, loss_tokens long").coalesce(1), P.Limits(2048, 6, 700)).collect()
    assert sorted((r.example_id, r.tokens, r.loss_tokens) for r in rows) == made
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    assert all(sum(r.tokens for r in b) <= 2048 and len(b) <= 6 and sum(r.loss_tokens for r in b) <= 700 for b in bins.values())
    assert len(bins) <= 1.1 * max(sum(x[1] for x in made) / 2048, len(made) / 6, sum(x[2] for x in made) / 700) + 1


def test_limits_below_one_are_an_error():
    for bad in ({"tokens": 0}, {"segments": 0}, {"loss_tokens": 0}):
        with pytest.raises(ValueError):
            P.Limits(**bad)


def test_the_heuristic_against_brute_force():
    """Each bin takes, of what fits, the item with the largest product of its demand and the room left; of equal ones the first."""
    import random

    rng = random.Random(3)
    for _ in range(60):
        limits = P.Limits(rng.choice([20, 50]), rng.choice([2, 4, 9]), rng.choice([10, 30]))
        made = [(t := rng.randrange(1, limits.tokens + 1), min(t, rng.randrange(0, limits.loss_tokens + 1))) for _ in range(25)]
        got = [[i.key for i in b] for b in P.place([P.Item(k, 0, t, n, t) for k, (t, n) in enumerate(made)], limits, False)]
        size, left, want = (limits.tokens, limits.segments, limits.loss_tokens), list(range(len(made))), []
        while left:
            room, chosen = list(size), []
            while True:
                fits = [k for k in left if made[k][0] <= room[0] and room[1] >= 1 and made[k][1] <= room[2]]
                if not fits:
                    break
                score = lambda k: sum(a * b / c / c for a, b, c in zip((made[k][0], 1, made[k][1]), room, size, strict=True))  # noqa: B023, E731
                best = max(fits, key=lambda k: (round(score(k), 12), -k))
                room = [room[0] - made[best][0], room[1] - 1, room[2] - made[best][1]]
                left.remove(best)
                chosen.append(best)
            want.append(chosen)
        assert got == want


def test_the_query_covers_all_ids_with_little_padding(spark):
    """op2_packing on whole tables: each id in one piece, sequences without gaps, padding of at most two in a hundred."""
    folder = "/root/testdata/sf0.01"
    t = tokenizers.Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = P.op2_packing(spark, folder).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for d, text in texts.items():
        ids, at = t.encode(text, add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    used = sum(r.length for r in rows)
    assert 1 - used / (2048 * len(sequences)) < 0.02
