import re

import pytest
from sparkweft.llm import decontamination as D


def brute(text, items, width=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, ids = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(width, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in wins:
                hit.update(range(i, i + n))
                ids.add(str(item))
    return len(words), len(hit), len(ids), len(hit) > 0 and 20 * len(hit) >= len(words)


ITEMS = [(1, "What is the capital of Ruritania?"), (2, "one two three"), (3, " ".join(f"w{i}" for i in range(20))), (4, None), (5, "!!"), (2, "one two three"), (6, "É à")]
TEXTS = [None, "", "One, two three one two three!", "x " * 300 + "what IS the capital of ruritania", " ".join(f"w{i}" for i in range(4, 19)) + " end", "é à É à", "wone two three", "a" * 50000]


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_against_brute_force(spark, block):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(2, TEXTS[2])], "doc_id long, text string").selectExpr("*", "'x' AS contamination", "'y' AS item_id")
    rows = D.scan(docs, bench_of(spark), 13, block).collect()
    assert {r.item_id for r in rows} == {"y"}
    got = sorted((r.doc_id, r.contamination.n_words, r.contamination.n_hit, r.contamination.n_items) for r in rows)
    assert [r.contamination.contaminated for r in rows] == [brute(TEXTS[r.doc_id], ITEMS)[3] for r in rows]
    want = sorted((i, *brute(t, ITEMS)[:3]) for i, t in [*enumerate(TEXTS), (2, TEXTS[2])])
    assert got == want


def bench_of(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_spans_point_into_the_original(spark):
    docs = spark.createDataFrame([(1, "Ünï — ONE, two;THREE. x")], "doc_id long, text string")
    bench = spark.createDataFrame([(2, "one two three")], "item_id long, text string")
    found = D.scan(docs, bench).first().contamination
    assert [docs.first().text[s.start : s.end] for s in found.hits] == ["ONE, two;THREE"]
    assert found.contaminated and found.items == ["2"] and D.scan(docs, bench.limit(0)).first().contamination.n_hit == 0
    assert D.scan(docs.limit(0), bench).count() == 0


def test_against_brute_force_on_random_texts():
    """Few words, so that windows, anchors and items overlap, repeat and share runs."""
    import random

    rng = random.Random(4)
    for width in (13, 6, 3):
        for _ in range(40):
            word = lambda: f"w{rng.choice([0, 0, 0, 1, 1, 2, 3, 4])}"
            items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 13, 14, 30])))) for i in range(8)]
            scanner = D.Scanner(D.Index.made([(str(i), t) for i, t in items], width))
            for _ in range(10):
                words = [word() if rng.random() < 0.95 else "none" for _ in range(60)]
                item = rng.choice(items)[1].split()
                words[20 : 20 + len(item)] = item
                n, ranges, found = scanner.scan(" ".join(words))
                hit = {k for a, b in ranges for k in range(a, b)}
                assert (n, len(hit), len(found)) == brute(" ".join(words), items, width)[:3]


def test_the_automaton_is_small_beside_the_benchmark():
    import random

    rng = random.Random(4)
    words = [f"{rng.randrange(30000):x}ab" for _ in range(100_000)]
    items = [(str(i), " ".join(words[i : i + 100])) for i in range(0, len(words), 100)]
    made = D.Scanner(D.Index.made(items))
    size = sum(len(t) for _, t in items)
    assert made.automaton.get_stats()["total_size"] < 12 * size
    assert made.scan(items[7][1])[2] == {"700"}


def test_the_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = D.op10_decontamination(spark, folder).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == brute(texts[r.doc_id], items)
