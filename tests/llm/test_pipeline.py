import re

import corpus_pipeline as C
import pytest
from sparkweft.llm import decontamination, jaccard
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_jaccard import brute as components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for i, (_, f) in enumerate(C.STAGES):
        made = f(spark, docs, SF)
        made.write.parquet(f"{folder}/{i}")
        out.append((docs, spark.read.parquet(f"{folder}/{i}")))
        docs = out[-1][1]
    return out


def test_columns_stay(stages):
    assert len(stages) == 5
    for docs, made in stages[:-1]:
        assert made.dtypes == docs.dtypes


def test_clean_documents_stay(stages):
    docs, made = stages[0]
    kept = {r.doc_id for r in made.collect()}
    for r in docs.collect():
        if len(re.findall(r"[^\W\d_]", r.text)) > 100:
            assert r.doc_id in kept


def test_one_of_each_group(stages):
    docs, made = stages[1]
    want = sorted(d for d, _, c in components([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if d == c)
    assert sorted(r.doc_id for r in made.collect()) == want


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs, made = stages[2]
    want = sorted(r.doc_id for r in docs.collect() if not contaminated(r.text, items)[3])
    assert sorted(r.doc_id for r in made.collect()) == want and len(want) < docs.count()


def test_personal_data_goes(stages):
    docs, made = stages[3]
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (docs, made))
    assert set(before) == set(after)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert any(email.search(t) for t in before.values()) and not any(email.search(t) for t in after.values())
    assert sum(before[d] != after[d] for d in before) < len(before) / 4


def test_every_text_is_packed(stages):
    docs, made = stages[4]
    got = {}
    for r in made.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert set(got) == {r.doc_id for r in docs.collect()}


def test_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, language string"
    rows = [(1, "the same text here again", "en", "s", 1, "x"), (1, "the same text here again", "en", "s", 1, "x"), (2, None, None, None, None, None), (None, "other words in this one", "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, schema)
    assert sorted((r.doc_id or 0) for r in jaccard.distinct(docs).collect()) == [0, 1, 2]
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert decontamination.scan(docs, docs.selectExpr("doc_id AS item_id", "text").limit(0)).count() == 4


def test_columns_of_the_same_names_long_texts_and_ties(spark):
    """Columns named like the stages' own, a very long text, and two languages with equal claims."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, language string, contamination string, pii string, _language string"
    english, german = "the harbour was calm and people walked there ", "der hafen war ruhig und leute gingen dort "
    rows = [(i, (english if i % 2 else german) * (i + 1) + f"w{i} " * 9, "en" if i % 2 else "de", "s", 1, "a", "b", "c", "d") for i in range(12)]
    rows += [(50, "walked a.b@mail.example " + english * 30_000, "en", "s", 1, "a", "b", "c", "d"), (51, english * 5 + german * 5, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")] and {(r.language, r.pii) for r in docs.collect()} <= {("a", "c"), (None, None)}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert "[EMAIL]" in texts[50] and len(texts[50]) > 1_000_000
    assert sum(r.length for r in C.pack(spark, docs, SF).where("doc_id = 50").collect()) > 200_000


def test_near_duplicates_by_five_words_and_four_fifths(spark):
    def shingles(text, k):
        w = text.split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    def alike(a, b, k):
        a, b = shingles(a, k), shingles(b, k)
        return len(a & b) / len(a | b)

    words = [f"w{i}" for i in range(100)]
    changed = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(words))
    # Two changes are near by five words at 0.8, not by four at 0.85; three changes are not near.
    rows = [(1, changed()), (2, changed(40, 60)), (3, changed(20, 50, 80)), (4, "x " + changed(10, 30, 70, 90))]
    assert alike(rows[0][1], rows[1][1], 5) >= 0.8 and alike(rows[0][1], rows[1][1], 4) < 0.85
    links = {(a, b) for a, s in rows for b, t in rows if a < b and alike(s, t, 5) >= 0.8}
    assert links == {(1, 2)}
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    made = C.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in made.collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in jaccard.distinct(docs).collect()) == [1, 2, 3, 4]  # op 3's own rule stays
