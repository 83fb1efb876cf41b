import re

from pyspark.sql import functions as F
from sparkweft.llm import licenses as L

TEXTS = [
    None, "", "plain words under the sun", "Th ndinly.\nLicensed under CC BY-NC 4.0.\nmore", "É à — this WORK is licensed under the GNU General Public License version 3",
    "foo " + L.TEMPLATES["MIT"][2].replace("Software", "Program", 1) + " bar", "x " * 4000 + "Released under the MIT License. " * 2, "Released under the MIT", "licensed under the",
]


def brute(text):
    """Every window of words against every template."""
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    words, best = norm(text or ""), 0.0
    words = [w for i, w in enumerate(words) if w != "x" or words[max(0, i - 40) : i + 41].count("x") < 81]  # of a run of one word its ends are enough
    for ts in L.TEMPLATES.values():
        for t in ts:
            w = norm(t)
            b = set(zip(w, w[1:]))
            for i in range(len(words) - 1):
                for n in {len(w) - 1, len(w), len(w) + 1}:
                    a = set(zip(words[i : i + n], words[i + 1 : i + n]))
                    best = max(best, 2 * len(a & b) / (len(a) + len(b)) if a else 0)
    return best


def test_against_all_windows(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3])], "doc_id long, text string").withColumn("licences", F.lit("clash"))
    rows = L.scan(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        best = brute(TEXTS[r.doc_id])
        assert (best >= L.LEAST) == bool(r.licences), (r.doc_id, best)
        if r.licences:
            assert max(x.dice for x in r.licences) >= best - 0.05
    by = {r.doc_id: r.licences for r in rows}
    assert [(x.licence, TEXTS[3][x.start : x.end]) for x in by[3]] == [("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0")]
    assert [(x.licence, x.start) for x in by[4]] == [("GPL-3.0", 6)]
    assert [x.licence for x in by[5]] == ["MIT"] and by[5][0].dice < 1
    assert L.scan(docs.limit(0)).count() == 0


def test_notices_beside_others_and_common_words(spark):
    texts = {
        "The rest of the page. Released under the MIT License.": ["MIT"],
        "Released under the MIT License. Licensed under CC BY 4.0.": ["MIT", "CC-BY-4.0"],
        "Code: Licensed under the MIT License. Text: Licensed under CC BY 4.0.": ["MIT", "CC-BY-4.0"],
        "Licensed under the MIT License. See the license for details.": ["MIT"],
        "of the x. " * 50 + L.TEMPLATES["MIT"][2] + " in the " * 50: ["MIT"],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    for i, (text, want) in enumerate(texts.items()):
        assert [x.licence for x in got[i].licences] == want and all(x.dice == 1 for x in got[i].licences), text
    one = got[3].licences[0]
    assert got[3].text[one.start : one.end] == "Licensed under the MIT License"


def test_full_texts_and_headers(spark):
    want = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "BSD-3-Clause", "BSD-2-Clause", "Unlicense", "AGPL-3.0", "ISC", "LGPL-3.0"]
    texts = [(name, f"Some words of ours. {max(L.TEMPLATES[name], key=len)} And more of them.") for name in want]
    texts += [("GPL-2.0", "# " + L.TEMPLATES["GPL-2.0"][1] + " x = 1"), ("LGPL-2.1", L.TEMPLATES["LGPL-2.1"][0])]
    bsd = max(L.TEMPLATES["BSD-3-Clause"], key=len)
    texts.append(("BSD-3-Clause", bsd.replace("the University nor", "Grove and Orchard Company Limited nor")))
    got = {r.doc_id: r.licences for r in L.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    for i, (name, _) in enumerate(texts):
        assert name in {x.licence for x in got[i]} and got[i][0].licence == name, (name, got[i])


PROSE = "of the page in the end to the other for the use and the rest of the work with the same as is by the way or the like. "


def short():
    return [(name, t) for name in sorted(L.TEMPLATES) for t in L.TEMPLATES[name] if len(t.split()) < 60]


def test_every_template_between_common_words(spark):
    texts = [(name, t) for name in sorted(L.TEMPLATES) for t in L.TEMPLATES[name]]
    docs = spark.createDataFrame([(i, PROSE * 3 + t + " " + PROSE * 3) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in L.scan(docs).collect()}
    for i, (name, t) in enumerate(texts):
        best = max(got[i], key=lambda x: (x.end - x.start, x.dice))
        assert best.licence == name and best.dice > 0.99 and abs((best.end - best.start) - len(t.strip())) < 40, (name, t[:60], best)


def test_every_notice_beside_every_other(spark):
    """All pairs of notices, each found where it stands: none is lost, whichever stands next to it."""
    pairs = [(a, b) for a in short() for b in short()]
    docs = spark.createDataFrame([(i, f"{PROSE}{a[1]} {b[1]} {PROSE}") for i, (a, b) in enumerate(pairs)], "doc_id long, text string")
    for r in L.scan(docs).collect():
        (one, t), (other, u) = pairs[r.doc_id]
        begin = len(PROSE)
        for name, low, high in ((one, begin, begin + len(t)), (other, begin + len(t) + 1, begin + len(t) + 1 + len(u))):
            inside = [x for x in r.licences if x.start < high - 1 and x.end > low + 1]
            assert name in {x.licence for x in inside}, (name, r.text, r.licences)


def test_ties_and_rows(spark):
    """Two templates of one text: the name that sorts first."""
    docs = spark.createDataFrame([(None, "x granted to all who ask y"), (1, "x granted to all who ask y"), (1, None)], "doc_id long, text string")
    rows = L.scan(docs, {"B": ["granted to all who ask"], "A": ["granted to all who ask"], "C": [""]}).collect()
    assert sorted([x.licence for x in r.licences] for r in rows) == [[], ["A"], ["A"]]


def test_the_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = L.op1_licenses(spark, folder).collect()
    assert len(rows) == len(texts) and any(r.n_notices for r in rows)
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    known = [(name, set(zip(w, w[1:])), len(w)) for name, t in short() for w in [norm(t)]]
    for r in rows:
        words, best = norm(texts[r.doc_id]), 0.0
        pairs = list(zip(words, words[1:]))
        for _, b, n in known:
            if sum(p in b for p in pairs) >= 0.66 * len(b):
                for i in range(len(pairs)):
                    for k in range(n - 2, n + 1):
                        a = set(pairs[i : i + k])
                        best = max(best, 2 * len(a & b) / (len(a) + len(b)) if a else 0)
        if r.dice is None:
            assert best < L.LEAST and r.n_notices == 0
        else:
            assert r.dice >= max(L.LEAST, best - 1e-9) and norm(texts[r.doc_id][r.start : r.end])
