"""S001 by cases, and planted slips of a small dictionary against a plain edit distance."""

import random

from marginalia.operators import misspellings as ms

KNOWN = "the they effective treatment receive estimate organised sample rate town then review stratified section kilometre labelled analysis rose ad per capita".split()


def found(spark, *texts, terms=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(w, 100 - k) for k, w in enumerate(KNOWN)], "word string, freq long")
    own = spark.createDataFrame([(t,) for t in terms], "term string") if terms else None
    rows = ms.misspellings(docs, known, own).orderBy("doc_id", "start").collect()
    assert all(texts[r.doc_id][r.start : r.end] == r.text and r.rule_id == "S001" for r in rows)
    return [[(r.text, r.replacement) for r in rows if r.doc_id == k] for k in range(len(texts))]


CASES = [
    ("They recieve the treatmnet", [("recieve", "receive"), ("treatmnet", "treatment")]),
    ("They estimates, treatments, unstratified, organized, subsection, kilometer, labeled", []),  # derived forms
    ("thes", [("thes", "the")]),  # function words take no suffix
    ("The effec-\ntive rate", [("effec-\ntive", "effective")]),
    ("ABCXYZ it's qzx@town.org town/qzxy qzxy_a http://qzxy.org", []),
    ("The Zyxwvu town. Zyxwvu rose. Treatmnet rose", [("Treatmnet", "Treatment")]),  # names, sentence starts
    ("Qqqqqq JK, rose. Tratment et al rose", []),
    ("ad valorem, per capita rose: valorem", [("valorem", None)]),
    ("zzyzx zzyzx zzyzx the", []),  # a word used three times is the author's
    ("mis-treatment", []),
    ("subbbsection stratifieddd", [("subbbsection", None), ("stratifieddd", "stratified")]),
    ("", []),
    (None, []),
]


def test_cases(spark):
    got = found(spark, *[t for t, _ in CASES])
    for (text, want), have in zip(CASES, got, strict=True):
        assert have == want, text


def test_terms_and_nulls(spark):
    assert found(spark, "the seroprev", None, "the serprev", terms=["Seroprev"]) == [[], [], [("serprev", None)]]


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def slipped(word, r):
    k = r.randrange(len(word) - 1)
    c = r.choice("abcdefghijklmnopqrstuvwxyz")
    return r.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :], word[:k] + word[k + 1] + word[k] + word[k + 2 :]])


def test_planted_slips(spark):
    r = random.Random(5)
    words = sorted({"".join(r.choice(["ba", "ko", "tri", "men", "sul", "ve", "ra"]) for _ in range(r.randint(3, 5))) for _ in range(300)})
    known = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, freq long")
    lost = sorted({slipped(slipped(w, r), r) if k % 2 else slipped(w, r) for k, w in enumerate(words)} - set(words))
    got = {x.lower: (x.distance, x.suggested) for x in ms.suggestions(spark.createDataFrame([(w,) for w in lost], "lower string"), known).collect()}
    for w in lost:
        near = sorted((osa(w, x), -k, x) for k, x in enumerate(words))
        least = near[0][0]
        want = (least, [x for d, _, x in near if d == least][:3]) if least <= 2 else None
        assert got.get(w) == want, w
    # planted slips of one edit: all are reported, with the word meant among the suggestions where it is nearest
    text = " ".join(f"{w} {slipped(w, r)}" for w in words)
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    hits = ms.misspellings(docs, known).select("start", "text").collect()
    parts, at, planted, good = text.split(" "), 0, set(), set()
    for k, p in enumerate(parts):
        (planted if k % 2 and p not in words else good).add(at)
        at += len(p) + 1
    starts = {h.start for h in hits}
    assert len(starts & planted) / len(planted) > 0.8  # slips that end like a suffix of a known word pass for it
    assert not starts & good


def test_forms_are_never_broadcast(spark):
    """Their size is guessed from the words they are made of, so a broadcast of them fills the driver."""
    known = spark.createDataFrame([(w, k) for k, w in enumerate(KNOWN)], "word string, freq long")
    lost = spark.createDataFrame([("recieve",)], "lower string")
    plan = ms.suggestions(lost, known)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [form" in plan and "BroadcastHashJoin [form" not in plan
