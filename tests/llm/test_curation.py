"""Filter audit, quality classifier and fill-in-middle: brute force, odd rows, empty tables."""

import hashlib
import os
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, documents, prose
from tidemark.llm import fill_in_middle, filter_audit, positive_unlabelled

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"
LARGE = "/root/testdata/sf0.1"


# -- fill in the middle ----------------------------------------------------------------

def slow_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, post = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{post}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{post}<M>{mid}"


MARKED = [
    (20, "a<P>b", "s"), (21, "<P", "s"), (22, "P>x<S", "s"), (23, "<S<M", "t"), (24, "\\Q$1\\E $2 {3}", "t"),
    (25, "é́😀\r\n\x00\x85  end\n", "t"), (26, "\n", "t"), (27, "a" * 50_000, "t"), (28, "7" * 400_000, "t"),
    (29, "ab1" * 300_000, "t")]


def test_fim_equals_brute_force_and_round_trips(spark):
    rows = ODD + MARKED + [(i, prose(i, i % 50), "s") for i in range(100, 400)]
    docs = documents(spark, rows, clashes=True).withColumn("_fim", F.lit(1)).withColumn("_fim_n", F.lit(2))
    out = fill_in_middle.transformed(docs)
    assert out.columns[:-1] == docs.columns
    f = F.col(out.columns[-1])
    got = out.select("doc_id", "text", *[f[x].alias(x) for x in fill_in_middle.FIELDS],
                     fill_in_middle.restored(f["output"], f["form"]).alias("back")).collect()
    assert len(got) == len(rows)
    forms = set()
    for r in got:
        assert tuple(r)[2:7] == slow_fim(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}


def test_fim_of_other_marks_and_no_rows(spark, none):
    assert fill_in_middle.transformed(none).count() == 0
    marks = fill_in_middle.Marks("[[a.", "$b", "c\\", 0, 50)
    docs = documents(spark, [(i, prose(i, 30), "s") for i in range(40)])
    out = fill_in_middle.transformed(docs, marks=marks)
    f = F.col(out.columns[-1])
    got = out.select("text", f["form"].alias("form"), fill_in_middle.restored(f["output"], f["form"], marks).alias("b")).collect()
    assert all(r["text"] == r["b"] for r in got) and {r["form"] for r in got} == {"psm", "spm"}


# -- filter audit ----------------------------------------------------------------------

def slow_measures(text):
    words = WORD.findall(text)
    return (len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text)))


def test_transducer_counts_like_patterns():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aA #$\nbé😀Z\t\x0b\x85\xa0") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["", " ", "x", "", "a" * 5000, "x y " * 3000, prose(1, 3000), "é" * 99, ""]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(b) for b in raw])
    got = filter_audit.measured(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert list(zip(*[c.tolist() for c in got])) == [slow_measures(t) for t in texts]
    assert [c.tolist() for c in filter_audit.measured(np.empty(0, np.uint8), np.zeros(3, np.int64))] == [[0, 0]] * 5


def test_words_of_equal_hash_are_compared_by_bytes():
    words = [b"aa", b"ab", b"aa", b"ba", b"ab", b"cc"]
    letters = np.frombuffer(b"".join(words), np.uint8)
    begin, length, owner = np.arange(0, 12, 2), np.full(6, 2), np.array([0, 0, 0, 0, 0, 1])
    for hashes in (np.zeros(6, np.uint64), np.full(6, 2**64 - 1, np.uint64)):  # all collide, at the table's end too
        assert filter_audit.first_of_kind(letters, begin, length, owner, hashes).sum() == 4


def slow_audit(rows, labels):
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    docs = []
    for i, t, part in rows:
        t = t or ""
        words, caps = WORD.findall(t), len(re.findall("[A-Z]", t))
        smaller = [j for j, u, _ in rows if (u or "") == t and j is not None and (i is None or j < i)]
        fails = "".join(f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * caps > 3 * len(t), re.search(r"[#$%&*|]", t),
            smaller)) if bad)
        docs.append((part or "", fails, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        totals = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                totals[f] += len(now)
                found.append((part, "".join(order), step, len(left), len(now), sum(f in d[1] for d in gone),
                              sum(d[1] == f for d in docs if d[0] == part), sum(d[2] for d in now), sum(d[3] for d in now)))
                gone += now
        out += [(*r, totals[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def test_audit_equals_brute_force(spark, none):
    parts = {"s": "en", "t": "fr", "u": "", None: None}
    rng = random.Random(5)
    rows = [(i, t, parts[s]) for i, t, s in ODD]
    base = [prose(1, 260), prose(2, 260, 30), prose(3, 220).upper(), prose(4, 230) + " #", "short", "", prose(5, 30) + " $ A A A"]
    rows += [(rng.choice([*range(20, 60), None]), rng.choice(base), rng.choice(["en", "fr", None])) for _ in range(120)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(22, 1, 0), (22, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select(
        "*", *[F.lit(1).alias(c) for c in ("part", "mask", "id", "n", "good", "digest", "at", "quality")])
    found = filter_audit.filter_audit(docs, spark.createDataFrame(labels, LABELS))
    order = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.select(*order).collect())) == slow_audit(rows, labels)
    assert filter_audit.filter_audit(none, spark.createDataFrame([], LABELS)).count() == 0


# -- quality classifier ----------------------------------------------------------------

def test_style_of_odd_texts():
    for text in (b"", b" \n", b"x", "漢字".encode() * 500, b"!" * 100_000, b"a b\n" * 5, b"\x00\x01"):
        assert len(positive_unlabelled.style(text)) == len(positive_unlabelled.MEASURES)


def test_fit_is_the_least_of_the_greater_risk():
    """The closed form against plain subgradient descent on the non-negative risk, where its bound binds and where not."""
    rng = np.random.default_rng(0)
    measures = rng.integers(0, 256, (400, len(positive_unlabelled.MEASURES))).astype(np.uint8)
    good = measures[:, 0] < 90
    x = positive_unlabelled.hinges(measures) / positive_unlabelled.TOP
    p, u = x[good][:100], x
    sums = [positive_unlabelled.Sums(len(a), (a * 255).T @ (a * 255)) for a in (p, u)]
    eye = (positive_unlabelled.RIDGE + 1 / len(p)) * np.eye(x.shape[1])
    eye[0, 0] = 1e-9

    def risk(w, prior):
        own = prior * np.mean((1 - p @ w) ** 2) / 4
        rest = np.mean((1 + u @ w) ** 2) / 4 - prior * np.mean((1 + p @ w) ** 2) / 4
        return own + max(rest, 0) + w @ eye @ w / 2

    for prior in (0.35, 0.6, 0.95):
        w = positive_unlabelled.fitted(*sums, prior)
        best = risk(w, prior)
        for _ in range(300):
            assert risk(w + rng.normal(0, 10 ** rng.uniform(-5, 0), len(w)), prior) >= best - 1e-7


def test_prior_from_scores():
    rng = np.random.default_rng(1)
    positive = np.histogram(rng.beta(5, 2, 20_000), 1000, (0, 1))[0]
    mixed = np.histogram(np.concatenate([rng.beta(5, 2, 14_000), rng.beta(1, 9, 6_000)]), 1000, (0, 1))[0]
    assert abs(positive_unlabelled.estimated_prior(positive, mixed) - 0.7) < 0.04
    assert positive_unlabelled.estimated_prior(np.zeros(5), np.ones(5)) == 0.5


def junk(seed):
    words = prose(seed, 80).split()
    return " ".join(f"{w}{'#$%&'[i % 4] * 3}" for i, w in enumerate(words)) if seed % 2 else " ".join(w for w in words for _ in range(9))


def test_scores_of_odd_rows_and_rules_of_the_fold(spark, odd, none):
    clean = [(i, prose(i, 100), "s") for i in range(100, 700)]
    bad = [(i, junk(i), "s") for i in range(700, 900)]
    rows = clean + bad
    docs = odd.select("doc_id", "text").unionByName(documents(spark, rows).select("doc_id", "text")).withColumns(
        {c: F.lit(1) for c in ("id", "style", "good", "score", "positive", "fold")})
    labels = [(i, 1, 0) for i in range(100, 700, 2)] + [(i, 0, 0) for i in range(700, 760)] + [(None, 1, 0), (5, 1, 0), (5, 0, 0)]
    made = spark.createDataFrame(labels, LABELS)
    got = positive_unlabelled.quality_scores(docs, made).collect()
    assert len(got) == len(ODD) + len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    right = [r["predicted"] == (r["doc_id"] < 700) for r in got if r["held_out"] and (r["doc_id"] or 0) >= 100]
    assert np.mean(right) > 0.95
    # labels of held out rows change nothing
    turned = made.withColumn("quality", F.when(positive_unlabelled.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = positive_unlabelled.quality_scores(docs, turned).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert positive_unlabelled.quality_scores(none, made).count() == 0
    lone = positive_unlabelled.quality_scores(docs, spark.createDataFrame([], LABELS)).select("score").distinct().collect()
    assert [r[0] for r in lone] == [0.5]


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="test tables are not here")
def test_held_out_accuracy_and_prior(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    rows = positive_unlabelled.measured(docs, labels).cache()
    model = positive_unlabelled.learnt(rows)
    found = positive_unlabelled.scored(rows, model).filter("held_out").join(
        labels.withColumnRenamed("doc_id", "id"), "id").toPandas()
    assert (found["predicted"] == found["quality"]).mean() > 0.98
    assert abs(model.prior - labels.agg(F.avg("quality")).first()[0]) < 0.05
    rows.unpersist()
