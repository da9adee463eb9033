"""Spelling variants, document quality and centroid clustering against brute force, finite differences and held-out accuracy."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import centroid_clusters, quality_crf, spelling_variants

random.seed(3)
DOCS = "doc_id long, text string"


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


# spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    return any((a[:i] + a[i + 1 :] if len(a) == len(b) else a[:i] + a[i:]) == b[:i] + b[i + 1 :] for i in range(len(b)))


def variants_brute(counts, factor=5):
    form, out = {}, {}
    for w, n in counts.items():
        close = sorted((-m, x) for x, m in counts.items() if near(w, x))
        form[w] = close[0][1] if close and -close[0][0] >= factor * n else None
        out[w] = len(close)
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, out[w], counts[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


def words_brute(docs):
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("few, letters", [(1, "ab"), (1, "aé"), (2, "abcÿ"), (32, "ab"), (32, "abcÿ")])
def test_variants_small_alphabets(spark, few, letters):
    """Few letters and short words: nearly all share a segment, so hot segments are cut again and again."""
    words = {"".join(random.choice(letters) for _ in range(random.randint(1, 9))): random.choice([5, 5, 6, 25, 30, 150, 800]) for _ in range(220)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling_variants.variants(frame, few=few)) == variants_brute(words)


def test_variants_of_texts(spark):
    base = ["kitten", "mittens", "sitting", "Ünöder", "unöder", "x" * 40, "flower×"]
    docs = []
    for i in range(500):
        words = []
        for _ in range(40):
            w = random.choice(base)
            if random.random() < 0.1:
                at = random.randrange(len(w))
                w = w[:at] + random.choice("aeÉ") + w[at + random.randint(0, 1) :]
            words.append(random.choice([w, w.upper(), w.title()]))
        docs.append((i if i % 50 else None, random.choice([" ", "\n", "-", "1", "漢"]).join(words)))
    docs += [(7, None), (8, ""), (9, "short it is"), docs[3], docs[3]]
    frame = spark.createDataFrame(docs, DOCS).select("*", F.lit("other").alias("word"), F.lit(1).alias("TEXT"), F.lit(2).alias("n"))
    want = words_brute(docs)
    assert {r.word: r.n for r in spelling_variants.word_counts(frame).collect()} == want
    assert rows_of(spelling_variants.variants(spelling_variants.word_counts(frame))) == variants_brute(want)
    assert any(zlib.crc32(f"{i}:{w}".encode()) % 199 == 0 for i, t in docs if i is not None for w in re.findall("[a-zà-ÿ]+", (t or "").lower()))
    assert rows_of(spelling_variants.variants(spelling_variants.word_counts(frame.limit(0)))) == []


def test_variants_long_chain(spark):
    """Roots over a long chain of forms, ties to the smaller word, a word of a million letters."""
    chain = {"a" * (6 + i): 5 * 5**i for i in range(12)}
    long = "b" * 1_000_000
    other = "cd" * 50_000
    words = chain | {long: 5, long + "b": 25, other: 5, other[:70_000] + "x" + other[70_001:]: 6, other[:5] + other[6:]: 7, "y" + other: 30, other[:9] + "xx" + other[11:]: 99, "zzzzza": 9, "zzzzzb": 50, "zzzzzc": 50}
    got = {r.word: (r.form, r.root) for r in spelling_variants.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["aaaaaa"] == ("aaaaaaa", "a" * 17) and got["a" * 17] == (None, "a" * 17)
    assert got[other] == ("y" + other, "y" + other) and got[other[:5] + other[6:]] == (None, other[:5] + other[6:])
    assert got[long] == (long + "b", long + "b") and got["zzzzza"] == ("zzzzzb", "zzzzzb")
    text = spark.createDataFrame([(1, ("c" * 2_000_000 + " ") * 5)], DOCS)
    assert [(len(r.word), r.n) for r in spelling_variants.word_counts(text).collect()] == [(2_000_000, 5)]


# document quality


def test_quality_marginals_are_exact():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        field = quality_crf.Field(np.zeros((3, 1)), 0.0, np.zeros(2), rng.normal(size=(2, 2)) * 2)
        u = rng.normal(size=n) * 2
        weight = {y: math.exp(sum(a for a, b in zip(u, y, strict=True) if b) + sum(field.trans[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=n)}
        want = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(n)]
        assert np.allclose(field.marginals(u), want)


@pytest.mark.parametrize("chained", [False, True])
def test_quality_likelihood_and_gradient(chained):
    rng = np.random.default_rng(2)
    chains = [(rng.integers(0, 3, (n, len(quality_crf.FEATURES))).astype(np.uint8), rng.integers(0, 2, n)) for n in (1, 2, 4, 3, 2)]
    x = rng.normal(size=3 * quality_crf.WIDE * len(quality_crf.FEATURES) + 7) * 0.4
    value, grad = quality_crf.loss(x, chains, 0.01, chained)
    for i in [*rng.choice(len(x), 30).tolist(), *range(len(x) - 7, len(x))]:
        d = np.zeros(len(x))
        d[i] = 1e-5
        assert abs((quality_crf.loss(x + d, chains, 0.01, chained)[0] - quality_crf.loss(x - d, chains, 0.01, chained)[0]) / 2e-5 - grad[i]) < 1e-6
    field, want = quality_crf.Field(*quality_crf._unpacked(x)), 0.0
    for b, y in chains:  # every labelling of every chain
        u = field.leanings(b, np.zeros(1, np.int64))
        total = {s: math.exp(sum(a for a, k in zip(u, s, strict=True) if k) + chained * sum(field.trans[a, c] for a, c in itertools.pairwise(s))) for s in itertools.product((0, 1), repeat=len(y))}
        want -= math.log(total[tuple(y.tolist())] / sum(total.values()))
    assert abs(value - want / sum(len(y) for _, y in chains) - 0.005 * (x @ x)) < 1e-9


def plain_sums(line):
    words = re.findall(r"[^ \t\x0b\x0c\r]+", line)
    mark = lambda c: not (c.isalpha() or c.isdigit() or c in " \t\x0b\x0c\r.,;:?!'\"()-")
    odd = lambda c: mark(c) or c in ".,;:?!'\"()-"
    return [
        len(line), sum(c.isalpha() for c in line), sum(c.isupper() for c in line), sum(c.isdigit() for c in line), sum(c in ".,;:?!'\"()-" for c in line), sum(map(mark, line)),
        sum(a == b and odd(a) for a, b in itertools.pairwise(line)), sum(map(len, words)), len(words), sum(not any(c.isalpha() for c in w) for w in words),
        sum(any(c.isalpha() for c in w) and any(map(mark, w)) for w in words), sum(w[0].isupper() for w in words), sum(a == b for a, b in itertools.pairwise(words)),
        sum(len(set(words[i : i + 64])) for i in range(0, len(words), 64)),
    ]


def test_quality_sums():
    lines = ["a", " ", "  Ab ab  AB ab", "x## x## 12 é3 ..!! \t漢字 漢字 🙂", "w " * 200, "ab ba ab ba", "-", "\ta", " ".join(random.choice(["to", "be", "or", "Not", "#1"]) for _ in range(300))]
    assert quality_crf._sums(lines).tolist() == [plain_sums(x) for x in lines]


def test_quality_bins_of_many_texts_are_those_of_each():
    texts = ["a b\n\nc", "", "\n", "same\nsame\nother", "x" * 700_000 + "\n" + "y z " * 100_000]
    together, lengths, first = quality_crf.bins(texts)
    assert lengths.tolist()[:3] == [3, 0, 1] and len(together) == 3 + 1 + 2 + 3 + 2
    for i, t in enumerate(texts):
        alone = quality_crf.bins([t])[0]
        assert (together[first[i] : first[i] + len(alone)] == alone).all()
    same = list(quality_crf.FEATURES).index("same_line")
    assert together[first[3] : first[3] + 3, same].tolist() == [1, 1, 0]


def quality_tables(spark, n=400):
    words = ["the", "house", "was", "old", "and", "Anna", "walked", "by", "slowly", "rain"]
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        lines = [" ".join(random.choice(words) for _ in range(random.randint(3, 15))) + "." for _ in range(random.randint(1, 8))]
        if not good:
            kind = random.choice([lambda x: x.upper() + "!!", lambda x: x + "###", lambda x: "| " + x])
            lines = [" ".join(kind(w) for w in line.split()) for line in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_tables(spark)
    odd = [(1000, None), (1001, ""), (1002, "\n\n"), (None, rows[0][1]), (5, rows[5][1]), (1003, "word " * 300_000), (1004, "a\n" * 200_000)]
    docs = spark.createDataFrame(rows + odd, DOCS).select("*", F.lit("de").alias("lang"), F.lit(1).alias("SCORE"), F.lit(2).alias("h"))
    marks = spark.createDataFrame([*labels, (None, 1, 0), (2000, 0, 0), (6, None, 0), *labels[:3]], "doc_id long, quality int, toxic int")
    model = quality_crf.fitted(docs, marks)
    got = quality_crf.scored(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = dict((i, q) for i, q, _ in labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1
    assert quality_crf.scored(docs.limit(0), model).count() == 0


def test_quality_learns_from_no_held_out_row(spark):
    """The labels of held-out rows may be anything: the scores don't change."""
    rows, labels = quality_tables(spark, 120)
    docs = spark.createDataFrame(rows, DOCS)
    told = []
    for flip in (0, 1):
        marks = [(i, q ^ (flip and zlib.crc32(str(i).encode()) % 5 == 0), 0) for i, q, _ in labels]
        model = quality_crf.fitted(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
        told.append(rows_of(quality_crf.scored(docs, model)))
    assert told[0] == told[1]


def test_quality_mixed_text_lies_between(spark):
    rows, labels = quality_tables(spark)
    model = quality_crf.fitted(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    good, bad = "Anna walked by the old house.", "ANNA!! WALKED!! BY!! THE!! OLD!! HOUSE!!"
    share = lambda lines: model.shares(*quality_crf.bins(["\n".join(lines)]))[0]
    assert share([good] * 9) > 0.9 > share([good] * 6 + [bad] * 3) > share([bad] * 9) and share([bad] * 9) < 0.1


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(1, 1, 0), (2, 1, 0)], 1.0), ([(1, 0, 0)], 0.0)])
def test_quality_without_both_labels(spark, labels, want):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], DOCS)
    model = quality_crf.fitted(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r.score for r in quality_crf.scored(docs, model).collect()} == {want}


# centroid clustering


def clusters_brute(rows, k, dim, scale, rounds, seed=2):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [int(np.nan_to_num(np.floor(scale * np.float64(x)))) for x in v], v))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    cs = [list(r[1]) for r in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))[::-1]
    for _ in range(rounds):
        own = {}
        for _, v, _ in kept:
            own.setdefault(nearest(v)[0], []).append(v)
        cs = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(cs)]
    return sorted(((i, j, min(d, 2**63 - 1)) for i, v, _ in kept for j, d in [nearest(v)]), key=repr), cs


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("cluster"), F.lit(2).alias("EMBEDDING"))


@pytest.mark.parametrize("case", ["clouds", "grid", "copies", "huge", "few"])
def test_clusters(spark, monkeypatch, case):
    rng = np.random.default_rng(5)
    dim, k = 3, 7
    points = {
        "clouds": lambda: (rng.normal(size=(400, dim)) + rng.integers(0, 4, (400, 1)) * 6).tolist(),
        "grid": lambda: (rng.integers(-2, 3, (300, dim)) / 2).tolist(),  # many ties
        "copies": lambda: [[0.5, 0.5, 0.5]] * 150 + rng.normal(size=(150, dim)).tolist(),
        "huge": lambda: (rng.normal(size=(60, dim)) * 10.0 ** rng.integers(0, 300, (60, 1))).tolist() + [[1.7e308] * dim],
        "few": lambda: rng.normal(size=(4, dim)).tolist(),
    }[case]()
    rows = list(enumerate(points)) + [(9000, None), (9001, [1.0, None, 2.0]), (9002, [1.0, float("nan"), 0.0]), (9003, [1.0, float("-inf"), 0.0]), (9004, [1.0]), (9005, []), (None, [1.0, 2.0, 3.0]), (3, points[3]), (3, [0.0, 0.0, 1.0])]
    monkeypatch.setattr(centroid_clusters, "CHUNK", 100)
    found, cs = centroid_clusters.clusters(vectors(spark, rows), k, dim, 256, 4)
    want, centroids = clusters_brute(rows, k, dim, 256, 4)
    assert cs == centroids and rows_of(found) == want


def test_clusters_described(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(90, 64)) + rng.integers(0, 3, (90, 1))).tolist())]
    got = centroid_clusters.described(*centroid_clusters.clusters(vectors(spark, rows), 5)).collect()
    want, cs = clusters_brute(rows, 5, 64, 256, 5)
    inertia = Counter()
    for _, j, d in want:
        inertia[j] += d
    assert sorted(map(tuple, got), key=repr) == sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, j, d in want), key=repr)
    empty = centroid_clusters.described(*centroid_clusters.clusters(vectors(spark, rows).limit(0), 5))
    assert empty.collect() == []


def test_tree_filters_and_keeps_ties():
    rng = np.random.default_rng(7)
    points = np.floor(rng.normal(size=(2000, 2)) * 40 + rng.integers(0, 5, (2000, 1)) * 600)
    centroids = [[600 * i, 600 * i] for i in range(5)] + [[0, 0], [300, 300]]
    tree = centroid_clusters.Tree(list(range(2000)), points)
    whole = sum(b - a for a, b, k, _, each in tree.assigned(centroids) if each is None)
    assert whole > 1500  # nearly all go by whole nodes
    of, far = tree.distances(centroids)
    for i, p, j, d in zip(tree.ids, tree.points.tolist(), of, far, strict=True):
        assert (d, j) == min((int((p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2), n) for n, c in enumerate(centroids))
        assert points[i].tolist() == p
