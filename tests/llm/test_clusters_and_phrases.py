"""Centroid clusters, the signature join and phrases against brute force and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import centroids, minhash_join, near, phrases
from ledgerloom.llm.near import Shingler

SCHEMA = "doc_id long, text string, lang string, node long, signature int, kept boolean, component_id string, id long, hash long, row string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, None, "c", 3, 4, "r") for i, t, lang in rows], SCHEMA).repartition(3)


# -- centroids ------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]
    near_of = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near_of(v)[1]].append(v)
        centers = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if groups[n] else c for n, c in enumerate(centers)]
    told = [(i, *near_of(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, n, d in told:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, n, d in told), key=repr)


@pytest.mark.parametrize(("count", "k", "spread"), [(400, 12, 1.0), (5, 12, 1.0), (300, 40, 0.01), (1, 3, 1.0)])
def test_clusters_are_brute_force(spark, count, k, spread):
    draw = random.Random(count)
    heart = [[draw.gauss(0, 3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [draw.gauss(x, spread) for x in draw.choice(heart)]) for i in range(count)]
    rows += [(None, [1.0] * 6), (3, rows[0][1]), (1000, rows[0][1]), (1001, rows[0][1]), (1002, [float("nan")] * 6), (1003, [1.0] * 5), (1004, None), (1005, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1006, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, vector string").repartition(3)
    found = centroids.clusters(df, k=k, rounds=4, dims=6)
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == brute_clusters(rows, k, 4, 6)


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.clusters(none).collect() == []
    assert centroids.clusters(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_hold_and_spare_scans():
    draw = np.random.default_rng(5)
    heart = draw.integers(-3000, 3000, (8, 16))
    x = heart[draw.integers(0, 8, 4000)] + draw.integers(-200, 200, (4000, 16))
    before = heart + draw.integers(-50, 50, heart.shape)
    cluster, upper, lower = centroids.placed(x, before)
    scans = 0
    for _ in range(6):
        after = np.array([x[cluster == n].mean(axis=0) // 1 if (cluster == n).any() else c for n, c in enumerate(before)]).astype(np.int64)
        cluster, upper, lower, full = centroids.Moved(after, before).step(x, cluster, upper, lower)
        apart, scans, before = centroids.scan(x, after), scans + full, after
        assert (cluster == apart.argmin(axis=1)).all()
        every = np.arange(len(x))
        assert (upper**2 * (1 + 1e-6) >= apart[every, cluster]).all()
        apart[every, cluster] = np.iinfo(np.int64).max
        assert (lower**2 * (1 - 1e-6) <= apart.min(axis=1)).all()
    assert scans < len(x)


def test_ties_go_to_the_smaller_number():
    moved = centroids.Moved(np.array([[2, 0], [-2, 0], [0, 2]]), np.array([[2, 1], [-2, 0], [0, 2]]))
    x = np.array([[0, 0], [0, -4]])
    assert moved.step(x, np.array([2, 1]), np.array([2.0, 4.0]), np.array([0.0, 0.0]))[0].tolist() == [0, 0]


# -- signature join -------------------------------------------------------------------------------------------------


def brute_near(rows, percent, k=5):
    sets = []
    for i, t, _ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    low = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        low[find(x)].append(i)
    first = {r: min((i for i in ids if i is not None), default=None) for r, ids in low.items()}
    return sorted(((i, len(s), i if not s else first[find(x)], (i if not s else first[find(x)]) == i) for x, (i, s) in enumerate(sets)), key=repr)


def near_rows(seed, groups=30):
    draw, rows, n = random.Random(seed), [], 0
    for _ in range(groups):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.choice((3, 8, 40, 150, 400)))]
        for _ in range(draw.randrange(1, 6)):
            text = list(base)
            for _ in range(draw.choice((0, 0, 1, 2, 5, len(text) // 40))):
                text[draw.randrange(len(text))] = f"v{draw.randrange(5000)}"
            rows.append((n, " ".join(text), "en"))
            n += 1
    odd = [None, "", " \n", "One", "one", "a b c d e f g h\n" * 50, "é 日本 🙂 x y z", "x" * 9000]
    rows += [(n + i, t, None) for i, t in enumerate(odd)]
    rows += [rows[0], rows[0], (None, rows[1][1], "en"), (None, None, None), (None, "alone here and nowhere", "en")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_signature_join_is_brute_force(spark, seed):
    rows = near_rows(seed)
    found = minhash_join.minhash_join(table(spark, rows))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in found.collect()), key=repr) == brute_near(rows, 85)


def test_keep_smallest_keeps_the_first_of_each_group(spark):
    rows = near_rows(3, 12)
    keeps = Counter(r[0] for r in brute_near(rows, 85) if r[3] and r[0] is not None)
    found = minhash_join.keep_smallest(table(spark, rows))
    assert found.columns == SCHEMA.replace(",", "").split()[::2]
    assert Counter(r["doc_id"] for r in found.collect() if r["doc_id"] is not None) == keeps
    assert minhash_join.keep_smallest(table(spark, []).where("false")).count() == 0
    assert minhash_join.minhash_join(table(spark, []).where("false")).count() == 0


def test_signatures_within_the_distance_share_a_key(spark):
    draw, rows = np.random.default_rng(7), []
    for i in range(300):
        one = draw.integers(0, 1 << 16, minhash_join.SYMBOLS)
        two = one.copy()
        away = draw.choice(minhash_join.SYMBOLS, minhash_join.DISTANCE, replace=False)
        two[away] += 1
        rows.append((i, one.tolist(), two.tolist()))
    df = spark.createDataFrame(rows, "i int, one array<int>, two array<int>")
    from pyspark.sql import functions as F

    assert df.where(F.arrays_overlap(minhash_join.keys(F.col("one")), minhash_join.keys(F.col("two")))).count() == 300
    assert minhash_join.missed(85) < 1e-5


def test_signatures_differ_as_the_sets_do():
    draw, apart = np.random.default_rng(3), []
    for _ in range(200):
        x = near.mix(draw.integers(0, 1 << 62, 400).astype(np.uint64))
        apart.append((minhash_join.signature(x[:370]) != minhash_join.signature(x[30:])).mean())
    assert abs(np.mean(apart) - (1 - 340 / 400)) < 0.02


def test_one_signature_of_many_unlike_nodes(spark):
    """A key that all share is found without all of its rows in one task, and its bucket keeps every node."""
    rows = spark.range(5000).selectExpr("id % 2 * (id + 1) as sig", "id as node")
    found = near.shared(rows)
    assert found.where("sig = 0").count() == 2500
    assert found.select("sig", "center", "many").distinct().collect()[0][1:] == (0, 2500)


# -- phrases --------------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, top, most=5):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        some = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        left = []
        for p, a in some.items():
            if any(100 * b >= 100 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            left.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, x, y) in enumerate(sorted(left)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -score))
    return sorted(out)


def phrase_rows():
    draw, rows = random.Random(11), []
    for i in range(300):
        words = [draw.choice("the of And a be it é日 Ünd x1 🙂".split()) for _ in range(draw.randrange(0, 60))]
        at = draw.randrange(len(words) + 1)
        words[at:at] = ["new", "york", "city", "hall"][: draw.choice((0, 0, 2, 4))]
        text = "".join(w + draw.choice((" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "\x1c ", " ")) for w in words)
        rows.append((i % 250, text, draw.choice(("en", "en", "de", None, "und", ""))))
    return [*rows, (None, None, None), (1, "", "en"), (2, "only", "fr"), (3, ".,;", "en"), (4, "z " * 5000, "en")]


@pytest.mark.parametrize("full", [False, True])
def test_phrases_are_brute_force(spark, monkeypatch, full):
    """Also with a filter that is full, which lets every phrase be exploded."""
    rows = phrase_rows()
    if full:
        monkeypatch.setattr(phrases, "filter_of", lambda frequent: np.full(phrases.FILTER_BITS >> 6, 2**64 - 1, dtype=np.uint64))
    found = phrases.collocations(table(spark, rows), min_count=5, top=40)
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(rows, 5, 40)


def test_phrases_of_nothing_and_of_two_words(spark):
    assert phrases.collocations(table(spark, []).where("false")).count() == 0
    rows = phrase_rows()
    found = phrases.collocations(table(spark, rows), max_n=2, min_count=5, top=10)
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(rows, 5, 10, most=2)


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(10**12, 10**14, 10**12, 10**12)], "a long, n long, l long, r long")
    assert big.select(F.expr(phrases.SCORE)).first()[0] == 1000 * 10**12 * 10**14 // 10**24
