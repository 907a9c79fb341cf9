"""Centroid clustering, quality rules and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from anamnesis.llm.clusters import CentroidLists, cluster_vectors
from anamnesis.llm.quality import quality_rules, text_statistics
from anamnesis.llm.variants import count_words, crc32_of_ranges, deal_parts, near_words, roots, signatures, spelling_variants

WORD = r"[^\x20\x09-\x0D]+"
LOWER = {i: i + 32 for i in range(65, 91)}


# Clusters -------------------------------------------------------------------------------------

def plain_clusters(rows, clusters, rounds, factor):
    kept = [(i, [int(np.floor(x * factor)) for x in v]) for i, v in rows]
    draw = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))
    centroids = [v for _, v in draw[:clusters]]

    def assign():
        distance = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in kept]
        return [(min(range(len(d)), key=lambda c: (d[c], c)), min(d)) for d in distance]

    for _ in range(rounds):
        mine = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (n, _) in zip(kept, mine) if n == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    mine = assign()
    total = Counter()
    for c, d in mine:
        total[c] += d
    return sorted(((i, c, d, total[c], sum(total.values()),
                    hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                   for (i, _), (c, d) in zip(kept, mine)), key=repr)


@pytest.mark.parametrize("scale", [0.02, 1.0, 5e6])
def test_clusters_equal_a_plain_loop(spark, scale):
    rng = random.Random(int(scale * 100))
    rows = [(i, [rng.choice((-1, 0, 1)) * scale + rng.random() * scale for _ in range(4)]) for i in range(60 if scale < 9 else 12)]
    rows += [(7, rows[3][1]), (7, rows[7][1]), (None, rows[9][1]), (100, rows[9][1])]
    odd = [(200, None), (201, [1.0, 2.0, 3.0]), (202, [1.0, None, 2.0, 3.0]), (203, [1.0, float("nan"), 2.0, 3.0]),
           (204, [1.0, float("inf"), 2.0, 3.0]), (205, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd],
                               "vec_id long, embedding array<double>, cluster int, distance int")
    got = sorted((tuple(r) for r in cluster_vectors(df.repartition(3), 5, 3, 4).collect()), key=repr)
    assert got == plain_clusters(rows, 5, 3, 64)


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert cluster_vectors(spark.createDataFrame([], schema)).count() == 0
    assert cluster_vectors(spark.createDataFrame([(None, [1.0, 2.0])], schema), dims=2).count() == 0
    got = cluster_vectors(spark.createDataFrame([(3, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [9.0, 2.0])], schema), dims=2)
    assert {r.distance for r in got.collect()} == {0} and got.count() == 3
    with pytest.raises(Exception, match="[Ii]nt|overflow|large"):
        cluster_vectors(spark.createDataFrame([(3, [1e300, 2.0]), (4, [-1e300, 2.0])], schema.replace("float", "double")),
                        1, dims=2).collect()


def test_walk_stops_early_and_is_exact():
    rng = np.random.RandomState(3)
    for _ in range(60):
        k, dims, rows, span = rng.randint(1, 30), rng.randint(1, 7), rng.randint(1, 50), rng.choice([2, 6, 1000])
        c, x = rng.randint(-span, span, (k, dims)), rng.randint(-span, span, (rows, dims))
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        cluster, distance = CentroidLists(c).nearest(x)
        assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


# Quality --------------------------------------------------------------------------------------

def plain_base(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    marked = {i + s for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for s in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))


def quality_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéio") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 120))]
        bad = i % 7 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + "%%%" for w in words]
        lines = [" ".join(words[j:j + 20]) for j in range(0, len(words), 20)]
        docs.append((i, ("\r\n" if i % 3 else "\n").join(lines + lines[:i % 2])))
        if i % 5:
            labels.append((i, 0 if bad else 1, 1))
    return docs, labels


def test_base_counts_equal_plain_ones_and_odd_texts_are_refused(spark):
    docs, labels = quality_rows()
    rng = random.Random(6)
    odd = [None, "", " \t\n", "one", "a b a b a b", "x " * 60, "ü ü \x85 \n\n \nx\nx\r\nx\n", "a\vb\fc\x1cd",
           "\n".join(["same line here"] * 30), "w" * 300_000, " ".join(rng.choice("abcdefgh") for _ in range(60_000))]
    extra = [(1000 + i, x) for i, x in enumerate(odd)] + [(None, docs[1][1]), (1, docs[1][1]), (1, docs[2][1])]
    df = spark.createDataFrame([(i, x, 9, True) for i, x in docs + extra], "doc_id long, text string, n_words int, kept boolean")
    marks = spark.createDataFrame(labels + [(1, 1, 1), (None, 0, 1), (9999, 0, 1), (3, None, 1), (4, 7, 1)],
                                  "doc_id long, quality int, n_words int")
    got = quality_rules(df.repartition(3), marks).collect()
    want = Counter()
    for i, x in docs + extra:
        base = plain_base(x)
        want[(i, *base, base[0] < 50 or 100 * base[4] > 50 * base[0])] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    clean = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 7 and not r.base_failed]
    bad = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 7 == 0]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)  # a fifth of them carries no label
    again = {(r.doc_id, r.kept, r.normality) for r in quality_rules(df.repartition(5), marks).collect()}
    assert again == {(r.doc_id, r.kept, r.normality) for r in got}


def test_quality_without_labels_or_rows(spark):
    docs, labels = quality_rows()
    df = spark.createDataFrame(docs[:40], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed and r.normality is None for r in quality_rules(df, none).collect())
    good = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in quality_rules(df, good).collect())
    bad = spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in quality_rules(df, bad).collect())
    assert quality_rules(df.limit(0), good).count() == 0


def test_statistics_are_shares():
    base, made = text_statistics(np.frombuffer(b"Ab! 12 | x", np.uint8), np.array([0, 10, 10]))
    assert base.tolist() == [[4, 7, 1, 0, 0], [0, 0, 0, 0, 0]]
    assert made[0].tolist()[:2] == [1.75, 0.25] and made[1].tolist() == [0.0] * made.shape[1]


# Spelling -------------------------------------------------------------------------------------

def edits_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(docs, shortest, least, misspelt):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % misspelt == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [x for x in words if edits_one(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


def test_variants_equal_brute_force(spark):
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcÀéÿ×") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    docs = []
    for i in range(200):
        words = []
        for _ in range(60):
            w = rng.choice(stems[:10] if rng.random() < 0.6 else stems)
            at, kind = rng.randrange(len(w)), rng.random()
            if kind < 0.08:
                w = w[:at] + w[at + 1:]
            elif kind < 0.16:
                w = w[:at] + rng.choice("abcéñ") + w[at:]
            elif kind < 0.24:
                w = w[:at] + rng.choice("abcéñ") + w[at + 1:]
            words.append(rng.choice((w, w.upper(), w.capitalize())))
        docs.append((i - 3, rng.choice((" ", "_", "1", "Ā", "ß, ")).join(words)))
    docs += [(500, None), (501, ""), (502, "ab " * 5000 + "aabbcc " * 5000), (None, "aabbcd aabbcd aabbcd Aabbcd"),
             (3, docs[4][1]), (503, "z" * 5000 + " " + "z" * 5001 + " " + "z" * 5000)] + [(504 + i, "z" * 5001) for i in range(3)]
    df = spark.createDataFrame([(i, x, "w", 1) for i, x in docs], "doc_id long, text string, word string, n int")
    for shortest, least, misspelt in ((5, 3, 97), (1, 1, 3)):
        if shortest == 1:
            docs = docs[:40]
            df = df.where("doc_id < 37 and doc_id <> 3 or doc_id = 3 and text <> '" + docs[7][1].replace("'", "") + "'").limit(0) \
                .union(spark.createDataFrame([(i, x, "w", 1) for i, x in docs], df.schema))
        got = sorted((tuple(r) for r in spelling_variants(df.repartition(3), shortest, least, misspelt).collect()), key=repr)
        assert got == plain_variants(docs, shortest, least, misspelt)
    assert spelling_variants(df.limit(0)).count() == 0


def test_hot_word_and_repeated_rows(spark):
    words = [("abcde", 100)] + [("abcd" + x, 40 if x == "f" else 3) for x in "fghijklmnop"] + [("abcdef", 300), ("zzzzz", 9)]
    got = {(r.word, r.other) for r in near_words(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {(a, b) for a, _ in words for b, _ in words if edits_one(a, b)}


def test_signatures_of_every_near_pair_meet():
    rng = random.Random(8)
    for _ in range(400):
        a = "".join(rng.choice("aabcé") for _ in range(rng.randrange(1, 14)))
        at = rng.randrange(len(a))
        b = rng.choice((a[:at] + a[at + 1:], a[:at] + rng.choice("abcd") + a[at:], a[:at] + rng.choice("abcdé") + a[at + 1:]))
        if not b or not edits_one(a, b):
            continue
        short, long = sorted((a, b), key=lambda x: (len(x), x))
        part_of = deal_parts([((ord(c) << 3) | k, rng.randrange(9)) for c in "abcdé" for k in range(8)], 9, 4)
        left, _ = signatures([short], part_of, 4, False)
        right, _ = signatures([long], part_of, 4, True)
        assert set(left.tolist()) & set(right.tolist())


def test_crc_counts_and_roots(spark):
    data = np.frombuffer("doc12:ab".encode() + b"q" * 500, np.uint8)
    start, end = np.array([0, 3, 6, 8, 8]), np.array([3, 8, 8, 508, 9])
    before = np.array([zlib.crc32(b"7:")] * 5, dtype=np.uint32)
    assert crc32_of_ranges(data, start, end, before).tolist() == \
        [zlib.crc32(b"7:" + data[a:b].tobytes()) for a, b in zip(start, end)]
    df = spark.createDataFrame([(1, "Word word WORD wörd wörd", "x")], "doc_id long, text string, n string")
    assert {(r.word, r.n) for r in count_words(df, 4, 2, 1 << 30).collect()} == {("word", 3), ("wörd", 2)}
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "word string, form string")
    assert {r.root for r in roots(chain).collect()} == {"w9"}


def test_no_side_of_the_variants_is_broadcast_by_the_size_of_its_words(spark, monkeypatch):
    from anamnesis.llm import variants as V

    plans = []
    monkeypatch.setattr(V, "cut_lineage", lambda df, real=V.cut_lineage: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or real(df))
    docs = spark.createDataFrame([(1, "abcde abcde abcde abcdef abcdef abcdef abcdef abcdef abcdef abcdef")], "doc_id long, text string")
    found = spelling_variants(docs)
    assert {(r.word, r.form) for r in found.collect()} == {("abcde", "abcdef"), ("abcdef", None)}
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    met = [p for p in plans if "levenshtein" in p] + plans[-1:]
    assert len(met) == 2 and not any("BroadcastHashJoin" in p for p in met)
