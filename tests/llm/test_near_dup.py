"""Near-duplicate documents and repeated passages against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from anamnesis.llm.minhash import near_duplicates, superminhash
from anamnesis.llm import passages as P
from anamnesis.llm.passages import repeated_passages

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, component_id string, node string"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def shingles(text, width):
    w = words(text)
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(w)


def corpus():
    """A hot group of exact copies, one of edited copies in which many pairs are no near duplicates, and others."""
    rng = random.Random(7)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    rows, base = [], text(150)
    rows += [(i, base) for i in range(40)]
    rows += [(100 + i, edited(rng, base, rng.randrange(12))) for i in range(90)]
    rows += [(300 + i, text(rng.randrange(1, 60))) for i in range(80)]
    rows += [(400, ""), (401, None), (402, "one"), (403, "ONE"), (404, "one two"), (405, " \t\n"), (406, "x " * 30000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, width, percent):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width=width, percent=percent).collect()}
    assert got == brute(rows, width, percent)


def test_edge_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in near_duplicates(df, width=3, percent=85).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, False), (3, 0, 3, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_an_id_with_several_texts_is_linked_by_each(spark):
    rng = random.Random(11)
    a, b, c = (" ".join(f"w{rng.randrange(10 ** 5)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a), (1, b), (2, edited(rng, a, 1)), (3, edited(rng, b, 1)), (4, c), (4, edited(rng, a, 1)), (5, c), (6, ""),
            (6, edited(rng, c, 1)), (7, b), (8, "alone at last")]
    want = {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 8}
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = near_duplicates(frame(spark, rows).repartition(seed), width=3, percent=85).collect()
        assert {r.doc_id: r.component_id for r in got if r.n_shingles} == want
        assert [(r.component_id, r.kept) for r in got if not r.n_shingles] == [(6, True)]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    common, left, right = (rng.integers(0, 2 ** 63, n, dtype=np.uint64) for n in (300, 100, 100))
    values = np.concatenate([common, left, common, right])
    row = np.repeat([0, 1], 400)
    made = superminhash(values, row, 2, 252)
    assert abs((made[0] == made[1]).mean() - 300 / 500) < 0.12
    few = superminhash(values[:3], np.zeros(3, np.int64), 1, 252)
    assert (few < np.iinfo(np.uint64).max).all()


def brute_passages(rows, size=50):
    seen, out = {}, set()
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            if seen.setdefault(key, i) != i:
                out |= {i, seen[key]}
    return out


def test_passages_of_fifty_words_are_found(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    shared, other, near = text(60), text(55), text(120)
    rows = [(i, f"{text(rng.randrange(0, 80))} {shared} {text(30)}") for i in range(40)]
    rows += [(100 + i, f"{text(20)} {other} {text(20)} {shared}") for i in range(3)]
    rows += [(200, near), (201, edited(rng, near, 2)), (210, shared.upper())]
    rows += [(300 + i, text(rng.randrange(1, 200))) for i in range(30)] + [(400, None), (401, ""), (402, "x " * 500)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = repeated_passages(df).collect()
    found = {r.doc_id for r in got}
    assert brute_passages(rows) <= found
    assert found == brute_passages(rows) | {200, 201}
    by_doc = {r.doc_id: r for r in got if r.doc_id < 40}
    assert len({r.class_id for r in by_doc.values()}) == 1
    full = dict(rows)
    for r in by_doc.values():
        assert " ".join(shared.split()) in " ".join(words(full[r.doc_id])[r.start_word:r.end_word])


def test_passages_of_an_empty_table(spark):
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def similar_windows(a, b, size=50, width=5, percent=80):
    """Whether two texts hold windows of `size` words that are similar enough."""
    one, two = words(a), words(b)
    sets = [shingles(" ".join(two[k:k + size]), width) for k in range(len(two) - size + 1)]
    for i in range(len(one) - size + 1):
        own = shingles(" ".join(one[i:i + size]), width)
        if any(100 * len(own & s) >= percent * len(own | s) for s in sets):
            return True
    return False


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def test_edited_passages_of_fifty_and_sixty_words_always_meet(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(f"v{rng.randrange(9000)}" for _ in range(n))
    rows, expected = [], set()
    for n in range(120):
        base = text(50 if n % 2 else 60)
        a, b = (f"{text(40)} {t} {text(40)}" for t in (base, edited(rng, base, 1)))
        rows += [(2 * n, a), (2 * n + 1, b)]
        if similar_windows(a, b):
            expected |= {2 * n, 2 * n + 1}
    assert len(expected) > 150
    got = {r.doc_id: r.class_id for r in repeated_passages(frame(spark, rows)).collect()}
    assert expected == set(got)
    assert all(got[i] == i - i % 2 for i in got)


def test_passages_settled_with_a_leader_still_meet_the_others(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(f"v{rng.randrange(9000)}" for _ in range(n))
    rows = []
    for n in range(40):  # the first and the third share 46 words, the second holds 60 words of either
        base = text(75).split()
        parts = (base[:60], base, base[14:])
        rows += [(3 * n + i, f"{text(30)} {' '.join(part)} {text(30)}") for i, part in enumerate(parts)]
    got = {r.doc_id: r.class_id for r in repeated_passages(frame(spark, rows)).collect()}
    assert got == {i: i - i % 3 for i, _ in rows}


def test_second_copy_of_a_passage_in_one_text_has_a_row(spark):
    rng = random.Random(13)
    text = lambda n: " ".join(f"v{rng.randrange(9000)}" for _ in range(n))
    rows = []
    for n in range(20):
        base = text(70)
        line = " ".join(base.split()[20:45])  # a part of the passage comes alone before it
        rows += [(2 * n, f"{text(30)} {base} {text(40)} {base} {text(30)}"),
                 (2 * n + 1, f"{text(30)} {line} {text(30)} {base} {text(30)}")]
    got = repeated_passages(frame(spark, rows)).collect()
    full = dict(rows)
    held = {i: 0 for i in full}
    for r in got:
        passage = full[r.doc_id].split()[r.start_word:r.end_word]
        held[r.doc_id] += " ".join(full[r.doc_id - r.doc_id % 2].split()[30:100]) in " ".join(passage)
    assert held == {i: 2 - i % 2 for i in full}


def test_similar_passage_in_a_loosely_edited_copy_is_found(spark):
    rng = random.Random(14)
    text = lambda n: " ".join(f"v{rng.randrange(9000)}" for _ in range(n))
    rows = []
    for n in range(20):
        one = text(220).split()
        two = [f"c{n}x{k}" if k % 6 == 0 and not 80 <= k < 140 else w for k, w in enumerate(one)]
        two[110] = f"c{n}y"
        rows += [(2 * n, " ".join(one)), (2 * n + 1, " ".join(two))]
    got = repeated_passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(i, i - i % 2) for i, _ in rows}
    assert all(r.start_word <= 85 and r.end_word >= 135 for r in got)


def pair(a, b, seeds=((), ())):
    texts = [P.Text(np.array(t, np.uint64), np.array([p for p, _ in x], np.int64), np.array([k for _, k in x], np.uint64))
             for t, x in zip((a, b), seeds)]
    return P.Pair(*texts, 4, 60)


def test_ranges_are_compared_on_sets_of_tokens(monkeypatch):
    """Numbered once: no sort for each range, as a text of short period has very many of them."""
    rng = random.Random(11)
    for _ in range(60):
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        with monkeypatch.context() as m:
            for name in ("unique", "intersect1d", "isin"):
                m.setattr(P.np, name, None)
            two = pair(a, b)
            for _ in range(20):
                s, t = rng.randrange(len(a)), rng.randrange(len(b))
                e, f = rng.randint(s, len(a)), rng.randint(t, len(b))
                one, other = set(a[s:e]), set(b[t:f])
                want = min(e - s, f - t) >= 4 and 100 * len(one & other) >= 60 * len(one | other)
                assert two.similar(s, e, t, f) == want
                assert two._held(two.one_number[s:e], two.two_number[t:f]).tolist() == [x in other for x in a[s:e]]


def test_the_nearest_run_over_a_gap_is_found_once(monkeypatch):
    rng = random.Random(12)
    for _ in range(100):
        a, b = ([rng.randrange(30) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        two = pair(a, b)
        x, y = rng.randint(0, len(a)), rng.randint(0, len(b))
        ahead = [(i + j, i, j) for i, p in enumerate(a[x:x + P.GAP + 1]) for j, q in enumerate(b[y:y + P.GAP + 1]) if p == q]
        got = two._next(x, y, True)
        if ahead:
            _, i, j = min(ahead)
            assert got == (x + i, y + j, two._run(x + i, y + j))
        else:
            assert got is None
        monkeypatch.setattr(two, "_run", None)
        assert two._next(x, y, True) == got


def test_texts_of_short_period_without_similar_ranges():
    a, b = [1, 2, 3, 4, 5, 6, 7, 8] * 30, ([1, 2, 3, 4] + [90, 91, 92, 93, 94, 95]) * 25
    seeds = [[(p, t) for p, t in enumerate(x) if t == 1] for x in (a, b)]
    two = pair(a, b, seeds)
    calls, real = [], two._search
    two._search = lambda *at: calls.append(at) or real(*at)
    two.passages()
    assert len(calls) == len(set(calls))


def test_scores_rule_out_no_passage():
    rng = random.Random(15)
    found = 0
    for n in range(150):
        base = [rng.randrange(12 if n % 3 == 0 else 400) for _ in range(rng.randrange(10, 60))]
        other = [rng.randrange(400) if rng.random() < 0.08 else x for x in base if rng.random() > 0.03]
        a, b = base + [rng.randrange(400) for _ in range(9)], [rng.randrange(400) for _ in range(9)] + other
        common = set(a) & set(b)
        two = pair(a, b, [[(p, t) for p, t in enumerate(x) if t in common] for x in (a, b)])
        scores = []
        for x, y in ((a, b), (b, a)):
            held, again = np.isin(x, y)[:, None], np.array([t in x[:p] for p, t in enumerate(x)])
            scores.append(P._scores(held, again, np.arange(len(x)), 4, 60)[:, 0])
        for s, e, t, f in two.passages():
            assert scores[0][s:e].min() + scores[1][t:f].min() >= 0
            found += 1
    assert found > 50


def test_texts_alike_in_short_stretches_are_not_compared_in_whole(monkeypatch):
    """Many texts with one line in common and half of the words around it, but no similar passage."""
    rng = random.Random(16)
    base = [f"v{k}" for k in range(400)]
    texts = [" ".join(w if k // 20 % 2 == 0 or 200 <= k < 226 else f"c{n}x{k}" for k, w in enumerate(base)) for n in range(40)]
    run_tokens, _ = P.shared_run(5, 46, 80)
    keys = [sorted(set(text.key.view(np.int64).tolist())) for _, text in P._texts(P.pa.array(texts), 5, run_tokens)]
    assert set(keys[0]) & set(keys[1])
    rows = P.pa.RecordBatch.from_pylist([{"leader": 0, "cluster": 0, "low": 0, "high": 0, "doc_id": n, "block": 0, "spans": None,
                                          "keys": own, "text": text} for n, (own, text) in enumerate(zip(keys, texts))])
    made, real = [], P.Pair
    monkeypatch.setattr(P, "Pair", lambda *at: made.append(at) or real(*at))
    run, _ = P._block_links(5, 46, 80)
    assert sum(batch.num_rows for batch in run(iter([rows]))) == 0
    assert len(made) == 0


def test_large_groups_of_one_seed_are_joined(spark, monkeypatch):
    """Texts with a line of 30 words; within three groups of 20 they share 70 words round it, but not with the first text."""
    monkeypatch.setattr(P, "BLOCK_TEXTS", 16)
    rng = random.Random(17)
    text = lambda n: " ".join(f"v{rng.randrange(9000)}" for _ in range(n))
    line, rows = text(30), []
    rows.append((0, f"{text(60)} {line} {text(60)}"))
    for group in range(3):
        before, after = text(20), text(20)
        rows += [(1 + 20 * group + n, f"{text(50)} {before} {line} {after} {text(50)}") for n in range(20)]
    got = {r.doc_id: r.class_id for r in repeated_passages(frame(spark, rows)).collect()}
    assert got == {i: 1 + (i - 1) // 20 * 20 for i, _ in rows if i}
