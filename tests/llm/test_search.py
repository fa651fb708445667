"""Decontamination, SimHash and MinHash against brute force, and their edge cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segmenta.llm import decontamination as dec
from segmenta.llm import minhash, simhash
from segmenta.llm import queries as llm_queries
from segmenta.llm import textkernel as tk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}{chr(97 + i % 26)}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def edit(rng, text, k):
    s = list(text)
    for _ in range(k):
        at = rng.randrange(len(s))
        s[at : at + 1] = rng.choice([[], ["z"], [s[at], "q"]])
    return "".join(s)


def brute_distance(item, text):
    """Least edit distance of the item to a substring, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[-1] + 1))
    return min(row)


@given(st.text("abc ", max_size=30), st.text("abc ", max_size=60))
@settings(max_examples=300, deadline=None)
def test_bit_parallel_distance(item, text):
    item, text = dec.normal(item), dec.normal(text)
    if item:
        k = len(item)
        assert dec.Item(1, item, k).least(text, k + 1) == min(k + 1, brute_distance(item, text))


def test_each_benchmark_has_its_own_matcher(spark):
    words = [f"passage number {i} of a benchmark with words enough" for i in range(12)]
    docs = frame(spark, [(i, f"before {w} after") for i, w in enumerate(words)]).repartition(8)
    for i, w in enumerate(words):
        bench = spark.createDataFrame([(i, w)], "item_id long, text string")
        assert [(r.doc_id, r.item_id) for r in dec.leaks(docs, bench).where("distance = 0").collect()] == [(i, i)]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, 12)) for i in range(12)] + [(90, None), (91, ""), (92, "  "), (None, prose(rng, 9)), (5, prose(rng, 10))]
    rows = [(0, None), (1, ""), (2, prose(rng, 40)), (2, items[0][1]), (2, items[0][1]), (None, items[1][1].upper())]
    for i in range(40):
        item = rng.choice([t for _, t in items if t and t.strip()])
        rows.append((10 + i, f"{prose(rng, rng.randrange(20))} {edit(rng, item, rng.randrange(9))}\n{prose(rng, rng.randrange(20))}"))
    rows.append((99, prose(rng, 5000) + " " + items[3][1] + " " + prose(rng, 3000)))
    docs = frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.item_id is None, r.item_id or 0, r.distance) for r in dec.leaks(docs, bench).collect())
    want = []
    for d, t in rows:
        best = {}
        for i, item in items:
            m = dec.normal(item)
            x = dec.normal(t)
            if m and x:
                k = int(len(m) * dec.ERROR_RATE)
                dist = brute_distance(m, x) if len(x) < 2000 else (0 if m in x else k + 1)
                if dist <= k:
                    best[i] = min(dist, best.get(i, dist))
        want += [(d is None, d or 0, i is None, i or 0, x) for i, x in best.items()]
    assert got == sorted(want) and len(got) > 20
    kept = dec.decontaminate(docs, bench)
    dirty = {(n, d) for n, d, *_ in want}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((d is None, d or 0) for d, t in rows if (d is None, d or 0) not in dirty or t and not any(dec.normal(i[1]) and dec.normal(i[1]) in dec.normal(t) for i in items) and (d is None, d or 0) == (False, 2))
    assert kept.columns == docs.columns
    none = bench.where("false")
    assert dec.leaks(docs, none).count() == 0 and dec.decontaminate(docs, none).count() == len(rows)
    assert dec.leaks(docs.where("false"), bench).count() == 0


def test_shards_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, prose(rng, 10)) for i in range(9)]
    docs = frame(spark, [(i, prose(rng, 9) + " " + t) for i, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, dec.leaks(docs, bench).collect()))
    monkeypatch.setattr(dec, "SHARD_CHARS", 120)
    assert sorted(map(tuple, dec.leaks(docs, bench).collect())) == whole and len(whole) == 9


def words_of(text):
    return re.findall(r"[a-z0-9\u0080-￿]+", text.lower())


def groups_of(n, near):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if near(i, j):
                root[find(i)] = find(j)
    out = {}
    for i in range(n):
        out.setdefault(find(i), set()).add(i)
    return sorted(sorted(g) for g in out.values() if len(g) > 1)


def corpus(rng):
    texts = [prose(rng, rng.choice([1, 2, 5, 40, 200])) for _ in range(60)]
    for _ in range(40):
        w = rng.choice(texts).split()
        for _ in range(rng.randrange(1 + len(w) // 25)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    return [*texts, texts[0], texts[0].upper(), "", "...", prose(rng, 6000)]


def test_simhash_groups_equal_brute_force(spark, monkeypatch):
    texts = corpus(random.Random(8))
    prints, sizes = simhash.fingerprint_column(pa.array(texts))
    dist = lambda i, j, k: int(np.bitwise_count(prints[i, k : k + 2] ^ prints[j, k : k + 2]).sum())
    near = lambda i, j: sizes[i] and sizes[j] and dist(i, j, 0) <= simhash.RADIUS and dist(i, j, 2) <= simhash.COARSE and min(sizes[i], sizes[j]) >= simhash.RATIO * max(sizes[i], sizes[j])
    want = groups_of(len(texts), near)
    docs = frame(spark, list(enumerate(texts)))
    for cell in (simhash.CELL, 7):  # the second has many cells and boundary-overlapping shards
        monkeypatch.setattr(simhash.near_pairs, "__defaults__", (simhash.RADIUS, simhash.RATIO, cell, False, simhash.COARSE))
        got = {}
        for r in simhash.near_groups(docs).collect():
            got.setdefault(r.group_id, []).append(r.doc_id)
            assert r.kept == (r.doc_id == r.group_id)
        assert sorted(sorted(g) for g in got.values()) == want and len(want) > 15
    kept = sorted(r.doc_id for r in simhash.dedup(docs).collect())
    gone = {i for g in want for i in g[1:]}
    assert kept == [i for i in range(len(texts)) if i not in gone]


def test_tree_finds_all_pairs_and_prunes():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    near = np.repeat(base, 60, axis=0) ^ (np.uint64(1) << rng.integers(0, 63, (2400, 4), dtype=np.uint64))
    a, b = near[:900], near[600:]
    work: list[int] = []
    i, j, d = simhash.tree_pairs(a, b, 6, 3, 64, work)
    full = np.bitwise_count(a[:, None, :] ^ b[None, :, :])
    fine, coarse = full[:, :, :2].sum(axis=2), full[:, :, 2:].sum(axis=2)
    assert sorted(zip(i.tolist(), j.tolist(), d.tolist(), strict=True)) == [(x, y, int(fine[x, y])) for x, y in np.argwhere((fine <= 6) & (coarse <= 3)).tolist()]
    assert sum(work) < 0.3 * len(a) * len(b)


def test_minhash_recall_and_precision(spark, monkeypatch):
    rng = random.Random(12)
    texts = corpus(rng)
    for _ in range(60):
        w = prose(rng, 120).split()
        v = list(w)
        for _ in range(rng.randrange(4)):
            v[rng.randrange(len(v))] = "changed"
        texts += [" ".join(w), " ".join(v)]

    def shingles(t):
        w = words_of(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    sim = lambda i, j: len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
    close = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and sim(i, j) >= 0.7]
    docs = frame(spark, list(enumerate(texts)))
    for cell in (8_000_000, 900):  # the second compares components band by band, and bands in parts
        monkeypatch.setattr(minhash, "CELL", cell)
        group = {r.doc_id: r.group_id for r in minhash.similar_groups(docs).collect()}
        hits = sum(i in group and group.get(i) == group.get(j) for i, j in close)
        assert hits >= 0.9 * len(close) and len(close) > 40
        exact = groups_of(len(texts), lambda i, j: (i, j) in set(close))
        top = {i: k for k, g in enumerate(exact) for i in g}
        for d, g in group.items():
            assert top[d] == top[g]  # nothing is joined that brute force keeps apart


def test_minhash_gives_every_pair(spark, monkeypatch):
    rng = random.Random(31)
    base = prose(rng, 200).split()
    texts = [prose(rng, 150) for _ in range(20)]
    for k in (0, 0, 1, 2, 2, 3, 4, 5):  # each is similar to the others, in different degrees
        w = list(base)
        for at in rng.sample(range(len(w)), k):
            w[at] = rng.choice(WORDS)
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    sim = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    close = {(i, j): sim(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and sim(i, j) >= 0.7}
    seen = []
    for cell in (8_000_000, 900):  # the second compares components band by band, and bands in parts
        monkeypatch.setattr(minhash, "CELL", cell)
        rows = minhash.similar_groups(frame(spark, list(enumerate(texts)))).collect()
        of = {}
        for r in rows:
            of.setdefault(r.set_id, []).append(r.doc_id)
        got = {}
        for r in rows:
            assert (r.partners is None) == (r.doc_id != min(of[r.set_id]))
            got |= {(i, j): 1.0 for i in of[r.set_id] for j in of[r.set_id] if i != j}
            got |= {(i, j): p.jaccard for p in r.partners or [] for i in of[r.set_id] for j in of[p.set_id]}
        assert got.keys() <= close.keys() and len(got) >= 0.9 * len(close) and len(close) > 40
        assert all(abs(s - close[pair]) < 1e-6 for pair, s in got.items())
        assert all(r.jaccard == max(s for (i, _), s in got.items() if i == r.doc_id) for r in rows)
        seen.append(got)
    assert seen[0] == seen[1]  # the size of parts changes nothing


def test_minhash_query_finds_planted_edits(spark, tmp_path):
    rng = random.Random(77)
    rows, planted = [], []
    for n, edits in [(70, 3), (176, 7), (584, 24), (120, 6)] * 15:  # the first three as in the test tables, Jaccard 0.65 to 0.69
        w = prose(rng, n).split()
        v = list(w)
        for at in rng.sample(range(n), edits):
            v[at] = f"edited{len(rows)}x{at}"
        planted.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    group = {r.doc_id: r.group_id for r in llm_queries.op7_minhash(spark, str(tmp_path)).collect()}
    assert sum(i in group and group[i] == group.get(j) for i, j in planted) >= 0.9 * len(planted)
    assert all(g == d - d % 2 for d, g in group.items())


def test_edge_cases_of_fingerprints(spark):
    rows = [(1, "same words here"), (1, "same words here"), (None, "same words here"), (2, None), (3, ""), (4, "?!"), (5, "é" * 30_000), (6, "é" * 30_000)]
    docs = frame(spark, rows).withColumn("set", F.lit("x")).withColumn("rk", F.lit(0)).withColumn("node", F.lit(0)).withColumn("root", F.lit(0))
    for r in minhash.similar_groups(docs).collect():
        assert (r.group_id, r.group_size) in {(1, 3), (5, 2)} and r.jaccard == 1.0
    got = simhash.near_groups(docs).collect()
    assert sorted((r.group_id, r.group_size, r.kept) for r in got) == [(1, 3, False), (1, 3, False), (1, 3, True), (5, 2, False), (5, 2, True)]
    kept = simhash.dedup(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, i) for i in (1, 2, 3, 4, 5)]
    empty = docs.where("false")
    assert minhash.similar_groups(empty).count() == simhash.near_groups(empty).count() == simhash.dedup(empty).count() == 0


def test_words_are_hashed_whole():
    def of(texts):
        body, offs = tk.raw(pa.array(texts))
        h, n = tk.words(body, offs)
        return np.split(h, np.cumsum(n)[:-1])

    a = of(["One two", None, "", "two one", "ONE", "Été été", "x-y"])
    assert a[0][0] == a[3][1] == a[4][0] and a[0][1] == a[3][0] and len(a[1]) == len(a[2]) == 0 and a[5][0] == a[5][1] and len(a[6]) == 2
    assert len(set(np.concatenate(of([f"w{i}" for i in range(5000)])).tolist())) == 5000


@pytest.mark.parametrize("size", [1, 3, 5])
def test_shingle_counts(size):
    body, offs = tk.raw(pa.array(["a b c d", "", "a", "a b"]))
    _, n = tk.shingles(*tk.words(body, offs), size)
    assert n.tolist() == [max(1, 4 - size + 1), 0, 1, max(1, 2 - size + 1)]
