"""SimHash groups, leaks and top-k against brute force, and their odd cases."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from chartspan.llm import decontaminate, mtree, neardup, simhash
from chartspan.llm.graph import connected_components


def brute_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(values, far=2):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(set(values))
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= far:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 120)] + [(500, 600), (600, 600), (500, 600), (700, None)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 121)} | {500: 500, 600: 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_query(spark, sf):
    from chartspan.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_print(r.text) for r in docs}
    groups = brute_groups(list(prints.values()))
    least = {}
    for i, p in prints.items():
        least[groups[p]] = min(i, least.get(groups[p], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash_near_dedup"](spark, sf).collect()}
    assert got == {i: (f"{p:016x}", least[groups[p]]) for i, p in prints.items()}


def test_links_of_dense_lists(spark):
    """Many fingerprints within two bytes of one another are linked exactly."""
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << rng.randrange(16) for _ in range(rng.randrange(6))) for _ in range(300)}
    values |= {rng.getrandbits(64) for _ in range(50)}
    values = [v & (1 << 64) - 1 for v in values]
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long")).collect()
    unsigned = [(a % (1 << 64), b % (1 << 64)) for a, b in links]
    want = brute_groups(values)
    assert all(want[a] == want[b] for a, b in unsigned)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in unsigned:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert len({find(v) for v in values}) == len(set(want.values()))


def test_simhash_odd(spark, odd_docs, no_docs):
    groups = simhash.simhash_groups(odd_docs).collect()
    assert len(groups) == odd_docs.count()
    by_id = {g.doc_id: g for g in groups}
    assert by_id[2].component_id == 1 and by_id[3].fp == by_id[4].fp == by_id[5].fp == 0
    assert by_id[4].component_id == 3
    kept = simhash.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 8, 9] and ids.count(None) == 1
    assert simhash.simhash_groups(no_docs).count() == 0 and simhash.drop_near_copies(no_docs).count() == 0


def brute_near(rows, width=5, threshold=0.8):
    """Ids left of ``(id, text)`` when every group linked by the Jaccard similarity keeps its least."""
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if i < j and (a == b or len(a & b) >= threshold * len(a | b) - 1e-9):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in sets})


def test_near_copies_by_jaccard(spark, sf):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    for i in range(150):  # around the threshold, and a chain whose ends are far apart
        words = list(base)
        for k in rng.sample(range(300), rng.randrange(1, 12)):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, " ".join(f"c{k}" for k in range(10 * i, 10 * i + 200))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows)
    assert sorted(r.doc_id for r in neardup.drop_near_copies(docs).collect()) == want
    assert len(want) < len({r.component_id for r in simhash.simhash_groups(docs).collect()})


def test_repeated_ids_lose_no_text(spark):
    """An id that is repeated with another text names two documents."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "uno dos tres cuatro cinco seis siete")
    rows = [(3, a, 1), (5, b, 2), (5, a, 3), (None, b, 4), (None, c, 5), (None, c, 5), (7, None, 6), (3, a, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash int")
    for module in (neardup, simhash):
        kept = [(r.doc_id, r.text) for r in module.drop_near_copies(docs).collect()]
        assert sorted(kept, key=repr) == sorted([(3, a), (5, b), (None, c), (7, None)], key=repr)


def test_rows_repeated_in_full_stay_once(spark):
    a, b = "one two three four five six seven", "other words that stand alone in this table"
    docs = spark.createDataFrame([(3, a, 1), (3, a, 1), (3, a, 2), (5, b, 1), (None, b, 1), (None, "a third text of some words", None),
                                  (None, "a third text of some words", None)], "doc_id long, text string, hash int")
    got = sorted((r.doc_id or 0, r.text, r.hash or 0) for r in neardup.drop_near_copies(docs).collect())
    assert [(i, t) for i, t, _ in got] == [(0, "a third text of some words"), (3, a), (5, b)] and got[1][2] in (1, 2)


def test_template_family_is_not_compared_in_full(spark):
    """2,000 texts of one template, pairwise about 0.6 alike: all stay, and few pairs are met."""
    rng = random.Random(6)
    base = [f"t{k}" for k in range(200)]
    rows = [(i, " ".join(base[:150] + [f"u{rng.randrange(10**9)}" for _ in range(50)])) for i in range(2000)]
    rows += [(5000 + i, rows[i][1] + " end") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    slim = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(
        neardup._prefixes(neardup.rarity(docs)), neardup._SKETCHED).cache()
    met = []
    verified = neardup._verified
    neardup._verified = lambda pairs, sets: met.append(pairs.count()) or verified(pairs, sets)
    try:
        assert neardup.near_links(slim, docs).count() == 20
    finally:
        neardup._verified = verified
    assert sum(met) < 100
    assert sorted(r.doc_id for r in neardup.drop_near_copies(docs).collect()) == list(range(2000))


def test_any_order_finds_all(spark, monkeypatch):
    """With one counter the order is no better than chance; only the work may differ."""
    monkeypatch.setattr(neardup, "SKETCH", neardup.PART_OF)
    monkeypatch.setattr(neardup, "PART_OF", 1 << 15)
    monkeypatch.setattr(neardup, "STARS", 1)
    rng = random.Random(8)
    rows = []
    for f in range(6):
        base = [f"f{f}w{k}" for k in range(60 + 40 * f)]
        for i in range(25):
            words = list(base)
            for k in rng.sample(range(len(base)), rng.randrange(len(base) // 15)):
                words[k] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.drop_near_copies(docs).collect()) == brute_near(rows)


def test_near_copies_stage(spark, sf):
    """Natural near copies, 7 and 11 bits apart, leave the pipeline."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).select("doc_id").collect()}
    assert {1, 6} <= left and not {177, 145} & left
    assert sorted(left) == brute_near([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_near_copies_odd(spark, odd_docs, no_docs):
    kept = neardup.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 8, 9] and ids.count(None) == 1
    assert neardup.drop_near_copies(no_docs).count() == 0


def brute_leaks(docs, items, width=5, threshold=0.8):
    def shingles(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        return {" ".join(words[i:i + width]) for i in range(len(words) - width + 1)} or ({" ".join(words)} if words else set())

    own = [(i, shingles(t)) for i, t in docs]
    asked = [(i, shingles(t)) for i, t in items]
    return {(d, i) for d, s in own for i, q in asked if q and len(q & s) >= threshold * len(q) - 1e-9}


def test_leaks_both_ways(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_leaks(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert want
    for bound in (1_000_000, 0):
        got = decontaminate.leaks(docs, items, broadcast_rows=bound).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want


def test_leaks_odd(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "word1 and word2 and word3 and word4 and word5", "x"), (2, None, "y"), (3, "", "z"), (4, "Plain", None),
         (None, "a text of a row without an id that is its own", None), (5, "of a clean text that says something else", None)],
        "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd_docs, items).collect()}
    assert got == {(6, 1), (7, 1), (None, None)}
    left = decontaminate.drop_leaked(odd_docs, items)
    assert left.columns == odd_docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 1, 2, 3, 4, 5, 8, 9]
    assert decontaminate.drop_leaked(odd_docs, items, broadcast_rows=0).count() == left.count()
    assert decontaminate.leaks(no_docs, items).count() == 0
    assert decontaminate.drop_leaked(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).round(1)
    x[:200] = x[0]
    rows = [(int(i), [float(c) for c in v], "e") for i, v in enumerate(x)]
    odd = [(1000, None, "e"), (1001, [1.0, None], "e"), (1050, [float("nan")] * 8, "e"), (1100, [float("inf")] * 8, "e"),
           (None, [1.0] * 8, "e"), (1150, [2.0, 3.0], "e"), (1151, [1.0, 1.0], "e"), (50, rows[50][1], "e")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, v string")
    vectors = mtree.quantised(frame)
    got = mtree.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5).collect()
    data = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows + odd
            if i is not None and i not in (1000, 1001, 1050, 1100)]
    want = []
    for i, v in {i: v for i, v in data if i % 50 == 0}.items():
        scores = sorted((-int(v @ w), j) for j, w in data if j != i and len(w) == len(v))[:5]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert mtree.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_quantised_floors(spark):
    one = spark.createDataFrame([(1, [-0.001, 0.5, 1.999], 0)], "vec_id long, embedding array<float>, label int")
    assert mtree.quantised(one).first().v == [-1, 128, 511]
    assert mtree.quantised(one.where(F.lit(False))).count() == 0
