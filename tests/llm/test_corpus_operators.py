"""Mixing, URL rules and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from chartspan.llm import mixing, urlfilter


def compare(spark, sf, name):
    import duckdb

    from chartspan.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    found = con.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    exact = lambda v: f"{v:.9g}" if isinstance(v, float) else v
    want = sorted((tuple(exact(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(exact(r[c]) for c in columns) for r in frame.collect()), key=repr) == want


@pytest.mark.parametrize("name", ["op3_source_mixing", "op4_benchmark_decontamination", "op5_license_scan", "op7_exact_top_k", "op9_url_filter"])
def test_against_sql(spark, sf, name):
    compare(spark, sf, name)


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, left, out = set(), share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        total = sum(weight[s] for s in rest)
        out = {s: most * sizes[s] if s in full else weight[s] * left / total for s in names}
        over = {s for s in rest if out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)


def test_targets(spark):
    rng = random.Random(2)
    for _ in range(6):
        sizes = {rng.choice([None, "", "a", "B", "é", "z", "s1", "s10", "s2"]): rng.choice([0, 1, 50, 5000]) for _ in range(7)}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([1, 20, 300]), "hot" if i % 3 == 0 else f"s{i % 9}", float(rng.random())) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    for measure in (None, "target"):
        mixed = mixing.mix(docs, measure=measure).cache()
        assert mixed.count() == 6000 and mixed.where("taken > 2 * size").count() == 0
        sums = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.sum("size").alias("s"))
        for r in sums.collect():
            if measure and r.g > 0.9 * r.s:
                continue  # documents stop at two copies
            assert abs(r.t - r.g) <= (150 if measure is None else 0.05 * r.g + 300)
    again = mixing.mix(docs)
    assert again.exceptAll(mixing.mix(docs)).count() == 0


def test_mix_odd(spark, odd_docs, no_docs):
    mixed = mixing.mix(odd_docs)
    assert mixed.count() == odd_docs.count() and mixed.where("size = 0 and taken > 0").count() == 0
    kept = mixing.keep_mixed(odd_docs)
    assert kept.where("copies < 1").count() == 0 and kept.count() <= odd_docs.count()
    assert mixing.mix(no_docs).count() == 0 and mixing.keep_mixed(no_docs).count() == 0


def test_url_rules(spark):
    urls = ["http://NET/x", "http://a.b.net/", "http://xnet/", "http://example.net/en/a", "http://EXAMPLE.net/fr/",
            "https://www.example.com/de/1?q", "http://example.com/de", "http://t.org/fr/#f", "http://t.org", "http://.net/",
            "ftp://net?x/", "no scheme net/", "://net/", "", None, "http://net:80/", "http://a..org/fr/", "http://ü.net/é"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls)], "page_id long, url string, host string")

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0] if rest[cut:cut + 1] == "/" else ""
        fits = [(len(r), r, a) for a, r in urlfilter.RULES
                if ("." + host).endswith("." + urlfilter.split_rule(r)[0]) and host and path.startswith(urlfilter.split_rule(r)[1])]
        return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")

    for r in urlfilter.judge(pages).collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.row.page_id % len(urls)]), r
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("substring(key, -2) = '07'")
    levels = urlfilter.build_cascade(listed, keys.join(listed, "key", "left_anti"))
    assert len(levels) > 1
    got = keys.where(urlfilter.member(F.col("key"), levels))
    assert got.exceptAll(listed).count() == 0 and got.count() == listed.count()
    assert urlfilter.build_cascade(listed.limit(0), keys) == []


def test_pipeline(spark, sf):
    """Each stage against plain Python on its own input."""
    import corpus_pipeline

    from chartspan.llm.queries import toxicity_model
    from tests.llm.test_pair_operators import brute_leaks, brute_near
    from tests.llm.test_text_operators import brute_spans

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        from chartspan.plans.session import new_folder

        folder = new_folder(spark, name)
        stage(spark, docs, sf).write.parquet(folder)
        docs = spark.read.parquet(folder)
        assert docs.columns[:len(columns)] == columns
        seen.append(docs.collect())
    ids = [[r.doc_id for r in s] for s in seen]
    model = toxicity_model(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(ids[1]) == sorted(r.doc_id for r in seen[0] if model.score(r.text) < 0.3)
    assert sorted(ids[2]) == brute_near([(r.doc_id, r.text) for r in seen[1]])
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    leaked = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in seen[2]], items)}
    assert sorted(ids[3]) == sorted(set(ids[2]) - leaked)
    before = {r.doc_id: r.text for r in seen[3]}
    assert sorted(ids[4]) == sorted(ids[3])
    for r in seen[4]:
        spans = brute_spans(before[r.doc_id])
        assert (r.text == before[r.doc_id]) == (not spans) and not any(before[r.doc_id][s:e] in r.text for k, s, e in spans if k == "email")
    assert all(r.copies >= 1 and r.taken == r.copies * r.size for r in seen[5])
    final = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in final) == sorted(ids[5])
