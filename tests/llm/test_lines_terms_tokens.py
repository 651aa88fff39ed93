"""Line dedup, source audit and tokenizer alignment against plain Python, and their odd cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartspan.llm import alignment, divergence, linededup
from tests.llm.test_corpus_operators import compare


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_source_audit"])
def test_against_sql(spark, sf, name):
    compare(spark, sf, name)


# --- lines

def brute_lines(rows, min_docs, min_chars=1, keep_first=False):
    """Lines, dropped lines and kept text of each ``(doc_id, text)``."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    holders, first = collections.Counter(), {}
    for i, text in rows:
        lines = [key(line) for line in (text or "").split("\n")]
        holders.update(set(lines))
        for n, k in enumerate(lines):
            place = (i is None, i or 0, n)
            first[k] = min(first.get(k, place), place)
    out = []
    for i, text in rows:
        lines, kept = (text or "").split("\n"), []
        for n, line in enumerate(lines):
            k = key(line)
            if len(k) < max(1, min_chars) or holders[k] < min_docs or keep_first and first[k] == (i is None, i or 0, n):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def line_rows():
    rng = random.Random(11)
    pool = [f"Line {i} of the pool é" for i in range(40)] + ["", " ", "x", "É", "é", "\tMenu \r", "menu", "MENU\x0b", "a "]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < .6 else f"own {i} {rng.random()}" for _ in range(rng.randrange(9))))
            for i in range(300)]
    rows += [(7, "menu\nmenu"), (None, "menu\nown of nobody"), (None, None), (301, None), (302, ""), (302, ""), (303, "menu\n" * 30_000 + "end")]
    return rows


@pytest.mark.parametrize("options", [{"min_docs": 10}, {"min_docs": 2, "keep_first": True}, {"min_docs": 3, "min_chars": 5}])
@pytest.mark.parametrize("bounds", [{}, {"most_blocks": 1}, {"table_rows": 0}])
def test_lines_against_plain(spark, line_rows, options, bounds):
    docs = spark.createDataFrame(line_rows, "doc_id long, text string").repartition(5)
    got = linededup.drop_repeated(docs, **options, **bounds).collect()
    assert sorted(((r.doc_id, r.lines.n_lines, r.lines.n_dropped, r.text) for r in got), key=repr) == brute_lines(line_rows, **options)


def test_lines_odd(spark, odd_docs, no_docs):
    wide = odd_docs.withColumnRenamed("score", "lines").withColumnRenamed("row", "key")
    out = linededup.drop_repeated(wide, min_docs=2)
    assert out.count() == odd_docs.count() and set(out.columns) == set(wide.columns)
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[1].text == "" == by_id[2].text and by_id[1].lines.n_dropped == 1
    assert by_id[4].lines.n_lines == 1 and by_id[4].lines.n_dropped == 0
    assert linededup.drop_repeated(no_docs).count() == 0


def test_filters_merge_in_any_order():
    """Bits of any grouping of the parts never forget a key that two of them hold."""
    rng = random.Random(3)
    keys = linededup.digests([str(i).encode() for i in range(3000)])
    parts = [collections.Counter({k: 1 for k in rng.sample(keys, 400)}) for _ in range(8)]
    filters = []
    for p in parts:
        f = linededup.Filters(2)
        f.add(p)
        filters.append((f.once, f.twice))
    join = lambda x, y: (x[0] | y[0], x[1] | y[1] | (x[0] & y[0]))
    left = filters[0]
    for f in filters[1:]:
        left = join(left, f)
    right = filters[-1]
    for f in reversed(filters[:-1]):
        right = join(f, right)
    assert all((a == b).all() for a, b in zip(left, right))
    held = linededup.held(left[1], linededup.positions(keys, 2))
    assert all(held[i] for i, k in enumerate(keys) if sum(k in p for p in parts) > 1)
    block = rng.choice(filters)[0][:linededup.BLOCK]
    assert (linededup.unpack(linededup.pack(block)) == block).all()


def test_only_suspects_leave_their_task(spark):
    rows = [(i, "\n".join(f"single line {i} {j}" for j in range(20)) + "\nshared") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bits = linededup._broadcast_filter(spark, docs, 1, linededup.MOST_BLOCKS)
    sent = linededup._suspected(docs, "doc_id", "long", 1, bits)
    assert 500 <= sent.count() < 1500
    assert [r.docs for r in linededup.repeated_keys(docs).collect()] == [500]


# --- terms

def brute_audit(rows, min_docs=3, top=200):
    """Rows of the audit for ``(lang, source, text)``."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
            for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        holders = collections.Counter(w for d in mine for w in set(d[2]))
        kept = [w for w, n in holders.items() if n >= min_docs]

        def shares(which):
            counts = collections.Counter(w for d in which for w in d[2] if holders[w] >= min_docs)
            whole = sum(counts.values()) + len(kept)
            return counts, {w: 1 + 10 ** 9 * (counts[w] + 1) // whole for w in kept}

        _, of_lang = shares(mine)
        sources = {d[1] for d in mine}
        own = {s: shares([d for d in mine if d[1] == s]) for s in sources}
        far = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pairs = [(-sum(far(own[s][1][w], own[o][1][w]) for w in kept), o) for o in sources if o != s]
            terms = [(-far(own[s][1][w], of_lang[w]), w) for w in kept if own[s][0][w] and own[s][1][w] > of_lang[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda f: (f[0], f[1].encode()))[:most]
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def test_audit_against_plain(spark, odd_docs, no_docs):
    rng = random.Random(12)
    words = ["The", "the", "Ünder", "ünder", "日本", "a-b", "x", "É", "naïve", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["hot"] * 5 + ["b", None, "é", "z9"]),
             None if rng.random() < .05 else " ".join(words[min(int(rng.expovariate(.01)), len(words) - 1)] for _ in range(rng.randrange(60))))
            for _ in range(400)]
    rows += [("xx", "only", ""), ("xx", "other", None), ("yy", "one", "word " * 50_000)] * 3
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    got = sorted(tuple(r) for r in divergence.audit_sources(docs).collect())
    assert got == brute_audit(rows)
    few = sorted(tuple(r) for r in divergence.audit_sources(docs, min_docs=1, top=3).collect())
    assert few == brute_audit(rows, 1, 3)
    odd = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in divergence.audit_sources(odd_docs).collect()) == brute_audit(odd)
    assert divergence.audit_sources(no_docs).count() == 0


def test_audit_of_many_sources(spark, monkeypatch):
    """More sources than a block and more terms than a chunk: every pair of blocks meets."""
    monkeypatch.setattr(divergence, "BLOCK", 4)
    monkeypatch.setattr(divergence, "CHUNK", 16)
    rng = random.Random(5)
    rows = [("l", f"s{i % 13}", " ".join(chr(97 + rng.randrange(26)) + chr(97 + rng.randrange(9)) for _ in range(30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.audit_sources(docs).collect()) == brute_audit(rows)


def test_shares_are_exact_beyond_longs(spark):
    rows = spark.createDataFrame([(9 * 10 ** 15, 10 ** 16), (0, 7), (10 ** 18, 10 ** 18 + 3)], "n long, m long")
    for r in rows.select("n", "m", divergence._share(rows.n, rows.m).alias("p")).collect():
        assert r.p == 1 + 10 ** 9 * (r.n + 1) // r.m


# --- tokens

@pytest.fixture(scope="module")
def own():
    return alignment.Tokenizers(alignment.default_vocabulary())


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def brute_alignment(docs, plain, own):
    """Row of each ``(doc_id, text)`` by walking both token lists."""
    first, second = plain
    count, rows = collections.Counter(), []
    for i, text in docs:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a, bytes_b = [own.bytes_a[x] for x in a], [own.bytes_b[x] for x in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            rows.append((i, 0, 0, [], []))
            continue
        groups, links, now, x, y, end_a, end_b = [], [], ([], []), 0, 0, len(bytes_a[0]), len(bytes_b[0])
        while x < len(a):
            links.append((a[x], b[y]))
            done_a, done_b = end_a <= end_b, end_b <= end_a
            if done_a:
                now[0].append(a[x])
                x += 1
                end_a += len(bytes_a[x]) if x < len(a) else 0
            if done_b:
                now[1].append(b[y])
                y += 1
                end_b += len(bytes_b[y]) if y < len(b) else 0
            if done_a and done_b:
                groups.append(now)
                now = ([], [])
        count.update(links)
        rows.append((i, len(a), len(b), groups, links))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    text_of = lambda groups: ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
    return sorted(((i, a, b, len(g), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls),
                    hashlib.sha256(text_of(g).encode()).hexdigest() if g else "") for i, a, b, g, ls in rows), key=repr)


ODD_TEXTS = ["a", " ", "  two  blanks ", "naïve café 日本語のテキスト", "🙂🙂 emoji", "\n\n\t x\r\n", "<|endoftext|> <s> </s> <unk> <0x41>",
             "under▁score ▁ mark", "é combining", "I'll we've 12345 67.89", "\x00\x07 controls", "ﬁ ligature Ⅻ", "x" * 3000, " nbsp 　 wide"]


def test_first_encoder_is_the_file(own, plain):
    for text in ODD_TEXTS:
        assert own.first.encode_ordinary(" " + text) == plain[0].encode(" " + text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoder_on_any_text(own, plain, text):
    text = text.encode("utf-8", "ignore").decode()
    assert own.first.encode_ordinary(" " + text) == plain[0].encode(" " + text, add_special_tokens=False).ids


def same(x, y):
    return all(np.array_equal(getattr(x, f), getattr(y, f)) if f in ("pairs", "times") else
               all(np.array_equal(p, q) for p, q in zip(getattr(x, f), getattr(y, f))) if f in ("first", "last") else getattr(x, f) == getattr(y, f)
               for f in ("fits", "closed", "first", "last", "n_a", "n_b", "n_groups", "groups", "pairs", "times"))


def test_fragments_compose_in_any_grouping(own):
    """Byte ranges cut anywhere, also inside tokens, in any grouping, give the alignment of the whole."""
    rng = random.Random(13)
    for text in ODD_TEXTS[:-2] + ["The quick brown fox écrit 12,345 wörds antidisestablishmentarianism " * 5]:
        whole, = alignment.align(own, [text])
        if not whole.fits:
            continue
        (a, b), = own.encode([text])
        ends_a, ends_b = np.cumsum(own.size_a[a]), np.cumsum(own.size_b[b])
        for _ in range(8):
            cuts = sorted({0, int(ends_a[-1]), *(rng.randrange(int(ends_a[-1]) + 1) for _ in range(rng.randrange(7)))})
            parts = []
            for lo, hi in zip(cuts, cuts[1:]):
                i, j = np.searchsorted(ends_a, [lo, hi], side="right")
                k, m = np.searchsorted(ends_b, [lo, hi], side="right")
                parts.append(alignment.fragment(own, a[i:j], b[k:m], int(ends_a[i - 1]) if i else 0, int(ends_b[k - 1]) if k else 0))
            assert same(alignment.whole(own, alignment.compose(own, parts)), whole)
            while len(parts) > 1:
                at = rng.randrange(len(parts) - 1)
                parts[at:at + 2] = [alignment.compose(own, parts[at:at + 2])]
            assert same(alignment.whole(own, parts[0]), whole)


def test_pieces_give_the_text_back():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("ab1_ .\n▁é") for _ in range(400))
        for size in (1, 7, 50):
            parts = alignment.pieces(text, size)
            assert " ".join(parts) == text
            assert all(p[-1].isalnum() and q[0].isalnum() for p, q in zip(parts, parts[1:]))


def alignment_rows(frame):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("bounds", [{"long_text": 200, "piece": 16}, {"long_text": 200, "piece": 16, "table_rows": 0}, {}])
def test_alignment_against_plain(spark, own, plain, odd_docs, bounds):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id not in (6, 7)] + list(enumerate(ODD_TEXTS, 100))
    rows += [(200 + i, " ".join(t * 9 for t in ODD_TEXTS[i:])) for i in range(12)] + [(300, "word and words of it " * 400)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert alignment_rows(alignment.align_tokenizers(docs, **bounds)) == brute_alignment(rows, plain, own)


def test_alignment_query(spark, sf, own, plain):
    from chartspan.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert alignment_rows(QUERIES["op13_tokenizer_alignment"](spark, sf)) == brute_alignment(rows, plain, own)


def test_alignment_odd(spark, odd_docs, no_docs):
    wide = odd_docs.withColumnRenamed("score", "pairs").withColumnRenamed("row", "key")
    assert alignment.align_tokenizers(wide).count() == odd_docs.count()
    assert alignment.align_tokenizers(no_docs).count() == 0
