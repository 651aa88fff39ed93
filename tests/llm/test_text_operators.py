"""Toxicity, language, personal data, main text and licences."""

import hashlib
import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from chartspan.llm import html, language, licenses, pii, toxicity


@pytest.fixture(scope="module")
def model():
    return toxicity.Model({toxicity.folded(w): 5.0 for w in ("idiot", "trash")} | {"vequ*": 2.0},
                          [toxicity.folded("trash can")])


@pytest.mark.parametrize("text, n", [
    ("You IDIOT!", 1), ("an 1d10t, an іdiоt", 2), ("ｉｄｉｏｔ", 1), ("idiotic", 0), ("the trash can is trash", 1),
    ("vequaire vequx xvequ", 2), ("", 0), ("id​iot", 1), ("tr@sh", 1), ("idiot@@@ and stupid$$$", 1)])
def test_lexicon_hits(model, text, n):
    assert len(model.hits(toxicity.folded(text))) == n


def test_length_counts(model):
    dense, sparse = "idiot " * 3, "idiot " * 3 + "fine words " * 3000
    assert model.score(dense) > model.score(sparse) > model.score("fine words") == model.score(None) == model.score("")


def test_toxicity_fit(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        body = f"some harmless words number {i} in a row and more of them "
        rows.append((i, body + (f"zarg{i % 7} blah zarg{i % 5} " if bad else f"zar{i % 7} garbage can ")))
        labels.append((i, 1 if bad else 0))
    rows += [(None, "x"), (500, None), (0, rows[0][1])]
    labels += [(None, 1), (501, None), (0, 1), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(t.startswith("zarg") for t in fitted.weights)
    assert fitted.score("new words zarg9 and zarg8") >= 0.3 > fitted.score("new words about a garbage can")
    none = toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score("you idiot") >= 0.3 > none.score("hello")


def test_terms_beyond_two_thousand(spark):
    """A large group of near copies brings thousands of telling words; the terms of few documents enter all the same."""
    long = " ".join(f"filler{a}{b}{c}" for a in "abcdefghijklmn" for b in "abcdefghijklmn" for c in "abcdefghijklmn")
    rows = [(i, f"{long} copy{i}", 1) for i in range(30)] + [(100 + i, f"plain words vexor number{i} here", 1) for i in range(6)]
    rows += [(200 + i, f"plain words number{i} here", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fitted = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    assert fitted.score("some vexor words") > fitted.score("some other words")
    assert any("vexor".startswith(t.rstrip("*")) for t in fitted.weights)


def test_hits_against_plain_and_linear(model):
    import time

    for text in ("trash can trash", "class clown fish clown", "trash trash can", "a clown fish and a circus clown idiot"):
        plain = toxicity.folded(text)
        spans = [(m.start(), m.end()) for p in model.exceptions for m in re.finditer(rf"(?<!\w){re.escape(p)}(?!\w)", plain)]
        spared = [h for h in toxicity.Model(model.weights, []).hits(plain) if not any(s <= h[0] < e for s, e in spans)]
        assert sorted(model.hits(plain)) == sorted(spared)
    start = time.monotonic()
    assert model.hits("trash can " * 40_000) == []
    assert time.monotonic() - start < 5


def test_drop_toxic_odd(spark, odd_docs, no_docs, model):
    left = toxicity.drop_toxic(odd_docs, model)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count()
    assert toxicity.drop_toxic(no_docs, model).count() == 0


def test_toxicity_held_out(spark):
    from chartspan.llm.queries import op1_toxicity

    sf = "/root/testdata/sf0.01"
    got = op1_toxicity(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    seen = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    wrong = dict(seen.groupBy("toxic").agg(F.avg(F.abs(F.col("toxic") - F.col("predicted")))).collect())
    assert wrong[0] <= 0.05


def test_segmentations_are_summed():
    """The forward pass equals a plain sum over all segmentations."""
    pieces = language.Pieces(["▁", "▁a", "a", "ab", "b", "▁ab"])
    import numpy as np

    table = np.array([[1e-7], [.2], [.3], [.1], [.15], [.05], [.2]])
    prob = dict(zip([None, *pieces.pieces], table[:, 0]))

    def total(s):
        return 1.0 if not s else sum((prob.get(s[:n]) or (1e-7 if n == 1 else 0)) * total(s[n:]) for n in range(1, len(s) + 1))

    words = ["ab", "a", "abba", "zab", "bb"]
    got = language.word_scores(words, pieces, table)[:, 0]
    assert [round(x, 9) for x in got] == [round(math.log(total("▁" + w)), 9) for w in words]
    counts = language.expected_counts(["ab"], np.ones(1), pieces, table[:, 0])
    parts = {(1, 2, 4): .2 * .1 * .0}  # expected counts of one word add up to the mean number of pieces
    assert parts and abs((counts * np.array([1, 1, 2, 1, 2, 1, 3])).sum() - 3) < 1e-9


def test_long_words_are_not_cut():
    """Words beyond one pass give the plain sum over segmentations of the whole word, and its expected counts."""
    import numpy as np

    rng = random.Random(5)
    pieces = language.Pieces(["▁", "▁a", "a", "ab", "b", "▁ab", "abba", "bab"])
    table = np.array([[1e-7, 1e-7], [.2, .1], [.3, .1], [.1, .2], [.15, .3], [.05, .1], [.2, .05], [.1, .1], [.05, .2]])
    words = ["".join(rng.choice("abz") for _ in range(n)) for n in (29, 30, 31, 32, 200, 3000)]
    got = language.word_scores(words, pieces, table)
    for w, scores in zip(words, got):
        s = "▁" + w
        for lang in range(2):
            prob = {p: Fraction(table[i, lang]) for i, p in enumerate(pieces.pieces, 1)}
            if len(s) < 1000:
                sums = [Fraction(1)]
                for end in range(1, len(s) + 1):
                    sums.append(sum(sums[end - n] * prob.get(s[end - n:end], Fraction(table[0, lang]) if n == 1 else 0)
                                    for n in range(1, min(4, end) + 1)))
                log = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
                assert abs(log - scores[lang]) < 1e-8 * abs(log)
    assert np.isfinite(got).all()
    sizes = np.array([1, *map(len, pieces.pieces)])
    for w in words[:5]:  # every segmentation covers the marked word once
        counts = language.expected_counts([w], np.full(1, 2.0), pieces, table[:, 0])
        assert abs((counts * sizes).sum() - 2 * (len(w) + 1)) < 1e-6
    # both ways of the pass agree on a word that either can take
    w = words[0]
    logs = np.log(table)
    assert np.allclose(language.forward_long(pieces.places("▁" + w), len(w) + 1, logs)[-1], got[0])
    short = language.expected_counts([w], np.ones(1), pieces, table[:, 0])
    before, language.SPAN = language.SPAN, 5
    try:
        assert np.allclose(language.expected_counts([w], np.ones(1), pieces, table[:, 0]), short)
    finally:
        language.SPAN = before


def test_language_held_out(spark, odd_docs, no_docs):
    from chartspan.llm.queries import op2_language_id

    sf = "/root/testdata/sf0.01"
    got = op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    right = got.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    fitted = language.fit(odd_docs)
    seen = odd_docs.select("doc_id", language.predict(F.col("text"), fitted).alias("p")).collect()
    assert len(seen) == odd_docs.count()
    assert {r.doc_id: r.p.lang for r in seen if r.doc_id in (3, 4, 5)} == {3: "und", 4: "und", 5: "und"}
    empty = language.fit(no_docs)
    assert empty.languages == []
    assert {r.p.lang for r in odd_docs.select(language.predict(F.col("text"), empty).alias("p")).collect()} == {"und"}


def brute_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                          ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
                          ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(digits[::-1])) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("text", [
    None, "", "a@b", "a@b.c", "..@x-y.z.w@q.r", "a@b@c.de", "é@x.y u.v+w@x.y.", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1",
    "4111 1111-1111 1111", "41111111111111112", "+1 (487) 555-7209.", "+12 3", "++33 1 23 45 67 89 ", "0000.1.2.3",
    "a" * 5000 + "@", "1" * 3000 + ".1", "🙂 4111111111111111 me@x.y"])
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_pii_query(spark, sf):
    from chartspan.llm.queries import op10_pii

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op10_pii(spark, sf).collect():
        spans = brute_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in pii.KINDS]


def test_telling_terms(spark):
    """A label that stands next to addresses only is telling; common words and copies are not."""
    rows = [(f"hello there w{chr(97 + i)}x kontakt a{i}@b.cd bye now {'filler words ' * 30}",) for i in range(20)]
    rows += [("rareword x@y.zz copied passage",)] * 50 + [("hello there and bye now " * 20,)] * 200 + [(None,), ("",)]
    docs = spark.createDataFrame(rows, "text string")
    for sent in (100_000, 0):
        terms = pii.telling_terms(docs, sent_terms=sent)
        assert set(terms.kinds) == {"kontakt"} and terms.removed == {"kontakt"}
    assert pii.cleaned("my kontakt: a@b.cd", terms) == "my : [EMAIL]"
    assert pii.cleaned("kontakt only", terms) == "kontakt only"
    assert pii.telling_terms(docs.limit(0)).kinds == {}


def test_telling_terms_far_from_their_value(spark):
    """A name eight words, two lines and 300 characters from a value gives it away; nine words off it does not."""
    common = "the and for with from this that"
    gap = " " * 300

    def text(i, words):
        return f"zorvath\n{gap}{common}\n{'again ' * (words - 7)}" + f"u{i}@b.cd end of part x{chr(97 + i % 26)}q " + f"{common} again. " * 9

    for words, told in ((7, {"zorvath"}), (8, set())):
        docs = spark.createDataFrame([(text(i, words),) for i in range(20)] + [(f"{common} end of part again",)] * 300, "text string")
        assert set(pii.telling_terms(docs).kinds) == told


def test_windows_count_an_occurrence_once():
    text = "ab cd a@b.cd ef gh c@d.ef ij kl mn +1 555 123 4567 op"
    got = list(pii.windows(text, pii.base_spans(text), 2))
    terms = [(t, k) for t, k, _ in got]
    assert sorted(terms) == sorted([("ab", "email"), ("cd", "email"), ("ef", "email"), ("gh", "email"), ("ij", "email"), ("kl", "email"),
                                    ("kl", "phone"), ("mn", "phone"), ("op", "phone")])
    assert got[0][2] == "ab cd * ef gh" and list(pii.windows("", [], 2)) == []
    terms = pii.Terms({"aa": frozenset({"card"})})
    assert terms.spans("aa bb aa", [("card", 0, 2), ("ip", 1, 4)]) == [("term", 6, 8)]


def test_sanitise_odd(spark, odd_docs, no_docs):
    clean = pii.sanitise(odd_docs, pii.Terms())
    assert clean.columns == odd_docs.columns and clean.dtypes == odd_docs.dtypes
    seen = {r.doc_id: r for r in clean.collect()}
    assert seen[8].text == "écrivez à [EMAIL] ou [PHONE]" and seen[8].n_chars == len(seen[8].text)
    assert seen[9].text == "🙂 mail [EMAIL] now" and seen[3].text is None and seen[3].n_chars is None and seen[4].text == ""
    assert clean.count() == odd_docs.count() and pii.sanitise(no_docs, pii.Terms()).count() == 0


def test_main_text_of_pages(spark, sf):
    """Each page's article, cut out by a plain expression."""
    import html as entities

    from chartspan.llm.queries import op8_html_main_text

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op8_html_main_text(spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("just text", "just text"),
    ("<body><nav><a href=x>m</a></nav><div><h1>T</h1><p>One, two &amp; three&nbsp;four.</p><p>Five<br>six</p></div><footer>f</footer>",
     "T\nOne, two & three four.\nFive six"),
    ("<article><p>Body, of text.</p><div class='comments'><p>nice, post</p></div><aside>ad</aside><form>f</form></article>", "Body, of text."),
    ("<main><header><h1>Head</h1></header><p title='a > b'>x &lt; y<script>var p='</p>'</script></p><!-- c --></main>", "Head\nx < y"),
    ("<div id=sidebar><p>side, bar, text, with, commas, here</p></div><div class=content><p>Real text, here.<p>More of it.</div>",
     "Real text, here.\nMore of it."),
    ("<ul><li>a, b<li>c</ul><div hidden>no</div>", "a, b\nc")])
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_main_text_is_linear():
    for page in ("<a " * 30_000, "<a href=\"" * 20_001 + ">", "<div>" * 20_000 + "x</span>" * 20_000, "<li>a" * 20_000):
        html.main_text(page)
    import time

    start = time.monotonic()
    html.main_text("<blockquote><span>word, word " * 8_000)
    assert time.monotonic() - start < 5


def test_sizes_are_those_of_the_text(spark, sf):
    """Lengths and commas summed from the leaves against the text of every element."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").limit(60).collect()]
    for page in [*pages, "<p> a , <b> b</b><br>c <i> </i> </p> d<div></div>", "<p>x<span> <div>y,</div>z</span>"]:
        root = html.parse(page or "")
        sizes = html._sizes(root)
        for node in html._walk(root):
            text = html._text(node)
            assert sizes[id(node)][:2] == (len(text), text.count(","))


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/x.py", "code"),
            ("a/b/c/COPYING", "Licensed under the Apache License, Version 2.0."), ("a/b/c/y.py", "z"), ("q.py", None), ("r.py", ""),
            ("a/b/h.py", "# This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\n" + "code of many words " * 20),
            (None, "x"), ("a/z.py", "no license here, says copyright of nobody and nothing else")]
    files = spark.createDataFrame([(*r, 1.0) for r in rows], "path string, text string, cosine double")
    got = sorted((r.path or "", r.license, r.basis, r.directory) for r in licenses.scan(files).collect())
    assert got == sorted([
        ("a/LICENSE", "MIT", "file", None), ("a/b/x.py", "MIT", "inherited", "a"), ("a/b/x.py", "MIT", "inherited", "a"),
        ("a/b/c/COPYING", "Apache-2.0", "file", None), ("a/b/c/y.py", "Apache-2.0", "inherited", "a/b/c"),
        ("q.py", None, "none", None), ("r.py", None, "none", None), ("a/b/h.py", "MPL-2.0", "header", None),
        ("", None, "none", None), ("a/z.py", "MIT", "inherited", "a")])
    assert licenses.scan(files.limit(0)).count() == 0


def test_license_cosine_is_tf_idf(spark):
    """Cosines of a few passages against a plain computation."""
    passages = ["Licensed under the Apache License", "the license of the MIT people", "copyright by someone else entirely"]
    templates = [("A", "Licensed under the Apache License, Version 2.0."), ("B", "Released under the MIT License.")]
    tok = lambda s: re.findall(r"[^\W_]+(?:\.\d+)*", s.lower())
    vocabulary = {t for _, s in templates for t in tok(s)}
    texts = passages + [s for _, s in templates]
    n = len(texts)
    idf = {t: math.log((1 + n) / (1 + sum(t in tok(s) for s in texts))) + 1 for t in vocabulary}
    vec = lambda s: {t: tok(s).count(t) * idf.get(t, math.log(1 + n) + 1) for t in set(tok(s))}
    cos = lambda a, b: sum(a[t] * b.get(t, 0) for t in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    want = {}
    for p in passages:
        best = max((round(cos(vec(p), vec(s)), 9), name) for name, s in templates)
        if best[0] > 0:
            want[p] = best
    got = licenses.similarities(spark.createDataFrame([(p,) for p in passages], "text string"),
                                spark.createDataFrame(templates, "license string, text string")).collect()
    key = lambda p: hashlib.md5(p.encode()).hexdigest()
    assert {r.key: (r.cosine, r.license) for r in got} == {key(p): v for p, v in want.items()}
