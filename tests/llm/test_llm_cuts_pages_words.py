"""Fill-in-the-middle, main text of pages and spelling variants against plain Python."""

import hashlib
import html as markup
import random
import re
import string
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opsframe.llm import fim, html, queries, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    "", None, "word", "Two words, é😀中.", "x <M> y", "a\n\n\tb  c", "1", "ß" * 50, "Ab1" * 4000, "Two words, é😀中.", "<P", "end <S", "P>S>", "<P>",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, texts, **more):
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    return rows.withColumns({k: F.lit(v) for k, v in more.items()})


def plain_cut(doc_id, text, seed=1, percent=90, spm=20):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digits = sha(f"{seed}:{doc_id}")
    h = [int(digits[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


def test_fill_in_middle_equals_plain_cuts(spark):
    texts = TEXTS * 20
    docs = docs_of(spark, texts, n="clash", form=1, output="clash", extra="kept")
    got = {r.doc_id: r for r in fim.fill_in_middle(docs).withColumn("back", fim.restored()).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_cut(i, t or "")
        assert r.back == (t or "") and r.extra == "kept"
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_fill_in_middle_null_ids_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "some text here")] * 2 + [(5, "some text here")] * 2, "doc_id long, text string")
    got = [tuple(r) for r in fim.digest(fim.fill_in_middle(rows)).collect()]
    assert len(got) == 4 and len(set(got)) == 2
    assert {r[0]: r[1] for r in got} == {None: 5, 5: 5}
    assert fim.fill_in_middle(rows.limit(0)).count() == 0


def test_fill_in_middle_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op11_fill_in_middle(spark, sf_dir).collect()}
    for d in docs:
        n, form, prefix, middle, out = plain_cut(d.doc_id, d.text or "")
        assert tuple(got[d.doc_id]) == (d.doc_id, n, form, prefix, middle, sha(out), sha(d.text or ""))


def article_by_tags(page):
    inner = page[page.index("<article>"):page.index("</article>")]
    blocks = (" ".join(markup.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|article)>|<br>", inner))
    return "\n".join(x for x in blocks if x)


def test_page_query_gives_the_articles(spark, sf_dir):
    pages = {p.page_id: p for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op12_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article_by_tags(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


LONG = "This sentence is long enough to be taken for a part of an article, as we think. "
PAGES = [
    ("", ""),
    ("plain &lt;text&gt; only", "plain <text> only"),
    ("<script>if (a < b) { x = '<p>no</p>' }</script><style>p {}</style><p>yes</p>", "yes"),
    # no article element: the surge after the menu, short lines inside, a dive before the notice
    (f"<div class=t><a href=/>Home</a> <a href=/n>News</a></div><div><h1>Title</h1><p>{LONG * 3}</p><p>Short.</p><p>{LONG * 2}</p></div><div>(c) 2020</div>",
     f"Title\n{(LONG * 3).strip()}\nShort.\n{(LONG * 2).strip()}"),
    # no article element, two text boxes of one kind and a short line between them
    (f"<div><p>{LONG * 3}</p></div><section><a>x</a></section><div><p>{LONG * 3}</p></div>", f"{(LONG * 3).strip()}\n{(LONG * 3).strip()}"),
    # class names
    (f"<div id='cookieNotice'>{LONG}</div><div class='main has-sidebar'><p>{LONG}</p><div class='ad-slot'>Buy!</div><p>And more.</p></div>"
     f"<div class='left sidebar'>{LONG}</div><section id=comments><article class='comment'>{LONG}</article></section>", f"{LONG.strip()}\nAnd more."),
    # short article, long rest
    (f"<header>Site</header><article><header><h1>T</h1></header>Few words.<footer>by me</footer></article><aside>{LONG * 9}</aside><form>{LONG}</form>", "T\nFew words."),
    # never closed
    ("<nav><ul><li><a>Home</a><article><h1>T<p>One <b>two<p>Three</article>", "T\nOne two\nThree"),
    # a list of links is a menu also inside an article, two links are not
    ("<article><p>Text.</p><p>More text.</p><ul><li><a>a</a><li><a>b</a><li><a>c</a><li><a>d</a></ul></article>", "Text.\nMore text."),
    ("<article><p>Text.</p><p><a>source</a></p></article>", "Text.\nsource"),
    ("<p>In<b>li</b>ne&nbsp;&nbsp; white\n\tspace<br>same<br><br>next</p>", "Inline white space same\nnext"),
    ("<!-- <p>not this</p> --><p title='a > b'>but this</p><!-- open", "but this"),
    ("<p hidden>no</p><p style='display: none'>no</p><div role=navigation>no</div><p>yes</p>", "yes"),
    ("<nav><a>only</a></nav>", ""),
]


def test_page_shapes(spark):
    rows = [(i, p, "clash") for i, (p, _) in enumerate(PAGES)] + [(99, None, "clash"), (3, PAGES[3][0], "again")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (PAGES[r.page_id][1] if r.page_id < 99 else "") and r.n_chars == len(r.text)
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("unit", ['<a "', "<", "<!--", "<div>", '<div class="ad">', "</p>", "<script>", "<b>", "<article><nav>", "&"])
def test_odd_pages_take_linear_time(unit):
    html.main_text(unit * 20_000 + "x")


def test_regions_part_at_dives_only():
    line = lambda weight, blanks=1: html.Line("x" * max(weight, 1), weight, blanks, 0, 0, 0, False)
    assert html.regions([line(5), line(5), line(5, 3), line(0), line(7)], close=False) == [(0, 1, 10), (2, 2, 5), (4, 4, 7)]
    assert [r[:2] for r in html.regions([line(5), line(5), line(9, 3)], close=False)] == [(0, 1), (2, 2)]
    assert [r[:2] for r in html.regions([line(5), line(5), line(9, 3)], close=True)] == [(0, 2)]
    assert [r[:2] for r in html.regions([line(5), line(0), line(0), line(0), line(9)], close=True)] == [(0, 0), (4, 4)]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if counts[b] >= ratio * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def found_variants(words, ratio=5):
    rows = spelling.variants(words, ratio).select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r.word: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_equal_all_pairs(spark):
    rng = random.Random(3)
    words = set()
    for _ in range(60):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        words.add(w)
        for _ in range(rng.randint(0, 9)):  # chains of edits at all places, in a small alphabet: many ties and repeated bigrams
            i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w = w[:i] + rng.choice("abéÀ") * (kind != 0) + w[i + (kind != 1):]
            if len(w) >= 6:
                words.add(w)
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "abababa"}
    counts = {w: 5 ** rng.randint(1, 9) for w in words}
    got = found_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert got == plain_variants(counts)
    assert max(v[3] for v in got.values()) > 3 and any(v[0] and v[1] != v[0] for v in got.values())


def test_look_ups_are_never_broadcast(spark, tmp_path):
    """The files of the words are far below Spark's threshold for broadcasts; what is looked up is not."""
    words = spark.createDataFrame([("garten", 50), ("gartem", 5), ("gartenn", 9)], "word string, n long")
    words.write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    pairs = spelling.near_pairs(words)
    for df in (pairs, spelling.forms(words, pairs, 5), spelling.variants(words)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_short_words_are_near_none(spark):
    words = spark.createDataFrame([("abc", 50), ("abd", 5), ("", 5), ("a", 5), ("abcd", 400), ("abce", 7)], "word string, n long")
    got = found_variants(words)
    assert got["abc"] == (None, "abc", 50, 0, None) and got["abce"] == ("abcd", "abcd", 7, 1, 400) and len(got) == 6


def plain_counts(rows, every):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_word_counts_with_nulls_repeats_and_clashes(spark):
    rows = [(1, "Garten garten GARTEN Übung übung×÷ Ünder"), (1, "Garten garten GARTEN Übung übung×÷ Ünder"), (None, "garten " * 9), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n long, word string")
    for every in (0, 3, 1):
        assert {r.word: r.n for r in spelling.word_counts(docs, typo_every=every).collect()} == plain_counts(rows, every)
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0


def test_spelling_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op13_spelling(spark, sf_dir).collect()}
    assert got == plain_variants(plain_counts(docs, 199))


def test_pivots_share_no_letter_and_weigh_least():
    rng = random.Random(5)
    for _ in range(300):
        prefix = [(i, rng.randint(1, 9)) for i in rng.sample(range(12), rng.randint(3, 7))]
        a, b = spelling.pivots(prefix)
        weight = dict(prefix)
        least = min(weight[x] + weight[y] for x in weight for y in weight if y - x >= 2)
        assert b - a >= 2 and weight[a] + weight[b] == least
