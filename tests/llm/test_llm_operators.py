"""Corpus operators against plain Python, and on nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from opsframe.llm import graph, lines, packing, pieces, pii, search, simhash, sketches, token_files, toxicity, urls
from opsframe.llm.common import SHUFFLE_CLEANUP, written
from opsframe.session import scratch_dir

WORDS = [f"w{c}{d}" for c in "abcdefgh" for d in "xyz"] + ["the", "of", "Über", "été"]
WORD_TOKENIZER, PIECE_MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts(n=120, seed=5):
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(1, 60)) for _ in range(n)]
    for i in range(0, n, 10):  # exact and near copies
        out[i + 1] = out[i]
        out[i + 2] = out[i] + " " + rng.choice(WORDS)
    return out


def doc_frame(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    return doc_frame(spark, [(i, t, f"s{i % 3 if i % 2 else 0}") for i, t in enumerate(texts())]).repartition(5)


@pytest.fixture(scope="module")
def odd(spark):
    """Null in every column, empty, blank and long texts, repeated rows, and column names operators use inside."""
    long_text = " ".join(f"long{i} word" for i in range(30000))
    rows = [(None, "no id here", None, 1), (None, None, "s", 2), (1, None, "s", 3), (2, "", None, 4), (3, "  \n ", "s", 5), (4, long_text, "s", 6),
            (5, "same text here twice", "s", 7), (5, "same text here twice", "s", 7), (6, "same text here twice", "t", None), (7, "x" * 50000, "s", 8)]
    names = ["doc", "dropped", "_row", "key", "fp", "root", "component_id", "score", "range", "bin_id", "ids", "_kept_id", "shard"]
    return doc_frame(spark, [(*r, *[r[3]] * (len(names) - 1)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))


def rows_of(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)


def empty(df):
    return df.where("false")


# 1 search


def bm25(corpus, query, k):
    terms = [(i, Counter(re.findall(r"\w+", (t or "").lower()))) for i, t in corpus]
    n, mean = len(terms), sum(sum(c.values()) for _, c in terms) / len(terms)
    df = Counter(w for _, c in terms for w in c)
    out = []
    for i, c in terms:
        size = sum(c.values())
        s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean))
                for w, m in Counter(re.findall(r"\w+", query.lower())).items() if w in c)
        if s > 0:
            out.append((round(s, 8), i))
    return sorted(out, key=lambda x: (-x[0], x[1]))[:k]


def test_search_equals_brute_force(docs):
    corpus = rows_of(docs, "doc_id", "text")
    got = search.search(docs, docs.where("doc_id % 7 = 0"), k=4, shard=16, queries_at_once=5).collect()
    for i, t in corpus:
        if i % 7 == 0:
            mine = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == i)
            want = bm25(corpus, t, 4)
            assert [round(s, 6) for _, _, s in mine] == [round(s, 6) for s, _ in want]
            assert [d for _, d, _ in mine] == [d for _, d in want]


def test_queries_are_neither_collected_nor_broadcast(docs, spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("queries in the driver")

    monkeypatch.setattr(type(docs), "toPandas", refuse)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    monkeypatch.setattr(search, "TERMS", 200)  # long queries make blocks of their own
    few = search.search(docs, docs.where("doc_id % 7 = 0"), k=4, shard=16, queries_at_once=1000).collect()
    monkeypatch.undo()
    want = search.search(docs, docs.where("doc_id % 7 = 0"), k=4).collect()
    short = lambda rows: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in rows)
    assert short(few) == short(want)


def test_block_bounds_prune_without_loss():
    rng = np.random.default_rng(1)
    corpus = [" ".join(f"t{x}" for x in rng.zipf(1.5, 20) if x < 3000) + (" rare" if i == 700 else "") for i in range(900)]
    shard = search.Shard(search.index_shard(list(range(900)), corpus), search.Statistics(900, 20.0), block=8)
    place = int(np.searchsorted(shard.terms, search._signed_hash("rare")))
    common = int(np.searchsorted(shard.terms, search._signed_hash("t1")))
    ids, scores = shard.top(np.array([place, common]), np.array([9.0, 0.1]), 3)
    assert ids[0] == 700 and len(ids) == 3 and (np.diff(scores) <= 0).all()


def test_search_odd(odd):
    got = rows_of(search.search(odd, odd.where("doc_id >= 5"), k=3), "query_id", "rank", "doc_id")
    assert [g for g in got if g[0] == 6] == [(6, 1, 5), (6, 2, 5), (6, 3, 6)]
    assert not [g for g in got if g[0] in (1, 2, 3)]
    assert search.search(empty(odd), odd).count() == 0 and search.search(odd, empty(odd)).count() == 0


# 2 lines


def template_keys(line):
    tokens = re.sub(r"\s+", " ", re.sub(r"\S*[0-9]\S*", "*", line)).strip(" ").split(" ")
    n = len(tokens)
    if n < 3:
        return []
    width = -(-(n - 2) // 4)
    runs = [tuple(tokens[2 + i * width:2 + (i + 1) * width]) for i in range(4)]
    leaf = (n, tokens[0], tokens[1])
    return [(leaf, None, tuple(runs))] + ([(leaf, i, tuple(runs[:i] + runs[i + 1:])) for i in range(4)] if n >= 10 else [])


def dedup_lines(corpus):
    first = {}
    for i, t in corpus:
        for line in (t or "").split("\n"):
            for key in template_keys(line):
                first.setdefault(key, i)
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if all(first[k] == i for k in template_keys(x)))) for i, t in corpus]


def test_lines_equal_plain_python(spark):
    rng = random.Random(2)
    common = [prose(rng, n) for n in (2, 4, 12, 60)]
    corpus = []
    for i in range(80):
        ls = [prose(rng, 15), rng.choice(common), f"Posted by {rng.choice(WORDS)} on day {i} of the long and happy year {i}", "short"]
        corpus.append((i, "\n".join(rng.sample(ls, 4))))
    df = doc_frame(spark, [(i, t, "s") for i, t in corpus]).repartition(4)
    got = rows_of(lines.drop_recurring(df), "doc_id", "text")
    assert got == sorted(dedup_lines(corpus), key=repr)
    assert sum(common[3] in t for _, t in got) == 1  # a passage of 60 words stays once
    assert sum("Posted by" in t for _, t in got) == 1 and sum("short" in t for _, t in got) == 80


def test_lines_odd(odd):
    out = lines.drop_recurring(odd, report="gone")
    assert out.columns == odd.columns + ["gone"] and out.count() == odd.count()
    got = {(r["doc_id"], r["doc"]): r["text"] for r in out.collect()}
    assert got[(5, 7)] == "same text here twice" and got[(6, None)] == "" and got[(1, 3)] is None and got[(3, 5)] == "  \n "
    assert lines.drop_recurring(empty(odd)).count() == 0
    assert lines.drop_recurring(odd, min_docs=3).where("doc_id = 6").first()["text"] == "same text here twice"


# 3 packing


def check_bins(rows, capacity, conflicts):
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
    for members in bins.values():
        members.sort(key=lambda r: r["bin_start"])
        at = 0
        for r in members:
            assert r["bin_start"] == at
            at += r["n_tokens"]
        assert at <= capacity
        for kind in conflicts:
            seen = [kind(r) for r in members if kind(r) is not None]
            assert len(seen) == len(set(seen))
    return bins


def best_fit(items, capacity):
    """Plain best fit over (size, source, cluster) in order: bin of each item."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and source not in b["has"] and ("c", cluster) not in b["has"]]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "has": set()})
        bins[k]["left"] -= size
        bins[k]["has"] |= {source, ("c", cluster)}
        out.append(k)
    return out


def test_bins_equal_plain_best_fit():
    rng = random.Random(4)
    items = sorted([(rng.randint(1, 40), rng.choice("aaabcdef"), rng.randint(0, 60)) for _ in range(400)], key=lambda x: -x[0])
    bins = packing.Bins(50)
    got = [bins.place(s, a, c)[0] for s, a, c in items]
    assert got == best_fit(items, 50)


def test_packing_keeps_every_word(docs):
    corpus = dict(rows_of(docs, "doc_id", "text"))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    rows = packing.pack(docs, capacity=32, keep_text=True).collect()
    check_bins(rows, 32, [lambda r: source[r["doc_id"]], lambda r: corpus[r["doc_id"]].lower()])
    for i, t in corpus.items():
        mine = sorted((r["piece"], r["start"], r["end"], r["text"]) for r in rows if r["doc_id"] == i)
        assert "".join(m[3] for m in mine) == t and all(t[a:b] == x for _, a, b, x in mine)


def test_packing_odd(odd):
    rows = packing.pack(odd, capacity=512, keep_text=True).collect()
    check_bins(rows, 512, [])
    assert sum(r["n_tokens"] - 1 for r in rows if r["doc_id"] == 4) == 60000
    assert sorted(r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)) == [1, 1, 1] and len([r for r in rows if r["doc_id"] == 5]) == 2
    assert packing.pack(empty(odd)).count() == 0
    assert packing.cut("", 5) == [(0, 0, 0)] and packing.cut(" a b  c", 2) == [(0, 6, 2), (6, 7, 1)]


# 4 urls

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/")]


def test_url_rules_and_templates(spark):
    rows = [("http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/"), ("https://b.example.com/en/2", "b.example.com", "/en/2", "example.com/en/"),
            ("http://notexample.com/en/3", "notexample.com", "/en/3", "com/"), ("http://a.com", "a.com", "", None), ("x", "", "", None), (None, "", "", None),
            ("a://b.org?c://d/e", "b.org", "", None), ("http://É.org/a#b?c", "É.org", "/a", None)]
    df = spark.createDataFrame([(i, r[0], i) for i, r in enumerate(rows)], "page_id long, url string, hit int")
    got = {r["page_id"]: r for r in urls.judge(df, RULES).collect()}
    for i, (_, host, path, rule) in enumerate(rows):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
    assert got[1]["verdict"] == "block" and got[0]["verdict"] == "allow"
    assert urls.judge(df.where("false"), RULES).count() == 0


def plain_judge(pages, rules):
    """Verdict and purity of every (id, url), counted in dictionaries."""
    rows, tree = [], {}
    for i, u in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]) if m else ("", "")
        fits = [(len(h + p), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        looks = [re.sub(urls.VARIABLE, lambda x: "*" + (x[1] or ""), x) for x in path.split("/") if x]
        rows.append((i, host, looks, max(fits)[1] if fits else None))
        for k, x in enumerate(looks):
            seen = tree.setdefault((host, tuple(looks[:k])), Counter())
            seen[x] += 1
    form = lambda host, looks: "/" + "/".join(
        "*" if len(c := tree[host, tuple(looks[:k])]) > 8 and c[x] < 0.05 * sum(c.values()) else x for k, x in enumerate(looks))
    count = Counter()
    for _, host, looks, v in rows:
        f = form(host, looks)
        for key in ((host, f), ("form", None, f), ("host", host)):
            count[key, v] += 1
    smooth = lambda key, prior: (count[key, "block"] + 4 * prior) / (count[key, "block"] + count[key, "allow"] + 4)
    out = {}
    for i, host, looks, v in rows:
        f = form(host, looks)
        p_host = smooth(("host", host), smooth(("form", None, f), 0.5))
        n, n_host = count[(host, f), "block"] + count[(host, f), "allow"], count[("host", host), "block"] + count[("host", host), "allow"]
        share = count[("host", host), "block"] / n_host if n_host else 0
        merged = n == 0 or share in (0, 1) or abs(count[(host, f), "block"] / n - share) / math.sqrt(share * (1 - share) / n) < 1.96
        p = p_host if merged else smooth((host, f), p_host)
        out[i] = (v or ("block" if p > 0.5 else "allow"), round(p, 9))
    return out


def test_verdicts_equal_plain_counts(spark):
    rng = random.Random(12)
    pages = []
    for i in range(900):
        host = rng.choice(["a.example.com", "b.net", "www.example.com", "c.org"]) if i % 3 else "hot.net"
        path = rng.choice(["/en/", "/es/", "/fr/x/", "/"]) + rng.choice([str(rng.randint(1, 99)), "p" + rng.choice(WORDS) + rng.choice("abcd"), "about.html", ""])
        pages.append((i, f"http://{host}{path}?q={i}"))
    rules = RULES + [("block", "net", "/es/"), ("block", "net", "/fr/"), ("allow", "net", "/en/1")]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()
    assert {r["page_id"]: (r["verdict"], round(r["purity"], 9)) for r in got} == plain_judge(pages, rules)


def test_purity_follows_labels(spark):
    rows = [(f"http://h.org/bad/{i}", 1) for i in range(40)] + [(f"http://h.org/good/{i}", 0) for i in range(40)]
    rows += [("http://h.org/bad/x9999", None), ("http://h.org/bad/777", None), ("http://h.org/good/888", None), ("http://new.org/bad/5", None)] * 2
    rows += [(f"http://w.org/{w}{v}/p", 0) for w in WORDS for v in "abcd"]
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id long, url string, y int")
    got = urls.judge(df, [], label=F.col("y")).collect()
    by = {(r["host"] + r["path"]): r for r in got}
    assert by["h.org/bad/777"]["verdict"] == "block" and by["h.org/good/888"]["verdict"] == "allow" and by["new.org/bad/5"]["verdict"] == "block"
    assert by["h.org/bad/777"]["template"] == "h.org/bad/*" and not by["h.org/bad/777"]["merged_branch"]
    assert {r["template"] for r in got if r["host"] == "w.org"} == {"w.org/*/p"} and len(got) == len(rows)


def test_unlabelled_branches_are_unknown_and_siblings_merge(spark):
    rows = [(f"http://h.net/{b}/{i}", y) for b, n, y in (("es", 30, 1), ("fr", 30, 1), ("ok", 30, 0), ("en", 30, None)) for i in range(n)]
    rows += [(f"http://k.org/en/{i}", 0) for i in range(9)] + [("http://n.net/es/1", 1), ("http://n.net/de/1", None)]
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id long, url string, y int")
    by = {r["template"]: r for r in urls.judge(df, [], label=F.col("y"), siblings=True).collect()}
    assert by["h.net/es/*"]["merged_branch"] and by["h.net/fr/*"]["merged_branch"] and not by["h.net/ok/*"]["merged_branch"]
    assert by["h.net/en/*"]["purity"] < 0.5 and by["h.net/en/*"]["verdict"] == "allow" and not by["h.net/en/*"]["merged_branch"]
    assert [by[f"h.net/{b}/*"]["verdict"] for b in ("es", "fr", "ok")] == ["block", "block", "allow"]
    rules = [("block", "net", "/es/"), ("block", "net", "/fr/"), ("allow", "org", "/")]
    seen = {r["template"]: r for r in urls.judge(df, rules, siblings=True).collect()}
    assert seen["h.net/en/*"]["verdict"] == "allow" and seen["h.net/es/*"]["verdict"] == "block"
    # two alike, one apart; merged counts are shared
    assert urls.merge_siblings([("/b", True, 9, 1), ("/a", True, 10, 0), ("/c", False, 1, 30)], 1.96) == [
        ("/c", False, 1, 30, False), ("/b", True, 19, 1, True), ("/a", True, 19, 1, True)]


# 5 pieces


def test_pieces_equal_library_and_round_trip(spark, odd):
    import sentencepiece

    rng, alphabet = random.Random(1), "aBe.,' \n\té▁ 0(nt)😀 theing"
    xs = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [" " * k + "x" + " " * (40 - k) for k in range(40)] + texts()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    mine = pieces.Pieces(PIECE_MODEL)
    ids = mine.encode(xs)
    assert ids == library.encode(xs)
    assert [mine.decode(i) for i in ids] == [x.replace("▁", " ") for x in xs]
    back = pieces.decode(pieces.encode(odd, PIECE_MODEL), PIECE_MODEL)
    assert rows_of(back, "doc_id", "text") == rows_of(odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    assert pieces.encode(empty(odd), PIECE_MODEL).count() == 0


def pieces_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def test_units_end_at_punctuation_that_no_piece_joins(monkeypatch):
    mine, matched = pieces.Pieces(PIECE_MODEL), []
    match = mine._match
    monkeypatch.setattr(mine, "_match", lambda units: (matched.extend(units), match(units)))
    text = "x zorgat zorgat, zorgat. (zorgat) zorgat-zorgat zorgat².» «zorgat” zorgat…"
    assert mine.encode([text]) == [pieces_library().encode(text)]
    assert {u for u in matched if "zorgat" in u} == {"▁zorgat", "zorgat", "▁zorgat².»", "▁«zorgat”", "▁zorgat…"}
    joined = pieces.unit_pattern([*"ab.!", "a.", "▁b"])
    assert joined.findall("a.b▁!b▁▁a!b.a\n!a") == ["a.", "b", "▁!", "b", "▁▁a!", "b", ".a", "\n", "!a"]


def test_units_in_use_outlive_a_full_store_and_are_matched_in_parts(monkeypatch):
    monkeypatch.setattr(pieces, "CODES", 60)
    mine, matched = pieces.Pieces(PIECE_MODEL, limit=30), []
    match = mine._match
    monkeypatch.setattr(mine, "_match", lambda units: (matched.append(units), match(units)))
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["kept", "in use", "zorgat", f"rare{i}x"]) for _ in range(12)) for i in range(40)]
    library = pieces_library()
    for t in texts:
        assert mine.encode([t]) == [library.encode(t)]
    learned = Counter(u for units in matched for u in units)
    assert learned["▁zorgat"] == 1 and max(learned.values()) == 1
    assert all(sum(len(u) + 1 for u in units[:-1]) <= 60 for units in matched)


def test_pieces_stand_apart_as_merging_says():
    mine, rng = pieces.Pieces(PIECE_MODEL), random.Random(5)
    names = sorted(mine.id)
    short = [p for p in names if len(p) < 4]
    for _ in range(3000):
        some = rng.choice([names, short])
        x, y = rng.choice(some), rng.choice(some)
        assert mine.stand_apart(x, y) == (mine.merge(x + y) == [x, y])


def test_decoding_keeps_null_and_empty_ids(spark):
    got = pieces.decode(spark.createDataFrame([(1, None), (2, []), (3, pieces_library().encode("a  b\n"))], "doc_id long, ids array<int>").coalesce(1), PIECE_MODEL)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: None, 2: "", 3: "a  b\n"}


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    codes = rng.integers(1, 4, 300)
    s = pieces.suffix_array(codes, 16)
    keys = [tuple(codes[i:i + 16]) for i in s]
    assert keys == sorted(keys) and sorted(s) == list(range(300))


# 6 sketches


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_fingerprints_of_edits(docs):
    corpus = rows_of(docs, "doc_id", "text")
    got = {r["doc_id"]: r for r in sketches.fingerprint_edits(docs).collect()}
    for n, (i, t) in enumerate(sorted(corpus)):
        following = sorted(corpus)[(n + 1) % len(corpus)][1]
        half = len(t) // 2
        new = t[:len(t) - half] + following[:half]
        a, b, c = shingles(t), shingles(new), shingles(following)
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["n_shingles"] == len(a)  # below 128: exact
        assert got[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and got[i]["near_next"] == pytest.approx(len(a & c) / len(a | c))


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(3)
    a, b = prose(rng, 3000), prose(rng, 3000)
    df = spark.createDataFrame([("x", a), ("x", b), ("y", a), (None, None)], "g string, text string").withColumn("sketch", sketches.sketch(F.col("text")))
    whole_group = {r["g"]: r["sketch"] for r in sketches.merge_groups(df, "g").collect()}
    parts = df.where("g = 'x'").collect()
    assert whole_group["x"] == sorted(set(parts[0]["sketch"]) | set(parts[1]["sketch"]))[:128]
    row = spark.createDataFrame([(whole_group["x"], whole_group["y"])], "a array<long>, b array<long>").select(
        sketches.resemblance(F.col("a"), F.col("b")).alias("r"), sketches.containment(F.col("b"), F.col("a")).alias("c"), sketches.distinct_shingles(F.col("a")).alias("n")).first()
    assert abs(row["r"] - 0.5) < 0.15 and row["c"] > 0.8 and abs(row["n"] / 5992 - 1) < 0.25


def test_fingerprints_odd(odd, spark):
    got = sketches.fingerprint_edits(odd).collect()
    assert len(got) == odd.count()
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    assert by[(2, 0)]["fingerprint"] == "" == by[(3, 4)]["fingerprint"] and by[(2, 0)]["near_next"] == 1.0
    assert by[(7, 50000)]["edited_sha256"] == hashlib.sha256(("x" * 25000).encode()).hexdigest()  # the first row's text is empty
    assert sketches.fingerprint_edits(empty(odd)).count() == 0
    one = sketches.fingerprint_edits(odd.where("doc_id = 6")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"same text same text ").hexdigest() and one["near_next"] == 1.0


# 7 token files


def test_token_files_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_TOKENIZER)
    for frame in (docs, odd):
        path = f"{scratch_dir(spark)}/tokens"
        token_files.write_tokens(frame, path, WORD_TOKENIZER)
        rows = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
        start, want = 0, []
        for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
            ids = np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4")
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = token_files.token_digest(token_files.read_tokens(spark, path))
        assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == want
    assert {r["doc_id"] for r in token_files.read_tokens(spark, path, [4, 6]).collect()} == {4, 6}
    token_files.write_tokens(empty(odd), path, WORD_TOKENIZER)
    assert token_files.token_digest(token_files.read_tokens(spark, path)).count() == 0


def test_chunk_encoder_equals_library():
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(WORD_TOKENIZER), token_files.ChunkEncoder(WORD_TOKENIZER, limit=20000)
    rng, alphabet = random.Random(1), "aB.,'s \n\téÉİΣσI\u0301<|endoftext|>\x1c\u2028 1٠%😀"
    for _ in range(4000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        x += rng.choice(["", "", "<|endoftext|>", "<|STARTOFTEXT|>."])
        assert mine.encode(x) == np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)


def test_texts_with_dotted_i_and_words_before_punctuation(monkeypatch):
    from tokenizers import Tokenizer

    library, mine, learned = Tokenizer.from_file(WORD_TOKENIZER), token_files.ChunkEncoder(WORD_TOKENIZER), []
    learn = mine._learn
    monkeypatch.setattr(mine, "_learn", lambda chunks: (learned.extend(chunks), learn(chunks)))
    xs = ["K’ <İ\u094d् ;b. ", "", "Zorgat zorgat, zorgat. (zorgat) zorgat...", "\t \r\n", "zorgat,<|endoftext|> É. é,", "x"]
    monkeypatch.setattr(token_files, "CHARS", 30)
    assert mine.encode_all(xs) == [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in xs]
    assert mine.encode_all([]) == []
    assert not {"zorgat.", "zorgat..."} & set(learned) and learned.count("zorgat") == 1


def test_every_character_before_punctuation_equals_the_library():
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(WORD_TOKENIZER), token_files.ChunkEncoder(WORD_TOKENIZER)
    assert mine.chunked
    characters = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    for end in (",", ".", "'", "###"):
        texts = [c + end for c in characters]
        for text, got, want in zip(texts, mine.encode_all(texts), library.encode_batch(texts, add_special_tokens=False)):
            assert got == np.array(want.ids, "<u4").tobytes(), repr(text)


def test_chunks_in_use_outlive_a_full_store():
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(WORD_TOKENIZER), token_files.ChunkEncoder(WORD_TOKENIZER, limit=20_000)
    rng = random.Random(2)
    for _ in range(40):
        texts = [" ".join(f"w{rng.randrange(3000)}ord, {rng.choice(WORDS)}" for _ in range(20)) for _ in range(5)] + [""]
        assert mine.encode_all(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert mine.older and len(mine.known) < 2000


def test_a_large_vocabulary_is_encoded_once(monkeypatch):
    mine, asked = token_files.ChunkEncoder(WORD_TOKENIZER), []
    ids = mine._ids
    monkeypatch.setattr(mine, "_ids", lambda words: asked.append(len(words)) or ids(words))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:17]]  # 298,792
    texts = [" ".join(words[i:i + 2000]) for i in range(0, len(words), 2000)]
    first = mine.encode_all(texts[:75]) + mine.encode_all(texts[75:])
    assert sum(asked) == len(words)
    assert mine.encode_all(texts[:75]) + mine.encode_all(texts[75:]) == first and sum(asked) == len(words)


def test_vocabularies_without_the_chunks_properties_encode_whole_texts():
    mine = token_files.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not mine.chunked
    text = "It's two  words, and\nMORE.\t"
    assert mine.encode(text) == np.array(mine.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_lookup_reads_few_row_groups(spark):
    path = f"{scratch_dir(spark)}/tokens"
    docs = spark.range(0, 20_000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    token_files.write_tokens(docs.coalesce(1), path, WORD_TOKENIZER, row_group=1024)
    found = token_files.read_tokens(spark, path, [77, 15_000])
    assert {r["doc_id"] for r in found.collect()} == {77, 15_000}
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    while scan.nodeName().startswith(("WholeStage", "InputAdapter", "AdaptiveSpark")):
        scan = scan.children().head()
    assert scan.metrics().apply("numOutputRows").value() <= 2 * 4096  # of 20,000


# 8 toxicity


def toxic_corpus(n=900):
    rng, out = random.Random(8), []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 200))]
        bad = i % 6 == 0
        for _ in range(rng.randint(2, 4) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["zorgat", "blimpo"]) + rng.choice(["", "ing", "ed", "er"])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, toxicity.fold(F.col("doc_id")) != 1)
    got = {r["doc_id"]: r["score"] for r in model.score(df).collect()}
    held = [(got[i] >= 0.7, bool(y)) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    kept = model.keep_below(df, 0.7)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.7}


def test_evidence_of_small_models(spark):
    labelled = spark.createDataFrame([(1, "abc abd xyz xyz"), (0, "abc abe abf zzz zzz")], "toxic int, text string")
    top = toxicity.gram_counts(toxicity.word_counts(labelled))
    p = toxicity.shared_backoff(top).collect()
    assert p and all(0 < r["p"] < 1 for r in p)
    model = toxicity.fit_evidence(labelled)
    x, a, e = model.words(["xyz", "abc", "zzz"])
    assert x > a > e


def test_evidence_of_every_counted_ngram_is_kept(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(400)]
    rows = [(i % 2, " ".join(words[i::2] * 2)) for i in range(2)]
    labelled = spark.createDataFrame(rows, "toxic int, text string")
    each = toxicity.fit_evidence(labelled).words(words)
    assert all((x < 0) if i % 2 == 0 else (x > 0) for i, x in enumerate(each))


def test_ngrams_seen_once_are_evidence(spark):
    rows = [(1, "stone stone zorgat"), (0, "stone stone river")]
    labelled = spark.createDataFrame(rows, "toxic int, text string")
    model = toxicity.fit_evidence(labelled)
    bad, good = model.words(["zorgat", "river"])
    assert bad > 1 and good < -1  # each occurs once
    top = toxicity.gram_counts(toxicity.word_counts(labelled)).select("last", "context")
    assert {(g, r["context"]) for r in model.table.collect() for g in r["grams"]} == {tuple(r) for r in top.collect()}


def plain_evidence(counts, words, top=12, shared=5, discount=0.75):
    """Kneser-Ney by dictionaries: class counts at the top, shared continuation counts below."""
    grams = lambda w: [("\x02" * (top - 1) + w + "\x03")[i:i + top] for i in range(len(w) + 1)]
    by_class = [Counter(), Counter()]
    for (w, label), n in counts.items():
        for g in grams(w):
            by_class[label][g] += n
    level = {shared: Counter(g[-shared:] for g in {*by_class[0], *by_class[1]})}
    for k in range(shared - 1, 0, -1):
        level[k] = Counter(s[1:] for s in level[k + 1])

    def p(s):
        same = [n for t, n in level[len(s)].items() if t[:-1] == s[:-1]]
        below = p(s[1:]) if len(s) > 1 else 1 / (len(same) + 1)
        return max(level[len(s)][s] - discount, 0) / sum(same) + discount * len(same) / sum(same) * below

    def left(c, context):
        same = [n for g, n in by_class[c].items() if g[:-1] == context]
        return (discount * len(same) / sum(same), sum(same)) if same else (1.0, 0)

    def one(g):
        (lt, nt), (lo, no) = left(1, g[:-1]), left(0, g[:-1])
        if not nt and not no:
            return 0.0
        if g not in by_class[0] and g not in by_class[1]:
            return math.log(lt / lo)
        prob = lambda c, rest, n: (max(by_class[c][g] - discount, 0) / n if n else 0.0) + rest * p(g[-shared:])
        return math.log(prob(1, lt, nt) / prob(0, lo, no))

    return [sum(map(one, grams(w))) * min(1.0, 24 / len(w)) for w in words]


def test_evidence_equals_plain_kneser_ney(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 16))) for _ in range(60)] + ["ab" * 20, "abab" * 8]
    words = sorted(set(words))
    texts = [(rng.randint(0, 1), " ".join(rng.choice(words[::2]) for _ in range(30))) for _ in range(12)]
    counts = Counter((w, y) for y, t in texts for w in t.split())
    model = toxicity.fit_evidence(spark.createDataFrame(texts, "toxic int, text string"))
    assert np.allclose(model.words(words + ["中文", "zz"]), plain_evidence(counts, words + ["中文", "zz"]), atol=1e-9)


def test_batch_features_equal_counts_by_document():
    row, times, value = np.array([0, 0, 2, 2, 2, 2]), np.array([5, 1, 1, 2, 1, 1]), np.array([-1.0, 2.0, 0.5, 3.0, -2.0, 1.0])
    n_words, x = toxicity.batch_features(row, times, value, 3)
    assert n_words.tolist() == [6, 0, 5]
    assert np.allclose(x, [[-0.5, 2, -1, -1, math.log(6)], [0, 0, 0, 0, 0], [1.1, 3, 3, 1, math.log(5)]])


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if f.rsplit("/", 1)[-1].startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    got = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffle_files(spark) - before and got.count() == 7
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"


def test_words_values_return_to_their_batches(spark):
    texts = ["stone zorgat zorgat", "", "river stone", "zorgat", None, "unknown", "stone stone river", "river"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    model = toxicity.fit_evidence(spark.createDataFrame([(1, "stone zorgat"), (0, "stone river")], "toxic int, text string"))
    lines = toxicity.postings(docs, "doc_id", size=3).collect()
    assert max(len(r["ids"]) for r in lines) == 3 and sorted(i for r in lines for i in r["ids"]) == list(range(8))
    assert all(len(set(r["words"])) == len(r["words"]) for r in lines)
    names = ["stone", "zorgat", "river", "unknown"]
    value = dict(zip(names, model.words(names)))
    for r in toxicity.features(docs, model, "doc_id").collect():
        words = (texts[r["doc_id"]] or "").split()
        top = sorted((value[w] for w in words), reverse=True)[:3]
        mean = sum(value[w] for w in words) / max(1, len(words))
        assert r["n_words"] == len(words) and np.allclose([r["mean_evidence"], r["top_1"], r["top_2"], r["top_3"]], [mean, *top, *[0] * (3 - len(top))])


def test_toxicity_odd(odd, spark):
    labels = spark.createDataFrame([(4, 0), (5, 1), (5, 0)], "doc_id long, toxic int")
    for known in (labels, labels.where("false")):
        model = toxicity.train(odd, known)
        got = model.score(odd).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["n_words"] == 0}) == 1
        assert model.score(empty(odd)).count() == 0 and model.keep_below(empty(odd), 0.7).count() == 0


# 9 simhash


def test_simhash_components_equal_brute_force(docs):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).select("*", simhash.hex_digits().alias("hex")).collect()}
    import xxhash

    prints = {}
    for i, t in rows_of(docs, "doc_id", "text"):
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        sh = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints[i] = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
        assert got[i]["hex"] == f"{prints[i]:016x}"
    root = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[root[i]] == root[i] for i in root):
            break
    assert {i: r["component_id"] for i, r in got.items()} == root


def test_every_pair_within_radius_meets(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    moved = []
    for b in base:
        for d in (1, 2, 3, 4):
            moved.append((b, b ^ sum(1 << k for k in rng.sample(range(64), d)), d))
    all_prints = {x for a, b, _ in moved for x in (a, b)}
    df = spark.createDataFrame([(simhash._signed(x),) for x in all_prints], "fp long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(df)).collect()}
    for a, b, d in moved:
        together = roots.get(simhash._signed(a), a) == roots.get(simhash._signed(b), b)
        assert together or d == 4


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 300)] + [(500, 500), (7, 6)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 300)}}


def test_simhash_odd(odd):
    got = rows_of(simhash.near_duplicates(odd), "doc_id", "component_id")
    assert got.count((5, 5)) == 2 and (6, 5) in got and (1, 1) in got and (2, 1) in got and (3, 1) in got and (None, 1) in got and (None, None) in got
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert rows_of(kept, "doc_id") == sorted([(None,), (1,), (4,), (5,), (7,)], key=repr)
    assert simhash.near_duplicates(empty(odd)).count() == 0 and simhash.keep_first(empty(odd)).count() == 0
    assert simhash.fingerprint(b"") == 0 and simhash.fingerprint(b" \t\x0b") == 0


# 10 personal data


def plain_spans(t):
    digits = lambda s: re.sub(r"\D", "", s)
    ok = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and ok(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(9)
    parts = ["a", "b.c", "@", "x@y.de", ".", "1", "10.0.0.1", "256", "..", "+1 (555) 010-9999", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", "_", "%", "é", "😀", "0" * 20, "00010.1.2.3"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_added_kinds_need_proof():
    kinds = lambda t: [(k, t[i:j]) for k, i, j, _ in pii.find_spans(t) if k in pii.ADDED]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 now") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("pay to DE89 3704 0044 0532 0130 01 now") == []
    assert kinds("my SSN is 123-45-6789.") == [("national_id", "123-45-6789")] and kinds("lot 123-45-6789.") == []
    assert kinds("call (555) 123-4567") == [("local_phone", "(555) 123-4567")] and kinds("order 555-123-4567") == []
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_iban_ends_before_what_follows():
    found = lambda t: [t[i:j] for k, i, j, _ in pii.find_spans(t) if k == "iban"]
    de, gb, no = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    spaced = "DE89 3704 0044 0532 0130 00"
    for iban, rest in ((de, " BIC COBADEFFXXX"), (spaced, " EUR 50"), (gb, " 2024"), (no, " A B C"), (gb, "."), (spaced, " Now")):
        assert found(f"IBAN {iban}{rest}") == [iban], rest
    assert found(f"AB12 {de} {gb} {no}") == [de, gb, no] and found(de + "X") == found("X" + de) == []
    assert found(de[:-1] + "1 EUR 50") == [] and found(de + "x") == []
    assert found("DE12 " * 50_000 + de) == [de] and found("AB12" * 50_000) == []


def test_masks_and_odd(odd, spark):
    assert pii.mask("write to a@b.de or +1 (555) 010-9999!") == "write to [EMAIL] or [PHONE]!"
    out = pii.redact(odd.withColumn("n_chars", F.lit(9).cast("long")))
    assert out.columns == odd.columns + ["n_chars"] and out.where("doc_id = 1").first()["text"] is None
    digest = pii.span_digest(pii.find(odd))
    assert digest.count() == odd.count() and digest.where("doc_id = 2").first()["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find(empty(odd)).count() == 0 and pii.redact(empty(odd)).count() == 0
    for worst in ("1" * 200000, "1." * 100000, "a@" * 100000, "a" * 200000 + "@", "+" + "1 " * 100000, "A1" * 100000):
        pii.find_spans(worst)
