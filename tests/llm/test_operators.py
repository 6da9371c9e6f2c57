import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweft.llm import chat_format, fingerprints, html_extraction, mixing, ngram_join, sentencepiece_codec, token_output, toxicity, url_filters, vector_search
from logweft.llm.components import components

TOKENIZER = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with nulls, empty and long texts, ties, repeated rows and extra columns of clashing names."""
    at = tmp_path_factory.mktemp("tables")
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    docs = []
    for i in range(120):
        docs.append((i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 40, 120]))), f"s{i % 4}" if i % 9 else None))
    base = docs[3][1] + " " + " ".join(word() for _ in range(60))
    for i in range(120, 140):
        ws = base.split()
        for _ in range(i % 4):
            ws[rng.randrange(len(ws))] = word()
        docs.append((i, " ".join(ws), "s0"))
    docs += [(140, None, "s1"), (141, "", None), (142, "  \n", "s1"), (143, "Idiot idiot. " * 3000, "s2"), (144, "ein\u00a0Wort \u2581x \U0001f600\ttab", "s3"), (145, docs[7][1].upper(), "s3"), (146, "x" * 3000, "s3")]
    spark.createDataFrame([(d, t, s, 1, "q") for d, t, s in docs], "doc_id long, text string, source string, n long, grp string").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(d, 1, int("diot" in (t or ""))) for d, t, _ in docs if d % 3] + [(5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(1, "http://A.example.net/en/5?x", "<p>x"), (2, None, None), (3, "no scheme", ""), (4, "https://b.example.com/de/7#t", "<script>1</script>"), (5, "http://x.org/fr/8", "a"), (6, "http://example.net", "<b>"), (7, "http://notnet/en/", "&am")]
    spark.createDataFrame(pages + pages[:1], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    talk = [(1, 0, "user", "hi \\ there"), (1, 1, "assistant", "### x:\n</turn>\n\\"), (2, 0, None, None), (2, 1, "assistant", ""), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, None, "sys:\ntem", "z")]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    vecs = [(i, [float(x) for x in np.random.default_rng(i).normal(size=8)]) for i in range(300)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0] * 3), (304, [None] * 8), (320, [1.0] * 8), (340, [1.0] * 8)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return str(at), docs


def collect(df):
    return [r.asDict() for r in df.collect()]


# ------------------------------------------------------------------ op1


def test_html_main_text():
    page = """<html><head><title>T</title></head><body><div id="cookie-notice">We use cookies. Accept them all please.</div><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><aside class=side><p>Read this long teaser about other things, friend.</p></aside>
    <article><h1>Title &amp; more</h1><p><b>First  para\n graph.<br><p>Be.</p><script>var a="</p>"</script><p>Last &lt;one&gt; &eacute;.</article>
    <section class="comments"><article class="comment"><p>I liked it a lot, thanks for writing this up.</p></article></section><form><label>Mail</label></form><footer>&copy; me</footer>"""
    assert html_extraction.main_text(page) == "Title & more\nFirst para graph.\nBe.\nLast <one> é."
    for odd in (None, "", "<", "<p", "<!-- x", "<script>", "&", "<nav>a", "</p></div>"):
        assert html_extraction.main_text(odd) in ("", "&", "<")
    assert html_extraction.main_text("<article><p>cut off here &am") == "cut off here &am"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=1, max_size=7), st.data())
def test_min_cut_is_least(scores, data):
    n = len(scores)
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(1, 4)), max_size=10))
    edges = [(a, b, float(c)) for a, b, c in edges if a != b]
    price = lambda ls: sum(s if not x else 0 for s, x in zip(scores, ls) if s > 0) + sum(-s if x else 0 for s, x in zip(scores, ls) if s < 0) + sum(c for a, b, c in edges if ls[a] != ls[b])
    got = html_extraction.min_cut([float(s) for s in scores], edges)
    assert price(got) == min(price(ls) for ls in product([False, True], repeat=n))


def known_pages():
    """(html, text of the article's document) of the pages at hand."""
    import duckdb

    rows = duckdb.sql("SELECT html, text FROM (SELECT *, regexp_extract(url, '://[^/]*/[^/]*/([0-9]+)', 1)::BIGINT AS d FROM '/root/testdata/sf0.1/pages.parquet') JOIN '/root/testdata/sf0.1/documents.parquet' ON doc_id = d ORDER BY page_id").fetchall()
    return rows


def test_the_cut_decides_on_real_pages():
    """Labels that the cut changes are right afterwards: all of the article, and nothing else."""
    changed = wrong = 0
    for page, _ in known_pages():
        parsed = html_extraction.parse(page)
        scores, _ = html_extraction.graph(parsed, html_extraction.WEIGHTS)
        for b, price, keep in zip(parsed.blocks, scores, html_extraction.labels(parsed), strict=False):
            k = b.element
            while k >= 0 and parsed.elements[k].name != "article":
                k = parsed.elements[k].parent
            changed += (price > 0) != keep
            wrong += (k >= 0) != keep
    assert changed > 500 and not wrong


def test_weights_are_those_of_the_fit():
    fitted = html_extraction.fit(known_pages()[: html_extraction.SAMPLE])
    assert np.allclose(np.concatenate(fitted), np.concatenate(html_extraction.WEIGHTS), atol=0.02)


def test_html_odd_pages():
    text = html_extraction.main_text
    assert text("<article><p>Some <math><mi>E</mi>=mc</math> in <svg><text>a</text></svg> it.</p><object>old way</object><canvas>drawn</canvas></article>") == "Some E=mc in a it.\nold way\ndrawn"
    assert text('<article><div class="tags-intro search-results"><p>This is a paragraph of the article, with words.</p></div></article>').startswith("This is")
    assert text('<body><div id="content"><h1>A heading</h1><p>One sentence of some length stands here, and it ends.</p><p>Short.</p><p>Another sentence of some length stands here, and it ends.</p></div><div class="comment-list"><article><p>I liked it a lot, thanks. Really, so much that I can not even say.</p></article></div></body>').split("\n")[1:3] == ["One sentence of some length stands here, and it ends.", "Short."]
    assert text("<p>a<p>b<div hidden>secret</div><noscript>no</noscript><select><option>1</select>") == "a\nb"
    assert text("<table><tr><td><a href=1>Home</a><td><a href=2>News</a></table><p>Only one paragraph here.</p>") == "Only one paragraph here."
    assert text('<article class="post with-sidebar has-comments"><div class="entry-content"><p>x y</p></div><section class="related-posts"><p>One story that you will like. Read it all now.</p></section></article>') == "x y"
    import time

    for page in ("<b>" * 50_000 + "</i>" * 50_000, "<p>" + "<b>" * 50_000 + "<h2>x<hr>" * 50_000, "<article>" + "<p>x</p>" * 30_000, "<div>" * 20_000 + "x"):
        start = time.perf_counter()
        text(page)
        assert time.perf_counter() - start < 30


def test_html_query(spark, folder):
    got = collect(html_extraction.op1_html_extraction(spark, folder[0]))
    assert len(got) == 8 and all(r["n_chars"] == len(r["text"]) for r in got)


# ------------------------------------------------------------------ op2


def test_vector_search(spark, folder):
    got = defaultdict(list)
    for r in vector_search.op2_vector_search(spark, folder[0]).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder[0]}/embeddings.parquet").collect() if r.embedding and len(r.embedding) == 8 and r.embedding[0] is not None and not np.isnan(r.embedding).any() and any(r.embedding)}
    hits = total = 0
    assert set(got) == {i for i in rows if i % 20 == 0}
    for q, found in got.items():
        exact = sorted(((-float(np.dot(rows[q], v)), i) for i, v in rows.items() if i != q))[:20]
        assert len(found) == 20 and all(abs(s - np.dot(rows[q], rows[i])) < 1e-12 for i, s in found)
        assert [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)
        hits, total = hits + len({i for _, i in exact} & {i for i, _ in found}), total + 20
    assert hits / total >= 0.9


def test_vector_sample_of_a_hot_id(spark, monkeypatch):
    hot = spark.range(400).orderBy(F.xxhash64("id")).first()[0]
    vecs = [(hot, [1.0, 0.0, 0.0, 0.0])] * 300 + [(i, [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(400)]
    seen = []
    graph = vector_search.neighbour_graph
    monkeypatch.setattr(vector_search, "MOST_SAMPLE", 128)
    monkeypatch.setattr(vector_search, "neighbour_graph", lambda x, k: seen.append(x) or graph(x, k))
    vector_search.learn(spark.createDataFrame(vecs, "id long, v array<double>").coalesce(1))
    assert len(np.unique(seen[0], axis=0)) == len(seen[0]) == 128


def recall(spark, rows, searched):
    """Of the searched rows' neighbours, against all inner products."""
    x = np.array([r.embedding for r in rows], np.float64)
    ids = np.array([r.vec_id for r in rows])
    hits = total = 0
    for q, found in searched.items():
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        hits, total = hits + len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & set(found)), total + 20
    return hits / total


def test_recall_and_share_searched(spark):
    """Random directions need many parts, clusters few; neither is searched whole."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    near = [(i, (centres[i % 60] + 0.2 * rng.normal(size=16)).tolist()) for i in range(6000)]
    for df, most in ((spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 0.8), (spark.createDataFrame(near, "vec_id long, embedding array<double>").repartition(4), 0.2)):
        is_query = F.col("vec_id") % 20 == 0
        found = defaultdict(list)
        for r in vector_search.search(df, is_query).collect():
            found[r.query_id].append(r.vec_id)
        assert recall(spark, df.select("vec_id", "embedding").collect(), found) >= 0.9
        assert vector_search.searched_share(df, is_query) < most


def test_a_repeated_query_is_one(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    found = vector_search.search(spark.createDataFrame(vecs + [vecs[20]] * 300, "vec_id long, embedding array<double>"), F.col("vec_id") == 20).collect()
    assert len(found) == 20 == len({r.vec_id for r in found}) and sorted(r["rank"] for r in found) == list(range(1, 21))


def test_partition_is_balanced():
    x = np.random.default_rng(1).normal(size=(256, 6))
    part = vector_search.partition(vector_search.neighbour_graph(x, 8), 3)
    assert max(Counter(part.tolist()).values()) - min(Counter(part.tolist()).values()) <= 1


# ------------------------------------------------------------------ op3

PIECES = [("<unk>", 0.0, "other"), *((f"<0x{b:02X}>", -50.0, "byte") for b in range(256)), ("▁", -3.0, "text"), ("a", -2.0, "text"), ("b", -2.5, "text"), ("ab", -3.0, "text"), ("▁a", -2.2, "text"), ("bab", -4.4, "text"), ("▁▁", -5.0, "text"), ("é", -4.0, "text")]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab é▁\n\U0001f600x", max_size=9), min_size=1, max_size=4))
def test_viterbi_is_best_and_lossless(texts):
    v = sentencepiece_codec.Vocabulary.build(PIECES, 0)
    codec = sentencepiece_codec.Codec(v)
    scores = {t: s for t, s, k in PIECES if k == "text"}
    lost = min(s for _, s, _ in PIECES) - sentencepiece_codec.UNKNOWN
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        assert codec.decode(ids) == text
        if "▁" in text or not text:
            continue
        s = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-1e18] * len(s)
        for e in range(1, len(s) + 1):
            best[e] = max(max((best[e - n] + scores[s[e - n : e]] for n in range(1, min(4, e) + 1) if s[e - n : e] in scores), default=-1e18), best[e - 1] + lost if s[e - 1] not in scores else -1e18)
        own = sum(PIECES[i][1] for i in ids if i > 256) + lost * sum(1 for c in s if c not in scores)
        assert own == pytest.approx(best[-1])


def test_codec_against_the_library():
    """The library's own Viterbi works in single precision over whole texts: never better, and equal on short ones."""
    import public_tokenizers
    import sentencepiece

    raw = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    at = raw.rfind(b"\x18\x02")
    try:
        ref = sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x18\x01" + raw[at + 2 :])
    except RuntimeError:
        pytest.skip("the model's type can't be changed here")
    v = sentencepiece_codec.default_vocabulary()
    codec = sentencepiece_codec.Codec(v)
    for t in ["hello world", "The quick brown fox", "naïve café", "x"]:
        assert v.scores[codec.encode_batch([t])[0]].sum() >= v.scores[ref.encode(t)].sum() - 1e-6


def test_sentencepiece_query(spark, folder):
    got = {r["doc_id"]: r for r in collect(sentencepiece_codec.op3_sentencepiece(spark, folder[0]))}
    for d, t, _ in folder[1]:
        assert got[d]["lossless"] and got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


# ------------------------------------------------------------------ op4, op9, op10


def sql_rows(folder, sql, *tables):
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    return sorted(repr([(n, round(v, 6) if isinstance(v, float) else v) for n, v in sorted(zip(names, row, strict=True))]) for row in r.fetchall())


def spark_rows(df):
    return sorted(repr([(n, round(v, 6) if isinstance(v, float) else v) for n, v in sorted(r.asDict().items())]) for r in df.collect())


def test_url_filters(spark, folder):
    df = url_filters.op4_url_filters(spark, folder[0])
    assert spark_rows(df) == sql_rows(folder[0], url_filters.SQL, "pages", "labels")
    got = {r.page_id: r for r in df.collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/5", "example.net/en/", "allow")
    assert (got[4].rule, got[5].rule, got[6].rule, got[7].rule) == ("example.com/de/", "org/fr/", None, None)
    assert (got[2].host, got[2].path, got[3].host) == ("", "", "")


def test_a_bad_host_is_blocked(spark):
    """Hosts of their own outcomes, domains without any, an address, and clashing names."""
    good = [("fine.example.com", 1)] * 300 + [("new.example.com", 1)] * 3 + [("bad.spam.example", 0)] * 300 + [("other.spam.example", 0)] * 200 + [("10.0.0.7", 0)] * 200 + [("news.fine.co.uk", 1)] * 300
    outcomes = spark.createDataFrame(good + [("fine.example.com", None)], "__host string, good int")
    urls = ["http://fine.example.com/a", "http://bad.spam.example/a", "http://third.spam.example/", "http://10.0.0.7/x", "http://10.0.0.7:80/y", "http://8.8.8.7/", "http://www.fine.co.uk/", None]
    pages = spark.createDataFrame([(i, u, "h", i) for i, u in enumerate(urls)], "page_id long, url string, host string, __host long")
    got = {r.page_id: r for r in url_filters.judge(pages, outcomes).collect()}
    assert [got[i].verdict for i in range(8)] == ["allow", "block", "block", "block", "block", got[5].verdict, "allow", got[7].verdict]
    assert got[1].host == "h" and got[1].host_1 == "bad.spam.example" and got[1]["__host"] == 1
    # The chain by hand: each level pulled to the one above by the weight that the moments give.
    p = sum(y for _, y in good) / len(good)

    def weight(groups):
        n, k = sum(x for x, _ in groups), len(groups)
        spread = (sum(y * y / x for x, y in groups) - sum(y for _, y in groups) ** 2 / n) / (p * (1 - p)) - (k - 1)
        rho = spread / (n - sum(x * x for x, _ in groups) / n - (k - 1))
        return max(2.0, min(1000.0, (1 - rho) / rho)) if rho > 0 else 1000.0

    domain = {"fine.example.com": "example.com", "new.example.com": "example.com", "bad.spam.example": "spam.example", "other.spam.example": "spam.example", "10.0.0.7": "10.0.0.7", "news.fine.co.uk": "fine.co.uk"}
    suffix = {"example.com": "com", "spam.example": "example", "10.0.0.7": "10.0.0.7", "fine.co.uk": "co.uk"}
    counts = [defaultdict(lambda: [0, 0]) for _ in range(3)]
    for h, y in good:
        for c, key in zip(counts, (h, domain[h], suffix[domain[h]]), strict=True):
            c[key][0] += 1
            c[key][1] += y
    w = [weight(list(c.values())) for c in counts]
    m = p
    for c, key, k in ((counts[2], "example", w[2]), (counts[1], "spam.example", w[1]), (counts[0], "bad.spam.example", w[0])):
        m = (k * m + c[key][1]) / (k + c[key][0])
    assert got[1].mean == pytest.approx(m)


def test_mixing(spark, folder):
    df = mixing.op9_mixing(spark, folder[0])
    assert spark_rows(df) == sql_rows(folder[0], mixing.SQL, "documents")
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in folder[1]}
    for r in df.collect():
        assert r["size"] == sizes[r.doc_id] and r.taken in (0, r["size"], 2 * r["size"]) and r.target <= 2 * r.source_size
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0


def test_chat_format(spark, folder):
    got = {r.conv_id: r for r in chat_format.op10_chat_format(spark, folder[0]).collect()}
    assert set(got) == {1, 2, 3, -7} and [got[k].n_turns for k in (1, 2, 3, -7)] == [2, 2, 3, 2]
    assert spark_rows(chat_format.op10_chat_format(spark, folder[0]).filter("conv_id <> 3")) == [r for r in sql_rows(folder[0], chat_format.SQL, "conversations") if "('conv_id', 3)" not in r]
    assert got[3].loss_sha256 == hashlib.sha256(b"bb").hexdigest()


def test_reply_trees(spark):
    rows = [(1, 0, None, 0.0, "user", "q"), (1, 1, 0, 0.2, "assistant", "bad"), (1, 2, 0, 0.9, "assistant", "good"), (1, 3, 2, 0.1, "user", "more"), (1, 4, 99, 0.0, "user", "lost parent")]
    nodes = spark.createDataFrame(rows, "conv_id long, __id long, __parent long, __score double, role string, text string")
    formatted = lambda df, keep: sorted((r.path, r.seq, chat_format.parse(r.segment)[0][1]) for r in chat_format.format_turns(df, keep)[0].collect())
    want = [(1, 0, "q"), (1, 1, "good"), (1, 2, "more"), (2, 0, "q"), (2, 1, "bad")]
    assert formatted(nodes, 2) == want
    again = spark.createDataFrame(rows * 2 + [(1, 1, 0, 0.2, "assistant", "worse")], nodes.schema)
    assert formatted(chat_format.unique(again), 2) == want
    cycle = spark.createDataFrame([(1, 0, 1, 0.0, "user", "a"), (1, 1, 0, 0.0, "user", "b"), (2, 0, None, 0.0, "user", "c")], nodes.schema)
    with pytest.raises(ValueError):
        chat_format.format_turns(cycle)


def test_best_paths_against_all_paths(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for conv in range(6):
        parent = {i: rng.randrange(i) if i and rng.random() < 0.9 else None for i in range(25)}
        score = {i: rng.randint(0, 4) / 4 for i in parent}

        def path(i, parent=parent):
            return [i] if parent[i] is None else [*path(parent[i]), i]

        leaves = [path(i) for i in parent if i not in parent.values()]
        leaves.sort(key=lambda p, score=score: (-sum(score[i] for i in p), -len(p), p[-1]))
        want[conv] = leaves[:3]
        rows += [(conv, i, parent[i], score[i]) for i in parent]
    got = defaultdict(list)
    found, _ = chat_format.best_paths(spark.createDataFrame(rows, "conv_id long, __id long, __parent long, __score double"), 3)
    for r in sorted(found.collect(), key=lambda r: (r.conv_id, r["__path"], r["__depth"])):
        got[r.conv_id, r["__path"]].append(r["__id"])
    assert got == {(c, k + 1): p for c, ps in want.items() for k, p in enumerate(ps)}


# ------------------------------------------------------------------ op5


def brute_components(docs):
    sets, parent = {}, {}
    for d, t, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in product(sets, sets):
        if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_ngram_join(spark, folder):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op5_ngram_join(spark, folder[0]).collect()}
    assert got == brute_components(folder[1])


def test_ngram_join_of_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(40)]
    a, b = " ".join(words), " ".join(words[:38] + ["x", "y"])
    rows = [(2, a), (5, "some other text of seven words"), (5, a), (None, b), (None, "lone text of these six words"), (9, None), (9, "  ")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(2, 36, 2), (5, 2, 5), (5, 36, 2), (0, 36, 2), (0, 2, 0), (9, 0, 9), (9, 0, 9)])


def test_ngram_join_with_a_hot_element(spark, monkeypatch):
    """A shingle that 2,000 sets begin with, of which only neighbours link; documents made of hot passages alone; parts
    that overflow, and elements that are spread over all parts."""
    for name, value in (("MEET", 500), ("HOT", 30), ("SPLIT", 50), ("FLUSH", 200)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = [(i, f"a b c d e p{i // 2} q{i // 2} r{i // 2} s{i // 2} " + "z" * (i % 2)) for i in range(2000)]
    passage = lambda k, n: " ".join(f"x{k}y{j}" for j in range(n))
    more = [(10_000 + 20 * i + j, f"{passage(i, 40)} {passage(j, 8 + i % 3)}") for i in range(20) for j in range(20)]
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in brute_of(rows + more).items()}


def brute_of(docs):
    """By an index of the elements: for sets that are too many for all pairs."""
    sets, at, parent = {}, defaultdict(list), {}
    for d, t in docs:
        w = t.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    groups = defaultdict(list)
    for d, s in sets.items():
        groups[frozenset(s)].append(d)
    kinds = list(groups)
    for k in kinds:
        for d in groups[k]:
            parent[d] = min(groups[k])
    for k in kinds:
        for e in k:
            at[e].append(k)
    for ks in at.values():
        for i, x in enumerate(ks):
            for y in ks[:i] if len(ks) < 1900 else ():  # the common first shingle, whose pairs share others if they link
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    a, b = find(groups[x][0]), find(groups[y][0])
                    parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 75)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    assert all(got[i] == 0 for i in range(31)) and got[100] == got[75] == got[50] == 50


# ------------------------------------------------------------------ op6


def test_fold_and_phrases():
    assert toxicity.fold("1D10T! \u0456di\u043et $tup1d id!ot x") == " idiot idiot tupid idiot x "
    model = toxicity.Model({" trash": {0: 5.0}}, (" trash can ",), (-3.0, 1.0, 1.0))
    s = toxicity.Scorer(model)
    assert s.score("you trash") > 0.7 > s.score("the trash can") and s.score(None) == s.score("") < 0.1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["trash", "trashy", "trasher", "can", "bin", "you", "idiot", "the"]), max_size=12), st.sampled_from([" ", ", ", "! "]))
def test_matches_against_a_search_of_all_places(words, sep):
    weights = {" trash": {0: 2.0}, " trashy ": {0: 1.5, 2: 2.5}, " idiot ": {0: 3.0}, " can": {1: 0.5}}
    model = toxicity.Model(weights, (" trash can ", " you idiot "), (-3.0, 1.0, 2.0))
    folded = toxicity.fold(sep.join(words))
    found = Counter()
    for x in weights:
        for at in range(len(folded)):
            # An occurrence begins with the space before its word; it is harmless if that space lies in an exception.
            spaces = [e for e in model.exceptions for i in range(len(folded)) if folded.startswith(e, i) and i <= at < i + len(e) - 1]
            if folded.startswith(x, at) and not spaces:
                found[x] += 1
    scorer = toxicity.Scorer(model)
    assert scorer.matches(folded) == found
    n = max(1, len(folded.split()))
    total = sum(max((w for i, w in weights[x].items() if k >= toxicity.LEVELS[i] * n), default=0.0) for x, k in found.items())
    dense = sum(max((w for i, w in weights[x].items() if k >= toxicity.LEVELS[i] * n), default=0.0) * k / n for x, k in found.items())
    assert scorer.features(folded) == pytest.approx((min(total, toxicity.MOST), min(dense, 1.0)))


def test_a_late_insult_teaches(spark):
    """Whole texts are learned from, however long."""
    ids = [i for i in range(90) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = [(i, "plain words here " * 3000 + ("idiot" if i % 2 else "friend")) for i in ids]
    model = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int"))
    assert any("idio" in x for x in model.weights) and toxicity.Scorer(model).score("what an idiot") > 0.7


def test_toxicity_held_out(spark):
    rows = toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.8 and hit / sum(r.predicted for r in rows) > 0.9


def test_toxicity_of_a_hot_id(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"word{i} idiot here" if i % 2 else f"plain word{i} here") for i in ids]
    hot = next(i for i in ids if i % 2)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    learn = lambda docs: toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), labels, 100)
    model = learn(rows)
    assert model.weights and learn([(hot, dict(rows)[hot])] * 1000 + [(hot, None)] + rows) == model


def test_toxicity_query(spark, folder):
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, folder[0]).collect()}
    assert len(got) == len(folder[1]) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())


# ------------------------------------------------------------------ op7


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=16, max_size=80))
def test_pair_counts(raw):
    b, w = np.frombuffer(raw, np.uint8), fingerprints.WINDOW
    want = [sum(x[i] == x[j] for i in range(w) for j in range(i)) for x in (raw[t : t + w] for t in range(len(raw) - w + 1))]
    assert fingerprints.pair_counts(b).tolist() == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab c.é", max_size=70), min_size=1, max_size=4), st.integers(0, 5))
def test_selection_against_all_runs(texts, seed):
    """Windows that are best in enough runs, by a loop over runs."""
    w, run = fingerprints.WINDOW, fingerprints.RUN
    ranks = np.random.default_rng(seed).permutation(fingerprints.VALUES)
    got = fingerprints.features(pa.array(texts), ranks)
    for text, found in zip(texts, got, strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        counts = fingerprints.pair_counts(raw)
        best = Counter(min(range(r, r + run), key=lambda t: (ranks[counts[t]], t)) for r in range(len(counts) - run + 1))
        chosen = sorted(t for t, k in best.items() if k >= fingerprints.POPULAR)
        if chosen:
            want = fingerprints._window_hashes(raw, np.array(chosen))
            assert found.tolist() == list(dict.fromkeys(want.tolist()))
        else:
            assert len(found) == len({text.encode()[i : i + 4] for i in range(len(raw) - 3)} or ({text} - {""}))
        assert len(raw) >= w + run - 1 or not chosen


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 400), st.integers(0, 400), st.integers(0, 400), st.integers(0, 9))
def test_likeness_against_bits(n, m, both, seed):
    rng = np.random.default_rng(seed)
    items = rng.integers(0, 2**63, n + m, dtype=np.uint64)
    both = min(both, n, m)
    a, b = fingerprints.Digest(items[:n]), fingerprints.Digest(np.concatenate([items[:both], items[n : n + m - both]]))

    def bits(digest, found):
        chain = [set() for _ in range(-(-len(found) // fingerprints.FULL))]
        for i, x in enumerate(found.tolist()):
            chain[i // fingerprints.FULL] |= {x >> 11 * k & 2047 for k in range(fingerprints.HASHES)}
        return chain

    x, y = bits(a, items[:n]), bits(b, np.concatenate([items[:both], items[n : n + m - both]]))
    sizes = [a.counts(), b.counts()]
    if (len(x), n) > (len(y), m):
        x, y, sizes = y, x, sizes[::-1]
    got = fingerprints.likeness(a, b)
    if not n or not m:
        assert got == float(n == m)
        return
    total = 0.0
    for u, k in zip(x, sizes[0], strict=True):
        over = [(len(u & v) - len(u) * len(v) / 2048) / (min(len(u), len(v)) - len(u) * len(v) / 2048) for v in y]
        total += k * max(0.0, *over)
    assert got == pytest.approx(total / sum(sizes[0]))


def test_fingerprints(spark, folder):
    got = {r.doc_id: r for r in fingerprints.op7_fingerprints(spark, folder[0]).collect()}
    docs = sorted((d, t or "") for d, t, _ in folder[1])
    assert len(got) == len(docs)
    for (d, t), (_, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        e = fingerprints.edited(t, u)
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (got[d].near_edited == 1.0) if e == t else 0 <= got[d].near_edited <= 1
    assert got[7].fingerprint != got[8].fingerprint


# ------------------------------------------------------------------ op8


def test_token_output(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    start = 0
    got = {r.doc_id: r for r in token_output.op8_token_output(spark, folder[0]).collect()}
    for d, text, _ in sorted(folder[1], key=lambda x: x[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        r = got[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encoder_on_odd_words():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    t, e = Tokenizer.from_file(path), token_output.Encoder(path)
    for x in ["It's DON'T <|endoftext|>x", "ÀÉÎ ß µ ªº ²³ ½", "İstanbul ΣΑΣ", "e\u0301 x\u200bY \x1c\x85 a\xa0b", "12a1$$$ a.b,c-d_e [\\]^", "日本 😀"]:
        assert np.frombuffer(e.encode([x])[0], e.kind).tolist() == t.encode(x, add_special_tokens=False).ids


def test_shard_reads_one_document():
    import zstandard

    d = token_output.train([b"ab" * 9])
    w = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    ids = [np.array(x, "<u2") for x in ([1], [5, 6, 1], [])]
    data = token_output.write_shard(2, 7, d, [(k if k else None, len(x), w.compress(x.tobytes())) for k, x in enumerate(ids)])
    assert token_output.read_document(data, d, 1).tolist() == [5, 6, 1]
    assert len(token_output.Shard(data, d)) == 3 and token_output.Shard(data, d).before == 7
    with pytest.raises(ValueError):
        token_output.Shard(data, d + b"x")


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    kept = p.toxicity(spark, docs, folder[0])
    assert kept.columns == docs.columns
    single = {r.doc_id for r in p.near_duplicates(spark, docs, folder[0]).collect()}
    assert single == {d for d, (_, c) in brute_components(folder[1]).items() if c == d}
    out = p.run(spark, folder[0])
    assert set(docs.columns) < set(out.columns) and out.filter("NOT lossless").count() == 0


def test_pipeline_keeps_one_row_of_each_group(spark, folder):
    """Rows, not ids: an id with two texts, exact copies, null ids, and other columns that differ."""
    import corpus_pipeline as p

    words = [f"w{i}" for i in range(40)]
    a, b = " ".join(words), " ".join(words[:39] + ["x"])
    rows = [(2, a, "s"), (5, "other text of these seven words", "s"), (5, a, "t"), (2, a, "u"), (None, b, "s"), (None, "lone text of these six words", "s"), (9, None, "s"), (9, "", "s"), (9, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.withColumns({n: F.lit(f"<{n}>") for n in NAMES})
    single = p.near_duplicates(spark, docs, folder[0])
    got = single.collect()
    assert single.columns == docs.columns and all(r[n] == f"<{n}>" for r in got for n in NAMES)
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(2, a), (5, rows[1][1]), (0, rows[5][1]), (9, ""), (9, ""), (9, "")])


def test_pipeline_mixes_by_its_sql(spark, folder):
    """The mixing stage, as often as the SQL of the mix says."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    times = Counter(r.doc_id for r in p.mix_sources(spark, docs, folder[0]).collect())
    for r in mixing.op9_mixing(spark, folder[0]).collect():
        assert not r["size"] or times[r.doc_id] * r["size"] == r.taken


NAMES = ["__text", "__html", "__id", "__hash", "__source", "__k", "__key", "__row", "__host", "__part", "lossless", "piece_ids", "decoded", "score", "toxic", "n_chars", "key", "component", "verdict", "rule", "q", "class", "part"]


def test_clashing_names_are_kept(spark, folder):
    """Every operator that keeps columns keeps these, with their values (near duplicates: above)."""
    import corpus_pipeline as p

    extra = lambda df, skip=(): df.withColumns({n: F.lit(f"<{n}>") for n in NAMES if n not in skip})
    docs = extra(spark.read.parquet(f"{folder[0]}/documents.parquet"))
    pages = extra(spark.read.parquet(f"{folder[0]}/pages.parquet"))
    outcomes = spark.createDataFrame([("x.org", 1)], "__host string, good int")
    made = {
        "extract": html_extraction.extract(pages),
        "encode": sentencepiece_codec.encode(docs, sentencepiece_codec.Vocabulary.build(PIECES, 0), lossless="lossless"),
        "judge": url_filters.judge(pages, outcomes),
        "score": toxicity.score(docs, toxicity.Model({" idiot": {0: 3.0}}, (), (-3.0, 1.0, 1.0))),
        "mix": mixing.mix(docs),
        **{name: stage(spark, docs, folder[0]) for name, stage in p.STAGES if name != "near_duplicates"},
    }
    for name, df in made.items():
        assert len(set(df.columns)) == len(df.columns), name
        for r in df.limit(3).collect():
            assert all(r[n] == f"<{n}>" for n in NAMES), name
    # One that only reads some columns doesn't mind others.
    assert token_output.write(docs, __import__("public_tokenizers").path(TOKENIZER))[0].count() > 0


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    from logweft.llm.queries import queries

    assert {n: f(spark, str(tmp_path)).count() for n, f in queries().items()} == {n: 1 if n.startswith("op10") else 0 for n in queries()}


def test_text_bytes_of_a_slice():
    data, offsets = fingerprints.text_bytes(pa.array(["ab", None, "cde"])[1:])
    assert data.tobytes() == b"cde" and offsets.tolist() == [0, 0, 3]


def test_sketches_never_overstate_the_difference():
    rng = np.random.default_rng(3)
    for n, m, both in [(0, 0, 0), (1, 1, 0), (1, 1, 1), (5, 4000, 3), (700, 900, 650), (20_000, 21_000, 15_000), (300, 300, 300), (90_000, 40, 7)]:
        items = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))[: n + m - both]
        rng.shuffle(items)
        a, b = np.sort(items[:n]), np.sort(items[n - both :])
        least = ngram_join.unlike(ngram_join.sketch(a), ngram_join.sketch(b))
        assert least == ngram_join.unlike(ngram_join.sketch(b), ngram_join.sketch(a)) <= len(np.setxor1d(a, b))
    a, b = (np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64)) for _ in range(2))
    assert ngram_join.unlike(ngram_join.sketch(a), ngram_join.sketch(b)) > 3000  # long sets are told apart
