"""Packing, HTML extraction, URL filter and the pipeline."""

import random
import zlib
from itertools import groupby

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import DATA
from corpusloom.llm import decontaminate, html_text, packing, simhash, toxicity, url_rules
from corpusloom.llm.queries import ORACLES, QUERIES
from llm_texts import frame, odd_rows, prose  # noqa: F401


def whole_ids(texts):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]


def test_word_ids_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    texts = ["", "a", "It's  a\tTEST, isn't it?\r\nYes", "e\u0301clair ΑΣ ΣΑΣ", "a\u00a0b\u2003c\x1cd\x85e", "<|endoftext|> <|startoftext|>x", "99 bottles!!! #$%", "\x0b\x0c", prose(1, 50)]
    encode = packing.WordIds(packing.tokenizer_path())
    for _ in range(2):
        got = encode([t.encode() for t in texts], packing.END_ID)
        assert [np.frombuffer(g, dtype=encode.kind).tolist() for g in got] == whole_ids(texts)


def check_pieces(pieces, docs, targets=None):
    """Every id once, gapless sequences, sizes without padding; returns the tokens per sequence and source."""
    want = {}
    for (i, _), ids in zip(docs, whole_ids([t for _, t in docs]), strict=True):
        want.setdefault(i, []).append(ids)
    total = sum(len(ids) for rows in want.values() for ids in rows)
    assert sum(p.length for p in pieces) == total
    found = {}
    for p in sorted(pieces, key=lambda p: (str(p.doc_id), p.start)):
        found.setdefault(p.doc_id, []).append(p)
    for i, own in found.items():
        if len(want[i]) == 1:
            ids = want[i][0]
            at = 0
            for p in own:
                assert p.start == at and p.doc_tokens == len(ids)
                assert zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes()) == p.ids_crc32
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in own) == sum(map(len, want[i]))
    sizes, shares = {}, {}
    for k, own in groupby(sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
            shares.setdefault(k, {}).setdefault(p.source, []).append(p.length)
        sizes[k] = at
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == packing.WINDOW or n & (n - 1) == 0 for n in sizes.values())
    assert sum(n < packing.WINDOW for n in sizes.values()) == (total % packing.WINDOW).bit_count()
    return {k: {s: sum(x) for s, x in v.items()} for k, v in shares.items()}, sizes


def test_packing_of_the_given_documents(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    pieces = QUERIES["op5_pack"](spark, DATA).collect()
    shares, sizes = check_pieces(pieces, list(zip(docs.doc_id, docs.text, strict=True)))
    total = sum(sizes.values())
    for source in docs.source.unique():
        own = sum(s.get(source, 0) for s in shares.values())
        for k in range(total // packing.WINDOW):
            assert abs(shares[k].get(source, 0) - packing.WINDOW * own / total) < 2.5


def test_served_equals_a_round_robin_by_token():
    rng = random.Random(1)
    for totals, targets in (([5, 0, 17, 40], None), ([300, 7, 90], [1, 1, 1]), ([4000, 3000, 2500], [0.5, 0.2, 0.3]), ([10, 20], [1.0, 0.0])):
        s = packing.Schedule.of(totals, targets)
        everything = s.served(np.arange(s.total + 1))
        assert (everything.sum(axis=1) == np.arange(s.total + 1)).all()
        steps = np.diff(everything, axis=0)
        assert (steps >= 0).all() and everything[-1].tolist() == totals
        some = np.array(sorted(rng.randrange(s.total + 1) for _ in range(9)))
        assert (s.served(some) == everything[some]).all()
        # within a phase no source is ahead or behind its share by more than a token and a half
        for p in range(len(s.rank)):
            n = s.count[p].sum()
            own = everything[s.rank[p] : s.rank[p] + n + 1] - s.taken[p]
            assert np.abs(own - np.arange(n + 1)[:, None] * s.count[p] / n).max() <= len(totals) / 2 + 1


def test_every_token_lies_in_one_sequence():
    """Random totals, whose tails have sequences of 1, 2 and 4 tokens, where shares are rounded most."""
    rng = random.Random(5)
    for run in range(500):
        totals = [rng.choice([1, 2, 3, 7, rng.randint(1, 1500), rng.randint(1, 6000)]) for _ in range(rng.randint(2, 20))]
        if run % 3 == 0:
            totals = [totals[0]] * len(totals)
        s = packing.Schedule.of(totals, None if run % 2 else [rng.choice([0.0, 1.0, 2.5]) for _ in totals])
        before = s.served(s.bound(np.arange(s.sequences + 1)))
        assert (np.diff(before, axis=0) >= 0).all() and before[-1].tolist() == totals
        for q, n in enumerate(totals):
            places = np.unique(np.r_[np.arange(min(n, 30)), np.arange(max(0, n - 60), n)])
            at = s.holder(np.full(len(places), q), places)
            assert (before[at, q] <= places).all() and (places < before[at + 1, q]).all()


def test_shares_of_huge_totals_are_exact():
    s = packing.Schedule.of([10**13 + 7, 3 * 10**12 + 1, 5 * 10**11, 17])
    k = np.random.default_rng(0).integers(0, s.sequences - len(s.tail), 500)
    steps = s.served(s.bound(k + 1)) - s.served(s.bound(k))
    assert (steps >= 0).all() and (steps.sum(axis=1) == packing.WINDOW).all()


def test_packing_with_targets(frame):
    rng = random.Random(2)
    rows = [(k, prose(k, rng.randint(1, 400)), "big" if k % 3 else "small") for k in range(150)]
    pieces = packing.with_digest(packing.pack(frame(rows), {"big": 0.5, "small": 0.5})).collect()
    shares, sizes = check_pieces(pieces, [(i, t) for i, t, _ in rows])
    both = [k for k in sizes if sizes[k] == packing.WINDOW and len(shares[k]) == 2]
    assert all(abs(shares[k]["big"] - packing.WINDOW / 2) <= 2 for k in both[:-1]) and len(both) > 3
    assert any(set(shares[k]) == {"big"} for k in sizes)


def test_packing_of_odd_rows(frame, odd_rows):
    pieces = packing.with_digest(packing.pack(frame(odd_rows)))
    check_pieces(pieces.collect(), odd_rows)
    assert packing.pack(frame(odd_rows).limit(0)).count() == 0


# URLs


def slow_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1] + r[2]), r[0] == "block"), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_given_urls_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLES['op8_url_filter']})").fetchall()
    got = QUERIES["op8_url_filter"](spark, DATA).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_urls_equal_brute_force(spark, ranges):
    rng = random.Random(3)
    rules = [*url_rules.RULES, ("allow", "net", "/en/very/long"), ("block", "b.example.net", "/"), ("allow", "a.b.example.net", "/x"), ("block", "net", "/"), ("block", "c", "")]
    urls = [None, "", "no scheme", "http://", "http://NET", "http://net/", "x://Ä.Net/en/?q", "https://user@a.example.net:80/en/", "http://..net/en/", "ftp://c?x#y", "a://b://c/d", "http://internet/", "http://a\n.net/x\ny"]
    for _ in range(300):
        host = ".".join(rng.choice(("a", "b", "www", "EXAMPLE", "example")) for _ in range(rng.randint(0, 3)))
        urls.append(f"http://{host}.{rng.choice(('net', 'com', 'org', 'c'))}" + rng.choice(("", "/", "/en/", "/de/x", "/fr/", "/en/very/long/1", "?a=/en/", "#top", "/x?y")))
    urls += ["http://hot.example.net/en/1"] * 200
    rows = [(k if k % 50 else None, u, "x", "x", "x") for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string, part string")
    got = url_rules.judge_urls(pages, rules, ranges=ranges).collect()
    want = [(k, *slow_judge(u, rules)) for k, u, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert url_rules.judge_urls(pages, (), ranges=ranges).where("rule IS NOT NULL OR verdict <> 'allow'").count() == 0
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0


def test_one_hot_host_fills_all_ranges(spark):
    """20,000 urls of one host, half of them one row, over 50 ranges."""
    rows = spark.range(20_000, numPartitions=16).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("page_id"), F.lit("http://a.example.net/en/x").alias("url"))
    sizes = url_rules.judge_urls(rows, url_rules.RULES, ranges=50).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 20_000 and len(sizes) >= 35 and max(r["count"] for r in sizes) < 1800


# HTML


def test_minimum_cut_equals_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 8)
        cost = [rng.choice((-3.0, -1.0, -0.25, 0.5, 1.0, 2.0)) for _ in range(n)]
        edges = [(a, b, rng.choice((0.4, 0.8, 1.5))) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def value(side, cost=cost, edges=edges):
            ends = sum(c for c, s in zip(cost, side, strict=True) if c > 0 and not s) - sum(c for c, s in zip(cost, side, strict=True) if c < 0 and s)
            return ends + sum(w for a, b, w in edges if side[a] != side[b])

        least = min(value([m >> k & 1 for k in range(n)]) for m in range(1 << n))
        assert abs(value(html_text.minimum_cut(cost, edges)) - least) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style></head><body>
<header><a href="/">Home page of the site</a></header><nav><ul><li><a href="/a">First</a><li><a href="/b">Second</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, and here is a long sentence about them. Accept them, please.</div>
<div id="content"><h1>The &lt;real&gt; title</h1><!-- <p>not this</p> --><p>First paragraph of the story,
   with <b>enough</b> words to look&nbsp;like prose. It goes on<br>and on.<p>Short.</p>
<div class="advert">Buy this now, it is a great product, with many words about it. Buy it.</div>
<p>Second paragraph &amp; the last of the story, with enough words to look like prose.</p>
<form><label>Your name</label><input><textarea>text</textarea><button>Send it</button></form></div>
<aside class="sidebar"><p>Other stories that you may like, with a long teaser text here, yes, really.</p></aside>
<section id="comments"><p>Great article, I liked it a lot, thanks for the insight. Really good, all of it.</p></section>
<script>if (a < b) { "<p>script</p>" }</script><footer><p>&copy; 2020 The owner of the site, all rights.</p></footer>"""


def test_main_text():
    want = "The <real> title First paragraph of the story, with enough words to look like prose. It goes on and on. Short. Second paragraph & the last of the story, with enough words to look like prose."
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(PAGE.replace("</div>\n<p>Second", "</div><p>Second")) == want
    for odd in (None, "", "<p", "<p><b><i>", "</p></div>", "<!-- open", "<script>x", "&amp", "<a href='x>y'>z"):
        assert isinstance(html_text.main_text(odd), str)
    long = "<article>" + "".join(f"<p>Paragraph {k}, with some words, as it should.</p>" for k in range(20_000)) + "</article>"
    assert html_text.main_text(long).count("Paragraph") == 20_000


SENTENCE = "A plain sentence of the article, with enough words to look like prose, and a full stop."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<article class="comment-free-post"><p>{SENTENCE}</p></article>', SENTENCE),
        (f'<main id="search-theory"><p>{SENTENCE}</p></main>', SENTENCE),
        (f"<article><p>{SENTENCE}</p><p><button>Send it</p><p>{SENTENCE}</p></article>", f"{SENTENCE} {SENTENCE}"),
        (f"<article><div><select><option>One<option>Two</div><p>{SENTENCE}</p></article>", SENTENCE),
        (f"<article><p>{SENTENCE}<object data=x>No <b>plug-in</b></p><p>{SENTENCE}</p></article>", f"{SENTENCE} {SENTENCE}"),
        (f"<article><p>{SENTENCE} So it is <canvas>none</canvas>one.</p></article>", f"{SENTENCE} So it is one."),
        (f"<head><title>Name</head><body><article><p>{SENTENCE}</p></article>", SENTENCE),
        (f"<article><p>{SENTENCE} It holds if a <b and c > d then, or if a<b>b</b>.</p></article>", f"{SENTENCE} It holds if a <b and c > d then, or if ab."),
        (f'<article><p>{SENTENCE}</p><div class="comment-list"><p>{SENTENCE}</p></div></article>', SENTENCE),
        (f'<article><p>{SENTENCE}</p></article><div id="site-footer-2"><p>{SENTENCE}</p></div>', SENTENCE),
    ],
)
def test_names_and_unclosed_elements(html, want):
    assert html_text.main_text(html) == want


def test_pages_of_another_shape():
    """No article element: a table layout of old pages, and nested plain divisions."""
    old = f"""<table><tr><td><a href=1>Home</a><br><a href=2>News</a><br><a href=3>Links</a></td><td><font size=5>On rain</font><br>
    {SENTENCE}<br><br>{SENTENCE} <i>{SENTENCE}</i></td></tr><tr><td colspan=2 class=copyright>(c) The owner. All rights reserved, of course.</td></tr></table>"""
    assert html_text.main_text(old) == f"On rain {SENTENCE} {SENTENCE} {SENTENCE}"
    plain = f"""<body><div class="site-header"><a href="/">Site</a></div><div><div><div><h2>On snow</h2><div>{SENTENCE}</div><div>{SENTENCE}</div>
    <ul><li>First point, short.</li><li>Second point.</li></ul><div>{SENTENCE}</div></div></div></div>
    <div class="related-posts"><h3>More</h3><a href="/1">Another one</a></div><div id="cookie-bar">We use cookies, as all do. Accept them.</div></body>"""
    assert html_text.main_text(plain) == f"On snow {SENTENCE} {SENTENCE} First point, short. Second point. {SENTENCE}"


def test_given_pages_yield_their_articles(spark):
    import html as H
    import re

    pages = pd.read_parquet(f"{DATA}/pages.parquet").set_index("page_id")
    got = QUERIES["op7_extract"](spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|<footer|\Z)", pages.loc[r.page_id].html, re.S)[1]
        parts = [" ".join(H.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)[^>]*>", article)]
        assert r.text == " ".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (1, "u", "", "x"), (None, "u", PAGE, "x"), (2, "u", PAGE, "x"), (2, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == 5 and [r.n_chars for r in got if r.page_id == 1] == [0, 0]
    assert len({r.text for r in got if r.page_id != 1}) == 1
    assert html_text.extract(pages.limit(0)).count() == 0


# pipeline


def test_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts, columns, at = {}, docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in at.collect()}
        at = corpus_pipeline.staged(stage(spark, at, DATA), name)
        texts[name] = before
        if name != "packing":
            assert at.columns == columns and {r.doc_id for r in at.select("doc_id").collect()} <= set(before)
    after = {name: texts[later] for (name, _), (later, _) in zip(corpus_pipeline.STAGES, corpus_pipeline.STAGES[1:], strict=False)}
    machine = toxicity.fit_toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, machine).collect() if r.predicted}
    assert set(after["toxicity"]) == set(texts["toxicity"]) - toxic
    fp = {i: simhash.fingerprint((t or "").encode()) % 2**64 for i, t in texts["simhash_dedup"].items()}
    kept = set(after["simhash_dedup"])
    for a in fp:
        near = [b for b in fp if (fp[a] ^ fp[b]).bit_count() <= 3]
        assert a in kept or min(near) < a or any(b in kept for b in near)
        assert len(near) > 1 or a in kept
    items = [decontaminate.question_and_answer(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for i, t in texts["decontamination"].items():
        whole = " " + " ".join(decontaminate.words_of(t)) + " "
        leak = any(all(sum(s in whole for s in sh) >= 0.8 * len(sh) for sh in map(decontaminate.shingles, item)) for item in items)
        assert (i in after["decontamination"]) != leak
    check_pieces(at.collect(), list(texts["packing"].items()))


def test_pipeline_takes_odd_and_empty_tables(spark, frame, odd_rows):
    for docs in (frame(odd_rows, clash=False), frame(odd_rows, clash=False).limit(0)):
        at = docs
        for name, stage in corpus_pipeline.STAGES:
            at = corpus_pipeline.staged(stage(spark, at, DATA), f"odd-{name}")
        assert (at.count() > 0) == (docs.count() > 0)
