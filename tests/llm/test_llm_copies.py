"""Suffix dedup, decontamination, SimHash near-dedup and line dedup."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import DATA, plan
from corpusloom import staging
from corpusloom.llm import components, decontaminate, line_dedup, simhash, suffix_dedup
from corpusloom.llm.queries import QUERIES
from llm_texts import frame, odd_rows, prose  # noqa: F401


def find(parent, a):
    while parent[a] != a:
        a = parent[a]
    return a


# suffix dedup


def brute_repeats(texts, length=200):
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((k, i))
    gone = [np.zeros(len(t), dtype=bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = True
    return gone


def check_repeats(rows, got):
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), t, g in zip(rows, texts, brute_repeats(texts), strict=True):
        runs = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~g])
        want.append((i, len(t), int(g.sum()), runs, hashlib.sha256(kept).hexdigest()))
    have = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r))
    assert order(have) == order(want)


def repeat_rows():
    rng = random.Random(8)
    base = [prose(k, 400) for k in range(4)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(40):
        t = list(base[k % 4])
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = "ÄQZ"[rng.randrange(3)]
        cut = rng.randrange(len(t) // 2)
        rows.append((100 + k, prose(1000 + k, 60) + "".join(t[cut : cut + rng.randint(150, 1200)]) + prose(2000 + k, 30)))
    rows += [(200, "a" * 900), (201, "ab" * 400), (202, base[0][:199]), (203, base[0][5:205]), (204, None), (205, ""), (206, base[1]), (206, base[1]), (206, base[2][:500]), (None, base[3])]
    return rows


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2])
def test_repeats_equal_brute_force(frame, group):
    rows = repeat_rows()
    check_repeats(rows, suffix_dedup.without_repeats(frame(rows), group).collect())


def test_ranks_are_the_order_of_suffixes():
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab") * rng.randint(1, 90) for _ in range(12)).encode() + b"z" * 200 for _ in range(9)] + [b"q" * 200]
    part, place, rank = suffix_dedup._string_ranks(parts)
    strings = [parts[a][b : b + 200] for a, b in zip(part.tolist(), place.tolist(), strict=True)]
    order = {s: k for k, s in enumerate(sorted(set(strings)))}
    for a, b in zip(range(len(rank)), rng.choices(range(len(rank)), k=len(rank)), strict=True):
        assert (rank[a] < rank[b], rank[a] == rank[b]) == (order[strings[a]] < order[strings[b]], strings[a] == strings[b])


def test_long_texts_are_parsed_in_segments(frame, monkeypatch):
    long = prose(5, 3000)
    rows = [(1, long), (2, long[1000:6000]), (3, prose(6, 2000))]
    want = [(p.tolist()) for p in suffix_dedup.phrases([long.encode()])[1:3]]
    assert sum(want[1]) == len(long) - 199
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 4096)
    pieces = list(suffix_dedup._segments([t.encode() for _, t in rows]))
    assert sum(len(h) for _, _, held in pieces for h in held) > 0
    covered = sum(len(h) - 199 for rows_, _, held in pieces for r, h in zip(rows_, held, strict=True) if r == 0)
    assert covered == len(long) - 199


def test_repeats_of_the_given_documents(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    got = QUERIES["op3_suffix_dedup"](spark, DATA).toPandas().set_index("doc_id")
    texts = [t.encode() for t in docs.text]
    for i, t, g in zip(docs.doc_id, texts, brute_repeats(texts), strict=True):
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~g])
        assert (got.loc[i].n_removed, got.loc[i].kept_sha256) == (int(g.sum()), hashlib.sha256(kept).hexdigest())


def test_texts_with_equal_checksums_keep_their_bytes(spark, frame):
    """Rows without an id whose texts agree in Spark's 32-bit hash are told apart."""
    common = prose(7, 80)
    ids = spark.range(120_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("own"))
    shared = ids.select(F.concat(F.lit(common), "own").alias("a"))
    alone = ids.select(F.concat(F.sha2(F.col("own"), 512), F.sha2(F.concat("own", F.lit("x")), 512)).alias("b"))
    pair = shared.withColumn("h", F.hash("a")).join(alone.withColumn("h", F.hash("b")), "h").limit(1).collect()
    assert pair
    rows = [(None, pair[0].a), (None, pair[0].b), (3, common)]
    check_repeats(rows, suffix_dedup.without_repeats(frame(rows)).collect())


# components


def test_components_of_random_links(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    parent = {n: n for p in pairs for n in p}
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: find(parent, n) for n in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_hand():
    for text in ("", "one", "One TWO", "Ä b c d e", " x  y\nz w " * 5, prose(1, 200)):
        assert simhash.fingerprint(text.encode()) % 2**64 == slow_fingerprint(text)


def test_given_documents_equal_brute_force(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    got = QUERIES["op6_simhash"](spark, DATA).toPandas().set_index("doc_id")
    values = [slow_fingerprint(t) for t in docs.text]
    ids, parent = docs.doc_id.tolist(), list(range(len(docs)))
    for a in range(len(ids)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 3:
                parent[find(parent, a)] = find(parent, b)
    least = {}
    for k, i in enumerate(ids):
        root = find(parent, k)
        least[root] = min(least.get(root, i), i)
    for k, i in enumerate(ids):
        assert got.loc[i].fingerprint == f"{values[k]:016x}" and got.loc[i].component_id == least[find(parent, k)]


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(6)
    values = {0, 2**64 - 1}
    for _ in range(60):
        seed = rng.getrandbits(64)
        for _ in range(6):
            v = seed
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    parent = dict(zip(signed, signed, strict=True))
    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 3:
                x, y = find(parent, signed[a]), find(parent, signed[b])
                parent[max(x, y)] = min(x, y)
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    assert all((r.a ^ r.b) % 2**64 and ((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in links.collect())
    got = {r.node: r.component for r in components.components(links).collect()}
    roots = {s: find(parent, s) for s in signed}
    many = {r for r in roots.values() if list(roots.values()).count(r) > 1}
    assert got == {s: r for s, r in roots.items() if r in many}


def test_one_document_of_each_component_stays(frame):
    other = [prose(40 + k, 60) for k in range(5)]
    rows = [(None, t) for t in other[:3]] + [(None, other[0]), (3, other[1]), (5, other[3]), (5, other[4]), (6, other[4]), (5, other[3])]
    docs = frame(rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(None, other[0]), (None, other[2]), (3, other[1]), (5, other[3]), (5, other[4])], key=str)


# lines


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert line_dedup.edit_distance(a, b) == slow_distance(a, b)


def line_rows():
    rng = random.Random(9)
    pool = [prose(k, rng.randint(6, 40)) for k in range(25)]
    rows = []
    for k in range(40):
        lines = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(pool).split(" ")
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(("zz", "Kalo", "mi"))
            lines.append(rng.choice(("", "  ")) + " ".join(words).capitalize() + rng.choice((".", "!")))
        rows.append((k, "\n".join([*lines, "Yes.", ""])))
    return rows


def test_emptied_documents_go_and_empty_ones_stay(frame):
    line = prose(3, 12)
    docs = frame([(1, line), (2, line), (3, ""), (4, None), (5, line + "\nmore"), (None, line), (None, f"{line}\n{prose(4, 9)}")])
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, line), (3, ""), (4, None), (5, "more"), (None, prose(4, 9))], key=str)


def brute_similar(rows, fewest):
    """Removed lines by edit similarity alone: over characters if both lines have fewer than five words, else over words."""
    parts = sorted((i, n, line_dedup.normal(x)) for i, t in rows for n, x in enumerate(t.split("\n")))
    parts = [p for p in parts if len(p[2]) >= fewest]
    parent = list(range(len(parts)))
    for a in range(len(parts)):
        for b in range(a):
            x, y = parts[a][2], parts[b][2]
            if max(len(x), len(y)) < 5:
                x, y = " ".join(x), " ".join(y)
            if x == y or 1 - slow_distance(x, y) / max(len(x), len(y)) >= 0.8 - 1e-9:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    gone = {}
    for k, (i, n, _) in enumerate(parts):
        if find(parent, k) != k:
            gone.setdefault(i, set()).add(n)
    return gone


@pytest.mark.parametrize("block", [None, 2])
def test_all_lines_at_edit_similarity_are_linked(frame, monkeypatch, block):
    if block:
        monkeypatch.setattr(line_dedup, "MEETING", block)
    rng = random.Random(11)
    rows = [(i, t.replace("\nYes.", "")) for i, t in line_rows()]
    for k in range(60):
        words = prose(300 + k % 12, 5 + k % 12 * 3).split(" ")
        for _ in range(rng.randint(0, len(words) // 4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [rng.choice(("qq", "mi", "ka"))] * rng.randint(0, 1)
        rows.append((100 + k, " ".join(words)))
    gone = brute_similar(rows, 1)
    assert sum(map(len, gone.values())) > 60
    # as many keys as the most edits take, and one more, lose nothing
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(rows), keys=40).collect()}
    assert {i: set(r.lines_gone) for i, r in got.items() if r.lines_gone} == gone
    for i, text in rows:
        assert got[i].text == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone.get(i, set()))


def test_small_and_large_groups_are_compared_alike(monkeypatch):
    rng = random.Random(4)
    lines = [prose(k % 40, 9 + k % 3).split(" ") for k in range(300)]
    for x in lines:
        x[rng.randrange(len(x))] = rng.choice(("qq", "ka", x[0]))
    mark = line_dedup.word_marks(lines)
    new = np.zeros(300, dtype=bool)
    new[[0, 2, 3, 9, 40, 41, 200]] = True
    turns = np.full(300, line_dedup.WORD_TURNS)
    found = line_dedup._partnered(mark, new, turns)
    group = np.cumsum(new)
    want = [any(group[a] == group[b] and a != b and line_dedup.marks_near(mark[a], mark[b : b + 1], 2)[0] for b in range(300)) for a in range(300)]
    assert found.tolist() == want and 0 < found.sum() < 300
    monkeypatch.setattr(line_dedup, "SMALL_GROUP", 3)
    assert line_dedup._partnered(mark, new, turns).tolist() == want


def test_recall_on_the_given_documents(spark):
    """Links that are found of all pairs of distinct lines at edit similarity 0.8, by brute force over pairs of near length."""
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    lines = {" ".join(x): x for t in docs.text for x in map(line_dedup.normal, t.split("\n")) if x}
    held = list(lines.values())
    marks, chars = line_dedup.word_marks(held), line_dedup.char_marks(held)
    links = 0
    groups = {}
    for k, x in enumerate(held):
        short = np.maximum(marks[:, 0], marks[k, 0]) < 5
        near = np.where(short, line_dedup.marks_near(chars[k], chars, 4), line_dedup.marks_near(marks[k], marks, 2))
        for j in np.flatnonzero(near[:k]).tolist():
            if line_dedup.similar_lines(x, held[j]):
                links += 1
                groups.setdefault(k, set()).add(j)
    parent = list(range(len(held)))
    for k, others in groups.items():
        for j in others:
            a, b = find(parent, k), find(parent, j)
            parent[max(a, b)] = min(a, b)
    same = {tuple(held[k]): find(parent, k) for k in range(len(held))}
    want = {}
    places = sorted((i, n, tuple(line_dedup.normal(x))) for i, t in zip(docs.doc_id, docs.text, strict=True) for n, x in enumerate(t.split("\n")))
    seen = set()
    for i, n, x in places:
        if x:
            if same[x] in seen:
                want.setdefault(i, set()).add(n)
            seen.add(same[x])
    got = {r.doc_id: set(r.removed_lines) for r in QUERIES["op9_line_dedup"](spark, DATA).collect() if r.removed_lines}
    missed = sum(len(v - got.get(i, set())) for i, v in want.items())
    extra = sum(len(v - want.get(i, set())) for i, v in got.items())
    total = sum(map(len, want.values()))
    assert links > 20 and extra == 0 and missed <= 0.01 * total


def test_texts_of_one_id_are_documents_of_their_own(frame):
    a, b, c, d = (prose(60 + k, 12) for k in range(4))
    rows = [(1, a), (5, f"{b}\n{a}"), (5, f"{c}\n{d}"), (5, f"{c}\n{d}"), (6, d)]
    out = [(r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(frame(rows)).collect()]
    assert sorted(out) == sorted([(1, a), (5, b), (5, f"{c}\n{d}"), (5, f"{c}\n{d}")])


# decontamination


def slow_share(part, words):
    """1 - the least edit distance of the part to any run of the words, per word of the part."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(part, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return 1 - min(row) / len(part)


def test_edit_share_equals_a_plain_table():
    rng = random.Random(6)
    for _ in range(300):
        part, words = ([rng.choice("abc") for _ in range(rng.randint(low, 12))] for low in (1, 0))
        assert decontaminate.edit_share(part, words) == pytest.approx(slow_share(part, words))


def test_edited_items_are_found(spark, frame, monkeypatch):
    """One word in each part is changed; every text is long, and passages are looked up a few at a time."""
    monkeypatch.setattr(decontaminate, "BOUNDS", 64)
    rng = random.Random(12)
    items, rows, edits = [], [], 0
    for k in range(60):
        question, answer = prose(700 + k, rng.randint(8, 70)).split(" "), prose(900 + k, rng.randint(7, 20)).split(" ")
        items.append((k, " ".join(question).capitalize() + ". " + " ".join(answer).capitalize() + "."))
        for part in (question, answer):
            part[rng.randrange(len(part))] = "changed"
        rows.append((k, f"{prose(k, 300 + 40 * k)}. {' '.join(question)}. {' '.join(answer)}. {prose(k + 100, 200)}"))
        rows.append((1000 + k, f"{prose(k, 900)}. {' '.join(answer)}. {prose(k + 100, 200)}"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(k, k) for k in range(60)}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_one_very_long_text(spark, frame, monkeypatch):
    monkeypatch.setattr(decontaminate, "BOUNDS", 256)
    text = f"{prose(1, 150_000)}. {prose(2, 40)}. {prose(3, 9)}. {prose(4, 150_000)}"
    items = spark.createDataFrame([(1, f"{prose(2, 40)}. {prose(3, 9)}."), (2, prose(5, 50))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame([(9, text)]), items).collect()] == [(9, 1)]


def test_leaks_equal_brute_force(spark):
    docs, items = pd.read_parquet(f"{DATA}/documents.parquet"), pd.read_parquet(f"{DATA}/benchmark.parquet")
    want = set()
    for it in items.itertuples():
        parts = decontaminate.question_and_answer(it.text)
        for d in docs.itertuples():
            words = decontaminate.words_of(d.text)
            whole = " " + " ".join(words) + " "
            shares = [np.mean([s in whole for s in decontaminate.shingles(p)]) for p in parts]
            if max(shares) > 0.3:  # a text that shares so little is no edited item
                shares = [max(x, slow_share(p, words)) if x < 0.8 and 5 <= len(p) < 29 else x for x, p in zip(shares, parts, strict=True)]
            if min(shares) >= 0.8 - 1e-9:
                want.add((d.doc_id, it.item_id))
    got = QUERIES["op4_decontaminate"](spark, DATA).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 0


def test_retrieval_equals_plain_bm25(monkeypatch):
    rng = random.Random(3)
    items = [(k, prose(k, rng.randint(3, 150))) for k in range(60)]
    segments = [w[lo : lo + 64] for _, t in items for w in [decontaminate.words_of(t)] for lo in range(0, len(w), 64)]
    df = {}
    for s in segments:
        for w in set(s):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.Index.of(items, df, len(segments), sum(map(len, segments)) / len(segments))
    queries = [decontaminate.words_of(prose(k, 100)) for k in range(30)] + [decontaminate.words_of(items[5][1])]
    pairs = np.array(sorted({(q, index.words[w]) for q, ws in enumerate(queries) for w in ws if w in index.words}))
    plain = np.zeros((len(queries), len(index.item)))
    for q, w in pairs:
        lo, hi = index.segment_of_word[w], index.segment_of_word[w + 1]
        plain[q, index.segments[lo:hi]] += index.weight[lo:hi]
    for threshold in (0.05, 0.3, 0.9):
        p, s, x = index.retrieve(pairs[:, 0], pairs[:, 1], len(queries), threshold)
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(plain >= threshold - 1e-9), strict=True)}
        assert {(int(a), int(b)) for a, b in zip(p, s, strict=True)} == want
        assert np.allclose(x, plain[p, s])


def test_question_and_answer_are_both_needed(spark, frame, monkeypatch):
    question, answer = prose(31, 30).capitalize(), prose(32, 12).capitalize()
    items = spark.createDataFrame([(7, f"{question}. {answer}.", "x"), (8, None, "x"), (9, "", "x"), (10, prose(33, 200), "x"), (7, f"{question}. {answer}.", "x")], "item_id long, text string, score string")
    around = prose(34, 500)
    rows = [(1, f"{around} {question.upper()};\n{answer}! {around}"), (2, f"{around} {question}"), (3, f"{answer} {around}"), (4, None), (5, ""), (6, around + " " + prose(33, 200)), (6, around + " " + prose(33, 200))]
    for shard in (20_000, 1):
        monkeypatch.setattr(decontaminate, "SHARD_ITEMS", shard)
        got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(rows), items).collect())
        assert got == [(1, 7), (6, 10), (6, 10)]
        assert sorted(r.doc_id for r in decontaminate.drop_leaks(frame(rows), items).collect()) == [2, 3, 4, 5]
    assert decontaminate.find_leaks(frame(rows), items.limit(0)).count() == 0
    assert decontaminate.drop_leaks(frame(rows).limit(0), items).count() == 0


# all of them


def test_odd_rows(frame, odd_rows):
    docs = frame(odd_rows)
    check_repeats([(i, t) for i, t in odd_rows if t is None or len(t) < 10_000], suffix_dedup.without_repeats(docs.where("text IS NULL OR length(text) < 10000")).collect())
    groups = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8), (None, None)} == groups
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 5, 7, 8, None]
    lines = line_dedup.drop_repeated_lines(docs)
    assert sorted((r.doc_id for r in lines.collect()), key=str) == [1, 2, 3, 4, 5, 5, 7, 8, None]
    empty = docs.limit(0)
    for out in (suffix_dedup.without_repeats(empty), simhash.near_duplicates(empty), simhash.keep_first(empty), line_dedup.dedup_lines(empty), line_dedup.drop_repeated_lines(empty)):
        assert out.count() == 0


def test_grams_of_all_texts_are_counted(spark):
    """Also those that stand only late in a long text, and only in the last rows of a large table."""
    rows = [(k, f"w{3 * k} w{3 * k + 1} w{3 * k + 2} w{3 * k + 3} w{3 * k + 4}") for k in range(2500)]
    rows += [(k, " ".join(f"v{k}x{n}" for n in range(1000)) + "\nuno due tre quattro cinque") for k in range(2500, 2600)]
    often = line_dedup._often(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    grams, _ = line_dedup._grams(*line_dedup._word_units([["uno", "due", "tre", "quattro", "cinque"], ["w0", "w1", "w2", "w3", "w4"]]), 2)
    held = often[(grams & np.uint64(line_dedup.COUNTERS - 1)).astype(np.int64)]
    assert held[:4].all() and not held[4:].any()


def test_lines_are_read_and_compared_at_once_as_one_by_one():
    texts = ["İstanbul ΣΑΣ Σ. a_b\n\nß Ǆ ⓐ ² ½", " \t\n", "", "A B\x85c\x0bd\r\n", "\n\na", "x" * 100 + " y " + "é" * 40, "abcdefgh abcdefghijklm"]
    row, number, held, units, sizes = line_dedup.lines_in(texts)
    want = [(k, n, line_dedup.normal(x)) for k, text in enumerate(texts) for n, x in enumerate(text.split("\n")) if line_dedup.normal(x)]
    assert list(zip(row.tolist(), number.tolist(), [x.decode().split(" ") for x in held], strict=True)) == want
    hashes, counts = line_dedup._word_units([x[2] for x in want])
    assert units.tolist() == hashes.tolist() and sizes.tolist() == counts.tolist()
    assert all(len(x) == 0 for x in line_dedup.lines_in([]))
    rng = random.Random(8)
    for _ in range(400):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 7)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = [rng.choice("abcdefgh")] * rng.randint(0, 1)
        distance = slow_distance(a, b)
        assert line_dedup.similar(a, b) == (distance <= int(0.2 * max(len(a), len(b)) + 1e-9))
        assert [line_dedup._few_edits(a, b, most) for most in range(8)] == [distance <= most for most in range(8)]


def test_lines_that_meet_under_several_keys_are_one_group(spark):
    """Two near copies meet under several keys, and are fetched for one comparison, not for one under each key."""
    line = prose(5, 60).split(" ")
    rows = [(k, " ".join([*line[:30], f"x{k}", *line[30:]])) for k in range(2)]
    lines = line_dedup.lines_of(spark.createDataFrame(rows, "doc_id long, text string"), np.zeros(line_dedup.COUNTERS, dtype=bool))
    first, second = (set(r["keys"]) for r in lines.collect())
    met = line_dedup._key_meetings(lines).collect()
    assert len(first & second) > 1
    assert len(met) == 2 and len({r.code for r in met}) == 2 and len({r.name for r in met}) == 1


def test_line_dedup_leaves_one_staged_table(spark):
    folder = Path(staging.stage_folder(spark).removeprefix("file:"))
    before = set(folder.glob("line*")) | set(folder.glob("distinct-lines*"))
    text = prose(7, 12)
    gone = line_dedup.repeated_lines(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))
    left = (set(folder.glob("line*")) | set(folder.glob("distinct-lines*"))) - before
    assert [x.name.rsplit("-", 1)[0] for x in left] == ["lines-gone"]
    assert [(r.doc_id, r.lines) for r in gone.collect()] == [(2, [0])]


def test_no_similar_line_is_lost(frame):
    """Lines with as many edits as similarity allows, evenly spread, so that most of their grams are gone."""
    rng = random.Random(21)
    rows, words = [], [f"{a}{b}{c}" for a in "abcdefgh" for b in "klmnop" for c in "rstuvwxy"]
    for k in range(300):
        n = 5 * rng.randint(2, 8)
        line = rng.choices(words, k=n)
        other = list(line)
        for at in range(2, n, 5):
            other[at] = f"q{k}x{at}"
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(other))]
    rows += [(1000 + k, f"{w}{w[::-1]}{v}") for k in range(40) for w, v in [(f"w{k}ab", "z"), (f"w{k}ab", "y")]]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(rows)).collect() if r.doc_id < 1000}
    assert all(got[2 * k] and got[2 * k + 1] == "" for k in range(300))


def test_grams_that_a_line_is_filed_under_survive_all_edits_but_one():
    """Among the grams of a line more than its edits do not overlap, and rarer ones come first."""
    rng = random.Random(2)
    lines = [prose(k, 4 + k % 60) for k in range(200)]
    _, _, held, units, sizes = line_dedup.lines_in(lines)
    seen = np.array([rng.choice((0, 0, 1, 5)) for _ in range(line_dedup.COUNTERS)], dtype=np.uint8)
    keys, owner = line_dedup.meeting_keys(held, units, sizes, seen, 1)
    grams, line = line_dedup._grams(units, sizes, 2)
    often = seen[(grams & np.uint64(line_dedup.COUNTERS - 1)).astype(np.int64)]
    for k in range(200):
        mine = set(keys[(owner == k) & (keys & np.uint64(1) == 0)].tolist())
        own = ((((grams >> np.uint64(6)) | (often.astype(np.uint64) << np.uint64(58))) << np.uint64(1))[line == k]).tolist()
        at = [n for n, x in enumerate(own) if x in mine]
        apart, last = 0, -2
        for n in at:
            if n > last + 1:
                apart, last = apart + 1, n
        assert apart > sizes[k] // 4
        assert sorted(set(own))[: len(mine)] == sorted(mine)


def test_many_pairs_are_compared_as_one_by_one(monkeypatch):
    rng = random.Random(12)
    lines = []
    for k in range(150):
        base = prose(k, rng.choice((5, 9, 20, 40, 120))).split(" ")
        for _ in range(4):
            line = list(base)
            for _ in range(rng.randint(0, len(base) // 4)):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = [rng.choice(("qq", "ka"))] * rng.randint(0, 1)
            lines.append(line or ["ka"])
    _, _, _, units, sizes = line_dedup.lines_in([" ".join(x) for x in lines])
    a, b = (np.array(x) for x in zip(*[(p, q) for k in range(0, 600, 4) for p in range(k, k + 4) for q in range(max(k - 2, 0), p)], strict=True))
    want = [line_dedup.similar(lines[p], lines[q]) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    assert 100 < sum(want) < len(want) - 100
    for words in (line_dedup.TABLE_WORDS, 30):
        monkeypatch.setattr(line_dedup, "TABLE_WORDS", words)
        assert line_dedup._within(units, np.cumsum(sizes), sizes, a, b).tolist() == want


def test_nothing_that_grows_is_broadcast(spark, frame):
    """However small the files look: an exploded table is sized as what it was exploded from."""
    docs = frame([(k, prose(k // 2, 30)) for k in range(40)])
    links = spark.createDataFrame([(3, 1), (2, 1)], "a long, b long")
    nodes = simhash.fingerprints(docs).select("fp").distinct()
    tables = [simhash.fingerprint_links(nodes), simhash.near_duplicates(docs), simhash.keep_first(docs)]
    tables += [components._large_star(links), components._small_star(links), line_dedup.dedup_lines(docs)]
    for table in tables:
        assert "SortMergeJoin" in plan(table) and "Broadcast" not in plan(table)
