"""Repeated strings and passages, similar documents, neighbours, and the pipeline."""

import math
import random

import numpy as np
import pytest

from tabulant.llm.components import component_labels
from tabulant.llm.hnsw import nearest
from tabulant.llm.jaccard import similar_components
from tabulant.llm.passages import compact_windows, near_passages
from tabulant.llm.suffixes import equal_windows, repeated_spans, suffix_order


def test_suffix_order_is_sorted():
    rng = random.Random(1)
    for _ in range(500):
        n, k = rng.randint(0, 40), rng.choice((2, 3, 5))
        text = [rng.randint(1, k) for _ in range(n)] + [0]
        assert suffix_order(text) == sorted(range(n + 1), key=lambda i: text[i:])
    groups = equal_windows([b"xabcd", b"abcdy"], 3)
    assert sorted(sorted(g) for g in groups if len(g) > 1) == [[(0, 1), (1, 0)], [(0, 2), (1, 1)]]


def plain_spans(rows, length):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            first.setdefault(b[j : j + length], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if i is not None and first[b[j : j + length]] < i:
                gone[j : j + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append(str((i, len(b), edges.reshape(-1, 2).tolist(), kept)))
    return sorted(out)


def test_repeated_spans(docs_of, messy_rows):
    base = messy_rows[0][1]
    rows = [r for r in messy_rows if r[1] is None or len(r[1]) < 10_000]
    rows += [(20, base[100:149]), (21, base[100:150]), (0, "y" * 60 + base[200:300]), (22, "ab" * 90)]
    rows += [(23, "q" + "ab" * 60), (24, base[:60] + base[:60]), (25, "é" * 80), (26, "z" + "é" * 60)]
    got = repeated_spans(docs_of(rows), 50).collect()
    seen = [str((r.doc_id, r.n_bytes, [[s.start, s.end] for s in r.spans], bytes(r.kept))) for r in got]
    assert sorted(seen) == plain_spans(rows, 50)
    assert repeated_spans(docs_of([])).count() == 0


def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def plain_components(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b:
                if 100 * len(a & b) >= percent * len(a | b):
                    p, q = sorted((root(i), root(j)))
                    label[q] = p
    return sorted(str((i, len(s), None if i is None else root(i))) for i, s in sets)


@pytest.mark.parametrize("block", [2000, 6])
def test_similar_components(docs_of, messy_rows, block):
    rng = random.Random(2)
    words = messy_rows[11][1].split()[:3000]
    rows = list(messy_rows)
    # a group of near copies, a chain whose ends are not similar, and texts that share a part
    for i in range(40):
        w = words[:100]
        w[rng.randrange(100)] = f"n{i}"
        rows.append((100 + i, " ".join(w)))
    for i in range(12):
        rows.append((200 + i, " ".join(words[300 + 3 * i : 400 + 3 * i])))
    for i in range(20):
        rows.append((300 + i, " ".join(words[500:540] + words[600 + 50 * i : 640 + 50 * i])))
    rng.shuffle(rows)
    got = similar_components(docs_of(rows), 4, 85, block=block).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_components(rows, 85)


def test_similar_components_of_nothing(docs_of):
    assert similar_components(docs_of([])).count() == 0


def test_component_labels(spark):
    links = [(5, 3), (3, 9), (9, 7), (20, 10), (10, 20), (4, 4), (None, 1)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in (3, 5, 7, 9)} == {3} and got[20] == 10 and 4 not in got and 1 not in got
    assert {got[i] for i in range(100, 160)} == {100}


def test_compact_windows_are_tree_nodes():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, t = int(rng.integers(1, 60)), int(rng.integers(2, 6))
        v = rng.permutation(n).astype(np.uint64) + np.uint64(1)
        v[rng.random(n) < 0.05] = 0
        want = set()
        for c in np.flatnonzero(v).tolist():
            left = right = c
            while left > 0 and v[left - 1] > v[c]:
                left -= 1
            while right < n - 1 and v[right + 1] > v[c]:
                right += 1
            if right - left + 1 >= t:
                want.add((left, c, right))
        assert set(zip(*[x.tolist() for x in compact_windows(v, t)])) == want


def test_near_passages(docs_of, messy_rows):
    words = messy_rows[11][1].split()
    part = words[1000:1060]
    near = part[:25] + ["changed"] + part[26:]
    far = [w if i % 8 else "no" for i, w in enumerate(part)]
    rows = [
        *messy_rows,
        (40, " ".join(words[2000:2100] + part + words[2100:2200])),
        (41, " ".join(words[3000:3033] + near + words[3100:3200])),
        (42, " ".join(words[4000:4100] + far)),
        (43, " ".join(words[5000:5100])),
        (43, " ".join(words[5000:5100])),
    ]
    rows = [r for r in rows if r[0] != 8]
    got = {}
    for r in near_passages(docs_of(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    [a], [b] = got[40], got[41]
    assert a.passages and {p.match for p in a.passages} == {41}
    assert b.passages and {p.match for p in b.passages} == {40}
    assert all(0.8 <= p.similarity <= 1 for p in a.passages)
    assert 100 <= a.passages[0].start <= 110 and 150 <= a.passages[-1].end <= 160
    for i in (4, 5, 6, 7, 42, 43, None):
        assert all(r.n_repeated == 0 for r in got[i])
    assert got[1][0].n_repeated == got[2][0].n_repeated == 120
    assert near_passages(docs_of([])).count() == 0


def test_near_passages_of_one_pair(docs_of):
    w = [f"w{i}" for i in range(400)]
    new = [f"n{i}" for i in range(8)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:200] + new + w[200:]))]
    got = {r.doc_id: r for r in near_passages(docs_of(rows)).collect()}
    assert got[1].n_repeated == 400 and 400 <= got[2].n_repeated <= 408


def test_near_passages_lose_no_link(docs_of):
    """A passage held twice by a document, and variants that are like each other, not the first."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows, twice, sets = [], [], {}
    for i in range(8):
        p = word(70)
        rows.append((100 + i, " ".join(word(40) + p + word(90) + p + word(30))))
        rows.append((200 + i, " ".join(word(25) + p + word(25))))
        twice.append(100 + i)
    base = word(50)
    for i in range(12):  # pairs 2k, 2k + 1 are nearly alike, others share half of the words
        v = list(base)
        for at in rng.choice(50, 6, replace=False):
            v[at] = f"pair{i // 2}-{at}" if i % 2 == 0 else v[at]
        if i % 2:
            v = list(sets[299 + i])
            v[25] = "other"
        sets[300 + i] = v
        rows.append((300 + i, " ".join(word(10) + v + word(10))))
    got = {r.doc_id: r for r in near_passages(docs_of(rows)).collect()}
    for i in twice:
        assert 140 <= got[i].n_repeated <= 165 and got[i].passages[0].match == i + 100
    shingles = {i: {tuple(v[j : j + 5]) for j in range(46)} for i, v in sets.items()}
    for i, x in shingles.items():
        like = [k for k, y in shingles.items() if k != i and len(x & y) >= 0.8 * len(x | y)]
        assert like and {p.match for p in got[i].passages} >= {min(like)}


def test_near_passages_of_words_said_over_and_over(docs_of):
    """Windows of few distinct shingles, against brute force; a run is one passage, not one per shift."""
    say = lambda *runs: " ".join(" ".join([w] * n) for w, n in runs)
    rows = [
        (1, say(("the", 100))),
        (2, say(("the", 60))),
        (3, say(("of", 30), ("the", 40))),
        (4, say(("of", 48), ("the", 2), ("and", 60))),
        (5, say(("of", 52), ("and", 50))),
        (6, say(("a", 3), ("of", 55))),
        (7, say(("x y", 40))),
        (8, say(("y x", 31))),
        (9, say(("once", 80))),
        (9, say(("once", 70))),
        (10, say(("the", 49))),
    ]
    sets = {}
    for n, (_, t) in enumerate(rows):
        w = t.split()
        sets[n] = [{tuple(w[j : j + 5]) for j in range(k, k + 46)} for k in range(len(w) - 49)]
    want, partner = [], {}
    for n, (i, t) in enumerate(rows):
        hit = set()
        for k, x in enumerate(sets[n]):
            assert len(x) <= 8
            for m, (o, _) in enumerate(rows):
                if o != i and any(len(x & y) >= 0.8 * len(x | y) for y in sets[m]):
                    hit |= set(range(k, k + 50))
                    partner.setdefault(i, set()).add(o)
        want.append((i, len(t.split()), len(hit)))
    got = near_passages(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_repeated) for r in got) == sorted(want)
    found = {r.doc_id: r.passages for r in got}
    assert [(p.start, p.end, p.match, p.similarity) for p in found[1]] == [(0, 100, 2, 1.0)]
    for i, p in found.items():
        assert {x.match for x in p} <= partner.get(i, set()) and bool(p) == (i in partner)


def test_passing_runs_are_all():
    from tabulant.llm.passages import passing_runs, widest

    rng = np.random.default_rng(6)
    for case in range(60):
        a = rng.integers(0, 4 if case % 3 == 0 else 1000, 90)
        b = np.concatenate([a[50:80], rng.integers(0, 1000, 4), a[:25], a[28:50], a[5:20]])
        b[rng.random(len(b)) < 0.03] = 7
        for most in (1 << 22, 60):
            want, runs = {}, passing_runs(a, b, 10, 0.8, most)
            for i in range(len(a) - 9):
                for k in range(len(b) - 9):
                    x, y = set(a[i : i + 10].tolist()), set(b[k : k + 10].tolist())
                    if len(x & y) / len(x | y) >= 0.8:
                        want[i, k] = len(x & y) / len(x | y)
            got = [(i, i - d) for x, y, d, _ in runs for i in range(x, y + 1)]
            assert len(got) == len(set(got)) and set(got) == set(want)
            assert all(j == max(want[i, i - d] for i in range(x, y + 1)) for x, y, d, j in runs)
            wide = widest(runs)
            for side in (0, 1):
                held = {i - side * d for x, y, d, _ in wide for i in range(x, y + 1)}
                assert held == {g[side] for g in want}


def test_pairs_of_a_cell_bring_each_span_once(spark):
    """Pairs of large groups: texts sent grow with the spans of a cell, not with its pairs."""
    from tabulant.llm.passages import in_cells

    groups = [range(1000, 1200), range(5000, 5050), *([i, i + 1] for i in range(9000, 9040, 2))]
    want = {(a, b) for g in groups for a in g for b in g if a < b}
    linked = spark.createDataFrame(sorted(want), "a long, b long")
    got = [tuple(r) for r in in_cells(linked, 4).collect()]
    assert len(got) == len(want) and {x[:2] for x in got} == want
    sent = {(cell, x) for a, b, cell in got for x in (a, b)}
    assert len(sent) < len(want) / 10


def test_alike_runs_of_many_pairs():
    """The same runs as pair by pair: edits, shifts, tokens said again, and copies far apart."""
    from tabulant.llm.passages import Spans, alike_runs, passing_runs, widest

    rng = np.random.default_rng(9)
    base, texts = rng.integers(0, 10**6, 160), []
    for case in range(40):
        t = base.copy()
        t[rng.random(160) < 0.04] = rng.integers(0, 10**6)
        if case % 2:
            at = int(rng.integers(10, 150))
            t = np.concatenate([t[:at], rng.integers(0, 10**6, case % 5), t[at + case % 3 :]])
        if case % 4 == 2:
            t = np.concatenate([t[100:], t[:70], t[20:60]])
        if case % 5 == 3:
            t[rng.random(len(t)) < 0.1] = 7
        if case % 8 == 7:
            t = rng.integers(0, 6, 60)
        texts.append(t[int(rng.integers(0, 30)) :].astype(np.uint32))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    for least in (10, 21):
        want = []
        for x, y in zip(a.tolist(), b.tolist()):
            for u, v, d, j in widest(passing_runs(texts[x], texts[y], least, 0.8)):
                want.append((x, u, v, y, u - d, j))
        got = alike_runs(Spans(texts, least), a, b, least, 0.8)
        assert len(want) > 1000 and sorted(zip(*(x.tolist() for x in got))) == sorted(want)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 12)) * rng.uniform(0.5, 2, size=(1500, 1))
    rows = [(i, x.tolist(), 1, 2) for i, x in enumerate(v)]
    odd = [None, [0.0] * 12, [None] + [1.0] * 11, [float("nan")] * 12, [float("inf")] * 12, [1.0], []]
    rows += [(2000 + 20 * i, x, 1, 2) for i, x in enumerate(odd)] + [(None, v[0].tolist(), 1, 2)]
    rows += [(3, v[3].tolist(), 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int, block int")
    asked = df.where("vec_id % 20 = 0")
    got = nearest(df, asked, 10, shards=3, query_rows=30).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(range(0, 1500, 20))
    hits = 0
    for q, rs in found.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 11)) and q not in [r.vec_id for r in rs]
        assert all(abs(r.score - float(v[q] @ v[r.vec_id])) < 1e-9 for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        s = v @ v[q]
        s[q] = -np.inf
        hits += len({r.vec_id for r in rs} & set(np.argsort(-s)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(found)
    few = df.where("vec_id < 4")
    assert nearest(few, few, 20).count() == 12
    assert nearest(df.limit(0), asked).count() == 0


def test_nearest_among_copies(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1500, 12))
    v[rng.permutation(1500)[:500]] = v[7]  # a third of the rows are copies of one
    v[[20, 40, 60]] = v[[80, 100, 120]]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = nearest(df, df.where("vec_id % 20 = 0"), 10, shards=2).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(range(0, 1500, 20))
    hits = 0
    for q, got in found.items():
        assert len(got) == 10
        s = np.array([math.fsum(x) for x in v * v[q]])
        s[q] = -np.inf
        hits += len(set(got) & set(np.lexsort((np.arange(1500), -s))[:10].tolist()))
        if np.array_equal(v[q], v[7]):  # ties go to the smaller ids
            same = [i for i in np.flatnonzero((v == v[7]).all(1)).tolist() if i != q]
            assert set(got) & set(same) <= set(same[:10])
    assert hits >= 0.97 * 10 * len(found)


def test_pipeline_stages(spark, docs_of, tmp_path, messy_rows):
    import corpus_pipeline as pipeline

    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    rows = [(i, t) for i, t in messy_rows if i != 8]
    rows += [(70, "see one two three four five six seven eight nine ten"), (71, "mail me.1@example.com now")]
    docs = docs_of(rows)
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert out.columns == docs.columns
            docs = pipeline.written(out)
            seen[name] = sorted(str(r.doc_id) for r in docs.collect())
    first = seen["language"]
    assert not {"4", "5", "6", "7"} & set(first) and {"1", "3", "70", "71"} <= set(first)
    assert "2" not in seen["near_duplicates"] and seen["near_duplicates"].count("1") == 1
    assert "70" not in seen["decontaminate"] and "71" in seen["decontaminate"]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert "me.1@" not in text[71] and text[1] == messy_rows[0][1]
    assert sorted(str(r.doc_id) for r in out.collect()) == seen["private_data"]
    empty = docs_of([])
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
