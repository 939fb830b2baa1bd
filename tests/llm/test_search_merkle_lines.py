"""Ranked search, Merkle manifest and line dedup against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tolparse.llm import line_dedup, merkle, ranked_search
from tolparse.llm.queries import QUERIES

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
lower = lambda text: re.sub("[A-Z]", lambda c: c[0].lower(), text)


# Ranked search.


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))


def brute_search(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counts:
            m = 50 + 50 * c.total() * n_docs // n_terms if n_terms else 50
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank + 1, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "É1", "x", "日本"]
    text = lambda size: rng.choice([" ", "-", "\x7f", "\n"]).join(rng.choice(words[: rng.choice([3, 20, 64])]) for _ in range(size))
    docs = [(rng.choice([k, k, k, None, 7]), text(rng.choice([0, 1, 5, 30, 200]))) for k in range(n)]
    docs += [(1000 + k, "W1 w2 W2") for k in range(40)] + [(5000, None), (5001, ""), (5002, "!?"), (5003, "zz " * 20_000)]
    items = [(k, text(rng.choice([1, 4, 12]))) for k in range(12)] + [(3, "w1 W2 unseen"), (None, "x X zz"), (90, None), (91, ""), (92, "unseen")]
    return docs, items


def searched(spark, docs, items, k, **more):
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, score string, question int")
    q = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, rank int")
    rows = ranked_search.search(d, q, k, **more).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=repr)


@pytest.mark.parametrize(("seed", "k", "block"), [(1, 5, 1024), (2, 50, 5)])
def test_search_equals_brute_force(spark, monkeypatch, seed, k, block):
    monkeypatch.setattr(ranked_search, "DOCS", 16)  # bounds rise within a task
    docs, items = corpus(seed, 300)
    assert searched(spark, docs, items, k, block=block) == brute_search(docs, items, k)


def test_search_over_nothing(spark):
    docs, items = corpus(5, 5)
    assert searched(spark, [], items, 5) == searched(spark, docs, [], 5) == searched(spark, [(1, "!"), (2, None)], items, 5) == []


def test_bounds_are_safe_and_tight(spark):
    """A term's stored kth impact is reached by k documents and within a step of the true one; the largest is exact."""
    docs, _ = corpus(6, 400)
    vocabulary = {w: k for k, w in enumerate(sorted({w.encode() for _, t in docs for w in terms(t)}))}
    indexed = ranked_search.index(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary)
    counts = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in counts), sum(c.total() for c in counts)
    got = {r.term: r for r in ranked_search.term_bounds(indexed, n_docs, n_terms, 20).collect()}
    assert len(got) == len(vocabulary)
    for w, k in vocabulary.items():
        own = sorted((10**9 * c[x] // (1000 * c[x] + 20 * (50 + 50 * c.total() * n_docs // n_terms)) for c in counts if c[x := w.decode()]), reverse=True)
        assert got[k].df == len(own) and got[k].most == own[0]
        assert got[k].kth == (own[19] // ranked_search.STEP * ranked_search.STEP if len(own) >= 20 else 0)


def test_pruning_drops_candidates():
    """Terms whose bounds together stay below the question's generate none; at an equal bound they do."""
    q = ranked_search.Questions([[0, 1, 2]], np.array([10, 5, 1]), np.array([100, 100, 100]), np.array([50, 0, 0]), 1)
    assert q.seeds.tolist() == [500] and q.terms[0].tolist() == [0, 1, 2]
    kept = lambda least: q.essential(np.array([least]))[2].tolist()
    assert kept(500) == [100] and kept(601) == [0 + 600] and kept(600) == [100] and kept(100) == [0] and kept(101) == [100]


# Merkle manifest.


def brute_manifest(rows):
    """The contract, with whole levels held as lists."""
    enc = lambda values: "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)

    def tree(nodes):
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for k, own in enumerate(at):
                first = own // 2 * 2
                paths[k].append(("".join(level[first:own]), "".join(level[own + 1 : first + 2])))
            level = [sha("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
            at = [k // 2 for k in at]
        return level[0], paths

    groups = defaultdict(list)
    for doc, source, lang, n, text in rows:
        leaf = sha(enc((doc, source, lang, n, text)))
        bad = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0
        groups[lang].append((doc is not None, doc or 0, leaf, sha(enc((doc, source, lang, None if n is None else n + 1, text))) if bad else leaf, doc))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g])]) for g in names]
    root, over = tree([t[0] for t in trees])
    out = []
    for name, (subroot, paths), above in zip(names, trees, over, strict=True):
        for (_, _, leaf, other, doc), path in zip(sorted(groups[name]), paths, strict=True):
            again = other
            for before, after in path + above:
                again = sha(before + again + after)
            out.append((doc, leaf, subroot, root, sha("".join(b + a for b, a in path + above)), again, again == root))
    return sorted(out, key=repr)


ODD = [(1, None, None, None, None), (1, "", "", 0, ""), (None, "a", "en", 3, "x"), (None, "a", "en", 3, "x"), (7, "ü", "é", 5, "日本 🙂"), (-4, "s", "z", 2**63 - 2, "t" * 100_000), (9, "0", "Z", 1, "-")]


@pytest.mark.parametrize(("rows", "levels"), [(ODD, 5), (ODD[:1], 5), ([(k, "s", "en" if k % 9 else "de", k, f"text {k}") for k in range(333)] + ODD, 5), ([(k, None, f"l{k % 70}", None, "") for k in range(100)], 3), ([(k, "s", "en", 1, "t") for k in range(16)] + ODD[:1] * 2, 1)])
def test_manifest_equals_brute_force(spark, rows, levels):
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, idx string, n int, path string")
    got = merkle.verified(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, levels=levels).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows)


def test_wider_fanout_verifies(spark):
    rows = [(k, "s", f"l{k % 3}", k, "t") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.verified(df, F.col("doc_id") % 10 == 3, fanout=5, levels=2).collect()
    assert {r.doc_id for r in got if not r.verified} == {k for k in range(100) if k % 10 == 3} and len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 3
    assert merkle.verified(df.limit(0), F.lit(True)).count() == 0


# Line dedup.


def brute_lines(rows, min_chars=10):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    last = lambda doc: (doc is None, doc or 0)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(last(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < 2 or min(holders[key(x)]) == last(doc)]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    lines = ["", "short", "a line of text", "  A Line of TEXT\t", "a line of text\r", "\x0b\x0cÜber den Wolken", "über den wolken", "Über den wolken", "123456789", "1234567890", " 日本語日本語日本語日", "\xa0 no blank here", "x" * 70_000]
    rows = [(rng.choice([k, k, None, 5]), "\n".join(rng.choice(lines) if rng.random() < 0.7 else f"own line number {k} {j}" for j in range(rng.choice([0, 1, 3, 30])))) for k in range(200)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "only here, once"), (904, "twice in one\ntwice in one"), (905, "a line of text\n" * 2000)] + [(906, "all rows are alike\nin here")] * 30
    df = spark.createDataFrame([(*r, 1, "clash", 0) for r in rows], "doc_id long, text string, pos int, places string, n_lines long")
    for hot in (1, 4096):
        line_dedup.HOT, before = hot, line_dedup.HOT
        try:
            got = line_dedup.dedup_lines(df).drop("text").collect()
        finally:
            line_dedup.HOT = before
        assert sorted(map(tuple, got), key=repr) == brute_lines(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_higher_threshold(spark):
    rows = [(k, "ten chars and more\nonly in three" if k < 3 else "ten chars and more\nlast") for k in range(5)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=4).collect()}
    assert got == {0: rows[0][1], 1: "only in three", 2: "only in three", 3: "last", 4: "last"}


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_merkle", "op13_line_dedup"])
def test_plans_have_no_cross_join(spark, sf_dir, name):
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
