import random

import numpy as np
import pytest
import xxhash

from tolparse.llm import simhash

DOCS = "doc_id long, text string, fp string, root int"


def plain(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    value = 0
    for b in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) > len(shingles):
            value |= 1 << b
    return value


def brute(fps):
    """Smallest id reachable over at most two bits."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one Two", "A b C d", "É été  x\x0by\x1cz\u00a0w " * 30, "the same words again and again " * 400])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_fingerprint_equals_builtin_hash(spark):
    got = spark.sql("SELECT xxhash64('a b c') AS h").first().h & (1 << 64) - 1
    assert got == xxhash.xxh64_intdigest(b"a b c", 42)


def near(rng, base, bits):
    for b in rng.sample(range(64), bits):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("crowd", [2, 5, 48])
def test_components_equal_brute_force(spark, crowd):
    rng = random.Random(crowd)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        chain = v
        for _ in range(rng.randrange(1, 12)):
            chain = near(rng, chain, rng.randrange(1, 4))
            values.add(chain)
    centre = rng.getrandbits(64)
    values |= {near(rng, centre, rng.randrange(0, 3)) for _ in range(150)}
    fps = dict(enumerate(rng.sample(sorted(values), len(values))))
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in fps.values()], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(frame, crowd)).collect()}
    by_value = {int(np.uint64(v).astype(np.int64)): i for i, v in fps.items()}
    want = brute(fps)
    groups = {}
    for v, i in by_value.items():
        groups.setdefault(got.get(v, v), set()).add(i)
    expected = {}
    for i, r in want.items():
        expected.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_crowds_that_cross_batches():
    import pyarrow as pa

    rows = [(7, i) for i in range(1, 90)] + [(8, 1), (8, 3)] + [(9, 5)]
    parts = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in p]), pa.array([f for _, f in p])], ["variant", "fp"]) for p in (rows[:20], rows[20:70], rows[70:91], rows[91:])]
    out = [r for b in simhash._match(10)(iter(parts)) for r in b.to_pylist()]
    assert sorted(r["a"] for r in out if r["b"] is None) == list(range(1, 90))


def test_documents(spark, sf_dir):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(5, text, "x", 1), (3, text.upper(), None, None), (9, "other words here entirely", "", 0), (9, "other words here entirely", "", 0), (2, None, "", 0), (8, "", "", 0), (7, " \n", "", 0)]
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(2, 2), (3, 3), (5, 3), (7, 2), (8, 2), (9, 9), (9, 9)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = simhash.deduplicated(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 9] and set(kept[0].asDict()) == {"doc_id", "text", "fp", "root"}


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    fps = {i: plain(t) for i, t in texts.items()}
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = brute(fps)
    assert got == {i: (fps[i], want[i]) for i in texts}
