import random

import pytest

import corpus_pipeline
from tolparse.llm import similar, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def close(texts):
    return [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]


def smallest(texts):
    root = list(range(len(texts)))
    for i, j in close(texts):
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("reach", [2, 24])
def test_deduplicated_equals_brute_force(spark, reach):
    rng = random.Random(reach)
    texts = [None, "", "one two", "One  TWO", "one two three"]
    for base in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 80, 200]))]
        texts += [edited(rng, words, rng.randrange(0, max(2, len(words) // 20))) for _ in range(40 if base == 0 else 5)]
    passage = " ".join(f"p{i}" for i in range(60))  # one that many otherwise different texts hold
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([3, 10, 60]))) for _ in range(60)]
    rng.shuffle(texts)
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert len(close(texts)) > 50
    assert sorted(r.doc_id for r in similar.deduplicated(frame, reach).collect()) == sorted(smallest(texts))


def test_stage_leaves_no_edited_copy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf_dir)
    alone = simhash.deduplicated(docs.select(*corpus_pipeline.COLUMNS))
    before, after = ([r.text for r in d.collect()] for d in (alone, kept))
    assert len(close(before)) == 2 and not close(after) and len(after) == len(before) - 2 and kept.columns == alone.columns
    assert dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("operator", [simhash, similar])
def test_null_and_repeated_ids(spark, operator):
    texts = [(None, "a text without an id"), (None, "a text without an id"), (None, "one more, quite different from it"), (4, "red green blue black white"), (4, "some other words stand here"), (2, "RED green blue black white")]
    rows = [(i, t, "en", "s", 1) for i, t in texts]
    got = sorted(((r.doc_id, r.text) for r in operator.deduplicated(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([texts[0], texts[2], texts[4], texts[5]], key=str)
