import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tolparse.llm import hidden_markov, multi_index, piece_counts, quality, queries
from tolparse.llm.common import fold, word_count


def test_word_count_and_fold(spark):
    df = spark.createDataFrame([(1, "a\x0bb  c\u00a0d"), (2, None), (3, ""), (None, " x ")], "doc_id long, text string")
    got = {r.doc_id: (r.n, r.f) for r in df.select("doc_id", word_count(F.col("text")).alias("n"), fold(7).alias("f")).collect()}
    assert got == {1: (3, zlib.crc32(b"1") % 7), 2: (0, zlib.crc32(b"2") % 7), 3: (0, zlib.crc32(b"3") % 7), None: (1, 0)}


# quality ---------------------------------------------------------------------------------------------------------


def test_factorisation_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    machine = quality.Machine(np.zeros(quality.STATS), np.ones(quality.STATS))
    machine.linear, machine.bias = rng.normal(size=len(machine.linear)), 0.3
    machine.factors = rng.normal(0, 0.3, machine.factors.shape)
    doc, bucket, value, stats = quality.Featurizer()(["a b b c", None, "Some OTHER words | here!!\nx"], [7, None, 30])
    z = machine.scaled(stats)
    for d in range(3):
        x = np.zeros(len(machine.linear))
        x[bucket[doc == d]] = value[doc == d]
        x[quality.BUCKETS :] = z[d]
        on = np.flatnonzero(x)
        logit = machine.bias + machine.linear @ x + sum(x[i] * x[j] * (machine.factors[i] @ machine.factors[j]) for i, j in itertools.combinations(on, 2))
        assert np.isclose(machine._logit(doc, bucket, value, z)[0][d], logit)


def test_query_scores_by_the_definition(spark, sf_dir):
    """The query's score, from hashed words, statistics and all pairs of features one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r.doc_id: r.score for r in queries.op2_quality(spark, sf_dir).collect()}
    some = sorted(docs.collect(), key=lambda r: len(r.text or ""))
    assert len(got) == len(some)
    for r in [*some[:40:8], *some[60:90:10]]:
        raw = (r.text or "").encode()
        words = raw.lower().split()
        count = Counter(zlib.crc32(w) % quality.BUCKETS for w in words)
        length = sum(n * n for n in count.values()) ** 0.5
        x = {b: n / length for b, n in count.items()}
        z = np.clip((np.array(quality.statistics(raw, words, r.n_chars)) - machine.mean) / machine.scale, -5, 5)
        x |= {quality.BUCKETS + k: v for k, v in enumerate(z)}
        logit = machine.bias + sum(machine.linear[i] * v for i, v in x.items()) + sum(x[i] * x[j] * float(machine.factors[i] @ machine.factors[j]) for i, j in itertools.combinations(x, 2))
        assert np.isclose(got[r.doc_id], 1 / (1 + np.exp(-np.clip(logit, -40, 40))), rtol=1e-6, atol=1e-9)


def test_gradient_lowers_the_loss():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["good", "fine", "text"]) for _ in range(20)) if k % 2 else " ".join(rng.choice(["bad!!", "JUNK", "text"]) for _ in range(20)) for k in range(120)]
    parts, label = quality.Featurizer()(texts, [None] * 120), np.array([k % 2 for k in range(120)], float)
    machine = quality.Machine(parts[3].mean(axis=0), parts[3].std(axis=0) + 1e-3).fit(*parts, label)
    assert ((machine.score(*parts) >= 0.5) == label).all()


def test_quality_held_out(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in queries.op2_quality(spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(rows[i].score, q) for i, q in labels.items() if rows[i].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held if x for b, y in held if not y]
    assert sum(pairs) / len(pairs) > 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in rows.items())


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "fine text", 9, 0.5), (2, None, None, None), (3, "", 0, 1.0), (3, "", 0, 1.0), (None, "x " * 50000, 100000, 0.0)], "doc_id long, text string, n_chars long, score double")
    labels = spark.createDataFrame([(i, q) for i in range(1, 40) for q in (0, 1, None)], "doc_id long, quality int")
    machine = quality.train(docs, labels)
    assert machine is not None
    got = quality.scores(docs, machine).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and got[2].score == got[3].score
    assert quality.train(docs, labels.filter("quality = 1")) is None and quality.train(docs.limit(0), labels) is None
    assert {r.score for r in quality.scores(docs, None).collect()} == {quality.UNKNOWN}
    assert quality.scores(docs.limit(0), machine).count() == 0


# nearest neighbours ----------------------------------------------------------------------------------------------


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(5)
    order = list(multi_index.MultiIndex.traverse(a, b))
    sums = [a[i] + b[j] for i, j in order]
    assert len(set(order)) == 35 and sums == sorted(sums)


def exact(vectors, queries_, k=5):
    ids = sorted(vectors)
    unit = {i: np.asarray(v, np.float64) / np.linalg.norm(np.asarray(v, np.float64)) for i, v in vectors.items()}
    return {q: sorted((-float(unit[q] @ unit[i]), i) for i in ids if i != q)[:k] for q in queries_}


def test_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    want = exact(vectors, [i for i in vectors if i % 50 == 0])
    rows = queries.op3_multi_index(spark, sf_dir).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == want.keys() and all([r["rank"] for r in own] == [1, 2, 3, 4, 5] for own in got.values())
    unit = {i: np.asarray(v, np.float64) / np.linalg.norm(np.asarray(v, np.float64)) for i, v in vectors.items()}
    assert all(np.isclose(r.score, unit[q] @ unit[r.vec_id], rtol=1e-12) for q, own in got.items() for r in own)
    assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for own in got.values() for a, b in itertools.pairwise(own))
    hits = sum(len({r.vec_id for r in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_vectors_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [0.0, 2.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [None, 1.0]), (5, []), (300, [1.0, 2.0, 3.0]), (2, [1.0, 1.0])]
    rows += [(i, [-1.0, 0.5]) for i in range(1000, 1400)] + [(1050, [-1.0, 0.5])] * 100
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in multi_index.nearest(df, F.col("vec_id") % 50 == 0, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    valid = {i: v for i, v in rows if v and len(v) == 2 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    want = exact(valid, [i for i in valid if i % 50 == 0])
    assert {q: [i for _, i in sorted(own)] for q, own in got.items()} == {q: [i for _, i in own] for q, own in want.items()}
    few = multi_index.nearest(df.filter("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]
    assert multi_index.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert multi_index.nearest(df.filter("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


# language model --------------------------------------------------------------------------------------------------


def all_paths(model, seq):
    """Likelihood and expected counts by summing over every path of states."""
    s = len(model.start)
    total, start, move, emit = 0.0, np.zeros(s), np.zeros((s, s)), np.zeros_like(model.emit)
    for path in itertools.product(range(s), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, c in zip(path, path[1:], seq[1:], strict=False):
            p *= model.move[a, b] * model.emit[c, b]
        total += p
        start[path[0]] += p
        for a, b in itertools.pairwise(path):
            move[a, b] += p
        for a, c in zip(path, seq, strict=True):
            emit[c, a] += p
    return total, start / total, move / total, emit / total


def test_rows_that_share_an_id_have_lists_of_their_own(spark):
    """Against all rows: a row's own vector under its own id is no candidate, another row of that id is."""
    rng = np.random.default_rng(3)
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [1.0, 1.0])]
    rows += [(int(i), [float(x) for x in v]) for i, v in zip(rng.integers(0, 120, 400), rng.standard_normal((400, 2)), strict=True)]
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    x = np.array([v for _, v in distinct])
    want = []
    for i, v in distinct:
        if i % 50 == 0:
            score = (x @ np.array(v)) / np.linalg.norm(x, axis=1) / np.linalg.norm(v)
            found = sorted((-round(s, 12), j) for s, (j, w) in zip(score, distinct, strict=True) if (j, w) != (i, v))[:5]
            want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(found)]
    got = multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, recall=1.0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in got) == sorted(want)


def test_recall_of_the_index_on_more_rows(spark):
    """At least 0.9 of the true neighbours, over all queries."""
    sf = "/root/testdata/sf0.01"
    rows = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = {(int(ids[q]), int(ids[j])) for q in np.flatnonzero(ids % 50 == 0) for j in [n for n in np.argsort(-(x @ x[q]), kind="stable") if n != q][:5]}
    got = {(r.query_id, r.vec_id) for r in queries.op3_multi_index(spark, sf).collect()}
    assert len(got & true) >= 0.9 * len(true)


def test_recursions_equal_all_paths():
    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hidden_markov.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    sequences = [rng.integers(0, 5, n) for n in (1, 4, 2, 6, 4)]
    chunk = hidden_markov.Chunk(sequences)
    want = [all_paths(model, s) for s in sequences]
    assert np.allclose(chunk.log10(chunk.forward(model)[2]), [np.log10(w[0]) for w in want])
    start, move, emit, fit, _ = chunk.expected(model)
    for got, k in ((start, 1), (move, 2), (emit, 3)):
        assert np.allclose(got, sum(w[k] for w in want))
    assert np.isclose(fit, sum(np.log10(w[0]) for w in want))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_segments_change_nothing(size):
    rng = np.random.default_rng(size)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hidden_markov.Model(norm(rng.random(4), 0), norm(rng.random((4, 4)), 1), norm(rng.random((9, 4)), 0))
    sequence = [rng.integers(0, 9, 50)]
    for whole, parts in zip(hidden_markov.expected_counts(sequence, model, 50), hidden_markov.expected_counts(sequence, model, size), strict=True):
        assert np.allclose(whole, parts)
    assert np.allclose(hidden_markov.log10_likelihoods(sequence, model, 50), hidden_markov.log10_likelihoods(sequence, model, size))


def test_rounds_improve(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.lit(False).alias("held_out"), "text")
    seen = hidden_markov.Counts.of(hidden_markov.token_counts(docs))
    rows = hidden_markov.encoded(docs, seen)
    _, history = hidden_markov.baum_welch(rows, hidden_markov.Model.fresh(seen.mass), seen.mass, 4)
    assert history == sorted(history) and history[-1] > history[0]


def test_base_scores_and_gain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs}
    count = Counter(t for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in own)
    n, v = sum(count.values()), len(count)
    rows = queries.op8_hidden_markov(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[t] > 0 for t in own), n)
        assert np.isclose(r.base_score, sum(np.log10((count[t] + 1) / (n + v + 1)) for t in own))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


TEXTS = [(1, "aa bb aa zz"), (2, "cc bb"), (3, "aa dd Bb"), (14, "aa xx"), (9, None), (9, None), (None, "dd")]


@pytest.mark.parametrize("frequent, vocabulary", [(1 << 18, 2), (1 << 18, 0), (0, 9), (3, 1), (1 << 18, 1 << 14)])
def test_scores_equal_all_paths(spark, monkeypatch, frequent, vocabulary):
    """The query's score by the definition: the sum over all paths of states, each word by its symbol and its share of its class."""
    monkeypatch.setattr(hidden_markov, "FREQUENT", frequent)
    monkeypatch.setattr(hidden_markov, "VOCABULARY", vocabulary)
    monkeypatch.setattr(hidden_markov, "OFTEN", 1)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    held = F.col("doc_id") == 14
    marked = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")).withColumn("row", F.monotonically_increasing_id())
    _, _, seen, model = hidden_markov.train(marked, 2, 2)
    words = {i: [*(t or "").lower().encode().split(), None] for i, t in TEXTS}
    count = Counter(w for i, t in TEXTS if i != 14 for w in [*(t or "").lower().encode().split(), None])
    assert seen.tokens == sum(count.values()) and seen.distinct == len(count)
    key = lambda w: hidden_markov.END_KEY if w is None else hidden_markov.word_key(w)
    own = {w: int(seen.symbol[list(seen.keys).index(key(w))]) for w in count if key(w) in seen.keys}
    own = {w: s for w, s in own.items() if s >= hidden_markov.CLASSES}
    assert len(own) <= vocabulary and (frequent < 9 or len(own) == min(vocabulary, len(count) - 1))
    share = {}
    for w in [*count, b"xx"]:
        members = [v for v in count if v not in own and key(v) >> 52 == key(w) >> 52]
        share[w] = 1.0 if w in own else (count[w] + 1) / (sum(count[v] + 1 for v in members) + 1)
    # a state's words, and one unseen word for each class, have probability one
    room = sum(model.emit[c] / seen.mass[c] * (sum(count[v] + 1 for v in count if v not in own and key(v) >> 52 == c) + 1) for c in range(hidden_markov.CLASSES))
    assert np.allclose(room + model.emit[hidden_markov.CLASSES :].sum(axis=0), 1)
    got = hidden_markov.score_documents(docs, held, 2, 2).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        symbols = [own.get(w, key(w) >> 52) for w in words[r.doc_id]]
        want = np.log10(all_paths(model, np.array(symbols))[0]) + sum(np.log10(share[w]) for w in words[r.doc_id])
        assert np.isclose(r.score, want) and r.held_out == (r.doc_id == 14) and r.n_known == sum(count[w] > 0 for w in words[r.doc_id])


@pytest.mark.parametrize("frequent", [1 << 18, 0, 2])
def test_language_model_edge_cases(spark, monkeypatch, frequent):
    monkeypatch.setattr(hidden_markov, "FREQUENT", frequent)
    rows = [(1, "A b b c", "q"), (2, None, "q"), (3, "", None), (3, "", None), (4, "zz b " * 3000, "q"), (16, "b new", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = hidden_markov.score_documents(docs, F.col("doc_id") == 16).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 3, 4, 16]
    last = next(r for r in got if r.doc_id == 16)
    assert (last.n_tokens, last.n_known, last.held_out) == (3, 2, True) and all(r.score < 0 and np.isfinite(r.score) for r in got)
    n, v = 6 * 1000 + 4 + 5, 5
    assert got[0].train_tokens == n and np.isclose(last.base_score, sum(np.log10(c / (n + v + 1)) for c in (3003, 1, 6)))
    assert hidden_markov.score_documents(docs.limit(0), F.col("doc_id") == 16).count() == 0
    alone = hidden_markov.score_documents(docs, F.lit(True)).collect()
    assert {r.train_tokens for r in alone} == {0} and {r.base_score for r in alone} == {0.0}


# piece counts ----------------------------------------------------------------------------------------------------


def reference(pieces, unknown, fallback):
    from tokenizers import Tokenizer, models

    return Tokenizer(models.Unigram([(p, -1e12 if s is None else s) for p, s in pieces], unk_id=unknown, byte_fallback=fallback))


def test_counts_equal_the_tokenizer(spark, sf_dir):
    pieces, unknown, fallback = piece_counts.vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    tokenizer = reference(pieces, unknown, fallback)
    counter = piece_counts.PieceCounter(pieces, fallback)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["a  b   c ", " ", "    lead", "日本語🙂 text\n\n\ttab", "x" * 3000, "\u2581 mark\u2581inside", "<0x0A> <s> </s> <unk>", "e\u0301\u00a0é"]
    for t in texts:
        assert counter(t) == len(tokenizer.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids), t[:80]


@pytest.mark.parametrize("fallback", [False])
def test_ties_and_unknowns(fallback):
    rng = random.Random(5)
    for _ in range(30):
        pieces = [("<unk>", None)] + [(p, float(-rng.randrange(1, 4))) for p in sorted({"".join(rng.choice("abc▁"[: 3 + (k == 0)]) for k in range(rng.randrange(1, 4))) for _ in range(12)})]
        if all(p.startswith("▁") and not p.strip("▁") for p, _ in pieces[1:]):
            continue
        counter, tokenizer = piece_counts.PieceCounter(pieces, fallback), reference(pieces, 0, fallback)
        for _ in range(20):
            text = "".join(rng.choice("abcdab ") for _ in range(rng.randrange(1, 15)))
            words = ["▁" + w for w in text.split(" ")]
            assert all(counter.viterbi(w) == len(tokenizer.encode(w, add_special_tokens=False).ids) for w in words), (pieces, text)


BYTES = [f"<0x{b:02X}>" for b in range(256)]


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("kind", ["fractions", "eighths", "whole, marks within"])
def test_any_scores_and_marks(fallback, kind):
    """Whole texts against an independent unigram tokenizer: fractions that round, eighths that tie, and pieces with marks within."""
    from tokenizers import Tokenizer, models

    rng = random.Random(f"{kind} {fallback}")
    score = {"fractions": lambda: -rng.random() * 3, "eighths": lambda: -rng.randrange(1, 24) / 8, "whole, marks within": lambda: float(-rng.randrange(1, 4))}[kind]
    for _ in range(40):
        made = {"".join(rng.choice("abcé▁") for _ in range(rng.randrange(1, 5))) for _ in range(14)} | {"▁a"}
        pieces = [("<unk>", None), *((b, None) for b in BYTES if fallback), *((p, score()) for p in sorted(made))]
        counter = piece_counts.PieceCounter(pieces, fallback)
        assert not counter.by_words or not any("▁" in p.lstrip("▁") for p in made)
        tokenizer = Tokenizer(models.Unigram([(p, 0.0 if s is None else s) for p, s in pieces], unk_id=0, byte_fallback=fallback))
        for _ in range(25):
            text = "".join(rng.choice("abcéd ab ") for _ in range(rng.randrange(1, 40)))
            assert counter(text) == len(tokenizer.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids), (pieces, text)


def test_piece_count_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello world", 5), (3, "hello world", 5)], "doc_id long, text string, n_pieces int")
    path = queries.tokenizer_path("piece_bpe_32k.model")
    assert sorted((r.doc_id, r.n_pieces) for r in piece_counts.piece_counts(df, path).collect())[:2] == [(1, 0), (2, 0)]
    assert piece_counts.piece_counts(df.limit(0), path).count() == 0
    assert piece_counts.PieceCounter([("▁a", -0.5), ("a", -0.5)], False)("a a") == 2 and piece_counts.PieceCounter([("▁a▁b", -1.0)], False)("a b") == 1
