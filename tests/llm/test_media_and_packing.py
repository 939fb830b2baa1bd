import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tolparse.llm import gif, packing, queries

DOCS = "doc_id long, text string, extra string, copies int"
ROWS = [(1, "Hello, world", "x", 1), (2, None, None, None), (3, "", "y", 2), (4, "Hello, world", "z", 0), (4, "Hello, world", "z", 0), (5, "ünï " * 9000, None, 1), (None, "no id", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.mark.parametrize("size", [192, 192 * 3, 192 * 257, 192 * 900])
@pytest.mark.parametrize("kind", ["noise", "zeros", "text"])
def test_gif_round_trip(size, kind):
    rng = random.Random(size)
    samples = {"noise": bytes(rng.randrange(256) for _ in range(size)), "zeros": bytes(size), "text": (b"the quick brown fox " * (size // 20 + 1))[:size]}[kind]
    frames = gif.decode(gif.encode(samples))
    assert b"".join(f.indices for f in frames) == samples
    assert sum(f.height for f in frames) == size // 192 and all(f.delay == gif.DELAY for f in frames)
    assert [f.disposal for f in frames] == [1 + n % 3 for n in range(len(frames))]


def test_stored_frames_by_the_rules():
    """Composes the stored frames of a long mixed text pixel by pixel."""
    rows = gif.FRAME_ROWS
    samples = (b"a few words " * 9000)[: 192 * 2 * rows] + ("ünï çödé 🙂 " * 9000).encode()[: 192 * rows] + (b"b " * 90000)[: 192 * (2 * rows + 5)]
    frames = gif.decode(gif.encode(samples))
    assert [f.local for f in frames] == [False, False, True, False, False, False] and [f.transparent for f in frames] == [None] + [32] * 5
    canvas = [[None] * 192 for _ in range(rows)]
    for f in frames:
        colours, before = gif.palette(8 if f.local else 7), [list(r) for r in canvas]
        for k, i in enumerate(f.indices):
            if i != f.transparent:
                canvas[k // 192][k % 192] = tuple(map(int, colours[i]))
        rgb, opaque = f.rgb(), f.opaque()
        assert all((tuple(map(int, rgb[y, x])) if opaque[y, x] else None) == canvas[y][x] for y in range(rows) for x in range(192))
        counts = [0] * 64
        for r, g, b in (c for row in canvas for c in row if c):
            counts[r // 64 * 16 + g // 64 * 4 + b // 64] += 1
        assert gif.histogram(f.canvas).tolist() == counts
        if f.disposal == 2:
            canvas = [[None] * 192 if y < f.height else canvas[y] for y in range(rows)]
        elif f.disposal == 3:
            canvas = before


def bits(codes, widths):
    total = at = 0
    for c, w in zip(codes, widths, strict=True):
        total |= c << at
        at += w
    return total.to_bytes((at + 7) // 8, "little")


def built(frames, size=(2, 2), common=((255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9))):
    """A GIF with 2-bit samples, each frame as literal codes between clear and end."""
    out = b"GIF89a" + size[0].to_bytes(2, "little") + size[1].to_bytes(2, "little") + bytes([0x81, 0, 0]) + bytes(x for c in common for x in c)
    for disposal, transparent, delay, (left, top, w, h), flags, samples in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + delay.to_bytes(2, "little") + bytes([transparent or 0, 0])
        codes, widths = [], []
        for s in samples:  # a clear code before each sample keeps all codes at three bits
            codes += [4, s]
            widths += [3, 3]
        data = bits([*codes, 5], [*widths, 3])
        out += b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (left, top, w, h)) + bytes([flags, 2]) + bytes([len(data)]) + data + b"\0"
    return out + b";"


def test_gif_disposal_and_transparency():
    whole = (0, 0, 2, 2)
    frames = gif.decode(built([(1, None, 10, whole, 0, [0, 1, 2, 3]), (2, 3, 5, whole, 0, [3, 3, 0, 3]), (3, None, 7, (1, 0, 1, 1), 0, [2]), (0, None, 1, (0, 0, 1, 1), 0, [1])]))
    red, green, blue, grey = (255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9)
    shown = [[tuple(map(int, p)) for p in f.rgb().reshape(-1, 3)] for f in frames]
    assert shown[0] == [red, green, blue, grey]
    assert shown[1] == [red, green, red, grey]  # transparent samples leave what was there
    assert shown[2][1] == blue and not frames[2].opaque()[0, 0]  # the second frame's area was cleared
    assert not frames[3].opaque()[0, 1] and shown[3][0] == green  # the third was undone
    assert [f.delay for f in frames] == [10, 5, 7, 1]


def test_gif_interlace_and_errors():
    frames = gif.decode(built([(0, None, 0, (0, 0, 1, 4), 0x40, [0, 2, 1, 3])], (1, 4)))
    assert list(frames[0].indices) == [0, 1, 2, 3]
    for broken in (b"", b"GIF89a", b"JFIF" * 9, gif.encode(bytes(192))[:-5], gif.encode(bytes(192))[:-1] + b"\x77"):
        with pytest.raises(ValueError):
            gif.decode(broken)


def test_lzw_codes_grow_and_restart():
    runs = gif.lzw_codes(bytes(np.random.default_rng(1).integers(0, 256, 9000, np.uint8)))
    assert len(runs) == 3 and all(len(r) == 4096 - 258 for r in runs[:-1])
    assert gif.lzw_decode(gif.pack_codes(runs), 8, 10**6) == bytes(np.random.default_rng(1).integers(0, 256, 9000, np.uint8))


def test_media_digests(docs):
    rows = gif.media_digests(gif.text_media(docs)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        raw = (next(t for i, t, *_ in ROWS if i == r.doc_id) or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        frames = gif.decode(gif.encode(payload))
        total = sum(gif.histogram(f.canvas) for f in frames)
        assert r.feature == f"{len(frames)}f{4 * len(frames)}cs-" + "".join(f"{int(x * 15 / max(1, total.sum()) + 0.5):x}" for x in total.tolist())
        assert (r.media_bytes, r.media_sha256) == (len(gif.encode(payload)), hashlib.sha256(gif.encode(payload)).hexdigest())
    same = [tuple(r)[1:] for r in rows if r.doc_id in (1, 4)]
    assert len(set(same)) == 1 and len(same) == 3
    assert gif.media_digests(gif.text_media(docs.limit(0))).count() == 0


def test_media_frames(spark, docs):
    media = gif.text_media(docs)
    frames = gif.media_frames(media, "doc_id", "media").collect()
    long = sorted((f for f in frames if f.key == 5), key=lambda f: f.frame)
    assert [f.start_cs for f in long] == [gif.DELAY * k for k in range(len(long))] and len(long) == -(-len(ROWS[5][1].encode()) // (192 * gif.FRAME_ROWS))
    odd = spark.createDataFrame([(1, b"no gif", "x"), (2, None, "x")], "doc_id long, media binary, payload string")
    assert [(f.key, f.error) for f in gif.media_frames(odd, "doc_id", "media").collect()] == [(1, "not a GIF")]
    assert sorted((r.doc_id, r.payload, r.frames, r.error) for r in gif.read_media(odd).collect()) == [(1, None, None, "not a GIF"), (2, None, None, None)]


PATH = queries.tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("text", ["", " ", "It's 2024, isn't it?\tYES\n\n", "Ünï\u00a0Σίσυφος ΣΑΣ\x1cx\x85y", "<|endoftext|> a<|endoftext|>b", "e\u0301 \u0301x", "a" * 5000, "日本語テキスト🙂 end", "ÀÖØÞßöøÿ÷× Élan'S L'été über12straße,(ÄÖ) İx ŸŠ", "naïve'll café!! ***ñandú$$$ a|b"])
def test_word_ids_equal_the_tokenizer(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    words = packing.WordIds(PATH)
    assert np.frombuffer(words(text), "<u4").tolist() == want == np.frombuffer(words(text), "<u4").tolist()


def test_word_ids_equal_the_tokenizer_on_a_table(spark, sf_dir):
    from tokenizers import Tokenizer

    texts = [r.text for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("text").collect()]
    words = packing.WordIds(PATH)
    for t, e in zip(texts, Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False), strict=True):
        assert words(t) == np.array(e.ids, "<u4").tobytes()


def test_cut_covers_and_fills():
    for size in [*range(1, 300), 511, 512, 1000, 1365, 1366, 4095, 4096, 4097, 8192, 20001]:
        at = 0
        for start, length, k in packing.cut(size):
            assert start == at and length > 0 and packing.CAPACITY // k >= length
            assert packing.CAPACITY // k - length <= packing.SLACK
            at += length
        assert at == size


def test_classes_are_bounded():
    lengths = packing.classes()
    assert len(lengths) < 30 and lengths[0] == (4096, 1) and lengths[-1][0] >= packing.SLACK and all(n == 4096 // k for n, k in lengths)
    assert packing.classes(4, 8) == ((4, 1),) and packing.cut(9, 4, 8) == ((0, 4, 1), (4, 4, 1), (8, 1, 1))


@pytest.mark.parametrize("seed", range(5))
def test_shared_sequences_hold_what_is_left(seed):
    rng = random.Random(seed)
    totals = {k: rng.randrange(3 * k) for _, k in packing.classes() if rng.random() < 0.8}
    rows, used = packing._planned(totals, packing.CAPACITY), {}
    for k, full, _first, ends, shared in rows:
        assert full == totals[k] // k and (ends[-1] if ends else 0) == totals[k] % k and len(ends) == len(shared)
        for s, n in zip(shared, np.diff([0, *ends]).tolist(), strict=True):
            assert n > 0 and s >= sum(r[1] for r in rows)
            used[s] = used.get(s, 0) + n * (packing.CAPACITY // k)
    assert all(u <= packing.CAPACITY for u in used.values()) and sum(u <= packing.CAPACITY // 2 for u in used.values()) <= 1


def checked(rows, documents):
    spans = {}
    for r in rows:
        spans.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert len(spans) == len(documents)
    for (_, total), own in spans.items():
        copies = sum(s == 0 for s, _ in own)
        for at in range(0, total, max(1, total // 50)):
            assert sum(s <= at < s + n for s, n in own) == copies
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    return padding, sum(r.length for r in rows)


def test_packing_of_edge_cases(docs):
    rows = packing.pack_documents(docs, PATH).collect()
    checked(rows, {i for i, *_ in ROWS})
    assert {(r.doc_id, r.doc_tokens) for r in rows if r.doc_id in (2, 3)} == {(2, 1), (3, 1)}
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_packing_of_a_table(spark, sf_dir):
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op5_harmonic_packing(spark, sf_dir).collect()
    padding, tokens = checked(rows, texts)
    assert padding < 0.03 * tokens
    tokenizer = Tokenizer.from_file(PATH)
    for r in rows[::7]:
        ids = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_sequences_hold_fixed_counts(spark, sf_dir):
    rows = queries.op5_harmonic_packing(spark, sf_dir).collect()
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, {}).setdefault(r["class"], []).append(r.length)
    whole = [(k, n) for own in held.values() if len(own) == 1 for k, n in own.items()]
    assert sum(len(n) == k for k, n in whole) == sum(v // k for k, v in {k: sum(len(own.get(k, [])) for own in held.values()) for k in {r["class"] for r in rows}}.items())
    assert sorted(held) == list(range(len(held)))
