import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from shared import ODD, words
from tokenizers import Tokenizer

from farescope.llm import bloom_lm, packing, token_counts, token_frames
from farescope.llm.common import saved
from farescope.llm.tokens import Encoder, vocabulary
from farescope.session import work_dir

STRANGE = ["", " ", "  ", " a", "a  b", "a\n\nb c\n", "x  y", "x  y z", "a\t b\r\n c", "é é   x", "ab's don't 'll", "12 345!!  ??\n", "\x1c a \x85b",
           "日本語 テスト　です", "ΑΣ ΣΑΣ σ", "w" * 30 + " " + "w" * 30, "a b " * 50]


def encoded(path, text, end):
    return np.array(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_whole_texts(name, spaced):
    r = random.Random(4)
    alphabet = list(" \n\t  \x1c\x85abZé1!'́ ") + ["<|endoftext|>"]
    texts = STRANGE + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [words(1, 3000)]
    encoder = Encoder(vocabulary(name), spaced)
    for part in (texts[:10], texts, texts[::-1]):
        flat, counts = encoder.encode([t.encode() for t in part])
        want = [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch(part, add_special_tokens=False)]
        assert [list(x) for x in np.split(flat, np.cumsum(counts)[:-1])] == want


def test_unknown_words_are_encoded_together():
    path = vocabulary("word_bpe_49k.json")
    r = random.Random(5)
    fresh = sorted({"".join(r.choice("abcdeéßX9.,'\u0301") for _ in range(r.randint(1, 40))) for _ in range(5000)}) + ["<|endoftext|>"]
    encoder, calls = Encoder(path, spaced=False), []

    class Told:
        def __getattr__(self, name):
            return lambda texts, **how: calls.append(len(texts)) or getattr(Tokenizer.from_file(path), name)(texts, **how)

    encoder.tokenizer = Told()
    flat, counts = encoder.encode([x.encode() for x in fresh])
    assert [list(x) for x in np.split(flat, np.cumsum(counts)[:-1])] == [
        e.ids for e in Tokenizer.from_file(path).encode_batch(fresh, add_special_tokens=False)]
    assert sum(calls) < len(fresh) / 50


def test_packing(make_docs):
    path = vocabulary("byte_bpe_50k.json")
    rows = ODD + [(100 + k, words(k, 17 * (k % 23))) for k in range(120)]
    got = packing.pack(make_docs(rows)).collect()
    found = Counter()
    for i, t in rows:
        ids = encoded(path, t, 2)
        first = len(ids) % 1024 or 1024
        at = 0
        for piece, end in enumerate(range(first, len(ids) + 1, 1024)):
            found[(i, piece, at, end - at, zlib.crc32(ids[at:end].tobytes()))] += 1
            at = end
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == found
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for bin_ in places.values():
        at = 0
        for offset, length in sorted(bin_):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= math.ceil(sum(r.length for r in got) / 1024) + 2
    assert packing.pack(make_docs([])).count() == 0


def naive_plan(counts, capacity):
    """One bin after another."""
    count, bins = dict(counts), []
    while any(count.values()):
        pattern = packing.next_pattern(count, sorted(n for n in count if count[n]), capacity)
        for n in pattern:
            count[n] -= 1
        bins.append(sorted(pattern))
    return bins


@pytest.mark.parametrize("seed", range(5))
def test_plan_equals_one_bin_at_a_time(seed):
    r = random.Random(seed)
    counts = {n: r.randint(1, 40) for n in r.sample(range(1, 101), 30)}
    bins, pieces = {}, Counter()
    segments = packing.plan(counts, 100)
    for n in counts:
        own = sorted(s for s in segments if s[0] == n)
        for (length, rank, first, _), after in zip(own, [*own[1:], (n, counts[n], 0, 0)]):
            for k in range(rank, after[1]):
                bins.setdefault(first + k - rank, []).append(length)
                pieces[n] += 1
    assert pieces == counts
    assert [sorted(bins[k]) for k in sorted(bins)] == naive_plan(counts, 100)


def test_best_pair_against_all_pairs():
    r = random.Random(2)
    for _ in range(300):
        lengths = sorted(r.sample(range(1, 60), r.randint(0, 12)))
        count = {n: r.randint(1, 2) for n in lengths}
        most = r.randint(1, 90)
        sums = [a + b for k, a in enumerate(lengths) for b in lengths[: k + 1] if a + b <= most and (a != b or count[a] > 1)]
        assert sum(packing.best_pair(lengths, count, most)) == max(sums, default=0)


def test_frames_round_trip(make_docs, spark):
    path = vocabulary("word_bpe_49k.json")
    rows = ODD + [(100 + k, words(k, 30)) for k in range(60)]
    docs = make_docs(rows)
    got = token_frames.round_trip(docs).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    start, want = 0, []
    for i, t in order:
        ids = encoded(path, t, 1)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda x: x[1]) == want
    files = saved(token_frames.write_frames(docs, work_dir(spark, "frames"), path), "files")
    some = {r.doc_id: r.ids for r in token_frames.fetch(spark, files, [9, 117, 4242]).collect()}
    assert some == {i: encoded(path, dict(rows)[i], 1).tolist() for i in (9, 117)}
    assert token_frames.round_trip(make_docs([])).count() == 0


def test_frame_reader_checks_and_skips():
    out = pa.BufferOutputStream()
    contents = [np.arange(k, dtype="<u4").tobytes() for k in range(5)]
    token_frames.frame_file(np.array([3, 5, 5, 8, 9]), contents, out)
    raw = bytearray(out.getvalue().to_pybytes())
    reader = token_frames.FrameReader(pa.PythonFile(pa.BufferReader(bytes(raw)), "r"))
    assert [reader.content(k) for k in range(5)] == contents
    assert reader.find(5) == range(1, 3) and reader.find(4) == range(1, 1)
    raw[int(reader.starts[3]) + 8] ^= 255
    broken = token_frames.FrameReader(pa.PythonFile(pa.BufferReader(bytes(raw)), "r"))
    assert broken.content(2) == contents[2]
    with pytest.raises(Exception):
        broken.content(3)


@pytest.mark.parametrize("block", [1 << 20, 7, 1])
def test_token_counts(make_docs, block):
    path = vocabulary("word_bpe_49k.json")
    rows = [(i, t if not t or len(t) < 4000 else words(3, 200)) for i, t in ODD] + [(50, "a <|endoftext|> b")]
    got = token_counts.token_counts(make_docs(rows).repartition(3), block=block).collect()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    want = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    for file in {r.file for r in got}:
        own = sorted((r.ordinal, r.start, r.n_tokens) for r in got if r.file == file)
        assert [o for o, _, _ in own] == list(range(len(own)))
        assert [s for _, s, _ in own] == [sum(n for _, _, n in own[:k]) for k in range(len(own))]
    assert token_counts.token_counts(make_docs([])).count() == 0


def plain_lm(rows):
    texts = [((t or "").encode().lower().split() + [None]) for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    one, two = Counter(), Counter()
    for t, h in zip(texts, held):
        if not h:
            one.update(t)
            two.update(zip([None, *t], t))
    n, v = sum(one.values()), len(one)
    base = [sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t) for t in texts]
    level = lambda c: 0 if not c else math.ceil(bloom_lm.BASE ** (int(bloom_lm.levels(np.array([c]))[0]) - 1) - 1e-9)
    p = bloom_lm.PRIOR
    score = [sum(math.log10((level(two[a, w]) + p * (one[w] + 1) / (n + v + 1)) / (one[a] + p)) for a, w in zip([None, *t], t)) for t in texts]
    return texts, held, one, n, base, score


@pytest.mark.parametrize("size,most", [(bloom_lm.BLOCK_TOKENS, bloom_lm.FILTER_BYTES), (500, 3000)], ids=["whole", "rounds"])
def test_language_model(make_docs, size, most):
    rows = ODD + [(100 + k, " ".join(random.Random(k).choices("the of and a in to x y z".split(), k=80)) + " " + words(k % 40, 30)) for k in range(200)]
    docs = make_docs(rows)
    got = bloom_lm.scores(docs, size, most).collect()
    texts, held, one, n, base, score = plain_lm(rows)
    want = sorted(((i is None, i or 0, len(t)), h, sum(one[w] > 0 for w in t), b, s) for (i, _), t, h, b, s in zip(rows, texts, held, base, score))
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens), r.held_out, r.n_known, r.base_score, r.score) for r in got)
    assert len(found) == len(want) and {r.train_tokens for r in got} == {n}
    for a, b in zip(found, want):
        assert a[:3] == b[:3]
        assert a[3] == pytest.approx(b[3])
        assert b[4] - 0.1 <= a[4] <= b[4] + 0.05 * abs(b[4]) + 1  # false positives only raise a count
    assert bloom_lm.scores(make_docs([])).count() == 0


def test_language_model_in_slices(make_docs, monkeypatch):
    rows = [(k, words(k % 20, 10 + k)) for k in range(60)] + [(100, None), (101, words(3, 400))]
    docs = make_docs(rows)
    shown = lambda: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in bloom_lm.scores(docs).collect())
    whole = shown()
    monkeypatch.setattr(bloom_lm, "SLICE", 7)
    from pyspark import cloudpickle

    # Workers get the function with the small slice.
    cloudpickle.register_pickle_by_value(bloom_lm)
    try:
        assert shown() == whole
    finally:
        cloudpickle.unregister_pickle_by_value(bloom_lm)


def test_bloom_filter_never_forgets():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 20_000, dtype=np.uint64))
    level = np.random.default_rng(1).integers(1, 9, len(keys))
    bits = bloom_lm.bloom(keys, level)
    assert len(bits) * 8 <= level.sum() * bloom_lm.BITS + 64
    got = bloom_lm.probed(bits, keys)
    assert (got >= level).all() and (got > level).mean() < 0.05
    assert (bloom_lm.probed(bits, keys ^ np.uint64(1 << 62)) > 0).mean() < 0.05
    counts = np.arange(1, 5000)
    assert (np.ceil(bloom_lm.BASE ** (bloom_lm.levels(counts) - 1) - 1e-9) <= counts).all()


def _most(work) -> int:
    """Most bytes that numpy and Python hold at once for some work."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_workers_hold_little_beside_their_block_and_filter():
    words = np.random.default_rng(5).integers(1, 50_000, 1_000_000).astype(np.uint64)
    made = []
    assert _most(lambda: made.append(bloom_lm._block(0, [1, 2], [False, True], [words[:600_000].copy(), words[600_000:].copy()]))) < 45 * len(words)
    row = made[0].to_pylist()[0]
    vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
    assert (vocabulary[bloom_lm.numbers(row["words"])] == words).all()
    assert (np.frombuffer(row["train"], np.int64) == np.bincount(words[:600_000].astype(int), minlength=50_000)[vocabulary.astype(int)]).all()
    keys = np.unique(words * np.uint64(0x9E3779B97F4A7C15)).repeat(20) + np.arange(20 * 50_000, dtype=np.uint64)[: 20 * len(np.unique(words))]
    assert _most(lambda: bloom_lm.bloom(keys, np.ones(len(keys), np.int64))) < 45 * len(keys)


def test_rounds_are_even():
    sizes = dict.fromkeys(range(20), 5)
    assert [len(r) for r in bloom_lm.rounds(sizes, 90)] == [11, 9] and bloom_lm.rounds({}, 90) == [[]]
    assert all(5 * len(r) <= 40 for r in bloom_lm.rounds(sizes, 40))


def test_bounded_rounds():
    assert bloom_lm.rounds({0: 5, 1: 5, 2: 9, 3: 1, 4: 20}, 10) == [[0, 1], [2, 3], [4]]
