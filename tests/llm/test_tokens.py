"""Tokenizers, packing, the Re-Pair store and the SentencePiece scan: exact round trips and library equality."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import packing as K
from gridloom.llm import repair_store as R
from gridloom.llm import sentencepiece_scan as S
from gridloom.llm.tokens import Encoder

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    "an <|endoftext|> inside, <|startoftext|>and<|endoftext|>",
    "<|ENDOFTEXT|> x","", " ", "a", "Hello, world. It's 5.0 o'clock...", "  two  gaps ", "x\n\ny\tz", "a\n b", "a \nb", "日本語 テキスト", "ΑΣ Σ İI ıi", "é é ß", "<|endoftext|> <|startoftext|>", "'s 's a's", "word" * 300, "a\u0085b c d", "foo ,bar. .baz ²³.", "ends with.\nStarts, here.", "x_. y_, 5. 6,", "wait... a*** b*** ***\n***c d&&&\n&&& b***", "(\"so\") it's' 5%. я, я日! я日!\nb!"]


def documents(spark, n=60, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["", None, *TEXTS]) if i % 5 == 0 else " ".join(r.choice(["the", "cat,", "Sat.", "on", f"m{r.randrange(50)}", "\n"]) for _ in range(r.choice([3, 40, 900])))) for i in range(n)]
    rows += [(7, "again"), (7, "again"), (None, "no id")]
    return rows, spark.createDataFrame([(i, t, "x", 0, 1.0) for i, t in rows], "doc_id long, text string, length string, piece int, rank double")


@pytest.mark.parametrize("path,spaced", [(WORD, False), (BYTE, True)])
def test_cached_encoding_equals_the_library(path, spaced):
    t = Tokenizer.from_file(path)
    e = Encoder(path, spaced)
    for _ in range(3):  # cold, then from the cache
        for text, ids in zip(TEXTS, e.encode(TEXTS)):
            assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abAB .,'!_*#-\n\tß5²éя日", max_size=40), min_size=1, max_size=5))
def test_cached_encoding_of_odd_texts(texts):
    for path, spaced in ((WORD, False), (BYTE, True)):
        e = _encoders.setdefault(path, Encoder(path, spaced))
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in e.encode(texts)] == want


_encoders: dict = {}


def test_store_round_trip(spark):
    rows, df = documents(spark)
    got = R.read_store(R.write_store(df, WORD)).collect()
    t = Tokenizer.from_file(WORD)
    ids = {(i, x): [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    at, want = 0, []
    for key in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        n = len(ids[key])
        want.append((key[0], at, n, zlib.crc32(np.array(ids[key], "<u4").tobytes())))
        at += n
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == [(b, a, c, d) for a, b, c, d in want]
    assert R.read_store(R.write_store(df.limit(0), WORD)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=300), max_size=6), st.integers(0, 500), st.integers(0, 200))
def test_shards_decode_whole_and_anywhere(docs, start, n):
    ids = [np.array(d, np.uint32) for d in docs]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    shard = R.Shard(R.encode_shard(list(range(len(docs))), ids))
    assert shard.decode().tolist() == flat.tolist()
    assert shard.counts.tolist() == [len(d) for d in docs]
    start = min(start, len(flat))
    assert shard.decode_range(start, n).tolist() == flat[start : start + n].tolist()


def test_no_frequent_pair_is_left_and_the_store_is_small():
    """On text-like ids the shard is smaller than what zlib makes of 16-bit ids, and every rule has repaid itself."""
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 3000, rng.integers(1, 6)) for _ in range(2000)]
    ids = np.concatenate([words[k] for k in (rng.pareto(0.8, 60_000) * 5).astype(int) % 2000]).astype(np.uint32)
    seq, rules = R.compress(ids.astype(np.int64), 3000)
    left = Counter(zip(seq[:-1].tolist(), seq[1:].tolist()))
    worst = max(left, key=left.get)
    assert left[worst] < R.MIN_COUNT or worst[0] == worst[1]
    uses = np.bincount(np.concatenate((seq, rules.ravel())), minlength=3000 + len(rules))
    assert (rules < 3000 + np.arange(len(rules))[:, None]).all() and uses[3000:].min() >= 1
    data = R.encode_shard([0], [ids])
    assert (R.Shard(data).decode() == ids).all()
    assert len(data) < len(zlib.compress(ids.astype("<u2").tobytes()))


def test_shards_shrink_and_detect_damage():
    rng = np.random.default_rng(0)
    ids = np.tile(rng.integers(0, 60_000, 200), 300).astype(np.uint32)
    data = R.encode_shard([None], [ids])
    assert len(data) < len(ids)
    bad = bytearray(data)
    bad[-40_0] ^= 1
    with pytest.raises(Exception):
        R.Shard(bytes(bad[:-8])).decode()


def check_plan(lengths):
    hist = np.bincount(lengths, minlength=1025)
    p = K.plan(hist)
    order = np.sort(lengths)
    rank = np.arange(len(order)) - np.searchsorted(order, order)
    seq, off = p.place(order.astype(np.int64), rank)
    used = {}
    for s, o, n in sorted(zip(seq.tolist(), off.tolist(), order.tolist())):
        assert o == used.get(s, 0)
        used[s] = o + n
    assert all(v <= 1024 for v in used.values()) and len(used) == p.sequences
    return p.sequences


def test_plans_are_gapless_and_no_worse_than_best_fit():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 1025, 3000), rng.integers(1, 1025, 40), rng.choice([341, 342, 100], 2000), np.full(500, 400), np.minimum(1024, rng.lognormal(5, 1, 2000).astype(int) + 1), np.array([1024, 1, 1023])):
        free, bins = [], 0
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                f = min(fits)
                free.remove(f)
                free.append(f - n)
            else:
                bins += 1
                free.append(1024 - n)
        assert check_plan(lengths) <= bins
    assert check_plan(np.zeros(0, int)) == 0


def test_packed_documents(spark):
    rows, df = documents(spark)
    got = K.pack_documents(df, BYTE).collect()
    t = Tokenizer.from_file(BYTE)
    want = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 1024
    assert K.pack_documents(df.limit(0), BYTE).count() == 0


@pytest.fixture(scope="module")
def model():
    return S.Model(PIECE)


def scan(m, text, size):
    text = S.normal(text)
    chunks = [(text[i : i + size + m.longest - 1], min(size, len(text) - i)) for i in range(0, len(text), size)]
    v, entries = np.where(np.arange(m.longest) == 0, 0.0, -np.inf), []
    for c, k in chunks:
        entries.append(v)
        v = S.combine(v, m.matrix(c, k))
    state, out = 0, []
    for (c, k), e in zip(reversed(chunks), reversed(entries)):
        out.append(np.frombuffer(m.backtrace(c, k, e, state), np.int32).tolist())
        state = int(m.exits(c, k, e)[state])
    return [i for part in reversed(out) for i in part], v[0]


SP_TEXTS = [t for t in TEXTS if t] + ["a" * 300, "=" * 100, "naïve café straße " * 30, "the quick brown fox " * 40, "x" * 40 + " " + "y" * 40]


def test_scan_equals_the_library_and_the_whole_recursion(model):
    library = model.unigram()
    for text in SP_TEXTS:
        ids = model.encode(text).tolist()
        best, back = model.path(S.normal(text), np.zeros(1))
        assert ids == model.emit(S.normal(text), back, len(back) - 1)[0]
        if len(text) < 500:
            assert ids == library.encode(S.normal(text))
        assert model.score(np.array(ids)) == best[-1]
        for size in (5, 16, 17, 40, 150):
            assert scan(model, text, size) == (ids, best[-1]), (text, size)


def test_matrices_are_associative(model):
    text = S.normal("some words and more of them, here")
    parts = [(text[i : i + 9 + model.longest - 1], min(9, len(text) - i)) for i in range(0, len(text), 9)]
    a, b, c = (model.matrix(*p) for p in parts[:3])
    assert np.array_equal(S.combine(S.combine(a, b), c), S.combine(a, S.combine(b, c)))


def test_encode_and_decode(spark, model):
    rows, df = documents(spark)
    rows = [(i, t) for i, t in rows if S.SPACE not in (t or "")]
    for size in (1 << 16, 64):
        e = S.encode(df, PIECE, chunk_chars=size)
        texts = sorted(((r["doc_id"], r["text"]) for r in S.decode(e, PIECE).collect()), key=str)
        assert texts == sorted(((i, t or "") for i, t in rows), key=str)
    one = S.summary(S.encoded_parts(df, PIECE), PIECE).collect()
    many = S.summary(S.encoded_parts(df, PIECE, chunk_chars=64), PIECE).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == len(rows)
    assert S.decode(S.encode(df.limit(0), PIECE), PIECE).count() == 0
