"""Exact round trips of the token coder, the tokenizer by chunks, and the packing plan."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import packing, rans
from ledgerlens.llm import text as X
from ledgerlens.llm import tokens as K

from . import brute


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 999), max_size=90), min_size=1, max_size=12))
def test_round_trip(docs):
    ids = np.array([x for d in docs for x in [*d, 7]], np.uint16)
    model = rans.Model.from_bytes(rans.Model.of_counts(np.bincount(ids, minlength=1000)).to_bytes())
    names = [None if k == 2 else f"d{k}".encode() for k in range(len(docs))]
    lengths = np.array([len(d) + 1 for d in docs])
    data = rans.encode(model, ids, names, lengths, 5, 9)
    part, first, got_names, got_lengths, got = rans.decode(model, memoryview(data))
    assert (part, first, got_names) == (5, 9, names) and (got_lengths == lengths).all() and (got == ids).all()


def test_many_blocks_near_entropy_and_damage():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 400_000) - 1, 49_999).astype(np.uint16)
    counts = np.bincount(ids, minlength=50_000)
    model = rans.Model.of_counts(counts)
    data = rans.encode(model, ids, [b"x"], np.array([len(ids)]), 0, 0)
    assert (rans.decode(model, memoryview(data))[-1] == ids).all()
    p = counts[counts > 0] / len(ids)
    assert 8 * len(data) < 1.1 * len(ids) * -(p * np.log2(p)).sum()
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode(model, memoryview(broken))
    other = rans.Model.of_counts(counts + 1)
    with pytest.raises(ValueError):
        rans.decode(other, memoryview(data))
    assert [bytes(x) for x in rans.split(memoryview(data + b"\n" + data + b"\n"))] == [data, data]


PIECES = st.lists(st.one_of(st.sampled_from([" ", "\n", "  ", "\t", "'s", "'", ",", ".", "a", "B", "é", "É", "İ", "3", "_", " ", "　", "<|endoftext|>", "<|", "é",
                                             "don't", "hello", "World", "日本", "🙂", "-", "(", "=", "̸", "\r\n", "\x1c", "ǅ", "ß"]), st.text(max_size=4)), max_size=25)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES.map("".join), min_size=1, max_size=4))
def test_chunked_ids_are_the_librarys(texts):
    for name, fold in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        tokenizer = _TOKENIZERS.setdefault(name, Tokenizer.from_file(K.public(name)))
        texts = [t.encode("utf-8", "ignore").decode() for t in texts]
        ids, counts = K.encoder(K.public(name), fold).encode([t.encode() for t in texts])
        assert ids.tolist() == [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids]
        assert counts.tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


_TOKENIZERS: dict = {}


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([5, 16, 50, 100])
    items = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 150))]
    counts = {x: items.count(x) for x in set(items)}
    ranges, bins = sorted(packing.plan(counts, capacity)), {}
    for k, (length, rank, each, first, offset) in enumerate(ranges):
        stop = ranges[k + 1][1] if k + 1 < len(ranges) and ranges[k + 1][0] == length else counts[length]
        for r in range(stop - rank):
            bins.setdefault(first + r // each, []).append((offset + r % each * length, length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == brute.best_fit(items, capacity)


def test_word_hashes_agree_across_pieces(monkeypatch):
    rnd = random.Random(1)
    texts = [" ".join("".join(rnd.choice("abÉ1") for _ in range(rnd.choice([1, 3, 40]))) for _ in range(200)).encode() for _ in range(5)]
    block = X.Texts(texts)
    s, e = block.words(X.ALNUM_WORD)
    whole = X.hash_words(block.buf, s, e)
    monkeypatch.setattr(X, "BLOCK_BYTES", 64)
    assert (X.hash_words(block.buf, s, e) == whole).all()
    by_word = {}
    for a, b, h in zip(s, e, whole.tolist()):
        assert by_word.setdefault(X.FOLD[block.buf[a:b]].tobytes(), h) == h
    assert len(set(by_word.values())) == len(by_word)
    w = X.hash_windows(whole, 13)
    assert len(w) == len(whole) - 12 and (X.hash_windows(whole[5:18], 13) == w[5]).all()
