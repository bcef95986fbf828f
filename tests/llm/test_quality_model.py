"""The word model of the quality rules: against plain Python, by script, by language."""

import pickle
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import knlm, quality
from ledgerlens.llm import text as X
from ledgerlens.llm.shared import map_arrow, written

from . import brute
from .conftest import text

SCHEMA = "doc_id long, lang string, text string"


def words(rnd, letters, n=120):
    return ["".join(rnd.choice(letters) for _ in range(rnd.choice([2, 4, 6]))) for _ in range(n)]


def sentences(rnd, vocabulary, n=60, follow=3):
    """Words in an order that repeats: each has a few that may follow it."""
    out = [rnd.randrange(len(vocabulary))]
    while len(out) < n:
        out.append((out[-1] * 7 + rnd.randrange(follow)) % len(vocabulary))
    return [vocabulary[k] for k in out]


def report(spark, docs, **options):
    return {r["doc_id"]: r for r in quality.quality_report(spark.createDataFrame(docs, SCHEMA).repartition(3), **options).collect()}


@pytest.mark.parametrize("broadcast_grams", [0, 30])
def test_model_matches_plain_python(spark, broadcast_grams):
    rnd = random.Random(3)
    docs = [(k, rnd.choice(["en", "en", "de", None]), text(rnd, rnd.choice([5, 30, 60]))) for k in range(60)]
    docs += [(100 + k, *docs[k][1:]) for k in range(12)] + [(200, "en", "日本語の文、テスト。" * 4), (201, "th", "ภาษาไทย " * 9), (202, "en", None), (203, None, ""),
                                                           (204, "en", "qxz " + "zzq vvk " * 30), (205, "en", " ".join(f"w{k}x" for k in range(80)))]
    got, expected = report(spark, docs, broadcast_grams=broadcast_grams), brute.quality_kept(docs)
    assert len(got) == len(expected) and any(not kept for _, _, kept in expected)
    for d, log_perplexity, kept in expected:
        assert got[d]["kept"] == kept, d
        assert got[d]["log_perplexity"] == (None if log_perplexity is None else pytest.approx(log_perplexity, abs=1e-6)), d


@pytest.mark.parametrize("broadcast_grams", [0, 1 << 19])
def test_hot_tokens_are_split(spark, monkeypatch, broadcast_grams):
    """Tokens that hold a third of all, as middle, first and last token; results as without a split."""
    rnd = random.Random(13)
    monkeypatch.setattr(knlm, "HOT", 0.2)
    docs = [(k, rnd.choice(["en", "de"]), " ".join(rnd.choice(["the", "of", rnd.choice("abcdefghijkl") * rnd.randrange(1, 4)]) for _ in range(40))) for k in range(50)]
    docs += [(100 + k, *docs[k][1:]) for k in range(5)]
    words = knlm.vocabulary(knlm.token_counts(quality._plain(spark.createDataFrame(docs, SCHEMA), "text", "lang")), 8, broadcast_grams)
    assert len(words.hot) >= 4 and words.splits.max() > 1
    got = report(spark, docs, broadcast_grams=broadcast_grams)
    for d, log_perplexity, kept in brute.quality_kept(docs):
        assert got[d]["kept"] == kept and got[d]["log_perplexity"] == pytest.approx(log_perplexity, abs=1e-6)


def test_model_grows_with_the_text(spark):
    rnd = random.Random(4)
    docs = [(k, "en", " ".join(words(rnd, "abcdefghij", 200))) for k in range(40)]

    def entries(docs):
        return knlm.model(quality._plain(spark.createDataFrame(docs, SCHEMA), "text", "lang")).groupBy().sum("entries").first()[0]
    assert entries(docs) > 8 * entries(docs[:4])


def test_real_words_in_senseless_order_are_rejected(spark):
    rnd = random.Random(5)
    vocabulary = words(rnd, "abcdefghij")
    docs = [(k, "en", " ".join(sentences(rnd, vocabulary, 150))) for k in range(120)]
    docs += [(1000 + k, "en", " ".join(rnd.sample(d[2].split(), 150))) for k, d in enumerate(docs[:4])]
    got = report(spark, docs)
    assert not any(got[1000 + k]["kept"] for k in range(4)) and sum(got[k]["kept"] for k in range(120)) >= 115


def test_garbled_text_beyond_latin_is_rejected(spark):
    rnd = random.Random(6)
    letters = {"ru": "абвгдежзиклмнопрстуф", "el": "αβγδεζηθικλμνξοπρστυ", "zh": "的一是不了人我在有他这中大来上国个到说们"}
    docs, bad = [], []
    for j, (lang, own) in enumerate(letters.items()):
        vocabulary, gap = words(rnd, own), "" if lang == "zh" else " "
        docs += [(1000 * j + k, lang, " \n".join(gap.join(sentences(rnd, vocabulary, 8)) for _ in range(24))) for k in range(60)]
        # Words of the same lengths, of other letters of the same script: their classes are the same.
        some = {"ru": "хцчшщъыьэюя", "el": "φχψωάέήίόύώ", "zh": "學習語言模型測試數據龍龜鑫森淼焱垚"}[lang]
        bad += [(9000 + j, lang, "".join(c if c in " \n" else rnd.choice(some) for c in docs[-1][2]))]
    got = report(spark, docs + bad)
    assert not any(got[d]["kept"] for d, *_ in bad) and sum(got[d]["kept"] for d, *_ in docs) >= 170


def test_every_language_has_its_own_model(spark):
    """A text in the words of another language is rejected whatever the rank of its label."""
    rnd = random.Random(8)
    vocabularies = {f"l{j:02}": words(rnd, "abcdefghijklmnop", 40) for j in range(70)}
    docs = [(100 * j + k, lang, " ".join(sentences(rnd, v, 60))) for j, (lang, v) in enumerate(vocabularies.items()) for k in range(12 if j < 66 else 10)]
    bad = [(90_000 + j, f"l{j:02}", " ".join(sentences(rnd, vocabularies[f"l{j - 1:02}"], 60))) for j in (1, 68, 69)]
    got = report(spark, docs + bad)
    assert not any(got[d]["kept"] for d, *_ in bad) and sum(got[d]["kept"] for d, *_ in docs) >= 0.95 * len(docs)


def test_copies_and_near_copies_stay(spark):
    rnd = random.Random(9)
    vocabulary = words(rnd, "abcdefghij")
    docs = [(k, "en", " ".join(sentences(rnd, vocabulary, 80))) for k in range(100)]
    docs += [(200 + k, "en", docs[0][2]) for k in range(15)] + [(300 + k, "en", " ".join(docs[1][2].split()[k:])) for k in range(1, 10)]
    got = report(spark, docs)
    assert all(got[d]["kept"] for d, *_ in docs if d >= 200 or d < 2)


def test_batches_are_bounded_by_bytes(spark):
    """A step gets batches of a size in bytes, not of 10 000 rows; a longer row comes alone."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])
    docs = spark.range(0, 600, 1, 1).selectExpr("repeat('word ', if(id = 300, 100000, 400)) as text")
    got = written(map_arrow(docs, sizes, "rows long, bytes long"), "sizes", batch_bytes=100_000).collect()
    assert sum(r["rows"] for r in got) == 600 and len(got) >= 10
    assert all(r["bytes"] < 120_000 for r in got if r["bytes"] < 500_000) and sum(r["bytes"] >= 500_000 for r in got) == 1


def test_hashes_that_agree_in_their_high_bits_are_sorted():
    near = np.array([5, 3, 5, 1 << 40, 3, 4, 1 << 63, 0], np.uint64)
    for h in (near, near[:0], near[:1], X.mix64(np.arange(1000, dtype=np.uint64) % np.uint64(7))):
        assert (h[X.argsort(h)] == np.sort(h)).all() and sorted(X.argsort(h).tolist()) == list(range(len(h)))


def test_neighbours_meet_their_tokens():
    """Frequent tokens travel by place, rare ones by hash, both cut into ranges; a broadcast vocabulary comes back whole."""
    h = X.mix64(np.arange(500, dtype=np.uint64))
    n, lang = np.arange(500) + 1, np.arange(500) % 3 - 1
    words = knlm.Vocabulary(h[:300].view(np.int64), lang[:300], n[:300], h[:2].view(np.int64), np.array([2, 3]))
    again = pickle.loads(pickle.dumps(words))
    assert all((getattr(words, k) == getattr(again, k)).all() for k in ("hash", "lang", "code", "sorted", "hot", "splits"))

    class Shared:
        value = again
    batch = pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(lang), pa.array(n), pa.array(n % 2 == 0)], names=["h", "lang", "n", "shared"])
    some = np.sort(np.concatenate([h[100:200], h[250:400]]))
    found = {}
    for p in range(5):
        rows = [(0, b) for k, b in knlm._neighbours(again, some, np.full(len(some), 4), 5) if k == p] * 2
        rows += [(1, b.as_py()) for sent in knlm._sent_tokens(5)([batch]) for k, b in zip(sent["p"].to_pylist(), sent["blob"]) if k == p]
        given = pa.RecordBatch.from_arrays([pa.array([p] * len(rows)), pa.array([k for k, _ in rows]), pa.array([b for _, b in rows])], names=["p", "kind", "blob"])
        for out in knlm._with_neighbours(Shared)([given]):
            found |= {r["h"]: (r["lang"], r["n"], r["shared"], r["a"]) for r in out.to_pylist()}
    at = [*range(100, 200), *range(250, 400)]
    assert found == {int(h[k].view(np.int64)): (int(lang[k]), int(n[k]), bool(n[k] % 2 == 0), 8) for k in at}


def peak(call):
    """What a call returns, and the most bytes that it held."""
    tracemalloc.start()
    try:
        return call(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_hashing_a_block_holds_little_beside_its_hashes():
    rnd = random.Random(29)
    texts = [" ".join(words(rnd, "abcdefgé", 400)).encode() for _ in range(2000)] + [None, b""]
    langs = np.full(len(texts), 7)
    knlm._hashes(texts[:200], langs[:200])                              # tables of powers
    (h, n, start), held = peak(lambda: knlm._hashes(texts, langs))
    assert held < 2 * h.nbytes + 24 * knlm.PIECE_BYTES, (held, h.nbytes)
    one = [knlm._hashes([t], langs[:1]) for t in texts]
    assert (h == np.concatenate([x[0] for x in one])).all() and n.tolist() == [len(x[0]) for x in one] and (start == one[0][2]).all()


def test_blocks_are_put_together_from_small_batches():
    rnd = random.Random(31)
    texts = [text(rnd, rnd.randrange(1, 60)) for _ in range(500)] + ["x" * 9000, None, ""]
    whole = pa.table({"key": np.arange(len(texts)), "lang": np.zeros(len(texts), np.int64), "text": pa.array(texts, pa.string())}).combine_chunks().to_batches()[0]
    small = [whole.slice(i, 10) for i in range(0, len(texts), 10)]
    found = list(X.joined(iter(small), 2, 8000))
    assert [t for _, ts in found for t in ts] == [None if t is None else t.encode() for t in texts]
    assert [k for b, _ in found for k in b.column(0).to_pylist()] == list(range(len(texts)))
    sizes = [b.nbytes for b, _ in found]
    assert max(len(b) for b, _ in found[:3]) > 10 and all(s <= 8000 or len(b) == 1 for s, (b, _) in zip(sizes, found))
    assert list(X.joined(iter([]), 2, 8000)) == []
    assert 4 * knlm.BATCH_BYTES <= knlm.BLOCK_BYTES
