"""Source divergence, fill-in-middle and language identification against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import divergence, fim, langid
from tests.conftest import SF_MID

from .conftest import WORDS, same, text

SCHEMA = "doc_id long, text string, lang string, source string"


def with_names(spark, rows, partitions=3):
    """Documents with columns whose names the operators use, one with a dot."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    clash = ["n", "form", "term", "c", "docs", "kind", "part", "rank", "item", "value", "score", "lang_pred", "held_out", "h0", "a.b"]
    return df.select(*(F.lit(7).alias(c) for c in clash), *df.columns)


# ------------------------------------------------------------------- divergence
def plain_divergence(rows, min_docs=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = {i: i + 32 for i in range(65, 91)}
    rows = [(lang or "", source or "", term.findall((t or "").translate(low))) for _, t, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs = Counter(w for x, _, ws in rows if x == lang for w in set(ws))
        kept = {w for w, n in docs.items() if n >= min_docs}
        count = defaultdict(Counter)
        for x, source, ws in rows:
            if x == lang:
                count[source].update(w for w in ws if w in kept)
        whole = sum(count.values(), Counter())
        share = lambda c, w: 1 + 10 ** 9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for a in count:
            pairs = [(b, sum(f(share(count[a], w), share(count[b], w)) for w in kept)) for b in count if b != a]
            terms = [(w, f(share(count[a], w), share(whole, w))) for w in count[a] if share(count[a], w) > share(whole, w)]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, a, part, w, v, k) for k, (w, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return out


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


@pytest.fixture(scope="module")
def sourced():
    rnd = random.Random(11)
    out = []
    for k in range(160):
        source = "hot" if k % 3 == 0 else rnd.choice(["a", "b", "c", None, ""])
        lang = rnd.choice(["en", "en", "en", "de", None])
        out.append((k, text(rnd, rnd.choice([2, 20, 60])) + (" Zulu" if source == "a" else ""), lang, source))
    out += [(500, None, "en", "bare"), (501, "", "xx", "one"), (502, "12 34", "xx", None), (503, "rare words once", "xx", "two"), (None, "Alpha" * 3, "de", "a")]
    return out + out[:4] + [(600, text(rnd, 20_000), "en", "long")]


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, sourced, monkeypatch, small):
    if small:       # several blocks, merges and column blocks
        for name, value in (("BLOCK_BYTES", 300), ("HELD_ROWS", 50), ("CELLS", 24)):
            monkeypatch.setattr(divergence, name, value)
    found = divergence.divergence_audit(with_names(spark, sourced))
    expected = plain_divergence(sourced)
    assert {r[2] for r in expected} == {"pair", "term"} and any(r[4] == 0 for r in expected)
    same(found, COLUMNS, expected)


def test_divergence_parameters_and_empty(spark, sourced):
    same(divergence.divergence_audit(with_names(spark, sourced), min_docs=2, top_terms=3), COLUMNS, plain_divergence(sourced, 2, 3))
    assert divergence.divergence_audit(with_names(spark, sourced).limit(0)).collect() == []


def test_shares_are_exact_for_counts_of_a_large_corpus():
    rnd = random.Random(2)
    for _ in range(300):
        n, terms = rnd.randrange(1, 10 ** 14), rnd.randrange(1, 10 ** 9)
        c = rnd.randrange(0, n)
        got = divergence._shares(np.array([c]), np.array([n]), terms)[0]
        assert got == 1 + 10 ** 9 * (c + 2) // (n + 2 * terms)
    p, q = np.array([10 ** 9 + 1, 5]), np.array([1, 10 ** 9])
    assert divergence._divergences(p, q).tolist() == [int((int(a) - int(b)) ** 2 // (int(a) + int(b))) for a, b in zip(p, q)]


# --------------------------------------------------------------- fill-in-middle
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(d, t):
    t = t or ""
    units = UNIT.findall(t)
    digest = hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 50:
        return d, len(units), "plain", None, None, t
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return d, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, rows):
    rnd = random.Random(12)
    extra = [(1000 + k, rnd.choice(["", " ", "\n"]) + text(rnd, rnd.randrange(1, 30)) + rnd.choice(["", " \n", "<", "<P"])) for k in range(150)]
    extra += [(2000 + k, x) for k in range(8) for x in ("<P>", "a <S> b", "<M", " \t ", "é 日本 x ", "\x00 a", "<|x|> <")]
    docs = rows + extra + rows[:3] + [(None, "null id text " * 5), (None, None)]
    df = with_names(spark, [(d, t, "en", None) for d, t in docs])
    out = fim.fill_in_middle(df)
    expected = [plain_fim(d, t) for d, t in docs]
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}
    same(out, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "text"], expected)
    back = out.select("doc_id", fim.restored().alias("text"))
    same(back, ["doc_id", "text"], [(d, t or "") for d, t in docs])
    assert fim.fill_in_middle(df.limit(0)).collect() == []
    assert {r["form"] for r in fim.fill_in_middle(df, fim_percent=100, spm_percent=0).collect()} == {"plain", "psm"}


def test_skip_list_reaches_every_rank():
    rnd = random.Random(13)
    texts = [text(rnd, n) + rnd.choice(["", " "]) for n in (0, 1, 2, 7, 40, 300)] + ["", " \n", "x", "日本 語"]
    n, units = fim.unit_list([t.encode() for t in texts])
    parts = [UNIT.findall(t) for t in texts]
    assert n.tolist() == [len(p) for p in parts] and len(units.units) > 2
    assert all(p.sum() == sum(map(len, texts)) for p in units.points)      # every lane carries all code points
    for r in range(int(n.max()) + 1):
        ranks = np.minimum(r, n)
        assert units.find(ranks).tolist() == [len("".join(p[:k])) for p, k in zip(parts, ranks)]


# ------------------------------------------------------------------ language id
def plain_profiles(rows, dimensions):
    """Prototypes and predictions by the definition, one n-gram at a time."""
    sign = {}

    def letter(c):
        if c not in sign:
            sign[c] = 1 - 2 * langid.sign_bits(np.array([0 if c == " " else ord(c)]), dimensions)[0].astype(int)
        return sign[c]

    def bundle(t):
        s = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in t or "")
        s = re.sub(" +", " ", f" {s} ")
        out = np.zeros(dimensions, int)
        for k in range(len(s) - 2):
            a, b, c = map(letter, s[k:k + 3])
            out += np.roll(a, 2) * np.roll(b, 1) * c
        return out, any(c != " " for c in s)

    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2
    learned = {}
    for d, t, lang, _ in rows:
        if t is not None and lang is not None and not held(d):
            learned[lang] = learned.get(lang, 0) + bundle(t)[0]
    out = []
    for d, t, _, _ in rows:
        v, some = bundle(t)
        best = ("und", 0.0)
        if some and learned:
            c = {x: round(float(v @ p / max(np.linalg.norm(v) * np.linalg.norm(p), 1e-300)), 9) for x, p in learned.items()}
            x = min(c, key=lambda x: (-c[x], x))
            best = (x, max(0.0, c[x]))
        out.append((d, held(d), *best))
    return out


@pytest.fixture(scope="module")
def languages():
    rnd = random.Random(14)
    alphabets = {"en": "abcdefgh", "ru": "абвгдежз", "zh": "的一是不了人我在", "x1": "abcdefgi"}
    out = []
    for k in range(80):
        lang = rnd.choice(list(alphabets))
        t = " ".join("".join(rnd.choice(alphabets[lang]) for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 30)))
        out.append((k, t.capitalize(), lang, None))
    out += [(500, None, "en", None), (501, "", "en", None), (502, "12 ! 34\n", "en", None), (503, "Б", None, None), (504, "q", "en", None),
            (None, "abc abc", "en", None), (505, "İstanbul ẞ ǅ a1b", None, None), (506, " ".join(WORDS * 200), "", None)]
    return out + out[:3]


def predictions(df):
    return sorted(((r[0], r[1], r[2], r[3]) for r in df.collect()), key=str)


@pytest.mark.parametrize("groups, piece", [(2048, 1 << 20), (1, 1 << 20), (2048, 50)])
def test_language_id(spark, languages, monkeypatch, groups, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "GRAMS", 4096 if piece > 50 else 16)
    df = with_names(spark, languages)
    learned = langid.prototypes(df.where(~langid.held_out()), dimensions=256)
    got = predictions(langid.predict(df, learned, dimensions=256, group_languages=groups))
    expected = sorted(plain_profiles(languages, 256), key=str)
    assert len({r[2] for r in expected}) >= 4
    for a, b in zip(got, expected, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=2e-9)


def test_language_id_without_anything_to_learn(spark):
    rows = [(1, "some text", None, None), (2, None, "en", None)]
    assert predictions(langid.identify(with_names(spark, rows))) == [(1, False, "und", 0.0), (2, False, "und", 0.0)]
    assert langid.identify(with_names(spark, rows).limit(0)).collect() == []


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id")
    judged = found.where("held_out and lang is not null and lang_pred <> 'und'").select(
        (F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), (F.length("text") >= 100).alias("long"))
    rate = {r["long"]: (r["ok"], r["n"]) for r in judged.groupBy("long").agg(F.avg("ok").alias("ok"), F.count("ok").alias("n")).collect()}
    assert rate[True][1] > 150 and rate[True][0] >= 0.98
