"""Plain Python versions of the operators' results, over lists of rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def sha256(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def chat(rows):
    """rows: (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha256(loss)))
    return out


def contamination(docs, items, width=13):
    grams = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(UPPER))
        size = min(width, len(words))
        for k in range(len(words) - size + 1) if size else ():
            grams[tuple(words[k:k + size])].add(str(item) if item is not None else "null")
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        words = ALNUM.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if (g := tuple(words[k:k + size])) in grams:
                    hit.update(range(k, k + size))
                    found |= grams[g]
        out.append((doc, len(words), len(hit), len(found), sha256(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def warc(pages):
    """pages: (page_id, html)."""
    payloads = [(p, (h or "").encode()) for p, h in pages]
    largest = {}
    for p, b in payloads:
        if len(b) >= 1000 and p is not None:
            largest[b] = max(p, largest.get(b, p))
    return [(p, len(b), hashlib.sha1(b).hexdigest(), *(("revisit", largest[b]) if largest.get(b, p) != p else ("response", None))) for p, b in payloads]


def substrings(docs, length=50):
    first = {}
    for d, t in docs:
        b, d = (t or "").encode(), 1 << 63 if d is None else d
        for k in range(len(b) - length + 1):
            g = b[k:k + length]
            first[g] = min(d, first.get(g, d))
    out = []
    for d, t in docs:
        b, own = (t or "").encode(), 1 << 63 if d is None else d
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < own:
                gone[k:k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), sha256(kept)))
    return out


def lines(docs):
    """docs: distinct (doc_id, text) pairs."""
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: x[0]):
        own = (t or "").split("\n") if t is not None else []
        gone = set()
        for k in range(len(own) - 2):
            w = tuple(own[k:k + 3])
            if SPACED.search("".join(w)):
                if w in seen:
                    gone.update((k, k + 1, k + 2))
                seen.add(w)
        out.append((d, len(own), len(gone), sum(1 for k in gone if k - 1 not in gone),
                    None if t is None else "\n".join(x for k, x in enumerate(own) if k not in gone)))
    return out


def token_files(docs, tokenizer, end_id=2):
    out, start = [], 0
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def shingles(text, size=5):
    words = SPACED.findall((text or "").translate(UPPER))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1))


def jaccard(docs, percent=80):
    """docs: (doc_id, text), ids distinct and not null."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    by = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by[g].append(d)
    both = Counter((a, b) for own in by.values() for i, a in enumerate(own) for b in own[i + 1:])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(d, len(s), find(d)) for d, s in sets.items()]


def base_licenses(docs):
    phrases = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
    out = []
    for d, t in docs:
        words = ALNUM.findall((t or "").translate(UPPER))
        at = [(k, label) for text, label in phrases for k in range(len(words)) if words[k:k + len(text.split())] == text.split()]
        out.append((d, len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None),
                    ",".join(sorted({x for _, x in at}))))
    return out


def quality(docs):
    out = []
    for d, t in docs:
        t = t or ""
        words = SPACED.findall(t)
        windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
        hit = {i for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for i in range(k, k + 8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += line in seen and bool(SPACED.search(line))
            seen.add(line)
        out.append((d, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit),
                    len(words) < 20 or 100 * len(hit) > 30 * len(words)))
    return out


def best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, b in enumerate(bins) if b + x <= capacity]
        if fits:
            bins[max(fits, key=lambda k: bins[k])] += x
        else:
            bins.append(x)
    return len(bins)


def tokens(t):
    from ledgerlens.llm.quality import SINGLES

    out, word = [], ""
    for c in (t or "").translate(UPPER) + " ":
        single = any(a <= ord(c) <= b for a, b in SINGLES)
        if single or c in " \t\n\v\f\r":
            out += [word] if word else []
            out += [c] if single else []
            word = ""
        else:
            word += c
    return out


def perplexities(docs, order=3):
    """``(log perplexity, by single tokens)`` of each ``(lang, text)``: modified Kneser-Ney by language,
    where an n-gram that only one text holds counts as unseen."""
    from math import log

    copies, out = Counter(docs), {}
    for lang in {x for x, _ in docs}:
        own = {}
        for t in {t for x, t in docs if x == lang}:
            ws = ["<s>"] * (order - 1) + tokens(t)
            own[t] = [Counter(tuple(ws[k - n + 1:k + 1]) for k in range(order - 1, len(ws))) for n in range(1, order + 1)]
        c = [Counter() for _ in range(order)]
        for t, grams in own.items():
            for n in range(order):
                for g, k in grams[n].items():
                    c[n][g] += k * copies[lang, t]
        a = [Counter(g[1:] for g in c[n + 1]) for n in range(order - 1)] + [c[-1]]
        p, rest = [], []
        for n in range(order):
            of = Counter(a[n].values())
            d = [0.0, 0.5, 0.5, 0.5]
            if of[1] and of[2]:
                y = of[1] / (of[1] + 2 * of[2])
                d[1:] = [min(max(k - (k + 1) * y * of[k + 1] / of[k], 0.1), k - 0.05) if of[k] else 0.5 for k in (1, 2, 3)]
            total, cut = Counter(), Counter()
            for g, k in a[n].items():
                total[g[:-1]] += k
                cut[g[:-1]] += d[min(k, 3)]
            rest.append({x: cut[x] / total[x] for x in total})
            p.append({g: (k - d[min(k, 3)]) / total[g[:-1]] + rest[n][g[:-1]] * (p[n - 1][g[1:]] if n else 1 / len(a[0]))
                      for g, k in a[n].items()})
        for t, grams in own.items():
            many = sum(grams[0].values())
            if not many:
                out[lang, t] = (None, None)
                continue

            def logp(g):
                if len(g) == 0:
                    return -log(len(a[0]))
                if c[len(g) - 1][g] > grams[len(g) - 1][g] * copies[lang, t]:
                    return log(p[len(g) - 1][g])
                return log(rest[len(g) - 1][g[:-1]]) + logp(g[1:])
            out[lang, t] = (-sum(k * logp(g) for g, k in grams[-1].items()) / many, -sum(k * logp(g) for g, k in grams[0].items()) / many)
    return out


def quality_kept(docs, spread=2.5, width=0.001):
    """``(doc_id, log perplexity, kept)`` of each ``(doc_id, lang, text)``."""
    from math import floor

    found, base = perplexities([(x, t) for _, x, t in docs]), quality([(d, t) for d, _, t in docs])

    def quartile(values, q):
        bins, upto = Counter(floor(v / width) for v in values), 0
        for b in sorted(bins):
            upto += bins[b]
            if upto >= q * len(values):
                return (b + 0.5) * width

    limits = {}
    for lang in {x for _, x, _ in docs}:
        passed = [found[x, t] for (_, x, t), r in zip(docs, base) if x == lang and not r[-1] and found[x, t][0] is not None]
        if passed:
            full, single = ([quartile([v[k] for v in passed], q) for q in (0.25, 0.75)] for k in (0, 1))
            limits[lang] = (full[1], spread * (full[1] - full[0] + width), single[0], spread * (single[1] - single[0] + width))
    out = []
    for (d, x, t), r in zip(docs, base):
        v, kept = found[x, t], not r[-1]
        if kept and x in limits and v[0] is not None:
            wider = max(1.0, 1000 / max(r[2], 1)) ** 0.5
            high, room, low, room_single = limits[x]
            kept = v[0] <= high + room * wider and v[1] >= low - room_single * wider
        out.append((d, v[0], kept))
    return out
