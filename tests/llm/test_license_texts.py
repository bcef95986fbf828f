"""Labels and scores of the license scan against a plain-Python edit distance."""

import random

import pytest

from ledgerlens.llm import licenses

HEADERS = {
    "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": "apache-2.0",
    "// SPDX-License-Identifier: MIT": "mit",
    "# SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "SPDX-License-Identifier: BSD-2-Clause": "bsd-2-clause",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0",
    "SPDX-License-Identifier: ISC": "isc",
    "SPDX-License-Identifier: Zlib": "",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "This is free and unencumbered software released into the public domain.": "public-domain,unlicense",
    "the film was placed in the domain of the public": "",
}


def _sub_edits(template, must, words):
    """Least edits of the template anywhere in ``words``; a word is found together with a neighbour."""
    n, t = len(words), len(template)

    def found(i, p):
        if p >= n or words[p] != template[i]:
            return False
        after = i + 1 < t and p + 1 < n and words[p + 1] == template[i + 1]
        return after or (i > 0 and p > 0 and words[p - 1] == template[i - 1])

    cost = [0] * (n + 1)                        # by the text position where the next template word would stand
    for i in range(t):
        edit = 99 if template[i] in must else 1
        new = [c + edit for c in cost]
        for p in range(n):
            new[p + 1] = min(new[p + 1], new[p] + 1, cost[p] + (0 if found(i, p) else edit))
        cost = new
    return min(cost)


def brute(text):
    words, labels, score = text.split(), set(), 0.0
    for k, (phrase, label) in enumerate(licenses.BASE + licenses.TEMPLATES):
        template = phrase.split()
        base = k < len(licenses.BASE)
        edits = _sub_edits(template, licenses.MUST.get(label, "").split(), words)
        if edits <= (0 if base else int(len(template) * (1 - licenses.MIN_COVER) + 1e-9)):
            labels.add(label)
            score = max(score, 1 - edits / len(template))
    return ",".join(sorted(labels)), score


def edited(rnd, words, n):
    """``words`` with ``n`` edits, apart from each other and from the ends of sections."""
    edges = {0, len(words)} | {len(words) * k // parts for parts in [-(-len(words) // licenses.SECTION)] for k in range(parts)}
    places = [i for i in range(2, len(words) - 2) if all(abs(i - e) > 2 for e in edges)]
    out, used = list(words), []
    for _ in range(n):
        free = [i for i in places if all(abs(i - u) > 3 for u in used)]
        if not free:
            break
        used.append(rnd.choice(free))
    for i in sorted(used, reverse=True):
        kind = rnd.choice("ird")
        out[i:i + (kind != "i")] = [] if kind == "d" else [f"z{rnd.randrange(99)}"]
    return out


def test_license_headers(spark):
    docs = spark.createDataFrame(list(enumerate(HEADERS)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.license_scan(docs).collect()}
    for k, (text, labels) in enumerate(HEADERS.items()):
        assert got[k] == labels, text


def test_edited_texts_against_edit_distance(spark):
    rnd = random.Random(11)
    filler = ["of", "the", "and", "software", "license", "to", "use", "copy", "this", "alpha", "beta"]
    texts = []
    for phrase, _ in licenses.TEMPLATES:
        words = phrase.split()
        most = int(len(words) * (1 - licenses.MIN_COVER) + 1e-9)
        for n in {0, 1, most, most + 1}:
            parts = [rnd.choice(filler) for _ in range(rnd.randrange(30))], edited(rnd, words, n), [rnd.choice(filler) for _ in range(rnd.randrange(30))]
            texts.append(" ".join(w for part in parts for w in part))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_scan(docs).collect()}
    for k, text in enumerate(texts):
        labels, score = brute(text)
        assert got[k] == (labels, pytest.approx(score)), text


def test_long_text_needs_all_its_sections(spark):
    words = dict((label, phrase) for phrase, label in licenses.TEMPLATES)["mit-text"].split()
    assert len(words) > 64 and len([x for x in licenses.sections() if x[3] == "mit-text"]) == 3
    third = len(words) // 3
    texts = [" ".join(words), " ".join(words[third:]), " ".join(words[third:] + words[:third]),
             " ".join(words[:third] + ["x"] * 60 + words[third:]), " ".join(words + ["y"] * 3000 + words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: "mit-text" in r["labels"].split(",") for r in licenses.license_scan(docs).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True}
