"""Licenses with words put in, left out and replaced; order and extent of an occurrence."""

import pytest

from ledgerlens.llm import licenses

EXPECTED = {
    "this is licensed under the MIT License": ("mit", 1.0),
    "licensed under the apache (new) license, version 2.0": ("apache-2.0", 0.875),
    "licensed under cc quite by nc": ("cc-by-nc", 0.8),
    "released and under the mit license": ("mit", 0.8),
    "provided under the mit license": ("mit", 0.8),
    "licensed under cc by sa": ("cc-by", 1.0),
    "released under the bsd license": ("", 0.0),
    "licensed under the gnu general public license version 2": ("gpl", 1.0),
    # All bigrams, in the wrong order or far apart.
    "mit license filler the mit filler under the filler released under": ("", 0.0),
    "released under " + "x " * 3 + "under the " + "x " * 3 + "the mit " + "x " * 3 + "mit license": ("", 0.0),
    "source code form is subject to x the terms of the mozilla public license": ("mpl", 1 - 2 / 14),
}


def test_edits_in_order(spark):
    docs = spark.createDataFrame(list(enumerate(EXPECTED)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_scan(docs).collect()}
    for k, (text, (labels, score)) in enumerate(EXPECTED.items()):
        assert got[k] == (labels, pytest.approx(score)), text
