"""License scan by diagonal voting.

All rolling word bigrams of a text are joined, by hash and then by their words, with the
places of the same bigrams in short license templates.  A match at word ``pos`` and template
place ``tpos`` votes for the diagonal ``pos - tpos``, the word where the template would start.
Votes are gathered by document, template and diagonal.  Each diagonal is taken together with
those at most as many words away as edits are allowed, and the template's words are verified in
order along them: the least number of words put in, left out or replaced, by a banded edit
distance.  A template takes one edit for every five of its words; the words that tell it from
others (``MUST``) take none.  Longer templates are cut into sections of at most ``SECTION`` words, each
voted for and verified as a template, and found where all sections lie together.  A word counts as found where a bigram with it voted.  Base phrases
take no edits: only a diagonal with all votes is a place.

The template table is a fixed list of several hundred rows, the only broadcast.  One pass over
the texts, one shuffle of the votes by document; a last word that no text can hold makes each
document send one row, which carries its number of words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Edge cases: a null or
empty text has no words; repeated rows and rows with null or equal ids are scanned and
returned one by one; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 2
MIN_COVER = 0.8                  # share of a template's words that no edit takes

#: Base phrases: places where their words stand consecutively.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Templates of the method's own labels, wordings of well-known licenses.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("apache license version 2 0 january 2004", "apache-2.0"),
    ("spdx license identifier apache 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
    ("spdx license identifier bsd 2 clause", "bsd-2-clause"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission", "bsd-3-clause"),
    ("spdx license identifier bsd 3 clause", "bsd-3-clause"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following "
     "disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
     "the following disclaimer in the documentation and or other materials provided with the distribution", "bsd-clauses"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("spdx license identifier cc0 1 0", "cc0"),
    ("licensed under a creative commons attribution", "creative-commons"),
    ("spdx license identifier gpl 2 0", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("spdx license identifier gpl 3 0", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license", "gpl-notice"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("spdx license identifier isc", "isc"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("spdx license identifier mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
     "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
     "and this permission notice shall be included in all copies or substantial portions of the software the software "
     "is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
     "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
     "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
     "arising from out of or in connection with the software or the use or other dealings in the software", "mit-text"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("spdx license identifier mpl 2 0", "mpl"),
    ("released into the public domain", "public-domain"),
    ("placed in the public domain", "public-domain"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("spdx license identifier unlicense", "unlicense"),
]

#: Words that no edit may leave out or replace, by label.
MUST = {"apache-2.0": "apache 2", "bsd-2-clause": "bsd 2", "bsd-3-clause": "bsd 3 contributors endorse", "cc-by-nc": "cc by nc",
        "cc0": "cc0", "creative-commons": "creative commons", "gpl-2.0": "gpl 2", "gpl-3.0": "gnu general public gpl 3",
        "gpl-notice": "gnu general public", "isc": "isc fee", "mit": "mit", "mpl": "mozilla mpl", "public-domain": "public domain",
        "unlicense": "unencumbered unlicense"}

_LAST = "\x00"                   # after a text's last word; no word holds it
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


SECTION = 60                     # words of a section at most, which fit the bits of a long


def sections(phrases=None) -> list[tuple[int, int, int, str, list[str]]]:
    """``(whole, section, offset, label, words)``: phrases cut into sections of about equal length."""
    out = []
    for whole, (text, label) in enumerate(BASE + TEMPLATES if phrases is None else phrases):
        words = text.split()
        parts = -(-len(words) // SECTION)
        edge = [len(words) * k // parts for k in range(parts + 1)]
        out += [(whole, k, a, label, words[a:b]) for k, (a, b) in enumerate(zip(edge, edge[1:]))]
    return out


def template_places(spark: SparkSession) -> DataFrame:
    """Rows ``(template, label, base, bigrams, tpos, first, second, key)``; a template is a section."""
    rows = [(-1, None, False, 0, 0, _LAST, None)]
    for k, (whole, _, _, label, words) in enumerate(sections()):
        rows += [(k, label, whole < len(BASE), len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, bigrams int, tpos int, first string, second string")
    return table.withColumn("key", F.xxhash64("first", "second"))


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(row, doc_id, template, label, base, bigrams, diagonal, covered)``; ``covered`` has a
    bit for each template place that voted for the diagonal."""
    # The Kelvin sign is the one character beyond ASCII that lower() would turn into an ASCII letter.
    text = F.lower(F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ")))
    words = F.concat(F.array_remove(F.split(text, _NOT_WORD), ""), F.array(F.lit(_LAST)))
    each = (docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words.alias("words"))
            .select("row", "doc_id", "words", F.posexplode("words").alias("pos", "word"))
            .select("row", "doc_id", "pos", "word", F.get("words", F.col("pos") + 1).alias("next"))
            .withColumn("key", F.xxhash64("word", "next")))
    places = F.broadcast(template_places(docs.sparkSession))
    found = each.join(places, "key").where((F.col("word") == F.col("first")) & F.col("next").eqNullSafe(F.col("second")))
    return (found.select("row", "doc_id", "template", "label", "base", "bigrams", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
            .repartition("row")
            .groupBy("row", "doc_id", "template", "label", "base", "bigrams", "diagonal")
            .agg(F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("covered")))


def _allowed(words: int, min_cover: float) -> int:
    return int(words * (1 - min_cover) + 1e-9)


def _of_template(values: list[int]):
    """The value of a row's template, which is its number in ``values``."""
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col("template"))


def shares(edited: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """``edited`` with ``share``, the part of a whole template's words without an edit, null where it
    does not occur.  The sections of a long template are verified one by one; it occurs where all
    of them are found with few enough edits together, beginning, less their offsets, at most as many
    words apart as the whole template has edits; words between two sections count by that alone."""
    parts = sections()
    long = {whole for whole, k, *_ in parts if k}
    words = [sum(len(w) for other, *_, w in parts if other == whole) for whole, *_ in parts]
    drift = max(_allowed(n, min_cover) for n in words)
    short = F.when(F.col("edits") <= F.col("most"), 1 - F.col("edits") / F.col("words"))
    rows = (edited.withColumn("whole", _of_template([whole for whole, *_ in parts]))
            .withColumn("section", _of_template([k for _, k, *_ in parts]))
            .withColumn("in_all", _of_template([sum(whole == x for x, *_ in parts) for whole, *_ in parts]))
            .withColumn("all_words", _of_template(words))
            .withColumn("begin", F.col("diagonal") - _of_template([offset for _, _, offset, *_ in parts])))
    near = Window.partitionBy("row", "whole").orderBy("begin").rangeBetween(0, drift)
    least = [F.min(F.when((F.col("section") == k) & F.col("whole").isin(*long), F.col("edits"))).over(near)
             for k in range(1 + max(k for _, k, *_ in parts))]
    rows = rows.withColumn("least", F.filter(F.array(*least), lambda x: x.isNotNull()))
    total = F.aggregate("least", F.lit(0).cast("long"), lambda a, x: a + x)
    together = F.when((F.size("least") == F.col("in_all")) & (total <= F.floor(F.col("all_words") * (1 - min_cover) + 1e-9)),
                      1 - total / F.col("all_words"))
    return rows.withColumn("share", F.when(F.col("in_all") > 1, together).otherwise(short))


def edits(voted: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """All votes, each diagonal with ``words``, those of the template, ``most``, the edits allowed,
    and ``edits``, the least number of edits of an occurrence at most ``most`` words from the
    diagonal; null for base phrases and where too few words are found."""
    texts = [words for *_, words in sections()]
    allowed = [_allowed(len(t), min_cover) for t in texts]
    must = [sum(1 << i for i, x in enumerate(t) if x in MUST.get(label, "").split()) for *_, label, t in sections()]
    of = _of_template
    band = max(allowed)
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-band, band)
    rows = (voted.withColumn("found", F.expr("covered | shiftleft(covered, 1)"))
            .withColumn("any", F.bit_or("found").over(near))
            .withColumn("near", F.collect_list(F.struct("diagonal", "found")).over(near))
            .withColumn("words", of([len(t) for t in texts])).withColumn("most", of(allowed)).withColumn("must", of(must))
            .withColumn("near", F.when(~F.col("base") & (F.col("template") >= 0) & (F.bit_count("any") >= F.col("words") - F.col("most"))
                                       & (F.col("any").bitwiseAND(F.col("must")) == F.col("must")), F.col("near")))
            .withColumn("bits", F.when(F.col("near").isNotNull(), F.transform(F.sequence(F.lit(-band), F.lit(band)), lambda k: F.aggregate(
                F.filter("near", lambda x: x["diagonal"] == F.col("diagonal") + k), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x["found"]))))))
    # costs[k]: edits so far when the next word of the template would stand k - band words off the diagonal.
    return rows.withColumn("costs", F.expr(f"""
        if(bits is null, null, aggregate(sequence(0, cast(words as int) - 1), array_repeat(0, {2 * band + 1}), (old, i) ->
            aggregate(sequence(0, {2 * band}), cast(array() as array<int>), (new, k) -> array_append(new, least(
                old[k] + if(bits[k] & shiftleft(1L, i) <> 0, 0, if(must & shiftleft(1L, i) <> 0, 99, 1)),
                coalesce(get(old, k + 1), 99) + if(must & shiftleft(1L, i) <> 0, 99, 1),
                coalesce(get(new, k - 1), 9999) + 1)))))""")).withColumn("edits", F.array_min("costs"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cover: float = MIN_COVER) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score`` (the best share of words without an edit of an accepted label, else 0)."""
    place = F.col("base") & (F.bit_count("covered") == F.col("bigrams"))
    own = shares(edits(votes(docs, id_col, text_col), min_cover), min_cover).withColumn("place", place)
    own = own.withColumn("share", F.when(F.col("place"), F.lit(1.0)).otherwise(F.col("share")))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    at = F.when(F.col("place"), F.col("diagonal"))
    return (own.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template") < 0, F.col("diagonal"))).cast("long").alias("n_words"),
        F.count(at).alias("n_base"),
        F.min(at).cast("long").alias("first_word"),
        F.max(at).cast("long").alias("last_word"),
        joined(F.when(F.col("place"), F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("share").isNotNull(), F.col("label"))).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score")).drop("row"))
