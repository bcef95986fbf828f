"""Operators whose tasks hand on, forget or range what they hold: results do not depend on the bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import jaccard, substrings, warc

from . import brute
from .conftest import same, text


def copies(n=60):
    """A passage in a third of all documents, in no order of ids, and documents that stand alone."""
    rnd = random.Random(11)
    passage = text(rnd, 40)
    rows = [(k, text(rnd, 30) + passage + text(rnd, 12) if k % 3 == 0 else text(rnd, 60)) for k in range(n)]
    rows += [(n + k, rows[k][1]) for k in range(0, n, 7)] + [(5, rows[5][1]), (None, rows[9][1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("remembered", [0, 40, 1 << 19])
def test_substrings_for_any_memory_of_a_task(frame, monkeypatch, remembered):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 600)
    monkeypatch.setattr(substrings, "SEEN_PIECES", remembered)
    rows = copies()
    found = substrings.removal_digests(substrings.remove_repeats(frame(rows, partitions=2)))
    same(found, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.substrings(rows))


def test_seen_pieces_keep_the_least_id():
    rnd, seen, least = np.random.default_rng(5), substrings.Seen(400), {}
    for _ in range(50):
        name = np.unique(rnd.zipf(1.3, 80).astype(np.uint64) % np.uint64(5000))
        ids = rnd.integers(0, 1000, len(name))
        got = seen.least_ids(name, name ^ np.uint64(9), ids)
        for n, own, low in zip(name.tolist(), ids.tolist(), got.tolist()):
            least[n] = min(own, least.get(n, own))
            assert least[n] <= low <= own           # a forgotten piece starts anew
            if n < 4:
                assert low == least[n]              # those met again and again stay
        assert len(seen.name) <= 400 and (np.diff(seen.name.astype(np.int64)) > 0).all()


def test_hot_pieces_travel_once_a_task():
    """A passage in every text, in texts of a chunk each, reaches its anchor once."""
    import pyarrow as pa
    rnd = random.Random(2)
    passage = text(rnd, 40).encode()
    sent = []
    for n in (4, 40):
        texts = [text(rnd, 20).encode() + passage for _ in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array(texts, pa.binary())],
                                           names=["doc", "key", "text"])
        rows = [row for b in substrings._deal(1, 50, 12)(batch.slice(k, 1) for k in range(n)) for row in b.column(1).to_pylist()]
        parts = [substrings._unpack(row, substrings._KINDS) for row in rows]
        bytes_of = [x[6].tobytes() for x in parts]
        sent.append(sum(passage[60:130] in b for b in bytes_of) + sum(passage[60:90] in b for b in bytes_of))
    assert sent[0] == sent[1]


@pytest.mark.parametrize("held", [40, 4000])
def test_shingles_handed_on_in_slices(frame, rows, monkeypatch, held):
    want = sorted(map(tuple, jaccard.similar_documents(frame(rows)).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    monkeypatch.setattr(jaccard, "HELD_SHINGLES", held)
    same(jaccard.similar_documents(frame(rows)), ["doc_id", "n_shingles", "component_id"], want)


def test_archives_are_bounded_in_bytes_and_ranges_in_rows(spark, monkeypatch):
    """Pages of all size classes, one over the bound: every archive holds the bound or one record."""
    monkeypatch.setattr(warc, "CURSOR_ROWS", 3)
    most = 64 << 10
    rnd = random.Random(3)
    pages = [(k, f"http://h{k % 3}.org/{k % 5}", chr(97 + k % 9) * (rnd.choice([0, 5, 900, 3000, 6000, 20_000]) + k % 2)) for k in range(300)]
    pages += [(900, "http://h1.org/big", "z" * 100_000), (901, "http://h1.org/big", "z" * 100_000)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    index = warc.archive_pages(table, F.timestamp_seconds("page_id"), archive_bytes=most)
    same(index, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], brute.warc([(p, h) for p, _, h in pages]))
    for r in index.groupBy("archive").agg(F.sum(F.when(F.col("record_type") == "response", F.col("payload_bytes"))).alias("b"),
                                          F.count(F.lit(1)).alias("n")).collect():
        assert (r["b"] or 0) <= most or r["n"] == 1
    rows = index.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(len(pages)))
    keys = [(r["urlkey"], r["captured_at"], str(r["page_id"])) for r in rows]
    assert keys == sorted(keys)


def test_ranges_follow_the_number_of_captures(spark, tmp_path):
    table = spark.createDataFrame([(k, "http://one.org/", f"page {k}") for k in range(200)], "page_id long, url string, html string").repartition(5)
    warc.write_archives(table, str(tmp_path / "w"), F.timestamp_seconds(F.lit(0)))
    merged = warc.merge_runs(warc.sorted_runs(spark, str(tmp_path / "w")), range_rows=10).collect()
    sizes = {}
    for r in merged:
        sizes[r["part"]] = sizes.get(r["part"], 0) + 1
    assert len(merged) == 200 and len(sizes) >= 15 and max(sizes.values()) <= 30      # one URL, many ranges
    order = [r["page"] for r in sorted(merged, key=lambda r: (r["part"], r["pos"]))]
    assert order == sorted(order)
