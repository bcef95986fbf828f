"""Registered queries against their SQL, and the pipeline against its stages by hand."""

import duckdb
import pytest

import corpus_pipeline
from ledgerlens.llm.oracle import ORACLE
from ledgerlens.llm.queries import QUERIES
from ledgerlens.llm import tokens as K
from ledgerlens.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tokenizers import Tokenizer

from . import brute


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    result = duck.execute(ORACLE[key])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == sorted(result.fetchall(), key=str)


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]


def test_token_files_query(spark):
    got = sorted(tuple(r) for r in QUERIES["op6_token_files"](spark, SF_SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute.token_files(documents(spark), Tokenizer.from_file(K.public("byte_bpe_50k.json")))


def test_license_and_quality_queries(spark):
    docs = documents(spark)
    got = QUERIES["op8_license_scan"](spark, SF_SMALL).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.base_licenses(docs), key=str)
    report = QUERIES["op9_quality_rules"](spark, SF_SMALL)
    assert sorted(map(tuple, report.drop("kept", "log_perplexity").collect())) == sorted(brute.quality(docs))
    langs = dict(tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang").collect())
    got = {r["doc_id"]: r for r in report.collect()}
    for d, log_perplexity, kept in brute.quality_kept([(d, langs[d], t) for d, t in docs]):
        assert got[d]["kept"] == kept and got[d]["log_perplexity"] == (None if log_perplexity is None else pytest.approx(log_perplexity, abs=1e-6))


def test_pipeline(spark):
    """Each stage on its predecessor's rows, held against plain Python."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in kept.collect()]
        out = stage(spark, kept, SF_SMALL)
        assert out.columns == columns
        after = sorted((r["doc_id"], r["text"]) for r in out.collect())
        if name == "quality_rules":
            verdict = {d for d, _, ok in brute.quality_kept([(r["doc_id"], r["lang"], r["text"]) for r in kept.collect()]) if ok}
            assert after == sorted(x for x in before if x[0] in verdict) and len(after) < len(before)
        elif name == "line_dedup":
            assert after == sorted((r[0], r[4]) for r in brute.lines(before))
        elif name == "jaccard_join":
            stay = {d for d, _, c in brute.jaccard(before) if d == c}
            assert after == sorted(x for x in before if x[0] in stay) and len(after) < len(before)
        else:
            bad = {r[0] for r in brute.contamination(before, items) if r[-1]}
            assert after == sorted(x for x in before if x[0] not in bad)
        kept = out
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF_SMALL).collect()
    tokenizer = Tokenizer.from_file(K.public("word_bpe_49k.json"))
    sizes = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in kept.collect()}
    got: dict = {}
    for r in last:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == sizes
    assert len({r["sequence_id"] for r in last}) == brute.best_fit([r["length"] for r in last], 4096)
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF_SMALL).collect()) == sorted(tuple(r)[:5] for r in last)
