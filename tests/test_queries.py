"""Every registered query of the library against its SQL in DuckDB."""

import hashlib
import re

import duckdb
import pytest

import __spark_entry__ as entry
from winnow.functions import fixed
from winnow.operators import lexical, maxscore, retrieval
from winnow.plans import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 8) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(own.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)


def test_inverted_abstracts_go_over_whole_texts(spark, sf_dir):
    documents = own.load(spark, sf_dir, "documents")
    whole = {r["doc_id"]: " ".join(r["text"].split()) for r in documents.collect()}
    assert max(len(t.split()) for t in whole.values()) > 1000
    assert {r["doc_id"]: r["words"] for r in own.rebuilt_texts(documents).collect()} == whole


def test_abstract_cuts_go_over_whole_texts(spark, sf_dir):
    rows = own.load(spark, sf_dir, "documents").collect()
    assert max(len(r["text"]) for r in rows) > 1000
    want = {}
    for r in rows:
        x = f"{r['text']}.{own._ENDS[r['doc_id'] % len(own._ENDS)]}"
        for p in fixed.ABSTRACT_CUTS:
            x = re.sub(f"(?is)(?:{p}).*$", "", x, count=1)
        want[r["doc_id"]] = hashlib.md5(x.encode()).hexdigest()
    assert {r["doc_id"]: r["digest"] for r in entry.queries()["abstract_cuts"](spark, sf_dir).collect()} == want


def test_lexical_shortlists_go_over_all_texts_and_write_no_postings(spark, sf_dir, monkeypatch):
    written, plain_kept = [], lexical.kept
    for module in (lexical, retrieval, maxscore):
        monkeypatch.setattr(module, "kept", lambda df, name: written.append(name) or plain_kept(df, name))
    documents = own.load(spark, sf_dir, "documents")
    got = entry.queries()["lexical_shortlists"](spark, sf_dir).collect()
    assert not {"shards"} & set(written) and written.count("counted") == 1  # that of the queries
    assert {r["query_id"] for r in got} == {r["doc_id"] for r in documents.where("doc_id % 100 = 0").collect()} and {r["grp"] for r in got} <= {r["source"] for r in documents.collect()}


def test_metadata_variants_go_over_all_events(spark, sf_dir):
    events = own.load(spark, sf_dir, "events").collect()
    rows = entry.queries()["metadata_variants_all"](spark, sf_dir).collect()
    distinct = {(r["user_id"] * 20 + r["event_id"] % 20, r["event_type"], r["value"] < 20) for r in events}
    assert sum(r["variants"] for r in rows) == len(distinct) and {r["lot"] for r in rows} == {k for k, *_ in distinct}
    assert {r["outcome"] for r in rows} >= {"accepted", "conflicting_metadata_versions", "not_error", "not_signup"}


def test_paired_bootstrap_draws_2000_samples(spark, sf_dir):
    assert entry.queries()["paired_bootstrap"](spark, sf_dir).first()["samples"] == 2000


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(own.QUERIES) - set(own.SQL)):
        assert entry.queries()[name](spark, sf_dir).count() > 0, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
