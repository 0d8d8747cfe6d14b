"""Every query against its SQL on the smallest tables; queries without SQL against what must hold of their rows."""

import os
from collections import Counter

import duckdb
import pytest

from tripleloom.plans import catalog
from tripleloom.plans.base import SQL_TRIPLES


def norm(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(repr(tuple(norm(r[i]) for i in order)) for r in rows)


def keys(n):
    """Rows have different keys (the first n columns)."""

    def check(df, rows, db):
        assert rows and len({tuple(r[c] for c in df.columns[:n]) for r in rows}) == len(rows)

    return check


def covers(table, key):
    """Every id of a table that is not left out comes back once."""

    def check(df, rows, db):
        want = {x for (x,) in db.sql(f"select distinct {key} from {table}").fetchall()}
        assert len(rows) == len(want) and {r[key] for r in rows} == want

    return check


def joined_text(df, rows, db):
    """Chunks hold all words of their text in order, apart from the words that chunks carry over."""
    texts = dict(db.sql("select doc_id, text from documents").fetchall())
    for doc in {r["id"] for r in rows}:
        words, at = texts[doc].split(), 0
        for r in sorted((r for r in rows if r["id"] == doc), key=lambda r: r["chunk_id"]):
            part = r["text"].split()
            start = next(k for k in range(at, max(-1, at - 60), -1) if words[k : k + len(part)] == part)
            at = start + len(part)
        assert at == len(words)


def counters(df, rows, db):
    for r in rows:
        assert r["n_in"] == r["n_clean"] + r["n_repaired"] + r["n_failed"] and r["n_out"] >= r["n_in"]
        assert r["n_single"] + r["n_multi"] == r["n_in"] - r["n_clean"] and r["n_multi_out"] >= r["n_multi"]
    assert sum(r["n_in"] for r in rows) == db.sql(f"select count(distinct triple_id) from {SQL_TRIPLES}").fetchall()[0][0]


def some(df, rows, db):
    assert rows and all(any(v is not None for v in r.values()) for r in rows)


# what stands for the SQL of a query that has none
CHECKS = {
    "char_chunks": joined_text, "paragraph_chunks": joined_text, "answer_triples": keys(2), "strict_answers": keys(1), "entity_matches": keys(1),
    "fact_entity_labels": keys(1), "object_resolution": keys(3), "resolution_history": keys(1), "resolution_counts": counters, "correlation_tests": keys(1),
    "graph_structure": keys(1), "density_clusters": covers("embeddings", "vec_id"), "leader_clusters": covers("embeddings", "vec_id"),
    "one_to_one_match": keys(1), "fuzzy_scores": some, "extraction_pipeline": keys(3), "name_vectors": some, "statement_contexts": keys(2),
    "classified_facts": keys(1), "matched_relations": some, "entity_graphs": some, "cluster_relations": some, "repaired_answers": keys(2), "context_sentences": keys(2), "token_f1": some,
}


@pytest.fixture(scope="session")
def db(data):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in sorted(os.listdir(data)):
        con.sql(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, db, name):
    df = catalog.queries()[name](spark, data)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        check = CHECKS[name]
        check(df, [r.asDict() for r in df.collect()], db)
        return
    got = [tuple(r) for r in df.collect()]
    rel = db.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, got) == rows_of(rel.columns, rel.fetchall())
