"""The stages and queries over the smallest tables, against plain versions."""

import re
import zlib
from collections import Counter

import duckdb
import pytest
from test_dedup import plain_near

import corpus_pipeline
from farescope.llm import exact_dedup, mixing, packing, queries, toxicity
from farescope.llm.common import documents, labels, saved
from farescope.llm.tokens import vocabulary
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    out, docs = {}, documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, docs, SF), name)
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_names_and_columns(stages, spark):
    columns = documents(spark, SF).columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "packing")


def test_toxic_texts_go(stages, spark):
    before, after = stages["toxicity"]
    scores = {r.doc_id: r.predicted for r in toxicity.scores(before, labels(spark, SF)).collect()}
    assert sorted(i for i, _ in texts(after)) == sorted(i for i, p in scores.items() if not p)


def test_copies_go(stages):
    before, after = stages["exact_dedup"]
    first = {}
    for i, t in sorted(texts(before)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert sorted(i for i, _ in texts(after)) == sorted(first.values())


def test_near_copies_go(stages):
    before, after = stages["near_dedup"]
    assert sorted(i for i, _ in texts(after)) == sorted(i for i, _, root in plain_near(texts(before)) if i == root)


def test_mix_follows_rates(stages, spark):
    before, after = stages["mixing"]
    rates = mixing.rates(before, labels(spark, SF), corpus_pipeline.WEIGHTS).collect()
    assert Counter(i for i, _ in texts(after)) == Counter({r.doc_id: r.copies for r in rates if r.copies})
    tokens = {n: sum(r.n_tokens * r.rate * r[f"p_{n}"] for r in rates) for n in corpus_pipeline.WEIGHTS}
    assert tokens["high"] / tokens["low"] == pytest.approx(9, rel=1e-2)


def test_everything_is_packed(stages):
    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for i, t in texts(before):
        want[i] += len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
    assert got == want


def test_odd_and_empty_tables_go_through(spark):
    docs = documents(spark, SF)
    odd = docs.limit(0).unionByName(spark.createDataFrame([(1, None, "en", None, None), (2, "", None, "s", 0), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3)], docs.schema))
    for table, rows in ((docs.limit(0), 0), (odd, 2)):
        for _, stage in corpus_pipeline.STAGES[:3]:
            table = saved(stage(spark, table, SF), "odd")
        assert table.count() == rows
        for _, stage in corpus_pipeline.STAGES[3:]:
            table = saved(stage(spark, table, SF), "odd")
        assert {r.doc_id for r in table.collect()} <= ({1, 3} if rows else set())


def test_clashing_names_go_through(spark):
    from pyspark.sql import functions as F

    names = ["score_of_text", "copy_id", "copy_sha", "gone_id", "gone_key", "mix_id", "mix_copies", "mix_copy", "__score", "__id", "__sha", "__copies", "__copy"]
    docs = documents(spark, SF).withColumns({n: F.lit(n) for n in names})
    table = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = saved(stage(spark, table, SF), "clash")
        assert table.columns == docs.columns
    first = table.first()
    assert first and all(first[n] == n for n in names)


def test_queries_match_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    for name, text in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, SF)
        cursor = con.execute(text)
        names = [d[0] for d in cursor.description]
        assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_one_query_for_each_operator():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)] + ["pipeline"]
