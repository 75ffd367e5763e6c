"""The corpus pipeline stage by stage: each decision against brute force on what its predecessor kept."""

from collections import Counter

import duckdb
import pytest
from test_decontaminate import words
from test_overlap import slow_kept

import __spark_entry__ as entry
import corpus_pipeline
from titleloom.llm import mixing, quality
from titleloom.llm.common import store
from titleloom.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows after each stage, the documents first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["good_quality", "near_duplicates", "benchmark_free", "mix_sources", "shard"]
    for df in kept[:-1]:
        assert sorted(df.columns) == sorted(kept[0].columns)
    assert kept[-1].columns == [*kept[0].columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_quality_rejects(spark, kept):
    scores = quality.quality(kept[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    good = {r.doc_id for r in scores if r.predicted == 1}
    assert sorted(r[0] for r in rows(kept[1])) == sorted(good)
    assert 0 < len(good) < len(scores)


def test_one_document_of_each_group_stays(kept):
    """Groups by five-word shingles with a Jaccard similarity of 0.8 or more, compared pair by pair."""
    before, after = rows(kept[1]), rows(kept[2])
    assert sorted(r[0] for r in after) == slow_kept([r[:2] for r in before])
    assert set(after) <= set(before)


def test_no_benchmark_window_is_left(spark, kept):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if w}
    dirty = lambda text: any(tuple(w[i : i + n]) in windows for w in [words(text)] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    before, after = rows(kept[2]), rows(kept[3])
    assert sorted(after) == sorted(r for r in before if not dirty(r[1]))
    assert len(after) < len(before)


def test_mixing_repeats_documents(kept):
    copies = {r.doc_id: r.copies for r in mixing.mix(kept[3]).collect()}
    assert Counter(r[0] for r in rows(kept[4])) == Counter({d: c for d, c in copies.items() if c})


def test_sharding_keeps_every_row(kept):
    assert Counter(rows(kept[5])) == Counter(rows(kept[4]))
    counts = Counter(r.shard for r in kept[5].collect())
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1


def test_run_equals_the_stages(spark, kept):
    got = sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(map(str, kept[-1].select(*corpus_pipeline.run(spark, SF).columns).collect()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, result.fetchall()))


def test_all_operators_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}
