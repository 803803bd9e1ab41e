"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from threadloom import registry
from threadloom.operators import duplicates

DATA = "/root/testdata/sf0.001"
CHOSEN = ("role_profile", "missing_by_column", "link_quality", "recursive_threads", "thread_stats_by_conv", "reconstruction_status", "journey_assembly", "group_split", "stratum_counts", "intent_top1", "state_at_every_point", "ledger_attempts", "tf_cosine_topk", "transition_evidence", "next_action", "escalation_codes", "cohens_kappa", "annotation_errors", "journey_violations", "split_violations", "threads_by_rounds", "threads_cut_at_depth", "point_violations", "missing_requirements", "action_reasons", "components_of_two_signatures", "full_norm_families", "split_manifest", "pool_statistics", "upserted_records", "online_annotation_errors", "evaluation_report", "agreement_report", "majority_baseline")


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) if isinstance(a, float) and isinstance(b, float) else a == b


def test_every_oracle_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 50


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    left, right = (sorted((tuple(r) for r in rows), key=repr) for rows in (got.select(*columns).collect(), want.fetchall()))
    assert len(left) == len(right) and all(same(x, y) for a, b in zip(left, right, strict=True) for x, y in zip(a, b, strict=True))


def test_golden_overlap_guard_finds_short_texts(spark, tmp_path):
    rows = {"documents": ["so be it", "nothing", None, "", "a long enough document, so be it", "quotes the whole reserved text here"], "benchmark": ["be it", "zz", None, "the whole reserved text", "nothing else here"]}
    con = duckdb.connect()
    for name, texts in rows.items():
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(r[0] for r in registry.queries()["golden_overlap_guard"](spark, str(tmp_path)).collect())
    assert got == sorted(r[0] for r in con.execute(registry.oracle_sql()["golden_overlap_guard"]).fetchall()) == [0, 4, 5]
    d, b = (spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in rows)
    assert sorted(r[0] for r in duplicates.quoting(d, b, "doc_id", most=1).collect()) == got and duplicates.quoting(d, b.limit(0), "doc_id").isEmpty()
