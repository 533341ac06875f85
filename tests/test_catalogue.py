from __future__ import annotations

import glob
import math
import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quernstone.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent
CHECKED = ["pair_stats_limited", "condition_stats", "itemsets_k3", "multiway_lift", "ranking_v1", "tier_split", "sensitivity_21", "threshold_grid_36", "tier_distribution", "ranking_compare_ab", "rank_corr_spearman", "external_only", "crosstab_tertile", "cohen_kappa", "density_components", "sentence_split", "sentence_pairs", "contamination_hits", "length_outliers", "alias_components", "era_compare", "metadata_inconsistency", "condition_lift_lists", "itemset_contexts", "raw_vs_normalised", "rank_drops", "grid_stability", "ranking_metadata", "feature_relation", "label_source", "sentence_lexicon", "pair_evidence", "pair_review_flags"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(f"{float(v):.9g}") if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", CHECKED)
def test_queries_equal_their_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == cols
    key = lambda r: [(x is not None, str(type(x)), x) for x in r]
    a = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=key)
    b = sorted(([plain(dict(zip(want.columns, r, strict=True))[c]) for c in cols] for r in want.fetchall()), key=key)
    assert a == b


def test_every_sql_has_its_query():
    assert catalogue.ORACLES.keys() <= catalogue.QUERIES.keys()


def test_nothing_else_imports_the_training_data_operators():
    for p in ROOT.glob("quernstone/**/*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(?m)^\s*(?:from|import)\s[^\n]*\bllm\b", p.read_text()), p


def test_the_entry_works_without_them(tmp_path):
    subprocess.run(["cp", "-r", str(ROOT / "quernstone"), str(ROOT / "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quernstone/llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) == len(catalogue.QUERIES)
