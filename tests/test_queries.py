"""Registered queries against DuckDB on the smallest tables."""

import math
import os

import pytest

from trailweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "trj_r2r_summary", "trj_reverie_items", "trj_soon_items", "top04_retarget", "grf03_paths", "top06_candidates", "txt01_bleu_corpus", "txt04_rouge_l", "txt05_cider", "prj01_instructions",
    "prj11_dialogs", "prj02_numbers", "prm_prompts", "smp01_mixture", "smp06_ranks", "obs05_graph", "win01_moves", "snk03_search", "st01_stream_memory", "st02_status",
    "st03_stream_nodes", "st11_greedy", "st11_beams", "grf03_asked_paths", "grf03_asked_paths_by_joins", "src13_records", "src10_objects", "src11_renamed", "snk07_matrix",
    "src02_arrays", "src04_search", "jon02_grounding", "prj09_augmented", "src05_dialogs", "src07_connectivity", "src18_answers", "cfg_mixture", "snk11_scenes", "flt07_offenders", "src17_images",
    "str06_treebank", "txt13_tokens", "obs11_search_samples", "obs11_dialog_samples", "mth12_relative_views", "trj_cvdn_items", "txt06_cider_given_frequency", "txt09_bundle", "txt07_exact_counts",
    "obs11_samples", "st07_jumps", "txt13_left", "smp05_shuffled", "agg07_running_means", "grf02_distances_by_joins", "snk08_aligned_features",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the benchmark tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if hasattr(v, "as_tuple"):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_every_query_has_a_name_of_its_own_and_sql_names_exist():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.FLAGSHIP in registry.queries()


@pytest.mark.parametrize("name", ["st04_candidate_cache", "st06_rollout"])
def test_walks_same_as_sql(spark, duck, name):
    test_same_as_sql(spark, duck, name)


def test_stream_of_graphs_same_as_sql(spark, duck):
    test_same_as_sql(spark, duck, "st01_stream_graph")
