"""Driver contract: entry/queries/oracle_sql and the bench output line."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_points(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry_mod
    from spindex.catalog import registry
    assert set(registry()) <= set(entry_mod.queries())
    assert set(registry()) <= set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    df = entry_mod.entry(spark)
    assert df.columns == ["query_id", "rank", "page_id", "page_url", "score", "similarity", "link_boost"]
    assert df.count() > 0


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "index_postings"],
                         capture_output=True, text=True, env=env, timeout=900, check=True).stdout
    lines = [x for x in out.splitlines() if x.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(rec)
    assert rec["unit"] == "sec" and rec["sf"] == 0.001 and rec["queries"]["index_postings"] > 0
