import os

import __spark_entry__ as entry_module


def test_entry_and_registry(spark, data_dir):
    out = entry_module.entry(spark)
    assert {"key", "wape"} <= set(out.columns) and out.count() > 0
    names, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 70


def test_queries_match_their_sql(spark, data_dir):
    import duckdb

    names, sql = entry_module.queries(), entry_module.oracle_sql()
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data_dir}/{f}'")

    def canon(rows, order):
        def one(v):
            return "null" if v is None or v != v else f"{v:.5g}" if isinstance(v, float) else str(v)

        return sorted(tuple(one(r[i]) for i in order) for r in rows)

    for name in ("rule_audit", "clean", "dst_collapse", "forward_fill", "feature_table", "pruned_features", "grouped_quantile_forecast", "interval_status", "rank_buckets", "next_hour", "champion", "drifted_files", "clean_reports", "month_of", "holiday_orders", "append_and_overwrite", "delete_and_drop", "hourly_feed", "carried_window", "reconciled", "stored_results", "next_hour_job", "poisson_key_totals", "poisson_score_equations", "export", "asof_orders", "permutation_losses", "run_log", "dimension"):
        df = names[name](spark, data_dir)
        cur = con.execute(sql[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns), name
        want = canon(cur.fetchall(), [cols.index(c) for c in sorted(cols)])
        got = canon([tuple(r) for r in df.collect()], [df.columns.index(c) for c in sorted(cols)])
        assert got == want, name


def test_entry_without_the_training_data_part(tmp_path):
    """Without the llm modules, even with what is left of their folder, the other queries are there."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    shutil.copytree(os.path.join(root, "panelcast"), tmp_path / "panelcast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    (tmp_path / "panelcast" / "llm" / "__pycache__").mkdir(parents=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), 'panel_counts' in e.queries(), len(e.oracle_sql()) > 60)"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["0", "True", "True"], done.stderr
