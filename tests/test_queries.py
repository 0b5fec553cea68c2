"""Every query beside its SQL on the smallest tables; those without SQL run."""

from __future__ import annotations

import pytest

from compare import compare
from polyloom.oracle import ORACLES
from polyloom.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, SF, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_sql_only_for_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    """Both folders gone, with the pipeline's file there or not: the other queries load, and so does their SQL."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    home = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(home, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e; from polyloom.queries import QUERIES; q, o = e.queries(), e.oracle_sql(); assert set(q) == set(QUERIES) and set(o) <= set(q) and len(o) > 80"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)


def test_an_error_inside_the_corpus_operators_is_not_hidden(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    home = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(home, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    (copy / "polyloom" / "llm").mkdir()
    (copy / "polyloom" / "llm" / "__init__.py").write_text("")
    (copy / "polyloom" / "llm" / "queries.py").write_text("import no_such_module_at_all")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=copy, capture_output=True, text=True)
    assert done.returncode != 0 and "no_such_module_at_all" in done.stderr


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest as p

    from polyloom.plans.shared import shared_dir

    unset = SimpleNamespace(get=lambda _k, _d=None: None)
    session = lambda master, conf: SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master), conf=conf)
    with p.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077", unset))
    assert shared_dir(session("local[2]", unset)).startswith("file://")
    assert shared_dir(session("yarn", SimpleNamespace(get=lambda _k, _d=None: "hdfs://x/y/"))) == "hdfs://x/y"


def test_plans_stay_in_the_jvm(spark):
    """Queries on text that need no kernel have no Python stage, and read the columns they need only."""
    for name in ("corpus_routing_summary", "split_sentences", "speech_segments", "html_scopes", "wrap_lines", "detect_language"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "n_chars" not in QUERIES["corpus_routing_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
