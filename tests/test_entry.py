"""The driver contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract
from bench import HEADLINES

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_a_stable_schema(spark):
    first, second = contract.entry(spark), contract.entry(spark)
    assert first.schema == second.schema and first.columns == ["word", "n"] and first.count() > 0


def test_names():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())
    assert {n for n in HEADLINES if not n.startswith("op") or n.startswith("op_")} <= set(queries)


def test_imports_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "millrace"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys; sys.modules['millrace.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op1_') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 70 and int(out[1]) >= 70 and out[2] == "False"


def test_workers_find_the_package(spark, folder):
    from millrace import registry

    registry.ship(spark)
    registry.ship(spark)
    assert spark.sparkContext.environment["PYTHONPATH"].split(":").count(str(ROOT)) == 1
    assert contract.queries()["mapper_lifecycle"](spark, folder).first()["n"] == 1500
