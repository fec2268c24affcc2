"""Every query of the engine that SQL can express against DuckDB on the same tables; the others run."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace import registry
from tests.compare import assert_same, connect


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, folder, con, name):
    assert_same(registry.queries()[name](spark, folder), con, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, folder, name):
    df = registry.queries()[name](spark, folder)
    assert df.schema == registry.queries()[name](spark, folder).schema
    assert df.count() > 0


@pytest.mark.parametrize("texts", [["a", "\n", "ab\n", "\n\n\n", "a\nb", "\u00e9"], ["", None, "abcd", "\n" * 9, "ab\n\ncdefgh\n", "\u00e9\n\u00e9\r\n\u00e9"], []])
def test_lines_of_short_texts_are_sharded(spark, tmp_path, texts):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    assert_same(registry.queries()["blob_lines_sharded"](spark, str(tmp_path)), connect(tmp_path), registry.oracle_sql()["blob_lines_sharded"])


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
