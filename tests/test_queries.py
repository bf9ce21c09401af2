"""Every registered query of the diagnostics library against DuckDB."""

import pytest
from oracle import check, duck

from vitalspark import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    check(catalog.QUERIES[name](spark, sf_dir).toPandas(), duck(catalog.ORACLE_SQL[name], sf_dir))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_library_does_not_import_the_training_data_package():
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['vitalspark.llm'] = None; import vitalspark.catalog; assert not any(m.startswith('vitalspark.llm.') "
        "for m in sys.modules)"
    )
    subprocess.run([sys.executable, "-c", code], check=True)
