"""The registered queries: names agree, and the library imports without its optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_sql_is_only_for_registered_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 10


def test_core_does_not_import_the_subpackage():
    code = "import sys; sys.modules['versionlog.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'kv_snapshot' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
