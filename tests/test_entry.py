from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_needs_no_session():
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_rest_works_without_the_llm_subpackage():
    code = (
        "import sys; sys.modules['quarry.llm'] = None; import __spark_entry__ as e; "
        "assert e.queries() and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
