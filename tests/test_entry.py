import subprocess
import sys

import __spark_entry__ as E
from cloakroom.plans import registry


def test_every_library_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(E.queries()) and len(registry.queries()) >= 40
    assert set(E.oracle_sql()) <= set(E.queries())


def test_the_library_works_without_the_corpus_subpackage(tmp_path):
    """With the optional folder and the pipeline gone the entry still imports and registers the rest."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(os.path.join(root, "cloakroom"), tmp_path / "cloakroom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    for leftover in (False, True):
        if leftover:  # an empty folder of that name is no package either
            (tmp_path / "cloakroom" / "llm").mkdir()
        code = "import __spark_entry__ as e; print(len(e.queries()), sorted(e.queries()) == sorted(e.oracle_sql()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
        assert out.returncode == 0, out.stderr
        assert out.stdout.split() == [str(len(registry.queries())), "True"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "text"]
    assert df.count() > 0
