import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_core_stands_without_the_subpackage(tmp_path):
    """The rest imports, and lists its queries, in a copy where the training-data operators are gone."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    gone = lambda folder, names: [n for n in names if n == "__pycache__" or n == "llm" and os.path.basename(folder) in ("spanforge", "tests")]
    for name in ("spanforge", "tests"):
        shutil.copytree(os.path.join(root, name), tmp_path / name, ignore=gone)
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q); import spanforge.__main__"
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0, run.stderr.decode()
