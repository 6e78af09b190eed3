"""The registry, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sql.keys() <= queries.keys()
    assert len(queries) > 45


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "x", "y", "z", "nx", "ny", "nz"]


def found_from(copy):
    """The environment with a copy of the repository on the path instead of this one, and all else that was on it."""
    before = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT]
    return os.environ | {"PYTHONPATH": os.pathsep.join([str(copy), *before])}


def test_without_the_subpackage(tmp_path):
    """The rest imports, and its tests pass, where both folders and the pipeline are gone. POINTLOOM_REST=all runs all of them."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import pointloom, __spark_entry__ as e; assert e.ROOT.startswith(%r); q = e.queries(); assert 'knn_grid' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql().keys() <= q.keys()" % str(copy)
    env = found_from(copy)
    subprocess.run([sys.executable, "-B", "-W", "error::UserWarning", "-c", code], cwd=copy, env=env, check=True)
    pytest_ = [sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider"]
    some = ["tests/test_files.py", "tests/test_streaming.py", "tests/test_oracles.py", "-k", "xyz or stream or normalise or grid_cells or ply_roundtrip"]
    rest = ["tests", "--deselect", "tests/test_entry.py"] if os.environ.get("POINTLOOM_REST") == "all" else some
    subprocess.run([*pytest_, *rest], cwd=copy, env=env, check=True)
    subprocess.run([*pytest_, "--collect-only", "tests"], cwd=copy, env=env, check=True)


def test_a_missing_dependency_does_not_pass_in_silence(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (copy / "zstandard.py").write_text("raise ImportError('none here', name='zstandard')")
    code = "import warnings\nwith warnings.catch_warnings(record=True) as w:\n    warnings.simplefilter('always')\n    import __spark_entry__ as e\nassert any('left out' in str(x.message) for x in w)\nassert 'knn_grid' in e.queries() and 'op4_warc' not in e.queries()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=found_from(copy), check=True)
