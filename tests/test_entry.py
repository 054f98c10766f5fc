import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

HERE = Path(entry.__file__).parent


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_corpus_operators_can_be_taken_out(tmp_path):
    """Without their folders, the pipeline's file there or not, the other queries stay."""
    graph = {n for n in entry.queries() if not n.startswith("op") or n.startswith("optional")} - {"pipeline"}
    shutil.copytree(HERE / "weftgraph", tmp_path / "weftgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if (HERE / name).exists():
            shutil.copy(HERE / name, tmp_path)
    code = "import __spark_entry__ as e, bench; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert run() == sorted(graph)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert run() == sorted(graph)
