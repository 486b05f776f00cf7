"""The rest works in a copy without the folders of the text operators."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
RUN = """
import __spark_entry__ as e
import bench
from tickerlake import session

names = e.queries()
assert set(names) == set(e.oracle_sql()) and not any(n.startswith("op") and n[2].isdigit() for n in names), sorted(names)
assert "pipeline" not in names and set(bench.HEADLINE) <= set(names)
assert names["action_factor"](session.local_session(2, partitions=2), e.SMOKE_DIR).count() > 0
"""


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py", "tickerlake/llm/__pycache__/x.pyc")])
def test_copy_without_folders(tmp_path, left):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py", "*.json"))
    shutil.copytree(ROOT / "tickerlake" / "contracts", copy / "tickerlake" / "contracts", dirs_exist_ok=True)
    for name in left:
        (copy / name).parent.mkdir(parents=True, exist_ok=True)
        (copy / name).write_bytes((ROOT / name).read_bytes() if (ROOT / name).exists() else b"")
    done = subprocess.run([sys.executable, "-c", RUN], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
