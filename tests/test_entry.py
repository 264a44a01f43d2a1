import json
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder):
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return json.loads(run.stdout)


def copy(folder):
    return Path(shutil.copytree(REPO, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache")))


def test_the_rest_stands_without_the_optional_part(tmp_path):
    """With both folders of the optional part deleted, with or without the pipeline, the other queries are there."""
    from lakescribe.plans import queries as plans

    cut = copy(tmp_path / "cut")
    for folder in ("lakescribe/llm", "tests/llm"):
        shutil.rmtree(cut / folder, ignore_errors=True)
    assert names(cut) == [sorted(plans.QUERIES), sorted(plans.SQL)]
    (cut / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(cut) == [sorted(plans.QUERIES), sorted(plans.SQL)]


def test_a_missing_module_takes_only_its_own_queries(tmp_path):
    from lakescribe.plans import queries as plans

    cut = copy(tmp_path / "cut")
    (cut / "corpus_pipeline.py").write_text("import no_such_module\n")
    found = names(cut)[0]
    assert set(plans.QUERIES) <= set(found)
    assert "pipeline" not in found
