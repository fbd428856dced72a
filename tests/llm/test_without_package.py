"""Executors need no copy of the package: functions and what they read travel with the job."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from ledgerlens.session import local_session, materialise
from ledgerlens.llm import queries
import corpus_pipeline

spark = local_session(4, 4)

def absent(batches):
    import importlib.util
    for b in batches:
        assert importlib.util.find_spec("ledgerlens") is None, "the package is there"
        yield b

assert spark.range(4).mapInArrow(absent, "id bigint").count() == 4
docs = spark.read.parquet({data!r} + "/documents.parquet")
assert corpus_pipeline.quality_stage(spark, docs, {data!r}).count() > 0
for name, query in queries.QUERIES.items():
    assert query(spark, {data!r}).count() > 0, name
print("done")
"""


def test_every_query_runs_where_workers_cannot_import_the_package(data, tmp_path):
    repo = str(Path(__file__).parents[2])
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=repo, data=data))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and done.stdout.strip().endswith("done"), done.stderr[-3000:]
