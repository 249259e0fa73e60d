import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from compare import SF, same
from gaugeframe.llm import queries

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))


def test_the_rest_stands_alone(tmp_path):
    """Without the subpackage and the pipeline the other queries still load."""
    shutil.copytree(ROOT / "gaugeframe", tmp_path / "gaugeframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'perf_by_model' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_columns_of_the_contracts(spark):
    want = {
        "op1_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
        "op2_url_filter": {"host": "string", "path": "string", "rule": "string", "verdict": "string"},
        "op3_quality": {"held_out": "boolean", "score": "double", "predicted": "int"},
        "op4_toxicity": {"held_out": "boolean", "score": "double", "predicted": "int"},
        "op8_embedding_dedup": {"n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
        "op9_jaccard_join": {"n_shingles": "bigint", "component_id": "bigint"},
        "op11_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
        "op12_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
        "op13_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    }
    for name, cols in want.items():
        kinds = dict(queries.QUERIES[name](spark, SF).dtypes)
        assert {c: kinds[c] for c in cols} == cols


@pytest.mark.parametrize("master, allowed", [("local[4]", True), ("local", True), ("local-cluster[3,2,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_no_temporary_folder_on_a_cluster(master, allowed):
    from types import SimpleNamespace

    from gaugeframe.llm.common import shared_dir

    conf = {}
    fake = SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))
    if allowed:
        assert shared_dir(fake).startswith("file://")
    else:
        with pytest.raises(ValueError):
            shared_dir(fake)
    conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert shared_dir(fake) == "hdfs://x/y"


def test_a_name_that_clashes_with_nothing():
    from gaugeframe.llm.common import free_name

    assert free_name("removed", ["doc_id", "Removed", "_removed"]) == "__removed" and free_name("x", []) == "x"
