import os
import subprocess
import sys

import pytest

from pairwell.llm import common


def test_clear_deletes_written_tables(spark):
    table = common.written(spark.range(5))
    assert table.count() == 5 and common.cut(spark.range(3)).count() == 3
    folder = common.shared_dir(spark).removeprefix("file:")
    assert os.listdir(folder)
    common.clear(spark)
    assert not os.listdir(folder) and common.written(spark.range(2)).count() == 2


class _Session:
    class sparkContext:  # noqa: N801
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class conf:  # noqa: N801
        get = staticmethod(lambda name, default: default)


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(_Session)


def test_a_lean_function_leaves_no_freed_batches_behind():
    """A worker that has passed large batches on holds little of their memory after."""
    code = r"""
import re
import pyarrow as pa
from pairwell.llm.common import byte_texts, lean

def held():
    return sum(map(int, re.findall(r"RssAnon:\s+(\d+)", open("/proc/self/status").read()))) >> 10

def run(batches):
    for batch in batches:
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "label": pa.array([x + b"!" for x in byte_texts(batch.column("text"))][::40])[:1].take(pa.array([0] * batch.num_rows))})

def made():
    for _ in range(3):
        yield pa.record_batch({"doc_id": pa.array(range(10_000)), "text": pa.array([str(n) * 300 for n in range(10_000)])})

before = held()
assert sum(b.num_rows for b in lean(run)(made())) == 30_000
assert held() - before < 40, (before, held())
"""
    subprocess.run([sys.executable, "-c", code], check=True)
