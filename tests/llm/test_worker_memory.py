import os
import re
import sys
import time
from pathlib import Path

import pyarrow as pa
import pytest

from lexaloom.llm import near_join, token_files
from lexaloom.llm.common import scratch_path

STEPS = {
    "token_files": lambda spark, docs: token_files.write(docs, scratch_path(spark, "memory"), token_files.default_tokenizer(), files=8),
    "near_join": lambda spark, docs: near_join.signatures(docs, id_col="doc_id", text_col="text", ngram=5),
}


@pytest.mark.parametrize("step", STEPS)
def test_workers_give_freed_memory_back(spark, step):
    """Python workers outlive their tasks: what an earlier step freed must not stay in their memory."""

    def worker(fill):
        def run(batches):
            for _ in batches:
                if fill:
                    some = [bytes(4000) for _ in range(25_000)]  # 100 MB; the last piece stays, so the rest isn't at the heap's end
                    sys.pinned_by_test = some.pop()
                    del some
                time.sleep(0.5)
                mb = sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024
                yield pa.record_batch({"pid": pa.array([os.getpid()]), "mb": pa.array([mb])})

        return run

    measured = lambda fill: dict(spark.range(0, 8, 1, 8).mapInArrow(worker(fill), "pid long, mb long").collect())
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(64)], "doc_id long, text string").repartition(8)
    STEPS[step](spark, docs)  # what a step loads once doesn't count
    before = measured(True)
    STEPS[step](spark, docs)
    after = measured(False)
    assert max(before[p] - after[p] for p in before.keys() & after.keys()) > 50
