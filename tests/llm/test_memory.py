"""Workers that stay from stage to stage give back what they have freed."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quadrel.llm import common, tokens


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_freed_memory_goes_back():
    def run(batches):
        for _ in batches:
            held = [np.ones(2_000) for _ in range(8_000)]  # 128 MB in pieces that the C library keeps
            last = held[-1]
            del held
            yield last

    before = _resident()
    assert len(list(common.tidy(run, each=True)([1, 2, 3]))) == 3
    assert _resident() - before < 80_000_000


def test_other_stages_forget_the_tokenizer(spark):
    """What packing has learnt must not stand beside the next stages' memory; in a worker too, where functions come pickled."""
    tokens.pieces_of(tokens.default_path())(["some words"])
    list(common.tidy(iter, keeps="pieces")([1]))
    assert tokens._pieces
    list(common.tidy(iter)([1]))
    assert not tokens._pieces

    def learn(batches):
        for b in batches:
            tokens.pieces_of(tokens.default_path())(["some words"])
            again = common.tidy(iter, keeps="pieces")
            kept = [len(tokens._pieces) for _ in again([1])] + [len(tokens._pieces) for _ in common.tidy(iter)([1])]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], ["id"])

    assert [r[0] for r in spark.range(1).mapInArrow(learn, "id bigint").collect()] == [1, 0]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_begin_with_a_collected_heap(spark, stage):
    """Each stage has the executors (here this JVM) collect before it reads anything."""

    class Unread:
        def __getattr__(self, name):
            raise LookupError

    def collections():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    before = collections()
    with pytest.raises(Exception):
        stage(spark, Unread(), "/nowhere")
    assert collections() > before
