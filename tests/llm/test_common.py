from pathlib import Path

import pyarrow as pa
import pytest
from keelson.llm import common


def held_mb() -> float:
    lines = Path("/proc/self/smaps_rollup").read_text().splitlines()
    return sum(int(x.split()[1]) for x in lines if x.startswith("Pss_Anon:")) / 1024


class Frame:
    """Takes the place of a DataFrame: its ``mapInArrow`` gives the function itself."""

    class sparkSession:
        class conf:
            set = staticmethod(lambda key, value: None)

    @staticmethod
    def mapInArrow(fn, schema):
        return fn


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from /proc")
def test_a_task_gives_its_memory_back():
    """Workers live on between tasks and stages; what a task has freed must not stay with them."""
    last = []

    def run(batches):
        for b in batches:
            many = [b"x" * 1000 + bytes([i % 256]) for i in range(200_000)]
            last.append(many[-1])                            # the end of the heap stays in use
            del many
            yield b

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
    before = held_mb()
    assert [b.num_rows for b in common.map_batches(Frame, run, "a bigint")(iter([batch] * 2))] == [1, 1]
    assert held_mb() - before < 60                           # of 200


def test_an_error_passes(spark):
    def run(batches):
        for _ in batches:
            raise ValueError("told")
        yield from ()

    with pytest.raises(Exception, match="told"):
        common.map_batches(spark.range(3), run, "id bigint").collect()
