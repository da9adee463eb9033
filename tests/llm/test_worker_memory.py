"""What a worker keeps from one task, and so from one step of the pipeline, to the next."""

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import common, fingerprints, ngram_join


def _anonymous_mb() -> float:
    return sum(int(x.split()[1]) for x in Path("/proc/self/smaps_rollup").read_text().splitlines() if x.startswith("Pss_Anon:")) / 1024


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="needs /proc and glibc")
def test_free_memory_goes_back_at_a_tasks_end():
    held = []

    def run():
        held.extend(bytearray(b"x" * 100_000) for _ in range(2000))
        pinned = held[-1]
        held.clear()
        held.append(pinned)  # the last block keeps malloc from shrinking by itself
        held.append(_anonymous_mb())
        yield pa.RecordBatch.from_pydict({"x": [1]})

    assert sum(b.num_rows for b in common.trimmed(run())) == 1
    assert _anonymous_mb() < held[-1] - 100


def test_powers_of_long_buffers_are_not_kept():
    data = np.frombuffer(np.random.Generator(np.random.PCG64(1)).bytes(500_000) * 5, np.uint8)
    sums = fingerprints.prefix_sums(data)
    at = np.arange(0, 500_000, 9973)
    first = fingerprints.prints(sums, at, 400)
    assert all((fingerprints.prints(sums, at + k * 500_000, 400) == first).all() for k in range(1, 4))
    assert (fingerprints.prints(fingerprints.prefix_sums(data[:600_000]), at, 400) == first).all()
    assert all(len(p) <= 1 << 20 for p in fingerprints._powers)


def test_names_of_words_are_not_kept():
    none = pa.array([1], pa.int64())
    batch = pa.RecordBatch.from_arrays([none, none, pa.array([b""]), pa.array([b"one two three four five six"])], names=["doc_id", "dk", "th", "bytes"])
    assert [b.num_rows for b in ngram_join._sets(iter([batch]), ngram_join.WORDS, ngram_join.LONG)] == [1]
    assert not ngram_join._names
