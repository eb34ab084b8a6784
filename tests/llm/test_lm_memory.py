"""Adding up a bucket of messages takes little more memory than the messages themselves."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tripmill.llm import lm_scoring


def test_add_up_is_exact_and_small():
    rng = np.random.default_rng(3)
    sent, slices, size = [], 20, 20_000
    for s in range(slices):
        keys = np.unique(rng.integers(0, 1 << 20, size).astype(np.uint64))
        sent.append((s, keys, rng.integers(0, 5, len(keys)), rng.integers(5, 9, len(keys))))
    planes = lm_scoring.planes
    table = pa.table({"bucket": pa.array([7] * slices, pa.int32()), "slice": pa.array([s if s else -1 for s in range(slices)], pa.int32()), **{c: pa.array([planes(m[i]) for m in sent], pa.binary()) for i, c in ((1, "keys"), (2, "t"), (3, "b"))}})
    tracemalloc.start()
    got = lm_scoring.add_up(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2.5 * table.nbytes
    every = np.concatenate([m[1] for m in sent])
    keys, where = np.unique(every, return_inverse=True)
    for c, i in (("t", 2), ("b", 3)):
        total = np.bincount(where, np.concatenate([m[i] for m in sent])).astype(np.int64)
        want = {m[0]: total[np.searchsorted(keys, m[1])].tolist() for m in sent[1:]}
        assert {s.as_py(): lm_scoring.unplanes(x.as_py()).view(np.int64).tolist() for s, x in zip(got.column("slice"), got.column(c))} == want
