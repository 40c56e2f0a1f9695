import numpy as np
import pyarrow as pa

from edgeloom.llm.common import BATCH_ROWS, bounded_batches


def test_a_batch_goes_when_its_last_run_has_been_taken():
    n = 20 * BATCH_ROWS + 7
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([None if k % 50 == 3 else "x" * 2000 for k in range(n)]), pa.array([[k] for k in range(n)])], ["a", "b", "c"])
    want, size, before = rows.to_pylist(), rows.nbytes, pa.total_allocated_bytes()
    batches = [rows, rows.slice(0, 5), rows.slice(0, 0), rows.slice(3, BATCH_ROWS)]
    assert [r for part in bounded_batches(iter(batches)) for r in part.to_pylist()] == want + want[:5] + want[3 : 3 + BATCH_ROWS]
    held = iter([rows])
    del rows, batches
    for part in bounded_batches(held):  # noqa: B007
        assert len(part) <= BATCH_ROWS
    assert part.to_pylist() == want[-7:]
    assert pa.total_allocated_bytes() < before - 0.9 * size
