"""What a Python worker keeps between tasks."""

import pyarrow as pa

from meshvoyage.llm.storage import forget, held, slices


def _batches(rows: int):
    return iter([pa.RecordBatch.from_arrays([pa.array(range(rows))], ["x"])])


def test_slices_keep_rows_order_and_the_owner_s_store():
    held("one")["cache"], held("two")["cache"] = 1, 2
    cut = list(slices(_batches(10), 4, "one"))
    assert [b.num_rows for b in cut] == [4, 4, 2]
    assert [x for b in cut for x in b.column(0).to_pylist()] == list(range(10))
    assert held("one") == {"cache": 1} and held("two") == {}


def test_a_task_of_another_operator_clears_the_store():
    held("one")["cache"] = 1
    assert list(slices(_batches(0))) == [] and held("one") == {}
    held("one")["cache"] = 1
    forget()
    assert held("one") == {}
