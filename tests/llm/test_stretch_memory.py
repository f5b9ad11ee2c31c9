"""A task that numbers words does not hold hashes, many times their size, for a whole stretch of texts."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from cardloom.llm import bytetext, collocations


class Made(Exception):
    pass


def run_of(monkeypatch):
    """The function that tasks run over the batches of ``write_shards``."""

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            raise Made(run)

    monkeypatch.setattr(collocations, "F", SimpleNamespace(coalesce=lambda *a: SimpleNamespace(alias=str), lit=str))
    monkeypatch.setattr(collocations, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    with pytest.raises(Made) as made:
        collocations.write_shards(Docs(), "", 4)
    return made.value.args[0]


def test_a_stretch_takes_few_times_its_size(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"word{i}" for i in rng.integers(0, 3000, 100)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 2000), pa.array(texts)], names=["lang", "text"])
    run, size = run_of(monkeypatch), sum(map(len, texts))
    bytetext._powers.clear()
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in run(iter([batch])))
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert rows == 1 and most < 30 * size and kept < 5 * size, (most / size, kept / size)


def test_words_of_a_stretch_do_not_depend_on_how_many_texts_are_hashed_at_a_time(monkeypatch):
    rng = np.random.default_rng(6)
    texts = pa.array([None, "", "A.b  c", *("".join(rng.choice(list("aB .,\n\té"), 40)) for _ in range(200)), ""])
    codes, seeds = rng.integers(0, 2, len(texts)).astype(np.int32), [np.array([3, 9], np.uint64), np.array([5, 8], np.uint64)]
    whole = collocations._stretch(texts, codes, seeds)
    monkeypatch.setattr(collocations, "pieces", lambda column: bytetext.pieces(column, 50))
    few = collocations._stretch(texts, codes, seeds)
    assert whole[0] == few[0] and len(whole[1]) > 500
    for x, y in zip([*whole[1:5], *whole[5]], [*few[1:5], *few[5]], strict=True):
        assert np.array_equal(x, y)
