import numpy as np
import pytest
from sparkweft.llm import folder as D


@pytest.fixture
def folder(spark):
    made = D.Folder.fresh(spark, "arrays")
    yield made
    made.delete()


def test_arrays_come_back_with_their_kind(folder):
    for values in (np.arange(5, dtype=np.uint32), np.zeros(0, np.int64), np.array([1.5, -2]), np.arange(3, dtype=np.uint8)):
        folder.write("a", values)
        D._maps.clear()
        got = folder.read("a", np.float32)
        assert got.dtype == values.dtype and (got == values).all() and (folder.piece("a", values.dtype, 1, 2) == values[1:2]).all()
    assert folder.read("none", np.uint16).dtype == np.uint16 and not len(folder.read("none", np.uint16))
    folder.write("none", np.ones(1, np.uint16))
    assert len(folder.read("none", np.uint16)) == 1


def test_maps_are_bounded(folder, monkeypatch):
    monkeypatch.setattr(D, "MAPS", 3)
    for i in range(9):
        folder.write(f"m{i}", np.full(4, i))
        assert folder.read(f"m{i}", np.int64)[0] == i and folder.read("m0", np.int64)[0] == 0 and len(D._maps) <= 3


def test_a_folder_that_cannot_be_mapped(folder, monkeypatch):
    """Arrays are read whole, within a bound, and pieces by themselves."""
    from pyarrow import fs

    for i in range(5):
        folder.write(f"m{i}", np.arange(i, i + 100))
    system, path = folder._open()
    monkeypatch.setattr(D.Folder, "_open", lambda self: (fs.SubTreeFileSystem(path, system), ""))
    monkeypatch.setattr(D, "HELD", 1700)
    D._maps.clear()
    D._read.clear()
    for i in range(5):
        assert folder.piece(f"m{i}", np.int64, 3, 5).tolist() == [i + 3, i + 4]
        assert folder.read(f"m{i}", np.int64).tolist() == list(range(i, i + 100)) and sum(D._read.values()) <= 1700 and len(D._maps) <= 2
    monkeypatch.undo()
