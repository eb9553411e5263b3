"""Vectors travel once for each part they meet, not once for each cell, and the answer stays exact."""

import numpy as np

from loanlens.operators import neighbours
from loanlens.sources import tables


def brute(vectors, k):
    at = {r.vid: np.array(r.features) for r in vectors.collect()}
    ids, rows = np.array(list(at)), np.array(list(at.values()))
    out = {}
    for vid, own in at.items():
        far = np.sqrt(((rows - own) ** 2).sum(1))
        out[vid] = [int(i) for i in ids[np.lexsort((ids, far))] if i != vid][:k]
    return out


def found(near):
    out = {}
    for r in sorted(near.collect(), key=lambda r: (r.vid, r.place)):
        out.setdefault(r.vid, []).append(r.other)
    return out


def vectors_of(spark, x):
    return neighbours.distinct_vectors(spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>"), "features")


def test_a_vector_is_stored_once_however_many_cells_it_visits(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(700, 12))  # in twelve dimensions almost no cell is ruled out
    vectors, stored = vectors_of(spark, x), []

    def stage(df):
        stored.append(tables.stage(df))
        return stored[-1]

    monkeypatch.setattr(neighbours, "stage", stage)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    assert found(neighbours.nearest_vectors(vectors, 4)) == brute(vectors, 4)
    assert max(df.count() for df in stored[:1] + stored[2:]) <= 700


def test_ties_and_a_cell_larger_than_a_part(spark, monkeypatch):
    rng = np.random.default_rng(7)
    lattice = np.unique(rng.integers(0, 3, size=(500, 6)).astype(float), axis=0)  # many equal distances
    far = 1e4 + rng.normal(size=(5, 6))
    vectors = vectors_of(spark, np.vstack([lattice, far]))
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neighbours, "PART_BYTES", 8 * 6 * 7)  # parts of seven vectors, less than a cell
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    monkeypatch.setattr(neighbours, "BATCH", 5)
    assert found(neighbours.nearest_vectors(vectors, 3)) == brute(vectors, 3)


def test_parts_hold_whole_cells_up_to_their_size():
    rng = np.random.default_rng(8)
    sizes = np.array([3, 40, 1, 7, 9, 12, 5, 5])
    first, slices, parts = neighbours._parts(rng.normal(size=(8, 2)), sizes, 15)
    assert slices[1] == 3 and (np.delete(slices, 1) == 1).all()
    assert sorted({p for f, s in zip(first, slices) for p in range(f, f + s)}) == list(range(parts))
    assert all(sizes[first == f].sum() <= 15 for f in first if f != first[1])
