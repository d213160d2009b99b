"""Numpy vector files: ranges, orders, sidecars, archives, round trips and refusals."""

import json

import numpy as np
import pytest

from quotaforge.sources import vectors


def held(frame):
    return {r["id"]: r["embedding"] for r in frame.collect()}


@pytest.fixture
def matrix():
    return np.random.default_rng(1).normal(size=(257, 6)).astype(np.float32)


@pytest.mark.parametrize("kind", ["<f4", "<f8", ">f4", "<i2"])
@pytest.mark.parametrize("by_columns", [False, True])
def test_ranges_and_orders(spark, tmp_path, matrix, kind, by_columns):
    m = (matrix * 100).astype(kind)
    np.save(tmp_path / "a.npy", np.asfortranarray(m) if by_columns else m)
    vectors.register(spark)
    found = spark.read.format("numpy_vectors").option("partitionBytes", 400).load(str(tmp_path / "a.npy"))
    assert found.rdd.getNumPartitions() >= 8
    rows = sorted(found.collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(257))
    assert np.array_equal(np.array([r["embedding"] for r in rows], np.float32), m.astype(np.float32))


@pytest.mark.parametrize("side", ["a.ids.jsonl", "a.ids.json", "embedding_rows.jsonl"])
def test_sidecars(spark, tmp_path, matrix, side):
    np.save(tmp_path / "a.npy", matrix)
    names = [f"n{k}" for k in range(257)]
    if side.endswith("l"):
        text = "\n".join(json.dumps({"sample_id" if k % 2 else "id": n}) + ("\n" if k % 9 == 0 else "") for k, n in enumerate(names))
    else:
        text = json.dumps({"ids": [{"id": n} if k % 2 else n for k, n in enumerate(names)]}, indent=1)
        (tmp_path / "a.ids.jsonl").write_text('{"id": "too few"}\n')
    (tmp_path / side).write_text(text)
    found = held(vectors.load_vectors(spark, str(tmp_path / "a.npy")))
    assert found == {n: matrix[k].tolist() for k, n in enumerate(names)}


def test_archives(spark, tmp_path, matrix):
    np.savez(tmp_path / "a.npz", **{f"k{k}": v[: 1 + k % 6] for k, v in enumerate(matrix)})
    assert held(vectors.load_vectors(spark, str(tmp_path / "a.npz"))) == {f"k{k}": v[: 1 + k % 6].tolist() for k, v in enumerate(matrix)}


def test_round_trip_and_modes(spark, tmp_path, matrix):
    rows = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(matrix)], "key long, v array<float>, file string").repartition(5)
    path = str(tmp_path / "out")
    vectors.write_vectors(rows, "key", "v", path)
    want = {str(k): v.tolist() for k, v in enumerate(matrix)}
    assert held(vectors.load_vectors(spark, path)) == want
    assert not (tmp_path / "out" / "_pending").exists()
    with pytest.raises(Exception, match="out"):
        vectors.write_vectors(rows, "key", "v", path)
    assert held(vectors.load_vectors(spark, path)) == want
    vectors.write_vectors(rows.filter("key < 3"), "key", "v", path, overwrite=True)
    assert set(held(vectors.load_vectors(spark, "file://" + path))) == {"0", "1", "2"}
    vectors.write_vectors(rows.filter("key < 0"), "key", "v", str(tmp_path / "none"))
    assert held(vectors.load_vectors(spark, str(tmp_path / "none"))) == {}


def test_refusals(spark, tmp_path, matrix):
    path = str(tmp_path / "a.npy")
    np.save(path, matrix)
    with pytest.raises(ValueError, match="no file of 257 ids"):
        vectors.load_vectors(spark, path)
    (tmp_path / "a.ids.jsonl").write_text("\n".join('{"id": "same"}' for _ in matrix))
    with pytest.raises(ValueError, match="repeat"):
        vectors.load_vectors(spark, path)
    np.save(tmp_path / "one.npy", matrix[0])
    np.save(tmp_path / "objects.npy", np.array([["a", None]], object))
    for name, match in (("one", "matrix"), ("objects", "numbers only")):
        with pytest.raises(Exception, match=match):
            spark.read.format("numpy_vectors").load(str(tmp_path / f"{name}.npy")).collect()
    cut = (tmp_path / "a.npy").read_bytes()[:-8]
    (tmp_path / "short.npy").write_bytes(cut)
    with pytest.raises(Exception, match="shorter"):
        spark.read.format("numpy_vectors").load(str(tmp_path / "short.npy")).collect()
    bad = spark.createDataFrame([("a", [1.0, None])], "id string, v array<float>")
    with pytest.raises(Exception, match="cannot be written"):
        vectors.write_vectors(bad, "id", "v", str(tmp_path / "bad"))
