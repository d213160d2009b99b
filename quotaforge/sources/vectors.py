"""Numpy vector files (.npy matrices with sidecar ids, .npz archives) as a Spark data source, and a sink for them.

`spark.read.format("numpy_vectors").load(path)` after `register(spark)`, or `load_vectors`,
which also joins the ids. Any file system that pyarrow opens will do (local, HDFS, object
stores); a path is a file or a folder of `.npy` files.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quotaforge.operators.order import global_rank

SCHEMA = "file string, position long, id string, embedding array<float>"
#: Bytes of a partition and of a batch inside it; rows of a written file, and bytes after which it is closed earlier.
PARTITION, BATCH, FILE_ROWS, FILE_BYTES = 64 << 20, 4 << 20, 65_536, 64 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _found(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The file itself, or the .npy files of a folder by name; names that begin with . or _ are left out."""
    system, place = _opened(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return system, [place]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    each = system.get_file_info(fs.FileSelector(place))
    return system, sorted(f.path for f in each if f.is_file and f.path.endswith(".npy") and not posixpath.basename(f.path).startswith((".", "_")))


@dataclass
class _Rows(InputPartition):
    """Rows [first, last) of a matrix, or members [first, last) of an archive."""

    path: str
    first: int
    last: int


def _header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether columns come first, and number type; the file stands at the first number afterwards."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_columns, kind = read(f)
    if kind.hasobject or kind.kind not in "fiub":
        raise ValueError(f"vectors of numbers only, not {kind}")
    return shape, by_columns, kind


def _members(f) -> list[str]:
    with zipfile.ZipFile(f) as z:
        return [n for n in z.namelist() if n.endswith(".npy")]


class _Reader(DataSourceReader):
    def __init__(self, options):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path = options["path"]
        self.bytes = int(options.get("partitionbytes", PARTITION))

    def partitions(self):
        """Only headers and the archive's list of names are read here."""
        system, paths = _found(self.path)
        out = []
        for path in paths:
            with system.open_input_file(path) as f:
                if path.endswith(".npz"):
                    n, step = len(_members(f)), max(1, int(self.bytes * len(_members(f)) / max(1, f.size())))
                else:
                    shape, _, kind = _header(f)
                    if len(shape) != 2:
                        raise ValueError(f"{path}: a matrix of rows is needed, not the shape {shape}")
                    if f.size() - f.tell() < shape[0] * shape[1] * kind.itemsize:
                        raise ValueError(f"{path}: shorter than its header says")
                    n, step = shape[0], max(1, self.bytes // max(1, shape[1] * kind.itemsize))
            out += [_Rows(path, a, min(n, a + step)) for a in range(0, n, step)]
        return out or [_Rows("", 0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _opened(self.path)
        with system.open_input_file(partition.path) as f:
            yield from (_archived if partition.path.endswith(".npz") else _matrix)(f, partition)


def _batch(path: str, positions, ids, values: np.ndarray, sizes) -> pa.RecordBatch:
    vectors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.float32).ravel()))
    name = posixpath.basename(path)
    return pa.RecordBatch.from_arrays([pa.array([name] * len(sizes)), pa.array(positions, pa.int64()), pa.array(ids, pa.string()), vectors], ["file", "position", "id", "embedding"])


def _matrix(f, part: _Rows) -> Iterator[pa.RecordBatch]:
    """A file by rows is read in one range; of one by columns, each batch reads its range of every column."""
    (rows, size), by_columns, kind = _header(f)
    start, step = f.tell(), max(1, BATCH // max(1, size * kind.itemsize))
    for a in range(part.first, part.last, step):
        n = min(part.last, a + step) - a
        if by_columns:
            columns = []
            for c in range(size):
                f.seek(start + (c * rows + a) * kind.itemsize)
                columns.append(np.frombuffer(f.read(n * kind.itemsize), kind))
            values = np.stack(columns, 1) if columns else np.zeros((n, 0))
        else:
            f.seek(start + a * size * kind.itemsize)
            values = np.frombuffer(f.read(n * size * kind.itemsize), kind).reshape(n, size)
        yield _batch(part.path, range(a, a + n), [None] * n, values, [size] * n)


def _archived(f, part: _Rows) -> Iterator[pa.RecordBatch]:
    names = _members(f)[part.first : part.last]
    with zipfile.ZipFile(f) as z:
        for k, name in enumerate(names):
            v = np.lib.format.read_array(io.BytesIO(z.read(name)), allow_pickle=False)
            if v.ndim != 1 or v.dtype.kind not in "fiub":
                raise ValueError(f"{part.path}: {name} is no vector of numbers")
            yield _batch(part.path, [part.first + k], [name.removesuffix(".npy")], v, [len(v)])


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    """Tasks write below `_pending`; the commit moves what the tasks that count have written, so a lost or repeated task leaves nothing."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.at = {c: k for k, c in enumerate(("id", "embedding"))}

    def write(self, iterator) -> _Written:
        system, place = _opened(self.path)
        system.create_dir(f"{place}/_pending", recursive=True)
        names, ids, vectors, held = [], [], [], 0

        def close():
            if len({len(v) for v in vectors}) > 1:
                raise ValueError("vectors of one file must have one size")
            name = f"part-{uuid.uuid4().hex}"
            with system.open_output_stream(f"{place}/_pending/{name}.npy") as f:
                buffer = io.BytesIO()
                np.save(buffer, np.array(vectors, np.float32), allow_pickle=False)
                f.write(buffer.getvalue())
            with system.open_output_stream(f"{place}/_pending/{name}.ids.jsonl") as f:
                f.write("".join(json.dumps({"id": i}) + "\n" for i in ids).encode())
            names.append(name)

        for row in iterator:
            if not row["id"] or row["embedding"] is None or any(x is None for x in row["embedding"]):
                raise ValueError("a vector without an id or a number cannot be written")
            ids.append(row["id"])
            vectors.append(row["embedding"])
            held += 4 * len(row["embedding"])
            if len(ids) == FILE_ROWS or held >= FILE_BYTES:
                close()
                ids, vectors, held = [], [], 0
        if ids:
            close()
        return _Written(names)

    def commit(self, messages) -> None:
        system, place = _opened(self.path)
        system.create_dir(place, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(place)) if f.is_file and f.path.endswith((".npy", ".ids.jsonl"))]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        for path in old:
            system.delete_file(path)
        for name in (n for m in messages if m for n in m.names):
            for end in (".ids.jsonl", ".npy"):
                system.move(f"{place}/_pending/{name}{end}", f"{place}/{name}{end}")
        self._clear(system, place)

    def abort(self, messages) -> None:
        self._clear(*_opened(self.path))

    @staticmethod
    def _clear(system, place: str) -> None:
        if system.get_file_info(f"{place}/_pending").type == fs.FileType.Directory:
            system.delete_dir(f"{place}/_pending")


class NumpyVectors(DataSource):
    @classmethod
    def name(cls):
        return "numpy_vectors"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NumpyVectors)


def write_vectors(rows: DataFrame, id_: str, vector: str, path: str, overwrite: bool = False) -> None:
    """A folder of .npy files, each with its .ids.jsonl; a null or empty id, or a vector that is null or holds one, is an error."""
    register(rows.sparkSession)
    named = rows.select(F.col(id_).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("embedding"))
    named.write.format("numpy_vectors").mode("overwrite" if overwrite else "append").save(path)


def _ids_in_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, position, id) of the non-empty ids of JSON Lines, numbered per file from 0."""
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    numbered = raw.withColumn("_seq", F.monotonically_increasing_id())  # rises along a block
    own = F.coalesce(F.get_json_object("value", "$.id"), F.get_json_object("value", "$.sample_id"))
    ranked = global_rank(numbered.withColumn("id", own).filter("id <> ''"), [F.col("file"), F.col("_block"), F.col("_seq")], "_at")
    first = ranked.groupBy("file").agg(F.min("_at").alias("_first"))
    return ranked.join(first, "file").select("file", (F.col("_at") - F.col("_first")).alias("position"), "id")


def _ids_in_object(spark: SparkSession, path: str) -> DataFrame:
    """(position, id) of one JSON value: a list, or an object with the list under ids or embedding_ids; items are ids or objects that hold one."""
    value = F.col("value")
    listed = F.coalesce(*[F.from_json(F.get_json_object(value, p), "array<string>") for p in ("$.ids", "$.embedding_ids")], F.from_json(value, "array<string>"))
    item = F.when(F.ltrim("item").startswith("{"), F.coalesce(F.get_json_object("item", "$.id"), F.get_json_object("item", "$.sample_id"))).otherwise(F.col("item"))
    each = spark.read.text(path, wholetext=True).select(F.posexplode(listed).alias("k", "item")).select("k", item.alias("id")).filter("id <> ''")
    return global_rank(each, [F.col("k")], "_at").select((F.col("_at") - 1).alias("position"), "id")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of a .npy or .npz file, or of a folder of .npy files.

    The ids of `x.npy` stand in the first of `x.ids.jsonl`, `x.ids.json` and
    `embedding_rows.jsonl` beside it that holds as many ids as the matrix has rows (in a folder
    of several: in its own `x.ids.jsonl`); without one, or where an id repeats, it is an error.
    Archives name their vectors. Numbers become floats. Ids and rows meet by file and position, in a join.
    """
    register(spark)
    found = spark.read.format("numpy_vectors").load(path)
    if path.endswith(".npz"):
        return found.select("id", "embedding")
    system, paths = _found(path)
    there = lambda p: system.get_file_info(p).type == fs.FileType.File
    uri = lambda p: path if p == _opened(path)[1] else posixpath.join(posixpath.dirname(path) if path.endswith(".npy") else path, posixpath.basename(p))
    counts = {}
    for p in paths:
        with system.open_input_file(p) as f:
            counts[p] = _header(f)[0][0]
    if not paths:
        return found.select("id", "embedding")
    if len(paths) > 1 or not path.endswith(".npy"):
        sides = {p.removesuffix(".npy") + ".ids.jsonl": p for p in paths}
        if missing := [p for p in sides if not there(p)]:
            raise ValueError(f"no ids: {', '.join(missing[:5])}")
        ids = _ids_in_lines(spark, [uri(p) for p in sides]).withColumn("file", F.regexp_replace("file", r"\.ids\.jsonl$", ".npy"))
        own = {r["file"]: r["n"] for r in ids.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a file
        if bad := [p for p in paths if own.get(posixpath.basename(p), 0) != counts[p]]:
            raise ValueError(f"not as many ids as rows: {', '.join(bad[:5])}")
    else:
        stem, ids = paths[0].removesuffix(".npy"), None
        for side in (f"{stem}.ids.jsonl", f"{stem}.ids.json", posixpath.join(posixpath.dirname(stem), "embedding_rows.jsonl")):
            if there(side):
                given = _ids_in_lines(spark, [uri(side)]).drop("file") if side.endswith("l") else _ids_in_object(spark, uri(side))
                if given.count() == counts[paths[0]]:
                    ids = given.withColumn("file", F.lit(posixpath.basename(paths[0])))
                    break
        if ids is None:
            raise ValueError(f"{path}: no file of {counts[paths[0]]} ids beside it")
    if twice := ids.groupBy("id").count().filter("count > 1").limit(5).collect():
        raise ValueError(f"ids repeat: {', '.join(r['id'] for r in twice)}")
    return found.drop("id").join(ids, ["file", "position"]).select("id", "embedding")
