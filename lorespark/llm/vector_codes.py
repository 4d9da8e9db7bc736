"""Vector code compression: each part of a vector becomes the number of the nearest entry of that part's codebook.

Vectors are kept in blocks, dimension by dimension, in a work table that every round reads. A round is one tree
aggregation over the blocks: each adds the squared distances of its parts to all entries one dimension at a time,
and adds its parts to tensors of sums and counts, which are merged on the way up. Numbers are whole, so the order of
the merges changes nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, and tensors that one task of the tree merges at most (about).
BLOCK, FAN_IN = 2048, 32


def usable(vectors: DataFrame, id_: str, vector: str, label: str) -> DataFrame:
    """(id, label, vector) of the rows whose vector has a value in every place."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    return rows.where(F.col("vector").isNotNull() & fine)


def one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def in_columns(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ids, labels, n, dim, most, data): blocks of vectors of one length, a dimension after the other; most bounds the numbers in it."""
    label, item = rows.schema["label"].dataType, rows.schema["vector"].dataType.elementType
    kind = "<f4" if isinstance(item, T.FloatType) else "<f8"
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("n", T.IntegerType()), T.StructField("dim", T.IntegerType()),
        T.StructField("most", T.DoubleType()), T.StructField("data", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                same = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                for at in range(0, same.num_rows, block):
                    own = same.slice(at, block)
                    data = own.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(own.num_rows, dim)
                    most = float(np.abs(data).max(initial=0)) * SCALE + 1
                    yield pa.record_batch([
                        one_list(own.column(0)), one_list(own.column(1)), pa.array([own.num_rows], pa.int32()), pa.array([dim], pa.int32()), pa.array([most]), pa.array([data.T.tobytes()]),
                    ], names=schema.names)

    return rows.select("id", "label", F.col("vector").cast(T.ArrayType(T.FloatType() if kind == "<f4" else T.DoubleType()))).mapInArrow(run, schema)


def whole(data: np.ndarray, kind: type) -> np.ndarray:
    """floor(SCALE x) as whole numbers; object arrays hold those of any size."""
    if kind is np.int64:
        return np.floor(data.astype(np.float64) * SCALE).astype(np.int64)
    big = 2.0**60
    return np.array([int(x) * SCALE if abs(x) >= big else math.floor(x * SCALE) for x in data.astype(np.float64).ravel().tolist()], object).reshape(data.shape)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each vector of part (dimension, vector) in book (entry, dimension), the first of equals, and the squared distance."""
    far = np.zeros((part.shape[1], len(book)), part.dtype)
    for values, entries in zip(part, book.T):
        step = values[:, None] - entries
        far += step * step
    code = far.argmin(axis=1)
    return code, far[np.arange(len(code)), code]


def learned(blocks: DataFrame, books: np.ndarray, item: str, partitions: int) -> np.ndarray:
    """books (part, entry, dimension) after one round."""
    parts, entries, width = books.shape
    kind = np.int64 if books.dtype == np.int64 else object
    sent = blocks.sparkSession.sparkContext.broadcast(books)

    def add(found, row):
        if found is None:
            found = np.zeros(books_shape, kind), np.zeros((parts, entries), np.int64)
        sums, counts = found
        x = whole(np.frombuffer(row[0], item).reshape(parts * width, row[1]), kind)
        for p in range(parts):
            own = x[p * width : (p + 1) * width]
            code, _ = nearest(own, sent.value[p])
            np.add.at(sums[p], code, own.T)
            np.add.at(counts[p], code, 1)
        return found

    def merge(a, b):
        if a is None or b is None:
            return a if b is None else b
        return a[0] + b[0], a[1] + b[1]

    books_shape = books.shape
    depth = max(2, math.ceil(math.log(max(2, partitions), FAN_IN)))
    sums, counts = blocks.select("data", "n").rdd.treeAggregate(None, add, merge, depth)
    sent.unpersist()
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)


def compress(
    vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of each usable vector, and the codebooks (part, entry, dimension) in units of 1 / SCALE.

    code has two hex digits for each part, error is the squared distance to what the code stands for, in whole units. Books start as the
    parts of the rows with the smallest ids (null ids last, equal ones by vector); fewer rows make smaller books.
    Rows whose vector is null or holds a null, NaN or infinity are dropped. Repeated ids are rows of their own. Numbers
    of any size are exact, but an error beyond a long fails. Vectors must have one length, which parts divides: others are
    a ValueError. Without usable rows there are none, and no entries. Of other columns none is carried.
    """
    if entries > 256:
        raise ValueError("two hex digits number 256 entries at most")
    rows = usable(vectors, id_, vector, label)
    blocks = materialize(in_columns(rows), "vectors")
    has = blocks.agg(F.min("dim").alias("least"), F.max("dim").alias("dim"), F.max("most").alias("most"), F.sum("n").alias("n")).first()
    if has["n"] and (has["least"] != has["dim"] or has["dim"] % parts):
        raise ValueError(f"vectors must have one length that {parts} divides, not {has['least']} to {has['dim']}")
    dim, n, most = has["dim"] or 0, has["n"] or 0, has["most"] or 0
    width = dim // parts
    item = "<f4" if isinstance(rows.schema["vector"].dataType.elementType, T.FloatType) else "<f8"
    kind = np.int64 if n * most < 2**62 and width * (2 * most) ** 2 < 2**62 else object
    first = rows.orderBy(F.asc_nulls_last("id"), "vector").select("vector").limit(entries).collect()
    books = whole(np.array([r[0] for r in first], item).reshape(len(first), dim), kind).reshape(len(first), parts, width).transpose(1, 0, 2)
    partitions = blocks.rdd.getNumPartitions()
    for _ in range(rounds if n else 0):
        books = learned(blocks, books, item, partitions)
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (size, data) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                x = whole(np.frombuffer(data.as_buffer(), item).reshape(dim, size), kind)
                codes, error = np.empty((size, parts), np.uint8), np.zeros(size, kind)
                for p in range(parts):
                    codes[:, p], far = nearest(x[p * width : (p + 1) * width], sent.value[p])
                    error += far
                text = codes.tobytes().hex()
                yield pa.record_batch([
                    batch.column(0)[i].values, batch.column(1)[i].values, pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string()), pa.array(error.tolist(), pa.int64()),
                ], names=["id", "label", "code", "error"])

    schema = T.StructType([T.StructField("id", T.LongType()), rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return blocks.select("ids", "labels", "n", "data").mapInArrow(run, schema), books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): label_error sums up the errors of rows with an equal label, or of those without one."""
    coded = materialize(coded, "codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    rows = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def round_sql(before: int) -> str:
    """The assignment to the books of number before, and the books that it makes."""
    return f"""
near{before} AS ({nearest_sql(f"b{before}")}),
sums{before} AS (
  SELECT n.p, n.e, j, sum(parts.v[j]) AS s, count(*) AS c FROM near{before} n JOIN parts ON parts.r = n.r AND parts.p = n.p, generate_series(1, len(parts.v)) g(j) GROUP BY ALL),
means{before} AS (SELECT p, e, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY j) AS v FROM sums{before} GROUP BY p, e),
b{before + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{before} b LEFT JOIN means{before} m ON m.p = b.p AND m.e = b.e),"""


def nearest_sql(book: str) -> str:
    return f"""
  SELECT r, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (
    SELECT x.r, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::HUGEINT AS d FROM parts x JOIN {book} b ON b.p = x.p)
  GROUP BY r, p"""


#: The same as compress and with_label_errors with their default parameters.
ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, q[p * (len(q) // {PARTS}) + 1 : (p + 1) * (len(q) // {PARTS})] AS v FROM kept, range({PARTS}) t(p)),
b0 AS (SELECT p, r - 1 AS e, v FROM parts WHERE r <= {ENTRIES}),
{"".join(round_sql(k) for k in range(ROUNDS))}
last AS ({nearest_sql(f"b{ROUNDS}")}),
books AS (SELECT sha256(string_agg(v[j]::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM b{ROUNDS}, generate_series(1, len(v)) g(j)),
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (r), books
"""
