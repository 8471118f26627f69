"""Vector codes by Elkan's accelerated Lloyd iteration.

Vectors become integers and are cut into parts; every part position has a codebook of its
own. The first round finds each part's nearest entry and keeps, for each part, an upper
bound of the distance to its entry and a lower bound of the distance to every entry. These
bounds are written beside the codes. When entries have moved, upper bounds grow and lower
bounds shrink by as much as their entries moved; an entry is compared only if its
lower bound, and half its distance from the part's entry, don't exceed the upper bound.
An entry as near as the nearest is never passed over, since bounds prune only where
they are strictly apart; what is compared is compared in integers.

Lower bounds are kept as bytes, rounded down in units of 1/255 of a part's largest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise, new_path, sized_join

_LARGEST = 1 << 24  # integer components lie within this, so that squared distances of 2**14 of them fit into 64 bits
_UP, _DOWN = 1 + 1e-6, 1 - 1e-6  # bounds are kept in single precision; this is more than its rounding


def cuts(size: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and the last ends; where ``parts`` doesn't divide ``size`` the first are longer by one."""
    whole, more = divmod(size, parts)
    return [0, *np.cumsum([whole + (i < more) for i in range(parts)]).tolist()]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(-1)


def assign(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Give each row of ``x`` its nearest entry of ``book``; ``code``, ``upper`` and ``lower`` are changed in place.

    The bounds must hold for ``book``; infinite upper and zero lower ones always do. Returns
    the exact squared distances.
    """
    half = np.sqrt(squared(book[:, None], book[None]).astype(float)) / 2 * _DOWN
    np.fill_diagonal(half, np.inf)
    near = half.min(1)
    known = np.zeros(len(x), bool)
    best = np.zeros(len(x), np.int64)
    rows = np.flatnonzero(near[code] <= upper)  # no other entry can be as near to the rest

    def tighten(at: np.ndarray) -> None:
        best[at] = squared(x[at], book[code[at]])
        exact = np.sqrt(best[at].astype(float))
        upper[at], lower[at, code[at]], known[at] = exact * _UP, exact * _DOWN, True

    for c in range(len(book)):
        asked = rows[(code[rows] != c) & (lower[rows, c] <= upper[rows]) & (half[code[rows], c] <= upper[rows])]
        loose = asked[~known[asked]]
        if loose.size:
            tighten(loose)
            asked = asked[(lower[asked, c] <= upper[asked]) & (half[code[asked], c] <= upper[asked])]
        if not asked.size:
            continue
        found = squared(x[asked], book[c])
        exact = np.sqrt(found.astype(float))
        lower[asked, c] = exact * _DOWN
        better = (found < best[asked]) | ((found == best[asked]) & (c < code[asked]))
        won = asked[better]
        code[won], best[won], upper[won] = c, found[better], exact[better] * _UP
    tighten(np.flatnonzero(~known))
    return best


def _integers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.int64)


def _bytes(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    """The values of a column of equally long binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    width = flat[0].nbytes
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer((np.arange(len(flat) + 1) * width).astype(np.int32)), pa.py_buffer(flat)])


def _round(state: DataFrame, at: list[int], books: list[np.ndarray], moved: list[np.ndarray] | None, batch_rows: int = 4096) -> DataFrame:
    """``state`` with the codes, bounds and errors of ``books``; ``moved`` is how far each entry moved since its bounds were written."""
    parts, entries = len(at) - 1, len(books[0])
    schema = "row struct<vec_id:bigint,label:{}>, x array<int>, code binary, upper binary, lower binary, unit binary, error long".format(state.schema["row"].dataType["label"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), batch_rows):
                batch = whole.slice(start, batch_rows)
                x, n = _integers(batch.column("x")), len(batch)
                if moved is None:
                    code, upper, lower = np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, entries), np.float32)
                else:
                    code = _bytes(batch.column("code"), np.uint8, (parts,)).copy()
                    unit = _bytes(batch.column("unit"), np.float32, (parts, 1))
                    lower = _bytes(batch.column("lower"), np.uint8, (parts, entries)) * (unit * np.float32(_DOWN))
                    upper = _bytes(batch.column("upper"), np.float32, (parts,)).copy()
                    for p in range(parts):
                        upper[:, p] = (upper[:, p] + moved[p][code[:, p]]) * _UP
                        lower[:, p] = np.maximum((lower[:, p] - moved[p]) * _DOWN, 0)
                error = np.zeros(n, np.int64)
                for p in range(parts):
                    now, bound, below = code[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p].copy()
                    error += assign(x[:, at[p] : at[p + 1]], books[p], now, bound, below)
                    code[:, p], upper[:, p], lower[:, p] = now, bound, below
                unit = np.maximum(lower.max(2), np.float32(1e-30)) / 255
                levels = np.minimum(np.floor(lower / unit[:, :, None]), 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("x"), _binary(code), _binary(upper), _binary(levels), _binary(unit), pa.array(error)], names=["row", "x", "code", "upper", "lower", "unit", "error"])

    return state.mapInArrow(run, schema)


def _means(state: DataFrame, at: list[int], books: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The floored means of each entry's parts, and how far the entries move; entries without parts stay.

    A task sums what it reads and sends a row an entry at most.
    """
    parts, entries = len(at) - 1, len(books[0])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = [np.zeros((entries, at[p + 1] - at[p]), np.int64) for p in range(parts)]
        for batch in batches:
            x, code = _integers(batch.column("x")), _bytes(batch.column("code"), np.uint8, (parts,))
            for p in range(parts):
                counts[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], x[:, at[p] : at[p + 1]])
        used = [(p, e) for p, e in zip(*(i.tolist() for i in np.nonzero(counts)), strict=True)]
        rows = [(p, e, j, int(v), int(counts[p, e])) for p, e in used for j, v in enumerate(sums[p][e])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())], names=["part", "entry", "place", "total", "n"])

    found = state.select("x", "code").mapInArrow(local, "part int, entry int, place int, total long, n long")
    new, wide = [b.copy() for b in books], "decimal(38,0)"
    for r in found.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast(wide)).alias("total"), F.sum(F.col("n").cast(wide)).alias("n")).collect():
        new[r.part][r.entry, r.place] = int(r.total) // int(r.n)
    return new, [np.sqrt(squared(a, b).astype(float)) * _UP for a, b in zip(books, new, strict=True)]


def vector_codes(vectors: DataFrame, scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector without null or non-finite components.

    A component x becomes floor(``scale`` * x), held within 2**24 either way; the vector is
    cut into ``parts`` consecutive parts (if these can't be equal, the first are longer by
    one). A part position's codebook begins as that part of the ``entries`` smallest ids (256 at
    most; fewer rows make a smaller book). Each of ``rounds`` rounds gives every part its
    nearest entry, ties to the lower index, and replaces an entry by the floored mean of
    its parts; entries without parts stay. Then parts are assigned again. ``code`` has two
    hexadecimal digits a part, ``error`` is the sum of the squared distances, ``label_error``
    that of all rows of equal labels, null ones together.

    A null id comes after all others; among equal ids the smaller integers come first.
    The vector that comes first sets the length: empty vectors and those of another length
    take no part. Repeated rows count as often as they stand. No rows give no rows; other
    columns are ignored.

    Between rounds codes and bounds lie in the shared folder, about parts * (entries + 9)
    bytes a vector beside its integers; the state before is deleted when the next is
    written. The driver sees the codebooks alone.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(_LARGEST))), F.lit(-float(_LARGEST)))).cast("int"))
    finite = F.forall(F.col(vector_col), lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = vectors.filter(F.col(vector_col).isNotNull() & finite & (F.size(vector_col) > 0)).select(F.struct(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label")).alias("row"), x.alias("x"))
    order = [F.col("row.vec_id").asc_nulls_last(), F.col("x")]
    first = rows.orderBy(*order).select("x").first()
    if first is None:
        return rows.select("row.vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    size = len(first.x)
    rows, at = rows.filter(F.size("x") == size), cuts(size, parts)
    start = np.array([r.x for r in rows.orderBy(*order).select("x").limit(entries).collect()], np.int64)
    books, moved = [start[:, at[p] : at[p + 1]] for p in range(parts)], None

    state, path = rows, None
    for _ in range(rounds):
        before, path = path, new_path(spark)
        state = materialise(_round(state, at, books, moved), path)
        if before:
            forget(spark, before)
        books, moved = _means(state, at, books)
    out = materialise(_round(state, at, books, moved).select("row.*", F.lower(F.hex("code")).alias("code"), "error"))
    if path:
        forget(spark, path)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    totals = out.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return sized_join(out, totals, out["label"].eqNullSafe(totals["same"]), "inner").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
