"""Product codes of vectors: integer parts assigned to small codebooks, in blocks that rule most entries out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_below, name, saved

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of a chunk (which one task holds at a time), vectors of a block, and numbers of one step of the kernel.
CHUNK_VALUES, BLOCK, KERNEL = 1 << 20, 64, 1 << 21
#: Scaled components beyond this are taken as this.
LARGEST = 1 << 62


def hilbert_keys(points, bits: int):
    """The place on a Hilbert curve of each point: ``points`` holds a row per axis, numbers of ``bits`` bits.

    From the highest bit down, each axis inverts the lower bits of the first axis where its bit is set and else exchanges
    them with it; a Gray code over the axes then gives the digits.
    """
    import numpy as np
    x = points.astype(np.int64)
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for k in range(axes):
            turned = (x[k] & top) != 0
            swap = np.where(turned, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[k] ^= swap
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, np.int64((1 << level) - 1), 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(axes):
            key = key << 1 | (x[k] >> level) & 1
    return key


def scaled(vectors, scale: int):
    """The rows of a matrix of doubles as integers ``floor(scale * x)``: 64-bit ones if no squared distance of
    them can pass 2**62, else Python's."""
    import numpy as np
    made = np.floor(vectors * float(scale))
    most = np.abs(made).max(initial=0)
    if max(1, made.shape[1]) * 4.0 * float(most) ** 2 < 2.0 ** 62:
        return made.astype(np.int64)
    return np.array([[max(-LARGEST, min(LARGEST, int(v) if np.isfinite(v) else LARGEST * int(np.sign(v)))) for v in row]
                     for row in made.tolist()], dtype=object).reshape(made.shape)


class Chunk:
    """A chunk's parts as flat blocks in Hilbert order: ``order`` (part x vector), ``values`` (part x block x place x axis), boxes
    and sums (part x block x axis). The last block is filled up with its last vector; ``sizes`` has the true sizes."""

    def __init__(self, order, values, low, high, sums, n: int):
        import numpy as np
        self.order, self.values, self.low, self.high, self.sums, self.n = order, values, low, high, sums, n
        blocks = values.shape[1]
        self.sizes = np.full(blocks, BLOCK)
        self.sizes[-1] = n - BLOCK * (blocks - 1)

    @classmethod
    def of(cls, vectors, parts: int) -> Chunk:
        import numpy as np
        n, width = len(vectors), vectors.shape[1] // parts
        cut = vectors.reshape(n, parts, width).transpose(1, 2, 0)                 # part x axis x vector
        axes = min(width, 31)                                                    # the order alone needs no more
        bits = 62 // axes if axes > 3 else 16
        seen = cut[:, :axes].astype(np.float64)
        least = seen.min(axis=2, keepdims=True)
        span = seen.max(axis=2, keepdims=True) - least
        grid = ((seen - least) / np.where(span > 0, span, 1) * ((1 << bits) - 1)).astype(np.int64)
        keys = hilbert_keys(grid.transpose(1, 0, 2).reshape(axes, parts * n), bits).reshape(parts, n)
        order = np.argsort(keys, axis=1, kind="stable")
        blocks = -(-n // BLOCK)
        sorted_ = np.take_along_axis(cut, order[:, None, :], axis=2)
        filled = np.concatenate([sorted_, np.repeat(sorted_[:, :, -1:], blocks * BLOCK - n, axis=2)], axis=2)
        values = filled.reshape(parts, width, blocks, BLOCK).transpose(0, 2, 3, 1)
        sums = values.sum(axis=2)
        sums[:, -1] = values[:, -1, :n - BLOCK * (blocks - 1)].sum(axis=1)
        return cls(order.astype(np.uint32), values, values.min(axis=2), values.max(axis=2), sums, n)

    def fields(self) -> dict:
        """As binary columns; Python's integers travel as text."""
        import numpy as np
        if self.values.dtype == object:
            kind = "text"
            pack = lambda a: ",".join(map(str, a.ravel().tolist())).encode()      # noqa: E731
        else:
            most = int(np.abs(self.values).max(initial=0))
            kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "i8"
            pack = lambda a: a.astype(f"<{kind}").tobytes()                       # noqa: E731
        sums = self.sums.astype("<i8").tobytes() if kind != "text" else pack(self.sums)
        return {"n": self.n, "kind": kind, "blocks": self.values.shape[1], "ordered": self.order.astype("<u4").tobytes(),
                "held": pack(self.values), "low": pack(self.low), "high": pack(self.high), "sums": sums}

    @classmethod
    def from_fields(cls, row: dict, parts: int) -> Chunk:
        import numpy as np
        n, kind, blocks = row["n"], row["kind"], row["blocks"]

        def back(raw, *shape, of=kind):
            if kind == "text":
                return np.array([int(v) for v in raw.decode().split(",")], dtype=object).reshape(shape)
            return np.frombuffer(raw, f"<{of}").astype(np.int64).reshape(shape)

        order = np.frombuffer(row["ordered"], "<u4").reshape(parts, n)
        values = back(row["held"], parts, blocks, BLOCK, -1)
        return cls(order, values, back(row["low"], parts, blocks, -1), back(row["high"], parts, blocks, -1),
                   back(row["sums"], parts, blocks, -1, of="i8"), n)


def shortlists(low, high, book):
    """Which entries can be the nearest of some vector in each box (block x entry): those whose least distance from
    the box is no more than the smallest greatest distance of any entry."""
    import numpy as np
    below, above = low[:, None, :] - book[None], book[None] - high[:, None, :]
    gap = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(below), np.abs(above))
    far = np.maximum(far, np.maximum(np.abs(book[None] - low[:, None, :]), np.abs(book[None] - high[:, None, :])))
    nearest, farthest = (gap * gap).sum(axis=2), (far * far).sum(axis=2)
    return nearest <= farthest.min(axis=1, keepdims=True)


def nearest(values, listed, book):
    """The nearest entry of every vector of some blocks (lower index first) and its squared distance (block x place), by
    exact integer arithmetic over each block's shortlist; blocks with equally long lists go together."""
    import numpy as np
    blocks, places, width = values.shape
    entry = np.zeros((blocks, places), dtype=np.int64)
    distance = np.zeros((blocks, places), dtype=values.dtype)
    lengths = listed.sum(axis=1)
    for length in np.unique(lengths):
        found = np.flatnonzero(lengths == length)
        at_once = max(1, KERNEL // (places * int(length) * width))
        for some in np.split(found, range(at_once, len(found), at_once)):
            entries = np.nonzero(listed[some])[1].reshape(len(some), int(length))
            apart = np.zeros((len(some), places, int(length)), dtype=values.dtype)
            for axis in range(width):
                d = values[some, :, axis][:, :, None] - book[entries, axis][:, None, :]
                apart += d * d
            best = apart.argmin(axis=2)
            entry[some] = np.take_along_axis(entries, best, axis=1)
            distance[some] = np.take_along_axis(apart, best[:, :, None], axis=2)[:, :, 0]
    return entry, distance


def _book(books, part: int, values):
    """A part's codebook, with 64-bit integers if the differences from the values cannot overflow."""
    import numpy as np
    book = books[part]
    if values.dtype != object and 4 * books[:, 0].size * max(abs(int(v)) for v in book.ravel().tolist()) ** 2 < 1 << 62:
        return book.astype(np.int64), values
    return book.astype(object), values.astype(object)


def _chunks(df: DataFrame, parts: int, scale: int, width: int) -> DataFrame:
    """The kept rows ``id label vector`` as a written table of chunks."""
    size = max(BLOCK, CHUNK_VALUES // width)
    kinds = {f.name: f.dataType for f in df.schema}
    schema = T.StructType([T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("labels", T.ArrayType(kinds["label"])),
                           *[T.StructField(c, T.IntegerType()) for c in ("n", "blocks")], T.StructField("kind", T.StringType()),
                           *[T.StructField(c, T.BinaryType()) for c in ("ordered", "held", "low", "high", "sums")]])

    def build(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        waiting, n = [], 0

        def made(table):
            table = table.combine_chunks()
            flat = table["vector"].chunk(0).flatten().to_numpy(zero_copy_only=False)
            held = Chunk.of(scaled(flat.reshape(table.num_rows, width), scale), parts).fields()
            whole = pa.array([0, table.num_rows], pa.int32())
            listed = {c: pa.ListArray.from_arrays(whole, table[to].chunk(0)) for c, to in (("ids", "id"), ("labels", "label"))}
            rest = {"n": pa.array([held["n"]], pa.int32()), "blocks": pa.array([held["blocks"]], pa.int32()), "kind": pa.array([held["kind"]])}
            rest |= {c: pa.array([held[c]], pa.binary()) for c in ("ordered", "held", "low", "high", "sums")}
            return pa.RecordBatch.from_pydict(listed | rest)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            waiting.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(waiting)
                yield made(table.slice(0, size))
                waiting, n = table.slice(size).to_batches(), n - size
        if n:
            yield made(pa.Table.from_batches(waiting))

    return saved(df.mapInArrow(build, schema), "vector-chunks")


def _improved(chunks: DataFrame, books, parts: int):
    """The codebooks after one round: each task sums the vectors of each entry, Spark adds the tasks' sums up."""
    def sums(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        total, count = None, None
        for batch in batches:
            for row in batch.to_pylist():
                held = Chunk.from_fields(row, parts)
                if total is None:
                    total = np.zeros(books.shape, dtype=object)
                    count = np.zeros(books.shape[:2], dtype=np.int64)
                for part in range(parts):
                    book, values = _book(books, part, held.values[part])
                    listed = shortlists(held.low[part], held.high[part], book)
                    sure = listed.sum(axis=1) == 1        # a block that has one entry left counts by its stored sum
                    if sure.any():
                        one = listed[sure].argmax(axis=1)
                        np.add.at(count[part], one, held.sizes[sure])
                        np.add.at(total[part], one, held.sums[part][sure].astype(object))
                    if not sure.all():
                        entry, _ = nearest(values[~sure], listed[~sure], book)
                        real = np.arange(BLOCK)[None, :] < held.sizes[~sure][:, None]
                        e, v = entry[real], values[~sure][real]
                        count[part] += np.bincount(e, minlength=books.shape[1])
                        grouped = np.zeros((books.shape[1], v.shape[1]), dtype=v.dtype)
                        np.add.at(grouped, e, v)
                        total[part] += grouped.astype(object)
        if total is not None:
            part, entry = np.nonzero(count)
            axes = books.shape[2]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.repeat(part, axes), pa.int32()), "entry": pa.array(np.repeat(entry, axes), pa.int32()),
                "axis": pa.array(np.tile(np.arange(axes), len(part)), pa.int32()), "n": pa.array(np.repeat(count[part, entry], axes), pa.int64()),
                "total": pa.array([str(v) for v in total[part, entry].ravel().tolist()], pa.string())})

    parted = chunks.drop("ids", "labels").mapInArrow(sums, "part int, entry int, axis int, n bigint, total string")
    added = parted.groupBy("part", "entry", "axis").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    made = books.copy()
    for r in added.collect():                              # one row per number of the codebooks, whatever the table's size
        made[r["part"], r["entry"], r["axis"]] = int(r["total"]) // r["n"]
    return made


def _coded(chunks: DataFrame, books, parts: int, id_type: T.DataType, label_type: T.DataType) -> DataFrame:
    """``id label code error`` of every vector."""
    def code(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                held = Chunk.from_fields(row.drop_columns(["ids", "labels"]).to_pylist()[0], parts)
                codes, errors = np.zeros((held.n, parts), dtype=np.uint8), np.zeros(held.n, dtype=object)
                for part in range(parts):
                    book, values = _book(books, part, held.values[part])
                    entry, distance = nearest(values, shortlists(held.low[part], held.high[part], book), book)
                    codes[held.order[part], part] = entry.ravel()[:held.n]
                    errors[held.order[part]] += distance.ravel()[:held.n].astype(object)
                text = codes.tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_pydict({
                    "id": row["ids"].flatten(), "label": row["labels"].flatten(),
                    "code": pa.array([text[i:i + step] for i in range(0, len(text), step)], pa.string()),
                    "error": pa.array([int(e) if e < 1 << 63 else None for e in errors.tolist()], pa.int64())})

    schema = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])
    return chunks.mapInArrow(code, schema)


def whole_vectors(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``key code error label_error codebooks_sha256`` of every vector that is whole.

    Components become ``floor(scale * x)``. Vectors are cut into ``parts`` equal parts; each part has a codebook of at most ``entries``
    entries (256 at most), at first that part of the vectors with the smallest keys, improved in ``rounds`` rounds.

    Each task takes chunks of about a million components, sorts every part of a chunk along a Hilbert curve and cuts it
    into flat blocks with a box and sums, kept in a written table. In each round the boxes' distances leave each block a short list of
    entries, and exact integer kernels decide among them; a block with one entry left counts by its sum. Only the sums of
    entries are shuffled and only codebooks reach the driver, so neither repeated vectors nor hot labels gather anywhere.

    Vectors that are null or hold null or non-finite components go, as do those whose length is no multiple of ``parts``, or another than
    that of the smallest key's vector. Null keys come last; among rows that share a key the smaller vector comes first. Scaled
    components beyond 2**62 are taken as 2**62; an error beyond 64 bits is null and left out of its label's sum, a sum beyond 64 bits is null. Null labels are
    one label. An empty table gives an empty table.
    """
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("1 to 256 entries and at least one part")
    rows = df.select(name(key).alias("id"), name(label).alias("label"), name(vector).cast("array<double>").alias("vector"))
    rows = rows.where(whole_vectors(F.col("vector")) & (F.size("vector") > 0) & (F.size("vector") % parts == 0))
    first = rows.orderBy(F.col("id").asc_nulls_last(), F.size("vector"), "vector").select(F.size("vector").alias("n")).head()
    width = first["n"] if first else parts
    rows = rows.where(F.size("vector") == width)
    import numpy as np
    starts = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").head(entries)
    books = scaled(np.array([r["vector"] for r in starts], dtype=np.float64).reshape(len(starts), width), scale).astype(object)
    books = books.reshape(len(starts), parts, width // parts).transpose(1, 0, 2).copy()
    chunks = _chunks(rows, parts, scale, width)
    for _ in range(rounds if len(starts) else 0):
        books = _improved(chunks, books, parts)
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    coded = saved(_coded(chunks, books, parts, rows.schema["id"].dataType, rows.schema["label"].dataType), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("l")).agg(F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)").alias("label_error"))
    sums = saved(sums, "vector-labels")
    joined = coded.join(broadcast_below(sums), F.col("label").eqNullSafe(F.col("l")))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
