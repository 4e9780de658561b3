"""Product codes of vectors: codebooks by rounds of exact nearest-entry search, with slices intersected as bitmasks.

Vectors become integers and are cut into equal parts; each part has a codebook of at most 256 entries. To find a part's
nearest entry exactly without comparing it with all:

1. slices: in each dimension the entries' coordinates are sorted, and a prefix mask of four 64-bit words stands at each
   place: the entries sorted before it;
2. radius: the entries that neighbour the part in a few of the widest dimensions are compared with it; the least
   distance found bounds the nearest entry's distance, so that entry lies in the box of this radius;
3. intersect: in each dimension two binary searches select the range of the box, the exclusive or of its two prefix
   masks is the set of its entries, and the AND over all dimensions leaves the candidates;
4. the candidates' distances decide, ties to the lower index. Every entry in reach is a candidate, so the result is exact.

Each round is one pass over the vectors: tasks send sums and counts by entry, of which there are at most
256 x dimension, whatever the number of rows. The codebooks are as small and travel with the next round's tasks.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.storage import written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors that are compared at once.
BLOCK = 2048
#: Dimensions in which neighbours are looked up for the initial radius.
PROBES = 8
#: Components beyond this have no squared distance that fits 64 bits; their vectors take no part.
MOST = 1 << 16
#: A label with more than this share of all rows is hot; there are at most so many of them.
HOT_LABELS = 1024


class Slices(NamedTuple):
    """A codebook prepared for search: entries (n x d), sorted coordinates (d x n), prefix masks (d x (n + 1) x words), probed dimensions."""

    entries: np.ndarray
    sorted: np.ndarray
    order: np.ndarray
    masks: np.ndarray
    probes: np.ndarray


def sliced(entries: np.ndarray) -> Slices:
    n, d = entries.shape
    words = -(-n // 64)
    order = np.argsort(entries, axis=0, kind="stable").T.copy()
    masks = np.zeros((d, n + 1, words), np.uint64)
    bits = np.zeros((n, words), np.uint64)
    bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
    for j in range(d):
        masks[j, 1:] = np.bitwise_or.accumulate(bits[order[j]], axis=0)
    widest = np.argsort(-np.ptp(entries, axis=0), kind="stable")[:PROBES]
    return Slices(entries, np.take_along_axis(entries.T, order, axis=1), order, masks, widest)


def nearest(book: Slices, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, ties to the lower index. x: integers, n x d."""
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), BLOCK):
        index[a : a + BLOCK], error[a : a + BLOCK] = _nearest(book, x[a : a + BLOCK])
    return index, error


def _nearest(book: Slices, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, m = len(x), len(book.entries)
    least = np.full(n, np.iinfo(np.int64).max)
    for j in book.probes:
        place = np.searchsorted(book.sorted[j], x[:, j])
        for step in (-1, 0):
            near = book.order[j][np.clip(place + step, 0, m - 1)]
            np.minimum(least, ((x - book.entries[near]) ** 2).sum(1), out=least)
    radius = np.ceil(np.sqrt(least.astype(np.float64))).astype(np.int64) + 1
    found = np.full((n, book.masks.shape[2]), np.uint64(2**64 - 1))
    for j in range(x.shape[1]):
        low = np.searchsorted(book.sorted[j], x[:, j] - radius)
        high = np.searchsorted(book.sorted[j], x[:, j] + radius, "right")
        found &= book.masks[j][high] ^ book.masks[j][low]
    bits = np.unpackbits(found.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :m]
    row, entry = np.nonzero(bits)
    distance = ((x[row] - book.entries[entry]) ** 2).sum(1)
    first = np.searchsorted(row, np.arange(n))
    error = np.minimum.reduceat(distance, first)  # the box always holds the probed entry, so no row is without candidates
    hit = np.flatnonzero(distance == error[row])
    return entry[hit[np.searchsorted(row[hit], np.arange(n))]], error


def _vectors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """The scaled integer components, rows x width."""
    flat = batch.column(batch.schema.get_field_index(name)).flatten()
    return np.floor(SCALE * flat.to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64).reshape(-1, width)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor empty and holds numbers only, none null, non-finite or beyond MOST."""
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= MOST)))


def width_of(kept: DataFrame, parts: int) -> int:
    """Length of the vector of the smallest vec_id (of equal ids the smallest vector); 0 without vectors."""
    row = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").first()
    width = len(row.embedding) if row else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    return width


def first_entries(kept: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The first codebooks: parts of the vectors of the smallest ids, equal ids by their components, null ids last."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    x = np.floor(SCALE * np.array([r.embedding for r in rows], np.float64)).astype(np.int64)
    return np.split(x, parts, axis=1)


def trained(kept: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after `rounds` passes over all vectors: each entry becomes floor(mean) of the parts assigned to it."""
    width = sum(b.shape[1] for b in books)
    each = width // len(books)

    def sums(books):
        def run(batches):
            tables = [sliced(b) for b in books]
            total, count = np.zeros((len(books), len(books[0]), each), np.int64), np.zeros((len(books), len(books[0])), np.int64)
            for batch in batches:
                x = _vectors(batch, "embedding", width)
                for p, table in enumerate(tables):
                    part = x[:, p * each : (p + 1) * each]
                    index, _ = nearest(table, part)
                    count[p] += np.bincount(index, minlength=len(books[0]))
                    np.add.at(total[p], index, part)
            p, e = np.nonzero(count)
            n = len(p)
            place = [pa.array(np.repeat(v, each), pa.int32()) for v in (p, e)] + [pa.array(np.tile(np.arange(each), n), pa.int32())]
            yield pa.RecordBatch.from_arrays([*place, pa.array(total[p, e].ravel(), pa.int64()), pa.array(np.repeat(count[p, e], each), pa.int64())], ["part", "entry", "place", "total", "rows"])

        return run

    for _ in range(rounds):
        found = kept.select("embedding").mapInArrow(sums(books), "part int, entry int, place int, total long, rows long")
        means = found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
        books = [b.copy() for b in books]
        for r in means.collect():  # at most ENTRIES x dimension rows
            books[r.part][r.entry, r.place] = r.total // r.rows
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all integer components in order of part, entry and position, as decimals with commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def coded(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distance summed over parts) of every vector."""
    width = sum(b.shape[1] for b in books)
    each = width // len(books)

    def run(batches):
        tables = [sliced(b) for b in books]
        for batch in batches:
            x = _vectors(batch, "embedding", width)
            codes, error = np.zeros((len(x), len(tables)), np.uint8), np.zeros(len(x), np.int64)
            for p, table in enumerate(tables):
                index, distance = nearest(table, x[:, p * each : (p + 1) * each])
                codes[:, p], error = index, error + distance
            text = codes.tobytes().hex()
            step = 2 * len(tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over equal labels, nulls together. codes: a written table.

    The labels with more than 1 / HOT_LABELS of all rows, fewer than HOT_LABELS of them, are joined by broadcast; so no task
    gets all the rows of a hot label. The others meet their rows by label.
    """
    labels = written(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_rows")), "labels")
    most = (labels.agg(F.sum("_rows")).first()[0] or 0) // HOT_LABELS
    hot, cold = (labels.where(c).select(F.col("label").alias("_label"), "label_error", F.lit(True).alias("_hot")) for c in (f"_rows > {most}", f"_rows <= {most}"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    marked = codes.join(F.broadcast(hot), same, "left").drop("_label")
    done = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot is null").drop("_hot", "label_error").join(cold.drop("_hot").hint("shuffle_hash"), same, "inner").drop("_label")
    return done.unionByName(rest)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of vectors(vec_id, embedding, label, ...) and the codebooks that decode them.

    Every component x becomes floor(1024 * x). Returns a written table (vec_id, label, code, error) with one row per usable
    vector, and the integer codebooks by part. Vectors that are null or empty, hold null or non-finite components or
    components beyond 65,536 in size, or differ in length from the vector of the smallest vec_id, take no part. Repeated rows
    are coded alike; a null vec_id stays and comes last in the choice of first entries; null labels are labels. With fewer
    usable vectors than entries the codebook is shorter. No usable vectors: no rows, no codebooks. A length that is no
    multiple of `parts` raises a ValueError. Other columns are ignored.
    """
    kept = usable(vectors.select("vec_id", "embedding", "label"))
    width = width_of(kept, parts)
    if not width:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), []
    kept = kept.where(F.size("embedding") == width)
    books = trained(kept, first_entries(kept, parts, entries), rounds)
    return written(coded(kept, books), "codes"), books


def decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Adds `decoded`, the integer vector that each code stands for: the codebooks' entries side by side."""
    tables = [b.tolist() for b in books]

    @F.pandas_udf("array<long>")
    def look_up(code):
        return code.map(lambda c: [v for p, t in enumerate(tables) for v in t[int(c[2 * p : 2 * p + 2], 16)]])

    return codes.withColumn("decoded", look_up("code"))


def code_errors(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector, see compress()."""
    codes, books = compress(vectors)
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
