"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the 64-bit hashes of its distinct word n-grams (verification compares their upper 48 bits). Documents with equal sets
form one class, of which only the representative (smallest id) is joined:

1. a count sketch of fixed width estimates every n-gram's document frequency over all documents;
2. each set is ordered rare-first (frequency, then hash), and only its prefix, in which two sets of
   the wanted similarity must meet, becomes postings;
3. postings meet by n-gram. The length filter compares set sizes, the positional filter what can follow the matching
   places, and the suffix filter splits what follows the prefixes at fixed pivots of the hash order: the
   differences of the parts' sizes bound the sets' Hamming distance from below;
4. what survives is no list of pairs. Each document's smallest candidate is its anchor; documents with one anchor are
   neighbours, cut into chunks of bounded size. A second meeting finds which two chunks hold a candidate pair;
5. two such chunks are a block. The whole sets of its candidates travel to it once, and all pairs between the
   chunks are verified there, by one product of incidence matrices. A pair belongs to one block only, so it is verified once.

Blocks return what each document is linked with as a count and a root, so a group of g near copies makes g rows
a block and never its g * g pairs. Components alone need even less: every document is verified against
its anchor first, and only documents whose components are still apart meet again.

The sketch only decides the order, so its errors cost time but never lose a pair. An n-gram that the sketch calls hot
is dealt to a grid of cells, so that no task holds all its postings.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.arrays import U64, mix, slices, span_hashes
from marketloom.llm.bitmaps import may_hold
from marketloom.llm.components import connected_components
from marketloom.llm.storage import let_go, scratch, written

#: Counters of the sketch, a byte each once ranked.
SKETCH_WIDTH = 1 << 22
#: Documents, by the sketch, from which an n-gram is hot, and postings of a bucket on average.
HOT_GRAM, BUCKET_POSTINGS = 1 << 13, 50_000
#: n-grams in a chunk's sets (each counting as LEAST_SET at least), and in those that one task verifies, on average.
CHUNK_GRAMS, LEAST_SET, TASK_GRAMS = 1 << 19, 256, 1 << 19
#: Bytes of document ids and blocks that are broadcast at most to pick documents; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Parts that the suffix filter's pivots make.
_PARTS = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = U64(0xD6E8FEB86659FD93)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the n + 1 offsets of the texts' words. Words never cross texts."""
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams; a shorter text is one n-gram, an empty one has none."""
    data = _LOWER[data]
    starts, ends, first = words(data, at)
    if not len(starts):
        for _ in range(len(at) - 1):
            yield np.zeros(0, U64)
        return
    hashes = span_hashes(data, starts, ends)
    grams = hashes.copy()
    for j in range(1, size):
        grams[: len(grams) - j] = mix(grams[: len(grams) - j] * _STEP + hashes[j:])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            whole = hashes[a : a + 1]
            for j in range(a + 1, b):
                whole = mix(whole * _STEP + hashes[j : j + 1])
            yield mix(whole + U64(b - a))
        else:
            yield np.zeros(0, U64)


def _needed(n, percent: int):
    """Least overlap that a set of n members has with any set of the wanted similarity."""
    return -(-n * percent // 100)


def cell_of(hashes: np.ndarray, width: int) -> np.ndarray:
    return (hashes >> U64(20)).astype(np.int64) % width


def sketch_frequencies(docs: DataFrame, size: int, width: int) -> np.ndarray:
    """Estimated document frequencies by cell: `width` counters, summed by Spark in two levels.

    Only that fixed-size array reaches the driver, whatever the number of documents.
    """
    chunk = min(width, 1 << 14)

    def packed(part: int, cells: np.ndarray, salt: int = 0) -> dict:
        return {"part": part, "salt": salt, "cells": zlib.compress(cells.astype(np.int64).tobytes(), 1)}

    schema = "part int, salt int, cells binary"
    arrow = pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("cells", pa.binary())])

    def count(batches):
        let_go()
        cells, salt, held = np.zeros(width, np.int32), 0, []
        for batch in batches:
            for _, data, at in slices(batch):
                salt = (salt + len(data)) % 64
                held += (cell_of(s, width) for s in shingle_sets(data, at, size) if len(s))
                if len(held) and sum(map(len, held)) > width // 4:
                    cells += np.bincount(np.concatenate(held), minlength=width).astype(np.int32)
                    held = []
        if held:
            cells += np.bincount(np.concatenate(held), minlength=width).astype(np.int32)
        for i in range(0, width, chunk * 16):
            yield pa.RecordBatch.from_pylist([packed(j, cells[j : j + chunk], salt) for j in range(i, min(width, i + chunk * 16), chunk)], arrow)

    def add(table: pa.Table) -> pa.Table:
        cells = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in table.column("cells"))
        return pa.Table.from_pylist([packed(table.column("part")[0].as_py(), cells)], arrow)

    rows = docs.select("text").mapInArrow(count, schema)
    rows = rows.groupBy("part", "salt").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema)
    cells = np.zeros(width, np.int64)
    for r in rows.collect():
        cells[r.part : r.part + chunk] = np.frombuffer(zlib.decompress(r.cells), np.int64)
    return cells


_STEPS = 8  # ranks to a doubling of the frequency


def ranks(cells: np.ndarray) -> np.ndarray:
    """One byte a cell: its frequency on a log scale."""
    return np.minimum(255, _STEPS * np.log2(1 + cells)).astype(np.uint8)


_BASE = "doc_id long, n int, signature binary, c0 long, c1 long, prefix array<long>"


def prefixes(docs: DataFrame, size: int, percent: int, rank) -> DataFrame:
    """For each row: set size, digest of the whole set, sizes of the suffix's parts (a byte each, at most 255), rare-first prefix."""

    def describe(batches):
        for batch in batches:
            for part, data, at in slices(batch):
                n, signatures, parts, prefix = [], [], np.zeros((part.num_rows, _PARTS), np.uint8), []
                for i, s in enumerate(shingle_sets(data, at, size)):
                    n.append(len(s))
                    signatures.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keep = len(s) - _needed(len(s), percent) + 1 if len(s) else 0
                    order = np.lexsort((s, rank.value[cell_of(s, len(rank.value))]))
                    parts[i] = np.minimum(255, np.bincount((s[order[keep:]] >> U64(60)).astype(np.int64), minlength=_PARTS))
                    prefix.append(s[order[:keep]].view(np.int64))
                flat = np.concatenate([np.zeros(0, np.int64), *prefix])
                ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
                two = parts.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(signatures, pa.binary()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["doc_id", "n", "signature", "c0", "c1", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(describe, _BASE)


_KEYS = {"c0": np.int64, "c1": np.int64, "chunk": np.int64, "part": np.int64, "anchor": np.int64}


def postings(classes: DataFrame, rank, buckets: int, hot: int) -> DataFrame:
    """A row for each prefix n-gram of classes(id, n, c0, c1, prefix, ...): bucket, key, side, id, n, pos and the other columns.

    key: the n-gram, or for a hot one the n-gram and a cell of its grid. Members of a cell meet if their side is -1 or differs.
    """
    more = [c for c in classes.columns if c in _KEYS]

    def deal(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            lists = get("prefix")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
            columns = {c: get(c).to_numpy() for c in ("id", "n", *more)}
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + (1 << 18), "right")) - 1)
                grams, row = flat[ends[begin] : ends[end]], np.repeat(np.arange(begin, end), np.diff(ends[begin : end + 1]))
                pos = np.arange(ends[begin], ends[end]) - ends[row]
                often = np.exp2(rank.value[cell_of(grams, len(rank.value))] / _STEPS)
                key, side, at = grams, np.full(len(grams), -1, np.int32), np.arange(len(grams))
                many = np.flatnonzero(often > hot)
                if len(many):  # row and column of the grid's cells that hold this posting
                    grid = -(-often[many] // hot).astype(np.int64)
                    own = (mix(columns["id"][row[many]].astype(U64)) % grid.astype(U64)).astype(np.int64)
                    again = np.repeat(np.arange(len(many)), grid)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(grid) - grid, grid)
                    mine = own[again]
                    cell = np.minimum(mine, other) * grid[again] + np.maximum(mine, other)
                    few = np.flatnonzero(often <= hot)
                    key = np.concatenate([grams[few], mix(grams[many][again] + cell.astype(U64) * _STEP)])
                    side = np.concatenate([side[few], np.where(mine == other, -1, mine).astype(np.int32)])
                    at = np.concatenate([few, many[again]])
                row, pos = row[at], pos[at]
                bucket = (mix(key) % U64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(key.view(np.int64)), pa.array(side), pa.array(columns["id"][row]), pa.array(columns["n"][row].astype(np.int32)), pa.array(pos.astype(np.int32)), *(pa.array(columns[c][row]) for c in more)],
                    ["bucket", "key", "side", "id", "n", "pos", *more],
                )
                begin = end

    return classes.mapInArrow(deal, "bucket int, key long, side int, id long, n int, pos int" + "".join(f", {c} long" for c in more))


def _meetings(table: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, dict]]:
    """Candidate pairs of a bucket's postings, a bounded number at a time: rows x and y, and the columns sorted as they are numbered."""
    columns = {c: table.column(c).to_numpy() for c in table.column_names if c != "bucket"}
    order = np.lexsort((columns["n"], columns["key"]))
    columns = {c: v[order] for c, v in columns.items()}
    key, n, pos, side, ids = (columns[c] for c in ("key", "n", "pos", "side", "id"))
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    after = n - _needed(n, percent) - pos  # of the prefix, after this place
    parts = np.stack([columns.pop("c0"), columns.pop("c1")], 1).view(np.uint8)
    x = np.flatnonzero(key[1:] == key[:-1])
    apart = 1
    while len(x):
        x = x[x + apart < len(key)]
        # lengths ascend within a key, so whoever is too long stays so
        x = x[(key[x + apart] == key[x]) & (100 * n[x] >= percent * n[x + apart])]
        for i in range(0, len(x), 1 << 19):
            a = x[i : i + (1 << 19)]
            b = a + apart
            ok = (ids[a] != ids[b]) & ((side[a] < 0) | (side[a] != side[b]))
            least = -(-(n[a] + n[b]) * percent // (100 + percent))
            ok &= np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least
            if "part" in columns:  # what is one component, or was verified, need not meet
                ok &= (columns["part"][a] != columns["part"][b]) & (columns["anchor"][a] != ids[b]) & (columns["anchor"][b] != ids[a])
            a, b, least = a[ok], b[ok], least[ok]
            distance = np.abs(parts[a].astype(np.int16) - parts[b]).sum(1, dtype=np.int64)
            rest = (n[a] - pos[a] - 1 - after[a]) + (n[b] - pos[b] - 1 - after[b])
            # of what two sets share after this place, all that is not in both suffixes is in the prefix that reaches further
            ok = np.minimum(pos[a], pos[b]) + 1 + np.maximum(after[a], after[b]) + (rest - distance) // 2 >= least
            if ok.any():
                yield a[ok], b[ok], columns
        apart += 1


def _anchors(met: DataFrame, percent: int) -> DataFrame:
    """id, anchor: the smallest candidate of each document that has one, or itself."""

    def meet(table):
        least: dict[str, np.ndarray] = {}
        ids = None
        for x, y, columns in _meetings(table, percent):
            if ids is None:
                ids = columns["id"]
                least = ids.copy()
                seen = np.zeros(len(ids), bool)
            np.minimum.at(least, x, ids[y])
            np.minimum.at(least, y, ids[x])
            seen[x] = seen[y] = True
        if ids is None:
            return pa.table({"id": pa.array([], pa.int64()), "anchor": pa.array([], pa.int64())})
        order = np.lexsort((least[seen], ids[seen]))
        own, best = ids[seen][order], least[seen][order]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        return pa.table({"id": own[first], "anchor": best[first]})

    return met.groupBy("bucket").applyInArrow(meet, "id long, anchor long").groupBy("id").agg(F.min("anchor").alias("anchor"))


def _blocks(met: DataFrame, percent: int) -> DataFrame:
    """id, block, chunk: the blocks in which each document has a candidate, from postings with `chunk`."""

    def meet(table):
        found, held, size = [], [], 0

        def settle():
            nonlocal held, size
            if held:
                found.append(np.unique(np.concatenate([*held, *found]), axis=0))
                del found[:-1]
                held, size = [], 0

        for x, y, columns in _meetings(table, percent):
            cx, cy = columns["chunk"][x], columns["chunk"][y]
            low, high = np.minimum(cx, cy), np.maximum(cx, cy)
            block = mix(mix(low.view(U64)) * _STEP + high.view(U64)).view(np.int64)
            held += (np.stack([columns["id"][x], block, cx], 1), np.stack([columns["id"][y], block, cy], 1))
            size += 2 * len(x)
            if size > 1 << 20:
                settle()
        settle()
        rows = found[0] if found else np.zeros((0, 3), np.int64)
        return pa.table({c: np.ascontiguousarray(rows[:, i]) for i, c in enumerate(("id", "block", "chunk"))})

    return met.groupBy("bucket").applyInArrow(meet, "id long, block long, chunk long")


def _packed(s: np.ndarray) -> bytes:
    """A sorted set as the differences of its hashes' upper 48 bits, byte by byte of all: the zero bytes compress in a shuffle."""
    steps = np.diff(s >> U64(16), prepend=U64(0))
    return steps.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unpacked(data) -> np.ndarray:
    """The upper 48 bits of a packed set's hashes, sorted; as many as it had, also where two of them agree."""
    n = len(data) // 6
    steps = np.zeros((n, 8), np.uint8)
    if n:
        steps[:, :6] = np.frombuffer(data, np.uint8).reshape(6, n).T
    return np.cumsum(steps.view(U64)[:, 0], dtype=U64)


def _whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """id, chunk, weight, blocks and members (the whole set, packed) of docs(doc_id, text, chunk, weight, blocks)."""

    def build(batches):
        for batch in batches:
            for part, data, at in slices(batch):
                get = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
                members = pa.array([_packed(s) for s in shingle_sets(data, at, size)], pa.binary())
                yield pa.RecordBatch.from_arrays([get("doc_id").cast(pa.int64()), get("chunk"), get("weight"), get("blocks"), members], ["id", "chunk", "weight", "blocks", "members"])

    return docs.select("doc_id", "text", "chunk", "weight", "blocks").mapInArrow(build, "id long, chunk long, weight long, blocks array<long>, members binary")


def _common(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """Sizes of the intersections of the first `cut` sets with the others (with all, if cut is 0), by incidence matrices of bounded width."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    column, owner = (v[(np.bincount(column) > 1)[column]] for v in (column, owner))  # a member of one set only is in no intersection
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1 if len(column) else column
    rows = slice(cut) if cut else slice(None)
    out = np.zeros((cut or len(sets), len(sets) - cut), np.float32)
    width = 2048
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [begin, begin + width])
        incidence = np.zeros((len(sets), width), np.float32)
        incidence[owner[i:j], column[i:j] - begin] = 1
        out += incidence[rows] @ incidence[cut:].T
    return out


def _similar_pairs(sets: list[np.ndarray], cut: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of similar sets: i < cut <= j, or i < j if cut is 0."""
    n = np.array([len(s) for s in sets], np.int64)
    both = _common(sets, cut)
    xs, ys = [], []
    for i in range(0, len(both), 256):
        some = both[i : i + 256].astype(np.int64)
        x, y = np.nonzero(100 * some >= percent * (n[i : i + len(some), None] + n[None, cut:] - some))
        xs.append(x + i)
        ys.append(y + cut)
    x, y = np.concatenate(xs), np.concatenate(ys)
    return (x, y) if cut else (x[x < y], y[x < y])


def verified(docs: DataFrame, wanted: DataFrame, size: int, percent: int, pairs: bool = False) -> DataFrame:
    """Verifies all pairs between the two chunks of each block (within the chunk, if it has one).

    wanted(id, chunk, weight, n, blocks): the blocks in which a document is. Returns for each document and block with a link id, root (smallest id that
    the block's links connect) and links (sum of the linked documents' weights); or, with pairs, the similar pairs a < b.
    """
    sums = wanted.agg(F.sum(F.size("blocks") * F.col("n")).alias("grams"), F.sum(F.size("blocks") * 8 + 40).alias("bytes")).first()
    groups = max(1, (sums.grams or 0) // TASK_GRAMS)
    how = "broadcast" if (sums.bytes or 0) <= BROADCAST_BYTES else "shuffle_hash"
    if how == "shuffle_hash":  # texts of documents without a candidate stay where they are
        docs = docs.where(may_hold(wanted, "id")(F.col("doc_id")))
    chosen = docs.join(wanted.withColumnRenamed("id", "doc_id").hint(how), "doc_id")
    sets = _whole_sets(chosen, size).select(F.explode("blocks").alias("block"), "id", "chunk", "weight", "members")
    sets = sets.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))

    def verify(table):
        block, chunk, ids, weight = (table.column(c).to_numpy() for c in ("block", "chunk", "id", "weight"))
        members = table.column("members").combine_chunks() if isinstance(table.column("members"), pa.ChunkedArray) else table.column("members")
        order = np.lexsort((ids, chunk, block))
        cuts = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1], [True]]))
        a, b, c = [], [], []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[i:j]
            if len(own) < 2:
                continue
            cut = int(np.searchsorted(chunk[own], chunk[own[0]], "right")) % len(own)
            sets = [_unpacked(members[r].as_buffer()) for r in own.tolist()]
            x, y = _similar_pairs(sets, cut, percent)
            x, y = ids[own][x], ids[own][y]
            x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
            if len(x) > 1 and len(np.unique(ids[own])) < len(own):  # an id with several sets: any of them counts, once
                x, y = np.unique(np.stack([x, y], 1), axis=0).T
            if not len(x):
                continue
            if pairs:
                a.append(x)
                b.append(y)
                continue
            known, place = np.unique(np.concatenate([x, y]), return_inverse=True)
            px, py = place[: len(x)], place[len(x) :]
            weights = np.zeros(len(known), np.int64)
            of = np.zeros(len(known), np.int64)
            at = np.searchsorted(known, ids[own])
            inside = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == ids[own])
            of[at[inside]] = weight[own][inside]
            np.add.at(weights, px, of[py])
            np.add.at(weights, py, of[px])
            a.append(known)
            b.append(_roots(known, px, py))
            c.append(weights)
        pa.default_memory_pool().release_unused()
        flat = [np.concatenate([np.zeros(0, np.int64), *v]) for v in (a, b, c)]
        return pa.table({"a": flat[0], "b": flat[1]} if pairs else {"id": flat[0], "root": flat[1], "links": flat[2]})

    return sets.groupBy("group").applyInArrow(verify, "a long, b long" if pairs else "id long, root long, links long")


def _roots(known: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest id of each component of the links x - y between places of the sorted ids `known`."""
    label = np.arange(len(known))
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            return known[label]


class _Join:
    """Tables that the steps of one join share."""

    def __init__(self, docs: DataFrame, size: int, percent: int, width: int, hot: int = HOT_GRAM):
        self.docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
        self.size, self.percent, self.hot = size, percent, hot
        # one byte a cell: `width` bytes
        self.rank = docs.sparkSession.sparkContext.broadcast(ranks(sketch_frequencies(self.docs, size, width)))
        base = written(prefixes(self.docs, size, percent, self.rank), "prefixes")
        full = base.where("n > 0")
        sets = full.groupBy("signature").agg(F.min("doc_id").alias("representative"), F.count("*").alias("rows"))
        repeated = written(sets.where("rows > 1").drop("rows"), "repeated")
        members = base.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "signature").join(repeated.hint("merge"), "signature", "left")
        self.members = written(members.select("doc_id", "n_shingles", F.coalesce("representative", "doc_id").alias("representative")), "members")
        # a set that stands once is a class as it is, so its prefix need not travel
        again = may_hold(repeated, "signature")(F.col("signature"))
        by_set = full.where(again).groupBy("signature").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "c0", "c1", "prefix")))
        self.classes = full.where(~again).select(F.col("doc_id").alias("id"), "n", "c0", "c1", "prefix").unionByName(written(by_set.drop("signature"), "classes"))
        grams = self.classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
        self.buckets = max(1, grams // BUCKET_POSTINGS)

    def anchored(self) -> DataFrame:
        """Classes that have a candidate: id, n, c0, c1, prefix, anchor, chunk."""
        anchor = written(_anchors(postings(self.classes, self.rank, self.buckets, self.hot), self.percent), "anchors")
        near = self.classes.where(may_hold(anchor, "id")(F.col("id"))).join(anchor.hint("merge"), "id")
        chunks = near.groupBy("anchor").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST_SET))) / CHUNK_GRAMS).alias("chunks"))
        near = near.join(chunks.hint("merge"), "anchor")
        return written(near.withColumn("chunk", F.xxhash64("anchor", F.pmod(F.xxhash64("id"), "chunks"))).drop("chunks"), "anchored")

    def sizes(self) -> DataFrame:
        """representative, size: how many documents it stands for."""
        return self.members.where("n_shingles > 0").groupBy("representative").agg(F.countDistinct("doc_id").alias("size"))

    def wanted(self, near: DataFrame, met: DataFrame) -> DataFrame:
        """id, chunk, weight, n, blocks of the documents that are in blocks, from met(id, block, chunk)."""
        of = met.groupBy("id", "chunk").agg(F.collect_set("block").alias("blocks"))
        n = near.groupBy("id").agg(F.max("n").alias("n"))
        weight = self.sizes().select(F.col("representative").alias("id"), F.col("size").alias("weight"))
        return written(of.join(n.hint("merge"), "id").join(weight.hint("merge"), "id"), "wanted")

    def links(self, near: DataFrame, pairs: bool = False) -> DataFrame:
        """What verification of all candidates in classes `near` returns."""
        met = _blocks(postings(near, self.rank, self.buckets, self.hot), self.percent)
        return written(verified(self.docs, self.wanted(near, met), self.size, self.percent, pairs), "links")

    def with_components(self, links: DataFrame) -> DataFrame:
        """members and component_id, from links(id, root)."""
        of = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("representative"), "component")
        return self.members.join(of.hint("merge"), "representative", "left").withColumn("component_id", F.coalesce("component", "representative"))


def jaccard_links(docs: DataFrame, size: int = 5, percent: int = 80, width: int = SKETCH_WIDTH, hot: int = HOT_GRAM) -> tuple[DataFrame, DataFrame]:
    """Similarity self-join of documents(doc_id, text, ...) on sets of `size`-word n-grams, for those who want the pairs.

    Returns (members, links): members has doc_id, n_shingles and
    representative (smallest id of an equal set) for each row; links has every pair a < b of representatives
    whose sets have 100 * intersection >= percent * union. Together they describe all links.

    Null or empty text: an empty set, linked with nothing (its own representative). Fewer words
    than `size`: the whole sequence is the one n-gram. Rows without doc_id take no part. Rows that
    repeat a doc_id stay rows of their own in members; a link of any of them is a link of that id. Other columns are ignored. No rows give no rows.
    """
    with scratch(docs.sparkSession):
        join = _Join(docs, size, percent, width, hot)
        return written(join.members, "members", keep=True), written(join.links(join.anchored(), pairs=True), "links", keep=True)


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80, width: int = SKETCH_WIDTH, hot: int = HOT_GRAM) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), n_links (other documents that are similar enough).

    Every candidate pair is verified, but none is listed. Edge cases as in jaccard_links. Ids are counted once; ids that one representative stands for count as equal.
    """
    with scratch(docs.sparkSession):
        join = _Join(docs, size, percent, width, hot)
        links = join.links(join.anchored())
        others = links.groupBy("id").agg(F.sum("links").alias("others"))
        counts = join.sizes().join(others.hint("merge"), F.col("representative") == F.col("id"), "left").select("representative", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
        n_links = F.when(F.col("n_shingles") > 0, F.col("links")).otherwise(F.lit(0)).cast("long")
        joined = join.with_components(links).join(counts.hint("merge"), "representative", "left")
        return written(joined.select("doc_id", "n_shingles", "component_id", n_links.alias("n_links")), "joined", keep=True)


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, width: int = SKETCH_WIDTH, hot: int = HOT_GRAM) -> DataFrame:
    """doc_id, n_shingles and component_id of jaccard_join(), from just enough links to connect whatever all links connect.

    Each document is verified against its anchor first. What that connects does not meet again, and no pair is verified twice.
    """
    with scratch(docs.sparkSession):
        join = _Join(docs, size, percent, width, hot)
        near = join.anchored()
        own = near.where("id != anchor").select("id", "anchor", "chunk")
        block = F.xxhash64("anchor", "chunk").alias("block")
        star = own.select("id", block, F.lit(1).cast("long").alias("chunk")).unionByName(own.select(F.col("anchor").alias("id"), block, F.lit(0).cast("long").alias("chunk")).distinct())
        # an id may be a centre and a member: its sets travel once as either
        first = written(verified(join.docs, join.wanted(near, star), size, percent), "stars")
        of = connected_components(first.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("part"))
        apart = near.join(of.hint("merge"), "id", "left").withColumn("part", F.coalesce("part", "id"))
        links = first.unionByName(join.links(written(apart, "apart")))
        return written(join.with_components(links).select("doc_id", "n_shingles", "component_id"), "joined", keep=True)
