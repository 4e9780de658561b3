"""Alignment of two tokenizers' tokens by byte offsets, with corpus-wide counts of linked id pairs.

Counting is external: no pair's records need to be in memory together.

1. spill: a shard of some megabytes of whole texts is tokenised by both vocabularies (A and B) and aligned. Its pair-document
   records (B id, A id, document, links) are radix-partitioned by the low bits of the B id, sorted with the B id as the major
   key, and kept as one zstd run a partition; a run has its pairs with their sums and, apart from them, its documents;
2. merge: the pairs of a partition's runs meet, at most FAN runs a group and as many levels as it takes, in a k-way heap merge that
   adds up each pair's count. Since B ids come one after the other, each one's highest count is known when it has passed;
3. stream back: shards are read again; each partition's run walks along the merged counts and adds to its documents'
   contributions. A shard holds whole documents, so nothing is shuffled for that.

A frequent id has one entry a shard and partner in step 2, however often it occurs, so no partition is hot.

Texts are tokenised by units, the stretches between blanks that follow anything but white space: neither vocabulary merges across
them, so a unit has the same ids everywhere, and a worker keeps those it has met, with their links.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.arrays import slices, span_hashes
from marketloom.llm.storage import written

#: Bytes of whole texts (or one longer text) whose records are sorted together.
SHARD_BYTES = 4 << 20
#: Radix partitions, by the low bits of the B id; runs that are merged at once; pairs that a run gives to the merge at once.
RADIX, FAN, BLOCK = 256, 64, 1024
#: Bytes of merged counts that tasks get at once; more are streamed back in several passes.
COUNT_BYTES = 64 << 20
#: Units that a worker remembers, some 80 MB.
CACHED_UNITS = 400_000
#: Bytes of units that are tokenised in one call.
CALL_BYTES = 1 << 14
_A_BITS, _B_BITS = 24, 24


def _byte_level() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: visible Latin-1 ones for themselves, the others from 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Side:
    """A vocabulary: the bytes of each id, and ids of strings that begin with a blank."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer, table = Tokenizer.from_file(path), _byte_level()
            tokenizer.encode_special_tokens = True
            self.token = [b""] * tokenizer.get_vocab_size()
            for text, i in tokenizer.get_vocab().items():
                self.token[i] = bytes(table[c] for c in text) if all(c in table for c in text) else text.encode()
            self.encode = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
        else:
            from sentencepiece import SentencePieceProcessor

            sp = SentencePieceProcessor(model_file=path)
            self.token = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.vocab_size())]
            self.encode = lambda s: sp.encode(s[1:], num_threads=1)  # it adds the blank itself
        self.size = np.array([len(t) for t in self.token], np.int64)

    def ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has; -1 where the ids' bytes are not the unit's."""
        flat, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for some in _calls(units):
            ids, n = self._together(some)
            if n is None:
                each = [self._together([u]) for u in some]
                ids, n = np.concatenate([x for x, m in each if m is not None] or [ids[:0]]), np.array([-1 if m is None else m[0] for _, m in each])
            flat.append(ids)
            many.append(n)
        return np.concatenate(flat), np.concatenate(many)

    def _together(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray | None]:
        """Units end where a blank follows no white space, so ids of their string are those of each; None if they are not."""
        joined = b"".join(units)
        ids = self.encode(joined.decode("utf-8", "replace"))
        if b"".join([self.token[i] for i in ids]) != joined:
            return np.zeros(0, np.int64), None
        ids = np.array(ids, np.int64)
        ends, cuts = np.cumsum(self.size[ids]), np.cumsum(list(map(len, units)))
        at = np.searchsorted(ends, cuts)
        return ids, np.diff(at, prepend=-1) if (ends[at] == cuts).all() else None


def _calls(units: list[bytes]) -> Iterator[list[bytes]]:
    """Units for one call each: those that end in white space or are long are alone."""
    some: list[bytes] = []
    size = 0
    for u in units:
        alone = len(u) > CALL_BYTES or u[-1] <= 0x20 or u[-1] == 0x7F or u.endswith(_WIDE_BLANKS)
        if some and (alone or size + len(u) > CALL_BYTES):
            yield some
            some, size = [], 0
        some.append(u)
        size += len(u)
        if alone:
            yield some
            some, size = [], 0
    if some:
        yield some


#: White space beyond ASCII, and what some count as such.
_WIDE_BLANKS = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, 0x3000))


def _no_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is surely no white space. data begins with a blank."""
    last, second, third = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = last >= 0x80
    blank = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
    blank |= (third == 0xE1) & (((second == 0x9A) & (last == 0x80)) | ((second == 0xA0) & (last == 0x8E)))
    blank |= (third == 0xE2) & (((second == 0x80) & ((last <= 0x8F) | ((last >= 0xA8) & (last <= 0xAF)))) | ((second == 0x81) & (last == 0x9F)))
    blank |= (third == 0xE3) & (second == 0x80) & (last == 0x80)
    return np.where(wide, ~blank, (last > 0x20) & (last < 0x7F))


class Units:
    """Units met so far, by hash: counts of ids, groups and links, the linked pairs, and the groups as text."""

    def __init__(self, a: str, b: str, limit: int = CACHED_UNITS):
        self.a, self.b, self.limit = _Side(a), _Side(b), limit
        if len(self.a.token) >> _A_BITS or len(self.b.token) >> _B_BITS:
            raise ValueError("vocabularies of more than 2**24 ids are not supported")
        self.digits = np.frombuffer("".join(f"{i:<9}" for i in range(max(len(self.a.token), len(self.b.token)))).encode(), np.uint8).reshape(-1, 9)
        self.clear()

    def clear(self) -> None:
        self.hash, self.code = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        #: n_a, n_b, n_groups, n_links; n_a is -1 for units whose ids' bytes differ from theirs.
        self.sizes = np.zeros((4, 0), np.int64)
        self.first, self.link = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pairs, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.text, self.text_end = bytearray(), np.zeros(1, np.int64)

    def codes(self, hashes: np.ndarray, units: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
        """Numbers of the units of these hashes, which are sorted and distinct; `units` gives those of the wanted places."""
        at = np.searchsorted(self.hash, hashes)
        fresh = np.flatnonzero(np.append(self.hash, np.uint64(0))[at] != hashes) if len(self.hash) else np.arange(len(hashes))
        if len(fresh):
            code = np.arange(len(fresh)) + len(self.first)
            self._learn(units(fresh))
            self.code, self.hash = np.insert(self.code, at[fresh], code), np.insert(self.hash, at[fresh], hashes[fresh])
        return self.code[np.searchsorted(self.hash, hashes)]

    def _learn(self, fresh: list[bytes]) -> None:
        (a, many_a), (b, many_b) = self.a.ids(fresh), self.b.ids(fresh)
        good = (many_a >= 0) & (many_b >= 0)
        a, b = a[np.repeat(good, np.maximum(many_a, 0))], b[np.repeat(good, np.maximum(many_b, 0))]
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        ends = np.sort(np.concatenate([end_a, end_b]))
        ends = ends[np.diff(ends, prepend=0) > 0]  # the stretch before each of these is shared by one id of either side
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = np.flatnonzero((end_a[at_a] == ends) & (end_b[at_b] == ends)) if len(ends) else np.zeros(0, np.int64)
        stop = np.cumsum(np.array(list(map(len, fresh)))[good])
        sizes = np.full((4, len(fresh)), 0)
        sizes[0] = -1
        sizes[:, good] = [many_a[good], many_b[good], np.diff(np.searchsorted(ends[both], stop, "right"), prepend=0), np.diff(np.searchsorted(ends, stop, "right"), prepend=0)]
        self.first = np.concatenate([self.first, len(self.link) + np.cumsum(sizes[3]) - sizes[3]])
        self.sizes = np.concatenate([self.sizes, sizes], axis=1)
        self.link = np.concatenate([self.link, self._numbers(_keys(a[at_a], b[at_b]))])
        self._texts(a, b, at_a[both] + 1, at_b[both] + 1, sizes)

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of pairs in the order in which they were met."""
        seen = np.sort(keys)
        seen = seen[np.append(True, seen[1:] != seen[:-1])] if len(seen) else seen
        new = seen[~np.isin(seen, self.pairs, kind="sort")]
        self.pairs = np.concatenate([self.pairs, new])
        self.order = np.argsort(self.pairs)
        return self.order[np.searchsorted(self.pairs, keys, sorter=self.order)].astype(np.int32)

    def _texts(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, sizes: np.ndarray) -> None:
        """Adds each unit's groups, `a1,a2|b1;` and so on, to the text kept."""
        many_a, many_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        place_a = np.arange(len(a)) + np.repeat(to_b - many_b, many_a)
        place_b = np.arange(len(b)) + np.repeat(to_a, many_b)
        ids, sign = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        sign[place_a[to_a - 1]], sign[place_b[to_b - 1]] = ord("|"), ord(";")
        made, bounds = [], [0]
        for i in range(0, len(ids), 1 << 17):
            cell = np.append(self.digits[ids[i : i + (1 << 17)]], sign[i : i + (1 << 17), None], axis=1)
            shown = cell != ord(" ")
            made.append(cell[shown].tobytes())
            bounds.append(shown.sum(1))
        ends = np.cumsum(np.concatenate([[0], *bounds[1:]]))
        own = np.cumsum(np.maximum(sizes[0], 0) + sizes[1])
        self.text_end = np.concatenate([self.text_end, self.text_end[-1] + ends[own]])
        self.text += b"".join(made)


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs as numbers in order of radix partition, B id, A id."""
    return ((b % RADIX).astype(np.uint64) << np.uint64(_A_BITS + _B_BITS)) | (b.astype(np.uint64) << np.uint64(_A_BITS)) | a.astype(np.uint64)


@cache
def _units(a: str, b: str) -> Units:
    """One cache for all tasks of a worker."""
    return Units(a, b)


def _packed(x: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _pack_pairs(keys: np.ndarray, counts: np.ndarray, rows: np.ndarray | None = None) -> bytes:
    """Sorted pairs with their counts, and the numbers of their records."""
    return _packed(np.concatenate([np.diff(keys, prepend=np.uint64(0)), counts.astype(np.uint64), *([] if rows is None else [rows.astype(np.uint64)])]), "<u8")


def _unpack_pairs(blob: bytes, planes: int) -> list[np.ndarray]:
    x = _unpacked(blob, "<u8").reshape(planes, -1)
    return [np.cumsum(x[0], dtype=np.uint64), *x[1:]]


def occurrences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts, none empty, with a blank before each; starts and ends of their units, and the text of each."""
    begin = at[:-1] + np.arange(len(at) - 1)
    data = np.insert(data, at[:-1], np.uint8(0x20))
    cut = data == 0x20
    cut[begin[1:] - 1] = cut[-1] = cut[0] = False  # a blank at the end of a text is no unit
    inner = np.flatnonzero(cut)
    cut[inner[~_no_space(data, inner)]] = False
    cut[begin] = True
    starts = np.flatnonzero(cut)
    return data, starts, np.append(starts[1:], len(data)), np.searchsorted(begin, starts, "right") - 1


class Spilled:
    """Tokenises and aligns a shard of texts, and spills its pair-document records as runs."""

    def __init__(self, units: Units):
        self.units = units

    def shard(self, data: np.ndarray, at: np.ndarray, with_groups: bool) -> dict:
        known, n = self.units, len(at) - 1
        if len(known.first) > known.limit:
            known.clear()
        sizes, texts = np.zeros((4, n), np.int64), [b""] * n
        whole = np.flatnonzero(np.diff(at))
        pairs, rows = [b""] * RADIX, [b""] * RADIX
        if len(whole):
            buffer, starts, ends, text = occurrences(data, np.append(at[whole], at[-1]))
            code = self._codes(buffer, starts, ends)
            bad = np.bincount(text, known.sizes[0][code] < 0, len(whole)) > 0
            for j in range(4):
                sizes[j, whole] = np.where(bad, 0, np.bincount(text, known.sizes[j][code], len(whole)).astype(np.int64))
            bounds = np.searchsorted(text, np.arange(len(whole) + 1)).tolist()
            for k, i in enumerate(whole.tolist()):
                if not bad[k]:
                    own = code[bounds[k] : bounds[k + 1]]
                    texts[i] = b"".join([known.text[a:b] for a, b in zip(known.text_end[own].tolist(), known.text_end[own + 1].tolist(), strict=True)])[:-1]
            keep = ~bad[text]
            self._records(code[keep], whole[text[keep]], n, pairs, rows)
        groups = [t.decode() for t in texts] if with_groups else None
        return {"n": n, "sizes": sizes, "groups": groups, "sha256": [hashlib.sha256(t).hexdigest() if t else "" for t in texts], "pairs": pairs, "rows": rows}

    def _codes(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each unit."""
        hashes = span_hashes(buffer, starts, ends)
        order = np.argsort(hashes)
        hashes = hashes[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        where, raw = order[new], buffer.tobytes()
        known = self.units.codes(hashes[new], lambda at: [raw[a:b] for a, b in zip(starts[where[at]].tolist(), ends[where[at]].tolist(), strict=True)])
        code = np.empty(len(order), np.int64)
        code[order] = known[np.cumsum(new) - 1]
        return code

    def _records(self, code: np.ndarray, doc: np.ndarray, n: int, pairs: list[bytes], rows: list[bytes]) -> None:
        """Records of (pair, document) in order with the sum of their links, cut into runs by radix partition."""
        known, units = self.units, len(self.units.first)
        one = np.sort(doc * units + code)
        new = np.flatnonzero(np.diff(one, prepend=-1))
        times = np.diff(new, append=len(one))
        doc, code = np.divmod(one[new], units)
        links = known.sizes[3][code]
        spread = np.repeat(known.first[code] - np.cumsum(links) + links, links) + np.arange(links.sum())
        if not len(spread):
            return
        used = np.zeros(len(known.pairs), bool)
        used[known.link[spread]] = True
        used = known.order[used[known.order]]
        own, ranks = known.pairs[used], np.zeros(len(known.pairs), np.int64)
        ranks[used] = np.arange(len(used))
        at = ranks[known.link[spread]] * n + np.repeat(doc, links)
        weight = np.repeat(times, links)
        bits = int(weight.max()).bit_length()
        if (len(own) * n).bit_length() + bits <= 63:
            packed = np.sort(at << bits | weight)
            at, weight = packed >> bits, packed & ((1 << bits) - 1)
        else:
            order = np.argsort(at, kind="stable")
            at, weight = at[order], weight[order]
        new = np.flatnonzero(np.diff(at, prepend=-1))
        weight, at = np.add.reduceat(weight, new), at[new]
        rank, doc = np.divmod(at, n)
        first = np.searchsorted(rank, np.arange(len(own) + 1))
        total = np.add.reduceat(weight, first[:-1])
        part = (own >> np.uint64(_A_BITS + _B_BITS)).astype(np.int64)
        bound = np.searchsorted(part, np.arange(RADIX + 1))
        for p in np.unique(part).tolist():
            a, b = bound[p], bound[p + 1]
            pairs[p] = _pack_pairs(own[a:b], total[a:b], np.diff(first[a : b + 1]))
            rows[p] = _packed(np.concatenate([doc[first[a] : first[b]], weight[first[a] : first[b]]]), "<u4")


_SHARDS = "shard string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, groups_sha256 array<string>, pairs array<binary>, rows array<binary>"


def spill(docs: DataFrame, a: str, b: str, with_groups: bool = False) -> DataFrame:
    """One row a shard: its documents' counts, and its runs by radix partition. Written, as each later step reads it again."""

    def run(batches):
        spilled = Spilled(_units(a, b))
        for batch in batches:
            for part, data, at in slices(batch, limit=SHARD_BYTES):
                x = spilled.shard(data, at, with_groups)
                ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                row = [uuid.uuid4().hex, ids, *(s.tolist() for s in x["sizes"]), x["groups"], x["sha256"], x["pairs"], x["rows"]]
                kinds = [pa.string(), *[pa.list_(pa.int64())] * 5, *[pa.list_(pa.string())] * 2, *[pa.list_(pa.binary())] * 2]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in _SHARDS.split(", ")])

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SHARDS), "runs")


def merge(runs: list[list[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """K-way heap merge of sorted runs (pairs, counts): blocks of pairs in order, each pair once with the sum of its counts."""
    heap = [(int(keys[min(BLOCK, len(keys)) - 1]), i) for i, (keys, _) in enumerate(runs) if len(keys)]
    heapq.heapify(heap)
    place = [0] * len(runs)
    while heap:
        bound = heap[0][0]  # where the first of the runs' current blocks ends; up to it, all that the runs hold is in their current blocks
        keys, counts = [], []
        for i in [i for _, i in heap]:
            k, c = runs[i]
            end = place[i] + int(np.searchsorted(k[place[i] : place[i] + BLOCK], np.uint64(bound), "right"))
            if end > place[i]:
                keys.append(k[place[i] : end])
                counts.append(c[place[i] : end])
                place[i] = end
        while heap and heap[0][0] == bound:
            i = heap[0][1]
            k = runs[i][0]
            if place[i] < len(k):
                heapq.heapreplace(heap, (int(k[min(place[i] + BLOCK, len(k)) - 1]), i))
            else:
                heapq.heappop(heap)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys)
        keys = keys[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        yield keys[new], np.add.reduceat(counts[order], new)


def _merged(blobs: list[bytes], planes: int) -> tuple[np.ndarray, np.ndarray]:
    blocks = list(merge([_unpack_pairs(x, planes)[:2] for x in blobs]))
    return np.concatenate([k for k, _ in blocks]), np.concatenate([c for _, c in blocks])


def highest(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each pair has its B id's highest count. The pairs of a B id stand together."""
    first = np.flatnonzero(np.diff(keys >> np.uint64(_A_BITS), prepend=np.uint64(2**64 - 1)))
    most = np.maximum.reduceat(counts, first)
    return counts == np.repeat(most, np.diff(first, append=len(keys)))


def merged_counts(shards: DataFrame) -> DataFrame:
    """One row a radix partition: partition, and `counts`, its pairs in order with corpus-wide count and whether it is the B id's highest.

    A partition's pairs are at most (B ids / RADIX) x A ids, whatever the number of documents.
    """

    def gather(planes):
        def run(key, table):
            keys, counts = _merged(table.column("pairs").to_pylist(), planes)
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([uuid.uuid4().hex]), pa.array([_pack_pairs(keys, counts)], pa.binary())], ["partition", "shard", "pairs"])

        return run

    def finish(key, table):
        keys, counts = _merged(table.column("pairs").to_pylist(), 2)
        best = highest(keys, counts)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([_pack_pairs(keys, counts, best)], pa.binary())], ["partition", "counts"])

    n = shards.count()
    runs = shards.select("shard", F.posexplode("pairs").alias("partition", "pairs")).where("length(pairs) > 0").select("partition", "shard", "pairs")
    planes = 3
    while True:
        groups = -(-n // FAN)
        dealt = runs.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(max(1, groups))))
        merged = dealt.groupBy("partition", "group").applyInArrow(gather(planes), "partition int, shard string, pairs binary")
        runs, planes, n = written(merged, "merged"), 2, groups
        if groups <= 1:
            return written(runs.groupBy("partition").applyInArrow(finish, "partition int, counts binary"), "counts")


def pairs(counts: DataFrame) -> DataFrame:
    """b, a, count, best of every linked id pair, from merged_counts()."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                keys, count, best = _unpack_pairs(blob, 3)
                a, b = keys & np.uint64((1 << _A_BITS) - 1), (keys >> np.uint64(_A_BITS)) & np.uint64((1 << _B_BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(count.astype(np.int64)), pa.array(best > 0)], ["b", "a", "count", "best"])

    return counts.select("counts").mapInArrow(run, "b int, a int, count long, best boolean")


_ROWS = "shard string, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string"


def _contributions(shards: DataFrame, counts: dict[int, bytes]) -> DataFrame:
    """Rows of all documents, with what the given partitions contribute to n_best and count_sum."""
    sent = shards.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        known = {p: _unpack_pairs(x, 3) for p, x in sent.value.items()}
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["doc_id"])
                best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for p, (keys, count, high) in known.items():
                    if row["pairs"][p]:
                        own, _, records = _unpack_pairs(row["pairs"][p], 3)
                        at = np.searchsorted(keys, own)
                        doc, links = _unpacked(row["rows"][p], "<u4").reshape(2, -1).astype(np.int64)
                        times = records.astype(np.int64)
                        np.add.at(total, doc, links * np.repeat(count[at].astype(np.int64), times))
                        np.add.at(best, doc, links * np.repeat(high[at].astype(np.int64), times))
                lists = [row["doc_id"], *(row[c] for c in ("n_a", "n_b", "n_groups", "n_links")), best, total]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.string()), pa.array(np.arange(n), pa.int32()), *(pa.array(x, pa.int64()) for x in lists), pa.array(row["groups"] or [None] * n, pa.string()), pa.array(row["groups_sha256"], pa.string())],
                    [f.split()[0] for f in _ROWS.split(", ")],
                )

    return shards.mapInArrow(run, _ROWS)


def stream_back(shards: DataFrame, counts: DataFrame, limit: int = COUNT_BYTES) -> DataFrame:
    """Adds n_best and count_sum to every document: one pass over the shards for each `limit` bytes of counts (one, as a rule)."""
    passes: list[list[int]] = [[]]
    room = limit
    for p, size in sorted(tuple(r) for r in counts.select("partition", F.length("counts")).collect()):  # at most RADIX rows
        if passes[-1] and size > room:
            passes.append([])
            room = limit
        passes[-1].append(p)
        room -= size
    rows = None
    for some in passes:
        blobs = {r.partition: bytes(r.counts) for r in counts.where(F.col("partition").isin(some)).collect()} if some else {}
        found = _contributions(shards, blobs)
        rows = found if rows is None else rows.unionByName(found)
    if len(passes) > 1:
        same = [f.split()[0] for f in _ROWS.split(", ") if f.split()[0] not in ("n_best", "count_sum")]
        rows = rows.groupBy(same).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("shard", "place")


def align(docs: DataFrame, a: str, b: str, with_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """Aligns the tokens of documents(doc_id, text, ...) by two vocabularies: a byte-level one in a .json file, and a piece model.

    Returns two tables. One row per document: doc_id, n_a, n_b (ids), n_groups (stretches that end where ids of both sides end),
    n_links (occurrences of an A id and a B id that share bytes), n_best (those whose pair has the highest count of its B id in all
    documents, ties included), count_sum (of the links' counts), groups (`a1,a2|b1;a3|b2`, null unless with_groups) and
    groups_sha256. One row per pair: b, a, count, best.

    A text that is null, empty, or not given back byte for byte by either side has zeros and empty strings. Repeated rows and ids are
    documents of their own; a null doc_id stays null. No documents give no rows. Other columns are ignored.
    """
    shards = spill(docs, a, b, with_groups)
    counts = merged_counts(shards)
    return stream_back(shards, counts), pairs(counts)
