"""Benchmark decontamination with an FM-index of words per shard of training documents.

1. index: a shard of some megabytes of whole documents is a sequence of words with a separator after each document. Its
   suffixes are sorted by prefix doubling (full order, separators distinct), and the words before them, the Burrows-Wheeler
   transform, are kept in a wavelet matrix. The suffix positions are sampled: every SAMPLE-th word of a document and its first;
2. search: each test phrase is searched backwards, a word at a time, by ranks in the wavelet matrix, all phrases of a length together;
   phrases with a word that the shard doesn't have are dropped at once;
3. locate: each row found walks back word by word to a sampled suffix;
4. merge: the words that occurrences cover become maximal spans of each document, which are removed.

An index does not depend on the benchmark: index_shards() can be written once and searched for many. The benchmark goes to the tasks
in blocks of bounded size; each further block is another pass over the written index.
"""

from __future__ import annotations

import pickle
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.arrays import BYTE_CODES, slices, span_hashes
from marketloom.llm.storage import written

#: Bytes of whole texts (or one longer text) that are indexed together.
SHARD_BYTES = 8 << 20
#: Words of a window; every SAMPLE-th word of a document has its position kept.
WINDOW, SAMPLE = 10, 8
#: Words of the benchmark that tasks get at once, 8 bytes each.
BLOCK_WORDS = 2 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Codes of bytes in which A to Z count as a to z.
_CODES = BYTE_CODES.copy()
_CODES[0x41:0x5B] = BYTE_CODES[0x61:0x7B]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the first word of each text with the number of words at the end."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[at] = False
    starts = np.flatnonzero(inside & ~before)
    stop = ~inside
    stop[at] = True
    stops = np.flatnonzero(stop)
    return starts, stops[np.searchsorted(stops, starts, "right")], np.searchsorted(starts, at)


class Bits(NamedTuple):
    """A bit vector with the number of ones before each 64-bit word."""

    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        packed = np.packbits(bits, bitorder="little")
        full = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        full[: len(packed)] = packed
        w = full.view("<u8")
        before = np.zeros(len(w), np.int32)
        np.cumsum(np.bitwise_count(w[:-1]), out=before[1:])
        return cls(w, before)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w, low = i >> 6, (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0


class Index(NamedTuple):
    """FM-index of a shard: sorted hashes of its words (their symbols are 1, 2 ..., the separator's 0), first row of each symbol,
    wavelet matrix with the zeros of each level and where each symbol starts below it, sampled rows and their positions, words by document."""

    vocabulary: np.ndarray
    first: np.ndarray
    levels: list[Bits]
    zeros: list[int]
    below: np.ndarray
    sampled: Bits
    position: np.ndarray
    sizes: np.ndarray

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place in the transform."""
        top = len(self.levels) - 1
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(i)
            i = np.where((symbol >> (top - level)) & 1, zeros + ones, i - ones)
        return i - self.below[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one word longer."""
        symbol, i = np.zeros_like(row), row
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.get(i), bits.rank(i)
            i = np.where(one, zeros + ones, i - ones)
            symbol = symbol << 1 | one
        return self.first[symbol] + i - self.below[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of phrases (rows of word hashes, one length): number of the phrase and position in the shard."""
        symbol = np.searchsorted(self.vocabulary, phrases)
        known = np.append(self.vocabulary, np.uint64(0))[symbol] == phrases if len(self.vocabulary) else np.zeros(phrases.shape, bool)
        which = np.flatnonzero(known.all(1))
        symbol = symbol[which] + 1
        low, high = self.first[symbol[:, -1]], self.first[symbol[:, -1] + 1]
        for j in range(symbol.shape[1] - 2, -1, -1):
            s = symbol[:, j]
            low, high = self.first[s] + self.rank(s, low), self.first[s] + self.rank(s, high)
            some = low < high
            which, symbol, low, high = which[some], symbol[some], low[some], high[some]
        many = high - low
        rows = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(which, many), self.locate(rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of each row's suffix. The first word of a document is sampled, so no walk leaves it."""
        out = np.zeros(len(rows), np.int64)
        open_, step = np.arange(len(rows)), 0
        while len(open_):
            done = self.sampled.get(rows)
            out[open_[done]] = self.position[self.sampled.rank(rows[done])] + step
            open_, rows, step = open_[~done], self.back(rows[~done]), step + 1
        return out


def suffixes(symbols: np.ndarray, most: int) -> np.ndarray:
    """The suffix array of symbols 0 ... most; zeros are separators, each a different one, in order of place."""
    n, apart = len(symbols), int((symbols == 0).sum())
    bits = (apart + most).bit_length()
    code = symbols + (apart - 1)
    code[symbols == 0] = np.arange(apart)
    depth = max(1, min(4, 62 // bits))
    key = np.zeros(n, np.int64)
    for j in range(min(depth, n)):
        key[: n - j] |= code[j:] << (bits * (depth - 1 - j))
    order = np.argsort(key)
    key = key[order]
    head = np.append(True, key[1:] != key[:-1])
    starts = np.flatnonzero(head)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(starts, append=n))
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))  # places of the suffixes that are not told apart yet
    while len(open_):
        own = order[open_]
        key = rank[own] * n + rank[np.minimum(own + depth, n - 1)]
        turn = np.argsort(key)
        own, key = own[turn], key[turn]
        order[open_] = own
        head = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(head)
        rank[own] = np.repeat(open_[starts], np.diff(starts, append=len(own)))
        open_ = open_[~(head & np.append(head[1:], True))]
        depth *= 2
    return order


def build(data: np.ndarray, at: np.ndarray) -> Index:
    """The index of a shard of texts."""
    starts, ends, first = words(data, at)
    sizes, docs = np.diff(first), len(at) - 1
    hashes = span_hashes(data, starts, ends, _CODES)
    order = np.argsort(hashes)
    hashes = hashes[order]
    new = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
    vocabulary = hashes[new]
    n = len(starts) + docs
    place = np.arange(len(starts)) + np.repeat(np.arange(docs), sizes)
    symbols = np.zeros(n, np.int64)
    symbols[place[order]] = np.cumsum(new)
    sa = suffixes(symbols, len(vocabulary)) if n else np.zeros(0, np.int64)
    first_row = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(vocabulary) + 1))])
    begin = np.cumsum(sizes + 1) - sizes - 1
    marked = (np.arange(n) - np.repeat(begin, sizes + 1)) % SAMPLE == 0
    marked[symbols == 0] = True
    marked = marked[sa]
    levels, zeros = [], []
    part = symbols[sa - 1].astype(np.int32)
    below, top = np.zeros(len(vocabulary) + 1, np.int64), max(1, len(vocabulary).bit_length())
    numbers = np.arange(len(vocabulary) + 1)
    for level in range(top):
        one = (part >> (top - 1 - level)) & 1 > 0
        bits = Bits.of(one)
        levels.append(bits)
        zeros.append(len(part) - int(one.sum()))
        ones = bits.rank(below)
        below = np.where((numbers >> (top - 1 - level)) & 1, zeros[-1] + ones, below - ones)
        part = np.concatenate([part[~one], part[one]])
    return Index(vocabulary, first_row, levels, zeros, below, Bits.of(marked), sa[marked].astype(np.int32), sizes)


_INDEX = "shard string, doc_id array<long>, index binary"


def index_shards(docs: DataFrame) -> DataFrame:
    """One row a shard of documents(doc_id, text, ...): shard, the documents' ids, and the index. Null texts have no words."""

    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch, limit=SHARD_BYTES):
                ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())), pa.array([pickle.dumps(build(data, at), 5)], pa.binary())], ["shard", "doc_id", "index"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _INDEX)


def hashed_items(items: DataFrame) -> DataFrame:
    """item_id as string, and the hashes of its words, of every item that has words."""

    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch):
                starts, ends, first = words(data, at)
                hashes, first = span_hashes(data, starts, ends, _CODES).view(np.int64), first.tolist()
                lists = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int64()))], ["item_id", "words"])

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item_id string, words array<long>").where("size(words) > 0")


class Phrases(NamedTuple):
    """The different windows of one length, and the items that each belongs to: owner[first[i] : first[i + 1]] (-1: an item without id)."""

    windows: np.ndarray
    first: np.ndarray
    owner: np.ndarray


def phrases(items: list[np.ndarray], names: np.ndarray, window: int) -> list[Phrases]:
    """All windows by length. names: the number of each item's id."""
    out = []
    for length in sorted({min(window, len(w)) for w in items}):
        some = [(w, i) for w, i in zip(items, names.tolist(), strict=True) if len(w) == length or (length == window and len(w) > window)]
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(w, length) for w, _ in some])
        owner = np.repeat([i for _, i in some], [len(w) - length + 1 for w, _ in some])
        windows, at = np.unique(rows, axis=0, return_inverse=True)
        order = np.argsort(at.ravel(), kind="stable")
        out.append(Phrases(windows, np.searchsorted(at.ravel()[order], np.arange(len(windows) + 1)), owner[order]))
    return out


def found_spans(index: Index, sought: list[Phrases]) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """Of each document: the maximal spans of covered words, and the numbers of the items whose windows occur."""
    sizes = index.sizes
    begin = np.cumsum(sizes + 1) - sizes - 1
    cover = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int64)
    pairs = [np.zeros((0, 2), np.int64)]
    for p in sought:
        which, position = index.search(p.windows)
        np.add.at(cover, position, 1)
        np.add.at(cover, position + p.windows.shape[1], -1)
        doc = np.searchsorted(begin, position, "right") - 1
        keys = np.unique(which * len(begin) + doc)  # each window once a document
        which, doc = np.divmod(keys, max(1, len(begin)))
        many = p.first[which + 1] - p.first[which]
        owner = p.owner[np.repeat(p.first[which] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        pairs.append(np.unique(np.stack([np.repeat(doc, many), owner], 1), axis=0))
    covered = np.cumsum(cover) > 0
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    doc = np.searchsorted(begin, edges[::2], "right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in sizes]
    for d, a, b in zip(doc.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        spans[d].append((a - int(begin[d]), b - int(begin[d])))
    items: list[list[int]] = [[] for _ in sizes]
    for d, i in np.unique(np.concatenate(pairs), axis=0).tolist():
        if i >= 0:
            items[d].append(i)
    return spans, items


_SPANS = "array<struct<start:long,end:long>>"
_FOUND = f"shard string, place int, doc_id long, n_words long, spans {_SPANS}, items array<string>"


def _search(index: DataFrame, rows: list, window: int) -> DataFrame:
    """The spans and items of every document of the index, for a block of items."""
    ids = sorted({r.item_id for r in rows if r.item_id is not None})
    number = {x: i for i, x in enumerate(ids)}
    hashes, names = [np.array(r.words, np.int64).view(np.uint64) for r in rows], np.array([number.get(r.item_id, -1) for r in rows], np.int64)
    sent = index.sparkSession.sparkContext.broadcast((ids, phrases(hashes, names, window)))

    def run(batches):
        ids, sought = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                own = pickle.loads(row["index"])
                spans, items = found_spans(own, sought)
                n = len(row["doc_id"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * n), pa.array(range(n), pa.int32()), pa.array(row["doc_id"], pa.int64()), pa.array(own.sizes, pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([[ids[i] for i in s] for s in items], pa.list_(pa.string())),
                    ],
                    ["shard", "place", "doc_id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(run, _FOUND)


def _joined(rows: DataFrame) -> DataFrame:
    """Merges what several blocks of items found in a document."""
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    rows = rows.groupBy("shard", "place", "doc_id", "n_words").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    grown = F.aggregate(
        "spans", F.lit([]).cast(_SPANS),
        lambda done, x: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]),
                               F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    return rows.withColumn("spans", grown)


def find(index: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK_WORDS) -> DataFrame:
    """Of every document of index_shards(): doc_id, n_words, spans (word numbers from 0, end not included) and items (sorted ids as strings).

    The items' words go to the tasks in blocks of some `block` words, with one pass over the index for each.
    """
    hashed = written(hashed_items(items), "items")
    blocks = max(1, -(-(hashed.agg(F.sum(F.size("words"))).first()[0] or 0) // block))
    if blocks > 1:
        index = written(index, "index")
    found = None
    for i in range(blocks):
        rows = hashed.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == i).collect()  # `block` words, about
        some = _search(index, rows, window)
        found = some if found is None else found.unionByName(some)
    return (found if blocks == 1 else _joined(found)).drop("shard", "place")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Finds windows of benchmark items(item_id, text, ...) in documents(doc_id, text, ...): see find().

    Words are runs of ASCII letters and digits and of characters beyond ASCII; A-Z count as a-z. A window is `window` words in a row; an item
    of fewer, but not none, is one window. Null and empty texts have no words. Every row of documents gives a row; repeated rows and ids are
    documents of their own, a null doc_id stays null. Repeated items count once; an item without id marks words, but is not named. No documents
    give no rows, no items leave every document clean. Other columns are ignored.
    """
    return find(index_shards(docs), items, window)


def remove_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with a unique, non-null doc_id and their texts without the words of the spans: `kept`, null for null.

    A span is cut from its first word's start to its last word's end; what stands around it stays.
    """

    def run(batches):
        for batch in batches:
            texts, kept = batch.column(batch.schema.get_field_index("text")).to_pylist(), []
            spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
            for text, cuts in zip(texts, spans, strict=True):
                raw = (text or "").encode()
                if cuts:
                    starts, ends, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    edges = [0, *(e for c in cuts for e in (int(starts[c["start"]]), int(ends[c["end"] - 1]))), len(raw)]
                    raw = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                kept.append(None if text is None else raw.decode())
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_spans"} | {"kept": pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    docs = docs.drop("kept", "_spans")
    joined = docs.join(found.select("doc_id", F.col("spans").alias("_spans")).hint("shuffle_hash"), "doc_id", "left")
    fields = ", ".join(f"`{n}` {t}" for n, t in joined.drop("_spans").dtypes) + ", kept string"
    return joined.mapInArrow(run, fields)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document, see decontaminate()."""
    found = decontaminate(docs, items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
