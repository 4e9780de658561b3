"""Packing of tokenised documents into fixed windows by Karmarkar-Karp multiway differencing.

Every document is tokenised once. Whole windows are cut from its front; the rest, shorter than a
window, is one piece. Pieces are dealt at random (by hash) into groups of bounded size, and
each group is partitioned into near-equal windows by differencing: the two partial
partitions with the largest imbalance are merged, largest sums onto smallest, until one is left.
Starting from the least possible number of windows, that number rises until no window is over capacity.
"""

from __future__ import annotations

import heapq
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.arrays import slices
from marketloom.llm.storage import kept, unused

CAPACITY = 4096
SEPARATOR = 2
#: Pieces that are balanced together, on average.
GROUP_PIECES = 1024
#: Distinct words whose ids a worker remembers, some 50 MB.
CACHED_WORDS = 250_000


#: Ends of words that can be tokenised apart from them: signs after an ASCII letter and before white space.
_SIGNS = re.compile(rb"[.,;:!?*&%$#](?<=[A-Za-z].)[.,;:!?*&%$#]*(?=[ \n])")
#: Stands between words that are tokenised in one call; a special token of the vocabulary is never merged.
_FENCE = "<|startoftext|>"


#: Words of these letters only are one unit of the vocabulary's patterns, and no normal form or lower case splits or joins them.
_LETTERS = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")


class WordIds:
    """Token ids of whole texts, by a cache of the ids of white-space separated words.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its words.
    It also ignores case and keeps letters and signs apart, which lets words share entries.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.fence = self.tokenizer.token_to_id(_FENCE)
        #: Of each id, whether it ends a word: only the last id of a unit does.
        self.ends_word = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.code: dict[bytes, int] = {}
        self.passed = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.length, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _encode(self, fresh: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
        """Of each word, where its ids start and end in an array. Words of letters are cut after the ids that end words, others at fences."""
        texts = [w.decode("utf-8", "replace") for w in fresh]
        plain = [i for i, t in enumerate(texts) if _LETTERS.fullmatch(t)]
        out: list = [None] * len(texts)
        for some in (plain[i : i + 500] for i in range(0, len(plain), 500)):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in some])], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                for i, a, b in zip(some, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                    out[i] = (a, b, ids)
        others = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(others, self._fenced([texts[i] for i in others]), strict=True):
            out[i] = x
        return out

    def _fenced(self, texts: list[str]) -> list[tuple[int, int, np.ndarray]]:
        out = []
        for i in range(0, len(texts), 500):
            some = texts[i : i + 500]
            joined = _FENCE.join(some)
            if self.fence is not None and joined.count(_FENCE) == len(some) - 1:
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(ids == self.fence)
                out += zip(np.append(0, cuts + 1).tolist(), np.append(cuts, len(ids)).tolist(), [ids] * len(some), strict=True)
            else:
                each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                out += ((0, len(x), x) for x in each)
        return out

    def learn(self, fresh: list[bytes]) -> None:
        first, used = len(self.code), self.used
        encoded = self._encode(fresh)
        sizes = np.array([b - a for a, b, _ in encoded], np.int64)
        total = int(sizes.sum())
        while used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(fresh) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.length[first : first + len(fresh)] = sizes
        self.start[first : first + len(fresh)] = used + np.cumsum(sizes) - sizes
        self.ids[used : used + total] = np.concatenate([np.zeros(0, np.uint32), *(x[a:b] for a, b, x in encoded)])
        self.used += total
        self.code.update(zip(fresh, range(first, first + len(fresh)), strict=True))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n + 1 offsets."""
        words = [(_SIGNS.sub(rb" \g<0>", t) if b"<|" in t else _SIGNS.sub(rb" \g<0>", t.lower())).split() for t in texts]
        flat = list(itertools.chain.from_iterable(words))
        # once the cache is full, the words it lacks, rare ones, are forgotten again; when they have become many, it starts anew
        if self.passed > 4 * self.limit:
            self.clear()
        known, used = len(self.code), self.used
        if fresh := list(set(flat).difference(self.code)):
            self.learn(fresh)
        codes = np.fromiter(map(self.code.__getitem__, flat), np.int64, len(flat))
        sizes = self.length[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.start[codes] - ends[:-1], sizes) + np.arange(ends[-1])]
        if fresh and known > self.limit:
            for word in fresh:
                del self.code[word]
            self.used, self.passed = used, self.passed + len(fresh)
        return ids, ends[np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)]


def word_ids(path: str) -> WordIds:
    """One cache for all tasks of a worker, as long as no other operator's tasks come."""
    return kept(("word_ids", path), lambda: WordIds(path))


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Pieces of at most `capacity` ids that cover each document's ids, with `separator` as its last id."""

    def cut(batches):
        words = word_ids(tokenizer)
        for batch in batches:
            for part, data, at in slices(batch):
                raw = data.tobytes()
                ids, ends = words.encode([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                names = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                rows: list[tuple] = []
                for name, a, b in zip(names, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(separator)).astype("<u4")
                    rows += ((name, i, min(capacity, len(own) - i), zlib.crc32(own[i : i + capacity].tobytes()), len(own)) for i in range(0, len(own), capacity))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _PIECES)


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Splits item numbers into `windows` lists of near-equal total size by multiway differencing."""
    # An entry: its spread, a running number, its non-zero sums with their items; all sums negated, so that the largest come first.
    heap = [(-s, i, [(-s, i, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = itertools.count(len(sizes))
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        free = windows - len(b)  # so many of the largest sums of a meet a zero of b
        over = max(0, len(a) - free)
        merged = [*a[:free], *b[: len(b) - over], *((x[0] + y[0], next(number), (x[2], y[2])) for x, y in zip(a[free:], reversed(b[len(b) - over :]), strict=True))]
        merged.sort()
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (spread, next(number), merged))

    def items(tree: tuple) -> list[int]:
        out, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(reversed(x))
            else:
                out.append(x)
        return out

    return [items(x[2]) for x in heap[0][2]] if heap else []


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of near-equal size, none over `capacity`, starting from the least number that could hold the items."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, windows)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        windows += max(1, windows // 512)


def pack(cut: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, start, length, ...); other columns stay.

    Groups are dealt by a hash of the row and its number among equal rows, so that repeated documents spread over groups like others and are
    packed as separate pieces. Columns named sequence_id and offset are replaced. No rows give no rows.
    """
    cut = cut.drop("sequence_id", "offset")
    names = cut.columns
    fields = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"

    group = unused(cut, "group")

    def place(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes = table.column("length").to_pylist()
        sequence, offset, window = [0] * len(sizes), [0] * len(sizes), 0
        for i, s in enumerate(sizes):
            if s == capacity:
                sequence[i], window = window, window + 1
        rest = [i for i, s in enumerate(sizes) if s < capacity]
        for part in balanced([sizes[i] for i in rest], capacity):
            at = 0
            for j in part:
                sequence[rest[j]], offset[rest[j]], at = window, at, at + sizes[rest[j]]
            window += 1
        base = key[0].as_py() << 32
        return table.select(names).append_column("sequence_id", pa.array([base + x for x in sequence], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    # equal rows are counted and numbered, so that copies are dealt to different groups too
    copy = unused(cut, "copy")
    many = cut.groupBy(*names).agg(F.count("*").alias(copy)).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copy)))
    dealt = many.withColumn(group, F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", copy), F.lit(groups))).drop(copy)
    return dealt.groupBy(group).applyInArrow(place, fields)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Packs documents(doc_id, text, ...) into windows of at most `capacity` ids.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Null or empty text: only the separator. A null doc_id stays null. Repeated rows are packed as often as they
    occur. Documents longer than a window are cut at its multiples. Other columns are ignored.
    """
    groups = max(1, -(-docs.count() // GROUP_PIECES))
    return pack(pieces(docs, tokenizer, capacity, separator), groups, capacity)
