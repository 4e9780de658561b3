"""Sampled SentencePiece segmentations and lossless decoding.

All segmentations of a text into pieces of a vocabulary form a lattice. Its paths have the product of
their pieces' weights (a vocabulary of merges gives ranks only; a piece of rank r weighs 1 / (r + 2), to the power alpha). A
path is drawn exactly: forward filtering sums the weights of all ways to each place, backward sampling walks from
the end, drawing each last piece by its share. Draws depend only on the seed, the row's key and the place.

No piece crosses a blank from the left or holds a line feed, so the lattice falls apart at blanks and lines; the parts that
are equal in a slice of texts are filtered once, and all their occurrences are sampled side by side.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.arrays import U64, mix, slices
from marketloom.llm.language_id import HashTable
from marketloom.llm.storage import unused

_CHUNKS = re.compile(r" +[^ \n]*|\n|[^ \n]+")
_STEP = U64(0xA0761D6478BD642F)
SLICE = 4 << 20


class Vocabulary:
    """Pieces of a SentencePiece model with byte fallback, as tables over prefixes of code points."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte = np.full(256, -1, np.int64)
        self.surface: list[bytes] = [b""] * n
        prefixes: dict[str, int] = {}
        rank = 0
        self.weight = np.zeros(n)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                if "\n" in text or " " in text.lstrip(" "):
                    continue  # would cross a border of the lattice's parts
                self.surface[i] = text.encode()
                self.weight[i] = -np.log(rank + 2.0)
                rank += 1
                for k in range(1, len(text)):
                    prefixes.setdefault(text[:k], -1)
                prefixes[text] = i
        if (self.byte < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.byte_weight = -np.log(n + 2.0)
        keys = np.array([self._key(p) for p in prefixes], U64)
        self.table = HashTable(keys, np.array([*prefixes.values()]))
        self.longest = max(map(len, prefixes))

    @staticmethod
    def _key(text: str) -> int:
        key = np.zeros(1, U64)
        for c in text:
            key = mix(key * _STEP + U64(ord(c)))
        return int(key[0])

    def lattice(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """Edges of all chunks' lattices: node from, node to, piece (-1 - code point where only its bytes fit), and the nodes' offsets."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
        base = np.concatenate([[0], np.cumsum(sizes + 1)])
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        node = np.arange(len(codes)) + chunk
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
        key, alive = np.zeros(len(codes), U64), np.arange(len(codes))
        starts, ends, pieces, single = [], [], [], np.zeros(len(codes), bool)
        for k in range(1, self.longest + 1):
            alive = alive[room[alive] >= k]
            if not len(alive):
                break
            key[alive] = mix(key[alive] * _STEP + codes[alive + k - 1])
            row = self.table.find(key[alive])
            alive, row = alive[row >= 0], row[row >= 0]
            piece = self.table.values[row, 0].astype(np.int64) if self.table.values.ndim > 1 else self.table.values[row].astype(np.int64)
            whole = piece >= 0
            at = alive[whole]
            if k == 1:
                single[at] = True
            starts.append(node[at])
            ends.append(node[at] + k)
            pieces.append(piece[whole])
        lone = np.flatnonzero(~single)
        starts.append(node[lone])
        ends.append(node[lone] + 1)
        pieces.append(-1 - codes[lone].astype(np.int64))
        a, b, p = (np.concatenate(x) for x in (starts, ends, pieces))
        order = np.lexsort((a, b))
        return a[order], b[order], p[order], base

    def byte_count(self, pieces: np.ndarray) -> np.ndarray:
        """Ids that each piece of a lattice stands for."""
        c = -1 - pieces
        return np.where(pieces >= 0, 1, 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def forward_filter(vocab: Vocabulary, chunks: list[str], alpha: float) -> tuple[np.ndarray, ...]:
    """Of all chunks' lattices: edges by their end (first edge of each node, node from, piece, cumulated share), and the nodes' offsets."""
    a, b, p, base = vocab.lattice(chunks)
    nodes = int(base[-1])
    weight = alpha * np.where(p >= 0, vocab.weight[np.maximum(p, 0)], vocab.byte_count(p) * vocab.byte_weight)
    first = np.searchsorted(b, np.arange(nodes + 1))
    depth = np.arange(nodes) - np.repeat(base[:-1], np.diff(base))
    total = np.full(nodes, -np.inf)
    total[base[:-1]] = 0
    by_depth = np.argsort(depth[b], kind="stable")
    cuts = np.searchsorted(depth[b][by_depth], np.arange(1, int(depth.max(initial=0)) + 2))
    value = np.zeros(len(b))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        e = by_depth[i:j]
        v = total[a[e]] + weight[e]
        value[e] = v
        new = np.flatnonzero(np.concatenate([[True], b[e][1:] != b[e][:-1]]))
        top = np.maximum.reduceat(v, new)
        total[b[e][new]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(new, len(e))))), new))
    share = np.exp(value - total[b])
    run = np.cumsum(share)
    cumulated = run - np.repeat(np.concatenate([[0], run])[first[:-1]], np.diff(first))
    return first, a, p, cumulated, base


def sample(vocab: Vocabulary, texts: list[str], keys: np.ndarray, alpha: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a sampled segmentation of each text, in a row, and the n + 1 offsets. A blank is put before each text."""
    parts = [_CHUNKS.findall(" " + t) for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    index: dict[str, int] = {}
    chunk = np.fromiter((index.setdefault(c, len(index)) for own in parts for c in own), np.int64, int(counts.sum()))
    if not len(chunk):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    first, a, p, cumulated, base = forward_filter(vocab, list(index), alpha)
    begin = np.cumsum(counts) - counts
    place = np.arange(len(chunk)) - np.repeat(begin, counts)
    draw = mix(np.repeat(mix(keys.astype(np.int64).view(U64) ^ mix(np.array([seed], U64))), counts) + place.astype(U64) * _STEP)
    node, active, steps = base[chunk + 1] - 1, np.arange(len(chunk)), []
    taken = np.zeros(len(chunk), np.int64)
    while len(active):
        at = node[active]
        u = (mix(draw[active] + U64(len(steps))) >> U64(11)) * (1.0 / (1 << 53))
        e, last = first[at], first[at + 1] - 1
        wait = np.flatnonzero((cumulated[e] <= u) & (e < last))
        while len(wait):
            e[wait] += 1
            wait = wait[(cumulated[e[wait]] <= u[wait]) & (e[wait] < last[wait])]
        steps.append((active, p[e]))
        taken[active] += 1
        node[active] = a[e]
        active = active[node[active] != base[chunk[active]]]
    ends = np.cumsum(taken)
    pieces = np.zeros(int(ends[-1]), np.int64)
    for k, (own, piece) in enumerate(steps):  # the k-th drawn is the k-th from the chunk's end
        pieces[ends[own] - 1 - k] = piece
    size = vocab.byte_count(pieces)
    place = np.concatenate([[0], np.cumsum(size)])
    ids = np.zeros(int(place[-1]), np.int32)
    ids[place[:-1]] = np.maximum(pieces, 0)
    for i in np.flatnonzero(pieces < 0).tolist():
        raw = chr(-1 - pieces[i]).encode("utf-8", "surrogatepass")
        ids[place[i] : place[i] + len(raw)] = vocab.byte[list(raw)]
    return ids, place[np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]]


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids, without the blank that encoding put before it."""
    raw = b"".join([vocab.surface[i] for i in ids.tolist()])
    return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """Adds ids (array<int>): a segmentation of the column `text` sampled by the weights, seeded by `seed` and the row's `key`.

    A higher alpha favours frequent, longer pieces. Null text gives null, empty text the lone blank's id. Equal keys and
    texts give equal ids, on any partitioning; a null key counts as one key. All other columns stay; a column named ids is overwritten.
    """
    docs = docs.drop("ids")
    hashed = unused(docs, "hashed")
    tagged = docs.withColumn(hashed, F.xxhash64(F.col(key).cast("string")))
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", ids array<int>"

    def run(batches):
        vocab = vocabulary(model)
        for batch in batches:
            for part, data, at in slices(batch, text, SLICE):
                ids, ends = _sampled(vocab, part, hashed, data, at, alpha, seed)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=part.column(part.schema.get_field_index(text)).is_null())
                own = [c for c, n in zip(part.columns, part.schema.names, strict=True) if n != hashed]
                yield pa.RecordBatch.from_arrays([*own, lists], [*(n for n in part.schema.names if n != hashed), "ids"])

    return tagged.mapInArrow(run, schema)


def _sampled(vocab: Vocabulary, part: pa.RecordBatch, hashed: str, data: np.ndarray, at: np.ndarray, alpha: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return sample(vocab, texts, part.column(part.schema.get_field_index(hashed)).to_numpy(), alpha, seed)


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """Adds decoded (string): the text of the column `ids`; null for null. Other columns stay."""
    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes if n != "decoded") + ", decoded string"

    def run(batches):
        vocab = vocabulary(model)
        for batch in batches:
            texts = [decode_ids(vocab, x.values.to_numpy()) if x.is_valid else None for x in batch.column(batch.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.drop("decoded").mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, n_chars, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 of every row of documents(doc_id, text, ...).

    Encodes and decodes each whole text in one pass. Null text counts as empty.
    """
    tagged = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.col("doc_id").cast("string")).alias("hashed"))

    def run(batches):
        vocab = vocabulary(model)
        for batch in batches:
            for part, data, at in slices(batch, "text", SLICE):
                ids, ends = _sampled(vocab, part, "hashed", data, at, alpha, seed)
                out = []
                for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = ids[x:y]
                    text = decode_ids(vocab, own)
                    out.append((len(text), len(own), zlib.crc32(own.astype("<u4").tobytes()), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
                n, m, crc, sha = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha)], ["doc_id", "n_chars", "n_ids", "ids_crc32", "decoded_sha256"])

    return tagged.mapInArrow(run, "doc_id long, n_chars long, n_ids long, ids_crc32 long, decoded_sha256 string")
