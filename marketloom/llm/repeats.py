"""Removal of long strings that repeat across documents, by prefix-free parsing.

A rolling hash over k bytes triggers phrase boundaries. The trigger is the least hash among the k-byte
strings of a window of `span` bytes, so that every string of `span` bytes holds one and equal strings have it at
the same place. (A plain modulus leaves some strings without a trigger, which would then be missed.)

1. parse: every text is cut into phrases: a trigger with the context that its strings of `span` bytes reach. Only
   hashes of both travel. A trigger of one document alone cannot repeat and is dropped; of equal contexts
   all but the smallest document's are settled; a trigger with one context only needs no more;
2. dictionary: the other contexts, once each, with their bytes;
3. order: within a bucket of triggers the contexts' suffixes are sorted on their first `span` bytes
   (a suffix array cut off there); equal neighbours are one string of the corpus, and the smallest document
   of each run owns it;
4. combine: the parse carries settled contexts and owned strings back to positions in the documents.

Documents with hot phrases do not meet in one task: equal contexts of a batch are settled there, and the
contexts of a trigger that is in very many batches are dealt by their strings, not by their trigger.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.arrays import BYTE_CODES, POWERS, U64, mix, slices

TRIGGER_BYTES = 20
#: A trigger with more contexts than this is hot.
HOT_CONTEXTS = 2_000
#: Bytes of text, on average, whose phrases' hashes meet in one group, and whose open contexts do.
HASHED_BYTES, OPEN_BYTES = 16 << 20, 4 << 20
_SETTLED, _OPEN, _HOT = 0, 1, 2


class Phrases(NamedTuple):
    """Of each phrase: its document's number, first and last start of the `span`-byte strings that it serves, hashes of trigger and context."""

    document: np.ndarray
    first: np.ndarray
    last: np.ndarray
    trigger: np.ndarray
    context: np.ndarray


def phrases(data: np.ndarray, at: np.ndarray, span: int, k: int) -> Phrases:
    """The phrases of all texts. Equal contexts have equal hashes (48 bits), triggers have 64."""
    width, n = span - k + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < span:
        return Phrases(none, none, none, np.zeros(0, U64), np.zeros(0, U64))
    up, down = POWERS.upto(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_CODES[data] * up[:n], dtype=U64, out=total[1:])
    hashes = mix((total[k:] - total[:-k]) * down[: n - k + 1])
    bits = U64((1 << int(width).bit_length()) - 1)
    low = hashes & ~bits  # the low bits hold how far the least hash lies ahead; the leftmost wins a tie
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[:-step], low[step:] + U64(step))
        reach += step
    starts = len(low)  # strings start at 0 .. n - span
    sizes = np.diff(at)
    valid = np.zeros(starts + 1, np.int64)
    long = np.flatnonzero(sizes >= span)
    np.add.at(valid, at[long], 1)
    np.add.at(valid, np.minimum(at[long + 1] - span + 1, starts), -1)
    inside = np.cumsum(valid[:-1]) > 0
    own = np.flatnonzero(inside)
    if not len(own):
        return Phrases(none, none, none, np.zeros(0, U64), np.zeros(0, U64))
    trigger = own + (low[own] & bits).astype(np.int64)
    new = np.ones(len(own), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (own[1:] != own[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    document = np.searchsorted(at, own[first], "right") - 1
    a, b, place = own[first], own[last], trigger[first]
    context = mix((total[b + span] - total[a]) * down[a] + ((place - a) * 128 + b - a).astype(U64))
    return Phrases(document, a, b, hashes[place], context >> U64(16))


def _where(rows: np.ndarray, codes: np.ndarray, known_rows: np.ndarray, known_codes: np.ndarray, known: np.ndarray, absent: int) -> np.ndarray:
    """known of the pair (row, code), or absent."""
    if not len(known):
        return np.full(len(rows), absent)
    keys, wanted = (r.astype(U64) * U64(0x9E3779B97F4A7C15) ^ c.astype(U64) for r, c in ((known_rows, known_codes), (rows, codes)))
    order = np.argsort(keys)
    keys, known = keys[order], known[order]
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, known[i], absent)


_PARSED = "bucket int, kind int, triggers binary, contexts binary, owners binary, ids binary, tags binary"
_SHARED = "doc_id long, tag long, context long, kind int"


def _bytes(values: np.ndarray, n: int) -> bytes:
    """The lowest n bytes of each 64-bit value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def _values(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(blob) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(blob, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def _parse(keyed: DataFrame, span: int, k: int, groups: int) -> DataFrame:
    """Hashes of each batch's phrases, packed by bucket. kind 0: the smallest document's of each context; kind 1: the others, which are settled."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("triggers", "contexts", "owners", "ids", "tags"))])

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 30_000):
                batch = whole.slice(begin, 30_000)
                ids, tags = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("doc_id", "tag"))
                found, rows = [], 0
                for part, data, at in slices(batch):
                    p = phrases(data, at, span, k)
                    found.append((p.trigger, p.context, p.document + rows))
                    rows += part.num_rows
                if not found:
                    continue
                h, c, d = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(h):
                    continue
                rank = np.unique(ids, return_inverse=True)[1]
                order = np.lexsort((rank[d], c, h))
                h, c, d = h[order], c[order], d[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
                first = np.flatnonzero(new)
                least = np.repeat(rank[d[first]], np.diff(np.append(first, len(h))))
                settled = rank[d] > least
                bucket = ((h >> U64(40)) % U64(groups)).astype(np.int64)
                # what is settled needs no meeting, and goes to any bucket
                out = []
                for kind, chosen in ((0, np.flatnonzero(~settled)), (1, np.flatnonzero(settled))):
                    where = bucket[chosen] if kind == 0 else np.full(len(chosen), int(h[0] % U64(groups)))
                    by = np.argsort(where, kind="stable")
                    for some in np.split(chosen[by], np.flatnonzero(np.diff(where[by])) + 1) if len(chosen) else []:
                        used, owner = np.unique(d[some], return_inverse=True)
                        out.append({
                            "bucket": int(bucket[some[0]] if kind == 0 else h[0] % U64(groups)), "kind": kind, "triggers": _bytes(h[some], 4) if kind == 0 else b"", "contexts": _bytes(c[some], 6),
                            "owners": owner.astype(np.uint16).tobytes(), "ids": ids[used].tobytes(), "tags": tags[used].astype(np.uint32).tobytes(),
                        })
                yield pa.RecordBatch.from_pylist(out, schema)

    return keyed.mapInArrow(run, _PARSED)


def _shared(parsed: DataFrame, hot: int) -> DataFrame:
    """Contexts of the triggers that occur in more than one document: settled, or open where other contexts must be compared."""

    def meet(table):
        rows = table.to_pylist()
        out = []
        for kind in (0, 1):
            own = [r for r in rows if r["kind"] == kind]
            if not own:
                continue
            c = np.concatenate([_values(r["contexts"], 6) for r in own])
            ids, tags = (np.concatenate([np.frombuffer(r[x], kind_)[np.frombuffer(r["owners"], np.uint16)] for r in own]).astype(np.int64) for x, kind_ in (("ids", np.int64), ("tags", np.uint32)))
            if kind == 1:
                out.append((ids, tags, c, np.full(len(c), _SETTLED)))
                continue
            h = np.concatenate([_values(r["triggers"], 4) for r in own])
            order = np.lexsort((ids, c, h))
            h, c, ids, tags = h[order], c[order], ids[order], tags[order]
            trigger = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            context = np.flatnonzero(new)
            spread = lambda x, at: np.repeat(x, np.diff(np.append(at, len(h))))
            several = spread(np.minimum.reduceat(ids, trigger) != np.maximum.reduceat(ids, trigger), trigger)
            contexts = spread(np.add.reduceat(new, trigger, dtype=np.int64), trigger)
            settled = ids > spread(ids[context], context)
            kinds = np.where(settled, _SETTLED, np.where(contexts > hot, _HOT, _OPEN))
            keep = several & (settled | (contexts > 1))
            out.append((ids[keep], tags[keep], c[keep], kinds[keep]))
        ids, tags, c, kinds = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"doc_id": ids, "tag": tags, "context": c.astype(np.int64), "kind": pa.array(kinds, pa.int32())})

    return parsed.groupBy("bucket").applyInArrow(meet, _SHARED)


def _lists(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, context and kind of all entries of the columns contexts and kinds."""
    lists, kinds = (part.column(part.schema.get_field_index(c)) for c in ("contexts", "kinds"))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(part.num_rows), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), kinds.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


_PLACED = "bucket int, doc_id long, tag long, at int, mask long, context binary"


def _dictionary(joined: DataFrame, span: int, k: int, groups: int) -> DataFrame:
    """Phrases that may repeat, with the bytes that their strings reach. mask -1 - m: settled here, with strings m repeated."""

    def run(batches):
        for batch in batches:
            found = []
            get = lambda part, c: part.column(part.schema.get_field_index(c))
            for part, data, at in slices(batch):
                row, context, kind = _lists(part)
                if not (kind != _SETTLED).any():
                    continue
                p = phrases(data, at, span, k)
                kind = _where(p.document, p.context, row, context, kind, _SETTLED)
                hit = np.flatnonzero(kind != _SETTLED)
                ids, tags, raw = pc.fill_null(get(part, "doc_id"), 0).to_numpy(), get(part, "tag").to_numpy(), data.tobytes()
                document = p.document[hit]
                for h, many, doc, tag, a, b, o in zip(*(x.tolist() for x in (p.trigger[hit], kind[hit] == _HOT, ids[document], tags[document], p.first[hit], p.last[hit], at[document])), strict=True):
                    if many:
                        found += ((None, raw[s : s + span], doc, tag, s - o, 1) for s in range(a, b + 1))
                    else:
                        found.append((h, raw[a : b + span], doc, tag, a - o, b - a + 1))
            least: dict[bytes, int] = {}
            for _, context, doc, *_ in found:
                if (x := least.get(context)) is None or doc < x:
                    least[context] = doc
            out = {c: [] for c in ("bucket", "doc_id", "tag", "at", "mask", "context")}
            for h, context, doc, tag, at, n in found:
                settled = least[context] < doc
                where = hash(doc) if settled else (h >> 40) if h is not None else zlib.crc32(context)
                for c, x in zip(out, (where % groups, doc, tag, at, -1 - ((1 << n) - 1) if settled else 0, None if settled else context), strict=True):
                    out[c].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["doc_id"], pa.int64()), pa.array(out["tag"], pa.int64()), pa.array(out["at"], pa.int32()), pa.array(out["mask"], pa.int64()), pa.array(out["context"], pa.binary())], list(out))

    return joined.mapInArrow(run, _PLACED)


def _ordered(dictionary: DataFrame, span: int) -> DataFrame:
    """Masks of the strings of each phrase that also start in a smaller document: doc_id, tag, at, mask."""

    def order(table):
        doc, tag, at, mask = (table.column(c).to_numpy() for c in ("doc_id", "tag", "at", "mask"))
        contexts = table.column("context").to_pylist()
        open_ = [i for i, c in enumerate(contexts) if c is not None]
        out = np.where(mask < 0, -1 - mask, 0)
        if open_:
            sizes = np.array([len(contexts[i]) for i in open_])
            data = np.frombuffer(b"".join(contexts[i] for i in open_), np.uint8)
            begin, n = np.cumsum(sizes) - sizes, sizes - span + 1
            row, shift = np.repeat(open_, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            suffixes = np.lib.stride_tricks.sliding_window_view(data, span)[np.repeat(begin, n) + shift]
            suffixes = np.ascontiguousarray(suffixes).view(f"S{span}").ravel()
            rank = np.argsort(suffixes, kind="stable")
            s, owner = suffixes[rank], doc[row[rank]]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(s))))
            repeated = rank[owner > least]
            np.bitwise_or.at(out, row[repeated], np.int64(1) << shift[repeated])
        keep = out != 0
        return pa.table({"doc_id": doc[keep], "tag": tag[keep], "at": pa.array(at[keep], pa.int32()), "mask": out[keep]})

    return dictionary.groupBy("bucket").applyInArrow(order, "doc_id long, tag long, at int, mask long")


_NAMES = frozenset("doc_id n_bytes n_removed n_spans kept_sha256 kept spans".split())
_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<struct<start:long,end:long>>"


def _combine(joined: DataFrame, span: int, k: int, with_text: bool, carried: list[str]) -> DataFrame:
    types = dict(joined.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carried), _RESULT])
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch, "_text"):
                get = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
                cover = np.zeros(len(data) + 1, np.int32)
                row, context, kind = _lists(part)
                some = kind == _SETTLED
                if some.any():
                    p = phrases(data, at, span, k)
                    hit = _where(p.document, p.context, row[some], context[some], np.ones(some.sum(), np.int64), 0) > 0
                    np.add.at(cover, p.first[hit], 1)
                    np.add.at(cover, p.last[hit] + span, -1)
                found = get("found")
                if found.null_count < part.num_rows:
                    start, mask = (found.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "mask"))
                    start += np.repeat(at[:-1], pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
                    for bit in range(63):
                        own = start[(mask >> bit) & 1 == 1] + bit
                        np.add.at(cover, own, 1)
                        np.add.at(cover, own + span, -1)
                removed = np.cumsum(cover[:-1]) > 0
                raw, out = data.tobytes(), {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    kept, spans, gone = raw[a:b], [], removed[a:b]
                    if gone.any():
                        kept = data[a:b][~gone].tobytes()
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
                        spans = [{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)]
                    for c, x in zip(out, (b - a, b - a - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None, spans if with_text else None), strict=True):
                        out[c].append(x)
                yield pa.RecordBatch.from_arrays(
                    [*map(get, carried), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.string()), pa.array(out["spans"], kinds)],
                    [*carried, *out],
                )

    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, span: int = 50, with_text: bool = True, carry: tuple[str, ...] = (), trigger_bytes: int = TRIGGER_BYTES, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Removes from each text the bytes covered by a `span`-byte string that also starts in a document of smaller doc_id.

    docs(doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with
    with_text kept (the remaining bytes as text; a character that was cut is dropped) and spans. Columns named in carry stay, but for those that have the name of a result.

    Texts are UTF-8 bytes; null or empty ones, and those shorter than `span`, lose nothing and own nothing. Rows that repeat a
    doc_id are not compared with each other, only with smaller ids. Rows without doc_id lose nothing and own
    nothing. Of equal texts only the smallest id keeps its bytes. Other columns are ignored.
    """
    if not 1 <= span - trigger_bytes <= 60:
        raise ValueError("span must exceed trigger_bytes by 1 to 60")
    carry = tuple(c for c in carry if c.lower() not in _NAMES)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = ["_carry"] if carry else []
    keyed = docs.select(F.col("doc_id").cast("long"), *([F.struct(*carry).alias("_carry")] if carry else []), text.alias("_text"), F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("_tag"))
    size = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    groups = max(1, -(-size // HASHED_BYTES))
    named = keyed.where("doc_id is not null").select("doc_id", F.col("_tag").alias("tag"), F.col("_text").alias("text"))
    shared = _shared(_parse(named, span, trigger_bytes, groups), hot_contexts)
    by_doc = shared.groupBy(F.col("doc_id"), F.col("tag").alias("_tag")).agg(F.collect_list("context").alias("contexts"), F.collect_list("kind").alias("kinds"))
    marked = keyed.join(by_doc.hint("shuffle_hash"), ["doc_id", "_tag"], "left")
    # rows without an open context are left out in Python: a filter here would change the join's inputs, and the texts would be shuffled twice
    open_ = marked.select("doc_id", F.col("_tag").alias("tag"), F.col("_text").alias("text"), "contexts", "kinds", *held)
    masks = _ordered(_dictionary(open_, span, trigger_bytes, max(1, -(-size // OPEN_BYTES))), span)
    found = masks.groupBy("doc_id", F.col("tag").alias("_tag")).agg(F.collect_set(F.struct("at", "mask")).alias("found"))
    whole = marked.join(found.hint("shuffle_hash"), ["doc_id", "_tag"], "left").select("doc_id", *held, "_text", "contexts", "kinds", "found")
    out = _combine(whole, span, trigger_bytes, with_text, ["doc_id", *held])
    return out.select("doc_id", *(f"_carry.{c}" for c in carry), *(c for c in out.columns if c not in ("doc_id", "_carry")))
