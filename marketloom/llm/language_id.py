"""Language identification by interpolated Kneser-Ney character models.

Spark counts the character 4-grams of every labelled training text, and from all of them the lower
orders, discounts and totals of a Kneser-Ney model. No n-gram is left out. The models of all languages
share one table per order: hashes of n-grams in a sorted array, and beside each the log
probabilities in every language. A text gets the language of lowest cross-entropy per
character; it is rejected where that exceeds the language's threshold, calibrated on all labelled texts.

4-grams and 3-grams are dealt to shards by their two characters before the last: a 4-gram, its context, the 3-gram that it
ends in and that one's context then share a shard, which one task turns into probabilities. Shards whose tables
fit MODEL_BYTES together are broadcast together. A model that is larger is scored in several passes over the texts, each
with the next shards, that add up to the same sums.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.arrays import U64, mix, slices
from marketloom.llm.storage import let_go, unused, written

ORDER = 4
#: Shards of the two highest orders, and bytes of tables that are broadcast at once.
SHARDS, MODEL_BYTES = 64, 128 << 20
#: n-grams that a task holds before it passes their counts on.
HELD_GRAMS = 1 << 19
#: Share of a language's labelled texts under whose highest entropy the threshold is set, and steps to a nat in which it is first looked for.
CALIBRATION_SHARE, ENTROPY_STEPS = 0.999, 256
#: A text is rejected above this multiple of the entropy that all but one in a thousand labelled texts stay under.
MARGIN = 1.25
#: Characters from which on the score no longer grows more certain.
SCORED_CHARS = 60


@cache
def _folded() -> np.ndarray:
    """Code of each BMP character: its lower case if it is a letter or mark, else a blank."""
    out = np.full(1 << 16, 32, np.uint64)
    for i in range(1 << 16):
        c = chr(i)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
    return out


def _characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts in a row and the n + 1 offsets. Runs of blanks become one; every text begins with a blank."""
    n = len(at) - 1
    wide = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = lead[at] if lead[-1] == len(wide) else None
    if ends is None:  # not valid UTF-8: decoded text by text
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
        wide = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([0, *map(len, parts)])
    codes = np.full(len(wide) + n + 1, U64(32))
    place = np.ones(len(codes), bool)
    breaks = ends + np.arange(n + 1)
    place[breaks] = False
    folded = _folded()[np.minimum(wide, 0xFFFF)]
    high = np.flatnonzero(wide >= 1 << 16)
    if len(high):  # letters beyond 16 bits share one code
        kinds, where = np.unique(wide[high], return_inverse=True)
        folded[high] = np.array([0xFFFE if unicodedata.category(chr(k))[0] in "LM" else 32 for k in kinds], np.uint64)[where]
    codes[place] = folded
    keep = codes != 32
    keep[1:] |= codes[:-1] != 32
    keep[breaks] = True
    keep[breaks[:-1] + 1] &= codes[breaks[:-1] + 1] != 32
    keep[breaks] = True
    ends = np.concatenate([[0], np.cumsum(keep)])[breaks]
    return codes[keep][: ends[-1]], ends


def _grams(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each character, 16 bits a character; blanks precede each text's first."""
    grams, place = codes.copy(), np.arange(len(codes)) - np.repeat(at[:-1], np.diff(at))
    for j in range(1, ORDER):
        before = np.full(len(codes), U64(32))
        before[j:] = codes[:-j]
        before[place < j] = 32
        grams |= before << U64(16 * j)
    return grams


def _owner(at: np.ndarray) -> np.ndarray:
    """For each character but the leading blanks, the text that it belongs to; -1 for leading blanks."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    owner[at[:-1]] = -1
    return owner


def _shard(grams: np.ndarray) -> np.ndarray:
    """Shard of 4-grams and of 3-grams: by the two characters before the last."""
    return (mix((grams >> U64(16)) & U64(0xFFFFFFFF)) % U64(SHARDS)).astype(np.int32)


_COUNTS = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])


def count_grams(labelled: DataFrame) -> DataFrame:
    """Counts of character 4-grams by language over all rows of labelled(text, lang): lang, shard, gram, n."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        grams, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(grams)
        grams, n = grams[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        return grams[first], np.add.reduceat(n, first)

    def rows(held: dict):
        for name, parts in held.items():
            grams, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(_shard(grams)), pa.array(grams.view(np.int64)), pa.array(n)], schema=_COUNTS)

    def count(batches):
        let_go()
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for part, data, at in slices(batch):
                codes, ends = _characters(data, at)
                if len(ends) < 2:
                    continue
                grams, owner = _grams(codes, ends), _owner(ends)
                names, which = np.unique(np.array(part.column(part.schema.get_field_index("lang")).to_pylist(), object).astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    found = np.unique(grams[(owner >= 0) & (which[owner] == k)], return_counts=True)
                    held.setdefault(str(name), []).append(found)
                    size += len(found[0])
                if size > 2 * HELD_GRAMS:
                    held = {name: [merged(parts)] for name, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > HELD_GRAMS:
                        yield from rows(held)
                        held, size = {}, 0
        yield from rows(held)

    found = labelled.select("text", "lang").mapInArrow(count, "lang string, shard int, gram long, n long")
    return found.groupBy("lang", "shard", "gram").agg(F.sum("n").alias("n"))


class _Level:
    """One order of a language's model: n-grams with counts, and their contexts' totals and back-off masses."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, discount: float):
        order = np.argsort(keys)
        self.keys, self.counts, self.discount = keys[order], counts[order].astype(float), discount
        self.contexts, where = np.unique(self.keys >> U64(16), return_inverse=True)
        self.totals, self.left = np.bincount(where, self.counts), discount * np.bincount(where)


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in the sorted array `known`, and whether they are there."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return i, known[i] == keys


def _below(n: int) -> np.uint64:
    return U64((1 << 16 * (n - 1)) - 1)


class _KneserNey:
    """Interpolated Kneser-Ney probabilities of one language, or of one shard of its high orders."""

    def __init__(self, levels: dict[int, _Level], letters: int):
        self.levels, self.size = levels, letters + 1  # one more for all unknown characters

    def weight(self, contexts: np.ndarray, n: int) -> np.ndarray:
        """What order n leaves to the order below it, by context; 1 where the context is new."""
        level = self.levels[n]
        i, known = _find(level.contexts, contexts)
        return np.where(known, level.left[i] / level.totals[i], 1.0) if len(level.contexts) else np.ones(len(contexts))

    def probability(self, keys: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full(len(keys), 1 / self.size)
        level, context = self.levels[n], keys >> U64(16)
        own = np.zeros(len(keys))
        i, known = _find(level.keys, keys)
        if known.any():
            j, _ = _find(level.contexts, context)
            own[known] = (level.counts[i] - level.discount)[known] / level.totals[j][known]
        return own + self.weight(context, n) * self.probability(keys & _below(n), n - 1)


class HashTable:
    """Rows of values found by the hash of a key: a sorted array of hashes, entered through their leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = mix(keys)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)
        self.bits = max(8, int(np.ceil(np.log2(max(len(keys), 1)))) + 1)
        self.first = np.searchsorted(self.hashes >> U64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        hashes = mix(keys)
        lead = (hashes >> U64(64 - self.bits)).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        found = np.full(len(keys), -1, np.int32)
        left = np.flatnonzero(at < end)
        while len(left):
            i = at[left]
            hit = self.hashes[i] == hashes[left]
            found[left[hit]] = i[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return found


@dataclass
class _Tables:
    """Tables of all orders for all languages, of some shards; low orders are whole."""

    languages: list[str]
    grams: dict[int, HashTable]
    weights: dict[int, HashTable]
    base: np.ndarray

    def log_probabilities(self, keys: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Natural log probability of each gram's last character in every language."""
        if n == 0:
            return np.broadcast_to(self.base, (len(keys), len(self.languages)))
        row = self.grams[n].find(keys)
        out = self.grams[n].values[row] if len(self.grams[n].values) else np.zeros((len(keys), len(self.languages)), np.float32)
        missing = np.flatnonzero(row < 0)
        if len(missing):
            rest = keys[missing]
            context = self.weights[n].find(rest >> U64(16))
            values = self.weights[n].values
            back = np.where((context >= 0)[:, None], values[context], np.float32(0)) if len(values) else np.float32(0)
            out[missing] = back + self.log_probabilities(rest & _below(n), n - 1)
        return out


@dataclass
class LanguageModel:
    """The model's high orders as a table of shards, its low orders, and thresholds of rejection (nats a character)."""

    languages: list[str]
    shards: DataFrame
    passes: int
    low: _Tables
    thresholds: dict[str, float] = field(default_factory=dict)
    _held: dict = field(default_factory=dict)

    def tables(self, turn: int) -> _Tables:
        """Tables of the shards of one pass, MODEL_BYTES in all at most (a single larger shard is taken whole)."""
        grams, weights = dict(self.low.grams), dict(self.low.weights)
        found = self.shards.where(F.pmod("shard", F.lit(self.passes)) == turn).collect()
        for n in (3, ORDER):
            for kind, out in (("grams", grams), ("weights", weights)):
                own = [r for r in found if r.level == n and r.kind == kind]
                keys = np.concatenate([np.zeros(0, U64), *(np.frombuffer(r.keys, U64) for r in own)])
                values = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r.vals, np.float32) for r in own)])
                out[n] = HashTable(keys, values.reshape(len(keys), len(self.languages)))
        return _Tables(self.languages, grams, weights, self.low.base)

    def broadcast(self, turn: int):
        """The tables of one pass for all tasks; kept where there is only one pass."""
        if turn not in self._held:
            self._held = {turn: self.shards.sparkSession.sparkContext.broadcast(self.tables(turn))}
        return self._held[turn]


_BUILT = pa.schema([("shard", pa.int32()), ("level", pa.int32()), ("kind", pa.string()), ("keys", pa.binary()), ("vals", pa.binary())])


def fit(labelled: DataFrame, model_bytes: int = MODEL_BYTES) -> LanguageModel | None:
    """Model of the languages of labelled(text, lang); None where no row has a text and a language.

    All 4-grams of all rows are counted and kept. Through the driver go statistics of languages, the pairs of characters (bounded by
    alphabets, not by rows), and what is broadcast.
    """
    counts = written(count_grams(labelled.where("lang is not null and text is not null")), "grams")
    level, discounts, letters = counts.select("lang", "gram", "n"), {}, {}
    for n in range(ORDER, 0, -1):
        for r in level.groupBy("lang").agg(F.count("*").alias("grams"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect():
            discounts[r.lang, n] = min(0.95, max(0.1, r.ones / (r.ones + 2 * r.twos))) if r.ones else 0.5
            letters[r.lang] = r.grams
        if n == 2:
            pairs = level.toArrow()
        if n == 1:
            single = level.toArrow()
        if n > 1:  # below the highest order a gram counts the characters that it follows
            level = written(level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1)).alias("gram")).agg(F.count("*").alias("n")), "grams")
    if not letters:
        return None
    languages = sorted(letters)
    low = []
    for x in languages:
        levels = {}
        for n, t in ((2, pairs), (1, single)):
            own = np.array(t.column("lang").to_pylist(), object) == x
            levels[n] = _Level(t.column("gram").to_numpy()[own].view(np.uint64), t.column("n").to_numpy()[own], discounts[x, n])
        low.append(_KneserNey(levels, letters[x]))
    shared = counts.sparkSession.sparkContext.broadcast((languages, low, discounts))

    def build(table):
        languages, low, discounts = shared.value
        grams, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
        lang = np.array(table.column("lang").to_pylist(), object)
        own = []
        for x, model in zip(languages, low, strict=True):
            high = grams[lang == x]
            three, kinds = np.unique(high & _below(ORDER), return_counts=True)
            own.append(_KneserNey(model.levels | {ORDER: _Level(high, n[lang == x], discounts[x, ORDER]), 3: _Level(three, kinds, discounts[x, 3])}, model.size - 1))
        shard, out = table.column("shard")[0].as_py(), []
        for k in (ORDER, 3):
            keys, contexts = (np.unique(np.concatenate([getattr(m.levels[k], c) for m in own])) for c in ("keys", "contexts"))
            values, left = np.log(np.stack([m.probability(keys, k) for m in own], 1)), np.log(np.stack([m.weight(contexts, k) for m in own], 1))
            out += ({"shard": shard, "level": k, "kind": kind, "keys": x.tobytes(), "vals": v.astype(np.float32).tobytes()} for kind, x, v in (("grams", keys, values), ("weights", contexts, left)))
        return pa.Table.from_pylist(out, _BUILT)

    shards = written(counts.groupBy("shard").applyInArrow(build, "shard int, level int, kind string, keys binary, vals binary"), "model")
    size = shards.agg(F.sum(2 * F.length("keys") + F.length("vals"))).first()[0]
    grams, weights = {}, {}
    for n in (1, 2):
        keys, contexts = (np.unique(np.concatenate([getattr(m.levels[n], c) for m in low])) for c in ("keys", "contexts"))
        grams[n] = HashTable(keys, np.log(np.stack([m.probability(keys, n) for m in low], 1)))
        weights[n] = HashTable(contexts, np.log(np.stack([m.weight(contexts, n) for m in low], 1)))
    base = np.log([1 / m.size for m in low]).astype(np.float32)
    return LanguageModel(languages, shards, min(SHARDS, max(1, -(-size // model_bytes))), _Tables(languages, grams, weights, base))


_FIELDS = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("entropy", T.DoubleType()), ("n_letters", T.LongType()))


def score(docs: DataFrame, model: LanguageModel | None, prefix: str = "") -> DataFrame:
    """All columns of docs(text, ...) and lang_pred, score, entropy (nats a character in that language), n_letters, under `prefix`.

    Columns of docs that have such a name are replaced.
    """
    docs = docs.drop(*(prefix + n for n, _ in _FIELDS))
    passes = model.passes if model else 1
    sums = unused(docs, "sums")
    for turn in range(passes - 1):  # a large model: each pass adds what its shards know
        docs = written(_pass(docs, model, turn, sums, T.StructType([*(f for f in docs.schema.fields if f.name != sums), T.StructField(sums, T.ArrayType(T.DoubleType()))]), None), "sums")
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != sums), *(T.StructField(prefix + n, t) for n, t in _FIELDS)])
    return _pass(docs, model, passes - 1, sums, schema, SCORED_CHARS)


def _pass(docs: DataFrame, model: LanguageModel | None, turn: int, sums: str, schema: T.StructType, scored: int | None) -> DataFrame:
    """docs with the sums of log probabilities so far; at the last pass (scored is given) with the results in their place."""
    shared, passes = (model.broadcast(turn), model.passes) if model else (None, 1)

    def run(batches):
        let_go()
        tables = shared.value if shared else None
        for batch in batches:
            for part, data, at in slices(batch):
                codes, ends = _characters(data, at)
                owner = _owner(ends)
                letters = np.bincount(owner[(owner >= 0) & (codes != 32)], minlength=part.num_rows)
                n = np.maximum(1, np.bincount(owner[owner >= 0], minlength=part.num_rows))
                columns = [c for c, name in zip(part.columns, part.schema.names, strict=True) if name != sums]
                if tables is None:
                    names, certain, entropy = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
                else:
                    grams = _grams(codes, ends)
                    if passes > 1:
                        here = np.flatnonzero((_shard(grams) % passes == turn) & (owner >= 0))
                        each = np.zeros((len(grams), len(tables.languages)), np.float32)
                        each[here] = tables.log_probabilities(grams[here])
                    else:
                        each = tables.log_probabilities(grams)
                    each[owner < 0] = 0
                    total = np.add.reduceat(each, ends[:-1], 0, dtype=np.float64)
                    if turn:
                        total += part.column(part.schema.get_field_index(sums)).flatten().to_numpy(zero_copy_only=False).reshape(total.shape)
                    if scored is None:
                        lists = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), total.shape[1]).cast(pa.list_(pa.float64()))
                        yield pa.RecordBatch.from_arrays([*columns, lists], schema.names)
                        continue
                    cross = -total / n[:, None]
                    best = cross.argmin(1)
                    entropy = cross[np.arange(len(best)), best]
                    odds = np.exp(np.maximum(-700, (entropy[:, None] - cross) * np.minimum(n, scored)[:, None]))
                    certain = np.where(letters > 0, 1 / odds.sum(1), 0)
                    names = [tables.languages[i] if k else "und" for i, k in zip(best.tolist(), letters.tolist(), strict=True)]
                found = [pa.array(names, pa.string()), pa.array(certain, pa.float64()), pa.array(entropy, pa.float64()), pa.array(letters, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *found], schema.names)

    return docs.mapInArrow(run, schema)


def percentile_by(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """by, high: the exact percentile of value (not negative) in each group, interpolated as Spark's percentile().

    Counts by step of the value find the steps that hold the two rows in question; only rows of those steps are sorted.
    """
    from pyspark.sql import Window

    x = rows.select(by, F.col(value).alias("v"), F.floor(F.col(value) * ENTROPY_STEPS).alias("step"))
    w = Window.partitionBy(by)
    steps = x.groupBy(by, "step").agg(F.count("*").alias("here"))
    steps = steps.withColumns({"upto": F.sum("here").over(w.orderBy("step")), "at": (F.sum("here").over(w) - 1) * F.lit(share)}).withColumn("before", F.col("upto") - F.col("here"))
    steps = steps.where((F.col("before") <= F.ceil("at")) & (F.col("upto") > F.floor("at")))
    found = x.join(F.broadcast(steps.select(by, "step", "at", "before")), [by, "step"])  # one or two steps a group
    found = found.withColumn("row", F.row_number().over(Window.partitionBy(by, "step").orderBy("v")) - 1 + F.col("before"))
    low, high, part = (F.max(F.when(F.col("row") == F.floor("at"), F.col("v"))), F.max(F.when(F.col("row") == F.ceil("at"), F.col("v"))), F.max(F.col("at") - F.floor("at")))
    return found.groupBy(by).agg((low + (high - low) * part).alias("high"))


def calibrate(model: LanguageModel, labelled: DataFrame, margin: float = MARGIN) -> LanguageModel:
    """Sets each language's rejection threshold from all labelled texts."""
    entropies = score(labelled.select("text"), model).where("n_letters > 0").select("lang_pred", "entropy")
    high = percentile_by(written(entropies, "entropies"), "lang_pred", "entropy", CALIBRATION_SHARE)
    model.thresholds = {r.lang_pred: margin * r.high for r in high.collect()}
    return model


def is_held_out() -> F.Column:
    """Documents that are never learnt from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def annotate(docs: DataFrame, training: DataFrame | None = None, prefix: str = "_") -> DataFrame:
    """All rows and columns of documents(doc_id, text, lang, ...) with lang_pred, score, entropy, n_letters and accepted, under `prefix`.

    Learns from the text and lang of `training` (by default: docs that are not held out). score is 0 to 1, the
    share of the best language, its entropy against the others'. accepted: a letter, and an entropy that the language's threshold allows.

    Null text, or text without a letter: lang_pred `und`, score 0, not accepted. Labels that are null are not
    learnt from; with no labelled text at all everything is `und`. A tie goes to the first language by name. Repeated rows
    get equal results. A language that no labelled text gets accepts everything. Letters beyond 16 bits count as one letter.
    Columns of documents that have a result's name are replaced; no rows give no rows.
    """
    docs = docs.drop(*(prefix + n for n in ("lang_pred", "score", "entropy", "n_letters", "accepted")))
    labelled = (docs if training is None else training).where(~is_held_out()).where("lang is not null and text is not null")
    model = fit(labelled)
    if model is not None:
        model = calibrate(model, labelled)
    limits = model.thresholds if model is not None else {}
    limit = F.lit(float("inf"))
    for name, high in sorted(limits.items()):
        limit = F.when(F.col(prefix + "lang_pred") == name, F.lit(float(high))).otherwise(limit)
    return score(docs, model, prefix).withColumn(prefix + "accepted", (F.col(prefix + "n_letters") > 0) & (F.col(prefix + "entropy") <= limit))


def identify(docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, accepted of every row, as annotate() gives them."""
    found = annotate(docs.select(F.col("doc_id").cast("long"), "text", "lang"), training)
    return found.select("doc_id", is_held_out().alias("held_out"), *(F.col("_" + c).alias(c) for c in ("lang_pred", "score", "entropy", "accepted")))
