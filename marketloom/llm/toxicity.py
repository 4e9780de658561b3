"""Toxicity by weak supervision.

Voters are lexicons and patterns. Some are fixed; the others are drawn from a bounded sample of labelled training
documents: words and word beginnings that are much more frequent in toxic ones. A generative label model
explains the votes on all training documents: a class, and for each voter a table of its votes given the
class and the voter that it is most tied to (a tree of the strongest conditional dependencies), fitted by expectation
maximisation on the counts of vote patterns. A known label is one more voter, of fixed accuracy, for the documents that have one. A
logistic regression is trained on the posterior labels of all training documents and scores every document from the voters' hits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.storage import written

#: Labelled rows, in expectation, that voters and classifier are fitted on.
LABELLED_ROWS = 20_000
#: Odds, on a log scale, that a known label gives its class.
GOLD_ODDS = 4.0
#: How many times as frequent in toxic documents an entry must be, and in how many of them it must occur.
MIN_RATIO, MIN_TOXIC = 12.0, 3
_LENGTHS = range(4, 10)

# Insults, and patterns of abuse.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown fool garbage ugly hate".split())
PATTERNS = (
    re.compile(r"\b(?:you|u) (?:are|r) (?:an? |such |so )?\w+"),  # you are such a ...
    re.compile(r"\b\w[*#@$%]{2,}\w+\b"),  # masked letters
    re.compile(r"\b(?:shut up|get lost|go to hell|drop dead|screw you)\b"),  # dismissals
    re.compile(r"\b(?:i|we) (?:will|shall|am going to|are going to) (?:kill|hurt|beat|find|destroy) (?:you|u|them|him|her)\b"),  # threats
    re.compile(r"\ball (?:of )?(?:you|them|those|these) (?:\w+ )?(?:should|must|deserve|need to)\b"),  # of whole groups
    re.compile(r"[!?]{3,}"),  # shouting
)
#: Voters: fixed insults; learned words (3 lexicons by hash); learned beginnings, short (2) and long (2); patterns.
VOTERS = 8 + len(PATTERNS)
_FIXED = (0, *range(8, VOTERS))
_WORD = re.compile(r"\w+")


def _features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in _LENGTHS if n < len(word))]


def _voter(feature: str) -> int:
    draw = zlib.crc32(feature.encode())
    if feature[0] == "=":
        return 1 + draw % 3
    return (4 if len(feature) < 7 else 6) + draw % 2


def learn_lexicon(sample: DataFrame) -> dict[str, int]:
    """feature -> voter, from sample(text, toxic): all entries that toxic documents have MIN_RATIO times as often. Bounded as the sample is."""

    def count(batches):
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                seen = {f for w in set(_WORD.findall((text.as_py() or "").lower())) for f in _features(w)}
                (toxic if y.as_py() else clean).update(seen)
            # what this batch has in clean documents only is needed where other batches have it in toxic ones
            names = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())], ["feature", "p", "n"])

    totals = sample.agg(F.sum(F.col("toxic").cast("long")).alias("p"), F.sum((1 - F.col("toxic")).cast("long")).alias("n")).first()
    if not totals.p or not totals.n:
        return {}
    sums = sample.select("text", "toxic").mapInArrow(count, "feature string, p long, n long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    ratio = (F.col("p") + 0.5) / (totals.p + 1) / ((F.col("n") + 0.5) / (totals.n + 1))
    rows = sums.where((F.col("p") >= MIN_TOXIC) & (ratio >= MIN_RATIO)).select("feature").collect()
    return {r.feature: _voter(r.feature) for r in rows}


def voter_hits(docs: DataFrame, lexicon: dict[str, int]) -> DataFrame:
    """doc_id, hits (words that each voter knows, by voter), n_words for each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the labelled sample

    def run(batches):
        lexicon, known = shared.value, {}
        for batch in batches:
            hits, sizes = np.zeros((batch.num_rows, VOTERS), np.int32), []
            for i, text in enumerate(batch.column(1)):
                text = (text.as_py() or "").lower()
                words = _WORD.findall(text)
                sizes.append(len(words))
                if len(known) > 400_000:
                    known.clear()
                for w in words:
                    voters = known.get(w)
                    if voters is None:
                        voters = known[w] = tuple({lexicon[f] for f in _features(w) if f in lexicon} | ({0} if w in INSULTS else set()))
                    for v in voters:
                        hits[i, v] += 1
                for j, pattern in enumerate(PATTERNS):
                    hits[i, 8 + j] = sum(1 for _ in pattern.finditer(text))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(hits.ravel()), VOTERS).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes, pa.int64())], ["doc_id", "hits", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, hits array<int>, n_words long")


def votes() -> F.Column:
    """One digit a voter: 2 toxic, 0 clean, 1 abstains. Learned lexicons call a document without hits clean; fixed ones abstain."""
    each = [F.when(F.col("hits")[v] >= (1 if v in _FIXED else 2), "2").when((F.col("hits")[v] == 0) & F.lit(v not in _FIXED), "0").otherwise("1") for v in range(VOTERS)]
    return F.concat(*each)


class LabelModel:
    """Class and votes as a tree-augmented generative model, fitted on counts of vote patterns.

    patterns: (m, voters) of 0, 1, 2; free: documents of each pattern without a label; gold: (m, 2) labelled ones by class.
    """

    def __init__(self, patterns: np.ndarray, free: np.ndarray, gold: np.ndarray, prior: float = 0.1, rounds: int = 30):
        self.patterns, m, v = patterns, *patterns.shape
        known = gold.sum(0)
        self.prior = (known[1] + prior) / (known.sum() + 1)
        # first guess for what is not labelled: the balance of votes
        lean = (patterns == 2).sum(1) - 0.3 * (patterns == 0).sum(1)
        posterior = np.clip(1 / (1 + np.exp(-2 * (lean - 0.5))), 0.01, 0.99)
        if known.min() > 0:
            self._fit(gold.astype(float), [-1] * v)
            posterior = self.posterior()
        self.parents = [-1] * v
        for i in range(rounds):
            counts = gold + np.stack([1 - posterior, posterior], 1) * free[:, None]
            if i == 5:
                self.parents = self._tree(counts)
            self._fit(counts, self.parents)
            if not known.min() > 0:
                self.prior = min(0.5, counts[:, 1].sum() / max(1, counts.sum()))
            posterior = self.posterior()

    def _fit(self, counts: np.ndarray, parents: list[int]) -> None:
        """Tables of each voter: log p(vote | parent's vote, class)."""
        self.used, self.tables = list(parents), []
        for v, parent in enumerate(parents):
            table = np.full((2, 3, 3), 0.5)
            above = self.patterns[:, parent] if parent >= 0 else np.zeros(len(self.patterns), int)
            for y in (0, 1):
                np.add.at(table[y], (above, self.patterns[:, v]), counts[:, y])
            self.tables.append(np.log(table / table.sum(2, keepdims=True)))

    def posterior(self) -> np.ndarray:
        odds = np.full(len(self.patterns), np.log(self.prior / (1 - self.prior)))
        for v, parent in enumerate(self.used):
            above = self.patterns[:, parent] if parent >= 0 else np.zeros(len(self.patterns), int)
            odds += self.tables[v][1][above, self.patterns[:, v]] - self.tables[v][0][above, self.patterns[:, v]]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def _tree(self, counts: np.ndarray) -> list[int]:
        """Parents in the maximum spanning tree of conditional mutual information given the class."""
        v = self.patterns.shape[1]
        gain = np.zeros((v, v))
        for i in range(v):
            for j in range(i):
                for y in (0, 1):
                    joint = np.full((3, 3), 0.1)
                    np.add.at(joint, (self.patterns[:, i], self.patterns[:, j]), counts[:, y])
                    share = joint / joint.sum()
                    gain[i, j] += joint.sum() * (share * np.log(share / np.outer(share.sum(1), share.sum(0)))).sum()
                gain[j, i] = gain[i, j]
        parents, inside = [-1] * v, {0}
        while len(inside) < v:
            _, child, parent = max((gain[i, j], i, j) for i in range(v) if i not in inside for j in inside)
            parents[child] = parent
            inside.add(child)
        return parents

    def accuracies(self) -> np.ndarray:
        """Share of right votes among those that each voter casts, under the model."""
        p = self.posterior()
        return np.array([(p[self.patterns[:, v] == 2].sum() + (1 - p)[self.patterns[:, v] == 0].sum()) / max(1, (self.patterns[:, v] != 1).sum()) for v in range(self.patterns.shape[1])])


def inputs() -> F.Column:
    """The classifier's inputs: hits by voter, on a log scale and as presence, their sum, and its share of words."""
    hit = [F.col("hits")[v].cast("double") for v in range(VOTERS)]
    learned = sum(hit[v] for v in range(1, 8))
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return F.array(*(F.log1p(h) for h in hit), *(F.least(h, F.lit(1.0)) for h in hit), F.log1p(learned), F.least(100 * learned / n, F.lit(20.0)), F.least(learned / 4, F.lit(4.0)))


def is_held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, threshold: float = 0.3) -> DataFrame:
    """Toxicity of every row of documents(doc_id, text, ...), learnt from labels(doc_id, toxic) of documents that are not held out.

    Returns doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on). Fits on about `rows` labelled rows, taken
    by a hash of doc_id; votes are counted over all documents that are not held out.

    Null or empty text has no hits and scores as such. Labels that are null are not used; where a document has
    several, toxic wins. Without labels of both classes only the fixed voters decide. Repeated rows get equal results, null ids
    stay null. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    usable = labels.select(F.col("doc_id").cast("long"), "toxic").where("doc_id is not null and toxic in (0, 1)").where(~is_held_out())
    share = min(1.0, rows / max(1, usable.count()))
    some = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("labels")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    some = written(some.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    sample = written(docs.join(F.broadcast(some), "doc_id").select("text", "toxic"), "sample")  # bounded by `rows`
    hits = written(voter_hits(docs, learn_lexicon(sample)), "hits")
    seen = hits.where(~is_held_out()).join(F.broadcast(some), "doc_id", "left").withColumn("votes", votes())
    counted = seen.groupBy("votes").agg(*(F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("free", F.col("toxic").isNull()), ("clean", F.col("toxic") == 0), ("bad", F.col("toxic") == 1)))).orderBy("votes").collect()
    x, b = np.zeros(2 * VOTERS + 3), np.log(0.1 / 0.9)
    x[list(_FIXED)] = 2.0  # without labels of both classes only the fixed voters count
    if sum(r.clean for r in counted) and sum(r.bad for r in counted):
        model = LabelModel(np.array([[int(c) for c in r.votes] for r in counted]), np.array([r.free for r in counted], float), np.array([[r.clean, r.bad] for r in counted], float))
        x, b = _regression(spark, seen, counted, model)
    odds = F.aggregate(F.zip_with(inputs(), F.array(*(F.lit(float(c)) for c in x)), lambda p, q: p * q), F.lit(float(b)), lambda s, c: s + c)
    return hits.select("doc_id", is_held_out().alias("held_out"), (1 / (1 + F.exp(-odds))).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _regression(spark, seen: DataFrame, counted: list, model: LabelModel) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression on the posterior labels of all training documents; equal inputs are one weighted row."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    posterior = spark.createDataFrame([(r.votes, float(p)) for r, p in zip(counted, model.posterior(), strict=True)], "votes string, p double")
    odds = F.log(F.col("p") / (1 - F.col("p"))) + F.when(F.col("toxic") == 1, GOLD_ODDS).when(F.col("toxic") == 0, -GOLD_ODDS).otherwise(0.0)
    p = 1 / (1 + F.exp(-odds))
    known = seen.join(F.broadcast(posterior), "votes").select(inputs().alias("inputs"), p.alias("p"))  # one row a vote pattern: 3 ** 7 * 2 ** 7 at most
    both = written(known.groupBy("inputs").agg(F.sum("p").alias("bad"), F.sum(1 - F.col("p")).alias("clean")), "inputs")
    rows = both.select("inputs", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("bad").alias("weight")), F.struct(F.lit(0.0).alias("label"), F.col("clean").alias("weight")))).alias("q"))
    train = rows.select(array_to_vector("inputs").alias("features"), "q.label", "q.weight").cache()
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=60).fit(train)
    train.unpersist()
    return fitted.coefficients.toArray(), fitted.intercept
