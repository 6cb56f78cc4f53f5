"""Toxicity by nearest labelled examples under TF-IDF cosine.

A bounded sample of labelled documents (`per_class` of each label, the smallest
hashes of doc_id) gives the examples. Terms are the examples' whole words, beginnings and
pieces of words. A weight is TF x IDF x evidence: document frequencies count all
documents; evidence says how unevenly a term occurs in the two classes, as
1 - NOISE / chi-square, not below 0. NOISE is what chance gives the best of
many terms, or a quarter of the best term's chi-square if that is less: with a few
labels no term can reach much, and the best ones still tell the classes apart. All words
of a text together count as one more term, so that a cosine compares
shares, not mere presence. Examples lie in an inverted index cut into blocks of BLOCK examples;
every term keeps its largest weight per block, so that a document visits the
blocks by their upper bound and stops where none can beat its K-th example: the
K nearest are exact. Votes weigh by cosine; a logistic curve, fitted on the
examples' own votes (each without itself) at the class shares of all training
labels, turns votes into probabilities. The nearest examples are the evidence.

Proven sizes: 2 * per_class examples; of their terms at most `features`, the most telling
ones, and one. Terms of a whole text
are found by one pass of an Aho-Corasick automaton.

Nulls: a null text is empty; a text without any term has vote 0 and gets the
score of that vote. Labels with a null doc_id or toxic teach nothing; a document
labelled twice counts as toxic if one label says so. A null doc_id is scored
like any other. Of equally near examples those in the block visited first count,
alike in every run. Very long texts are read whole; of several texts under an example's doc_id
the first in order teaches. Without examples
of both classes every score is the share of toxic labels (0 without labels).
Repeated rows score alike; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import as_row, crc_mod, map_texts, shuffled
from weirline.sources.scratch import cut

FOLDS, BLOCK, K, PIECE, STARTS = 5, 128, 16, 5, (4, 5, 6)
#: Chi-square that chance alone gives the best of very many terms.
NOISE = 40.0
NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case letters with one space around every word."""
    return " " + NOT_LETTERS.sub(" ", text.lower()) + " "


def terms(text: str) -> set[str]:
    """Words (with their spaces) and pieces of words that a text has."""
    out: set[str] = set()
    for w in set(plain(text).split()):
        out.add(f" {w} ")
        out.update(w[i : i + PIECE] for i in range(len(w) - PIECE + 1))
        out.update(" " + w[:n] for n in STARTS if len(w) > n)
    return out


class Index:
    """Examples as unit vectors over the chosen terms, in blocks with the largest weight per term."""

    def __init__(self, names: list[str], weights: np.ndarray, bags: list[dict[int, int]], toxic: np.ndarray, ids: list[int]) -> None:
        self.names, self.weights, self.toxic, self.ids = names, weights.astype(np.float64), toxic.astype(np.float64), np.array(ids)
        rows = np.zeros((len(bags), len(weights)))
        for k, bag in enumerate(bags):
            at, weight = self.vector(bag)
            rows[k, at] = weight
        # Like examples lie together, by their strongest term and how much of them it is: bounds are tight then.
        strongest = rows[:, :-1].argmax(axis=1) if len(names) else np.zeros(len(bags), dtype=np.int64)
        order = np.lexsort((np.arange(len(bags)), rows[:, -1], strongest))
        self.place = np.empty(len(bags), dtype=np.int64)  # from the order given to the order held
        self.place[order] = np.arange(len(bags))
        rows, self.toxic, self.ids = rows[order], self.toxic[order], self.ids[order]
        self.blocks = [np.ascontiguousarray(rows[i : i + BLOCK].T) for i in range(0, len(bags), BLOCK)]
        self.most = np.stack([b.max(axis=1) for b in self.blocks], axis=1) if bags else np.zeros((len(weights), 0))
        self.curve = (0.0, 0.0)

    def vector(self, bag: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(bag.keys(), dtype=np.int64, count=len(bag))
        order = np.argsort(at)
        at = at[order]
        weight = (1.0 + np.log(np.fromiter(bag.values(), dtype=np.float64, count=len(bag))[order])) * self.weights[at]
        norm = np.sqrt((weight * weight).sum())
        return at, weight / norm if norm else weight

    def nearest(self, bag: dict[int, int], but: int = -1, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples, nearest first; of equals those met first."""
        at, weight = self.vector(bag)
        if not len(at):
            return np.empty(0, dtype=np.int64), np.empty(0)
        bound = weight @ self.most[at]
        order = np.argsort(-bound, kind="stable")
        best_at, best = np.empty(0, dtype=np.int64), np.empty(0)
        for b in order:
            if bound[b] <= 0 or len(best) == k and bound[b] <= best[-1] + 1e-12:
                break
            cos = weight @ self.blocks[b][at]
            if 0 <= but - b * BLOCK < len(cos):
                cos[but - b * BLOCK] = 0.0
            mine = np.flatnonzero(cos > (best[-1] if len(best) == k else 0.0))
            if not len(mine):
                continue
            at_, cos_ = np.concatenate([best_at, mine + b * BLOCK]), np.concatenate([best, cos[mine]])
            keep = np.argsort(-cos_, kind="stable")[:k]
            best_at, best = at_[keep], cos_[keep]
        return best_at, best

    def vote(self, near: np.ndarray, cos: np.ndarray) -> float:
        """From -1 to 1: toxic less other neighbours, by cosine; a document near nothing votes -1."""
        if not len(near):
            return -1.0
        weight = cos / (1.0 + 1e-6 - np.minimum(cos, 1.0) + 0.25)
        return float((weight * (2.0 * self.toxic[near] - 1.0)).sum() / weight.sum())

    def fit_curve(self, votes: np.ndarray, share: float) -> None:
        """Logistic regression of the label on the vote by Newton steps, classes weighed to their share."""
        y = self.toxic
        w = np.where(y > 0, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
        x = np.stack([np.ones(len(y)), votes], axis=1)
        beta = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            grad = x.T @ (w * (y - p)) - 1e-2 * beta
            hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            beta += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        self.curve = (float(beta[0]), float(beta[1]))

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * vote))))


def automaton(names: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, name in enumerate(names):
        found.add_word(name, k)
    found.make_automaton()
    return found


def bag_of(found: ahocorasick.Automaton, text: str) -> dict[int, int]:
    """Counts of the chosen terms; under the next number, the words of the text."""
    said = plain(text)
    bag = Counter(k for _, k in found.iter(said))
    words = said.count(" ") - 1
    if words > 0:
        bag[len(found)] = words
    return bag


def evidence(n0: np.ndarray, n1: np.ndarray, size0: int, size1: int) -> np.ndarray:
    """1 - NOISE / chi-square (one degree of freedom) of terms in n0 and n1 examples of either class, not below 0."""
    both = (n0 + n1) / (size0 + size1)
    gap = n1 / size1 - n0 / size0
    test = gap * gap / (both * (1 - both) * (1 / size0 + 1 / size1) + 1e-9)
    noise = min(NOISE, test.max(initial=0.0) / 4)
    return np.maximum(0.0, 1 - np.divide(noise, test, out=np.ones_like(test), where=test > 0))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each class a term occurs."""
    seen: Counter = Counter()
    for b in batches:
        for t, c in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            seen.update((x, c) for x in terms(t or ""))
    keys = list(seen)
    yield pa.RecordBatch.from_pydict(
        {
            "term": pa.array([k[0] for k in keys], type=pa.string()), "toxic": pa.array([k[1] for k in keys], type=pa.int32()),
            "n": pa.array([seen[k] for k in keys], type=pa.int64()),
        }
    )


def _frequencies(names: list[str]):
    """In how many texts each of the named terms occurs, one line per term and task; line -1 counts the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts, total = automaton(names), np.zeros(len(names), dtype=np.int64), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                at = list({k for _, k in found.iter(plain(t or ""))})
                counts[at] += 1
            total += b.num_rows
        yield pa.RecordBatch.from_pydict({"at": np.append(np.arange(len(names)), -1).astype(np.int32), "n": np.append(counts, total)})

    return work


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1000, features: int = 4000) -> tuple[Index | None, float]:
    """The index fitted on a bounded sample of the training fold, and the share of toxic labels in that fold."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .where(crc_mod(F.col("doc_id"), FOLDS) != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    counts = {0: 0, 1: 0}
    for r in known.groupBy((F.col("toxic") != 0).cast("int").alias("toxic")).count().collect():
        counts[r["toxic"]] = r["count"]
    share = counts[1] / max(1, sum(counts.values()))
    if not all(counts.values()):
        return None, share
    ranked = known.withColumn("order", shuffled(F.lit("toxicity"), F.col("doc_id")))
    drawn = [ranked.where((F.col("toxic") != 0) == bool(c)).orderBy("order", "doc_id").limit(per_class).select("doc_id").collect() for c in (0, 1)]
    label = {r["doc_id"]: c for c in (0, 1) for r in drawn[c]}
    chosen = docs.sparkSession.createDataFrame([(k, v) for k, v in sorted(label.items())], "l_doc_id long, toxic int")
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_doc_id"))
    examples = cut(held.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))  # as many rows as examples
    size = {0: 0, 1: 0}
    for r in examples.groupBy("toxic").count().collect():
        size[r["toxic"]] = r["count"]
    if not all(size.values()):
        return None, share
    part = [F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    counted = examples.mapInArrow(_presence, "term string, toxic int, n long").groupBy("term").agg(*part)
    # Every term of the examples, a bounded number of texts; those without evidence weigh nothing.
    by_count = counted.groupBy("n0", "n1").agg(F.count("*").alias("terms")).collect()
    pairs = np.array([(r["n0"], r["n1"]) for r in by_count], dtype=np.float64).reshape(-1, 2)
    telling = dict(zip(map(tuple, pairs.astype(int).tolist()), evidence(pairs[:, 0], pairs[:, 1], size[0], size[1]).tolist(), strict=True))
    useful = sorted((-v, k) for k, v in telling.items() if v > 0)
    if not useful:
        return None, share
    said = docs.sparkSession.createDataFrame([(*k, -v) for v, k in useful], "t0 long, t1 long, evidence double")
    picked = counted.join(F.broadcast(said), (F.col("n0") == F.col("t0")) & (F.col("n1") == F.col("t1")))
    picked = picked.orderBy(F.desc("evidence"), "term").limit(features).collect()
    names = [r["term"] for r in picked]
    seen = {r["at"]: r["n"] for r in docs.select("text").mapInArrow(_frequencies(names), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    total = seen.pop(-1)
    often = np.array([seen[k] for k in range(len(names))] + [total], dtype=np.float64)
    weights = (np.log((1.0 + total) / (1.0 + often)) + 1.0) * np.array([r["evidence"] for r in picked] + [1.0])
    found = automaton(names)

    def bags(texts: list[str]) -> dict:
        out = [sorted(bag_of(found, t).items()) for t in texts]
        return {"at": [[k for k, _ in b] for b in out], "n": [[v for _, v in b] for b in out]}

    rows = map_texts(examples, ["doc_id", "toxic"], ["text"], {"at": "array<int>", "n": "array<int>"}, bags).collect()
    rows.sort(key=lambda r: r["doc_id"])
    index = Index(names, weights, [dict(zip(r["at"], r["n"], strict=True)) for r in rows], np.array([r["toxic"] for r in rows]), [r["doc_id"] for r in rows])
    votes = np.zeros(len(rows))
    for k, r in zip(index.place.tolist(), rows, strict=True):
        votes[k] = index.vote(*index.nearest(dict(zip(r["at"], r["n"], strict=True)), but=k))
    index.fit_curve(votes, share)
    return index, share


def scorer(index: Index | None, share: float):
    """Function: texts to scores and evidence."""

    def work(texts: list[str]) -> dict:
        if index is None:
            return {"_score": [share] * len(texts), "_evidence": [[] for _ in texts]}
        if not hasattr(index, "found"):
            index.found = automaton(index.names)
        near = [index.nearest(bag_of(index.found, t)) for t in texts]
        return {"_score": [index.score(index.vote(*x)) for x in near], "_evidence": [index.ids[x[0][:5]].tolist() for x in near]}

    return work


FIELDS = {"_score": "double", "_evidence": "array<long>"}


def score(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (doc_ids of the nearest examples, nearest first)."""
    scored = map_texts(docs, ["doc_id"], ["text"], FIELDS, scorer(*train(docs, labels, **how)))
    return scored.select(
        "doc_id", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_evidence").alias("evidence"),
    )


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that score under 0.5, all columns kept."""
    scored = map_texts(as_row(docs, text=F.col("text")), ["row"], ["text"], FIELDS, scorer(*train(docs, labels, **how)))
    return scored.where("_score < 0.5").select("row.*")
