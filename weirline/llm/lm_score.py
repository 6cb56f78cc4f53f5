"""Language-model scores from a weighted backoff automaton.

Words (A-Z in lower case) and one end per text are the tokens; the texts outside
the held-out tenth teach the model. Every run of up to `order` - 1 tokens seen in
training is a state (a text begins in the state of the end). A state has an arc
for every token that followed it in training, with log10 of its discounted
share, and a failure arc to the state of the run without its first token; the
last of them is the root, whose arcs are the smoothed single-token
probabilities. A text is read once from left to right: each step takes the arc
of the longest state that has one, and pays the failure arcs passed on the way.

Failure weights are tied by length and frequency (powers of two) of the state
and hold the Witten-Bell estimate: T / (T + N), for T different arcs that N
tokens took. Seen arcs share the rest, so the arcs of a state never sum above 1.

No task holds the model. Texts are coded in blocks of BLOCK characters, each
with its own sorted dictionary of hashed tokens. A block sends its hashes and
training counts, cut by hash range, to the parts that add them up, and gets
counts back in the order it sent them: the block's slice of the automaton.
Blocks are of bounded size and there is a range per RANGE characters of input,
so both stay of bounded size; hot words cost one entry per block.

Nulls: a null text is empty and holds only the end; a null doc_id is kept, its
text for the held-out rule is empty. Repeated rows are scored, and teach, one by
one. Without training rows N is 0 and base scores use (0 + 0.1) / 0.1. Very long
texts make a block of their own. Empty tables give empty results; other columns
are ignored. Tokens are known by 64-bit hashes, runs by BITS bits: among 10 billion
different runs, a run is taken for another with a probability of 1 in 7 million.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weirline.llm.common import crc_mod, tasks
from weirline.sources.scratch import cut

FOLDS, BLOCK, RANGE, ADD, CLASSES, ORDER = 10, 12_000_000, 96_000_000, 0.1, 48, 3
#: Bits of a run's hash that travel.
BITS = 56
#: No word has a space, so this hash belongs to the end alone.
END = xxh64_intdigest(b" end")

ROW = "block string, kind string, part int, a binary, b binary, c binary, ids array<long>"
#: Steps by class of state: classes and counts of taken and of failure arcs; a block's sums of different arcs and of tokens on its first row.
SCORED = (
    "doc_id long, n_tokens long, n_known long, base_score double, arcs double, took array<int>, took_n array<int>, "
    "failed array<int>, failed_n array<int>, kinds array<double>, after array<long>"
)


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers in few bytes: differences if they ascend, then byte by byte of equal weight."""
    values = np.ascontiguousarray(values)
    if ascending and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(size, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if ascending else values


def rows(made: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    names = ["block", "kind", "part", "a", "b", "c", "ids"]
    return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], type=k) for i, k in enumerate(kinds)], names=names)


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS != 0


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to blocks: each text as places (a) among the sorted hashes of the distinct tokens (c), and its length (b)."""
    n = 0
    place: defaultdict = defaultdict()
    place.default_factory = place.__len__
    ids: list = []
    texts: list[np.ndarray] = []
    size = 0

    def block() -> pa.RecordBatch:
        nonlocal n, size
        hashes = np.fromiter((END if w is None else xxh64_intdigest(w) for w in place), dtype=np.uint64, count=len(place))
        found, rank = np.unique(hashes, return_inverse=True)
        tokens = rank.astype(np.uint32)[np.concatenate(texts)]
        lengths = np.array([len(t) for t in texts], dtype=np.uint32)
        name = f"{TaskContext.get().partitionId()}-{n}"
        n += 1
        out = rows([(name, "text", None, packed(tokens), packed(lengths), packed(found, True), list(ids))])
        place.clear()
        ids.clear()
        texts.clear()
        size = 0
        return out

    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = (t or "").encode("utf-8", "replace").lower().split()
            words.append(None)
            ids.append(i)
            texts.append(np.fromiter(map(place.__getitem__, words), dtype=np.uint32, count=len(words)))
            size += len(t or "")
            if size >= BLOCK:
                yield block()
    if ids:
        yield block()


def grams(hashes: np.ndarray, tokens: np.ndarray, end: int, order: int) -> Iterator[np.ndarray]:
    """Hashes of the runs of 2 to order tokens that end at each token; the first of a text follows an end, as it does in the block's row of tokens."""
    own = hashes[tokens]
    run = own
    for _ in range(2, order + 1):
        before = np.concatenate([hashes[[end]], run[:-1]])
        run = (before ^ (before >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + own
        run ^= run >> np.uint64(29)
        run *= np.uint64(0xBF58476D1CE4E5B9)
        run ^= run >> np.uint64(32)
        yield run & np.uint64((1 << 64) - (1 << (64 - BITS)))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of every value among them."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, dtype=bool)
    at = np.empty(len(values), dtype=np.int64)
    at[order] = np.cumsum(first) - 1
    return s[first], at


class Blocks:
    """Puts the rows of a block, which come together in order of kind, into one."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.batches = batches

    def __iter__(self) -> Iterator[dict]:
        name, held = None, {}
        for b in self.batches:
            for r in b.to_pylist():
                if r["block"] != name:
                    if held:
                        yield held
                    name, held = r["block"], {"block": r["block"]}
                if r["part"] is None:
                    held[r["kind"]] = r
                else:
                    held.setdefault(r["kind"], {})[r["part"]] = r["a"]
        if held:
            yield held


def opened(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """hashes, tokens, lengths, training flag and place in its text of each token, place of the end among the hashes."""
    hashes = unpacked(block["text"]["c"], np.uint64, True)
    tokens = unpacked(block["text"]["a"], np.uint32).astype(np.int64)
    lengths = unpacked(block["text"]["b"], np.uint32).astype(np.int64)
    trains = np.repeat(np.array([in_training(i) for i in block["text"]["ids"]]), lengths)
    place = (np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).clip(0, 1 << 30).astype(np.int32)
    return hashes, tokens, lengths, trains, place, int(np.searchsorted(hashes, np.uint64(END)))


def cuts(n: int) -> np.ndarray:
    """Lower ends of n equal ranges of hashes, but the first."""
    return np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)


def requests(n_parts: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in Blocks(batches):
            hashes, tokens, _, trains, place, end = opened(block)

            def sent(kind: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
                ends = np.concatenate([[0], np.searchsorted(keys, cuts(n_parts)), [len(keys)]])
                return rows(
                    [
                        (block["block"], kind, p, packed(keys[ends[p] : ends[p + 1]], True), packed(n[ends[p] : ends[p + 1]].astype(np.uint32)), None, None)  # noqa: B023
                        for p in range(n_parts) if ends[p + 1] > ends[p]
                    ]
                )

            yield sent("1", hashes, np.bincount(tokens[trains], minlength=len(hashes)))
            for n, run_ in enumerate(grams(hashes, tokens, end, order), 2):
                whole = place >= n - 2  # runs that begin before their text are none
                keys, at = distinct(run_[whole])
                yield sent(str(n), keys, np.bincount(at[trains[whole]], minlength=len(keys)))

    return run


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counts of a part (its rows come together) and answers each block in its own order."""

    def total(key: tuple, asked: list[tuple[str, bytes, bytes]]) -> pa.RecordBatch:
        kind, part = key
        hashes = [unpacked(a, np.uint64, True) for _, a, _ in asked]
        counts = np.concatenate([unpacked(b, np.uint32) for _, _, b in asked])
        keys, at = distinct(np.concatenate(hashes))
        sums = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.uint64)
        ends = np.cumsum([0] + [len(h) for h in hashes])
        made = [(name, kind, part, packed(sums[at[ends[i] : ends[i + 1]]]), None, None, None) for i, (name, _, _) in enumerate(asked)]
        return rows(made + [("", kind, part, None, None, None, [int(sums.sum()), int((sums > 0).sum())])])

    key, asked = None, []
    for b in batches:
        for r in b.to_pylist():
            if (r["kind"], r["part"]) != key:
                if asked:
                    yield total(key, asked)
                key, asked = (r["kind"], r["part"]), []
            asked.append((r["block"], r["a"], r["b"]))
    if asked:
        yield total(key, asked)


def per_text(n: int, width: int, doc: np.ndarray, class_: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Classes met by each of n texts, and how often."""
    keys, counts = np.unique(doc * width + class_, return_counts=True)
    ends = np.searchsorted(keys, np.arange(n + 1) * width).astype(np.int32)
    return tuple(pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (keys % width, counts))


def walk(n_all: int, v_all: int, order: int):
    """Reads every text of a block through the block's slice of the automaton."""
    under, width = n_all + ADD * (v_all + 1), (order - 1) * CLASSES

    def joined(answers_: dict[int, bytes]) -> np.ndarray:
        return np.concatenate([unpacked(answers_[p], np.uint64) for p in sorted(answers_)]).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in Blocks(batches):
            hashes, tokens, lengths, trains, place, end = opened(block)
            n, doc = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
            seen = joined(block["1"])
            weight = (np.log10(seen + ADD) - np.log10(under))[tokens]
            base, n_known = np.bincount(doc, weights=weight, minlength=n), np.bincount(doc[seen[tokens] > 0], minlength=n)
            state = seen[np.concatenate([[end], tokens[:-1]])]
            kinds, after = np.zeros(width), np.zeros(width, dtype=np.int64)
            passed = []  # per length of state: class, or -1 where there is no such state
            longest = np.full(len(tokens), -1, dtype=np.int8)  # length of the state whose arc is taken, -1 for the root
            for k, run_ in enumerate(grams(hashes, tokens, end, order)):
                whole = place >= k
                times = np.zeros(len(tokens))
                if whole.any():
                    times[whole] = joined(block[str(k + 2)])[distinct(run_[whole])[1]]
                state[~whole] = 0
                class_ = (k * CLASSES + np.floor(np.log2(np.maximum(state, 1))).clip(0, CLASSES - 1)).astype(np.int16)
                taught = trains & whole
                kinds += np.bincount(class_[taught], weights=1 / times[taught], minlength=width)
                after += np.bincount(class_[taught], minlength=width)
                arc = times > 0
                weight[arc] = np.log10(times[arc]) - np.log10(state[arc])
                longest[arc] = k
                class_[state == 0] = -1
                passed.append(class_)
                state = np.concatenate([[0], times[:-1]])
            took, failed = [], []
            for k, class_ in enumerate(passed):
                arc, fails = longest == k, (longest < k) & (class_ >= 0)
                took.append((doc[arc], class_[arc]))
                failed.append((doc[fails], class_[fails]))
            took, took_n = per_text(n, width, *map(np.concatenate, zip(*took, strict=True)))
            failed, failed_n = per_text(n, width, *map(np.concatenate, zip(*failed, strict=True)))
            none = [None] * (n - 1)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(block["text"]["ids"], type=pa.int64()), "n_tokens": pa.array(lengths, type=pa.int64()),
                    "n_known": pa.array(n_known, type=pa.int64()),
                    "base_score": base, "arcs": np.bincount(doc, weights=weight, minlength=n),
                    "took": took, "took_n": took_n, "failed": failed, "failed_n": failed_n,
                    "kinds": pa.array([kinds.tolist(), *none], type=pa.list_(pa.float64())),
                    "after": pa.array([after.tolist(), *none], type=pa.list_(pa.int64())),
                }
            )

    return run


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, by runs of up to `order` (2 or more) tokens."""
    spark = docs.sparkSession
    blocks = cut(docs.select("doc_id", "text").mapInArrow(coded, ROW))
    parts = tasks(spark)
    ranges = max(parts, -(-blocks.count() * BLOCK // RANGE))
    asked = blocks.mapInArrow(requests(ranges, order), ROW)
    replies = cut(asked.repartition(ranges, "kind", "part").sortWithinPartitions("kind", "part", "block").mapInArrow(answers, ROW))
    sums = replies.where("kind = '1' and block = ''").agg(F.sum(F.col("ids")[0]).alias("n"), F.sum(F.col("ids")[1]).alias("v")).first()
    n_all, v_all = sums["n"] or 0, sums["v"] or 0
    met = blocks.unionByName(replies.where("block != ''")).repartition(parts, "block").sortWithinPartitions("block", "kind", "part")
    walked = cut(met.mapInArrow(walk(n_all, v_all, order), SCORED))

    classes = walked.where("after is not null").select(F.posexplode(F.arrays_zip("kinds", "after")).alias("class", "x"))
    seen = {r["class"]: (r["t"], r["n"]) for r in classes.groupBy("class").agg(F.sum("x.kinds").alias("t"), F.sum("x.after").alias("n")).collect()}
    fail = [(t + 0.5) / (t + n + 1.0) for t, n in (seen.get(c, (0, 0)) for c in range((order - 1) * CLASSES))]
    arc_cost = F.array(*[F.lit(float(np.log10(1.0 - f))) for f in fail])
    fail_cost = F.array(*[F.lit(float(np.log10(f))) for f in fail])

    def dot(classes: str, counts: str, costs):
        return F.aggregate(F.zip_with(F.col(classes), F.col(counts), lambda k, n: n * F.get(costs, k)), F.lit(0.0), lambda a, x: a + x)

    return walked.select(
        "doc_id", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
        "base_score", (F.col("arcs") + dot("took", "took_n", arc_cost) + dot("failed", "failed_n", fail_cost)).alias("score"),
    )
