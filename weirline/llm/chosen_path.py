"""N-gram Jaccard join by chosen paths.

Documents are sets of hashed shingles (five words; a shorter text is one
shingle). Equal sets are one representative from the start.

Search: a set joins the bucket of each of its shingles whose hash falls under
RUNS / size, about RUNS independent draws, in which two sets draw alike as far
as they overlap. Buckets are compared by brute force on sketches of 64 min-hash
values, with a margin below the threshold: whole within `room` sets, block
against block up to `blocks` times room. Only larger ones are split. Their sets
start over with twice the draws, and where a bucket is still too large each set
follows PATHS more of its shingles on average, sampled by a hash of the path so
far, so that similar sets tend to stay together and others part. What is still
too large after `depth` splits is compared completely, block against block.

A pair at similarity 0.8 shares no draw with probability exp(-0.8 * RUNS), 3 in a
million. If a bucket they share is split, both start over; that all of their
shared draws are in buckets split three times and no path holds them together
has a probability under 1 in a million (computed: 1e-8 for sets of equal size,
6e-7 for a set within the other).

Check: what the search connects is a family; families are disjoint, so each set
travels once. The exact Jaccard similarity of all pairs of a family is taken in
tiles of about `tile` by `tile` sets. No pair is ever a row: a tile returns,
per set, the links found and the smallest member of its connected part.

Result: one row per document with class_id, the smallest doc_id of its class
(null if the class has none), and n_links, the number of other documents at or
above the threshold, equal ones included.

Nulls: a null or empty text has no shingle, no links, and is a class of its own
(class_id = doc_id). A null doc_id is kept. Repeated rows are equal sets and
link to each other. Empty tables give empty results; other columns are ignored;
long texts are taken whole. Words are compared in lower case.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weirline.llm.common import as_row, map_texts, tasks
from weirline.llm.quality import mixed
from weirline.sources.scratch import cut, stack

WORDS, THRESHOLD, RUNS, POOL, SKETCH = 5, 0.8, 16, 24, 64
#: Shingles a set follows on average where a bucket is split; a pair at the threshold follows 1.6 of them together.
PATHS = 2.0
#: Equal sketch values for a pair to be checked; 64 * 0.8 less five standard deviations.
LIKELY = 35


def shingle_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    code: defaultdict = defaultdict()
    code.default_factory = code.__len__
    ids = []
    for t in texts:
        words = t.lower().encode("utf-8", "replace").split()
        ids.append(np.fromiter(map(code.__getitem__, words), dtype=np.int64, count=len(words)))
    codes = np.fromiter(map(xxh64_intdigest, code), dtype=np.uint64, count=len(code))
    out = []
    base = np.uint64(0x9E3779B97F4A7C15)
    for i in ids:
        c = codes[i]
        if not len(c):
            out.append(c)
            continue
        width = min(n, len(c))
        h = c[: len(c) - width + 1].copy()
        for k in range(1, width):
            h = h * base + c[k : len(c) - width + 1 + k]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        out.append(np.unique(h))
    return out


def drawn(values: np.ndarray, sizes: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Which shingles a set draws: about count of them, by a hash that all sets share."""
    share = (mixed(values ^ np.uint64(seed)) >> np.uint64(11)).astype(np.float64) / 2**53
    return share * sizes < count


def described(texts: list[str]) -> dict:
    """Size, hash, drawn shingles, pool and sketch of each set."""
    sets = shingle_sets(texts)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    full = np.flatnonzero(sizes)
    out = {
        "n": sizes, "set_hash": [np.uint64(xxh64_intdigest(s.tobytes())).astype(np.int64) if len(s) else None for s in sets],
        "draws": [[] for _ in sets], "twice": [[] for _ in sets], "pool": [[] for _ in sets], "sketch": [b""] * len(sets),
    }
    if not len(full):
        return out
    values = np.concatenate([sets[k] for k in full])
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    wide = np.repeat(sizes[full], sizes[full])
    for name, count, seed in (("draws", RUNS, 0x5EED), ("twice", 2 * RUNS, 0x5EED), ("pool", POOL, 0xF00D)):
        which = drawn(values, wide, count, seed)
        picked, ends = values[which].astype(np.int64), np.cumsum(np.add.reduceat(which.astype(np.int64), starts))
        for k, a, b in zip(full, np.concatenate([[0], ends[:-1]]), ends, strict=True):
            out[name][k] = picked[a:b].tolist()
    odd = np.random.default_rng(11).integers(0, 1 << 62, SKETCH).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.stack([np.minimum.reduceat(values * m, starts) for m in odd], axis=1)
    sketch = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
    for k, row in zip(full, sketch, strict=True):
        out["sketch"][k] = row.tobytes()
    return out


class Groups:
    """Rows of one key, which come sorted, as one group."""

    def __init__(self, batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]) -> None:
        self.batches, self.keys, self.columns = batches, keys, columns

    def __iter__(self) -> Iterator[tuple[tuple, list[tuple]]]:
        key, held = None, []
        for b in self.batches:
            parts = [b.column(c).to_pylist() for c in (*self.keys, *self.columns)]
            for row in zip(*parts, strict=True):
                k = row[: len(self.keys)]
                if k != key:
                    if held:
                        yield key, held
                    key, held = k, []
                held.append(row[len(self.keys) :])
        if held:
            yield key, held


def joined(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position connected to each of n positions."""
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for left, right in links:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets to edges of a forest that connects the sets with like sketches.

    A task gives an edge only between sets it has not connected yet, so that a group
    met in many buckets gives as many edges as it has members.
    """
    left, right = [], []
    known: dict[int, int] = {}

    def find(x: int) -> int:
        while known.setdefault(x, x) != x:
            known[x] = known[known[x]]
            x = known[x]
        return x

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict({"a": pa.array(left, type=pa.int64()), "b": pa.array(right, type=pa.int64())})
        left.clear()
        right.clear()
        return made

    for _, group in Groups(batches, ("path", "i", "j"), ("s", "sketch")):
        if len(group) < 2:
            continue
        group.sort()
        x = np.frombuffer(b"".join(g[1] for g in group), dtype=np.uint16).reshape(len(group), SKETCH)
        root = np.arange(len(group))
        for i in range(len(group) - 1):
            near = i + 1 + np.flatnonzero((x[i + 1 :] == x[i]).sum(axis=1) >= LIKELY)
            if len(near):
                parts = np.unique(root[np.append(near, i)])
                if len(parts) > 1:
                    root[np.isin(root, parts)] = parts[0]
        for i, r in enumerate(root.tolist()):
            if r != i:
                a, b = find(group[r][0]), find(group[i][0])
                if a != b:
                    known[b] = a
                    left.append(group[r][0])
                    right.append(group[i][0])
        if len(known) > 500_000:
            known.clear()
        if len(left) > 50_000:
            yield out()
    yield out()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by columns of shared shingles."""
    m = len(sets)
    if m <= 6:
        got = np.zeros((m, m))
        for i in range(m):
            for j in range(i + 1, m):
                got[i, j] = got[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return got
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    got = np.zeros((m, m), dtype=np.float64)
    if not len(row):
        return got
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    width = 4096
    ends = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b > a:
            x = np.zeros((m, width), dtype=np.float32)
            x[row[a:b], column[a:b] % width] = 1
            got += x @ x.T
    return got


def checked(threshold: float):
    """Tiles of a family: links per set (weighed by copies) and the smallest set connected to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []

        def made() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], type=pa.int64()) for c in range(4)], names=["family", "s", "root", "links"])
            out.clear()
            return got

        for (family, i, j), group in Groups(batches, ("family", "i", "j"), ("s", "mine", "copies", "shingles")):
            group = list({g[0]: g for g in group}.values())
            group.sort(key=lambda g: g[0])
            sets = [np.frombuffer(g[3], dtype=np.uint64) for g in group]
            sizes = np.array([len(x) for x in sets], dtype=np.float64)
            common = overlaps(sets)
            like = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
            np.fill_diagonal(like, False)
            if i != j:  # sets of one block meet in that block's own tile
                mine = np.array([g[1] for g in group])
                like &= mine[:, None] != mine[None, :]
            copies = np.array([g[2] for g in group], dtype=np.int64)
            links = like.astype(np.float64) @ copies
            root = joined(len(group), [np.nonzero(np.triu(like))])
            out.extend((family, g[0], group[r][0], int(n)) for g, r, n in zip(group, root.tolist(), links, strict=True))
            if len(out) > 20_000:
                yield made()
        yield made()

    return run


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest connected node) for edges a, b, by alternating large and small stars.

    Every round is written and read again. Rounds grow with the logarithm of the
    longest chain, and edges never become more.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = stack([e, e.select(F.col("v").alias("u"), F.col("u").alias("v"))])
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(floor, "u")
        small = stack([met.select("u", F.col("m").alias("v")), met.select(F.col("v").alias("u"), F.col("m").alias("v"))])
        e = cut(small.where("u != v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root")


def blocked(df: DataFrame, size: str, room: int, s: str = "s") -> DataFrame:
    """Keys i <= j of the tiles a set belongs to: one for a group within room, else one per other block."""
    groups = F.ceil(F.col(size) / room).cast("long")
    mine = F.when(groups > 1, F.pmod(F.xxhash64(F.lit(3), F.col(s)), groups)).otherwise(F.lit(0).cast("long"))
    return (
        df.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)))
        .withColumn("i", F.least("mine", "other"))
        .withColumn("j", F.greatest("mine", "other"))
        .drop("other")
    )


def buckets(reps: DataFrame, room: int, depth: int, blocks: int) -> DataFrame:
    """path, s and size of the buckets with two sets or more."""
    most = blocks * room
    rows = reps.select("s", F.explode("draws").alias("path"))
    done = []
    for level in range(-1, depth + 1):
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        met = cut(rows.join(sizes, "path"))
        last = level == depth or met.where(F.col("size") > most).limit(1).count() == 0
        done.append(met if last else met.where(F.col("size") <= most))
        if last:
            break
        more = met.where(F.col("size") > most).select("path", "s")
        if level < 0:  # both sets of a pair in a split bucket start over, so every draw they share counts
            again = more.select("s").distinct().join(reps.select("s", "twice"), "s")
            rows = again.select("s", F.explode(F.transform("twice", lambda t: F.xxhash64(t))).alias("path"))
            continue
        share = F.lit(1_000_000 * PATHS)
        sampled = F.filter("pool", lambda t: F.pmod(F.xxhash64("path", t), F.lit(1_000_000)) * F.size("pool") < share)  # noqa: B023
        more = more.join(reps.select("s", "pool"), "s")
        rows = more.select("s", F.explode(F.transform(sampled, lambda t: F.xxhash64(t, "path"))).alias("path")).distinct()
    return stack(done)


def classes_of(docs: DataFrame, threshold: float = THRESHOLD, room: int = 2048, depth: int = 3, tile: int = 512, blocks: int = 8) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), class_key, class_id and n_links of every document."""
    spark = docs.sparkSession
    parts = tasks(spark)
    fields = {"n": "long", "set_hash": "long", "draws": "array<long>", "twice": "array<long>", "pool": "array<long>", "sketch": "binary"}
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    sets = cut(map_texts(keyed, ["doc_id", "row"], ["text"], fields, described))
    held = F.struct("draws", "twice", "pool", "sketch")
    reps = cut(
        sets.where("n > 0").groupBy(F.col("set_hash").alias("s"))
        .agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first(held).alias("h"))
        .select("s", "id", "copies", "h.*")
    )
    met = blocked(buckets(reps, room, depth, blocks), "size", room).select("path", "i", "j", "s")
    tiles = met.join(reps.select("s", "sketch"), "s").repartition(parts, "path", "i", "j").sortWithinPartitions("path", "i", "j")
    families = components(tiles.select("path", "i", "j", "s", "sketch").mapInArrow(likely, "a long, b long"))
    members = cut(stack([families.select(F.col("root").alias("family"), F.col("node").alias("s")), families.select(F.col("root").alias("family"), F.col("root").alias("s")).distinct()]))
    members = members.join(members.groupBy("family").agg(F.count(F.lit(1)).alias("size")), "family").join(reps.select("s", "id", "copies"), "s")

    found = docs.select("doc_id", "text").join(members, F.col("doc_id").eqNullSafe(F.col("id")))

    def sets_of(texts: list[str]) -> dict:
        made = shingle_sets(texts)
        return {"own": [np.uint64(xxh64_intdigest(x.tobytes())).astype(np.int64) for x in made], "shingles": [x.tobytes() for x in made]}

    whole = map_texts(found, ["family", "s", "size", "copies"], ["text"], {"own": "long", "shingles": "binary"}, sets_of).where("own = s")
    tiled = blocked(whole, "size", tile).select("family", "i", "j", "s", "mine", "copies", "shingles")
    tiled = tiled.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j")
    linked = cut(tiled.mapInArrow(checked(threshold), "family long, s long, root long, links long"))
    links = linked.groupBy("s").agg(F.sum("links").alias("links"))
    classes = components(linked.select(F.col("s").alias("a"), F.col("root").alias("b")))
    per_set = (
        reps.select("s", "id", "copies").join(links, "s", "left").join(classes.withColumnRenamed("node", "s"), "s", "left")
        .withColumn("root", F.coalesce("root", "s"))
    )
    per_set = cut(per_set)
    named = per_set.groupBy("root").agg(F.min("id").alias("class_id"))
    final = per_set.join(named, "root").select("s", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # Sets without shingles meet nothing; a key of their own keeps them apart.
    own = F.coalesce("set_hash", F.xxhash64(F.lit("none"), "row"))
    some = F.col("n") > 0
    return sets.select("doc_id", "row", own.alias("s"), "n").join(final, "s", "left").select(
        "doc_id", "row", F.when(some, F.col("root")).otherwise(F.col("s")).alias("class_key"),
        F.when(some, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(some, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
    )


def join(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    return classes_of(docs, **how).select("doc_id", "class_id", "n_links")


def one_each(docs: DataFrame, **how) -> DataFrame:
    """The documents, all columns kept, without all but one of each class: the smallest doc_id stays (null last)."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    stay = classes_of(docs, **how).groupBy("class_key").agg(best).select(F.col("best.row").alias("stay"))
    keyed = as_row(docs, own=F.xxhash64("doc_id", "text")).join(stay, F.col("own") == F.col("stay"))
    return keyed.dropDuplicates(["own"]).select("row.*")
