"""Product codes of vectors by member-resident Lloyd rounds.

Every vector is cut into parts; each part position has a codebook of entries. A
member is one part of one vector. Members live with their owner, the group
(position, entry, salt), in a table bucketed by these three columns. In a round

- owners update: each sums up its resident members, without an exchange; only one line of
  sums per owner travels, and the salts of an entry are added up;
- members look for the nearest entry. Those whose entry stays the same stay in place; only the
  others go through a shuffle to their new owner.

The salt splits entries: there are so many salts that no owner can hold much more than
`room` members, even if all parts of a position choose one entry. The codebooks
(entries x components, fixed by the parameters) are all that reaches the driver
and is sent to the tasks. All arithmetic is in whole numbers, so results do not depend on order or salt.

Null vectors and vectors with null or non-finite components are left out. A null
vec_id is coded like any other and comes after all ids where the first entries are chosen; a repeated vec_id counts as often as it
occurs, equal ids ascending by components. A table of fewer rows than entries has as many entries as
rows. Vectors shorter than the longest, and lengths
that do not divide into parts, count as if padded with zeros. Components must lie
below 2^14 in magnitude, so that sums of squares are exact; a larger one is an error. Empty tables give an
empty result. Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import tasks
from weirline.sources.scratch import cut, drop_table, new_path

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Members that one owner holds at most, about; sets the number of salts.
ROOM = 8192
_LIMIT = 1 << 14
_MEMBER = "position int, entry int, salt int, x array<long>"
_OWNER = ["position", "entry", "salt"]


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """The columns to keep and x, the components as whole numbers floor(scale * component)."""
    doubles = F.transform(F.col(vector), lambda v: v.cast("double"))
    usable = F.forall(doubles, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    small = F.when(F.exists(doubles, lambda v: F.abs(v) >= _LIMIT), F.raise_error(F.lit(f"components must be below {_LIMIT}")).cast("array<long>"))
    x = F.coalesce(small, F.transform(doubles, lambda v: F.floor(v * F.lit(float(scale)))))
    return vectors.where(F.col(vector).isNotNull() & usable).select(*keep, x.alias("x"))


def _nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equally near ones) and its squared distance."""
    best = np.zeros(len(parts), np.int64)
    least = np.full(len(parts), np.iinfo(np.int64).max)
    for e, entry in enumerate(book):
        gap = parts - entry
        d = np.einsum("ij,ij->i", gap, gap)
        closer = d < least
        best[closer], least[closer] = e, d[closer]
    return best, least


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to width."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, type=pa.int32()), pa.array(np.ascontiguousarray(values).reshape(-1)))


def _members(batch_columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(batch_columns, names=["position", "entry", "salt", "x"])


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _settle(books: np.ndarray) -> Work:
    """Vectors to members, each with its nearest entry."""
    n_parts, _, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), n_parts * width)
            for p in range(n_parts):
                own = x[:, p * width : (p + 1) * width]
                entry, _ = _nearest(own, books[p])
                yield _members([pa.array(np.full(len(x), p, np.int32)), pa.array(entry.astype(np.int32)), batch.column("salt"), _lists(own)])

    return work


def _choose(books: np.ndarray, moving: bool) -> Work:
    """Members under the new codebooks: those that change their entry, or those that keep it."""
    width = books.shape[2]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, position, held = _matrix(batch.column("x"), width), batch.column("position").to_numpy(), batch.column("entry").to_numpy()
            entry = np.empty(len(x), np.int32)
            for p in np.unique(position):
                at = position == p
                entry[at] = _nearest(x[at], books[p])[0]
            wanted = np.nonzero((entry != held) == moving)[0]
            take = pa.array(wanted)
            yield _members([batch.column("position").take(take), pa.array(entry[wanted]), batch.column("salt").take(take), _lists(x[wanted])])

    return work


def _encode(books: np.ndarray) -> Work:
    """vec_id, label, code and error of whole vectors."""
    n_parts, _, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), n_parts * width)
            found = [_nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(n_parts)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = np.sum([f[1] for f in found], axis=0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in batch.schema.names if c != "x"], pa.array([r.tobytes().hex() for r in codes], type=pa.string()), pa.array(error)],
                names=[*[c for c in batch.schema.names if c != "x"], "code", "error"],
            )

    return work


class Residents:
    """The members, in a table bucketed by owner."""

    def __init__(self, members: DataFrame, stay: DataFrame | None = None):
        """members go to their owners; those of stay are with theirs already."""
        self.spark = members.sparkSession
        self.path = new_path(self.spark, "members")
        self.name = self.path.rsplit("/", 1)[1].replace("-", "_")
        self.buckets = tasks(self.spark)
        sent = members.repartition(self.buckets, *_OWNER)
        whole = sent if stay is None else stay.unionByName(sent)
        whole.write.option("path", self.path).bucketBy(self.buckets, *_OWNER).saveAsTable(self.name, format="parquet")
        self.table = self.spark.table(self.name)

    def sums(self, width: int) -> DataFrame:
        """(position, entry, n, s0, s1, ...): an owner's sums need no exchange, its bucket holds all its members."""
        totals = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)]
        owners = self.table.groupBy(*_OWNER).agg(F.count("*").alias("n"), *totals)
        return owners.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])

    def moved(self, books: np.ndarray) -> Residents:
        movers = self.table.mapInArrow(_choose(books, True), _MEMBER)
        stay = self.table.mapInArrow(_choose(books, False), _MEMBER)
        return Residents(movers, stay)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        drop_table(self.spark, self.path)


def codebooks(seen: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, room: int = ROOM) -> np.ndarray | None:
    """(parts, entries, width) after the rounds of Lloyd's algorithm; None for no rows."""
    facts = seen.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("longest")).first()
    first = seen.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()  # the entries: a fixed number
    if not first:
        return None
    width = max(1, -(-facts["longest"] // parts))
    books = np.zeros((parts, len(first), width), np.int64)
    for e, row in enumerate(first):
        books.transpose(1, 0, 2)[e] = np.pad(np.asarray(row["x"], np.int64), (0, parts * width - len(row["x"]))).reshape(parts, width)
    salts = max(1, -(-facts["n"] // room))
    salted = seen.select("x", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"))
    residents = Residents(salted.mapInArrow(_settle(books), _MEMBER))
    for r in range(rounds):
        if r:
            following = residents.moved(books)
            residents.drop()
            residents = following
        for row in residents.sums(width).collect():  # one row per entry in use
            books[row["position"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    residents.drop()
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, room: int = ROOM) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector."""
    out = "vec_id, code, error, label_error, codebooks_sha256".split(", ")
    seen = cut(quantised(vectors))
    books = codebooks(seen, parts, entries, rounds, room)
    if books is None:
        empty = seen.where("false").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long"), "label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")})
        return empty.select(*out)
    kinds = dict(seen.dtypes)
    coded = cut(seen.mapInArrow(_encode(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    # Joined without a hint: small totals are broadcast, a hot label among many is left to the adaptive skew join.
    whole = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return whole.withColumn("codebooks_sha256", F.lit(books_sha256(books))).select(*out)


def decode(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """coded with approx, the vector that the code stands for (padding included)."""
    flat = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in entry]) for entry in book]) for book in books])
    at = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books))]
    whole = F.flatten(F.array(*[F.get(F.get(flat, F.lit(p)), a) for p, a in enumerate(at)]))
    return coded.withColumn("approx", F.transform(whole, lambda v: (v + F.lit(0.5)) / F.lit(float(scale))))


def _sql() -> str:
    """The rounds unrolled in DuckDB's SQL; tables of equal lengths that divide into the parts."""
    dist = "list_sum(list_transform(list_zip(m.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""a{r} AS MATERIALIZED (
  SELECT m.row_id, m.position, arg_min(b.entry, ({dist})::HUGEINT * {ENTRIES} + b.entry) AS entry, min({dist}) AS error
  FROM members m JOIN b{r} b ON m.position = b.position GROUP BY m.row_id, m.position)""")
        if r < ROUNDS:
            rounds.append(f"""u{r} AS (
  SELECT position, entry, list(mean ORDER BY place) AS x FROM (
    SELECT a.position, a.entry, place, (sum(m.x[place]) - ((sum(m.x[place]) % count(*)) + count(*)) % count(*)) // count(*) AS mean
    FROM a{r} a JOIN members m ON m.row_id = a.row_id AND m.position = a.position, range(1, len(m.x) + 1) t(place) GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.position, b.entry, coalesce(u.x, b.x) AS x FROM b{r} b LEFT JOIN u{r} u ON u.position = b.position AND u.entry = b.entry)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row_id, vec_id, label,
         list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
members AS MATERIALIZED (
  SELECT row_id, position::INTEGER AS position, x[position * (len(x) // {PARTS}) + 1 : (position + 1) * (len(x) // {PARTS})] AS x FROM kept, range({PARTS}) p(position)),
b0 AS (SELECT position, row_id AS entry, x FROM members WHERE row_id < {ENTRIES}),
{", ".join(rounds)},
coded AS (
  SELECT row_id, string_agg(printf('%02x', entry), '' ORDER BY position) AS code, sum(error)::BIGINT AS error FROM a{ROUNDS} GROUP BY row_id),
books AS (
  SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY position, entry, place)) AS codebooks_sha256
  FROM (SELECT position, entry, place, x[place] AS v FROM b{ROUNDS}, range(1, len(x) + 1) t(place)))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row_id), books
"""


#: The same codes in DuckDB's SQL.
SQL = _sql()
