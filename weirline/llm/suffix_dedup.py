"""Removal of repeated passages with suffix arrays, in shards that meet by content.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else, in
the same or another document. Strings are judged on the input; texts are UTF-8
bytes and no string crosses a document.

Strings are dealt out by content: the smallest hash of a GRAM-byte gram inside a
string is its key, alike wherever the string occurs. Neighbouring strings with
one key form a segment (the text they cover). Only segments whose key occurs
twice leave their document. Equal segments are one row with a count; all of a
segment that occurs twice goes. Different segments of a key meet in one shard,
whose suffix array (induced sorting) and permuted common prefixes say which of
their strings start twice.

A key whose different segments hold more than `room` bytes, as of a passage that very many
documents hold or of a long text that repeats itself, is not put into one shard: there every single string is a row,
and equal ones are counted in a shuffle. Shards are cut into arrays of about
SHARD bytes, whatever the number of tasks. Nothing is dropped or sampled.

Nulls: a null text is empty. A null doc_id is kept. Repeated rows are documents
of their own, so that texts of LENGTH bytes and more which occur in two rows are
removed from both. Empty tables give empty results; other columns are ignored;
texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from weirline.llm.common import as_row, tasks
from weirline.llm.chosen_path import Groups
from weirline.llm.suffix_array import common_prefixes, suffix_array
from weirline.sources.scratch import cut, stack

LENGTH, GRAM = 200, 80
#: Bytes of text that a worker hashes at once (some 100 bytes of memory for each), and those of one suffix array.
PIECE, SHARD = 1_000_000, 1_000_000
#: Strings that leave a task at once where each is a row.
STRINGS = 50_000
SEPARATOR = 255  # no UTF-8 text holds this byte


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hashes of all grams of GRAM (64 + 16) bytes, by doubling."""
    codes = np.random.default_rng(5).integers(0, 1 << 63, 256).astype(np.uint64)
    h, width, power, tail = codes[text], 1, 0x9E3779B97F4A7C15, None
    while width < 64:
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power % (1 << 64)
        if width == GRAM - 64:
            tail, shift = h, power
    h = h[: 64 - GRAM] * np.uint64(shift) + tail[64:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of width values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text number, first and last start of a string, key, and whether the key's gram occurs twice in the segment."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    text = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.empty(0, dtype=np.int64)
    if len(text) < LENGTH or (sizes < LENGTH).all():
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = gram_hashes(text)
    # The place goes into the low bits, so that the smallest value says where it is, from the left and from the right.
    place, high = np.arange(len(h), dtype=np.uint64), h & ~np.uint64(0xFFFFFF)
    span = LENGTH - GRAM + 1
    left = least(high | place, span) & np.uint64(0xFFFFFF)
    right = np.uint64(0xFFFFFF) - (least(high | (np.uint64(0xFFFFFF) - place), span) & np.uint64(0xFFFFFF))
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(left)]
    at = np.arange(len(left))
    at = at[at + LENGTH <= (starts + sizes)[owner]]
    left, right, owner = left[at].astype(np.int64), right[at].astype(np.int64), owner[at]
    key = h[left]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    twice = np.logical_or.reduceat(left != right, first) | (left[first] != left[last])
    return owner[first], at[first] - starts[owner[first]], at[last] - starts[owner[first]], key[first], twice


def pieces(data: bytes) -> list[tuple[int, bytes]]:
    """A very long text in parts that hold every string once."""
    step = 8 * PIECE
    return [(i, data[i : i + step + LENGTH - 1]) for i in range(0, max(1, len(data) - LENGTH + 1), step)]


def read(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[list[tuple], list[int], list[bytes]]]:
    """Rows, offsets and parts of texts, so many at once that numpy pays and memory stays bounded."""
    held, offsets, parts, size = [], [], [], 0
    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in (*columns, "data")], strict=True):
            for offset, part in pieces(row[-1] or b""):
                held.append(row[:-1])
                offsets.append(offset)
                parts.append(part)
                size += len(part)
                if size >= PIECE:
                    yield held, offsets, parts
                    held, offsets, parts, size = [], [], [], 0
    if held:
        yield held, offsets, parts


def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each text, twice where a segment repeats within itself."""
    for held, _, parts in read(batches, ("row",)):
        owner, _, _, key, twice = segments(parts)
        rows = np.array([h[0] for h in held], dtype=np.int64)[owner] if len(owner) else owner
        yield pa.RecordBatch.from_pydict({"row": rows, "key": key.view(np.int64), "n": (1 + twice).astype(np.int32)})


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments whose key is among the document's shared keys."""
    for held, offsets, parts in read(batches, ("row", "keys")):
        owner, first, last, key, twice = segments(parts)
        key = key.view(np.int64)
        shared = {i: np.array(sorted(held[i][1])) for i in set(owner.tolist())}
        out = []
        for o, a, b, k, t in zip(owner.tolist(), first.tolist(), last.tolist(), key.tolist(), twice.tolist(), strict=True):
            known = shared[o]
            i = np.searchsorted(known, k)
            if i < len(known) and known[i] == k:
                data = parts[o][a : b + LENGTH]
                out.append((held[o][0], a + offsets[o], k, xxh64_intdigest(data) - (1 << 63), t, data))
        kinds = [("row", pa.int64()), ("start", pa.int64()), ("key", pa.int64()), ("seg", pa.int64()), ("inner", pa.bool_()), ("data", pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def covered(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of bytes under the strings that begin at the (ascending) starts."""
    if not len(starts):
        return [], []
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + LENGTH]))
    return starts[new].tolist(), (starts[np.append(new[1:], len(starts)) - 1] + LENGTH).tolist()


def repeated_in(parts: list[bytes]) -> list[np.ndarray]:
    """For each segment the starts of strings that start twice among all of them."""
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", dtype=np.uint8)
    sa = suffix_array(text)
    before, prefix = common_prefixes(text, sa, max(map(len, parts)) + 1, SEPARATOR)
    hit = np.flatnonzero(prefix >= LENGTH)
    twice = np.zeros(len(text), dtype=bool)
    twice[hit] = True
    twice[before[hit]] = True
    out, at = [], 0
    for p in parts:
        out.append(np.flatnonzero(twice[at : at + max(0, len(p) - LENGTH + 1)]))
        at += len(p) + 1
    return out


COVER = "key long, seg long, starts array<int>, ends array<int>"


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over whole keys, which come sorted; what they cover of each segment."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out() -> pa.RecordBatch:
        runs = [covered(s) for s in repeated_in([h[2] for h in held])]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([h[0] for h in held], type=pa.int64()), pa.array([h[1] for h in held], type=pa.int64()),
                pa.array([r[0] for r in runs], type=pa.list_(pa.int32())), pa.array([r[1] for r in runs], type=pa.list_(pa.int32())),
            ],
            names=["key", "seg", "starts", "ends"],
        )

    for (key,), group in Groups(batches, ("key",), ("seg", "data")):
        held.extend((key, seg, data) for seg, data in group)
        size += sum(len(d) for _, d in group)
        if size >= SHARD:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def singly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the segments of a very common key, by a hash of 128 bits."""
    for b in batches:
        for key, seg, data in zip(*[b.column(c).to_pylist() for c in ("key", "seg", "data")], strict=True):
            for first in range(0, len(data) - LENGTH + 1, STRINGS):
                at = range(first, min(first + STRINGS, len(data) - LENGTH + 1))
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array([key] * len(at), type=pa.int64()), "seg": pa.array([seg] * len(at), type=pa.int64()), "at": pa.array(at, type=pa.int32()),
                        "string": pa.array([xxh3_128_digest(data[i : i + LENGTH]) for i in at], type=pa.binary()),
                    }
                )


def spans(docs: DataFrame, room: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """(row, data, pieces) of every text that loses bytes, pieces being covered runs; and all documents as (row, data, doc_id).

    row is a 64-bit hash of doc_id and text; repeated rows share it.
    """
    spark = docs.sparkSession
    parts = tasks(spark)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select("doc_id", data.alias("data")).withColumn("row", F.xxhash64("doc_id", "data"))
    all_keys = cut(texts.select("row", "data").where(F.octet_length("data") >= LENGTH).mapInArrow(keys, "row long, key long, n int"))
    shared = all_keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    by_row = all_keys.select("row", "key").join(shared, "key").groupBy("row").agg(F.collect_set("key").alias("keys"))
    hit = cut(texts.select("row", "data").join(by_row, "row"))
    found = cut(hit.mapInArrow(cut_out, "row long, start long, key long, seg long, inner boolean, data binary"))

    kinds = cut(found.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"), F.first("data").alias("data")))
    many = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("inner").alias("inside"), F.sum(F.octet_length("data")).alias("bytes"))
    whole = kinds.where("n > 1").select(
        "key", "seg", F.array(F.lit(0)).alias("starts"), F.array(F.octet_length("data")).alias("ends")
    )
    met = kinds.select("key", "seg", "data").join(many.where("kinds > 1 or inside"), "key")
    sharded = met.where(F.col("bytes") <= room).select("key", "seg", "data").repartition(parts, "key").sortWithinPartitions("key", "seg").mapInArrow(shards, COVER)
    strings = cut(met.where(F.col("bytes") > room).select("key", "seg", "data").mapInArrow(singly, "key long, seg long, at int, string binary"))
    common = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    single = strings.join(common.select("string"), "string").select("key", "seg", F.array("at").alias("starts"), F.array(F.col("at") + LENGTH).alias("ends"))
    cover = stack([whole, sharded, single]).where(F.size("starts") > 0)

    piece = F.explode(F.arrays_zip("starts", "ends"))
    placed = found.select("row", "start", "key", "seg").join(cover.select("key", "seg", piece.alias("p")), ["key", "seg"])
    runs = placed.select("row", F.struct((F.col("start") + F.col("p.starts")).alias("a"), (F.col("start") + F.col("p.ends")).alias("b")).alias("run"))
    per_row = runs.groupBy("row").agg(F.collect_set("run").alias("pieces"))
    return hit.select("row", "data").dropDuplicates(["row"]).join(per_row, "row"), texts


def kept(data: bytes, runs: list[dict]) -> tuple[bytes, int, int]:
    """The bytes that stay, the number removed, and the number of maximal runs removed."""
    out, at, removed, n, end = [], 0, 0, 0, -1
    for a, b in sorted((r["a"], r["b"]) for r in runs):
        if a > end:
            n += 1
            out.append(data[at:a])
            removed += b - a
        elif b > end:
            removed += b - end
        end = max(end, b)
        at = max(at, b)
    out.append(data[at:])
    return b"".join(out), removed, n


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(r, *kept(d, p)) for r, d, p in zip(*[b.column(c).to_pylist() for c in ("row", "data", "pieces")], strict=True)]
        yield pa.RecordBatch.from_pydict(
            {
                "row": pa.array([r[0] for r in rows], type=pa.int64()), "rest": [r[1].decode("utf-8", "ignore") for r in rows],
                "removed": pa.array([r[2] for r in rows], type=pa.int64()), "spans": pa.array([r[3] for r in rows], type=pa.int64()),
                "sha": [hashlib.sha256(r[1]).hexdigest() for r in rows],
            }
        )


REST = "row long, rest string, removed long, spans long, sha string"


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    losing, texts = spans(docs)
    done = losing.mapInArrow(_remove, REST).select("row", "removed", "spans", "sha")
    base = texts.select("doc_id", "row", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("whole"))
    return base.join(done, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
    )


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all columns kept, with what repeats taken out of the text.

    A character that loses a part of its bytes goes whole. A null text stays null.
    """
    losing, _ = spans(docs.select("doc_id", F.col(text).alias("text")))
    rest = losing.mapInArrow(_remove, REST).select(F.col("row").alias("of"), "rest")
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    met = as_row(docs, own=F.xxhash64(F.col("doc_id"), whole)).join(rest, F.col("own") == F.col("of"), "left")
    left = F.coalesce(F.col("rest"), F.col("row")[text])
    return met.select(*[left.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
