"""Vector codes, Merkle manifest and Hilbert shards against plain Python, and their awkward rows."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirline.llm import hilbert, merkle, vector_codes
from weirline.llm.order import numbered

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
        T.StructField("x", T.StringType()), T.StructField("code", T.StringType()), T.StructField("salt", T.StringType()),
    ]
)


def vectors(n=300, width=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = [[i, [float(v) for v in np.float32(rng.normal(size=width))], int(i % 3)] for i in range(n)]
    for i in range(60, 160):  # a hot vector
        rows[i][1] = rows[60][1]
    for i in range(160, 170):
        rows[i][2] = None
    rows += [[None, rows[3][1], 1], [5, rows[7][1], 1], [5, rows[5][1], 2], [900, None, 1], [901, [float("nan")] * width, 1], [902, [None] * width, 1], [903, [float("inf")] * width, 1]]
    return [(*r, "z", "z", "z") for r in rows]


def lloyd(rows, parts=8, entries=16, rounds=6):
    """The same rounds, row by row."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    longest = max(len(r[1]) for r in kept)
    width = max(1, -(-longest // parts))
    x = [[int(np.floor(4096 * float(v))) for v in r[1]] + [0] * (width * parts - len(r[1])) for r in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, x[i]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for v in cut:
                members[near(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(members, books[p])]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(
        ((r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], sha) for r, f, e in zip(kept, found, error)), key=str
    )


def coded(spark, rows, **how):
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3), **how).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("room", [8192, 40])
def test_codes_equal_plain_lloyd(spark, room):
    rows = vectors()
    assert coded(spark, rows, room=room) == lloyd(rows)


def test_codes_of_few_ragged_and_no_rows(spark):
    few = vectors()[:5]
    assert coded(spark, few) == lloyd(few)
    ragged = [(1, [0.5, -0.5, 0.25], 1, "", "", ""), (2, [], None, "", "", ""), (3, [1.0] * 9, None, "", "", ""), (3, [1.0] * 9, None, "", "", "")]
    assert coded(spark, ragged) == lloyd(ragged)
    assert coded(spark, []) == []
    assert coded(spark, vectors()[-4:]) == []
    nameless = [(None, r[1], None, "", "", "") for r in vectors()[:30]]
    assert coded(spark, nameless) == lloyd(nameless)


def test_owners_sum_without_an_exchange_and_tables_go(spark, capsys):
    rows = spark.createDataFrame(vectors(), VECTORS)
    seen = vector_codes.quantised(rows)
    first = np.zeros((8, 16, 2), np.int64)
    first[:, :, 0] = np.arange(16) * 300
    members = seen.select("x", F.lit(0).alias("salt")).mapInArrow(vector_codes._settle(first), vector_codes._MEMBER)
    home = vector_codes.Residents(members)
    owners = home.table.groupBy("position", "entry", "salt").agg(F.count("*").alias("n"))
    assert "Exchange" not in owners._jdf.queryExecution().executedPlan().toString()
    n = home.table.count()
    again = home.moved(first)  # nobody moves under the same codebooks
    assert home.table.mapInArrow(vector_codes._choose(first, True), vector_codes._MEMBER).count() == 0
    assert again.table.count() == n
    home.drop()
    assert not spark.catalog.tableExists(home.name)
    again.drop()


def test_decoded_vectors_are_near(spark):
    rows = spark.createDataFrame(vectors(), VECTORS)
    books = vector_codes.codebooks(vector_codes.quantised(rows))
    coded_ = vector_codes.compress(rows).select("vec_id", "code")
    got = vector_codes.decode(coded_, books).join(rows.dropna(subset=["embedding"]), "vec_id").collect()
    gaps = [np.square(np.subtract(r["approx"], r["embedding"])).sum() / 16 for r in got if np.isfinite(r["embedding"]).all()]
    assert np.mean(gaps) < 0.5  # unit variance before


# ---- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i ^ 1 < i, level[i ^ 1]) if i ^ 1 < len(level) else None)
        i //= 2
    return out


def plain_manifest(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    own = {}
    for lang in langs:
        mine = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        own[lang] = mine, tree_of([leaf_of(r) for r in mine])
    crown = tree_of([own[lang][1][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        mine, levels = own[lang]
        for i, r in enumerate(mine):
            steps = way(levels, i) + way(crown, place)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            acc = leaf_of(r, int(hit and r["n_chars"] is not None))
            for s in steps:
                acc = sha(acc) if s is None else sha(s[1] + acc) if s[0] else sha(acc + s[1])
            out.append((r["doc_id"], leaf_of(r), levels[-1][0], crown[-1][0], sha("".join(s[1] for s in steps if s)), acc, acc == crown[-1][0]))
    return sorted(out, key=str)


def test_manifest_equals_plain_python(spark, docs, no_docs):
    got = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str)
    assert got == plain_manifest(docs.collect())
    assert merkle.manifest(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 33, 70])
def test_manifest_of_several_strides(spark, docs, n):
    many = spark.createDataFrame(
        [(i, f"text {i}", lang, "s", i if i % 5 else None, "", "", "", "") for i in range(n) for lang in ("de", None, "é", "")][: n + 2 * (n > 3)], docs.schema
    )
    got = sorted((tuple(r) for r in merkle.manifest(many).collect()), key=str)
    assert got == plain_manifest(many.collect())
    one = many.withColumn("lang", F.lit("en"))
    assert sorted((tuple(r) for r in merkle.manifest(one).collect()), key=str) == plain_manifest(one.collect())


def test_nodes_hold_their_leaves(spark):
    leaves = spark.range(70).select(F.lit("t").alias("tree"), F.lit(70).cast("long").alias("n"), F.col("id").alias("lo"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    _, roots, nodes = merkle.forest(leaves, stride=3)
    levels = tree_of([sha(str(i)) for i in range(70)])
    assert roots.collect()[0]["root"] == levels[-1][0]
    got = {(r["level"], r["lo"]): (r["hi"], r["digest"]) for r in nodes.collect()}
    want = {(k, i << k): (min(69, ((i + 1) << k) - 1), d) for k, level in enumerate(levels) if k for i, d in enumerate(level)}
    assert got == want


# ---- Hilbert shards


@pytest.mark.parametrize("n, bits", [(2, 3), (3, 2), (1, 3)])
def test_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame([tuple(map(int, c)) for c in cells], ", ".join(f"c{i} long" for i in range(n)))
    got = df.select("*", hilbert.curve_index([F.col(f"c{i}") for i in range(n)], bits).alias("at")).orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(len(cells)))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in itertools.pairwise(got))


def test_shards_of_awkward_rows(spark, docs, no_docs):
    rows = docs.collect()
    for law in ("bytes", "rows"):
        got = hilbert.shard(docs, 3, law).collect()
        assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == sorted(
            str((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))) for r in rows
        )
        for s in {r["shard"] for r in got}:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
        assert {r["grown_shard"] for r in got} == {None}
    counts = [sum(r["shard"] == s for r in got) for s in range(3)]
    assert max(counts) - min(counts) <= 1
    assert hilbert.shard(no_docs).count() == 0
    assert hilbert.shard(docs.withColumn("shard", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("value", F.lit(1))).count() == len(rows)


def test_shards_near_equal_and_copies_split(spark, docs):
    many = spark.createDataFrame([(i, "copy " * 9 if i % 3 else "x" * (i % 90), "en", "s", 7, "", "", "", "") for i in range(3000)], docs.schema)
    sizes = {r["shard"]: r["b"] for r in hilbert.shard(many).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 2 * 91


def test_written_shards_exclude_each_other(spark, docs, tmp_path):
    langs = ("de", "en", "fr", "es")
    many = spark.createDataFrame([(i, "y" * (i % 61), langs[i % 4], f"s{i % 7}", i * 37 % 1000, "", "", "", "") for i in range(4000)], docs.schema)
    ranges = hilbert.write(many, str(tmp_path / "shards"), 16).collect()
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(tuple, back.select(*many.columns).collect())) == sorted(map(tuple, many.collect()))
    # A filter on either dimension leaves out a good part of the shards.
    assert sum(r["min_lang"] <= "de" <= r["max_lang"] for r in ranges) <= 8
    assert sum(r["min_n_chars"] <= 10 and 0 <= r["max_n_chars"] for r in ranges) <= 10
    held = {r["shard"]: (r["lo"], r["hi"]) for r in back.groupBy("shard").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi")).collect()}
    assert held == {r["shard"]: (r["min_n_chars"], r["max_n_chars"]) for r in ranges}


def test_numbered_counts_through_ranges(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i % 2, i) for i in range(500)], "g string, o int, v long")
    got = numbered(df, ["g"], ["o"], F.col("v")).collect()
    for g in "ab":
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own))) and [r["o"] for r in own] == sorted(r["o"] for r in own)
        assert [r["before"] for r in own] == [int(v) for v in np.concatenate([[0], np.cumsum([r["v"] for r in own])[:-1]])]
        assert {r["n"] for r in own} == {len(own)} and {r["total"] for r in own} == {sum(r["v"] for r in own)}
