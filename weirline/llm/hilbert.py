"""Shards along a Hilbert curve through the metadata, so that a filter on any dimension touches few files.

Each dimension is quantised to 2^bits bins of equal depth: the bin of a value is
the share of rows with a smaller value. The bins of a row are its coordinates;
rows are sorted by the index of that cell on the Hilbert curve and cut into
consecutive runs, one per shard. Neighbours on the curve are neighbours in every
dimension, so a shard covers a small box, and its minimum and maximum per
dimension exclude it from most filters.

Law bytes: the runs are cut at equal sums of sizes, each boundary to within half a row. Law
rows: at equal numbers of rows, counts at most one apart. Within a cell, equal texts
lie together and then rows follow doc_id. Groups of equal texts may be cut:
one of a third of all rows fits no shard.

Nulls: a null dimension sorts before all values; a null text has size 1 and the
checksum of the empty text; a null doc_id comes first within equal texts.
Repeated rows are placed one by one. Empty tables give empty results. Columns
that are neither dimensions nor doc_id and text are ignored, so their names cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirline.llm.order import numbered
from weirline.sources.scratch import cut

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 8


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def curve_index(axes: list[Column], bits: int = BITS) -> Column:
    """Place of a cell on the Hilbert curve (Skilling's transform); axes are longs below 2^bits."""
    n = len(axes)
    if n * bits > 62:
        raise ValueError("dimensions times bits must stay below 63")
    masks = [1 << b for b in reversed(range(bits))]
    steps = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q in masks[:-1] for i in range(n)])

    def unfold(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        own = F.get(x, s["i"])
        set_ = own.bitwiseAND(s["q"]) != 0
        swap = F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, j: F.when(set_ & (j == 0), v.bitwiseXOR(low)).when(~set_ & ((j == 0) | (j == s["i"])) & (s["i"] != 0), v.bitwiseXOR(swap)).otherwise(v),
        )

    turned = F.aggregate(steps, F.array(*axes), unfold) if bits > 1 else F.array(*axes)

    def number(x: Column) -> Column:
        gray = [reduce(lambda a, b: a.bitwiseXOR(b), [F.get(x, F.lit(j)) for j in range(i + 1)]) for i in range(n)]
        flip = F.aggregate(
            _ints(masks[:-1]) if bits > 1 else F.array().cast("array<long>"),
            F.lit(0).cast("long"),
            lambda t, q: F.when(gray[-1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
        )
        return F.transform(F.array(flip), lambda t: F.array(*[g.bitwiseXOR(t) for g in gray]))[0]

    coded = F.transform(F.array(turned), number)[0]
    return F.aggregate(
        F.flatten(F.transform(_ints(masks), lambda q: F.transform(coded, lambda v: F.when(v.bitwiseAND(q) != 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))),
        F.lit(0).cast("long"),
        lambda index, bit: index * 2 + bit,
    )


def binned(rows: DataFrame, dimension: str, bits: int = BITS) -> DataFrame:
    """rows with <dimension>_bin: the share of rows with a smaller value, in 2^bits steps.

    Values are counted first; only counts are put in order. The counted values are
    joined back without a hint: they are broadcast while small, and a hot value of
    a large table is left to the adaptive skew join.
    """
    counts = rows.groupBy(F.col(dimension).alias("value")).agg(F.count("*").alias("held"))
    bins = cut(numbered(counts, [], ["value"], F.col("held")).select("value", F.expr(f"(before * {1 << bits}) div total").alias(f"{dimension}_bin")))
    return rows.join(bins, F.col(dimension).eqNullSafe(F.col("value"))).drop("value")


def placed(docs: DataFrame, shards: int = 8, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, law: str = "bytes") -> DataFrame:
    """doc_id, the dimensions, size, text_crc32, curve, shard and slot of every row."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"law must be bytes or rows, not {law}")
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = cut(
        docs.select(
            F.col("doc_id").alias("k_doc_id"), *[F.col(d).alias(f"d{i}") for i, d in enumerate(dimensions)],
            (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("like"),
        )
    )
    cells = seen
    for i in range(len(dimensions)):
        cells = binned(cells, f"d{i}", bits)
    curve = curve_index([F.col(f"d{i}_bin") for i in range(len(dimensions))], bits)
    lined = cells.select("k_doc_id", *[f"d{i}" for i in range(len(dimensions))], "size", "text_crc32", "like", curve.alias("curve"))
    in_order = numbered(lined, [], ["curve", "like", "k_doc_id"], F.col("size"))
    shard = f"((2 * before + size) * {shards}) div (2 * total)" if law == "bytes" else f"(rank * {shards}) div n"
    dealt = cut(in_order.withColumn("shard", F.expr(shard).cast("int")))
    first = dealt.groupBy("shard").agg(F.min("rank").alias("first"))  # one row per shard
    return dealt.join(first, "shard").select(
        F.col("k_doc_id").alias("doc_id"), *[F.col(f"d{i}").alias(d) for i, d in enumerate(dimensions) if d != "doc_id"],
        "size", "text_crc32", "curve", "shard", (F.col("rank") - F.col("first")).alias("slot"),
    )


def shard(docs: DataFrame, shards: int = 8, law: str = "bytes", **how) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0) and grown_shard (null: neither law deals by key)."""
    return placed(docs, shards, law=law, **how).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write(docs: DataFrame, folder: str, shards: int = 8, dimensions: tuple[str, ...] = DIMENSIONS, files: int = 1, **how) -> DataFrame:
    """Write docs to folder/shard=N and return the smallest and largest value of each dimension per shard.

    files splits a shard into so many consecutive runs of the curve, whose statistics in the
    Parquet footers prune further. Rows that agree in doc_id, dimensions and text are alike, so it does
    not matter which of them takes which of their places.
    """
    if "shard" in docs.columns:
        raise ValueError("docs has a column shard, the name of the written folders")
    places = placed(docs, shards * files, dimensions, **how)
    alike = list(dict.fromkeys(["doc_id", *dimensions]))
    keyed = [F.col(c).alias(f"_w_{c}") for c in alike]
    spot = places.select(*keyed, F.col("text_crc32").alias("_w_crc"), F.col("size").alias("_w_size"), F.col("shard").alias("_w_shard"), F.col("curve").alias("_w_curve"))
    spot = spot.groupBy(*[f"_w_{c}" for c in alike], "_w_crc", "_w_size").agg(F.min("_w_shard").alias("_w_shard"), F.first("_w_curve").alias("_w_curve"))
    text = F.coalesce(F.col("text"), F.lit(""))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in alike])
    same = same & (F.crc32(text.cast("binary")) == F.col("_w_crc")) & (F.octet_length(text) + 1 == F.col("_w_size"))
    out = docs.join(spot, same).withColumn("shard", F.expr(f"_w_shard div {files}").cast("int"))
    kept = [*docs.columns, "shard"]
    out.repartitionByRange(shards * files, "_w_shard").sortWithinPartitions("_w_shard", "_w_curve").select(*kept).write.partitionBy("shard").parquet(folder)
    return places.groupBy(F.expr(f"shard div {files}").cast("int").alias("shard")).agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"),
        *[f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))],
    )


def _bins_sql(d: str) -> str:
    return f"""{d}_bins AS (
  SELECT {d}, ((coalesce(sum(count(*)) OVER (ORDER BY {d} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {1 << BITS})
    // sum(count(*)) OVER ())::BIGINT AS {d}_bin FROM documents GROUP BY {d})"""


def _walk_sql() -> str:
    """The curve in SQL: one CTE per bit and axis, then the Gray code and the interleaving."""
    n, parts, last = len(DIMENSIONS), [], "s_start"
    for q in [1 << b for b in reversed(range(1, BITS))]:
        for i in range(n):
            name = f"s_{q}_{i}"
            low = q - 1
            cols = []
            for j in range(n):
                x = f"x{j}"
                if j == 0:
                    other = x if i == 0 else f"xor(x0, xor(x0, x{i}) & {low})"
                    cols.append(f"CASE WHEN (x{i} & {q}) <> 0 THEN xor(x0, {low}) ELSE {other} END AS x0")
                elif j == i:
                    cols.append(f"CASE WHEN (x{i} & {q}) <> 0 THEN {x} ELSE xor({x}, xor(x0, x{i}) & {low}) END AS {x}")
                else:
                    cols.append(x)
            parts.append(f"{name} AS (SELECT row_id, {', '.join(cols)} FROM {last})")
            last = name
    grays = ["x0"]
    for j in range(1, n):
        grays.append(f"xor({grays[-1]}, x{j})")
    parts.append(f"gray AS (SELECT row_id, {', '.join(f'{g} AS g{j}' for j, g in enumerate(grays))} FROM {last})")
    flip = "0"
    for q in [1 << b for b in reversed(range(1, BITS))]:
        flip = f"xor({flip}, CASE WHEN (g{n - 1} & {q}) <> 0 THEN {q - 1} ELSE 0 END)"
    parts.append(f"flipped AS (SELECT row_id, {', '.join(f'xor(g{j}, {flip}) AS t{j}' for j in range(n))} FROM gray)")
    bits = [f"((t{j} >> {b}) & 1)" for b in reversed(range(BITS)) for j in range(n)]
    parts.append(f"curves AS (SELECT row_id, {' + '.join(f'{bit} * {1 << (len(bits) - 1 - k)}' for k, bit in enumerate(bits))} AS curve FROM flipped)")
    return ",\n".join(parts)


#: crc32 (polynomial 0xEDB88320) of a list of bytes, in DuckDB's SQL: the table from its rule, then a fold.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS crc
  FROM range(256) t(b))"""


def crc_sql(bytes_: str) -> str:
    return f"xor(list_reduce([4294967295::BIGINT] || {bytes_}, lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c // 256)), 4294967295)"


#: The same shards in DuckDB's SQL.
SQL = f"""
WITH {CRC_TABLE_SQL},
{", ".join(_bins_sql(d) for d in DIMENSIONS)},
numbered_docs AS (SELECT row_number() OVER () AS row_id, * FROM documents),
s_start AS (
  SELECT row_id, {", ".join(f"{d}_bin AS x{i}" for i, d in enumerate(DIMENSIONS))}
  FROM numbered_docs o {" ".join(f"JOIN {d}_bins ON {d}_bins.{d} IS NOT DISTINCT FROM o.{d}" for d in DIMENSIONS)}),
{_walk_sql()},
sized AS (
  SELECT row_id, doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 1 AS size, curve
  FROM numbered_docs JOIN curves USING (row_id)),
lined AS (
  SELECT *, row_number() OVER w - 1 AS rank, sum(size) OVER w - size AS before, sum(size) OVER () AS total FROM sized
  WINDOW w AS (ORDER BY curve, md5(t), doc_id NULLS FIRST, row_id ROWS UNBOUNDED PRECEDING)),
dealt AS (SELECT *, (((2 * before + size) * 8) // (2 * total))::INTEGER AS shard FROM lined),
hexed AS (SELECT row_id, hex(encode(t)) AS h FROM sized),
checks AS (
  SELECT row_id, {crc_sql("list_transform(regexp_extract_all(h, '..'), lambda c: ('0x' || c)::BIGINT)")}::BIGINT AS text_crc32
  FROM hexed, crc_table)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, (rank - min(rank) OVER (PARTITION BY shard))::BIGINT AS slot,
       NULL::DOUBLE AS grown_shard
FROM dealt JOIN checks USING (row_id)
"""
