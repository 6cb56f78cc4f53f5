"""Merkle manifest of a dataset by nested-interval labels.

A node of the hash tree is labelled with the interval of leaf ranks it covers.
Nodes of level l lie in bucket lo >> l, so a parent, an ancestor or a leaf meets by an
equi-join on (tree, level, bucket), checked by containment of intervals. Within a
parent, the parent's interval minus the node's own is the interval of its
sibling; an empty difference is a lone node. Every step of a proof is 'L' or 'R'
and the sibling's digest, or '-' for a lone node, which is hashed alone.

The tree is built STRIDE levels at a time: 2^STRIDE neighbouring nodes meet in one
group and leave the nodes above them, so that a forest of any size takes few jobs and
no task sees more of one tree. The steps of a stride are attached to the nodes it
starts from; from the top down, a node's steps are followed by those of its
ancestor at the end of the stride. One leaf carries its proof once.

Every lang is a tree over its rows by ascending doc_id; the roots of these trees,
null first, are the leaves of the tree above them.

Nulls: a null value is written as '-'; a null lang is a tree of its own; a null doc_id comes first and is
never tampered with. Empty texts are values of 0 bytes. Repeated doc_ids follow
their digests; equal rows have equal digests and take any of their places. An empty table gives an empty
result. Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirline.functions.columns import bind
from weirline.llm.order import numbered
from weirline.sources.scratch import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STRIDE = 5


def digest(parts: list[Column]) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _shift(lo: str, level: str) -> Column:
    return F.expr(f"shiftright({lo}, {level})")


def _nodes_above(entries: DataFrame, base: int, stride: int) -> DataFrame:
    """The nodes of the next levels over the nodes of level base, as far as their trees go."""
    runs = entries.groupBy("tree", "n", _shift("lo", str(base + stride)).alias("top")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("run"))
    nothing = F.array().cast("array<struct<lo:bigint,hi:bigint,digest:string>>")

    def pair(run: Column, i: Column) -> Column:
        a, b = F.get(run, i * 2), F.get(run, i * 2 + 1)
        return F.struct(a["lo"].alias("lo"), F.coalesce(b["hi"], a["hi"]).alias("hi"), digest([a["digest"], F.coalesce(b["digest"], F.lit(""))]).alias("digest"))

    def up(held: Column, level: Column) -> Column:
        run = held["run"]
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(run) - 1) / 2).cast("int")), lambda i: pair(run, i))
        whole = F.when(F.call_function("shiftright", F.col("n") - 1, level) > 0, pairs).otherwise(nothing)
        return bind(
            whole,
            lambda r: F.struct(
                r.alias("run"),
                F.concat(held["out"], F.transform(r, lambda v: F.struct((level + 1).alias("level"), v["lo"].alias("lo"), v["hi"].alias("hi"), v["digest"].alias("digest")))).alias("out"),
            ),
        )

    start = F.struct(F.col("run"), F.array().cast("array<struct<level:int,lo:bigint,hi:bigint,digest:string>>").alias("out"))
    built = F.aggregate(F.sequence(F.lit(base), F.lit(base + stride - 1)), start, up, lambda held: held["out"])
    return runs.select("tree", "n", F.inline(built))


def _steps(nodes: DataFrame) -> DataFrame:
    """(tree, level, lo, hi, step) of all nodes but the roots.

    Nodes meet under their parent, two at most, whose interval is what they cover together.
    """
    children = nodes.where(_shift("n - 1", "level") > 0).withColumn("bucket", _shift("lo", "level + 1"))
    families = children.groupBy("tree", "level", "bucket").agg(
        F.min("lo").alias("p_lo"), F.max("hi").alias("p_hi"), F.collect_list(F.struct("lo", "hi", "digest")).alias("held")
    )

    def sibling(own: Column) -> Column:
        """What is left of the parent's interval without the node's own; null for a lone node."""
        left, right = own["lo"] > F.col("p_lo"), own["hi"] < F.col("p_hi")
        o_lo = F.when(left, F.col("p_lo")).when(right, own["hi"] + 1)
        o_hi = F.when(left, own["lo"] - 1).when(right, F.col("p_hi"))
        return F.get(F.filter("held", lambda other: (other["lo"] == o_lo) & (other["hi"] == o_hi)), F.lit(0))

    def step(own: Column) -> Column:
        other = sibling(own)
        side = F.when(other["lo"] < own["lo"], F.lit("L")).otherwise(F.lit("R"))
        return F.when(other.isNull(), F.lit("-")).otherwise(F.concat(side, other["digest"]))

    stepped = F.transform("held", lambda own: F.struct(own["lo"].alias("lo"), own["hi"].alias("hi"), step(own).alias("step")))
    return families.select("tree", "level", F.inline(stepped))


def _attached(entries: DataFrame, steps: DataFrame, base: int, stride: int) -> DataFrame:
    """(tree, lo, path): the steps from every node of level base to the end of the stride or its root."""
    height = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    levels = F.sequence(F.lit(base), F.least(F.lit(base + stride), height) - 1)
    below = entries.select("tree", "lo", "hi", F.explode(levels).alias("level")).withColumn("bucket", _shift("lo", "level"))
    holder = steps.select(
        F.col("tree").alias("a_tree"), F.col("level").alias("a_level"), _shift("lo", "level").alias("a_bucket"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), "step"
    )
    # Both sides grow with the rows: merged, never broadcast.
    inside = below.join(
        holder.hint("merge"),
        (F.col("tree") == F.col("a_tree")) & (F.col("level") == F.col("a_level")) & (F.col("bucket") == F.col("a_bucket"))
        & (F.col("a_lo") <= F.col("lo")) & (F.col("hi") <= F.col("a_hi")),
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("level", "step"))), lambda s: s["step"])
    return inside.groupBy("tree", "lo").agg(ordered.alias("path"))


def forest(leaves: DataFrame, stride: int = STRIDE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paths (tree, lo, path), roots (tree, root) and inner nodes of the trees over leaves (tree, n, lo, digest).

    lo is the 0-based rank of a leaf and n the number of leaves of its tree. A tree of one leaf has no
    path, and the leaf is its root.
    """
    entries = leaves.select("tree", "n", F.lit(0).alias("level"), "lo", F.col("lo").alias("hi"), "digest")
    roots, built, strides = [entries.where("n = 1")], [], []
    tallest = leaves.agg(F.max("n")).first()[0] or 0  # one number
    base = 0
    while (tallest - 1) >> base > 0:
        alive = entries.where(_shift("n - 1", str(base)) > 0)
        above = cut(_nodes_above(alive, base, stride))
        strides.append((base, cut(_attached(alive, _steps(alive.unionByName(above)), base, stride))))
        built.append(above)
        roots.append(above.where(_shift("n - 1", "level") == 0))
        base += stride
        entries = above.where(F.col("level") == base)
    full = None
    for base, own in reversed(strides):
        if full is None:
            full = own
            continue
        higher = full.select(F.col("tree").alias("h_tree"), _shift("lo", str(base + stride)).alias("h_bucket"), F.col("path").alias("rest"))
        met = own.withColumn("bucket", _shift("lo", str(base + stride))).join(
            higher.hint("merge"), (F.col("tree") == F.col("h_tree")) & (F.col("bucket") == F.col("h_bucket")), "left"
        )
        full = cut(met.select("tree", "lo", F.concat("path", F.coalesce("rest", F.array().cast("array<string>"))).alias("path")))
    if full is None:
        full = leaves.where("false").select("tree", "lo", F.array().cast("array<string>").alias("path"))
    tops, nodes = roots[0], None
    for part in roots[1:]:
        tops = tops.unionByName(part)
    for part in built:
        nodes = part if nodes is None else nodes.unionByName(part)
    return full, cut(tops.select("tree", F.col("digest").alias("root"))), entries.where("false") if nodes is None else nodes


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def up(own: Column, step: Column) -> Column:
        other = F.substr(step, F.lit(2))
        return F.when(step.startswith("L"), digest([other, own])).when(step.startswith("R"), digest([own, other])).otherwise(digest([own]))

    return F.aggregate(path, leaf, up)


def proved(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered (the leaf after tampering, else null), path, subroot and root of every row."""
    as_is = [_field(F.col(c)) for c in FIELDS]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    changed = [_field(more) if c == "n_chars" else f for c, f in zip(FIELDS, as_is)]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    tree = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), F.col("lang").cast("string")))  # '-' sorts before ':'
    leaves = docs.select("doc_id", tree.alias("tree"), digest(as_is).alias("digest"), F.when(hit, digest(changed)).alias("tampered"))
    ranked = cut(numbered(leaves, ["tree"], ["doc_id", "digest"]).select("doc_id", "tree", "n", F.col("rank").alias("lo"), "digest", "tampered"))
    paths, subroots, _ = forest(ranked)
    crowns = cut(
        numbered(subroots.select(F.lit("").alias("all"), F.col("tree").alias("lang_tree"), "root"), ["all"], ["lang_tree"]).select(
            F.col("all").alias("tree"), "n", F.col("rank").alias("lo"), F.col("root").alias("digest"), "lang_tree"
        )
    )
    crown_paths, tops, _ = forest(crowns)
    top = crowns.join(crown_paths, ["tree", "lo"], "left").join(tops, "tree")
    top = cut(top.select(F.col("lang_tree").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("crown_path"), "root"))  # one row per lang
    none = F.array().cast("array<string>")
    whole = F.concat(F.coalesce("path", none), F.coalesce("crown_path", none))
    return ranked.join(paths.hint("merge"), ["tree", "lo"], "left").join(top, "tree").select(
        "doc_id", F.col("digest").alias("leaf"), "tampered", whole.alias("path"), "subroot", "root"
    )


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    siblings = F.transform(F.filter("path", lambda s: s != "-"), lambda s: F.substr(s, F.lit(2)))
    back = proved(docs).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return back.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _tree_sql(name: str, leaves: str) -> str:
    """All nodes, step of every node, and the folded and listed proof of every leaf (tree, lo, digest, start) in DuckDB's SQL."""
    return f"""
{name}_sizes AS (SELECT tree, count(*) AS n FROM {leaves} GROUP BY tree),
{name}_nodes AS (
  SELECT l.tree, s.n, 0 AS level, l.lo, l.digest FROM {leaves} l JOIN {name}_sizes s ON l.tree = s.tree
  UNION ALL
  SELECT tree, any_value(n), any_value(level) + 1, lo // 2, sha256(string_agg(digest, '' ORDER BY lo))
  FROM {name}_nodes WHERE ((n - 1) >> level) > 0 GROUP BY tree, lo // 2),
{name}_root AS (SELECT tree, digest AS root FROM {name}_nodes WHERE ((n - 1) >> level) = 0),
{name}_proofs AS (
  SELECT l.tree, s.n, l.lo AS leaf_lo, 0 AS level, l.start AS acc, '' AS listed FROM {leaves} l JOIN {name}_sizes s ON l.tree = s.tree
  UNION ALL
  SELECT p.tree, p.n, p.leaf_lo, p.level + 1,
         CASE WHEN o.digest IS NULL THEN sha256(p.acc) WHEN (p.leaf_lo >> p.level) % 2 = 1 THEN sha256(o.digest || p.acc) ELSE sha256(p.acc || o.digest) END,
         p.listed || coalesce(o.digest, '')
  FROM {name}_proofs p
  LEFT JOIN {name}_nodes o ON o.tree = p.tree AND o.level = p.level AND o.lo = xor(p.leaf_lo >> p.level, 1)
  WHERE ((p.n - 1) >> p.level) > 0)"""


def _sql() -> str:
    from weirline.llm.hilbert import CRC_TABLE_SQL, crc_sql

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR END"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(field(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"

    crc = crc_sql("list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda c: ('0x' || c)::BIGINT)")
    return f"""
WITH RECURSIVE {CRC_TABLE_SQL},
hashed AS (
  SELECT doc_id, coalesce(':' || lang, '-') AS tree, {leaf("n_chars")} AS digest,
         CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND {crc} % 7 = 0 THEN {leaf("n_chars + 1")} END AS tampered
  FROM documents, crc_table),
leaves AS (
  SELECT *, coalesce(tampered, digest) AS start,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS lo FROM hashed),
{_tree_sql("low", "leaves")},
folds AS (SELECT tree, leaf_lo AS lo, acc, listed FROM low_proofs WHERE ((n - 1) >> level) = 0),
crown AS (SELECT '' AS tree, tree AS lang_tree, root AS digest, root AS start, row_number() OVER (ORDER BY tree) - 1 AS lo FROM low_root),
{_tree_sql("top", "crown")},
crown_folds AS (SELECT leaf_lo AS lo, listed FROM top_proofs WHERE ((n - 1) >> level) = 0),
climbs AS (
  SELECT f.tree, f.lo, c.lo AS place, 0 AS level, s.n, f.acc FROM folds f JOIN crown c ON c.lang_tree = f.tree, top_sizes s
  UNION ALL
  SELECT c.tree, c.lo, c.place, c.level + 1, c.n,
         CASE WHEN o.digest IS NULL THEN sha256(c.acc) WHEN (c.place >> c.level) % 2 = 1 THEN sha256(o.digest || c.acc) ELSE sha256(c.acc || o.digest) END
  FROM climbs c LEFT JOIN top_nodes o ON o.level = c.level AND o.lo = xor(c.place >> c.level, 1)
  WHERE ((c.n - 1) >> c.level) > 0)
SELECT l.doc_id, l.digest AS leaf, w.digest AS subroot, r.root, sha256(f.listed || t.listed) AS proof_sha256,
       k.acc AS folded_root, k.acc = r.root AS verified
FROM leaves l JOIN folds f ON f.tree = l.tree AND f.lo = l.lo JOIN crown w ON w.lang_tree = l.tree JOIN crown_folds t ON t.lo = w.lo
JOIN climbs k ON k.tree = l.tree AND k.lo = l.lo AND ((k.n - 1) >> k.level) = 0, top_root r
"""


#: The same manifest in DuckDB's SQL.
SQL = _sql()
