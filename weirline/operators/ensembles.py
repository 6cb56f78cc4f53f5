"""Forests and boosted trees per section and fold, with every stage of an ensemble scored from one fit.

A case is a row of a section under a fold: a train row of that fold, or a row to
predict. Cases are packed by (section, fold), which the calendar bounds, and spread
over the cluster; a task fits the ensembles of several packs at once. Trees grow
level by level over sums whose keys are (section, fold, tree, node, input, value), as
flat arrays: one pass serves all trees of a level. Nothing but the packs and the
predictions travels.

One fit answers a whole grid: a forest of 300 trees without a depth limit holds the
forests of its first 100 trees and of depth 10, and 300 rounds of boosting hold
the first 100. Forests are cut into chunks of trees that different tasks fit;
their sums are added up by Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirline.operators import jvm
from weirline.sources.scratch import spread

#: Elements (cases x inputs) that one pass handles at most, so that its arrays stay near the processor; a bound on memory, not on results.
ELEMENTS = 100_000
#: Trees of a forest that one task fits.
CHUNK = 100
UNLIMITED = 1_000


# ---- growing many trees at once


@dataclass
class Level:
    """What one level of ``grow`` split: roots and heap numbers of the nodes, splits, values and train cases of both sides, and the cases that moved."""

    root: np.ndarray
    heap: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    sides: np.ndarray  # (2, nodes): values left and right
    sizes: np.ndarray  # (2, nodes)
    moved: np.ndarray
    value: np.ndarray  # of the cases that moved


def grow(
    x: np.ndarray, row: np.ndarray, root: np.ndarray, w: np.ndarray, y: np.ndarray, depth: int, least: int | np.ndarray = 1,
    order: np.ndarray | None = None, allowed: np.ndarray | None = None, want: tuple[int, ...] = (), levels: list[Level] | None = None,
) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Least-squares trees over cases, one per root; the value each case ends with, and at the depths wanted.

    x is (inputs, rows); a case is a row under a root with weight w (0: only to be predicted)
    and truth y; ``least`` may differ by root. Splits lie midway between neighbouring train values; of splits equal to nine
    digits the first input and the lowest value win. ``order`` may hold the train cases by (root, value)
    per input, ``allowed`` the inputs of each root; ``levels`` collects the splits.

    Truths are centred on their node, so that a gain is one square and one product. Of a split node the left children
    come first, then the right ones: two selections per level instead of a sort. Children too small to split leave at once.
    """
    if order is None:
        order = train_order(x, row, root, w > 0)
    n_roots = int(root.max()) + 1 if len(root) else 0
    mean = np.bincount(root, w * y, n_roots) / np.maximum(np.bincount(root, w, n_roots), 1e-300)
    value = mean[root]
    # Truths as distances from the root's mean; a common level costs no digits.
    raw, wy, y, level_of = y, w * y, y - value, mean
    seen: dict[int, np.ndarray] = {0: value.copy()} if 0 in want else {}
    flat_x, inputs = np.ascontiguousarray(x).reshape(-1), len(x)
    own = root[order[0]] if len(order) else np.zeros(0, np.int64)
    alike = len(own) == 0 or bool((w[order[0]] == 1).all())
    need = np.maximum(np.broadcast_to(np.asarray(least), n_roots), 1)
    # Only roots with train cases grow; nodes are numbered in the order of their cases.
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    origin = own[starts]
    sizes = np.diff(np.append(starts, len(own)))
    heap = np.ones(len(starts), np.int64)
    of_root = np.full(n_roots, -1)
    of_root[origin] = np.arange(len(origin))
    node = of_root[root]
    active = np.flatnonzero(node >= 0)
    node = node[active]
    xs = flat_x.take(row.take(order) + (np.arange(inputs) * x.shape[1])[:, None]) if len(own) else np.zeros(order.shape)
    centred, side = np.zeros(len(y)), np.empty(len(y), np.int8)
    for level in range(1, depth + 1):
        m, k = order.shape[1], len(starts)
        if not k:
            break
        group = np.repeat(np.arange(k), sizes)
        cases = order[0]
        w0, y0 = w.take(cases), y.take(cases)
        tw = np.add.reduceat(w0, starts)
        mu = np.add.reduceat(w0 * y0, starts) / tw
        gap = y0 - mu.take(group)
        wgap = w0 * gap
        centred[cases] = wgap
        spread_ = np.add.reduceat(wgap * gap, starts)
        from_zero = mu + level_of.take(origin)
        varied = spread_ > 1e-12 * np.maximum(spread_ + tw * from_zero * from_zero, 1e-300)
        per_node = np.where(varied, tw / np.where(varied, spread_, 1), 0)
        place = np.arange(m)
        ln = place + 1 - starts.take(group)
        rn = sizes.take(group) - ln
        fewest = need.take(origin).take(group)
        scale = np.where((ln >= fewest) & (rn >= fewest), per_node.take(group), 0)
        ly = centred.take(order)
        np.cumsum(ly, axis=1, out=ly)
        ly -= np.repeat(np.where(starts > 0, ly[:, starts - 1], 0), sizes, axis=1)
        gain = ly * ly
        if levels is not None:
            gain = _plain_gains(wy, raw, order, starts, sizes)
            gain *= scale > 0
        elif alike:
            gain *= scale / np.maximum(ln * rn, 1)
        else:
            lw = w.take(order)
            np.cumsum(lw, axis=1, out=lw)
            before = np.where(starts > 0, lw[:, starts - 1], 0)
            lw -= np.repeat(before, sizes, axis=1)
            share = tw.take(group) - lw
            share *= lw
            share[:, starts + sizes - 1] = np.inf
            if share.min() <= 0:  # weights too small to tell
                share[share <= 0] = np.inf
            gain /= share
            gain *= scale
        gain[:, :-1] *= xs[:, :-1] < xs[:, 1:]
        best = np.maximum.reduceat(gain, starts, axis=1)
        if allowed is not None:
            best[~allowed[:, origin]] = 0
        top = best.max(axis=0)
        rounded = np.rint(top * 1e9)
        kept = np.flatnonzero(rounded > 0)
        if not len(kept):
            break
        # Equal to nine digits: at least the rounded best less half a digit.
        bar = np.minimum((rounded - 0.5) * 1e-9, top)
        feature = (best >= bar).argmax(axis=0)
        hit = np.flatnonzero(gain.reshape(-1).take(np.repeat(feature * m, sizes) + place) >= np.repeat(bar, sizes))
        at = np.zeros(k, np.int64)
        at[group.take(hit)[::-1]] = hit[::-1]
        f, a, s = feature[kept], at[kept], starts[kept]
        low, high = xs[f, a], xs[f, a + 1]
        cut = (low + high) / 2
        cut = np.where(cut < high, cut, low)
        left_y, left_n = ly[f, a], a - s + 1
        left_w = left_n if alike else lw[f, a]
        sides = from_zero[kept] + np.stack([left_y / left_w, -left_y / (tw[kept] - left_w)])
        new = np.full(k, -1)
        new[kept] = np.arange(len(kept))
        node = new.take(node)
        on = np.flatnonzero(node >= 0)
        node, active = node.take(on), active.take(on)
        right = flat_x.take(f.take(node) * x.shape[1] + row.take(active)) > cut.take(node)
        if levels is not None:  # a model's values are sums over counts, to the last digit
            of = node + right * len(kept)
            sides = (np.bincount(of, wy.take(active), 2 * len(kept)) / np.bincount(of, w.take(active), 2 * len(kept))).reshape(2, -1)
        now = sides[right.view(np.int8), node]
        value[active] = now
        halves = np.stack([left_n, sizes[kept] - left_n])
        if levels is not None:
            levels.append(Level(origin[kept], heap[kept], f, cut, sides, halves, active, now))
        if level in want:
            seen[level] = value.copy()
        grows = halves >= np.maximum(2 * need[origin[kept]], 2)
        child = np.where(grows.reshape(-1), np.cumsum(grows.reshape(-1)) - 1, -1).reshape(2, -1)
        side[cases] = 2
        node = child[right.view(np.int8), node]
        side[active] = np.where(node >= 0, right, 2)
        on = np.flatnonzero(node >= 0)
        node, active = node.take(on), active.take(on)
        sorted_side = side.take(order).reshape(-1)
        lefts, rights = np.flatnonzero(sorted_side == 0), np.flatnonzero(sorted_side == 1)
        both = lambda v: np.concatenate([v.reshape(-1).take(i).reshape(inputs, -1) for i in (lefts, rights)], axis=1)
        order, xs = both(order), both(xs)
        sizes = halves[grows]
        starts = np.cumsum(sizes) - sizes
        origin = np.concatenate([origin[kept]] * 2)[grows.reshape(-1)]
        heap = np.concatenate([2 * heap[kept], 2 * heap[kept] + 1])[grows.reshape(-1)]
    return value, {d: seen.get(d, value) for d in want}


def _plain_gains(wy: np.ndarray, y: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Gains from sums of truths and squares as they are, node by node and in the order of the input, as SQL adds them up; weights are 1."""
    sums, squares = wy.take(order), (wy * y).take(order)
    for s, e in zip(starts.tolist(), (starts + sizes).tolist()):
        sums[:, s:e].cumsum(axis=1, out=sums[:, s:e])
        squares[:, s:e].cumsum(axis=1, out=squares[:, s:e])
    ends = starts + sizes - 1
    ts = np.repeat(sums[:, ends], sizes, axis=1)
    ln = np.arange(order.shape[1]) + 1.0 - np.repeat(starts, sizes)
    tn = np.repeat(sizes, sizes).astype(float)
    whole = ts * ts / tn
    spread_ = np.repeat(squares[:, ends], sizes, axis=1) - whole
    gain = sums * sums / ln + (ts - sums) ** 2 / np.maximum(tn - ln, 1) - whole
    return np.divide(gain, spread_, out=np.zeros_like(gain), where=spread_ > 0)


def train_order(x: np.ndarray, row: np.ndarray, root: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """(inputs, train cases): the cases by root, then by value of the input."""
    cases = np.nonzero(fit)[0]
    return np.stack([cases[np.lexsort((x[f, row[cases]], root[cases]))] for f in range(len(x))])


# ---- ensembles over a batch of packs


@dataclass
class Batch:
    """Several packs at once: inputs (inputs, cases), truth scaled per pack, pack number, train flag."""

    x: np.ndarray
    y: np.ndarray
    pack: np.ndarray
    train: np.ndarray
    names: list[tuple[str, int, int]]  # section, fold, chunk

    def rng(self, seed: int, i: int, *more: int) -> np.random.Generator:
        section, fold, _ = self.names[i]
        return np.random.default_rng([seed, zlib.crc32((section or "").encode()), fold, *more])

    def members(self) -> list[np.ndarray]:
        """The train cases of each pack."""
        cases = np.flatnonzero(self.train)
        cases = cases[np.argsort(self.pack[cases], kind="stable")]
        return np.split(cases, np.cumsum(np.bincount(self.pack[cases], minlength=len(self.names)))[:-1])


def _forest(batch: Batch, grid: list[dict], seed: int) -> np.ndarray:
    """(points, cases): sums over the trees of the chunk that belong to each point, for the cases to predict."""
    depths = sorted({g["maxDepth"] for g in grid})
    n_trees = max(g["numTrees"] for g in grid)
    out = np.zeros((len(grid), len(batch.y)))
    members, packs = batch.members(), len(batch.names)
    chunk = np.array([c for _, _, c in batch.names], np.int64)
    all_rows = np.arange(len(batch.y))
    at_once = max(1, ELEMENTS // max(1, batch.x.size))
    for c in sorted(set(chunk.tolist())):
        mine = chunk[batch.pack] == c
        asked = np.flatnonzero(mine & ~batch.train)
        whole = train_order(batch.x, all_rows, batch.pack, batch.train & mine)
        own = [i for i in range(packs) if chunk[i] == c and len(members[i])]
        if not own:
            continue
        taught = np.concatenate([members[i] for i in own])
        ends = np.cumsum([0, *[len(members[i]) for i in own]])
        trees = range(c * CHUNK, min(n_trees, (c + 1) * CHUNK))
        drawn = np.empty(len(taught), np.int64)
        place = np.empty(len(batch.y), np.int64)
        for first in range(trees.start, trees.stop, at_once):
            some = range(first, min(trees.stop, first + at_once))
            rows, roots, weights, orders, starts, size = [], [], [], [], [], 0
            for t, tree in enumerate(some):
                for i, a, b in zip(own, ends, ends[1:]):
                    drawn[a:b] = batch.rng(seed, i, tree).integers(0, b - a, b - a) + a
                w = np.zeros(len(batch.y))
                w[taught] = np.bincount(drawn, minlength=len(taught))
                bag = np.flatnonzero(w)
                row = np.concatenate([asked, bag])
                place[bag] = np.arange(len(bag)) + size + len(asked)
                orders.append(place[whole[w[whole] > 0].reshape(len(whole), -1)])
                rows.append(row)
                roots.append(batch.pack[row] + t * packs)
                weights.append(w[row])
                starts.append(size)
                size += len(row)
            row = np.concatenate(rows)
            _, at = grow(batch.x, row, np.concatenate(roots), np.concatenate(weights), batch.y[row], max(depths), order=np.concatenate(orders, axis=1), want=tuple(depths))
            answers = np.array(starts)[:, None] + np.arange(len(asked))
            for p, g in enumerate(grid):
                use = np.array([tree < g["numTrees"] for tree in some])
                out[p, asked] += at[g["maxDepth"]][answers[use]].sum(axis=0)
    return out


def _boosted(batch: Batch, grid: list[dict], seed: int) -> np.ndarray:
    """(points, cases): gradient boosting of squared loss, read after each wanted number of rounds.

    Settings that differ in step and leaf size only run side by side: they draw the same rows and inputs.
    """
    out = np.zeros((len(grid), len(batch.y)))
    packs, cases = len(batch.names), len(batch.y)
    drawn_alike = [(g["maxDepth"], g.get("subsamplingRate", 1.0), float(g.get("featureSubsetStrategy", 1.0)), g.get("seed", seed)) for g in grid]
    own = batch.members()
    taught = np.bincount(batch.pack, batch.train, packs)
    mean = np.bincount(batch.pack, batch.train * batch.y, packs) / np.maximum(taught, 1)
    whole = train_order(batch.x, np.arange(cases), batch.pack, batch.train)
    for kind in dict.fromkeys(drawn_alike):
        depth, share, some, from_seed = kind
        points = [p for p, other in enumerate(drawn_alike) if other == kind]
        settings = list(dict.fromkeys((grid[p].get("stepSize", 0.1), grid[p].get("minInstancesPerNode", 1)) for p in points))
        runs = [settings.index((grid[p].get("stepSize", 0.1), grid[p].get("minInstancesPerNode", 1))) for p in points]
        n = len(settings)
        row, root = np.tile(np.arange(cases), n), np.concatenate([batch.pack + r * packs for r in range(n)])
        y, pred = np.tile(batch.y, n), np.tile(mean[batch.pack], n)
        rate, least = np.repeat([s for s, _ in settings], cases), np.repeat([m for _, m in settings], packs)
        side_by_side = lambda o: np.concatenate([o + r * cases for r in range(n)], axis=1)
        draws = [batch.rng(from_seed, i) for i in range(packs)] if share < 1 or some < 1 else []
        w, order, allowed = batch.train.astype(float), side_by_side(whole), None
        for done in range(1, max(grid[p]["maxIter"] for p in points) + 1):
            if share < 1:
                w = batch.train.astype(float)
                for i, draw in enumerate(draws):
                    w[draw.permutation(own[i])[max(1, int(np.ceil(share * len(own[i])))) :]] = 0
                order = side_by_side(whole[w[whole] > 0].reshape(len(whole), -1))
            if some < 1:
                inputs = max(1, int(np.ceil(some * len(batch.x))))
                allowed = np.zeros((len(batch.x), packs), bool)
                for i, draw in enumerate(draws):
                    allowed[draw.permutation(len(batch.x))[:inputs], i] = True
                allowed = np.tile(allowed, n)
            step, _ = grow(batch.x, row, root, np.tile(w, n), y - pred, depth, least, order, allowed)
            pred = pred + rate * step
            for p, r in zip(points, runs):
                if grid[p]["maxIter"] == done:
                    out[p] = pred[r * cases : (r + 1) * cases]
    return out


def weighted_medians(values: np.ndarray, says: np.ndarray) -> np.ndarray:
    """Per column of values, the first value in ascending order at which half of the column's says is reached."""
    order = np.argsort(values, axis=0, kind="stable")
    upto = np.cumsum(np.take_along_axis(says, order, axis=0), axis=0)
    at = (upto >= 0.5 * upto[-1]).argmax(axis=0)
    return np.take_along_axis(values, np.take_along_axis(order, at[None], axis=0), axis=0)[0]


def _reweighted(batch: Batch, grid: list[dict], seed: int) -> np.ndarray:
    """(points, cases): AdaBoost.R2 (Drucker 1997, linear loss) with weighted trees, for the cases to predict.

    All rates run side by side; the says of a pack are one array and the predictions of a case one column,
    both a row longer with every round. A pack stops at a perfect tree, which counts, or at a
    mean loss of one half, where the tree counts only if it is the first.
    """
    out = np.zeros((len(grid), len(batch.y)))
    packs, cases, asked = len(batch.names), len(batch.y), np.flatnonzero(~batch.train)
    for depth in {g.get("depth", 3) for g in grid}:
        rates = sorted({g["rate"] for g in grid if g.get("depth", 3) == depth})
        rounds = max(g["rounds"] for g in grid if g.get("depth", 3) == depth)
        row = np.tile(np.arange(cases), len(rates))
        root = np.concatenate([batch.pack + r * packs for r in range(len(rates))])
        rate = np.repeat(rates, packs)
        train, y = np.tile(batch.train, len(rates)), np.tile(batch.y, len(rates))
        n = np.bincount(root, train, packs * len(rates))
        w = np.where(train, 1 / np.maximum(n, 1)[root], 0.0)
        going = np.ones(packs * len(rates), bool)
        order = train_order(batch.x, row, root, train)
        said, values = [], []
        for r in range(rounds):
            if not going.any():
                break
            value, _ = grow(batch.x, row, root, w, y, depth, order=order)
            error = np.where(train, np.abs(y - value), 0.0)
            worst = np.zeros(len(going))
            np.maximum.at(worst, root, error)
            loss = np.divide(error, worst[root], out=np.zeros(len(error)), where=worst[root] > 0)
            bar = np.bincount(root, w * loss, len(going))
            useful = going & (bar > 0) & (bar < 0.5)
            beta = np.where(useful, bar / np.where(useful, 1 - bar, 1), 0.5)
            said.append(np.where(useful, -rate * np.log(beta), np.where(going & (bar <= 0), 1.0, 0.0 if r else 1e-12)))
            values.append(value)
            w = np.where(useful[root], w * beta[root] ** ((1 - loss) * rate[root]), w)
            total = np.bincount(root, w, len(going))
            w = w / total[root]
            # Weights that vanish keep their case in the order of the train rows.
            w = np.where(train, np.maximum(w, 1e-300), 0.0)
            going = useful
        for p, g in enumerate(grid):
            if g.get("depth", 3) != depth:
                continue
            upto = min(g["rounds"], len(values))
            width = max(1, ELEMENTS // upto)
            for first in range(0, len(asked), width):
                part = asked[first : first + width] + rates.index(g["rate"]) * cases
                out[p, asked[first : first + width]] = weighted_medians(
                    np.stack([v[part] for v in values[:upto]]), np.stack([s[root[part]] for s in said[:upto]])
                )
    return out


_KERNELS: dict[str, Callable[[Batch, list[dict], int], np.ndarray]] = {"RF": _forest, "GB": _boosted, "LGBM": _boosted, "AdaB": _reweighted}


# ---- packs through Spark


def forward_cases(blocks: DataFrame, features: list[str], k: int = 3, y: str = "measured_flow", x: str | None = None) -> DataFrame:
    """(section_id, fold, train, tag, y, x): each row under the folds it trains, and under its own block to be predicted.

    Rows without all inputs, and train rows without truth, are left out. tag is the day.
    ``x`` may name a column that holds the inputs as an array.
    """
    ready = blocks.dropna(subset=features) if features else blocks
    inputs = F.array(*[F.col(c).cast("double") for c in features]) if x is None else F.col(x)
    teaches = (F.col("split") == "train") & F.col(y).isNotNull()
    trains = F.when(teaches & (F.col("block") < k), F.sequence(F.greatest(F.col("block") + 1, F.lit(0)), F.lit(k))).otherwise(F.array().cast("array<int>"))
    roles = F.concat(
        F.transform(trains, lambda f: F.struct(f.alias("fold"), F.lit(True).alias("train"))),
        F.when(F.col("block") >= 0, F.array(F.struct(F.col("block").alias("fold"), F.lit(False).alias("train")))).otherwise(
            F.array().cast("array<struct<fold:int,train:boolean>>")
        ),
    )
    return ready.select(
        "section_id", F.inline(roles), F.unix_date("date").cast("long").alias("tag"), F.col(y).cast("double").alias("y"), inputs.alias("x"),
    )


def _fit(alg: str, grid: list[dict], seed: int, width: int):
    kernel = _KERNELS[alg]
    # Settings that run at once share the room of a pass.
    side_by_side = {"RF": 2, "GB": 1, "LGBM": 4, "AdaB": 3}[alg]

    def batch_of(packs: list[dict]) -> tuple[Batch, list[np.ndarray]]:
        sizes = [len(p["tag"]) for p in packs]
        pack = np.repeat(np.arange(len(packs)), sizes)
        x = np.concatenate([p["x"].reshape(-1, width) for p in packs]).T.copy()
        y, train = np.concatenate([p["y"] for p in packs]), np.concatenate([p["train"] for p in packs])
        n = np.maximum(np.bincount(pack, train, len(packs)), 1)
        y0 = np.where(train, y, 0.0)
        mean = np.bincount(pack, y0, len(packs)) / n
        sd = np.sqrt(np.bincount(pack, np.where(train, (y0 - mean[pack]) ** 2, 0), len(packs)) / n)
        sd = np.where(sd > 0, sd, 1.0)
        scaled = np.where(train, (y0 - mean[pack]) / sd[pack], 0.0)
        return Batch(x, scaled, pack, train, [(p["section_id"], p["fold"], p["chunk"]) for p in packs]), [mean[pack], sd[pack], y]

    def answers(packs: list[dict]) -> pa.RecordBatch:
        batch, (mean, sd, y) = batch_of(packs)
        made = kernel(batch, grid, seed)
        if alg == "RF":
            own = np.zeros((len(grid), len(packs)))
            for i, (_, _, c) in enumerate(batch.names):
                own[:, i] = [max(0, min(g["numTrees"], (c + 1) * CHUNK) - c * CHUNK) / g["numTrees"] for g in grid]
            divisor = np.array([g["numTrees"] for g in grid])[:, None]
            made = made / divisor * sd + mean * own[:, batch.pack]
        else:
            made = made * sd + mean
        asked = ~batch.train
        tags = np.concatenate([p["tag"] for p in packs])[asked]
        section = pa.array([p["section_id"] for p in packs]).take(pa.array(batch.pack[asked]))
        folds = np.array([p["fold"] for p in packs], np.int32)[batch.pack[asked]]
        preds = np.ascontiguousarray(made[:, asked].T)
        ends = pa.array(np.arange(len(tags) + 1) * len(grid), type=pa.int32())
        truth = y[asked]
        return pa.RecordBatch.from_arrays(
            [section, pa.array(folds), pa.array(tags), pa.array(truth, mask=np.isnan(truth)), pa.ListArray.from_arrays(ends, pa.array(preds.reshape(-1)))],
            names=["section_id", "fold", "tag", "y", "preds"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Without train cases there is nothing to learn from; with nothing else, nothing to predict.
        for packs in packs_in(batches, ("section_id", "fold", "chunk"), ELEMENTS // side_by_side, lambda train: train.any() and not train.all()):
            yield answers(packs)

    return run


def packs_in(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], elements: int, useful: Callable[[np.ndarray], bool]) -> Iterator[list[dict]]:
    """The useful packs of a task, by their train flags, so many at once that they hold about that many elements."""
    waiting, size = [], 0
    for b in batches:
        for i in range(b.num_rows):
            p = {c: b.column(c)[i].as_py() for c in keys}
            for c in ("tag", "train", "y", "x"):
                p[c] = b.column(c)[i].values.to_numpy(zero_copy_only=False)
            p["y"], p["train"] = p["y"].astype(float), p["train"].astype(bool)
            if not useful(p["train"]):
                continue
            waiting.append(p)
            size += len(p["x"])
            if size >= elements:
                yield waiting
                waiting, size = [], 0
    if waiting:
        yield waiting


def packed(cases: DataFrame, *more: Column) -> DataFrame:
    """The cases of each (section, fold) as arrays in the order of their tags, once for each value of more."""
    case = F.struct("tag", "train", "y", "x")
    c = F.col("c")
    packs = cases.groupBy("section_id", "fold").agg(F.sort_array(F.collect_list(case)).alias("c"))
    return packs.select("section_id", "fold", *more, "c").select(
        *[k for k in packs.select("section_id", "fold", *more).columns], c["tag"].alias("tag"), c["train"].alias("train"), c["y"].alias("y"), F.flatten(c["x"]).alias("x")
    )


def settings(alg: str, g: dict, seed: int) -> list[float]:
    """A point of the grid in the order of ``Ensembles.java``."""
    if alg == "RF":
        some = [g["numTrees"], g["maxDepth"]]
    elif alg == "AdaB":
        some = [g["rounds"], g.get("depth", 3), g["rate"]]
    else:
        some = [g["maxIter"], g["maxDepth"], g.get("stepSize", 0.1), g.get("minInstancesPerNode", 1), g.get("subsamplingRate", 1.0), g.get("featureSubsetStrategy", 1.0), g.get("seed", seed)]
    return [*map(float, some), *[0.0] * (7 - len(some))]


def _asked(c: str) -> Column:
    """What column c of a pack holds for the cases to predict."""
    return F.transform(F.filter(F.arrays_zip(c, "train"), lambda v: ~v["train"]), lambda v: v[c])


def case_predictions(cases: DataFrame, width: int, alg: str, grid: list[dict], seed: int = 42) -> DataFrame:
    """(section_id, fold, tag, y, preds): preds has one value per point of the grid, for all cases that are not train."""
    chunks = -(-max(g["numTrees"] for g in grid) // CHUNK) if alg == "RF" else 1
    flat = spread(packed(cases, (F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))) if chunks > 1 else F.lit(0)).alias("chunk")), "section_id", "fold", "chunk")
    points = [settings(alg, g, seed) for g in grid]
    said = jvm.ensembles(cases.sparkSession, alg, points, CHUNK, seed, width, "section_id", "fold", "chunk", "train", "y", "x")
    found = flat.select("section_id", "fold", "chunk", _asked("tag").alias("tag"), _asked("y").alias("y"), said.alias("preds")).where("preds IS NOT NULL")
    if chunks > 1:
        sums = F.aggregate("c", F.get("c", F.lit(0))["preds"], lambda a, b: F.when(b["chunk"] == 0, a).otherwise(F.zip_with(a, b["preds"], lambda v, w: F.zip_with(v, w, lambda i, j: i + j))))
        found = (
            found.groupBy("section_id", "fold").agg(F.sort_array(F.collect_list(F.struct("chunk", "preds"))).alias("c"), F.first("tag").alias("tag"), F.first("y").alias("y"))
            .withColumn("preds", sums)
        )
    rows = found.select("section_id", "fold", F.inline(F.arrays_zip("tag", "y", "preds")))
    if chunks > 1:  # rows of a repeated day are added up, as they were; they lie together already
        rows = rows.groupBy("section_id", "fold", "tag").agg(F.first("y").alias("y"), F.array(*[F.sum(F.col("preds")[i]) for i in range(len(grid))]).alias("preds"))
    return rows.select("section_id", "fold", "tag", F.nanvl("y", F.lit(None).cast("double")).alias("y"), "preds")


def staged_predictions(
    blocks: DataFrame, features: list[str], alg: str, grid: list[dict], k: int = 3, y: str = "measured_flow", seed: int = 42
) -> DataFrame:
    """Out-of-fold (blocks below k) and test (block k) predictions of every point of the grid, as (…, point, pred)."""
    base = alg.removesuffix("_LAG")
    found = case_predictions(forward_cases(blocks, features, k, y), len(features), base, grid, seed)
    return found.select(
        "section_id", F.date_from_unix_date(F.col("tag").cast("int")).alias("date"),
        F.when(F.col("fold") == k, "test").otherwise("train").alias("split"), F.lit(alg).alias("alg"),
        F.col("fold").alias("block"), "y", F.posexplode("preds").alias("point", "pred"),
    )
