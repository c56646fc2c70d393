"""Histogram trees grown best first, with a bound on their leaves.

Features are cut into bins once; a cached row is its bins as bytes, its label and a hash of its values. A split of a node
depends on the node's rows alone, so the order in which nodes are opened can be replayed on the driver: a queue pops the leaf
of greatest gain, and whenever it pops leaves whose children are not known yet, one job collects the histograms of all those
children. A tree of L leaves costs about as many jobs as it is deep, and every smaller tree is a prefix of the same queue.

Histograms are sums of gradients, Hessians and rows by (node, feature, bin): added up per task, then per (node, feature) by
Spark, and only the best split of each comes to the driver. A regression tree is the case of Hessian 1 and gradient -label.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tabfeat.functions.columns import numeric, q

MAX_BINS = 256

#: Rows whose values place the borders of features with many values.
BIN_SAMPLE = 200_000

#: Bytes of histograms that a task sums up in one scan; more open nodes take further scans.
HISTOGRAM_BYTES = 64 << 20

#: Sums of a bin: gradient, Hessian, rows, squared gradient.
STATS = 4


# ---- bins ------------------------------------------------------------------------------------


@dataclass
class Bins:
    """Upper edges of the bins of every feature: a value falls into the first bin whose edge is not below it."""

    features: list[str]
    edges: list[np.ndarray]

    @property
    def width(self) -> int:
        return max((len(e) + 1 for e in self.edges), default=1)

    def codes(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """rows x features."""
        return np.column_stack([np.searchsorted(e, x, side="left") for e, x in zip(self.edges, columns)]).astype(np.uint8 if self.width <= 256 else np.uint16)

    def threshold(self, feature: int, bin_: int) -> float:
        return float(self.edges[feature][bin_])


def fit_bins(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS, sample: int = BIN_SAMPLE) -> Bins:
    """Every distinct value a bin of its own where a feature has few, else borders at quantiles.

    Borders lie on values, so that rows go left when they are not above one. Quantiles are those of about ``sample`` rows,
    chosen by a hash of their values and so the same however the input is partitioned; of all rows if there are no more.
    """
    named = {f"f{i}": numeric(df, f) for i, f in enumerate(features)}
    rows = df.select(*[v.alias(k) for k, v in named.items()])
    counted = rows.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(k).alias(k) for k in named]).first().asDict()
    few = [k for k in named if counted[k] <= max_bins]
    edges: dict[str, np.ndarray] = {}
    if few:
        sets = rows.agg(*[F.sort_array(F.collect_set(k)).alias(k) for k in few]).first()
        edges = {k: np.array(sets[k][:-1], float) for k in few if len(sets[k]) <= max_bins}
    many = [k for k in named if k not in edges]
    if many:
        if counted["n"] > sample:
            share = int(sample / counted["n"] * (1 << 40))
            rows = rows.where(F.pmod(F.xxhash64(*named), F.lit(1 << 40)) < share)
        probs = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
        # so fine a sketch holds every value, so it does not depend on their order
        found = rows.agg(*[F.percentile_approx(k, probs, F.lit(10 * sample)).alias(k) for k in many]).first()
        edges |= {k: np.unique(np.array(found[k] or [], float)) for k in many}
    return Bins(list(features), [edges[k] for k in named])


@contextmanager
def binned(df: DataFrame, bins: Bins, label: str, keep: Sequence[str] = ()) -> Iterator[DataFrame]:
    """``codes`` (bytes), ``label`` and the kept columns of all complete rows, cached for the block.

    Rows are dealt and ordered by a hash of their values, so sums do not depend on how the input was partitioned.
    """
    cols = [numeric(df, f).alias(f"_f{i}") for i, f in enumerate(bins.features)]
    rows = df.select(*cols, numeric(df, label).alias("label"), *[q(k) for k in keep]).dropna(subset=[*[f"_f{i}" for i in range(len(cols))], "label"])
    place = F.xxhash64(*[q(c) for c in rows.columns])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_hash", place).repartition(parts, "_hash").sortWithinPartitions("_hash")
    kept_fields = [f for f in rows.schema.fields if not f.name.startswith("_f")]
    schema = StructType([StructField("codes", BinaryType()), *kept_fields])

    def run(batches):
        for batch in batches:
            codes = bins.codes([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(bins.features))])
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1] * codes.itemsize), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))])
            rest = [batch.column(f.name) for f in kept_fields]
            yield pa.RecordBatch.from_arrays([blob.cast(pa.binary()), *rest], [f.name for f in schema.fields])

    cached = rows.mapInArrow(run, schema).persist()
    try:
        yield cached
    finally:
        cached.unpersist()


def codes_of(batch: pa.RecordBatch, bins: Bins) -> np.ndarray:
    kind = np.uint8 if bins.width <= 256 else np.uint16
    column = batch.column("codes")
    data = np.frombuffer(column.buffers()[2], np.uint8)
    first, last = (np.frombuffer(column.buffers()[1], np.int32)[i + column.offset] for i in (0, len(column)))
    return data[first:last].view(kind).reshape(len(column), len(bins.features))


# ---- trees -----------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in the order of their creation; children of node i are left[i] and left[i] + 1, -1 for a leaf."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def add(self, value: float, rows: int) -> int:
        for column, x in ((self.feature, -1), (self.bin, -1), (self.left, -1), (self.value, value), (self.gain, 0.0), (self.rows, rows)):
            column.append(x)
        return len(self.left) - 1

    def split(self, node: int, feature: int, bin_: int, gain: float) -> None:
        self.feature[node], self.bin[node], self.gain[node], self.left[node] = feature, bin_, gain, len(self.left)

    @property
    def leaves(self) -> int:
        return self.left.count(-1)

    def node_of(self, codes: np.ndarray, nodes: int | None = None) -> np.ndarray:
        """The leaf of each row; of the first ``nodes`` nodes only, if given."""
        left, feature, cut = (np.array(x) for x in (self.left, self.feature, self.bin))
        if nodes is not None:
            left = np.where(left + 1 < nodes, left, -1)
        at = np.zeros(len(codes), np.int64)
        open_ = np.flatnonzero(left[at] >= 0)
        while len(open_):
            node = at[open_]
            at[open_] = left[node] + (codes[open_, feature[node]] > cut[node])
            open_ = open_[left[at[open_]] >= 0]
        return at

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.node_of(codes)]


@dataclass(frozen=True)
class Rules:
    """What bounds a tree. A split must drop twice the loss by more than ``min_gain``; a node is split if it has ``min_split``
    rows and if the variance of its gradients is above ``min_impurity``."""

    max_leaves: int | None = 31
    max_depth: int | None = None
    min_rows: int = 1
    min_hessian: float = 0.0
    reg_lambda: float = 0.0
    reg_alpha: float = 0.0
    min_gain: float = 0.0
    min_split: int = 2
    min_impurity: float | None = None


def shrunk(gradient, alpha: float):
    """Soft threshold of the sum of gradients."""
    return np.sign(gradient) * np.maximum(np.abs(gradient) - alpha, 0.0)


def leaf_value(gradient, hessian, rules: Rules):
    """The Newton step -G / (H + lambda), with the sum of gradients shrunk by alpha."""
    weight = hessian + rules.reg_lambda
    return np.divide(-shrunk(gradient, rules.reg_alpha), weight, out=np.zeros_like(np.asarray(weight, float)), where=weight > 0)


def score(gradient, hessian, rules: Rules):
    """Twice the drop of the loss that the leaf's value brings."""
    weight = hessian + rules.reg_lambda
    return np.divide(shrunk(gradient, rules.reg_alpha) ** 2, weight, out=np.zeros_like(np.asarray(weight, float)), where=weight > 0)


def best_split(histogram: np.ndarray, rules: Rules) -> tuple[int, float, np.ndarray] | None:
    """(bin, gain, sums of the left side) of one feature of one node; the first of equal gains; None without an allowed split."""
    left = np.cumsum(histogram, axis=0)
    whole, left = left[-1], left[:-1]
    right = whole - left
    ok = (left[:, 2] >= rules.min_rows) & (right[:, 2] >= rules.min_rows) & (left[:, 1] >= rules.min_hessian) & (right[:, 1] >= rules.min_hessian)
    ok &= (left[:, 2] > 0) & (right[:, 2] > 0)
    if not ok.any():
        return None
    gain = score(left[:, 0], left[:, 1], rules) + score(right[:, 0], right[:, 1], rules) - score(whole[0], whole[1], rules)
    gain = np.where(ok, gain, -np.inf)
    at = int(np.argmax(gain))
    return at, float(gain[at]), left[at]


#: A function of a batch and its codes to gradient, Hessian and the weight of rows (0: left out).
Gradients = Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def label_gradients(batch: pa.RecordBatch, codes: np.ndarray):
    """For a plain regression tree: leaf values are means."""
    y = batch.column("label").to_numpy(zero_copy_only=False)
    return -y, np.ones(len(y)), np.ones(len(y))


def _node_histograms(rows: DataFrame, bins: Bins, tree: Tree, nodes: list[int], gradients: Gradients, rules: Rules,
                     features: Sequence[int]) -> dict[int, tuple[np.ndarray, tuple | None]]:
    """For each node its sums and its best split over the features (feature, bin, gain and left sums); one scan."""
    slot = np.full(len(tree.left), -1)
    slot[nodes] = np.arange(len(nodes))
    width, chosen = bins.width, np.array(features)
    size = len(nodes) * len(chosen) * width

    def sums(batches):
        total = np.zeros((STATS, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = codes_of(batch, bins)
            own = slot[tree.node_of(codes)]
            g, h, w = gradients(batch, codes)
            use = np.flatnonzero((own >= 0) & (w > 0))
            cells = ((own[use, None] * len(chosen) + np.arange(len(chosen))) * width + codes[np.ix_(use, chosen)]).ravel()
            for k, x in enumerate((g * w, h * w, (w > 0).astype(float), g * g * w)):
                total[k] += np.bincount(cells, np.repeat(x[use], len(chosen)), size)
        per = total.reshape(STATS, len(nodes) * len(chosen), width)
        some = np.flatnonzero(per[2].any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([per[:, i].T.tobytes() for i in some], pa.binary())], ["cell", "sums"])

    def split(table):
        parts: dict[int, list[bytes]] = {}
        for cell, data in zip(table["cell"].to_pylist(), table["sums"].to_pylist()):
            parts.setdefault(cell, []).append(data)
        out: dict[str, list] = {"cell": [], "bin": [], "gain": [], "left": [], "whole": []}
        for cell, data in parts.items():
            histogram = sum(np.frombuffer(b, float).reshape(width, STATS) for b in sorted(data))
            at, gain, left = best_split(histogram, rules) or (-1, 0.0, np.empty(0))
            for name, x in zip(out, (cell, at, gain, left.tobytes(), histogram.sum(axis=0).tobytes())):
                out[name].append(x)
        return pa.table(out, schema=pa.schema([("cell", pa.int64()), ("bin", pa.int32()), ("gain", pa.float64()), ("left", pa.binary()), ("whole", pa.binary())]))

    out: dict[int, tuple[np.ndarray, tuple | None]] = {}
    dealt = F.pmod("cell", F.lit(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    per_cell = rows.mapInArrow(sums, "cell long, sums binary").groupBy(dealt).applyInArrow(
        split, "cell long, bin int, gain double, left binary, whole binary")
    for r in sorted(per_cell.collect(), key=lambda r: r["cell"]):  # one row for each open node and feature at most
        node, feature = nodes[r["cell"] // len(chosen)], int(chosen[r["cell"] % len(chosen)])
        whole, best = out.get(node, (np.frombuffer(r["whole"], float), None))
        if r["bin"] >= 0 and (best is None or r["gain"] > best[2]):
            best = feature, r["bin"], r["gain"], np.frombuffer(r["left"], float)
        out[node] = whole, best
    return out


def grow(rows: DataFrame, bins: Bins, rules: Rules, gradients: Gradients = label_gradients, features: Sequence[int] | None = None) -> Tree:
    """The best-first tree over ``binned`` rows. Nodes 1 and 2 come from the first split and so on: the first 2 L - 1 nodes are
    the tree of L leaves. Of equal gains the older node, the first feature and the smallest bin win.

    ``known`` is a tree that grows ahead of the queue: its nodes have splits and children, the queue decides which are used.
    """
    features = list(range(len(bins.features))) if features is None else sorted(features)
    at_once = max(1, HISTOGRAM_BYTES // (8 * STATS * max(1, len(features)) * bins.width))
    whole, first = _node_histograms(rows, bins, Tree([-1], [-1], [-1], [0.0], [0.0], [0]), [0], gradients, rules, features).get(0, (np.zeros(STATS), None))
    known, stats, depth, splits = Tree(), [whole], [0], {0: first}
    known.add(float(leaf_value(whole[0], whole[1], rules)), int(round(whole[2])))
    most = rules.max_leaves or int(whole[2]) or 1
    least_gain = max(rules.min_gain, 1e-12 * max(1.0, float(score(whole[0], whole[1], rules))))

    def may_split(node: int) -> bool:
        gradient, weight, n, squares = stats[node]
        impure = rules.min_impurity is None or weight > 0 and squares / weight - (gradient / weight) ** 2 > rules.min_impurity
        return impure and (rules.max_depth is None or depth[node] < rules.max_depth) and n >= max(2 * max(1, rules.min_rows), rules.min_split)

    def look(nodes: list[int]) -> None:
        for i in range(0, len(nodes), at_once):
            found = _node_histograms(rows, bins, known, nodes[i:i + at_once], gradients, rules, features)
            splits.update({n: s for n, (_, s) in found.items()})

    def replay() -> tuple[list[int], list[int]]:
        """Nodes in the order of their splits, and those among them whose children are missing."""
        queue, order, missing = [], [], []

        def offer(node: int) -> None:
            s = splits.get(node)
            if s is not None and s[2] > least_gain:
                heapq.heappush(queue, (-s[2], node))

        if may_split(0):
            offer(0)
        while queue and len(order) < most - 1:
            node = heapq.heappop(queue)[1]
            order.append(node)
            if known.left[node] < 0:
                missing.append(node)
            else:
                offer(known.left[node])
                offer(known.left[node] + 1)
        return order, missing

    while True:
        order, missing = replay()
        if not missing:
            break
        fresh = []
        for node in missing:
            feature, cut, gain, left = splits[node]
            known.split(node, feature, cut, gain)
            for side in (left, stats[node] - left):
                child = known.add(float(leaf_value(side[0], side[1], rules)), int(round(side[2])))
                stats.append(side)
                depth.append(depth[node] + 1)
                fresh.append(child)
        look([n for n in fresh if may_split(n)])

    tree, place = Tree(), {0: 0}
    tree.add(known.value[0], known.rows[0])
    for node in order:  # the same nodes in the order of the queue
        own = place[node]
        tree.split(own, known.feature[node], known.bin[node], known.gain[node])
        for child in (known.left[node], known.left[node] + 1):
            place[child] = tree.add(known.value[child], known.rows[child])
    return tree


def errors_by_size(rows: DataFrame, bins: Bins, trees: Sequence[Tree], sizes: Sequence[int]) -> dict[int, float]:
    """Mean absolute error over ``rows`` of the trees' mean, each tree cut back to that many leaves; one scan for all sizes.

    A row's value at a size is that of the deepest node on its path that the smaller tree has, so every tree is walked once.
    """
    asked = np.array(sorted(set(sizes)))

    def sums(batches):
        total, n = np.zeros(len(asked)), 0
        for batch in batches:
            codes, y = codes_of(batch, bins), batch.column("label").to_numpy(zero_copy_only=False)
            for i in range(0, len(y), 2048):
                part = codes[i:i + 2048]
                total += np.abs(y[i:i + 2048, None] - sum(_values_by_size(t, part, asked) for t in trees) / len(trees)).sum(axis=0)
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "sums"])

    parts = sorted((r["n"], bytes(r["sums"])) for r in rows.mapInArrow(sums, "n long, sums binary").collect())  # one row a task
    n, error = sum(p[0] for p in parts), sum(np.frombuffer(p[1], float) for p in parts)
    return {int(s): float(e / n) if n else math.nan for s, e in zip(asked, error)}


def _values_by_size(tree: Tree, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """rows x sizes: the value of each row in the tree of each number of leaves."""
    left, feature, cut, value = (np.array(x) for x in (tree.left, tree.feature, tree.bin, tree.value))
    out = np.full((len(codes), len(sizes)), value[0])
    at, live = np.zeros(len(codes), np.int64), np.arange(len(codes))
    while True:
        live = live[left[at[live]] >= 0]
        if not len(live):
            return out
        node = at[live]
        at[live] = left[node] + (codes[live, feature[node]] > cut[node])
        # a pair of children is there from (its place + 3) / 2 leaves on
        reached = sizes[None, :] >= ((left[node] + 3) // 2)[:, None]
        out[live] = np.where(reached, value[at[live]][:, None], out[live])
