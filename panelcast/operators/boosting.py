"""Histogram gradient boosting of many ensembles at once (MD-8, MD-10, MD-12, MD-13).

A search fits configurations × folds.  Fitting them one after the other costs a job per level, round,
configuration and fold; here one job grows a level of every ensemble that is still running:

1. features are binned once per fold (``BINS`` quantile bins of its train rows; NULL is the lowest bin) and staged
   with the target and one running prediction per configuration,
2. a job's tasks read their rows, follow the trees grown since the last staging, and give, one ensemble
   at a time, the counts and gradient sums of every (open node, feature, bin), and the loss on
   the stopping rows whenever a tree has been finished,
3. sums of one ensemble meet keyed on it, in order, so a task holds one histogram; it finds the best cut
   of every open node, and the driver takes those cuts (ensembles × open nodes, a size that the
   configurations bound), never a row, a histogram or a prediction,
4. where a fold has at most ``WHOLE_ROWS`` train rows, those take no more than the histogram of 64 open nodes, so
   steps 2 and 3 send the rows instead (a byte a feature and eight for the gradient), and the task that receives
   those of an ensemble grows its tree to the end: a job for each round instead of one for each level,
5. every ``STAGED_ROUNDS`` rounds the running predictions are brought up to date and staged, so neither
   the trees that travel nor the work repeated after a lost executor grow with the number of rounds.

Ensembles are independent: each is at its own round and level, and stops by its own losses.  Gradients
are rounded to whole multiples of 2^-20 of the largest target deviation of the fold, so sums are exact and do not
depend on the order in which tasks finish.  Leaf-budget configurations split the open nodes of a level
best gain first until the budget is used up.

A task's memory is its partition of the scan (one byte a feature and eight a configuration for each row) and one
histogram of open nodes × features × bins, or the at most ``WHOLE_ROWS`` rows of one ensemble, which take no more
than the histogram of 64 open nodes where there are 15 features.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.contract import ContractError
from panelcast.operators import trees as grids
from panelcast.sources.staging import stage

BINS = 64
STAGED_ROUNDS = 4
WHOLE_ROWS = 1 << 16
FIXED_POINT = float(1 << 20)
FIT, STOP, OTHER = 0, 1, 2


@dataclass(frozen=True)
class Config:
    """One ensemble's shape; ``leaves`` is a budget of leaves a tree, ``depth`` the longest path (0: no limit but the budget)."""

    name: str
    rate: float
    depth: int = 0
    leaves: int = 0
    subsample: float = 1.0
    min_rows: int = 1
    colsample: float = 1.0
    columns: tuple[int, ...] = ()  # features it may use at all; none named: all

    def __post_init__(self):
        if not self.depth and not self.leaves:
            raise ContractError(f"{self.name} limits neither depth nor leaves")

    def features(self, p: int, round_: int) -> np.ndarray:
        """Features a round may cut at: a seeded draw of ``colsample`` of those it may use."""
        own = np.array(self.columns, dtype=np.int64) if self.columns else np.arange(p)
        return own[np.random.default_rng([grids.SEED, round_]).permutation(len(own))[: max(1, int(self.colsample * len(own)))]]


def search_grid() -> list[Config]:
    """All configurations of the search: 12 limited by depth, 12 by leaves."""
    share = grids.COLUMN_SHARE
    out = [Config(c["name"], c["rate"], depth=c["depth"], subsample=c["subsample"], min_rows=c["min_rows"], colsample=share) for c in grids.depth_grid()]
    for c in grids.leaf_grid():
        out.append(Config(c["name"], c["rate"], leaves=c["leaves"], subsample=c["subsample"], min_rows=c["min_rows"], colsample=share))
    return out


class Tree:
    """Nodes in order of creation; an inner node sends bins up to ``cut`` to ``left`` and the others to the node behind it."""

    def __init__(self, n: int, total: float):
        self.feature, self.cut, self.left = [-1], [0], [0]
        self.n, self.total, self.depth = [n], [total], [0]
        self.open = [0]

    def split(self, node: int, feature: int, cut: int, n: int, total: float) -> None:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for rows, part in ((n, total), (self.n[node] - n, self.total[node] - total)):
            for values, value in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.n, rows), (self.total, part), (self.depth, self.depth[node] + 1)):
                values.append(value)

    def extend(self, cuts: Sequence[tuple], leaves: int, depth: int) -> None:
        """Use a level's cuts, best gain first while the budget of leaves lasts, and open the nodes of the next level."""
        budget = leaves - (len(self.feature) + 1) // 2 if leaves else None
        better = sorted((r for r in cuts if r[3] >= 0), key=lambda r: (-r[5], r[0]))
        opened: list[int] = []
        for node, _, _, feature, cut, _, n, total in better if budget is None else better[:budget]:
            opened += [len(self.feature), len(self.feature) + 1]
            self.split(node, feature, cut, n, total)
        full = leaves and (len(self.feature) + 1) // 2 >= leaves
        self.open = [] if full else [k for k in opened if not depth or self.depth[k] < depth]

    def arrays(self, rate: float = 0.0) -> tuple[np.ndarray, ...]:
        value = rate * np.array(self.total) / np.maximum(self.n, 1)
        return np.array(self.feature), np.array(self.cut), np.array(self.left), value


def leaves_of(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """Node in which every row ends."""
    feature, cut, left, _ = tree
    at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        here = at[rows]
        at[rows] = left[here] + (bins[rows, feature[here]] > cut[here])
    return at


@dataclass
class Ensemble:
    """What the driver knows of one (fold, configuration)."""

    fold: int
    slot: int
    config: Config
    limit: int
    scale: float
    n_features: int
    patience: int | None = None
    rounds: int = 0
    tree: Tree | None = None
    pending: list[tuple[np.ndarray, ...]] = field(default_factory=list)  # finished since the last staging
    best: float = float("inf")
    best_round: int = 0
    done: bool = False

    def ask(self) -> tuple:
        """What tasks need to know: trees to follow, the tree being grown, its open nodes, how rows and features are drawn, and the tree's limits."""
        tree, open_ = (None, [0]) if self.tree is None else (self.tree.arrays(), self.tree.open)
        c = self.config
        return self.fold, self.slot, self.patience is not None, self.pending, tree, open_, self.rounds, c.subsample, max(c.min_rows, 1), c.features(self.n_features, self.rounds), c.leaves, c.depth

    def ended(self, loss: float | None) -> bool:
        """Before a new tree: note the loss of the rounds finished so far; no more rounds are due."""
        if loss is not None and self.rounds and loss < self.best:
            self.best, self.best_round = loss, self.rounds
        self.done = self.rounds >= self.limit or (self.patience is not None and self.rounds - self.best_round >= self.patience)
        return self.done

    def take(self, cuts: list[tuple], loss: float | None) -> None:
        """Use a level's cuts; ``loss`` is that of the rounds finished so far, given with a new tree only."""
        if self.tree is None:
            if self.ended(loss):
                return
            _, n, total, *_ = next((r for r in cuts if r[0] == 0), (0, 0, 0.0))
            self.tree = Tree(n, total)
        self.tree.extend(cuts, self.config.leaves, self.config.depth)
        if not self.tree.open:
            self.finish(self.tree)

    def take_whole(self, tree: Tree, loss: float | None) -> None:
        """Use a whole tree, grown from the rows of this ensemble; ``loss`` as above."""
        if not self.ended(loss):
            self.finish(tree)

    def finish(self, tree: Tree) -> None:
        self.pending.append(tree.arrays(self.config.rate / self.scale))
        self.tree, self.rounds = None, self.rounds + 1


def fixed_width(column: pa.Array, dtype: type) -> np.ndarray:
    """Matrix from a binary column whose values all have the same length."""
    raw = column.cast(pa.large_binary())
    n = len(raw)
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    return np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(n, -1)


def binary(matrix: np.ndarray) -> pa.Array:
    """Binary column of a matrix' rows."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(matrix.tobytes())])


def sampled(ids: np.ndarray, round_: int, share: float) -> np.ndarray:
    """Rows of a round's sample: by a hash of row and round, so a task that runs again takes the same ones."""
    with np.errstate(over="ignore"):
        x = ids.view(np.uint64) + np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def edges_of(rows: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[int, list[np.ndarray]]:
    """Action: inner bin borders of every feature for every fold (at most ``bins`` - 2 each) from its train rows."""
    probs = [k / (bins - 1) for k in range(1, bins - 1)]
    finite = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    found = rows.where(F.col("_part") != OTHER).groupBy("_fold").agg(*[F.percentile_approx(c, probs, 10_000).alias(f"_e{j}") for j, c in enumerate(finite)])
    return {r["_fold"]: [np.unique(np.array(r[f"_e{j}"] or [], dtype=np.float64)) for j in range(len(columns))] for r in found.collect()}


@dataclass
class Binned:
    """Staged rows of all folds: keys, _fold, _id, _part (fit, stop, other), y, _bins and the running predictions _f."""

    rows: DataFrame
    keys: list[str]
    n_features: int
    n_slots: int
    targets: dict[int, tuple[float, float]]  # per fold: mean of y over train rows, largest distance from it
    train_rows: dict[int, int]


def prepared(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], part: Mapping[str, int], slots: int, fold: str = "fold", role: str = "role", y: str = "y") -> Binned:
    """Action, stages: bin the features once per fold.  ``part`` maps roles to FIT, STOP and OTHER; train rows without a target are left out.

    ``slots`` is the number of configurations; every one starts from the mean target of the fold's train rows.
    """
    keys, p = list(keys), len(columns)
    code = F.coalesce(*[F.when(F.col(role) == name, value) for name, value in part.items()], F.lit(OTHER))
    mine = F.col(fold).cast("int") if fold in rows.columns else F.lit(0)
    rows = rows.select(*keys, mine.alias("_fold"), code.alias("_part"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(columns)])
    rows = rows.where((F.col("_part") == OTHER) | (F.col("y").isNotNull() & ~F.isnan("y")))
    names = [f"_x{j}" for j in range(p)]
    edges = edges_of(rows, names)
    train = rows.where(F.col("_part") != OTHER).groupBy("_fold")
    ends = train.agg(F.avg("y").alias("m"), F.max("y").alias("hi"), F.min("y").alias("lo"), F.count(F.lit(1)).alias("n")).collect()
    base = {r["_fold"]: float(f"{r['m']:.12g}") for r in ends}  # without the digits that depend on the order of summing
    mean = {r["_fold"]: (base[r["_fold"]], max(abs(r["hi"] - base[r["_fold"]]), abs(r["lo"] - base[r["_fold"]]))) for r in ends}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column("_fold").to_numpy(zero_copy_only=False)
            bins = np.zeros((batch.num_rows, p), dtype=np.uint8)
            base = np.zeros((batch.num_rows, slots))
            for k in np.unique(folds):
                here = folds == k
                base[here] = mean[k][0] if k in mean else 0.0
                for j in range(p):
                    x = batch.column(f"_x{j}").to_numpy(zero_copy_only=False)[here].astype(np.float64)
                    found = 1 + np.searchsorted(edges[k][j], x, "left") if k in edges else np.zeros(len(x))
                    bins[here, j] = np.where(np.isnan(x), 0, found)
            kept = [batch.column(c) for c in (*keys, "_fold", "_id", "_part", "y")]
            yield pa.RecordBatch.from_arrays([*kept, binary(bins), binary(base)], names=[*keys, "_fold", "_id", "_part", "y", "_bins", "_f"])

    rows = rows.withColumn("_id", F.xxhash64(*keys)).select(*keys, "_fold", "_id", "_part", "y", *names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys) + 4])
    # rows of a fold lie together, so a task gives histograms of few ensembles
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.mapInArrow(binned, f"{fields}, _bins binary, _f binary").repartitionByRange(tasks, "_fold", "_id")
    return Binned(stage(out), keys, p, slots, mean, {r["_fold"]: r["n"] for r in ends})


def running(f: np.ndarray, slot: int, pending: list[tuple[np.ndarray, ...]], bins: np.ndarray) -> np.ndarray:
    """Predictions of one configuration with the trees grown since the last staging."""
    out = f[:, slot].copy()
    for tree in pending:
        out += tree[3][leaves_of(tree, bins)]
    return out


def learning(batches: Iterator[pa.RecordBatch], asked: list[tuple], targets: Mapping[int, tuple[float, float]]) -> Iterator[tuple]:
    """For every ensemble asked about that has rows in a task: its number, loss on stopping rows, their count, and open node (as counted
    from 0), bins and gradient of each row it learns from."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    column = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("_fold", "_id", "_part", "y")}
    bins = np.concatenate([fixed_width(b.column("_bins"), np.uint8) for b in held])
    f = np.concatenate([fixed_width(b.column("_f"), np.float64) for b in held])
    for k in np.unique(column["_fold"]):
        here = np.flatnonzero(column["_fold"] == k)
        stop = here[column["_part"][here] == STOP]
        fits = {True: here[column["_part"][here] == FIT], False: here[column["_part"][here] != OTHER]}
        bins_of = {watch: bins[fit] for watch, fit in fits.items()}
        for number, (fold, slot, watch, pending, tree, open_, round_, share, *_) in enumerate(asked):
            if fold != k:
                continue
            fit, fit_bins = fits[watch], bins_of[watch]
            loss, seen = 0.0, 0
            if watch and tree is None and len(stop):
                off = column["y"][stop] - running(f[stop], slot, pending, bins[stop])
                loss, seen = float(np.rint(np.abs(off) * (FIXED_POINT / max(targets[k][1], 1e-300))).sum()), len(stop)
            gradient = column["y"][fit] - running(f[fit], slot, pending, fit_bins)
            gradient = np.rint(gradient * (FIXED_POINT / max(targets[k][1], 1e-300)))
            local = np.full((max(open_) + 1 if tree is None else len(tree[0])), -1)
            local[open_] = np.arange(len(open_))
            node = local[leaves_of(tree, fit_bins) if tree is not None else np.zeros(len(fit), dtype=np.int64)]
            use = node >= 0
            if share < 1.0:
                use &= sampled(column["_id"][fit], round_, share)
            use = np.flatnonzero(use)
            yield number, loss, seen, node[use], fit_bins[use], gradient[use]


def sums_of(node: np.ndarray, bins: np.ndarray, gradient: np.ndarray, n_open: int) -> np.ndarray:
    """Counts and gradient sums of every (open node, feature, bin)."""
    sums = np.empty((2, n_open, bins.shape[1], BINS))
    for j in range(bins.shape[1]):
        at = node * BINS + bins[:, j]
        sums[0, :, j] = np.bincount(at, minlength=n_open * BINS).reshape(n_open, BINS)
        sums[1, :, j] = np.bincount(at, gradient, n_open * BINS).reshape(n_open, BINS)
    return sums


def best_cuts(sums: np.ndarray, open_: Sequence[int], least: int, features: np.ndarray) -> list[np.ndarray]:
    """Best cut of every open node: node, rows, gradient sum, feature or -1, cut, gain, rows and gradient sum to the left."""
    n, g = sums
    all_n, all_g = n[:, 0].sum(axis=1), g[:, 0].sum(axis=1)
    left_n, left_g = np.cumsum(n, axis=2)[:, :, :-1], np.cumsum(g, axis=2)[:, :, :-1]
    right_n, right_g = all_n[:, None, None] - left_n, all_g[:, None, None] - left_g
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g**2 / left_n + right_g**2 / right_n - (all_g**2 / all_n)[:, None, None]
    allowed = np.isin(np.arange(n.shape[1]), features)[None, :, None]
    gain = np.where(allowed & (left_n >= least) & (right_n >= least), gain, -1.0).reshape(len(open_), -1)
    best = gain.argmax(axis=1)  # ties: smaller feature, then smaller cut
    rows = np.arange(len(open_))
    good = gain[rows, best] > 1e-9 * np.maximum(all_g**2, 1.0)
    return [
        np.array(open_), all_n.astype(np.int64), all_g, np.where(good, best // (BINS - 1), -1), best % (BINS - 1), gain[rows, best],
        left_n.reshape(len(open_), -1)[rows, best].astype(np.int64), left_g.reshape(len(open_), -1)[rows, best],
    ]


def level(data: Binned, asked: list[tuple]) -> dict[int, tuple[list[tuple], float | None]]:
    """Action: for every ensemble asked about, the best cut of each open node and, if it watches them, the loss on the stopping rows.

    Ensembles that watch the stopping rows learn from fit rows only, the others from both.
    A cut is (node, rows, gradient sum, feature or -1, cut, gain, rows and gradient sum to the left).
    """
    p, targets = data.n_features, data.targets

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, loss, seen, node, bins, gradient in learning(batches, asked, targets):
            sums = sums_of(node, bins, gradient, len(asked[number][5]))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([loss]), pa.array([seen], pa.int64()), binary(sums.reshape(1, -1))], names=["model", "loss", "seen", "sums"])

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total, loss, seen = None, None, 0.0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("model")[i].as_py()
                sums = fixed_width(batch.column("sums").slice(i, 1), np.float64)[0]
                if number != model:
                    if model is not None:
                        yield found(model, total, loss, seen)
                    model, total, loss, seen = number, sums.copy(), 0.0, 0
                else:
                    total += sums
                loss += batch.column("loss")[i].as_py()
                seen += batch.column("seen")[i].as_py()
        if model is not None:
            yield found(model, total, loss, seen)

    def found(model: int, total: np.ndarray, loss: float, seen: int) -> pa.RecordBatch:
        open_, least, features = asked[model][5], asked[model][8], asked[model][9]
        best = best_cuts(total.reshape(2, len(open_), p, BINS), open_, least, features)
        columns = [pa.array([model] * len(open_), pa.int32()), pa.array([loss] * len(open_)), pa.array([seen] * len(open_), pa.int64())]
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64()]
        columns += [pa.array(values, kind) for values, kind in zip(best, kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["model", "loss", "seen", "node", "n", "total", "feature", "cut", "gain", "left_n", "left_total"])

    partial = train_rows(data, asked).mapInArrow(histograms, "model int, loss double, seen long, sums binary")
    merged = partial.repartition("model").sortWithinPartitions("model")
    best = merged.mapInArrow(cuts, "model int, loss double, seen long, node int, n long, total double, feature int, cut int, gain double, left_n long, left_total double")
    out: dict[int, tuple[list[tuple], float | None]] = {k: ([], None) for k in range(len(asked))}
    for r in best.collect():  # one row for each open node of an ensemble
        nodes, _ = out[r.model]
        nodes.append((r.node, r.n, r.total, r.feature, r.cut, r.gain, r.left_n, r.left_total))
        out[r.model] = nodes, mean_loss(data, asked[r.model], r.loss, r.seen)
    return out


def train_rows(data: Binned, asked: list[tuple]) -> DataFrame:
    folds = sorted({a[0] for a in asked})
    return data.rows.where(F.col("_fold").isin(folds) & (F.col("_part") != OTHER)).select("_fold", "_id", "_part", "y", "_bins", "_f")


def mean_loss(data: Binned, ask: tuple, loss: float, seen: int) -> float | None:
    return loss / seen / FIXED_POINT * data.targets[ask[0]][1] if seen else None


def tree_of(bins: np.ndarray, gradient: np.ndarray, features: np.ndarray, least: int, leaves: int, depth: int) -> Tree:
    """Tree of one ensemble from its rows, level by level with the cuts that ``level`` finds; ``bins`` has a column for each of ``features``."""
    tree, at = Tree(len(bins), float(gradient.sum())), np.zeros(len(bins), dtype=np.int64)
    while tree.open:
        local = np.full(len(tree.feature), -1)
        local[tree.open] = np.arange(len(tree.open))
        use = np.flatnonzero(local[at] >= 0)  # rows of leaves are done
        bins, gradient, at = bins[use], gradient[use], at[use]
        best = best_cuts(sums_of(local[at], bins, gradient, len(tree.open)), tree.open, least, np.arange(len(features)))
        tree.extend(list(zip(*(column.tolist() for column in best))), leaves, depth)
        feature, cut, left, _ = tree.arrays()
        use = np.flatnonzero(feature[at] >= 0)
        bins, gradient, at = bins[use], gradient[use], at[use]
        at = left[at] + (bins[np.arange(len(at)), feature[at]] > cut[at])
    tree.feature = [int(features[j]) if j >= 0 else -1 for j in tree.feature]
    return tree


def whole(data: Binned, asked: list[tuple]) -> dict[int, tuple[Tree, float | None]]:
    """Action: for every ensemble asked about, its whole next tree and, if it watches them, the loss on the stopping rows.

    For folds of at most ``WHOLE_ROWS`` train rows; the trees are those that ``level`` gives.
    """
    targets = data.targets

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, loss, seen, _, bins, gradient in learning(batches, asked, targets):
            bins = bins[:, np.sort(asked[number][9])]  # features the round may cut at
            columns = [pa.array([number], pa.int32()), pa.array([loss]), pa.array([seen], pa.int64()), binary(bins.reshape(1, -1)), binary(gradient.reshape(1, -1))]
            yield pa.RecordBatch.from_arrays(columns, names=["model", "loss", "seen", "bins", "gradient"])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("model")[i].as_py()
                if number != model:
                    if held:
                        yield found(model, held)
                    model, held = number, []
                bins = fixed_width(batch.column("bins").slice(i, 1), np.uint8).reshape(-1, len(asked[model][9]))
                gradient = fixed_width(batch.column("gradient").slice(i, 1), np.float64)[0]
                held.append((batch.column("loss")[i].as_py(), batch.column("seen")[i].as_py(), bins, gradient))
        if held:
            yield found(model, held)

    def found(model: int, held: list[tuple]) -> pa.RecordBatch:
        loss, seen, bins, gradient = zip(*held)
        *_, least, features, leaves, depth = asked[model]
        tree = tree_of(np.concatenate(bins), np.concatenate(gradient), np.sort(features), least, leaves, depth)
        columns = [pa.array([model], pa.int32()), pa.array([sum(loss)]), pa.array([sum(seen)], pa.int64())]
        columns += [pa.array([values], pa.list_(kind)) for values, kind in zip((tree.feature, tree.cut, tree.left, tree.n, tree.total), (*[pa.int32()] * 3, pa.int64(), pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["model", "loss", "seen", "feature", "cut", "left", "n", "total"])

    rows = train_rows(data, asked).mapInArrow(sent, "model int, loss double, seen long, bins binary, gradient binary")
    tasks = min(len(asked), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work: not to be coalesced
    together = rows.repartition(tasks, "model").sortWithinPartitions("model")
    trees = together.mapInArrow(grown, "model int, loss double, seen long, feature array<int>, cut array<int>, left array<int>, n array<long>, total array<double>")
    out: dict[int, tuple[Tree, float | None]] = {k: (Tree(0, 0.0), None) for k in range(len(asked))}
    for r in trees.collect():  # one row for each ensemble
        tree, _ = out[r.model]
        tree.feature, tree.cut, tree.left, tree.n, tree.total = r.feature, r.cut, r.left, r.n, r.total
        out[r.model] = tree, mean_loss(data, asked[r.model], r.loss, r.seen)
    return out


def caught_up(data: Binned, ensembles: list[Ensemble]) -> Binned:
    """Action: stage the rows with running predictions that include all finished trees."""
    todo = [(e.fold, e.slot, e.pending) for e in ensembles if e.pending]

    def updated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column("_fold").to_numpy(zero_copy_only=False)
            bins, f = fixed_width(batch.column("_bins"), np.uint8), fixed_width(batch.column("_f"), np.float64).copy()
            for fold, slot, pending in todo:
                here = np.flatnonzero(folds == fold)
                if len(here):
                    f[here, slot] = running(f[here], slot, pending, bins[here])
            yield batch.set_column(batch.schema.get_field_index("_f"), "_f", binary(f))

    rows = stage(data.rows.mapInArrow(updated, data.rows.schema))
    for e in ensembles:
        e.pending = []
    return replace(data, rows=rows)


def grow(data: Binned, configs: Sequence[Config], rounds: int | Mapping[tuple[int, int], int], patience: int | Sequence[int | None] | None = None) -> tuple[Binned, list[Ensemble]]:
    """Actions, stages: grow every (fold, configuration).

    An ensemble with ``patience`` learns from FIT rows and stops by the loss on STOP rows; one without it learns from
    both for ``rounds`` rounds.  Both may be given once or for each (fold, slot) and slot.
    """
    waits = list(patience) if isinstance(patience, Sequence) else [patience] * len(configs)
    ensembles = [
        Ensemble(fold, slot, config, rounds if isinstance(rounds, int) else rounds[fold, slot], FIXED_POINT / max(spread, 1e-300), data.n_features, waits[slot])
        for fold, (_, spread) in sorted(data.targets.items()) for slot, config in enumerate(configs)
    ]
    for e in ensembles:
        e.done = e.limit <= 0
    while active := [e for e in ensembles if not e.done]:
        small = [e for e in active if data.train_rows[e.fold] <= WHOLE_ROWS]
        if small:
            trees = whole(data, [e.ask() for e in small])
            for k, e in enumerate(small):
                e.take_whole(*trees[k])
        large = [e for e in active if data.train_rows[e.fold] > WHOLE_ROWS]
        if large:
            answers = level(data, [e.ask() for e in large])
            for k, e in enumerate(large):
                e.take(*answers[k])
        if max(len(e.pending) for e in ensembles) >= STAGED_ROUNDS:
            data = caught_up(data, ensembles)
    return (caught_up(data, ensembles) if any(e.pending for e in ensembles) else data), ensembles


def predictions(data: Binned, configs: Sequence[Config]) -> DataFrame:
    """(keys, fold, part, y, config, pred) of every row and configuration."""
    keys, names = data.keys, [c.name for c in configs]

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = fixed_width(batch.column("_f"), np.float64)
            for slot, name in enumerate(names):
                columns = [*(batch.column(c) for c in (*keys, "_fold", "_part", "y")), pa.array([name] * batch.num_rows, pa.string()), pa.array(f[:, slot])]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "fold", "part", "y", "config", "pred"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.rows.select(*keys).schema.fields)
    return data.rows.mapInArrow(unpacked, f"{fields}, fold int, part int, y double, config string, pred double")


def fit_predict(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], config: Config, rounds: int, fold: str = "fold", role: str = "role", train: Sequence[str] = ("train",)) -> DataFrame:
    """Actions, stages: predictions of one configuration per fold for all its rows, learned from the train rows (MD-8)."""
    data = prepared(rows, keys, columns, {name: FIT for name in train}, 1, fold, role)
    data, _ = grow(data, [config], rounds)
    return predictions(data, [config])


def search(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], configs: Sequence[Config] | None = None, rounds: int = grids.SEARCH_ROUNDS,
           patience: int = grids.PATIENCE, least: int = grids.MIN_ROUNDS, fold: str = "fold", role: str = "inner_role", plain: Sequence[Config] = (), plain_rounds: int = grids.BOOST_ROUNDS) -> tuple[DataFrame, list[dict]]:
    """Actions, stages: early stopping of every configuration on every fold, refit on the whole train block (MD-10).

    ``role`` holds fit, stop and other values (rows to predict).  ``plain`` configurations grow beside them on the whole
    train block for ``plain_rounds`` rounds.  Returns predictions as ``predictions`` does and one dict for each searched (fold,
    configuration): rounds of the refit, the best loss on the stopping rows and rounds tried.
    """
    configs = search_grid() if configs is None else list(configs)
    both, n = [*configs, *plain], len(configs)
    data = prepared(rows, keys, columns, {"fit": FIT, "stop": STOP}, len(both), fold, role)
    limits = {(k, slot): rounds if slot < n else plain_rounds for k in data.targets for slot in range(len(both))}
    grown, probed = grow(data, both, limits, [patience] * n + [None] * len(plain))
    counts = {(e.fold, e.slot): max(e.best_round, least) if e.slot < n else 0 for e in probed}
    # the refit starts again from the mean: the rows as they were first staged
    refitted, _ = grow(data, both, counts)
    names = [c.name for c in configs]
    pred = predictions(refitted, both).where(F.col("config").isin(names))
    if plain:
        pred = pred.unionByName(predictions(grown, both).where(~F.col("config").isin(names)))
    report = [
        {"fold": e.fold, "config": e.config.name, "rounds": counts[e.fold, e.slot], "stop_mae": None if e.best == float("inf") else e.best, "tried": e.rounds}
        for e in probed if e.slot < n
    ]
    return pred, report


def choose(scores: DataFrame, report: list[dict]) -> DataFrame:
    """One row for each (fold, configuration): its scores, the configuration's mean over folds and whether it is chosen.

    The least mean MAE wins; ties go to the smaller name.
    """
    spark = scores.sparkSession
    known = spark.createDataFrame([(r["fold"], r["config"], r["rounds"], r["tried"], r["stop_mae"]) for r in report], "fold int, config string, rounds int, tried int, stop_mae double")
    means = scores.groupBy("config").agg(F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_mae"))
    first = means.agg(F.min_by("config", F.struct("mean_mae", "config")).alias("best"))  # one row
    chosen = means.join(F.broadcast(first)).withColumn("chosen", F.col("config") == F.col("best")).drop("best")
    return scores.join(known, ["fold", "config"]).join(chosen, "config")
