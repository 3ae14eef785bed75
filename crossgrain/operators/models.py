"""Models of panels: ridge from sums, gradient-boosted trees from MLlib, and graph networks as numpy kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ridge_gram(df: DataFrame, features: list[str], target: str, *by: str) -> DataFrame:
    """by, n, sums s_i, products q_i_j (j <= i), t_i with the target, and st: all that a ridge fit needs, in one aggregation. Missing features are 0."""
    df = df.where(F.col(target).isNotNull())
    x = [F.coalesce(f, F.lit(0.0)) for f in features]
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"q_{i}_{j}") for i in range(len(x)) for j in range(i + 1)]
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(target).alias("st"), *[F.sum(c * F.col(target)).alias(f"t_{i}") for i, c in enumerate(x)], *sums)


def ridge_solution(gram: dict, p: int, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of a row of `ridge_gram`; the intercept is not penalised."""
    n, s, t = gram["n"], np.array([gram[f"s_{i}"] for i in range(p)]), np.array([gram[f"t_{i}"] for i in range(p)])
    q = np.array([[gram[f"q_{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)])
    centred = q - np.outer(s, s) / n
    beta = np.linalg.solve(centred + alpha * np.eye(p), t - s * gram["st"] / n)
    return beta, float(gram["st"] / n - beta @ s / n)


def ridge_walk_forward(df: DataFrame, folds: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """fold_id, pos, asset, pred, target of test rows: a fit a fold, from sums; the driver has one row of sums a fold.

    `df`: pos, asset, features, target; `folds`: fold_id, role, pos.
    """
    spark = df.sparkSession
    dealt = df.join(F.broadcast(folds.select("fold_id", "role", "pos")), "pos")
    grams = ridge_gram(dealt.where("role = 'train'"), features, target, "fold_id").collect()
    fits = [(g["fold_id"], [float(b) for b in beta], float(c)) for g in grams for beta, c in [ridge_solution(g.asDict(), len(features), alpha)]]
    if not fits:
        return dealt.where("false").select("fold_id", "pos", "asset", F.lit(0.0).alias("pred"), F.col(target).alias("target"))
    table = spark.createDataFrame(fits, "fold_id int, ridge_beta array<double>, ridge_intercept double")
    pred = F.col("ridge_intercept")
    for i, f in enumerate(features):
        pred = pred + F.col("ridge_beta")[i] * F.coalesce(f, F.lit(0.0))
    return dealt.where("role = 'test'").join(F.broadcast(table), "fold_id").select("fold_id", "pos", "asset", pred.alias("pred"), F.col(target).alias("target"))


def boosted_trees(train: DataFrame, test: DataFrame, features: list[str], target: str, trees: int = 30, rate: float = 0.1, depth: int = 4, seed: int = 0) -> DataFrame:
    """`test` and pred of gradient-boosted regression trees (MLlib)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    fill = {f: F.coalesce(f, F.lit(0.0)) for f in features}
    assemble = VectorAssembler(inputCols=features, outputCol="_x")
    model = GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="pred", maxIter=trees, stepSize=rate, maxDepth=depth, subsamplingRate=0.8, seed=seed)
    fitted = model.fit(assemble.transform(train.withColumns(fill).where(F.col(target).isNotNull())))
    return fitted.transform(assemble.transform(test.withColumns(fill))).drop("_x")


def mean_aggregation(edges: np.ndarray, n: int) -> np.ndarray:
    """The [n, n] matrix that averages at dst what src sends; `edges` [2, e]."""
    a = np.zeros((n, n))
    if edges.size:
        np.add.at(a, (edges[1], edges[0]), 1.0)
    return a / np.maximum(a.sum(axis=1, keepdims=True), 1)


def soft_spearman(pred: np.ndarray, target: np.ndarray, reg: float = 1e-2) -> float:
    """1 less the correlation of soft ranks; 0 under 3 values."""
    if len(pred) < 3:
        return 0.0
    return float(1 - np.corrcoef(_soft_rank(pred, reg)[0], _soft_rank(target, reg)[0])[0, 1])


def _soft_rank(x: np.ndarray, reg: float) -> tuple[np.ndarray, np.ndarray]:
    s = 1 / (1 + np.exp(-np.clip((x[:, None] - x[None, :]) / reg, -500, 500)))
    return s.sum(axis=1), s * (1 - s) / reg


def soft_spearman_gradient(pred: np.ndarray, target: np.ndarray, reg: float = 1e-2) -> np.ndarray:
    """d soft_spearman / d pred."""
    if len(pred) < 3:
        return np.zeros_like(pred)
    a, slope = _soft_rank(pred, reg)
    b = _soft_rank(target, reg)[0]
    a, b = a - a.mean(), b - b.mean()
    na, nb = np.linalg.norm(a) + 1e-12, np.linalg.norm(b) + 1e-12
    g = -(b / (na * nb) - a * (a @ b) / (na**3 * nb))
    g = g - g.mean()
    return slope.sum(axis=1) * g - slope.T @ g


class _Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def train(params: list[np.ndarray], gradient, validate, epochs: int, patience: int, rate: float) -> None:
    """Full-batch Adam on `gradient()`, until `validate()` has not improved for `patience` epochs; the best state is kept, in place."""
    adam, best, kept, waited = _Adam(params, rate), np.inf, [p.copy() for p in params], 0
    for _ in range(epochs):
        adam.step(gradient())
        now = validate()
        if now < best - 1e-5:
            best, kept, waited = now, [p.copy() for p in params], 0
        else:
            waited += 1
            if waited >= patience:
                break
    for p, q in zip(params, kept, strict=True):
        p[:] = q


def purged_validation(n: int, share: float, gap: int) -> tuple[slice, slice]:
    """The first dates, to train on, and the last, to stop by, with `gap` dates between whose labels overlap."""
    cut = max(1, int(n * share))
    return slice(0, max(1, cut - gap)), slice(cut if cut < n else n - 1, n)


def rank_gradient(pred: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of the soft rank loss over the finite targets; 0 elsewhere."""
    ok, g = np.isfinite(target), np.zeros_like(pred)
    g[ok] = soft_spearman_gradient(pred[ok], target[ok])
    return g


def rank_loss(preds: list[np.ndarray], targets: list[np.ndarray]) -> float:
    return float(np.mean([soft_spearman(y[np.isfinite(t)], t[np.isfinite(t)]) for y, t in zip(preds, targets, strict=True)]))


class SageNetwork:
    """Two layers relu(h W_s + mean of neighbours W_n) and a linear head, trained on the soft rank loss of whole dates."""

    def __init__(self, n_features: int, hidden: int = 32, seed: int = 0):
        rng = np.random.default_rng(seed)
        init = lambda a, b: rng.normal(0, np.sqrt(2 / a), (a, b))
        self.params = [init(n_features, hidden), init(n_features, hidden), np.zeros(hidden), init(hidden, hidden), init(hidden, hidden), np.zeros(hidden), init(hidden, 1), np.zeros(1)]

    def forward(self, x: np.ndarray, a: np.ndarray):
        s1, n1, b1, s2, n2, b2, w, c = self.params
        ax = a @ x
        h1 = np.maximum(x @ s1 + ax @ n1 + b1, 0)
        ah = a @ h1
        h2 = np.maximum(h1 @ s2 + ah @ n2 + b2, 0)
        return (h2 @ w + c)[:, 0], (x, a, ax, h1, ah, h2)

    def gradients(self, kept, g: np.ndarray) -> list[np.ndarray]:
        x, a, ax, h1, ah, h2 = kept
        s1, n1, b1, s2, n2, b2, w, c = self.params
        g = g[:, None]
        gw, gc = h2.T @ g, g.sum(axis=0)
        g2 = (g @ w.T) * (h2 > 0)
        g1 = (g2 @ s2.T + a.T @ (g2 @ n2.T)) * (h1 > 0)
        return [x.T @ g1, ax.T @ g1, g1.sum(axis=0), h1.T @ g2, ah.T @ g2, g2.sum(axis=0), gw, gc]

    def fit(self, days: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 200, rate: float = 1e-3, share: float = 0.8, gap: int = 1, patience: int = 20) -> SageNetwork:
        """`days`: (features, mean aggregation, target) in order."""
        first, last = purged_validation(len(days), share, gap)

        def gradient():
            total = [np.zeros_like(p) for p in self.params]
            for x, a, t in days[first]:
                y, state = self.forward(x, a)
                for p, q in zip(total, self.gradients(state, rank_gradient(y, t)), strict=True):
                    p += q / len(days[first])
            return total

        train(self.params, gradient, lambda: rank_loss([self.forward(x, a)[0] for x, a, _ in days[last]], [t for _, _, t in days[last]]), epochs, patience, rate)
        return self

    def predict(self, x: np.ndarray, a: np.ndarray) -> np.ndarray:
        return self.forward(x, a)[0]


class GraphRecurrentNetwork:
    """At each date, relu(x W_s + mean of neighbours W_n) into a gated recurrent unit over dates and a linear score, trained through time on the soft rank loss."""

    def __init__(self, n_features: int, hidden: int = 32, seed: int = 0):
        rng = np.random.default_rng(seed)
        init = lambda a, b: rng.normal(0, np.sqrt(1 / a), (a, b))
        self.hidden = hidden
        gate = lambda: [init(hidden, hidden), init(hidden, hidden), np.zeros(hidden)]
        self.params = [init(n_features, hidden), init(n_features, hidden), *gate(), *gate(), *gate(), init(hidden, 1), np.zeros(1)]

    def unroll(self, days: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], list]:
        """The scores at each day of (features, mean aggregation), and what the way back needs; the same nodes in every day."""
        sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
        ws, wn, zx, zh, zb, rx, rh, rb, hx, hh, hb, w, c = self.params
        h, scores, kept = np.zeros((len(days[0][0]), self.hidden)), [], []
        for x, a in days:
            ax = a @ x
            u = np.maximum(x @ ws + ax @ wn, 0)
            z, r = sigmoid(u @ zx + h @ zh + zb), sigmoid(u @ rx + h @ rh + rb)
            n = np.tanh(u @ hx + (r * h) @ hh + hb)
            before, h = h, (1 - z) * n + z * h
            scores.append((h @ w + c)[:, 0])
            kept.append((x, ax, u, z, r, n, before, h))
        return scores, kept

    def gradients(self, kept: list, slopes: list[np.ndarray]) -> list[np.ndarray]:
        """Of all parameters, from the slopes of the loss at each day's scores."""
        ws, wn, zx, zh, zb, rx, rh, rb, hx, hh, hb, w, c = self.params
        g = [np.zeros_like(p) for p in self.params]
        dh = np.zeros_like(kept[0][-1])
        for (x, ax, u, z, r, n, before, h), slope in zip(reversed(kept), reversed(slopes), strict=True):
            g[11] += h.T @ slope[:, None]
            g[12] += slope.sum(keepdims=True)
            dh = dh + slope[:, None] @ w.T
            dn, dz = dh * (1 - z) * (1 - n * n), dh * (before - n) * z * (1 - z)
            back = dn @ hh.T
            dr = back * before * r * (1 - r)
            du = (dn @ hx.T + dz @ zx.T + dr @ rx.T) * (u > 0)
            for k, (d, state) in zip((2, 5, 8), ((dz, before), (dr, before), (dn, r * before)), strict=True):
                g[k] += u.T @ d
                g[k + 1] += state.T @ d
                g[k + 2] += d.sum(axis=0)
            g[0] += x.T @ du
            g[1] += ax.T @ du
            dh = dh * z + back * r + dz @ zh.T + dr @ rh.T
        return g

    def fit(self, days: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 300, rate: float = 1e-3, share: float = 0.8, gap: int = 1, patience: int = 25) -> GraphRecurrentNetwork:
        """`days`: (features, mean aggregation, target) in order, the same nodes in each."""
        first, last = purged_validation(len(days), share, gap)
        inputs, targets = [(x, a) for x, a, _ in days], [t for _, _, t in days]

        def gradient():
            scores, kept = self.unroll(inputs[first])
            return self.gradients(kept, [rank_gradient(y, t) / len(scores) for y, t in zip(scores, targets[first], strict=True)])

        train(self.params, gradient, lambda: rank_loss(self.unroll(inputs)[0][last], targets[last]), epochs, patience, rate)
        return self


class BoostedTrees:
    """Gradient boosting of squared error: trees of bounded depth over quantile bins, each on a random part of the rows."""

    def __init__(self, trees: int = 300, rate: float = 0.03, depth: int = 4, bins: int = 32, share: float = 0.8, least_rows: int = 20, seed: int = 0):
        self.trees, self.rate, self.depth, self.bins, self.share, self.least_rows, self.seed = trees, rate, depth, bins, share, least_rows, seed

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rng = np.random.default_rng(self.seed)
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, self.base, self.grown = self._binned(x), float(y.mean()), []
        now, offset = np.full(len(y), self.base), np.arange(x.shape[1]) * self.bins
        for _ in range(self.trees):
            rows = np.flatnonzero(rng.random(len(y)) < self.share)
            error, tree, nodes = y - now, {}, [(1, rows)]
            while nodes:
                k, at = nodes.pop()
                value = float(error[at].mean()) if len(at) else 0.0
                split = None
                if k < 1 << self.depth and len(at) >= 2 * self.least_rows:
                    flat = (b[at] + offset).ravel()
                    n = np.bincount(flat, minlength=x.shape[1] * self.bins).reshape(-1, self.bins).cumsum(axis=1)
                    e = np.bincount(flat, np.repeat(error[at], x.shape[1]), minlength=x.shape[1] * self.bins).reshape(-1, self.bins).cumsum(axis=1)
                    rest, total = len(at) - n, e[0, -1]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where((n >= self.least_rows) & (rest >= self.least_rows), e * e / n + (total - e) ** 2 / rest - total * total / len(at), -np.inf)
                    j, c = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[j, c] > 1e-12:
                        split = (int(j), int(c))
                        left = b[at, j] <= c
                        nodes += [(2 * k, at[left]), (2 * k + 1, at[~left])]
                tree[k] = (split, value)
            self.grown.append(tree)
            now = now + self.rate * self._walk(tree, b)
        return self

    def _walk(self, tree: dict, b: np.ndarray) -> np.ndarray:
        out, nodes = np.zeros(len(b)), [(1, np.arange(len(b)))]
        while nodes:
            k, at = nodes.pop()
            split, value = tree[k]
            if split is None:
                out[at] = value
            else:
                left = b[at, split[0]] <= split[1]
                nodes += [(2 * k, at[left]), (2 * k + 1, at[~left])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + self.rate * sum((self._walk(t, b) for t in self.grown), np.zeros(len(b)))


class _Rows:
    """A model of rows, fitted on all dates together."""

    def __init__(self, make):
        self.make = make

    def fit(self, days, gap):
        x, y = np.concatenate([x for x, _, _ in days]), np.concatenate([t for _, _, t in days])
        self.model = self.make().fit(x[np.isfinite(y)], y[np.isfinite(y)])
        return self

    def predict(self, x, a):
        return self.model.predict(x)


class _Ridge:
    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def fit(self, x, y):
        self.mean, self.base = x.mean(axis=0), y.mean()
        xc = x - self.mean
        self.beta = np.linalg.solve(xc.T @ xc + self.alpha * np.eye(x.shape[1]), xc.T @ (y - self.base))
        return self

    def predict(self, x):
        return self.base + (x - self.mean) @ self.beta


class _Network:
    """A network of dates; without a graph every node is alone with itself."""

    def __init__(self, graph: bool, **options):
        self.graph, self.options = graph, options

    def _day(self, x, a):
        return x, a if self.graph else np.eye(len(x))

    def fit(self, days, gap):
        self.net = SageNetwork(days[0][0].shape[1], seed=self.options.get("seed", 0)).fit([(*self._day(x, a), t) for x, a, t in days], gap=gap)
        return self

    def predict(self, x, a):
        return self.net.predict(*self._day(x, a))


#: Models of days (features, mean aggregation, target): `fit(days, gap)` and `predict(features, mean aggregation)`.
MODELS = {
    "ridge": lambda **o: _Rows(lambda: _Ridge(**o)),
    "gbm": lambda **o: _Rows(lambda: BoostedTrees(**o)),
    "mlp": lambda **o: _Network(False, **o),
    "gnn": lambda **o: _Network(True, **o),
}


def build_model(name: str, **options):
    """A fresh model of a name in MODELS."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name}")
    return MODELS[name](**options)


def aggregation_of(nodes: list, links: pd.DataFrame) -> np.ndarray:
    """The mean aggregation of `nodes` along `links` (src, dst), both ways, with loops."""
    at = pd.Series(np.arange(len(nodes)), index=nodes)
    i, j = at.reindex(links["src"]).to_numpy(), at.reindex(links["dst"]).to_numpy()
    ok = np.isfinite(i) & np.isfinite(j)
    e = np.stack([i[ok], j[ok]]).astype(int)
    both = np.concatenate([e, e[::-1], np.tile(np.arange(len(nodes)), (2, 1))], axis=1)
    return mean_aggregation(np.unique(both, axis=1), len(nodes))


def model_walk_forward(data: DataFrame, edges: DataFrame, folds: DataFrame, names: tuple[str, ...], features: list[str], target: str, gap: int = 1) -> DataFrame:
    """model, fold_id, pos, asset, pred, target of every test date: each model fitted to the fold's training dates.

    `data`: d, pos, asset, features, target; `edges`: as_of (a date of `data`), src, dst; `folds`: fold_id, role, pos. A
    fold is a group: its training rows are in one task, folds are dealt over tasks.
    """
    dealt = data.select("d", "pos", "asset", *features, F.col(target).alias("target")).join(F.broadcast(folds.select("fold_id", "role", "pos")), "pos")
    dates = dealt.select("fold_id", F.col("d").alias("as_of")).distinct()
    links = edges.select("as_of", "src", "dst").join(F.broadcast(dates.select("as_of", F.col("fold_id").alias("link_fold"))), "as_of")

    def fitted(key, rows, links):
        out, table = [], {"train": [], "test": []}
        of = dict(tuple(links.groupby("as_of")))
        none = links.iloc[:0]
        for (role, pos, d), day in rows.groupby(["role", "pos", "d"], sort=True):
            day = day.sort_values("asset")
            table[role].append((pos, day["asset"].tolist(), day[features].fillna(0.0).to_numpy(float), aggregation_of(day["asset"].tolist(), of.get(d, none)), day["target"].to_numpy(float)))
        train = [(x, a, t) for _, _, x, a, t in table["train"] if np.isfinite(t).any()]
        for name in names if train else ():
            model = build_model(name).fit(train, gap)
            for pos, assets, x, a, t in table["test"]:
                out += [(name, int(key[0]), int(pos), n, float(y), None if v != v else float(v)) for n, y, v in zip(assets, model.predict(x, a), t, strict=True)]
        return pd.DataFrame(out, columns=["model", "fold_id", "pos", "asset", "pred", "target"])

    kind = data.schema["asset"].dataType.simpleString()
    out = dealt.groupBy("fold_id").cogroup(links.groupBy("link_fold")).applyInPandas(fitted, f"model string, fold_id int, pos int, asset {kind}, pred double, target double")
    return out.withColumn("target", F.nanvl("target", F.lit(None).cast("double")))
