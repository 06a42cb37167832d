"""Regressions of one training window in numpy: (n, p) rows in, coefficients on the original scale out.

Windows have hundreds of rows and tens of columns; the backtest runs many of them per Arrow batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

RIDGE_ALPHAS = np.logspace(-3, 3, 25)
L1_RATIOS = (0.2, 0.5, 0.8, 0.95)


def ols(X: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and slopes of least norm among the best."""
    return np.linalg.lstsq(np.column_stack([np.ones(len(y)), X]), y, rcond=None)[0]


def _scaled(X: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, sd = X.mean(0), X.std(0)
    sd = np.where(sd == 0, 1.0, sd)
    return (X - mean) / sd, mean, sd


def _unscaled(w: np.ndarray, at: float, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    w = w / sd
    return np.concatenate([[at - w @ mean], w])


def ridge(X: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Penalty of least leave-one-out error, all of them from one singular value decomposition."""
    Z, mean, sd = _scaled(X)
    at = y.mean()
    U, s, Vt = np.linalg.svd(Z, full_matrices=False)
    uy, best = U.T @ (y - at), (np.inf, None)
    for alpha in RIDGE_ALPHAS:
        f = s * s / (s * s + alpha)
        hat = 1 / len(y) + (U * U) @ f
        loo = ((y - at - U @ (f * uy)) / np.maximum(1 - hat, 1e-12)) ** 2
        if loo.mean() < best[0]:
            best = loo.mean(), Vt.T @ (np.divide(f, s, out=np.zeros_like(s), where=s > 1e-12) * uy)
    return _unscaled(best[1], at, mean, sd)


def _sparse(gram: np.ndarray, xy: np.ndarray, w: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The w of least (1/2) w'Gw - w'c + l1 |w| + (l2/2) |w|^2, started from ``w``, by feature-sign search.

    With the signs of the coefficients in use guessed, the optimum is one linear system. Where a coefficient would change its
    sign on the way there, the best point on the way is taken and the guess mended; then the column that breaks the optimality
    conditions most comes in. Each round lowers the objective, so that no guess comes twice."""
    H = gram + l2 * np.eye(len(w))
    w, sign = w.copy(), np.sign(w)
    cost = lambda v, at: 0.5 * v @ H[np.ix_(at, at)] @ v - v @ xy[at] + l1 * np.abs(v).sum()
    for _ in range(100 * (len(w) + 1)):
        at = np.flatnonzero(sign)
        if len(at):
            A, right = H[np.ix_(at, at)], xy[at] - l1 * sign[at]
            try:
                goal = np.linalg.solve(A, right)
            except np.linalg.LinAlgError:
                goal = np.linalg.lstsq(A, right, rcond=None)[0]
            old = w[at]
            if np.all(np.sign(goal) == sign[at]):
                w[at] = goal
            else:
                move = goal - old
                turn = np.divide(-old, move, out=np.full_like(old, 2.0), where=move != 0)
                stops = np.unique(np.append(turn[(turn > 0) & (turn < 1)], 1.0))
                points = [np.where(np.abs(turn - t) < 1e-14, 0.0, old + t * move) for t in stops]
                best = min(points, key=lambda v: cost(v, at))
                if cost(best, at) >= cost(old, at) - 1e-15 * abs(cost(old, at)):
                    sign = np.sign(w)  # no better point for this guess
                    break
                w[at] = best
                sign = np.sign(w)
                continue
        grad = H @ w - xy
        over = np.where(sign == 0, np.abs(grad) - l1, -1.0)
        j = int(over.argmax())
        if over[j] <= 1e-10 * max(l1, 1e-12) + 1e-13:
            break
        sign[j] = -np.sign(grad[j])
    return w


def folds(n: int, k: int = 5) -> list[tuple[int, int]]:
    """(end of training, end of test) of expanding time-ordered folds."""
    # Fixed rule: a fold for each eight rows, at least two, at most ``k``; two where there are under 16 rows.
    k = max(2, min(k, n // 8)) if n >= 16 else 2
    size = n // (k + 1)
    return [(n - (k - i) * size, n - (k - i - 1) * size) for i in range(k)]


def _moments(Z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    mean, at = Z.mean(axis=0), y.mean()
    C = Z - mean
    return C.T @ C / len(y), C.T @ (y - at) / len(y), mean, at


def _path(Z: np.ndarray, y: np.ndarray, ratio: float, alphas: np.ndarray) -> np.ndarray:
    """Intercept and coefficients at each penalty, each started from the last."""
    gram, xy, mean, at = _moments(Z, y)
    w, out = np.zeros(len(xy)), []
    for a in alphas:
        w = _sparse(gram, xy, w, a * ratio, a * (1 - ratio))
        out.append(np.concatenate([[at - w @ mean], w]))
    return np.array(out)


def _penalised(X, y, ratios, n_alphas):
    """The penalty and ratio of least error over time-ordered folds."""
    Z, mean, sd = _scaled(X)
    parts = folds(len(y))
    pull = np.abs(Z.T @ (y - y.mean())).max(initial=0.0) / len(y)
    best = (np.inf, None, None)
    for ratio in ratios:
        alphas = max(pull / ratio, 1e-12) * np.geomspace(1.0, 1e-3, n_alphas)
        errors = np.zeros(n_alphas)
        for a, b in parts:
            w = _path(Z[:a], y[:a], ratio, alphas)
            errors += ((w[:, :1] + w[:, 1:] @ Z[a:b].T - y[a:b]) ** 2).mean(axis=1) / len(parts)
        i = int(errors.argmin())
        if errors[i] < best[0]:
            best = errors[i], ratio, alphas[: i + 1]
    w = _path(Z, y, best[1], best[2])[-1]
    return _unscaled(w[1:], w[0], mean, sd)


def lasso(X: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _penalised(X, y, (1.0,), 40)


def enet(X: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _penalised(X, y, L1_RATIOS, 30)


def arlr(X: np.ndarray, y: np.ndarray, forced: int = 0, most: int = 10) -> np.ndarray:
    """Least squares on the first ``forced`` columns and at most ``most`` others, each the one that lowers the squares most, while the
    corrected information criterion falls.

    An orthonormal basis of the chosen columns grows by one column a step; what is left of the others and of ``y`` is kept
    orthogonal to it, so that the gain of every candidate is one product."""
    n, cols, free = len(y), [], list(range(X.shape[1]))
    rest, left = X - X.mean(axis=0), y - y.mean()
    scale = np.maximum((rest * rest).sum(axis=0), 1e-300)

    def criterion(rss, k):
        return np.inf if n - k - 1 <= 0 or rss <= 0 else n * np.log(rss / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)

    def take(j):
        nonlocal rest, left
        size = rest[:, j] @ rest[:, j]
        if size > 1e-12 * scale[j]:
            q = rest[:, j] / np.sqrt(size)
            rest, left = rest - np.outer(q, q @ rest), left - q * (q @ left)
        cols.append(j)
        free.remove(j)

    for j in range(forced):
        take(j)
    now = criterion(left @ left, len(cols) + 1)
    for _ in range(most):
        if not free:
            break
        size = (rest[:, free] * rest[:, free]).sum(axis=0)
        gain = np.where(size > 1e-12 * scale[free], (left @ rest[:, free]) ** 2 / np.maximum(size, 1e-300), 0.0)
        best = int(gain.argmax())
        after = criterion(left @ left - gain[best], len(cols) + 2)
        if not after < now - 1e-9:
            break
        now = after
        take(free[best])
    b, out = ols(X[:, cols], y), np.zeros(X.shape[1] + 1)
    out[0] = b[0]
    out[[c + 1 for c in cols]] = b[1:]
    return out


def leaf(X: np.ndarray, y: np.ndarray, at: np.ndarray, rng: np.random.Generator, least: int, share: float) -> float:
    """What a regression tree grown on (X, y) says at the point ``at``.

    Only the nodes on the way to that point are grown: a node's split depends on its own rows and its own draw of columns, so
    the rest of the tree has no say. A node splits where the squares fall most, with ``least`` rows on either side, on ``share``
    of the columns, or on the others where none of those can split."""
    p = X.shape[1]
    m = max(1, int(p * share))
    while len(y) >= 2 * least and np.ptp(y) > 0:
        order, n = rng.permutation(p), len(y)
        left = np.arange(least, n - least + 1)
        for cols in (order[:m], order[m:]):
            if not len(cols):
                continue
            by = X[:, cols].argsort(axis=0, kind="stable")
            x = np.take_along_axis(X[:, cols], by, 0)
            total = np.cumsum(y[by] - y.mean(), axis=0)[left - 1]
            gain = np.where(x[left] > x[left - 1], total**2 / left[:, None] + total**2 / (n - left)[:, None], -1.0)
            i, j = np.unravel_index(gain.argmax(), gain.shape)
            if gain[i, j] >= 0:
                break
        else:
            break
        edge = (x[left[i] - 1, j] + x[left[i], j]) / 2
        side = (X[:, cols[j]] <= edge) == (at[cols[j]] <= edge)
        X, y = X[side], y[side]
    return float(y.mean())


def forest(X: np.ndarray, y: np.ndarray, at: np.ndarray, trees: int = 300, least: int = 3, share: float = 0.5) -> float:
    """Mean over ``trees`` trees on rows drawn with repeats. The draws follow from the tree's number, so that a retry gives the same."""
    out = 0.0
    for i in range(trees):
        rng = np.random.default_rng(i)
        rows = rng.integers(0, len(y), len(y))
        out += leaf(X[rows], y[rows], at, rng, least, share) / trees
    return out


def fitter(name: str, forced: int = 0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return {"ar": ols, "ols": ols, "ridge": ridge, "lasso": lasso, "enet": enet, "arlr": lambda X, y: arlr(X, y, forced)}[name]


def cluster(Z: np.ndarray, threshold: float = 0.4, most: int | None = None) -> list[int]:
    """Labels (from 0, by first member) of columns joined by average linkage on 1 - correlation while that is within
    ``threshold``, or until there are ``most`` groups."""
    k = Z.shape[1]
    if k <= 2:
        return list(range(k))
    with np.errstate(invalid="ignore", divide="ignore"):
        d = 1 - np.nan_to_num(np.corrcoef(Z, rowvar=False))
    groups = [[j] for j in range(k)]
    while len(groups) > (most or 1):
        dist, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if not most and dist > threshold:
            break
        groups[i] = sorted(groups[i] + groups.pop(j))
    order = sorted(groups, key=min)
    return [next(i for i, g in enumerate(order) if j in g) for j in range(k)]
