"""An independent estimator on one machine, from the published formulas, in dense numpy."""

import numpy as np


def fix(a):
    low = np.linalg.eigvalsh((a + a.T) / 2)[0]
    return a if low >= 1e-12 else a + np.eye(len(a)) * (1e-12 - low + 1e-10)


def inv(a):
    return np.linalg.inv(fix(a))


def layout_rows(df, kind, transform, exog_x):
    """Per id: (periods, is_level, y, X, y by index, transformed y by index) for y ~ lag(y) + x."""
    times = sorted(df.t.unique())
    rank = {t: i + 1 for i, t in enumerate(times)}
    out = []
    for _, g in df.sort_values(["id", "t"]).groupby("id"):
        y, x, t = g.y.to_numpy(float), g.x.to_numpy(float), g.t.to_numpy()
        n = len(g)
        if n < 3:
            continue
        X = np.column_stack([np.r_[np.nan, y[:-1]], x])
        rows = []
        if transform == "fd":
            for k in range(1, n):
                rows.append((t[k], False, y[k] - y[k - 1], X[k] - X[k - 1]))
        else:
            for k in range(n - 1):
                f = n - 1 - k
                c = np.sqrt(f / (f + 1))
                rows.append((t[k], False, c * (y[k] - y[k + 1 :].mean()), c * (X[k] - X[k + 1 :].mean(axis=0))))
        rows = [r for r in rows if not (np.isnan(r[2]) or np.isnan(r[3]).any())]
        moved = {rank[r[0]]: r[2] for r in rows}
        if kind == "system":
            rows += [(t[k], True, y[k], X[k]) for k in range(2, n) if not np.isnan(X[k]).any()]
        out.append(([rank[r[0]] for r in rows], np.array([r[0] for r in rows]), np.array([r[1] for r in rows], bool), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]).reshape(-1, 2), {rank[a]: b for a, b in zip(t, y)}, moved))
    return out, len(times), df.id.nunique()


def instruments(groups, T, kind, transform, collapse, exog):
    off = 1 if transform == "fd" else 0
    cols = {}
    if kind == "ah":
        cols = {(t, 2): 0 for t in range(3, T + 1)}
        width = 1
    elif collapse:
        for t in range(2 + off, T + 1):
            for o in range(1 + off, t):
                cols[t, o] = o - 1 - off
        width = T - 1 - off
    else:
        for t in range(2 + off, T + 1):
            for o in range(1 + off, t):
                cols[t, o] = len(cols)
        width = len(cols)
    blocks = []
    for tidx, _, lev, _, X, levels, moved in groups:
        n = len(tidx)
        a = np.zeros((n, width))
        b = np.zeros((n, 1 if collapse else T - 2))
        for i in range(n):
            if not lev[i]:
                for (t, o), c in cols.items():
                    if t == tidx[i]:
                        a[i, c] = np.nan_to_num(levels.get(t - o, 0.0))
            elif tidx[i] >= 3:
                b[i, 0 if collapse else tidx[i] - 3] = moved.get(tidx[i] - 1, 0.0)
        parts = [a]
        if exog:
            parts.append(np.where(lev, 0, X[:, 1])[:, None])
        if kind == "system":
            parts.append(b)
            if exog:
                parts.append(np.where(lev, X[:, 1], 0)[:, None])
        blocks.append(np.hstack(parts))
    return blocks


def estimate(df, kind, steps=1, robust=True, windmeijer=True, transform="fd", collapse=False, exog=True):
    groups, T, N = layout_rows(df, kind, transform, exog)
    Z = instruments(groups, T, kind, transform, collapse, exog)
    z = np.vstack(Z)
    # any maximal set of independent columns spans the same space
    keep = []
    for c in range(z.shape[1]):
        if np.linalg.matrix_rank(z[:, [*keep, c]]) > len(keep):
            keep.append(c)
    Z = [b[:, keep] for b in Z]
    M = [b.T @ g[4] for b, g in zip(Z, groups)]
    q = [b.T @ g[3] for b, g in zip(Z, groups)]
    zx, zy = sum(M), sum(q)
    if kind == "difference":
        S = 0
        for b, g in zip(Z, groups):
            t, lev = g[1], g[2]
            h = np.array([[0 if lev[i] or lev[j] else 2 if i == j else -1 if abs(t[i] - t[j]) == 1 else 0 for j in range(len(t))] for i in range(len(t))], float).reshape(len(t), len(t))
            S = S + b.T @ h @ b
        W = inv(S / N)
    else:
        W = inv(sum(b.T @ b for b in Z))
    A = zx.T @ W
    B = inv(A @ zx)
    beta = B @ A @ zy
    res = [(b.T @ (g[3] - g[4] @ beta)) for b, g in zip(Z, groups)]
    om = sum(np.outer(r, r) for r in res)
    Vr = B @ A @ om @ A.T @ B
    u = np.concatenate([g[3] - g[4] @ beta for g in groups])
    V = Vr if robust else u @ u / (len(u) - 2) * B
    if steps == 2:
        W = inv(om)
        B2 = inv(zx.T @ W @ zx)
        beta = B2 @ zx.T @ W @ zy
        V = B2
        if robust and windmeijer:
            c = W @ (zy - zx @ beta)
            temp = -sum((r @ c) * m + np.outer(r, m.T @ c) for r, m in zip(res, M))
            D = -B2 @ zx.T @ W @ temp
            V = B2 + D @ B2 + B2 @ D.T + D @ Vr @ D.T
    e = zy - zx @ beta
    return {"beta": beta, "se": np.sqrt(np.diag(V)), "j": float(e @ W @ e), "L": len(keep), "n": len(u)}
