"""Plain numpy versions of the estimators, written straight from the definitions."""

import numpy as np


def cox(start, stop, status, x, weight=None, strata=None, ties="efron", cluster=None, robust=False, steps=40):
    start, stop = np.asarray(start, float), np.asarray(stop, float)
    status, x = np.asarray(status, int), np.asarray(x, float)
    n, p = x.shape
    w = np.ones(n) if weight is None else np.asarray(weight, float)
    strata = np.zeros(n) if strata is None else np.asarray(strata)
    beta = np.zeros(p)

    def terms(b):
        """Yield (rows at risk, tied event rows, their share l/m, q-weights, weight of the term)."""
        for s in np.unique(strata):
            for t in np.unique(stop[(status == 1) & (strata == s)]):
                risk = (start < t) & (stop >= t) & (strata == s)
                dead = (stop == t) & (status == 1) & (strata == s)
                m, d = dead.sum(), w[dead].sum()
                cuts = [0.0] if ties == "breslow" else [l / m for l in range(m)]
                for c in cuts:
                    yield risk, dead, c, d / len(cuts)

    def at(b):
        r = w * np.exp(x @ b)
        ll, u, info = 0.0, np.zeros(p), np.zeros((p, p))
        for risk, dead, c, d in terms(b):
            q = np.where(dead, (1 - c) * r, r) * risk
            s0, s1 = q.sum(), q @ x
            s2 = (x * q[:, None]).T @ x
            share = d / w[dead].sum()
            ll += share * (w[dead] * (x[dead] @ b)).sum() - d * np.log(s0)
            u += share * (w[dead] @ x[dead]) - d * s1 / s0
            info += d * (s2 / s0 - np.outer(s1, s1) / s0 ** 2)
        return ll, u, info

    for _ in range(steps):
        ll, u, info = at(beta)
        step = np.linalg.solve(info, u)
        beta = beta + step
        if np.max(np.abs(step)) < 1e-12:
            break
    ll, u, info = at(beta)
    var = np.linalg.inv(info)
    out = {"coef": beta, "var": var, "ll": ll}
    if robust or cluster is not None:
        r = w * np.exp(x @ beta)
        res = np.zeros((n, p))
        for risk, dead, c, d in terms(beta):
            q = np.where(dead, (1 - c) * r, r) * risk
            s0, s1 = q.sum(), q @ x
            bar = s1 / s0
            share = d / w[dead].sum()
            res[dead] += share * w[dead][:, None] * (x[dead] - bar)
            res -= d * q[:, None] * (x - bar) / s0
        groups = np.arange(n) if cluster is None else np.asarray(cluster)
        summed = np.array([res[groups == g].sum(axis=0) for g in np.unique(groups)])
        out["robust"] = var @ (summed.T @ summed) @ var
    return out


def km(start, stop, status, weight=None):
    start, stop, status = map(np.asarray, (start, stop, status))
    w = np.ones(len(stop)) if weight is None else np.asarray(weight)
    s, out = 1.0, {}
    for t in np.unique(stop):
        n = w[(start < t) & (stop >= t)].sum()
        d = w[(stop == t) & (status == 1)].sum()
        s *= 1 - d / n
        out[t] = s
    return out


def cif(stop, cause, codes=(1, 2)):
    stop, cause = np.asarray(stop), np.asarray(cause)
    s, total, out = 1.0, dict.fromkeys(codes, 0.0), {}
    for t in np.unique(stop):
        n = (stop >= t).sum()
        for k in codes:
            total[k] += s * ((stop == t) & (cause == k)).sum() / n
        s *= 1 - ((stop == t) & (cause != 0)).sum() / n
        out[t] = dict(total)
    return out


def censor_before(stop, cause, last=None, start=None):
    """G(t-) at every distinct time."""
    stop, cause = np.asarray(stop), np.asarray(cause)
    last = np.ones(len(stop), bool) if last is None else np.asarray(last)
    start = np.full(len(stop), -1) if start is None else np.asarray(start)
    g, out = 1.0, {}
    for t in np.unique(stop):
        out[t] = g
        n = ((start < t) & (stop >= t)).sum() - ((stop == t) & (cause != 0)).sum()
        c = ((stop == t) & (cause == 0) & last).sum()
        if c:
            g *= 1 - c / n
    return out


def finegray_rows(start, stop, cause, focal, last=None):
    """Expansion split at every focal event time: (row, start, stop, status, weight)."""
    start, stop, cause = map(np.asarray, (start, stop, cause))
    g = censor_before(stop, cause, last, start)
    times = np.unique(stop[cause == focal])
    rows = []
    for i in range(len(stop)):
        rows.append((i, start[i], stop[i], int(cause[i] == focal), 1.0))
        if cause[i] not in (0, focal):
            prev = stop[i]
            for t in times[times > stop[i]]:
                rows.append((i, prev, t, 0, g[t] / g[stop[i]]))
                prev = t
    return rows
