"""SQL text of a Cox or Fine–Gray fit, for checking the Spark fits.

Everything is spelled out in one statement: risk-set sums by window, the
information matrix at 0 and its inverse by elimination, Newton steps with that
fixed inverse as a recursive query, the same again from where they end, then the
information and, if wanted, the score residuals at the solution.

``rows`` must yield ``(st, a, b, d, id, rival, x1 … xp)``: stratum, start, stop,
event, cluster, competing event, terms; complete cases only. With ``tail`` a CTE
``g(time, g_before)`` must exist.
"""

from __future__ import annotations

STEPS = 12        # per inverse; the second half starts next to the solution
Z_95 = "1.959963984540054"

G_CTE = """
ends AS (SELECT time, count(*) AS n_all, count(*) FILTER (event_numeric <> 0) AS d, count(*) FILTER (event_numeric = 0) AS c
         FROM basal GROUP BY time),
gr AS (SELECT e.*, (SELECT sum(n_all) FROM ends x WHERE x.time >= e.time) AS n FROM ends e),
g AS MATERIALIZED (SELECT time, coalesce(product(CASE WHEN c > 0 THEN 1 - c / (n - d) ELSE 1.0 END)
       OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS g_before FROM gr)
"""


def fit_sql(rows: str, terms: list[str], ties: str, tail: bool = False, robust: bool = False, ends: str | None = None) -> str:
    """CTEs ending in ``out(term, coef, hr, lower, upper, se, robust_se, z, p)``.

    ``ends`` yields ``(id, a, b, mark)``, the rows behind the censoring curve (mark 1: event, 2: censored, else 0),
    and adds the uncertainty of that curve (``gr(time, n, d, c)``) to the sandwich; one stratum only.
    """
    p = len(terms)
    js = range(1, p + 1)
    pairs = [(i, j) for i in js for j in js if i <= j]
    x = ", ".join(f"x{j}" for j in js)
    lp = " + ".join(f"b{j} * x{j}" for j in js)
    bs = ", ".join(f"b{j}" for j in js)
    efron = ties == "efron"

    def names(stem):
        return [f"{stem}0", *[f"{stem}{j}" for j in js]]

    def collapse(source, second):
        """Sums per (st, t) at the coefficients in ``source``, then risk-set sums."""
        cols = {"0": "1", **{str(j): f"x{j}" for j in js}}
        if second:
            cols.update({f"{i}_{j}": f"x{i} * x{j}" for i, j in pairs})
        agg = [f"sum(sg * r * {v}) AS a{k}" for k, v in cols.items()]
        agg += [f"sum(d * r * {v}) AS e{k}" for k, v in cols.items()] if efron else []
        agg += [f"sum(tl * r * {v}) AS q{k}" for k, v in cols.items()] if tail else []
        agg += [f"sum(d * x{j}) AS f{j}" for j in js]
        risk = [f"sum(a{k}) OVER back" + (f" + coalesce(any_value(gv) OVER cell, 0) * coalesce(sum(q{k}) OVER fore, 0)" if tail else "")
                + f" AS s{k}" for k in cols]
        gjoin = "LEFT JOIN (SELECT time, g_before AS gv FROM g) gg ON gg.time = y.t" if tail else ""
        return f"""SELECT y.*, {', '.join(risk)}{', gv' if tail else ''} FROM (
          SELECT k, {bs}, st, t, sum(d) AS m, {', '.join(agg)}
          FROM (SELECT src.*, ent.*, exp({lp}) AS r FROM {source} src, ent) GROUP BY k, {bs}, st, t) y {gjoin}
          WINDOW back AS (PARTITION BY k, st ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            {', fore AS (PARTITION BY k, st ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), cell AS (PARTITION BY k, st, t)' if tail else ''}"""

    def untied(inner):
        """One row per tied event (Efron) or per time (Breslow): c, n (share), denominators."""
        if efron:
            return f"SELECT *, l / m AS c, 1.0::DOUBLE AS n FROM (SELECT *, unnest(range(0, CAST(m AS BIGINT))) AS l FROM ({inner}) WHERE m > 0)"
        return f"SELECT *, 0.0::DOUBLE AS c, m * 1.0::DOUBLE AS n FROM ({inner}) WHERE m > 0"

    def cut(k):
        return f"(s{k} - c * e{k})" if efron else f"s{k}"

    score = [f"sum(n * (f{j} / m - {cut(j)} / {cut(0)})) AS u{j}" for j in js]
    info = [f"sum(n * ({cut(f'{i}_{j}')} / {cut(0)} - {cut(i)} * {cut(j)} / ({cut(0)} * {cut(0)}))) AS h{i}_{j}" for i, j in pairs]
    matrix = "[" + ", ".join("[" + ", ".join(f"h{min(i, j)}_{max(i, j)}" for j in js) + "]" for i in js) + "]"

    def hessian(name, source):
        return (f"{name} AS MATERIALIZED (SELECT {matrix} AS h FROM (SELECT {', '.join(info)} "
                f"FROM ({untied(collapse(source, True))})))")

    def inverse(name, source):
        return f"""{name}_gj(k, m) AS (
  SELECT 1, list_transform(h, lambda row, i: list_concat(row, list_transform(range(1, {p + 1}), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)))
  FROM {source}
  UNION ALL
  SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda v: v / m[k][k])
           ELSE list_transform(row, lambda v, j: v - row[k] * m[k][j] / m[k][k]) END)
  FROM {name}_gj WHERE k <= {p}),
{name} AS MATERIALIZED (SELECT list_transform(m, lambda row: row[{p + 1}:]) AS v FROM {name}_gj WHERE k = {p + 1})"""

    def chord(name, source, inv):
        """Newton steps from ``source`` with a fixed inverse."""
        moves = ", ".join(f"b{j} + list_dot_product({inv}.v[{j}], [{', '.join(f'u{i}' for i in js)}])" for j in js)
        at = untied(collapse(f"(SELECT * FROM {name} WHERE k < {STEPS})", False))
        return f"""{name}(k, {bs}) AS (
  SELECT * FROM {source}
  UNION ALL
  SELECT k + 1, {moves} FROM (SELECT k, {bs}, {', '.join(score)} FROM ({at}) GROUP BY k, {bs}), {inv})"""

    means = ", ".join(f"avg(x{j}) AS m{j}" for j in js)
    centred = ", ".join(f"x{j} - m{j} AS x{j}" for j in js)
    late = "coalesce(CASE WHEN rival THEN 1 / g.g_before END, 0.0)" if tail else "0.0::DOUBLE"
    parts = [
        f"rw AS MATERIALIZED ({rows})",
        f"mu AS MATERIALIZED (SELECT {means} FROM rw)",
        f"zz AS MATERIALIZED (SELECT row_number() OVER () AS rid, st, a, b, d, id, {late} AS tl, {centred} FROM rw CROSS JOIN mu"
        + (" LEFT JOIN g ON g.time = rw.b" if tail else "") + ")",
        f"ent AS MATERIALIZED (SELECT st, b AS t, 1 AS sg, d, tl, {x} FROM zz UNION ALL SELECT st, a, -1, 0, 0.0, {x} FROM zz)",
        f"zero AS (SELECT 0 AS k, {', '.join(f'0.0::DOUBLE AS b{j}' for j in js)})",
        hessian("h0", "zero"), inverse("v0", "h0"),
        chord("it", "zero", "v0"),
        f"mid AS MATERIALIZED (SELECT 0 AS k, {bs} FROM it WHERE k = {STEPS})",
        hessian("hm", "mid"), inverse("vm", "hm"),
        chord("it2", "mid", "vm"),
        f"fin AS MATERIALIZED (SELECT 0 AS k, {bs} FROM it2 WHERE k = {STEPS})",
        hessian("h1", "fin"), inverse("v1", "h1"),
    ]
    rse = "NULL::DOUBLE"
    if robust:
        own = []
        for j in js:
            own += [f"sum(n / m * {cut(j)} / {cut(0)}) AS bar{j}", f"sum(n * {cut(j)} / ({cut(0)} * {cut(0)})) AS ph{j}",
                    f"sum(n * c * {cut(j)} / ({cut(0)} * {cut(0)})) AS ps{j}"]
        own += [f"sum(n / {cut(0)}) AS ph0", f"sum(n * c / {cut(0)}) AS ps0"]
        gm = "any_value(gv)" if tail else "0.0"
        scans = [f"coalesce(sum(ph{j}) OVER up, 0) AS ca{j}" for j in (0, *js)]
        scans += [f"coalesce(sum(gm * ph{j}) OVER dn, 0) AS cb{j}" for j in (0, *js)]
        res = [f"""sum(CASE WHEN z.d = 1 THEN x{j} - coalesce(y.bar{j}, 0) ELSE 0 END
            - z.r * (x{j} * (y.ca0 - y0.ca0) - (y.ca{j} - y0.ca{j}))
            + CASE WHEN z.d = 1 THEN z.r * (x{j} * coalesce(y.ps0, 0) - coalesce(y.ps{j}, 0)) ELSE 0 END
            - z.tl * z.r * (x{j} * y.cb0 - y.cb{j})) AS l{j}""" for j in js]
        meat = "[" + ", ".join("[" + ", ".join(f"sum(l{i} * l{j})" for j in js) + "]" for i in js) + "]"
        parts += [
            f"own AS (SELECT st, t, {gm} AS gm, {', '.join(own)} FROM ({untied(collapse('fin', False))}) GROUP BY st, t)",
            f"""path AS MATERIALIZED (SELECT k.st, k.t, own.* EXCLUDE (st, t), {', '.join(scans)}
  FROM (SELECT DISTINCT st, t FROM ent) k LEFT JOIN own ON own.st = k.st AND own.t = k.t
  WINDOW up AS (PARTITION BY k.st ORDER BY k.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         dn AS (PARTITION BY k.st ORDER BY k.t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
            f"""res AS (SELECT z.id, {', '.join(res)} FROM (SELECT zz.*, exp({lp}) AS r FROM zz, fin) z
  JOIN path y ON y.st = z.st AND y.t = z.b JOIN path y0 ON y0.st = z.st AND y0.t = z.a GROUP BY z.id)""",
        ]
        source = "res"
        if ends:
            source = "res_all"
            k = ", ".join(f"coalesce(sum(tl * r * {'1' if j == 0 else f'x{j}'}), 0) AS k{j}" for j in (0, *js))
            cells = ", ".join(f"cq.k{j} * cq.b0 - cq.k0 * cq.b{j} AS q{j}" for j in js)
            parts += [
                f"ends_ AS MATERIALIZED ({ends})",
                f"late_ AS MATERIALIZED (SELECT b AS t, {k} FROM (SELECT zz.*, exp({lp}) AS r FROM zz, fin) WHERE tl > 0 GROUP BY b)",
                f"""cq AS MATERIALIZED (SELECT u.time AS u, u.n - u.d AS y, u.c,
  {', '.join(f"coalesce((SELECT sum(k{j}) FROM late_ WHERE t <= u.time), 0) AS k{j}" for j in (0, *js))},
  {', '.join(f"coalesce((SELECT sum(gm * ph{j}) FROM own WHERE t > u.time), 0) AS b{j}" for j in (0, *js))}
  FROM gr u WHERE u.c > 0)""",
                f"hq AS MATERIALIZED (SELECT u, y, c, {', '.join(f'CASE WHEN y > c THEN q{j} / (y - c) ELSE 0 END AS h{j}' for j in js)} FROM (SELECT u, y, c, {cells} FROM cq))",
                f"""psi AS (SELECT e.id, {', '.join(f"sum(CASE WHEN u = e.b AND e.mark = 2 THEN h{j} ELSE 0 END - CASE WHEN u < e.b OR e.mark <> 1 THEN h{j} * c / y ELSE 0 END) AS l{j}" for j in js)}
  FROM ends_ e JOIN hq ON u > e.a AND u <= e.b GROUP BY e.id)""",
                f"res_all AS (SELECT id, {', '.join(f'sum(l{j}) AS l{j}' for j in js)} FROM (SELECT * FROM res UNION ALL SELECT * FROM psi) GROUP BY id)",
            ]
        parts.append(f"meat AS MATERIALIZED (SELECT {meat} AS w FROM {source})")
        rse = ("sqrt(list_dot_product(v1.v[j], list_transform(meat.w, lambda row: list_dot_product(row, v1.v[j]))))")
    labels = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    parts.append(f"""raw AS MATERIALIZED (SELECT {labels}[j] AS term, [{bs}][j] AS coef, sqrt(v1.v[j][j]) AS se, {rse} AS robust_se
  FROM fin, v1{', meat' if robust else ''}, (SELECT unnest(range(1, {p + 1})) AS j))""")
    parts.append(f"""out AS MATERIALIZED (SELECT term, coef, exp(coef) AS hr, exp(coef - {Z_95} * s) AS lower, exp(coef + {Z_95} * s) AS upper,
    se, robust_se, coef / s AS z,
    1 - sqrt(2 / pi()) * abs(coef / s) / 1200 * list_sum(list_transform(range(0, 401), lambda i:
      (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(i * coef / s / 400) * (i * coef / s / 400) / 2))) AS p
  FROM (SELECT *, coalesce(robust_se, se) AS s FROM raw))""")
    return ",\n".join(parts)


def rounded(digits: int = 6) -> str:
    return "term, " + ", ".join(
        f"round({c}, {digits}) + 0.0 AS {c}" for c in ("coef", "hr", "lower", "upper", "se", "robust_se", "z", "p")) + ", CAST(1 AS BIGINT) AS converged"
