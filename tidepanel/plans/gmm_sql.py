"""The estimators in DuckDB's SQL, for comparison: matrices are lists, inverses Gauss-Jordan steps of a recursive query.

The SQL is for y ~ lag(y) + x with x exogenous, over a panel p(id, t, y, x); see
``queries`` for the panels and the common table expressions l, d and fo.
"""

from __future__ import annotations


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def product(a: str, b_columns: str) -> str:
    """a times the matrix whose columns are given, both as lists of rows and of columns."""
    return f"list_transform({a}, lambda r_: list_transform({b_columns}, lambda c_: {dot('r_', 'c_')}))"


def times(a: str, v: str) -> str:
    return f"list_transform({a}, lambda r_: {dot('r_', v)})"


def transposed(a: str) -> str:
    return f"list_transform(generate_series(1, len({a}[1])), lambda j_: list_transform({a}, lambda r_: r_[j_]))"


def inverse(name: str, source: str, column: str) -> str:
    """CTEs that end in name(m), the inverse of the one matrix in source(column)."""
    step = "list_transform(generate_series(1, n), lambda i_: list_transform(generate_series(1, 2 * n), lambda j_: CASE WHEN i_ = k THEN m[k][j_] / m[k][k] ELSE m[i_][j_] - m[i_][k] * m[k][j_] / m[k][k] END))"
    wide = f"list_transform(generate_series(1, len({column})), lambda i_: list_concat({column}[i_], list_transform(generate_series(1, len({column})), lambda j_: CASE WHEN i_ = j_ THEN 1.0 ELSE 0.0 END)))"
    return f"{name}_gj(k, n, m) AS (SELECT 1, len({column}), {wide} FROM {source} UNION ALL SELECT k + 1, n, {step} FROM {name}_gj WHERE k <= n), {name} AS (SELECT list_transform(m, lambda r_: r_[n + 1 : 2 * n]) AS m FROM {name}_gj WHERE k = n + 1)"


def matrix(name: str, cells: str, size: str) -> str:
    """CTE name(m): a dense square matrix from cells(a, b, v), absent ones 0."""
    return f"{name} AS (SELECT list(r ORDER BY a) AS m FROM (SELECT a, list(coalesce(v, 0.0) ORDER BY b) AS r FROM (SELECT u.i AS a, w.i AS b FROM {size} u CROSS JOIN {size} w) g LEFT JOIN {cells} c USING (a, b) GROUP BY a))"


def two_sided(z: str) -> str:
    """P(|N(0, 1)| > |z|) by the series of the error function whose terms are all positive."""
    x2 = f"(least(abs({z}), 9.0) ** 2 / 2)"  # beyond 9 the probability is under 1e-18
    series = f"list_sum(list_transform(generate_series(0, 250), lambda n_: exp(-{x2} + (2 * n_) * ln(2.0) + (n_ + 0.5) * ln({x2} + 1e-300) - lgamma(2 * n_ + 2.0) + lgamma(n_ + 1.0))))"
    return f"(1 - least(1.0, 2 / sqrt(pi()) * {series}))"


def chi2_sf(x: str, dof: str) -> str:
    """P(chi-squared > x) for whole degrees of freedom: a finite sum, from exp or from the normal tail."""
    even = f"exp(-({x}) / 2) * list_sum(list_transform(generate_series(0, ({dof}) // 2 - 1), lambda k_: exp(k_ * ln(({x}) / 2 + 1e-300) - lgamma(k_ + 1.0))))"
    odd = f"{two_sided(f'sqrt({x})')} + coalesce(list_sum(list_transform(generate_series(1, (({dof}) - 1) // 2), lambda k_: exp(-({x}) / 2 + (k_ - 0.5) * ln(({x}) / 2 + 1e-300) - lgamma(k_ + 0.5)))), 0.0)"
    return f"(CASE WHEN ({dof}) % 2 = 0 THEN {even} ELSE {odd} END)"


def equations(kind: str, transform: str = "fd", time_effects: bool = False) -> str:
    """CTE e(id, t, tidx, lev, seq, y, x): x is the list of regressors."""
    rows = {"fd": ("d", "dy", "dly", "dx"), "fod": ("fo", "sy", "sly", "sx")}[transform]
    extra = "" if not time_effects else ", list_transform((SELECT list(tidx ORDER BY tidx) FROM tm WHERE tidx >= 3), lambda q_: (CASE WHEN q_ = tidx THEN 1.0 ELSE 0.0 END) - (CASE WHEN q_ = before THEN 1.0 ELSE 0.0 END))"
    x = f"[{rows[2]}, {rows[3]}]" + extra
    body = f"SELECT id, t, tidx, FALSE AS lev, rn AS seq, {rows[1]} AS y, {f'list_concat({x})' if time_effects else x} AS x FROM {rows[0]}"
    if time_effects:
        body = body.replace("FROM d", "FROM (SELECT d.*, (SELECT max(h.tidx) FROM l h WHERE h.id = d.id AND h.tidx < d.tidx) AS before FROM d)")
    if kind == "system":
        body += " UNION ALL SELECT id, t, tidx, TRUE, rn + n_t, y, [ly, x] FROM l WHERE rn >= 3"
    return f"e AS ({body})"


def instruments(kind: str, transform: str = "fd", collapse: bool = False, max_lags: int = 999) -> str:
    """CTEs zl(id, t, lev, c, z): non-zero instruments; ix(i): their columns."""
    near = 2 if transform == "fd" else 1
    lag = f"SELECT p, o, {f'o - {near} + 1' if collapse else 'row_number() OVER (ORDER BY p, o)'} AS c FROM (SELECT unnest(generate_series({near + 1}, (SELECT max(tidx) FROM tm))) AS p) CROSS JOIN (SELECT unnest(generate_series({near}, (SELECT max(tidx) FROM tm))) AS o) WHERE o <= p - 1 AND o < {near} + {max_lags}"
    parts = ["SELECT e.id, e.t, e.lev, cells.c, h.y AS z FROM e JOIN cells ON NOT e.lev AND cells.p = e.tidx JOIN l h ON h.id = e.id AND h.tidx = e.tidx - cells.o"]
    start = "(SELECT max(c) FROM cells)"
    # regressors but the lag are exogenous
    parts.append(f"SELECT id, t, lev, {start} + k - 1, x[k] FROM (SELECT *, unnest(generate_series(2, len(x))) AS k FROM e WHERE NOT lev)")
    width = f"{start} + (SELECT max(len(x)) - 1 FROM e)"
    if kind == "system":
        own = "1" if collapse else "e.tidx - 2"
        levels = "1" if collapse else "(SELECT max(tidx) - 2 FROM tm)"
        parts.append(f"SELECT e.id, e.t, e.lev, {width} + {own}, h.dy FROM e JOIN d h ON e.lev AND h.id = e.id AND h.tidx = e.tidx - 1")
        parts.append(f"SELECT id, t, lev, {width} + {levels} + 1, x[2] FROM e WHERE lev")
    # columns without an entry are what the rank decision drops here
    return f"cells AS ({lag}), zl AS (SELECT id, t, lev, CAST(dense_rank() OVER (ORDER BY c) AS BIGINT) AS c, z FROM ({' UNION ALL '.join(parts)}) WHERE z <> 0), ix AS (SELECT DISTINCT c AS i FROM zl)"


def solved(kind: str, steps: int = 1, windmeijer: bool = True, robust: bool = True) -> str:
    """CTEs up to r: one row with b, v (vcov), j, n (observations), width, k; and u(id, t, lev, seq, y, x, f, u), fitted values and residuals."""
    column = "list_transform(generate_series(1, len(ms[1])), lambda j_: list_sum(list_transform(ms, lambda q_: q_[j_])))"
    zx = f"gi AS (SELECT id, c, {column} AS m, g FROM (SELECT zl.id, c, list(list_transform(x, lambda v_: v_ * z)) AS ms, sum(z * y) AS g FROM zl JOIN e ON e.id = zl.id AND e.t = zl.t AND e.lev = zl.lev GROUP BY 1, 2))"
    none = "list_transform(generate_series(1, (SELECT k FROM nk)), lambda j_: 0.0)"
    tot = f"nk AS (SELECT max(len(x)) AS k, count(*) AS n FROM e), tot AS (SELECT i, zy, coalesce({column}, {none}) AS zx FROM (SELECT i, coalesce(sum(g), 0.0) AS zy, list(m) FILTER (WHERE m IS NOT NULL) AS ms FROM ix LEFT JOIN gi ON gi.c = ix.i GROUP BY i)), zz AS (SELECT list(zx ORDER BY i) AS zx, list(zy ORDER BY i) AS zy FROM tot), mm AS (SELECT zx, zy, {transposed('zx')} AS xz FROM zz)"
    if kind == "difference":
        cells = "s0 AS (SELECT a.c AS a, b.c AS b, 2 * sum(a.z * b.z) AS v FROM zl a JOIN zl b ON a.id = b.id AND a.t = b.t GROUP BY 1, 2 UNION ALL SELECT a.c, b.c, -sum(a.z * b.z) FROM zl a JOIN zl b ON a.id = b.id AND abs(a.t - b.t) = 1 GROUP BY 1, 2), s AS (SELECT a, b, sum(v) / (SELECT count(DISTINCT id) FROM p) AS v FROM s0 GROUP BY 1, 2)"
    else:
        cells = "s AS (SELECT a.c AS a, b.c AS b, sum(a.z * b.z) AS v FROM zl a JOIN zl b ON a.id = b.id AND a.t = b.t AND a.lev = b.lev GROUP BY 1, 2)"

    def step(n: int, w: str) -> str:
        """gain = Z'X columns weighed, bread and b of a step whose weight is w(m)."""
        return (
            f"g{n} AS (SELECT mm.*, {w}.m AS w, {product('xz', f'{w}.m')} AS gain FROM mm, {w}), a{n} AS (SELECT {product('gain', 'xz')} AS m FROM g{n}), {inverse(f'b{n}', f'a{n}', 'm')}, "
            f"q{n} AS (SELECT g{n}.*, b{n}.m AS bread, {times(f'b{n}.m', times('gain', 'zy'))} AS b FROM g{n}, b{n})"
        )

    omega = f"gu AS (SELECT gi.id, c, gi.m, g - {dot('gi.m', 'q1.b')} AS u FROM gi, q1), o0 AS (SELECT a.c AS a, b.c AS b, sum(a.u * b.u) AS v FROM gu a JOIN gu b USING (id) GROUP BY 1, 2), {matrix('o', 'o0', 'ix')}"
    # rows of bread gain by columns of O, by rows of gain, by bread
    sandwich = product(product(product(product("bread", transposed("gain")), "o.m"), "gain"), "bread")
    sand = f"v1 AS (SELECT {sandwich} AS v FROM q1, o)"
    ctes = [zx, tot, cells, matrix("s1", "s", "ix"), inverse("w1", "s1", "m"), step(1, "w1"), omega, sand]
    if steps == 1 and not robust:
        ctes.append(f"sq AS (SELECT sum((y - {dot('e.x', 'q1.b')}) ** 2) / (count(*) - any_value(len(e.x))) AS s FROM e, q1), f AS (SELECT q1.*, list_transform(bread, lambda r_: list_transform(r_, lambda v_: v_ * s)) AS v FROM q1, sq)")
    elif steps == 1:
        ctes.append("f AS (SELECT q1.*, v1.v FROM q1, v1)")
    else:
        ctes += [inverse("w2", "o", "m"), step(2, "w2")]
        if windmeijer:
            e = f"list_transform(generate_series(1, len(zy)), lambda i_: zy[i_] - {dot('zx[i_]', 'b')})"
            ctes.append(f"cc AS (SELECT {times('w', e)} AS c FROM q2)")
            ctes.append(f"gc AS (SELECT id, uc, {column} AS mc FROM (SELECT id, sum(u * cc.c[gu.c]) AS uc, list(list_transform(m, lambda v_: v_ * cc.c[gu.c])) AS ms FROM gu, cc GROUP BY id))")
            ctes.append(f"t0 AS (SELECT i, {column} AS t FROM (SELECT gu.c AS i, list(list_transform(generate_series(1, len(m)), lambda j_: -(uc * m[j_] + u * mc[j_]))) AS ms FROM gu JOIN gc USING (id) GROUP BY 1)), tt AS (SELECT {transposed('ts')} AS tc FROM (SELECT list(coalesce(t, {none}) ORDER BY ix.i) AS ts FROM ix LEFT JOIN t0 USING (i)))")
            ctes.append(f"dd AS (SELECT list_transform({product(product('bread', transposed('gain')), 'tc')}, lambda r_: list_transform(r_, lambda v_: -v_)) AS d FROM q2, tt)")
            ctes.append(f"wm AS (SELECT q2.*, v1.v AS vr, d, {product('d', 'bread')} AS db, {product(product('d', 'v1.v'), 'd')} AS dvd FROM q2, dd, v1)")
            ctes.append("f AS (SELECT *, list_transform(generate_series(1, len(b)), lambda i_: list_transform(generate_series(1, len(b)), lambda j_: bread[i_][j_] + db[i_][j_] + db[j_][i_] + (dvd[i_][j_] + dvd[j_][i_]) / 2)) AS v FROM wm)")
        else:
            ctes.append("f AS (SELECT *, bread AS v FROM q2)")
    res = f"list_transform(generate_series(1, len(zy)), lambda i_: zy[i_] - {dot('zx[i_]', 'b')})"
    ctes.append(f"r0 AS (SELECT b, v, w, {res} AS e, len(zy) AS width FROM f), r AS (SELECT b, v, {dot('e', times('w', 'e'))} AS j, width, nk.n, nk.k FROM r0, nk)")
    fit = dot("e.x", "r.b")
    ctes.append(f"u AS (SELECT e.*, {fit} AS f, e.y - {fit} AS u FROM e, r)")
    return ", ".join(ctes)


def query(base: str, select: str, kind: str = "difference", *, transform: str = "fd", time_effects: bool = False, collapse: bool = False, max_lags: int = 999, more: str = "", **solver) -> str:
    """The whole statement: panel CTEs, the estimator, further CTEs, and what is selected from them."""
    return f"WITH RECURSIVE {base}, {equations(kind, transform, time_effects)}, {instruments(kind, transform, collapse, max_lags)}, {solved(kind, **solver)}{more} {select}"


def autocorrelation(order: int) -> str:
    """CTE ar<order>(z): the statistic of the residual autocorrelation test; the later of an id's rows of a period counts."""
    name = f"ar{order}"
    sums = f"{name}_s AS (SELECT sum(u.u * b.u) AS num, sum((u.u * b.u) ** 2) AS square, list(list_transform(generate_series(1, len(u.x)), lambda i_: -(u.x[i_] * b.u + b.x[i_] * u.u))) AS ms FROM u JOIN before b ON b.id = u.id AND b.t = u.t - {order})"
    total = f"{name}_d AS (SELECT num, square, list_transform(generate_series(1, len(ms[1])), lambda j_: list_sum(list_transform(ms, lambda q_: q_[j_]))) AS d FROM {name}_s)"
    return f"{sums}, {total}, {name} AS (SELECT num / sqrt(square + {dot('d', times('r.v', 'd'))}) AS z FROM {name}_d, r)"


#: the rows that autocorrelation() looks back to
BEFORE = "before AS (SELECT id, t, arg_max(u, seq) AS u, arg_max(x, seq) AS x FROM u GROUP BY id, t)"


def normal_quantile(p: str) -> str:
    """Quantile of the normal distribution: a rational start (relative error 1e-9) in three ranges."""
    # fixed values: the published coefficients of that approximation
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0)

    def horner(coefficients, x):
        out = f"({coefficients[0]})"
        for v in coefficients[1:]:
            out = f"({out} * {x} + ({v}))"
        return out

    tail = lambda q: f"({horner(c, q)} / {horner(d, q)})"
    q, low, high = f"(({p}) - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    square = f"({q} * {q})"
    return f"(CASE WHEN ({p}) < 0.02425 THEN {tail(low)} WHEN ({p}) > 0.97575 THEN -{tail(high)} ELSE {q} * {horner(a, square)} / {horner(b, square)} END)"


def coefficients(names: str = "['L.y', 'x']", digits: int = 4) -> str:
    """The coefficient table of r."""
    return f"SELECT name, round(estimate, {digits}) AS estimate, round(se, {digits}) AS std_error, round(estimate / se, 2) AS z, round({two_sided('estimate / se')}, 4) AS p, round(estimate - 1.959963984540054 * se, {digits}) AS lower, round(estimate + 1.959963984540054 * se, {digits}) AS upper FROM (SELECT unnest(generate_series(1, k)) AS i_, b, v, k FROM r) q, LATERAL (SELECT {names}[i_] AS name, b[i_] AS estimate, sqrt(v[i_][i_]) AS se)"
