"""SQL over the given tables that computes each registered query's rows a second way."""

from __future__ import annotations

from registered.documents import BAGS, CONFIGS, FOLDS, RATIO, REPEATS, SAMPLES, SEEDS, SHARE

# --- order scores ----------------------------------------------------------------------------------------------

STEPS = [
    (
        "preds",
        """SELECT l_orderkey AS ind_id, l_linenumber AS bag, l_linenumber % 2 AS common_seed, l_quantity,
       (l_quantity + CAST(0.123456 AS DOUBLE)) / CAST(51.7 AS DOUBLE) AS score,
       CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS holdout,
       CASE WHEN l_orderkey % 5 <> 0 AND l_orderkey % 3 = 0 AND 2 * sq > 61 * n THEN 1 ELSE 0 END AS known_pos,
       CASE WHEN l_orderkey % 5 = 0 AND 2 * sq <= 45 * n THEN 1 ELSE 0 END AS known_neg
FROM (SELECT *, SUM(l_quantity) OVER (PARTITION BY l_orderkey) AS sq,
             COUNT(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) t""",
    ),
    (
        "ent",
        """SELECT ind_id, holdout, known_pos, known_neg, AVG(score) AS score_mean
FROM preds GROUP BY ind_id, holdout, known_pos, known_neg""",
    ),
    ("s", "SELECT ind_id, known_pos AS label, score_mean AS y FROM ent WHERE holdout = 0"),
    (
        "stat",
        """SELECT label, COUNT(*) AS n, AVG(y) AS mean, MIN(y) AS low, MAX(y) AS high,
       power(1 / (4 * pi()), CAST(0.1 AS DOUBLE)) * power(243.0 / (35.0 * COUNT(*)), CAST(0.2 AS DOUBLE)) * STDDEV_SAMP(y) AS h
FROM s GROUP BY label""",
    ),
    (
        "plan",
        """SELECT label, n, mean, h, low - 4 * h AS a, (high + 4 * h - (low - 4 * h)) / 400 AS delta,
       CAST(LEAST(floor(4 * h / ((high + 4 * h - (low - 4 * h)) / 400)), 401) AS INTEGER) AS reach FROM stat""",
    ),
    (
        "pos_on_grid",
        """SELECT s.label, CAST(floor((y - a) / delta) AS INTEGER) AS li,
       (y - a) / delta - floor((y - a) / delta) AS rem FROM s JOIN plan USING (label)""",
    ),
    (
        "binned",
        """SELECT label, bin, SUM(w) AS weight FROM (
  SELECT label, li AS bin, 1 - rem AS w FROM pos_on_grid UNION ALL SELECT label, li + 1, rem FROM pos_on_grid) GROUP BY label, bin""",
    ),
    (
        "kernel",
        """SELECT label, l, exp(-0.5 * power(l * delta / h, 2)) / (SUM(exp(-0.5 * power(l * delta / h, 2))) OVER (PARTITION BY label) * delta * n) AS w
FROM (SELECT *, unnest(range(-reach, reach + 1)) AS l FROM plan)""",
    ),
    (
        "grid",
        """SELECT p.label, CAST(g.bin AS INTEGER) AS bin, p.a + g.bin * p.delta AS x, COALESCE(m.f, 0) AS f
FROM plan p CROSS JOIN (SELECT unnest(range(0, 401)) AS bin) g
LEFT JOIN (SELECT b.label, b.bin + k.l AS bin, SUM(b.weight * k.w) AS f FROM binned b JOIN kernel k USING (label) GROUP BY 1, 2) m
  ON m.label = p.label AND m.bin = g.bin""",
    ),
    (
        "dens",
        """SELECT u.ind_id, u.y, MAX(v) FILTER (WHERE plab = 1) AS f_pos, MAX(v) FILTER (WHERE plab = 0) AS f_unl FROM (
  SELECT u.ind_id, u.y, p.label AS plab,
         g0.f + (g1.f - g0.f) * LEAST(GREATEST((u.y - p.a) / p.delta - g0.bin, 0), 1) AS v
  FROM s u JOIN plan p ON u.label = 0
  JOIN grid g0 ON g0.label = p.label AND g0.bin = CAST(LEAST(GREATEST(floor((u.y - p.a) / p.delta), 0), 399) AS INTEGER)
  JOIN grid g1 ON g1.label = p.label AND g1.bin = g0.bin + 1) u GROUP BY u.ind_id, u.y""",
    ),
    (
        "ratio",
        "SELECT ROW_NUMBER() OVER (ORDER BY y, ind_id) AS rn, y, f_pos, f_unl, f_pos / f_unl AS r FROM dens",
    ),
    (
        "mono",
        """SELECT rn, y, CASE WHEN y > m THEN GREATEST(0, MAX(CASE WHEN y > m THEN r END) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING)) ELSE r END AS r
FROM ratio CROSS JOIN (SELECT mean AS m FROM plan WHERE label = 0)""",
    ),
    (
        "win",
        """SELECT n, (CASE WHEN k % 2 = 0 THEN k ELSE k - 1 END) // 2 AS w
FROM (SELECT COUNT(*) AS n, CAST(floor(COUNT(*) / CAST(20 AS DOUBLE)) AS BIGINT) AS k FROM mono)""",
    ),
    (
        "mixed",
        """SELECT rn, n, w, CASE WHEN rn > w AND rn <= n - w THEN
  median(r) OVER (ORDER BY rn ROWS BETWEEN (SELECT w FROM win) PRECEDING AND (SELECT w FROM win) FOLLOWING) ELSE r END AS r
FROM mono CROSS JOIN win""",
    ),
    (
        "ends",
        """SELECT list(r ORDER BY rn) FILTER (WHERE rn <= 2 * w) AS left_r, list(r ORDER BY rn DESC) FILTER (WHERE rn > n - 2 * w) AS right_r FROM mixed""",
    ),
    (
        "inner_smooth",
        """SELECT rn, n, CASE WHEN rn > 1 AND rn <= w THEN list_median(left_r[1:2 * rn - 1])
            WHEN rn < n AND rn > n - w THEN list_median(right_r[1:2 * (n + 1 - rn) - 1]) ELSE r END AS r
FROM mixed CROSS JOIN ends""",
    ),
    (
        "smooth",
        """SELECT rn, CASE WHEN rn = 1 THEN list_median([r, r2, 3 * r2 - 2 * r3]) WHEN rn = n THEN list_median([r, q2, 3 * q2 - 2 * q3]) ELSE r END AS r
FROM (SELECT *, LEAD(r, 1) OVER o AS r2, LEAD(r, 2) OVER o AS r3, LAG(r, 1) OVER o AS q2, LAG(r, 2) OVER o AS q3
      FROM inner_smooth WINDOW o AS (ORDER BY rn))""",
    ),
    (
        "curve0",
        """SELECT CAST(i AS INTEGER) AS i, i / CAST(999 AS DOUBLE) AS alpha, i / CAST(999 AS DOUBLE) - AVG(LEAST(i / CAST(999 AS DOUBLE) * r, 1)) AS d
FROM smooth CROSS JOIN (SELECT unnest(range(0, 1000)) AS i) GROUP BY i""",
    ),
    (
        "curve1",
        "SELECT *, LEAD(d) OVER (ORDER BY i) + LAG(d) OVER (ORDER BY i) - 2 * d AS d2 FROM curve0",
    ),
    (
        "star",
        "SELECT i AS star_i, alpha AS a_star FROM curve1 WHERE d2 IS NOT NULL ORDER BY round(d2, 12) DESC, i LIMIT 1",
    ),
    (
        "sweep",
        """SELECT CAST(t.i AS INTEGER) AS idx, t.i * CAST(0.01 AS DOUBLE) AS threshold,
       CAST(SUM(CASE WHEN y > t.i * CAST(0.01 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS n_above,
       SUM(CASE WHEN y > t.i * CAST(0.01 AS DOUBLE) THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE) AS share
FROM s CROSS JOIN (SELECT unnest(range(0, 100)) AS i) t WHERE label = 0 GROUP BY t.i""",
    ),
    (
        "pick",
        """SELECT threshold, share, hit AS matched FROM (
  SELECT *, abs(share - a_star) < CAST(0.01 AS DOUBLE) AS hit FROM sweep CROSS JOIN star)
ORDER BY hit DESC, CASE WHEN hit THEN -idx ELSE idx END LIMIT 1""",
    ),
    (
        "classed",
        "SELECT ent.*, CASE WHEN score_mean > threshold THEN 1 ELSE 0 END AS pred_class FROM ent CROSS JOIN pick",
    ),
    (
        "moments",
        """SELECT ind_id, COUNT(*) AS n, AVG(score) AS m, MIN(score) AS lo, MAX(score) AS hi, VAR_POP(score) AS v,
       AVG(ln(score)) AS la, AVG(ln(1 - score)) AS lb FROM preds GROUP BY ind_id""",
    ),
]


def with_steps(last: str, select: str, more: str = "", recursive: bool = False) -> str:
    """``select`` after the steps up to ``last``."""
    names = [name for name, _ in STEPS]
    chain = STEPS[: names.index(last) + 1]
    parts = [f"{name} AS MATERIALIZED ({sql})" for name, sql in chain]
    if more:
        parts.append(more)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}\n{select}"


def r(column: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({column}, {digits}) + CAST(0 AS DOUBLE) AS {name or column}"


def per_score(table: str, *values: str) -> str:
    cols = ", ".join(r(f"AVG({v})", 6, v) for v in values)
    return f"SELECT {r('y', 9)}, COUNT(*) AS n_rows, {cols} FROM {table} GROUP BY round(y, 9) + CAST(0 AS DOUBLE)"


def digamma(z: str) -> str:
    y = f"({z} + 12)"
    lifted = " + ".join(f"1 / ({z} + {j})" for j in range(12))
    return (
        f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * power({y}, 2)) + 1 / (120 * power({y}, 4)) - 1 / (252 * power({y}, 6))"
        f" + 1 / (240 * power({y}, 8)) - ({lifted}))"
    )


def trigamma(z: str) -> str:
    y = f"({z} + 12)"
    lifted = " + ".join(f"1 / power({z} + {j}, 2)" for j in range(12))
    return (
        f"(1 / {y} + 1 / (2 * power({y}, 2)) + 1 / (6 * power({y}, 3)) - 1 / (30 * power({y}, 5)) + 1 / (42 * power({y}, 7))"
        f" - 1 / (30 * power({y}, 9)) + {lifted})"
    )


# Newton steps for the shapes, then the hypergeometric series of the incomplete beta function
CONFIDENCE = f"""
newton AS (
  SELECT ind_id, 0 AS step, la, lb, m * (m * (1 - m) / v - 1) AS a, (1 - m) * (m * (1 - m) / v - 1) AS b
  FROM moments WHERE n > 1 AND lo < hi
  UNION ALL
  SELECT ind_id, step + 1, la, lb,
         GREATEST(a + ((tb - tc) * ga + tc * gb) / (ta * tb - tc * (ta + tb)), a / 3),
         GREATEST(b + (tc * ga + (ta - tc) * gb) / (ta * tb - tc * (ta + tb)), b / 3)
  FROM (SELECT *, la - {digamma('a')} + {digamma('(a + b)')} AS ga, lb - {digamma('b')} + {digamma('(a + b)')} AS gb,
               {trigamma('a')} AS ta, {trigamma('b')} AS tb, {trigamma('(a + b)')} AS tc
        FROM newton WHERE step < 25)),
fitted AS MATERIALIZED (
  SELECT c.ind_id, c.pred_class, threshold AS t, threshold < (a + 1) / (a + b + 2) AS near,
         CASE WHEN threshold < (a + 1) / (a + b + 2) THEN a ELSE b END AS p,
         CASE WHEN threshold < (a + 1) / (a + b + 2) THEN b ELSE a END AS q,
         CASE WHEN threshold < (a + 1) / (a + b + 2) THEN threshold ELSE 1 - threshold END AS x
  FROM newton JOIN classed c USING (ind_id) CROSS JOIN pick WHERE step = 25),
series AS (
  SELECT ind_id, p, q, x, 0 AS k, CAST(1 AS DOUBLE) AS term, CAST(1 AS DOUBLE) AS total FROM fitted
  UNION ALL
  SELECT ind_id, p, q, x, k + 1, term * (p + q + k) / (p + 1 + k) * x, total + term * (p + q + k) / (p + 1 + k) * x
  FROM series WHERE term > 1e-14 * total),
tails AS (
  SELECT f.ind_id, pred_class, near, exp(p * ln(x) + q * ln(1 - x) + lgamma(p + q) - lgamma(p) - lgamma(q)) / p * total AS part
  FROM fitted f JOIN (SELECT ind_id, MAX(total) AS total FROM series GROUP BY ind_id) USING (ind_id))"""

_HYPER = "common_seed, fold_id, config"
TUNE = """tune AS MATERIALIZED (
  SELECT common_seed, 'Fold' || (ind_id % 4 + 1) AS fold_id, known_pos, config,
         CASE config WHEN 1 THEN score WHEN 2 THEN 1 - score ELSE floor(l_quantity / 10) / CAST(5 AS DOUBLE) END AS score
  FROM preds CROSS JOIN (SELECT unnest([1, 2, 3]) AS config) WHERE holdout = 0),
ranked AS (
  SELECT *, RANK() OVER (PARTITION BY common_seed, fold_id, config ORDER BY score)
            + (COUNT(*) OVER (PARTITION BY common_seed, fold_id, config, score) - 1) / CAST(2 AS DOUBLE) AS mid FROM tune),
fold_auc AS MATERIALIZED (
  SELECT common_seed, fold_id, config,
         CASE WHEN SUM(known_pos) * SUM(1 - known_pos) = 0 THEN NULL ELSE
           (SUM(mid * known_pos) - SUM(known_pos) * (SUM(known_pos) + 1) / CAST(2 AS DOUBLE))
           / (CAST(SUM(known_pos) AS DOUBLE) * CAST(SUM(1 - known_pos) AS DOUBLE)) END AS auc
  FROM ranked GROUP BY common_seed, fold_id, config),
auc_sum AS MATERIALIZED (
  SELECT common_seed, config, CASE WHEN COUNT(auc) < COUNT(*) THEN NULL ELSE AVG(auc) END AS mean_auc,
         CASE WHEN COUNT(auc) < COUNT(*) THEN NULL ELSE MIN(auc) END AS min_auc FROM fold_auc GROUP BY common_seed, config)"""

_RECALL = """SUM(CASE WHEN {where} AND known_pos = 1 AND pred_class = 1 THEN 1 ELSE 0 END)
  / CAST(NULLIF(SUM(CASE WHEN {where} AND known_pos = 1 THEN 1 ELSE 0 END), 0) AS DOUBLE)"""
_SPECIF = """SUM(CASE WHEN holdout = 1 AND known_neg = 1 AND known_pos = 0 AND pred_class = 0 THEN 1 ELSE 0 END)
  / CAST(NULLIF(SUM(CASE WHEN holdout = 1 AND known_neg = 1 AND known_pos = 0 THEN 1 ELSE 0 END), 0) AS DOUBLE)"""
_METRICS = f"{r(_RECALL.format(where='holdout = 0'), 9, 'recall')}, {r(_SPECIF, 9, 'specif')}"
_FITTED = "CASE WHEN n > 1 AND lo < hi THEN {} END"

SCORES = {
    "auc_by_fold": with_steps("preds", f"SELECT {_HYPER}, {r('auc', 9)} FROM fold_auc", TUNE),
    "auc_summary": with_steps(
        "preds", f"SELECT common_seed, config, {r('mean_auc', 9)}, {r('min_auc', 9)} FROM auc_sum", TUNE
    ),
    "best_config": with_steps(
        "preds",
        """SELECT common_seed, config FROM auc_sum QUALIFY
  ROW_NUMBER() OVER (PARTITION BY common_seed ORDER BY round(mean_auc, 12) DESC NULLS LAST, config) = 1""",
        TUNE,
    ),
    "ensemble_mean": with_steps(
        "ent", f"SELECT ind_id, holdout, known_pos, known_neg, {r('score_mean', 9)} FROM ent WHERE holdout = 0"
    ),
    "kde_plan": with_steps(
        "plan",
        f"SELECT label, n, {r('mean', 9)}, {r('h', 9, 'bandwidth')}, {r('a', 9, 'start')}, {r('delta', 9, 'step')}, reach FROM plan",
    ),
    "kde_binned": with_steps("binned", f"SELECT label, bin, {r('weight')} FROM binned"),
    "kde_grid": with_steps("grid", f"SELECT label, bin, {r('x')}, {r('f')} FROM grid"),
    "density_at_unlabeled": with_steps("dens", per_score("dens", "f_pos", "f_unl")),
    "density_ratio_raw": with_steps("ratio", per_score("ratio", "r")),
    "ratio_monotone": with_steps("mono", per_score("mono", "r")),
    "ratio_smoothed": with_steps("smooth", f"SELECT rn, {r('r')} FROM smooth"),
    "prior_curve": with_steps(
        "star",
        f"SELECT i, {r('alpha', 9)}, {r('d')}, {r('d2')}, i = star_i AS is_star FROM curve1 CROSS JOIN star",
    ),
    "prior_estimate": with_steps("star", f"SELECT {r('a_star', 9, 'alpha')} FROM star"),
    "threshold_sweep": with_steps("sweep", f"SELECT idx, {r('threshold')}, n_above, {r('share', 9)} FROM sweep"),
    "threshold_pick": with_steps("pick", f"SELECT {r('threshold')}, {r('share', 9)}, matched FROM pick"),
    "classify": with_steps(
        "classed", f"SELECT ind_id, holdout, known_pos, known_neg, {r('score_mean', 9)}, pred_class FROM classed"
    ),
    "beta_moments": with_steps(
        "moments",
        f"""SELECT ind_id, n, {r('m', 8, 'score_mean')}, {r('lo', 8, 'score_min')}, {r('hi', 8, 'score_max')},
  {r('la', 8, 'mean_ln')}, {r('lb', 8, 'mean_ln1m')},
  {r('ln(' + _FITTED.format('m * (m * (1 - m) / v - 1)') + ')', 7, 'ln_shape1')},
  {r('ln(' + _FITTED.format('(1 - m) * (m * (1 - m) / v - 1)') + ')', 7, 'ln_shape2')} FROM moments""",
    ),
    "confidence": with_steps(
        "moments",
        f"""SELECT c.ind_id, c.pred_class, {r('a_star', 6, 'alpha')}, {r('threshold')},
  CASE WHEN m.n > 1 AND lo < hi THEN 'fitted' ELSE 'degenerate' END AS conf_status,
  {r('CASE WHEN near = (t.pred_class = 1) THEN 1 - part ELSE part END', 6, 'confidence')}
FROM classed c JOIN moments m USING (ind_id) LEFT JOIN tails t USING (ind_id) CROSS JOIN pick CROSS JOIN star""",
        CONFIDENCE,
        recursive=True,
    ),
    "recall_all": with_steps("classed", f"SELECT {r(_RECALL.format(where='TRUE'), 9, 'recall')} FROM classed"),
    "pu_metrics": with_steps("classed", f"SELECT {_METRICS} FROM classed"),
    "pu_metrics_by_group": with_steps(
        "classed", f"SELECT CAST(ind_id % 7 AS INTEGER) AS part, {_METRICS} FROM classed GROUP BY ind_id % 7"
    ),
}

# --- documents -------------------------------------------------------------------------------------------------

_SEEDS = ", ".join(str(s) for s in SEEDS)
_FOLD = f"'Fold' || ((ROW_NUMBER() OVER (PARTITION BY {{part}} ORDER BY md5(s || '|' || {{unit}}), {{unit}}) - 1) % {FOLDS} + 1)"
DOCS = f"""docs AS MATERIALIZED (
  SELECT d.doc_id AS ind_id, source, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS known_pos
  FROM documents d LEFT JOIN labels USING (doc_id) WHERE COALESCE(quality, 1) <> 0),
held AS (SELECT d.doc_id AS ind_id, quality FROM documents d JOIN labels USING (doc_id) WHERE quality = 0),
seeds AS (SELECT unnest([{_SEEDS}]) AS s),
folds AS MATERIALIZED (
  SELECT CAST(s AS INTEGER) AS common_seed, {_FOLD.format(part="s, known_pos", unit="ind_id")} AS fold_id, ind_id, known_pos
  FROM docs CROSS JOIN seeds),
bags AS (
  SELECT CAST(s AS INTEGER) AS common_seed, CAST(b AS INTEGER) AS bag, CAST(s * 1000 + b AS INTEGER) AS recipe_seed,
         CAST(ROW_NUMBER() OVER (ORDER BY s, b) AS INTEGER) AS counter
  FROM seeds CROSS JOIN (SELECT unnest(range(1, {BAGS} + 1)) AS b)),
models AS (SELECT b.*, f.fold_id FROM bags b JOIN (SELECT DISTINCT common_seed, fold_id FROM folds) f USING (common_seed)),
counts AS (SELECT common_seed, fold_id, COUNT(*) AS n_assessed FROM folds GROUP BY common_seed, fold_id)"""


def docs(select: str, more: str = "") -> str:
    return f"WITH {DOCS}{', ' + more if more else ''}\n{select}"


_SAMPLE = f"""placed AS (
  SELECT m.common_seed, m.bag, m.fold_id, f.ind_id, f.known_pos,
         ROW_NUMBER() OVER (PARTITION BY m.common_seed, m.bag, m.fold_id, f.known_pos
                            ORDER BY md5(m.recipe_seed || '|' || f.ind_id), f.ind_id) AS place
  FROM models m JOIN folds f ON f.common_seed = m.common_seed AND f.fold_id <> m.fold_id),
caps AS (
  SELECT common_seed, bag, fold_id, floor(MIN(n) * CAST({RATIO} AS DOUBLE)) AS cap FROM (
    SELECT common_seed, bag, fold_id, known_pos, COUNT(*) AS n FROM placed GROUP BY ALL) GROUP BY ALL)"""

_TUNED = f"models JOIN folds USING (common_seed, fold_id) CROSS JOIN (SELECT unnest(range(1, {CONFIGS} + 1)) AS config)"
_ASSESSED = """SELECT common_seed, bag, counter, fold_id, CAST(0 AS INTEGER) AS holdout, ind_id, CAST(known_pos AS INTEGER) AS known_pos,
  CAST(0 AS INTEGER) AS known_neg, CAST(1 AS INTEGER) AS in_range FROM models JOIN folds USING (common_seed, fold_id)"""
_HELD = """SELECT common_seed, bag, counter, fold_id, CAST(1 AS INTEGER) AS holdout, ind_id, CAST(0 AS INTEGER) AS known_pos,
  CAST(1 AS INTEGER) AS known_neg, CAST(1 AS INTEGER) AS in_range FROM models CROSS JOIN held"""
_STRATUM = "ROW_NUMBER() OVER (PARTITION BY s ORDER BY md5(s || '|{name}|' || c), c)"


def _drawn(n: int, seeds: str) -> str:
    """Numbered draws of every seed, and each row's place in its class's draw."""
    return f"""drawn AS (SELECT s, i, s * 1000 + i AS d FROM (SELECT unnest([{seeds}]) AS s) CROSS JOIN (SELECT unnest(range(1, {n} + 1)) AS i)),
ranked AS MATERIALIZED (
  SELECT s, i, d, ind_id, known_pos, COUNT(*) OVER (PARTITION BY d, known_pos) AS n,
         ROW_NUMBER() OVER (PARTITION BY d, known_pos ORDER BY md5(d || '|' || ind_id), ind_id) - 1 AS place
  FROM docs CROSS JOIN drawn)"""


_REPEATED = f"""{_drawn(REPEATS, str(SEEDS[0]))},
repeated AS (
  SELECT CAST(s AS INTEGER) AS common_seed, 'Repeat' || i || '.Fold' || f AS fold_id, ind_id, known_pos,
         CASE WHEN place % {FOLDS} + 1 = f THEN 'assessment' ELSE 'analysis' END AS part
  FROM ranked CROSS JOIN (SELECT unnest(range(1, {FOLDS} + 1)) AS f))"""
_BOOTSTRAP = f"""{_drawn(SAMPLES, _SEEDS)},
picks AS (
  SELECT d, known_pos, CAST('0x' || md5('pick|' || d || '|' || known_pos || '|' || place)[1:15] AS BIGINT) % n AS place, COUNT(*) AS times
  FROM ranked GROUP BY ALL),
sampled AS (
  SELECT CAST(s AS INTEGER) AS common_seed, 'Bootstrap' || i AS fold_id, ind_id, known_pos,
         CASE WHEN times IS NULL THEN 'assessment' ELSE 'analysis' END AS part, CAST(COALESCE(times, 1) AS INTEGER) AS times
  FROM ranked LEFT JOIN picks USING (d, known_pos, place))"""
_COPIES = f"""{_BOOTSTRAP},
copied AS (
  SELECT common_seed, bag, recipe_seed, fold_id, ind_id, known_pos, unnest(range(1, times + 1)) AS copy
  FROM sampled JOIN bags USING (common_seed) WHERE part = 'analysis'),
place AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY common_seed, bag, fold_id, known_pos ORDER BY
    md5(recipe_seed || '|' || ind_id || CASE WHEN copy > 1 THEN '|' || copy ELSE '' END), ind_id) AS place FROM copied),
cap AS (
  SELECT common_seed, bag, fold_id, floor(MIN(n) * CAST({RATIO} AS DOUBLE)) AS cap FROM (
    SELECT common_seed, bag, fold_id, known_pos, COUNT(*) AS n FROM copied GROUP BY ALL) GROUP BY ALL)"""

_PACKED = f"""size AS (
  SELECT coalesce(source, '') AS g, COUNT(*) AS n, COUNT(*) FILTER (known_pos = 0) AS n0, COUNT(*) FILTER (known_pos = 1) AS n1
  FROM docs GROUP BY ALL),
total AS (SELECT SUM(n0) AS t0, SUM(n1) AS t1 FROM size),
line AS (
  SELECT s, g, n, n0, n1, ROW_NUMBER() OVER (PARTITION BY s ORDER BY len(bin(n)) DESC, md5(s || '|' || g)) AS place
  FROM size CROSS JOIN seeds),
packed AS (
  SELECT s, CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS g, CAST(NULL AS BIGINT) AS fold,
         [CAST(0 AS HUGEINT) FOR i IN range({FOLDS})] AS l0, [CAST(0 AS HUGEINT) FOR i IN range({FOLDS})] AS l1 FROM seeds
  UNION ALL
  SELECT s, place, g, fold, [CASE WHEN f = fold THEN l0[f] + n0 ELSE l0[f] END FOR f IN range(1, {FOLDS} + 1)],
         [CASE WHEN f = fold THEN l1[f] + n1 ELSE l1[f] END FOR f IN range(1, {FOLDS} + 1)]
  FROM (
    SELECT line.*, l0, l1,
           list_sort([[t1 * t1 * l0[f] * n0 + t0 * t0 * l1[f] * n1, l0[f] + l1[f], f] FOR f IN range(1, {FOLDS} + 1)])[1][3] AS fold
    FROM packed JOIN line ON line.s = packed.s AND line.place = packed.place + 1 CROSS JOIN total))"""

DOCUMENTS = {
    "fold_assign_group_strata": docs(
        """SELECT CAST(s AS INTEGER) AS common_seed, 'Fold' || fold AS fold_id, ind_id
FROM docs JOIN packed ON packed.g = coalesce(source, '')""",
        _PACKED,
    ).replace("WITH", "WITH RECURSIVE", 1),
    "fold_assign_numeric_strata": f"""WITH sized AS (
  SELECT doc_id AS ind_id, floor((RANK() OVER (ORDER BY n_chars) - 1) * 4 / (COUNT(*) OVER ())) AS bin FROM documents)
SELECT CAST(s AS INTEGER) AS common_seed, {_FOLD.format(part="s, bin", unit="ind_id")} AS fold_id, ind_id
FROM sized CROSS JOIN (SELECT unnest([{_SEEDS}]) AS s)""",
    "encoded_features": docs(
        f"""SELECT f.common_seed, f.fold_id, f.ind_id,
  {r("(p - own_p + 20 * CAST(rest_p AS DOUBLE) / rest_n) / CAST(n - own_n + 20 AS DOUBLE)", 9, "source_rate")}
FROM named f JOIN category USING (common_seed, source) JOIN own USING (common_seed, fold_id, source) JOIN rest USING (common_seed, fold_id)""",
        """named AS (SELECT folds.*, source FROM folds JOIN docs USING (ind_id)),
category AS (SELECT common_seed, source, COUNT(*) AS n, SUM(known_pos) AS p FROM named GROUP BY ALL),
own AS (SELECT common_seed, fold_id, source, COUNT(*) AS own_n, SUM(known_pos) AS own_p FROM named GROUP BY ALL),
rest AS (
  SELECT a.common_seed, a.fold_id, COUNT(*) AS rest_n, SUM(known_pos) AS rest_p
  FROM (SELECT DISTINCT common_seed, fold_id FROM folds) a JOIN folds b ON a.common_seed = b.common_seed AND a.fold_id <> b.fold_id GROUP BY ALL)""",
    ),
    "grid_maximin": docs(
        f"""SELECT CAST(s AS INTEGER) AS common_seed, parameter, {r('value', 9)}, COUNT(*) AS n FROM (
  SELECT s, unnest([
    {{'parameter': 'min_instances', 'value': CAST(2 + floor(part * (hi - 1)) AS DOUBLE)}},
    {{'parameter': 'rate', 'value': CAST(0.5 AS DOUBLE) + part * CAST(0.5 AS DOUBLE)}},
    {{'parameter': 'info_gain', 'value': CAST(0.0001 AS DOUBLE) * exp(part * ln(CAST(1000 AS DOUBLE)))}},
    {{'parameter': 'impurity', 'value': CAST(floor(part * 2) AS DOUBLE)}}], recursive := true)
  FROM seeds CROSS JOIN (SELECT (i + CAST(0.5 AS DOUBLE)) / 6 AS part FROM range(6) t(i))
  CROSS JOIN (SELECT GREATEST(2, CAST(floor(MIN(n) * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS hi FROM (SELECT COUNT(*) AS n FROM docs GROUP BY known_pos)))
GROUP BY ALL"""
    ),
    "grid_data_bounds": docs(
        f"""SELECT CAST(s AS INTEGER) AS common_seed, CAST(c AS INTEGER) AS config,
  CAST(1 + floor(({_STRATUM.format(name='features_per_split')} - CAST(0.5 AS DOUBLE)) / 5 * 6) AS INTEGER) AS features_per_split,
  CAST(2 + floor(({_STRATUM.format(name='min_instances_per_node')} - CAST(0.5 AS DOUBLE)) / 5 * (hi - 1)) AS INTEGER) AS min_instances_per_node
FROM seeds CROSS JOIN (SELECT unnest(range(1, 6)) AS c)
CROSS JOIN (SELECT GREATEST(2, CAST(floor(MIN(n) * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS hi FROM (SELECT COUNT(*) AS n FROM docs GROUP BY known_pos))"""
    ),
    "split_repeated_rows": docs("SELECT common_seed, fold_id, ind_id, part FROM repeated", _REPEATED),
    "split_monte_carlo_rows": docs(
        f"""SELECT CAST(s AS INTEGER) AS common_seed, 'Split' || i AS fold_id, ind_id,
  CASE WHEN place < floor(n * CAST({SHARE} AS DOUBLE)) THEN 'analysis' ELSE 'assessment' END AS part FROM ranked""",
        _drawn(SAMPLES, _SEEDS),
    ),
    "bootstrap_rows": docs("SELECT common_seed, fold_id, ind_id, part, times FROM sampled", _BOOTSTRAP),
    "downsample_bootstrap": docs(
        """SELECT common_seed, bag, fold_id, ind_id, known_pos, COUNT(*) AS copies
FROM place JOIN cap USING (common_seed, bag, fold_id) WHERE place <= cap GROUP BY ALL""",
        _COPIES,
    ),
    "tune_cv_repeated": docs(
        """SELECT common_seed, CAST(1 AS INTEGER) AS bag, fold_id, CAST(1 AS INTEGER) AS config, COUNT(*) AS n_rows,
  COUNT(DISTINCT ind_id) AS n_entities, CAST(SUM(known_pos) AS BIGINT) AS n_pos, CAST(1 AS INTEGER) AS in_range
FROM repeated WHERE part = 'assessment' GROUP BY common_seed, fold_id""",
        _REPEATED,
    ),
    "fold_assign": docs(
        f"SELECT CAST(s AS INTEGER) AS common_seed, {_FOLD.format(part='s', unit='ind_id')} AS fold_id, ind_id FROM docs CROSS JOIN seeds"
    ),
    "fold_assign_stratified": docs("SELECT common_seed, fold_id, ind_id FROM folds"),
    "fold_assign_grouped": docs(
        "SELECT common_seed, fold_id, ind_id FROM docs JOIN grouped USING (source)",
        f"""grouped AS (SELECT CAST(s AS INTEGER) AS common_seed, {_FOLD.format(part='s', unit='source')} AS fold_id, source
  FROM (SELECT DISTINCT source FROM docs) CROSS JOIN seeds)""",
    ),
    "fold_sizes_analysis_assessment": docs(
        """SELECT m.common_seed, m.fold_id, CASE WHEN f.fold_id = m.fold_id THEN 'assessment' ELSE 'analysis' END AS part,
  COUNT(*) AS n_rows, CAST(SUM(known_pos) AS BIGINT) AS n_pos
FROM counts m JOIN folds f USING (common_seed) GROUP BY ALL"""
    ),
    "bag_table": docs("SELECT m.*, n_assessed FROM models m JOIN counts USING (common_seed, fold_id)"),
    "downsample_bag": docs(
        f"""SELECT ind_id, known_pos FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY known_pos ORDER BY md5('5|' || ind_id), ind_id) AS place FROM docs)
WHERE place <= (SELECT floor(MIN(n) * CAST({RATIO} AS DOUBLE)) FROM (SELECT COUNT(*) AS n FROM docs GROUP BY known_pos))"""
    ),
    "downsample_all_bags": docs(
        """SELECT common_seed, bag, fold_id, ind_id, known_pos FROM placed JOIN caps USING (common_seed, bag, fold_id)
WHERE place <= cap""",
        _SAMPLE,
    ),
    "grid_explicit": docs(
        """SELECT common_seed, CAST(c AS INTEGER) AS config, CAST(c * 10 AS INTEGER) AS num_trees, fold_id, n_assessed
FROM counts CROSS JOIN (SELECT unnest(range(1, 4)) AS c)"""
    ),
    "grid_latin_hypercube": docs(
        f"""SELECT CAST(s AS INTEGER) AS common_seed, CAST(c AS INTEGER) AS config,
  CAST(1 + floor(({_STRATUM.format(name='min_instances')} - CAST(0.5 AS DOUBLE)) / 5 * hi) AS INTEGER) AS min_instances,
  {r(f"CAST(0.5 AS DOUBLE) + ({_STRATUM.format(name='subsampling_rate')} - CAST(0.5 AS DOUBLE)) / 5 * CAST(0.5 AS DOUBLE)", 9, "subsampling_rate")}
FROM seeds CROSS JOIN (SELECT unnest(range(1, 6)) AS c)
CROSS JOIN (SELECT GREATEST(2, MIN(n) // 10) AS hi FROM (SELECT COUNT(*) AS n FROM docs GROUP BY known_pos))"""
    ),
    "split_rows": docs(
        f"""SELECT ind_id, known_pos, CASE WHEN fold_id = 'Fold2' THEN 'assessment' ELSE 'analysis' END AS part
FROM folds WHERE common_seed = {SEEDS[0]}"""
    ),
    "tune_cv_scores": docs(
        f"""SELECT common_seed, bag, counter, fold_id, CAST(config AS INTEGER) AS config, ind_id, known_pos, CAST(1 AS INTEGER) AS in_range
FROM {_TUNED}"""
    ),
    "tune_cv_coverage": docs(
        f"""SELECT common_seed, bag, fold_id, CAST(config AS INTEGER) AS config, COUNT(*) AS n_rows,
  COUNT(DISTINCT ind_id) AS n_entities, CAST(SUM(known_pos) AS BIGINT) AS n_pos, CAST(1 AS INTEGER) AS in_range
FROM {_TUNED} GROUP BY common_seed, bag, fold_id, config"""
    ),
    "train_predict_assess": docs(_ASSESSED),
    "train_predict_holdout": docs(f"{_ASSESSED} UNION ALL {_HELD}"),
    "train_predict_coverage": docs(
        f"""SELECT common_seed, bag, fold_id, holdout, COUNT(*) AS n_rows, COUNT(DISTINCT ind_id) AS n_entities,
  CAST(SUM(known_pos) AS BIGINT) AS n_pos, CAST(1 AS INTEGER) AS in_range
FROM ({_ASSESSED} UNION ALL {_HELD}) GROUP BY common_seed, bag, fold_id, holdout"""
    ),
    "documents_classified": docs(
        """SELECT ind_id, CAST(holdout AS INTEGER) AS holdout, CAST(known_pos AS INTEGER) AS known_pos, CAST(holdout AS INTEGER) AS known_neg,
  CAST(1 AS INTEGER) AS mean_ok, CAST(1 AS INTEGER) AS class_ok, CAST(1 AS INTEGER) AS confidence_ok, CAST(1 AS INTEGER) AS alpha_ok
FROM (SELECT ind_id, known_pos, 0 AS holdout FROM docs UNION ALL SELECT ind_id, 0, 1 FROM held)"""
    ),
}

BLOCKS = {f"{name}_blocks": SCORES[name] for name in ("auc_by_fold", "ratio_monotone", "ratio_smoothed")}

SQL = {**DOCUMENTS, **SCORES, **BLOCKS}
