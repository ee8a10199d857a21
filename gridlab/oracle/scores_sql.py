"""Oracle SQL for the scoring half (sweeps, blends, splits, selection)."""
from __future__ import annotations

from itertools import combinations

from .features_sql import r6

N = 8


# the grids and weights, written out as start + i * step (IEEE arithmetic); the
# oracle shares no definition with the engine
def _steps(start: float, step: float, n: int) -> list[float]:
    return [start + i * step for i in range(n)]


GRID81 = _steps(0.10, (0.10 + 0.01) - 0.10, 81)
PUBLIC = _steps(0.45, (0.45 + 0.02) - 0.45, 21)
FOCUS = [t for t in PUBLIC if 0.55 <= t <= 0.81]
PAIRS = _steps(0.1, (0.1 + 0.1) - 0.1, 9)
_THIRDS = _steps(0.2, (0.2 + 0.2) - 0.2, 3)
TRIPLES = [(a, b, 1.0 - a - b) for a in _THIRDS for b in _THIRDS if 1.0 - a - b > 0]


def dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


PREDS = f"""
preds AS (SELECT 'm' || CAST(m AS VARCHAR) AS candidate, CAST(m AS INTEGER) AS build_order,
                 CASE WHEN l.quality IS NULL THEN 'test' ELSE 'oof' END AS split,
                 d.doc_id AS row_id, CAST(l.quality AS INTEGER) AS y, d.source AS grp,
                 CAST((d.doc_id * (37 + 2 * m)) % 101 AS DOUBLE) / 101.0e0 AS p
          FROM documents d LEFT JOIN labels l USING (doc_id)
          CROSS JOIN (SELECT unnest(generate_series(0, {N - 1})) AS m) ms),
oof AS (SELECT * FROM preds WHERE split = 'oof')"""


def grid_cte(name: str, grid) -> str:
    vals = ", ".join(f"({i}, {dbl(t)})" for i, t in enumerate(grid))
    return f"{name} AS (SELECT * FROM (VALUES {vals}) g(i, t))"


def sweep_cte(name: str, src: str, grid: str, keys: str = "candidate") -> str:
    return f"""
{name}_c AS (SELECT {keys}, g.i, g.t,
        count(*) FILTER (WHERE y = 1 AND p >= g.t) AS tp, count(*) FILTER (WHERE y = 0 AND p >= g.t) AS fp,
        count(*) FILTER (WHERE y = 1 AND p < g.t) AS fn
        FROM {src} CROSS JOIN {grid} g GROUP BY {keys}, g.i, g.t),
{name} AS (SELECT {keys}, i, t, tp, fp, fn,
        CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0e0 * tp / (2.0e0 * tp + fp + fn) ELSE 0.0e0 END AS f1 FROM {name}_c)"""


def best_cte(name: str, sweep: str, keys: str = "candidate") -> str:
    return f"""
{name} AS (SELECT {keys}, t AS threshold, f1 AS oof_f1 FROM (SELECT *, row_number() OVER
        (PARTITION BY {keys} ORDER BY f1 DESC, i) AS rk FROM {sweep}) WHERE rk = 1)"""


def base_ctes() -> list[str]:
    return [PREDS, grid_cte("g81", GRID81), sweep_cte("sw", "oof", "g81"), best_cte("best", "sw"),
            "ranked AS (SELECT b.*, p.build_order, row_number() OVER (ORDER BY b.oof_f1 DESC, p.build_order) AS rk "
            "FROM best b JOIN (SELECT DISTINCT candidate, build_order FROM preds) p USING (candidate))"]


def W(*ctes) -> str:
    return "WITH " + ",\n".join(ctes)


def threshold_sweep_sql():
    return W(*base_ctes()) + f"""
SELECT candidate, CAST(i AS INTEGER) AS i, {r6('t')} AS threshold, CAST(tp AS BIGINT) AS tp,
       CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {r6('f1')} AS f1 FROM sw"""


def best_threshold_sql():
    return W(*base_ctes()) + f"\nSELECT candidate, {r6('threshold')} AS threshold, {r6('oof_f1')} AS oof_f1 FROM best"


def eval_ctes():
    g = PUBLIC
    f = FOCUS
    fi = [i for i, t in enumerate(g) if t in set(f)]
    return [*base_ctes(), grid_cte("g21", g), sweep_cte("sw21", "oof", "g21"),
            best_cte("b21", "sw21"), best_cte("fb21", f"(SELECT * FROM sw21 WHERE i IN ({', '.join(map(str, fi))}))"),
            f"fa21 AS (SELECT candidate, avg(f1) AS focus_mean_oof_f1, min(f1) AS focus_min_oof_f1 FROM sw21 "
            f"WHERE i IN ({', '.join(map(str, fi))}) GROUP BY candidate)",
            """ev AS (SELECT b.candidate, b.threshold AS best_threshold, b.oof_f1 AS best_oof_f1,
                fb.threshold AS focus_best_threshold, fb.oof_f1 AS focus_best_oof_f1,
                fa.focus_mean_oof_f1, fa.focus_min_oof_f1, p.build_order
         FROM b21 b JOIN fb21 fb USING (candidate) JOIN fa21 fa USING (candidate)
         JOIN (SELECT DISTINCT candidate, build_order FROM preds) p USING (candidate)),
evr AS (SELECT *, CAST(row_number() OVER (ORDER BY focus_best_oof_f1 DESC, focus_mean_oof_f1 DESC,
                 best_oof_f1 DESC, build_order) AS INTEGER) AS rank FROM ev)"""]


def candidate_eval_sql():
    cols = ["best_threshold", "best_oof_f1", "focus_best_threshold", "focus_best_oof_f1",
            "focus_mean_oof_f1", "focus_min_oof_f1"]
    return W(*eval_ctes()) + "\nSELECT candidate, " + ", ".join(f"{r6(c)} AS {c}" for c in cols) + \
        ", build_order, rank FROM evr"


def recommendations_sql():
    return W(*eval_ctes()) + f"""
SELECT e.candidate, {r6('g.t')} AS threshold FROM evr e CROSS JOIN g21 g
WHERE abs(g.t - e.focus_best_threshold) <= {dbl(0.04 + 1e-9)}"""


def confusion_sql():
    return W(PREDS) + """
SELECT candidate, y AS actual, CAST(p >= 0.5e0 AS INTEGER) AS predicted, count(*) AS n
FROM oof GROUP BY candidate, y, CAST(p >= 0.5e0 AS INTEGER)"""


def class_report_sql():
    def prf(tp, fp, fn):
        prec = f"(CASE WHEN ({tp} + {fp}) > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0e0 END)"
        rec = f"(CASE WHEN ({tp} + {fn}) > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0e0 END)"
        f1 = f"(CASE WHEN ({prec} + {rec}) > 0 THEN 2 * {prec} * {rec} / ({prec} + {rec}) ELSE 0.0e0 END)"
        return prec, rec, f1
    p1, r1, f1 = prf("tp", "fp", "fn")
    p0, r0, f0 = prf("tn", "fn", "fp")
    s1, s0, n = "(tp + fn)", "(tn + fp)", "(tp + fn + tn + fp)"
    rows = [("'0'", p0, r0, f0, s0), ("'1'", p1, r1, f1, s1),
            ("'accuracy'", "NULL", "NULL", f"(tp + tn) / {n}", n),
            ("'macro avg'", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", n),
            ("'weighted avg'", f"({p0} * {s0} + {p1} * {s1}) / {n}", f"({r0} * {s0} + {r1} * {s1}) / {n}",
             f"({f0} * {s0} + {f1} * {s1}) / {n}", n)]
    sel = " UNION ALL ".join(
        f"SELECT candidate, {lab} AS label, {r6(pr)} AS precision, {r6(rc)} AS recall, {r6(f)} AS f1, "
        f"{r6(s)} AS support FROM cm" for lab, pr, rc, f, s in rows)
    return W(PREDS, """cm AS (SELECT candidate,
        CAST(count(*) FILTER (WHERE y = 1 AND p >= 0.5e0) AS DOUBLE) AS tp,
        CAST(count(*) FILTER (WHERE y = 0 AND p >= 0.5e0) AS DOUBLE) AS fp,
        CAST(count(*) FILTER (WHERE y = 1 AND p < 0.5e0) AS DOUBLE) AS fn,
        CAST(count(*) FILTER (WHERE y = 0 AND p < 0.5e0) AS DOUBLE) AS tn FROM oof GROUP BY candidate)""") + "\n" + sel


def wide_cte(src: str = "preds", keys: str = "split, row_id, y") -> str:
    cols = ", ".join(f"max(p) FILTER (WHERE candidate = 'm{m}') AS m{m}" for m in range(N))
    return f"wide AS (SELECT {keys}, {cols} FROM {src} GROUP BY {keys})"


def candidate_corr_sql():
    names = [f"m{m}" for m in range(N)]
    sel = []
    for a, b in combinations(names, 2):
        const = " OR ".join(f"(max({x}) - min({x}) <= 1e-8 + 1e-5 * abs(min({x})))" for x in (a, b))
        den = f"(stddev_pop({a}) * stddev_pop({b}))"
        e = f"CASE WHEN {const} THEN 1.0e0 WHEN {den} > 0 THEN covar_pop({a}, {b}) / {den} ELSE 1.0e0 END"
        sel.append(f"SELECT '{a}' AS cand_a, '{b}' AS cand_b, {r6(e)} AS corr FROM wide")
    return W(PREDS, wide_cte("oof")) + "\n" + " UNION ALL ".join(sel)


def rank_normalize_sql():
    return W(PREDS) + f"""
SELECT candidate, split, row_id, {r6('CAST(row_number() OVER (PARTITION BY candidate, split ORDER BY p, row_id) AS DOUBLE) / count(*) OVER (PARTITION BY candidate, split)')} AS p
FROM preds"""


def _members_sql(k: int) -> str:
    return f"mem AS (SELECT candidate, rk FROM ranked WHERE rk <= {k})"


def _blend_tables(k: int, rank: bool):
    """(blend name, build_order, member ranks, weights) literal rows."""
    rows = []
    order = 0
    ranks = list(range(1, k + 1))
    for a, b in combinations(ranks, 2):
        ws = [(0.5, 0.5)] if rank else [(w, 1.0 - w) for w in PAIRS]
        for wa, wb in ws:
            rows.append((order, [a, b], [wa, wb]))
            order += 1
    if k >= 3:
        for a, b, c in combinations(ranks, 3):
            ws = [(1 / 3, 1 / 3, 1 / 3)] if rank else TRIPLES
            for w in ws:
                rows.append((order, [a, b, c], list(w)))
                order += 1
    return rows


def blends_sql(k: int, rank: bool):
    specs = _blend_tables(k, rank)
    src = "rn" if rank else "preds"
    parts = []
    for order, ranks, ws in specs:
        names = [f"(SELECT candidate FROM mem WHERE rk = {r})" for r in ranks]
        if rank:
            name = "'rank_' || " + " || '__' || ".join(names)
            val = "(" + " + ".join(f"v{r}" for r in ranks) + f") / {float(len(ranks))!r}e0"
        else:
            name = "'weighted_' || " + " || '__' || ".join(f"{n} || '_{w:.1f}'" for n, w in zip(names, ws))
            val = " + ".join(f"{dbl(w)} * v{r}" for r, w in zip(ranks, ws))
        parts.append(f"SELECT {name} AS candidate, {order} AS build_order, split, row_id, y, {val} AS p FROM wv")
    vcols = ", ".join(f"max(x.p) FILTER (WHERE m.rk = {r}) AS v{r}" for r in range(1, k + 1))
    ctes = [*base_ctes(), _members_sql(k)]
    if rank:
        ctes.append("rn AS (SELECT candidate, split, row_id, y, CAST(row_number() OVER (PARTITION BY candidate, split "
                    "ORDER BY p, row_id) AS DOUBLE) / count(*) OVER (PARTITION BY candidate, split) AS p FROM preds)")
    ctes += [f"wv AS (SELECT x.split, x.row_id, x.y, {vcols} FROM {src} x JOIN mem m USING (candidate) "
             f"GROUP BY x.split, x.row_id, x.y)",
             "bl AS (" + " UNION ALL ".join(parts) + ")",
             sweep_cte("bsw", "(SELECT * FROM bl WHERE split = 'oof')", "g81", "candidate, build_order"),
             best_cte("bbest", "bsw", "candidate, build_order")]
    return W(*ctes) + f"""
SELECT candidate, CAST(build_order AS INTEGER) AS build_order, {r6('threshold')} AS threshold, {r6('oof_f1')} AS oof_f1,
       kind, row_number() OVER (PARTITION BY kind ORDER BY oof_f1 DESC, build_order) = 1 AS is_best
FROM (SELECT *, CASE WHEN len(string_split(candidate, '__')) = 2 THEN 'pair' ELSE 'triplet' END AS kind FROM bbest)"""


def fold_average_sql():
    return W(f"""fp AS (SELECT 'm' || CAST(m AS VARCHAR) AS candidate, d.doc_id AS row_id, f, b,
        CAST((d.doc_id * (37 + 2 * m) + 7 * f + 3 * b) % 101 AS DOUBLE) / 101.0e0 AS p
        FROM documents d LEFT JOIN labels l USING (doc_id)
        CROSS JOIN (SELECT unnest(generate_series(0, {N - 1})) AS m) ms
        CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS f) fs
        CROSS JOIN (SELECT unnest(generate_series(0, 1)) AS b) bs WHERE l.quality IS NULL)""") + f"""
SELECT candidate, row_id, {r6('avg(p)')} AS p FROM (SELECT candidate, row_id, f, avg(p) AS p FROM fp
GROUP BY candidate, row_id, f) GROUP BY candidate, row_id"""


def meta_features_sql():
    return W(PREDS, wide_cte("oof", "row_id, y, grp")) + "\nSELECT row_id, y, grp, " + \
        ", ".join(f"{r6(f'm{m}')} AS m{m}" for m in range(N)) + " FROM wide"


def mean_ens_cte(name: str, k: int, label: str | None = None) -> str:
    return (f"{name} AS (SELECT split, row_id, y, avg(p) AS p, '{label or name}' AS candidate FROM preds "
            f"WHERE candidate IN (SELECT candidate FROM ranked WHERE rk <= {k}) GROUP BY split, row_id, y)")


def mean_ensembles_sql():
    return W(*base_ctes(), mean_ens_cte("mean_top2", 2), mean_ens_cte("mean_top3", 3)) + f"""
SELECT split, row_id, y, {r6('p')} AS p, candidate FROM mean_top2 UNION ALL
SELECT split, row_id, y, {r6('p')} AS p, candidate FROM mean_top3"""


def prior_shift_sql():
    def adj(b, t, s):
        num = f"({b} * ({t} / {s}))"
        return (f"greatest(least({num} / ({num} + (1.0e0 - {b}) * ((1.0e0 - {t}) / (1.0e0 - {s}))), "
                f"1.0e0 - 1e-6), 1e-6)")
    return "WITH RECURSIVE " + ",\n".join([PREDS, """
src AS (SELECT greatest(least(avg(CAST(quality AS DOUBLE)), 1.0e0 - 1e-4), 1e-4) AS s FROM labels
        JOIN documents USING (doc_id)),
tb AS (SELECT candidate, row_id, greatest(least(p, 1.0e0 - 1e-6), 1e-6) AS b FROM preds WHERE split = 'test')""",
        f"""it(candidate, k, t) AS (SELECT DISTINCT candidate, 0, (SELECT s FROM src) FROM tb
   UNION ALL SELECT it.candidate, it.k + 1, greatest(least(u.u, 1.0e0 - 1e-4), 1e-4)
   FROM it, LATERAL (SELECT avg({adj('b', 'it.t', '(SELECT s FROM src)')}) AS u FROM tb
                     WHERE tb.candidate = it.candidate) u
   WHERE it.k < 99 AND abs(u.u - it.t) > 1e-6)""",
        "lt AS (SELECT candidate, arg_max(t, k) AS t FROM it GROUP BY candidate)"]) + f"""
SELECT candidate, row_id, {r6(adj('b', 'lt.t', '(SELECT s FROM src)'))} AS p FROM tb JOIN lt USING (candidate)"""


def score_transforms_sql():
    c = "greatest(least(p, 1.0e0 - 1e-6), 1e-6)"
    odds = f"ln({c} / (1.0e0 - {c}))"
    return W(PREDS) + f"""
SELECT candidate, row_id, {r6(odds)} AS log_odds, {r6(f'1.0e0 / (1.0e0 + exp(-{odds}))')} AS back, {r6(f'ln({c})')} AS log_p,
       {r6(f'-ln(1.0e0 - {c})')} AS neg_log_q FROM preds"""


def selection_ctes():
    return [*base_ctes(), mean_ens_cte("comb", 2, "mean_top2"),
            sweep_cte("csw", "(SELECT * FROM comb WHERE split = 'oof')", "g81"), best_cte("cbest", "csw"),
            """fam AS (SELECT *, CASE WHEN build_order < 4 THEN 'b' ELSE 'n' END AS fam,
                  row_number() OVER (PARTITION BY CASE WHEN build_order < 4 THEN 'b' ELSE 'n' END
                                     ORDER BY oof_f1 DESC, build_order) AS frk FROM ranked),
sel AS (SELECT CASE WHEN c.oof_f1 > greatest(b.oof_f1, n.oof_f1) THEN 'combined_stack'
                    WHEN n.oof_f1 > b.oof_f1 THEN 'neural' ELSE 'baseline' END AS source,
               CASE WHEN c.oof_f1 > greatest(b.oof_f1, n.oof_f1) THEN c.candidate
                    WHEN n.oof_f1 > b.oof_f1 THEN n.candidate ELSE b.candidate END AS best_model_name,
               CASE WHEN c.oof_f1 > greatest(b.oof_f1, n.oof_f1) THEN c.oof_f1
                    WHEN n.oof_f1 > b.oof_f1 THEN n.oof_f1 ELSE b.oof_f1 END AS best_oof_f1,
               CASE WHEN c.oof_f1 > greatest(b.oof_f1, n.oof_f1) THEN c.threshold
                    WHEN n.oof_f1 > b.oof_f1 THEN n.threshold ELSE b.threshold END AS best_threshold
        FROM (SELECT * FROM fam WHERE fam = 'b' AND frk = 1) b, (SELECT * FROM fam WHERE fam = 'n' AND frk = 1) n,
             cbest c)""",
            """chosen AS (SELECT CAST(t.row_id AS VARCHAR) AS "ID", t.p, s.best_threshold FROM sel s JOIN
              (SELECT candidate, split, row_id, p FROM preds UNION ALL SELECT candidate, split, row_id, p FROM comb) t
              ON t.candidate = s.best_model_name WHERE t.split = 'test')"""]


def final_selection_sql():
    return W(*selection_ctes()) + f"""
SELECT source, best_model_name, {r6('best_oof_f1')} AS best_oof_f1, {r6('best_threshold')} AS best_threshold FROM sel"""


def submission_sql():
    return W(*selection_ctes()) + '\nSELECT "ID", CAST(p >= best_threshold AS INTEGER) AS "Target" FROM chosen'


def threshold_fanout_sql():
    pub = PUBLIC
    return W(*selection_ctes(), grid_cte("gpub", pub), """
lg AS (SELECT 'local' AS grid, lo + i * 0.02e0 AS t FROM (SELECT lo, unnest(generate_series(0,
        CAST(ceil((hi + 0.02e0 - lo) / 0.02e0) AS BIGINT) - 1)) AS i
       FROM (SELECT greatest(0.05e0, best_threshold - 0.12e0) AS lo, least(0.95e0, best_threshold + 0.12e0) AS hi
             FROM sel))),
grids AS (SELECT grid, t FROM lg UNION ALL SELECT 'public', t FROM gpub)""") + f"""
SELECT g.grid, printf('%.2f', g.t) AS label, {r6('g.t')} AS threshold, c."ID",
       CAST(c.p >= g.t AS INTEGER) AS "Target" FROM chosen c CROSS JOIN grids g"""


def rows_cte():
    return """rows AS (SELECT d.doc_id AS row_id, CAST(l.quality AS INTEGER) AS y, d.source AS grp
                 FROM documents d JOIN labels l USING (doc_id))"""


def spatial_blocks_sql():
    return """SELECT 'C' || CAST(c_custkey AS VARCHAR) AS "ID",
       CAST(CAST(floor((c_acctbal / 1000.0e0) / 0.5e0) AS BIGINT) AS VARCHAR) || '_' ||
       CAST(CAST(floor(((c_custkey % 97) / 10.0e0) / 0.5e0) AS BIGINT) AS VARCHAR) AS spatial_group FROM customer"""


def group_folds_sql():
    return W(rows_cte(), """g AS (SELECT grp, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg,
        ('0x' || substr(md5('42:' || grp), 1, 15))::BIGINT AS h FROM rows GROUP BY grp),
r AS (SELECT *, (row_number() OVER (ORDER BY pos DESC, neg DESC, h, grp) - 1) % 10 AS q FROM g)""") + """
SELECT grp, pos, neg, CAST(CASE WHEN q < 5 THEN q ELSE 9 - q END AS INTEGER) AS fold FROM r"""


def stratified_split_sql():
    return W(rows_cte()) + """
SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY ('0x' || substr(md5('42:' || CAST(row_id AS VARCHAR)), 1, 15))::BIGINT, row_id)
       <= ceil(count(*) OVER (PARTITION BY y) * 0.3e0) AS is_valid FROM rows"""


def class_weights_sql():
    return W(rows_cte(), "c AS (SELECT y, count(*) AS nc FROM rows GROUP BY y)") + f"""
SELECT r.y, r.row_id, {r6('CAST((SELECT sum(nc) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * c.nc)')} AS weight
FROM rows r JOIN c USING (y)"""


SQL = {
    "threshold_sweep": threshold_sweep_sql,
    "best_threshold": best_threshold_sql,
    "candidate_eval": candidate_eval_sql,
    "recommendations": recommendations_sql,
    "confusion": confusion_sql,
    "class_report": class_report_sql,
    "candidate_corr": candidate_corr_sql,
    "rank_normalize": rank_normalize_sql,
    "weighted_blends": lambda: blends_sql(4, False),
    "rank_blends": lambda: blends_sql(5, True),
    "fold_average": fold_average_sql,
    "meta_features": meta_features_sql,
    "mean_ensembles": mean_ensembles_sql,
    "prior_shift": prior_shift_sql,
    "score_transforms": score_transforms_sql,
    "final_selection": final_selection_sql,
    "submission": submission_sql,
    "threshold_fanout": threshold_fanout_sql,
    "spatial_blocks": spatial_blocks_sql,
    "group_folds": group_folds_sql,
    "stratified_split": stratified_split_sql,
    "class_weights": class_weights_sql,
}
