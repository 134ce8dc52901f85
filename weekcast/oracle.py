"""SQL twins of ``weekcast.queries`` for an independent engine (DuckDB), over the driver's views
``lineitem`` and ``supplier``. Written from the operator definitions, not generated from Spark plans:
each CTE chain states the semantics directly (window frames, filters between window steps, split
arithmetic), so a disagreement points at one side's bug.
"""

from __future__ import annotations

from weekcast.constants import CV_FIXED_MODULUS, CV_FOLDS, N_LAGS, SEASON, SPLIT_PCT
from weekcast.hygiene import sql_round


#: the dates of the features_between queries
BETWEEN = ("1998-06-01", "1999-05-31")


def _gap(h: int) -> int:
    """Purge gap: the oldest lag plus the lead."""
    return (h + N_LAGS - 1) + h


def _suffix(k: int) -> str:
    return f"{k}week" if k == 1 else f"{k}weeks"


def _r(*names: str) -> str:
    return ", ".join(sql_round(n) for n in names)


BASE = """
li AS (
  SELECT l_suppkey AS store, l_partkey AS dept, l_returnflag AS flag,
         CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         CAST(l_extendedprice AS DECIMAL(28,6)) AS price, l_discount, l_tax
  FROM lineitem),
sales AS (
  SELECT store, dept, flag, date, price AS weekly_sales FROM li),
features AS (
  SELECT store, date, flag, AVG(l_discount) AS temp, AVG(l_tax) AS cpi
  FROM li GROUP BY store, date, flag),
stores AS (
  SELECT s_suppkey AS store, s_nationkey AS nation, s_acctbal AS acctbal FROM supplier),
merged AS (
  SELECT s.store, s.dept, s.flag, s.date, s.weekly_sales, f.temp, f.cpi
  FROM sales s LEFT JOIN features f ON s.store = f.store AND s.date = f.date AND s.flag = f.flag),
merged_dim AS (
  SELECT m.*, st.nation, st.acctbal FROM merged m LEFT JOIN stores st ON m.store = st.store),
panel AS (
  SELECT date, CAST(ROUND(SUM(weekly_sales)) AS DOUBLE) AS total_sales,
         AVG(temp) AS temp, AVG(cpi) AS cpi,
         AVG(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS is_holiday,
         CAST(month(date) AS INTEGER) AS month, CAST(dayofmonth(date) AS INTEGER) AS day
  FROM merged GROUP BY date),
panel_s AS (
  SELECT store, date, CAST(ROUND(SUM(weekly_sales)) AS DOUBLE) AS total_sales,
         AVG(temp) AS temp, AVG(cpi) AS cpi,
         AVG(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS is_holiday,
         CAST(month(date) AS INTEGER) AS month, CAST(dayofmonth(date) AS INTEGER) AS day
  FROM merged GROUP BY store, date),
panel_k AS (
  SELECT nation, date, CAST(ROUND(SUM(weekly_sales)) AS DOUBLE) AS total_sales,
         AVG(temp) AS temp, AVG(cpi) AS cpi,
         AVG(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS is_holiday,
         CAST(month(date) AS INTEGER) AS month, CAST(dayofmonth(date) AS INTEGER) AS day
  FROM merged_dim GROUP BY nation, date)"""


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([BASE.strip(), *ctes]) + "\n"


def _feature_ctes(tag: str, h: int, reference: bool, src: str = "panel", keys: tuple[str, ...] = ()) -> list[str]:
    """The five window steps with their filters in between; final CTE ``{tag}_f``."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    w = f"({part}ORDER BY date)"
    ks = list(range(h, h + N_LAGS))
    base = f"lag_{_suffix(h)}"
    oldest, widest = f"lag_{_suffix(h + N_LAGS - 1)}", f"std_{_suffix(h + N_LAGS - 1)}"
    frame = lambda k: f"({part}ORDER BY date ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"
    stats = [f"AVG({base}) OVER {frame(k)} AS ma_{_suffix(k)}" for k in ks] + [
        f"STDDEV_SAMP({base}) OVER {frame(k)} AS std_{_suffix(k)}" for k in ks]
    if reference:
        s1 = (f"SELECT *, lag_1year AS level FROM (SELECT *, LAG(total_sales, {SEASON}, 0) OVER {w} AS lag_1year "
              f"FROM {src})")
        s2 = f"SELECT *, ABS(total_sales - lag_1year) AS diff_sales FROM {tag}_1 WHERE lag_1year > 0"
        lags = ", ".join(f"LAG(diff_sales, {k}, 0) OVER {w} AS lag_{_suffix(k)}" for k in ks)
        s4_where = f"{oldest} > 0"
        s5_where = f"{widest} > 0"
        label = f"LEAD(diff_sales, {h}, 0) OVER {w} AS label"
    else:
        s1 = (f"SELECT *, LAG(total_sales, {SEASON}) OVER {w} AS lag_1year, ROW_NUMBER() OVER {w} AS _ix, "
              f"LAG(total_sales, {SEASON - h}) OVER {w} AS level FROM {src}")
        s2 = f"SELECT *, total_sales - lag_1year AS diff_sales FROM {tag}_1 WHERE _ix > {SEASON}"
        lags = ", ".join(f"LAG(diff_sales, {k}) OVER {w} AS lag_{_suffix(k)}" for k in ks)
        s4_where = f"_ix > {SEASON + h + N_LAGS - 1}"
        s5_where = f"{widest} IS NOT NULL"
        label = f"LEAD(diff_sales, {h}) OVER {w} AS label"
    cols = [*keys, "date", "temp", "cpi", "is_holiday", "month", "day", "label", "diff_sales",
            *[f"lag_{_suffix(k)}" for k in ks], *[f"ma_{_suffix(k)}" for k in ks],
            *[f"std_{_suffix(k)}" for k in ks], "level"]
    nn = [c for c in cols if not (c == "label" and not reference)]
    not_null = " AND ".join(f"{c} IS NOT NULL" for c in nn)
    return [
        f"{tag}_1 AS ({s1})",
        f"{tag}_2 AS ({s2})",
        f"{tag}_3 AS (SELECT *, {lags} FROM {tag}_2)",
        f"{tag}_4 AS (SELECT *, {', '.join(stats)} FROM {tag}_3 WHERE {s4_where})",
        f"{tag}_5 AS (SELECT *, {label} FROM {tag}_4 WHERE {s5_where})",
        f"{tag}_f AS (SELECT {', '.join(cols)} FROM {tag}_5 WHERE {not_null})",
    ]


def _feature_select(h: int, keys: tuple[str, ...] = (), level: bool = False) -> str:
    ks = list(range(h, h + N_LAGS))
    names = ["label", "diff_sales", *[f"lag_{_suffix(k)}" for k in ks], *[f"ma_{_suffix(k)}" for k in ks],
             *[f"std_{_suffix(k)}" for k in ks]] + (["level"] if level else [])
    return ", ".join([*keys, "date", sql_round("temp"), sql_round("cpi"), sql_round("is_holiday"), "month", "day",
                      _r(*names)])


PANEL_OF = {(): "panel", ("nation",): "panel_k", ("store",): "panel_s"}


def features_sql(h: int, reference: bool = True, keys: tuple[str, ...] = (), level: bool = False) -> str:
    src = PANEL_OF[tuple(keys)]
    return _with(*_feature_ctes("fx", h, reference, src, keys)) + f"SELECT {_feature_select(h, keys, level)} FROM fx_f"


def _split_ctes(tag: str, src: str, gap: int, exact: bool, keys: tuple[str, ...] = ()) -> list[str]:
    cut = (f"CAST(CEIL(n_rows * {SPLIT_PCT}) AS BIGINT)" if exact
           else f"CAST(CEIL(CAST(n_rows AS DOUBLE) * {SPLIT_PCT}) AS BIGINT)")
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return [
        f"{tag}_a AS (SELECT *, ROW_NUMBER() OVER ({part}ORDER BY date) AS row_ix, "
        f"COUNT(*) OVER ({part.strip()}) AS n_rows FROM {src})",
        f"{tag}_b AS (SELECT *, {cut} AS cut FROM {tag}_a)",
        f"{tag} AS (SELECT *, CASE WHEN row_ix <= cut - {gap} THEN 'train' WHEN row_ix <= cut THEN 'gap' "
        f"ELSE 'test' END AS role FROM {tag}_b)",
    ]


def split_sql(h: int, role: str, gap: bool) -> str:
    g = _gap(h) if gap else 0
    ctes = _feature_ctes("fx", h, True) + _split_ctes("sp", "fx_f", g, exact=False)
    return _with(*ctes) + (f"SELECT date, row_ix, n_rows, cut, {_r('label', 'diff_sales')} FROM sp "
                           f"WHERE role = '{role}'")


def folds_sql(reference: bool) -> str:
    h, gap = 1, _gap(1)
    ctes = _feature_ctes("fx", h, reference) + _split_ctes("sp", "fx_f", gap, exact=not reference)
    ctes.append("tr AS (SELECT date FROM sp WHERE role = 'train')")
    ctes.append("tr_ix AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS row_ix, COUNT(*) OVER () AS n_rows FROM tr)")
    ctes.append("tr_f AS (SELECT *, 1 AS fold FROM tr_ix UNION ALL SELECT *, 2 AS fold FROM tr_ix)")
    if reference:
        ctes.append(
            f"bounds AS (SELECT *, n_rows % {CV_FIXED_MODULUS} AS initial, "
            f"CAST(FLOOR((n_rows - n_rows % {CV_FIXED_MODULUS}) / {CV_FOLDS}) AS BIGINT) AS shift FROM tr_f)")
        ctes.append(
            "bounds2 AS (SELECT *, initial + shift * fold AS test_end, "
            "CAST(CEIL(CAST(CAST(initial AS FLOAT) / CAST(initial + shift * fold AS FLOAT) AS DOUBLE) "
            "* (initial + shift * fold)) AS BIGINT) AS train_end, 0 AS g FROM bounds)")
    else:
        ctes.append(
            f"bounds2 AS (SELECT *, CAST(FLOOR(fold * n_rows / {CV_FOLDS + 1}) AS BIGINT) AS train_end, "
            f"CAST(FLOOR((fold + 1) * n_rows / {CV_FOLDS + 1}) AS BIGINT) AS test_end, {gap} AS g FROM tr_f)")
    ctes.append(
        "roles AS (SELECT *, CASE WHEN row_ix <= train_end - g THEN 'train' "
        "WHEN row_ix > train_end AND row_ix <= test_end THEN 'test' END AS role FROM bounds2)")
    return _with(*ctes) + ("SELECT fold, role, COUNT(*) AS n, MIN(date) AS first_date, MAX(date) AS last_date "
                           "FROM roles WHERE role IS NOT NULL GROUP BY fold, role")


def _naive_ctes(h: int, reference: bool) -> list[str]:
    ctes = _feature_ctes("fx", h, reference) + _split_ctes("sp", "fx_f", _gap(h), exact=not reference)
    ctes.append("nv AS (SELECT date, diff_sales AS prediction, label, level FROM sp WHERE role = 'test')")
    ctes.append("rt AS (SELECT date, prediction + level AS prediction, label + level AS label FROM nv)")
    return ctes


def retrend_sql(reference: bool) -> str:
    return _with(*_naive_ctes(1, reference)) + f"SELECT date, {_r('prediction', 'label')} FROM rt"


def retrend_by_key_join_sql() -> str:
    ctes = _feature_ctes("fx", 2, True) + _split_ctes("sp", "fx_f", _gap(2), exact=False)
    ctes.append("nv AS (SELECT date, diff_sales AS prediction, label FROM sp WHERE role = 'test')")
    ctes.append("lv AS (SELECT date, level FROM fx_f)")
    ctes.append("rt AS (SELECT nv.date, prediction + level AS prediction, label + level AS label, level "
                "FROM nv LEFT JOIN lv ON nv.date = lv.date)")
    return _with(*ctes) + f"SELECT date, {_r('prediction', 'label', 'level')} FROM rt"


def _smape_term(p: str, a: str) -> str:
    return f"COALESCE(ABS({p} - {a}) / NULLIF((ABS({p}) + ABS({a})) / 2.0, 0), 0.0)"


def smape_sql(reference: bool) -> str:
    ctes = _naive_ctes(1, reference)
    if reference:
        ctes.append("tr AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date DESC) AS from_end FROM rt)")
        ctes.append(f"sc AS (SELECT CASE WHEN from_end > 1 AND prediction IS NOT NULL AND label IS NOT NULL "
                    f"THEN {_smape_term('prediction', 'label')} END AS term FROM tr)")
        body = "SELECT ROUND(SUM(term) / COUNT(*) * 100.0, 4) AS smape, COUNT(term) AS n_scored FROM sc"
    else:
        ctes.append(f"sc AS (SELECT CASE WHEN prediction IS NOT NULL AND label IS NOT NULL "
                    f"THEN {_smape_term('prediction', 'label')} END AS term FROM rt)")
        body = "SELECT ROUND(SUM(term) / COUNT(term) * 100.0, 4) AS smape, COUNT(term) AS n_scored FROM sc"
    return _with(*ctes) + f"SELECT {_r('smape')}, n_scored FROM ({body})"


def rmse_sql() -> str:
    ctes = _naive_ctes(1, True)
    return _with(*ctes) + (
        "SELECT ROUND(SQRT(AVG(POW(prediction - label, 2))), 2) AS rmse, COUNT(*) AS n FROM nv "
        "WHERE prediction IS NOT NULL AND label IS NOT NULL")


def _sma_ctes(tag: str, window: int, reference: bool) -> list[str]:
    ctes = _split_ctes(f"{tag}s", "panel", 0, exact=not reference)
    if reference:
        ctes.append(f"{tag} AS (SELECT date, total_sales AS label, AVG(total_sales) OVER (ORDER BY day, date "
                    f"ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING) AS prediction FROM {tag}s WHERE role = 'test')")
    else:
        ctes.append(f"{tag}w AS (SELECT date, role, total_sales AS label, AVG(total_sales) OVER (ORDER BY date "
                    f"ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING) AS prediction FROM {tag}s)")
        ctes.append(f"{tag} AS (SELECT date, label, prediction FROM {tag}w WHERE role = 'test')")
    return ctes


def sma_sql(window: int) -> str:
    return _with(*_sma_ctes("sma", window, False)) + f"SELECT date, {_r('label', 'prediction')} FROM sma"


def sma_smape_sql(reference: bool) -> str:
    ctes = _sma_ctes("s2", 2, reference) + _sma_ctes("s3", 3, reference)
    denom = "COUNT(*)" if reference else "COUNT(term)"
    parts = []
    for w, tag in ((2, "s2"), (3, "s3")):
        ctes.append(f"{tag}_t AS (SELECT CASE WHEN prediction IS NOT NULL AND label IS NOT NULL "
                    f"THEN {_smape_term('prediction', 'label')} END AS term FROM {tag})")
        parts.append(f"SELECT {w} AS sma_window, ROUND(ROUND(SUM(term) / {denom} * 100.0, 4), 4) AS smape, "
                     f"COUNT(term) AS n_scored FROM {tag}_t")
    return _with(*ctes) + " UNION ALL ".join(parts)


def sma_smape_keyed_sql() -> str:
    keys = ("nation",)
    ctes = _split_ctes("sk", "panel_k", 0, True, keys)
    parts = []
    for w in (2, 3):
        ctes.append(f"sk{w} AS (SELECT nation, role, total_sales AS label, AVG(total_sales) OVER (PARTITION BY nation "
                    f"ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS prediction FROM sk)")
        ctes.append(f"sk{w}_t AS (SELECT nation, CASE WHEN prediction IS NOT NULL AND label IS NOT NULL "
                    f"THEN {_smape_term('prediction', 'label')} END AS term FROM sk{w} WHERE role = 'test')")
        parts.append(f"SELECT nation, {w} AS sma_window, ROUND(ROUND(SUM(term) / COUNT(term) * 100.0, 4), 4) AS smape, "
                     f"COUNT(term) AS n_scored FROM sk{w}_t GROUP BY nation")
    return _with(*ctes) + " UNION ALL ".join(parts)


def lr_single_feature_sql() -> str:
    ctes = _feature_ctes("fx", 1, False) + _split_ctes("sp", "fx_f", _gap(1), exact=True)
    return _with(*ctes) + (
        f"SELECT {_r('slope', 'intercept')} FROM (SELECT REGR_SLOPE(label, diff_sales) AS slope, "
        "REGR_INTERCEPT(label, diff_sales) AS intercept FROM sp WHERE role = 'train')")


def split_keyed_sql() -> str:
    keys = ("nation",)
    ctes = _feature_ctes("fx", 1, True, "panel_k", keys) + _split_ctes("sp", "fx_f", _gap(1), False, keys)
    return _with(*ctes) + (f"SELECT nation, date, row_ix, n_rows, cut, role, {_r('label', 'diff_sales')} FROM sp")


def folds_keyed_sql() -> str:
    keys = ("nation",)
    gap = _gap(1)
    ctes = _feature_ctes("fx", 1, False, "panel_k", keys) + _split_ctes("sp", "fx_f", gap, True, keys)
    ctes.append("tr AS (SELECT nation, date FROM sp WHERE role = 'train')")
    ctes.append("tr_ix AS (SELECT nation, date, ROW_NUMBER() OVER (PARTITION BY nation ORDER BY date) AS row_ix, "
                "COUNT(*) OVER (PARTITION BY nation) AS n_rows FROM tr)")
    ctes.append("tr_f AS (SELECT *, 1 AS fold FROM tr_ix UNION ALL SELECT *, 2 AS fold FROM tr_ix)")
    ctes.append(f"bounds2 AS (SELECT *, CAST(FLOOR(fold * n_rows / {CV_FOLDS + 1}) AS BIGINT) AS train_end, "
                f"CAST(FLOOR((fold + 1) * n_rows / {CV_FOLDS + 1}) AS BIGINT) AS test_end FROM tr_f)")
    ctes.append(f"roles AS (SELECT *, CASE WHEN row_ix <= train_end - {gap} THEN 'train' "
                "WHEN row_ix > train_end AND row_ix <= test_end THEN 'test' END AS role FROM bounds2)")
    return _with(*ctes) + ("SELECT nation, fold, role, COUNT(*) AS n, MIN(date) AS first_date, MAX(date) AS last_date "
                           "FROM roles WHERE role IS NOT NULL GROUP BY nation, fold, role")


def smape_keyed_sql() -> str:
    keys = ("nation",)
    ctes = _feature_ctes("fx", 1, False, "panel_k", keys) + _split_ctes("sp", "fx_f", _gap(1), True, keys)
    ctes.append("rt AS (SELECT nation, date, diff_sales + level AS prediction, label + level AS label "
                "FROM sp WHERE role = 'test')")
    ctes.append(f"sc AS (SELECT nation, CASE WHEN prediction IS NOT NULL AND label IS NOT NULL "
                f"THEN {_smape_term('prediction', 'label')} END AS term FROM rt)")
    body = ("SELECT nation, ROUND(SUM(term) / COUNT(term) * 100.0, 4) AS smape, COUNT(term) AS n_scored "
            "FROM sc GROUP BY nation")
    return _with(*ctes) + f"SELECT nation, {_r('smape')}, n_scored FROM ({body})"


FILLED = [
    "span AS (SELECT store, MIN(date) AS lo, MAX(date) AS hi FROM panel_s GROUP BY store)",
    "grid AS (SELECT store, CAST(UNNEST(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS date FROM span)",
    "filled AS (SELECT g.store, g.date, total_sales, temp, cpi, is_holiday, CAST(month(g.date) AS INTEGER) AS month, "
    "CAST(dayofmonth(g.date) AS INTEGER) AS day FROM grid g LEFT JOIN panel_s p ON g.store = p.store AND g.date = p.date)",
]

# the retail layout keeps only holiday or not; every tenth store has no covariates
RETAIL = [
    "rfeat AS (SELECT store, date, flag = 'R' AS holiday, CASE WHEN store % 10 = 0 THEN NULL ELSE AVG(l_discount) END AS temp, "
    "CASE WHEN store % 10 = 0 THEN NULL ELSE AVG(l_tax) END AS cpi FROM li GROUP BY store, date, flag = 'R')",
    "rmerged AS (SELECT s.date, s.price, s.flag, f.temp, f.cpi FROM li s LEFT JOIN rfeat f "
    "ON s.store = f.store AND s.date = f.date AND (s.flag = 'R') = f.holiday)",
    "rpanel AS (SELECT date, CAST(ROUND(SUM(price)) AS DOUBLE) AS total_sales, AVG(temp) AS temp, AVG(cpi) AS cpi, "
    "AVG(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS is_holiday, CAST(month(date) AS INTEGER) AS month, "
    "CAST(dayofmonth(date) AS INTEGER) AS day FROM rmerged GROUP BY date)",
]


# -- models with a closed form -------------------------------------------------------------------------

def _ridge_ctes(tag: str, h: int, reference: bool, src: str, keys: tuple[str, ...], reg: str = "0.5") -> list[str]:
    """Ridge of the label on the newest lag over the training rows; forecasts of the test rows in ``{tag}_p``."""
    x = f"lag_{_suffix(h)}"
    return [
        *_feature_ctes(f"{tag}fx", h, reference, src, keys),
        *_split_ctes(f"{tag}sp", f"{tag}fx_f", _gap(h), not reference, keys),
        f"{tag}_c AS (SELECT slope, my - slope * mx AS intercept FROM (SELECT COVAR_POP(label, {x}) / VAR_POP({x}) "
        f"/ (1 + {reg} / STDDEV_POP(label)) AS slope, AVG(label) AS my, AVG({x}) AS mx FROM {tag}sp "
        "WHERE role = 'train' AND label IS NOT NULL))",
        f"{tag}_p AS (SELECT sp.*, intercept + slope * {x} AS prediction FROM {tag}sp sp, {tag}_c WHERE role = 'test')",
    ]


def predict_lr_single_sql() -> str:
    return _with(*_ridge_ctes("r", 1, False, "panel", ())) + f"SELECT date, {_r('prediction')} FROM r_p"


def model_run_ridge_sql() -> str:
    return _with(*_ridge_ctes("r", 1, False, "panel", ()),
                 "rt AS (SELECT date, prediction + level AS prediction, label + level AS label FROM r_p)") + (
        f"SELECT date, {_r('prediction', 'label')} FROM rt")


def _stump_ctes(columns: tuple[str, ...]) -> list[str]:
    """Every one-split fit of the label on a column: cumulative sums over its sorted values, the threshold
    half way to the next value, and the squared error that the two means leave; the best one in ``best``."""
    parts = []
    for c in columns:
        parts.append(
            f"SELECT '{c}' AS feature, (x + next_x) / 2.0 AS threshold, sl / nl AS left_mean, (s - sl) / (n - nl) AS right_mean, "
            "-(sl * sl / nl + (s - sl) * (s - sl) / (n - nl)) AS loss FROM (SELECT x, LEAD(x) OVER (ORDER BY x) AS next_x, "
            "SUM(cnt) OVER (ORDER BY x) AS nl, SUM(sy) OVER (ORDER BY x) AS sl, SUM(cnt) OVER () AS n, SUM(sy) OVER () AS s "
            f"FROM (SELECT CAST({c} AS DOUBLE) AS x, COUNT(*) AS cnt, SUM(label) AS sy FROM sp "
            f"WHERE role = 'train' AND label IS NOT NULL GROUP BY {c})) WHERE next_x IS NOT NULL")
    return [
        *_feature_ctes("fx", 1, False), *_split_ctes("sp", "fx_f", _gap(1), True),
        f"splits AS ({' UNION ALL '.join(parts)})",
        "best AS (SELECT * FROM splits ORDER BY loss LIMIT 1)",
    ]


def stump_sql() -> str:
    return _with(*_stump_ctes(("month",)), "pr AS (SELECT date, month, CASE WHEN month <= threshold THEN left_mean "
                 "ELSE right_mean END AS prediction FROM sp, best WHERE role = 'test')") + (
        f"SELECT date, month, {_r('prediction')} FROM pr")


def stump_importance_sql(only_selected: bool) -> str:
    rows = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS feature" for i, c in enumerate(("month", "day")))
    body = (f"SELECT CAST(position AS INTEGER) AS position, f.feature, CASE WHEN f.feature = best.feature THEN 1.0 ELSE 0.0 END "
            f"AS importance FROM ({rows}) f, best")
    where = " WHERE importance > 0.03" if only_selected else ""
    return _with(*_stump_ctes(("month", "day"))) + f"SELECT position, feature, {_r('importance')} FROM ({body}){where}"


def _threshold_ctes(tag: str, rows: str, y: str, columns: tuple[str, ...], bins: int) -> list[str]:
    """The thresholds that a column may be split at, in ``{tag}_v<i>`` (t).

    A column with at most ``bins`` distinct values may be split between any two neighbours. One with more gets about
    ``bins - 1`` thresholds: walking up its values, wherever the rows so far are nearer to the next multiple of
    n / bins than with the next value added, the half way to that value is one."""
    known = f"role = 'train' AND {y} IS NOT NULL"
    ctes = []
    for i, c in enumerate(columns):
        v = f"{tag}_d{i}"
        ctes += [
            f"{v} AS (SELECT x, cnt, ROW_NUMBER() OVER (ORDER BY x) AS k, LAG(x) OVER (ORDER BY x) AS before, COUNT(*) OVER () AS many, "
            f"SUM(cnt) OVER () / CAST({bins} AS DOUBLE) AS stride, CAST(SUM(cnt) OVER (ORDER BY x) AS DOUBLE) AS upto FROM "
            f"(SELECT CAST({c} AS DOUBLE) AS x, COUNT(*) AS cnt FROM {rows} WHERE {known} GROUP BY {c}))",
            f"{tag}_w{i} AS (SELECT k, upto, stride AS target, CAST(NULL AS DOUBLE) AS t FROM {v} WHERE k = 1 "
            f"UNION ALL SELECT v.k, v.upto, CASE WHEN ABS(w.upto - w.target) < ABS(v.upto - w.target) THEN w.target + v.stride ELSE w.target END, "
            f"CASE WHEN ABS(w.upto - w.target) < ABS(v.upto - w.target) THEN (v.before + v.x) / 2.0 END "
            f"FROM {tag}_w{i} w JOIN {v} v ON v.k = w.k + 1)",
            f"{tag}_v{i} AS (SELECT (before + x) / 2.0 AS t FROM {v} WHERE before IS NOT NULL AND many <= {bins} "
            f"UNION ALL SELECT t FROM {tag}_w{i} WHERE t IS NOT NULL AND (SELECT MAX(many) FROM {v}) > {bins})",
        ]
    return ctes


def _tree_ctes(tag: str, rows: str, y: str, columns: tuple[str, ...], depth: int, bins: int = 32, thresholds: str | None = None) -> list[str]:
    """A least-squares tree of ``y`` on the columns, grown level by level on the train rows of ``rows``.

    At each level every node tries all thresholds of all columns (those of the tree ``thresholds``, if given); of
    thresholds that split a node alike only the least is tried. Nodes are numbered like a heap; one without a gain
    stays a leaf. Gives ``{tag}_p``, all rows with the node's mean as ``prediction``, and ``{tag}_g``, the gain of
    every split."""
    known = f"role = 'train' AND {y} IS NOT NULL"
    ctes = [] if thresholds else _threshold_ctes(tag, rows, y, columns, bins)
    ctes.append(f"{tag}_n0 AS (SELECT *, 1 AS node FROM {rows})")
    value = "CASE s.feature " + " ".join(f"WHEN '{c}' THEN CAST(n.{c} AS DOUBLE)" for c in columns) + " END"
    for d in range(1, depth + 1):
        parts = [
            f"SELECT node, '{c}' AS feature, {i} AS fpos, nl, MIN(t) AS threshold, ANY_VALUE(sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n) "
            f"AS gain FROM (SELECT node, t, COUNT(*) FILTER (CAST({c} AS DOUBLE) <= t) AS nl, SUM({y}) FILTER (CAST({c} AS DOUBLE) <= t) AS sl, "
            f"COUNT(*) AS n, SUM({y}) AS s FROM (SELECT node, {c}, {y} FROM {tag}_n{d - 1} WHERE {known}), {thresholds or tag}_v{i} GROUP BY node, t) "
            f"WHERE nl > 0 AND nl < n GROUP BY node, nl" for i, c in enumerate(columns)]
        ctes.append(f"{tag}_s{d} AS (SELECT node, feature, threshold, gain FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY node "
                    f"ORDER BY gain DESC, fpos, threshold) AS r FROM ({' UNION ALL '.join(parts)}) WHERE gain > 0) WHERE r = 1)")
        ctes.append(f"{tag}_n{d} AS (SELECT n.* EXCLUDE (node), CASE WHEN s.node IS NULL THEN n.node WHEN {value} <= s.threshold "
                    f"THEN 2 * n.node ELSE 2 * n.node + 1 END AS node FROM {tag}_n{d - 1} n LEFT JOIN {tag}_s{d} s ON s.node = n.node)")
    ctes.append(f"{tag}_m AS (SELECT node, AVG({y}) AS mean FROM {tag}_n{depth} WHERE {known} GROUP BY node)")
    ctes.append(f"{tag}_p AS (SELECT n.* EXCLUDE (node), m.mean AS prediction FROM {tag}_n{depth} n JOIN {tag}_m m ON m.node = n.node)")
    ctes.append(f"{tag}_g AS ({' UNION ALL '.join(f'SELECT feature, gain FROM {tag}_s{d}' for d in range(1, depth + 1))})")
    return ctes


TREE_COLUMNS = ("month", "day")
#: inputs with more values than bins
WIDE_COLUMNS = ("diff_sales", "lag_1week", "std_4weeks", "month")


def _tree_rows() -> list[str]:
    return [*_feature_ctes("fx", 1, False), *_split_ctes("sp", "fx_f", _gap(1), True)]


def tree_sql(depth: int, columns: tuple[str, ...] = TREE_COLUMNS, bins: int = 32) -> str:
    """Forecasts of the test rows by one tree (or a forest of equal trees)."""
    return _with(*_tree_rows(), *_tree_ctes("t", "sp", "label", columns, depth, bins)) + (
        f"SELECT date, month, day, {_r('prediction')} FROM t_p WHERE role = 'test'")


def _boost_ctes(tag: str, rows: str, depth: int, columns: tuple[str, ...] = TREE_COLUMNS, bins: int = 32, iterations: int = 2) -> list[str]:
    """Boosting: every later tree fits twice what those before it leave and counts a tenth; forecasts after each
    iteration as ``p1``, ``p2`` ... in ``{tag}_b``."""
    ctes = [*_tree_ctes(f"{tag}1", rows, "label", columns, depth, bins),
            f"{tag}_r1 AS (SELECT * EXCLUDE (prediction), prediction AS p1, 2 * (label - prediction) AS rest FROM {tag}1_p)"]
    for k in range(2, iterations + 1):
        ctes += _tree_ctes(f"{tag}{k}", f"{tag}_r{k - 1}", "rest", columns, depth, bins, f"{tag}1")
        ctes.append(f"{tag}_r{k} AS (SELECT * EXCLUDE (prediction, rest), p{k - 1} + 0.1 * prediction AS p{k}, "
                    f"2 * (label - p{k - 1} - 0.1 * prediction) AS rest FROM {tag}{k}_p)")
    return [*ctes, f"{tag}_b AS (SELECT * FROM {tag}_r{iterations})"]


def gbt_sql(depth: int, columns: tuple[str, ...] = TREE_COLUMNS, bins: int = 32, iterations: int = 2) -> str:
    return _with(*_tree_rows(), *_boost_ctes("b", "sp", depth, columns, bins, iterations), f"pr AS (SELECT date, month, day, p{iterations} "
                 "AS prediction FROM b_b WHERE role = 'test')") + f"SELECT date, month, day, {_r('prediction')} FROM pr"


def tree_importance_sql(depth: int, columns: tuple[str, ...] = TREE_COLUMNS, bins: int = 32) -> str:
    """Each column's share of the gains of all splits."""
    rows = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS feature" for i, c in enumerate(columns))
    body = (f"SELECT CAST(f.position AS INTEGER) AS position, f.feature, COALESCE(SUM(gain), 0) / (SELECT SUM(gain) FROM t_g) AS importance "
            f"FROM ({rows}) f LEFT JOIN t_g ON t_g.feature = f.feature GROUP BY f.position, f.feature")
    return _with(*_tree_rows(), *_tree_ctes("t", "sp", "label", columns, depth, bins)) + (
        f"SELECT position, feature, {_r('importance')} FROM ({body})")


def _fold_rows() -> list[str]:
    """The purged training rows once for each fold they take part in, as ``f1`` and ``f2``."""
    gap = _gap(1)
    ctes = [*_tree_rows(), "tr AS (SELECT * EXCLUDE (role, row_ix, n_rows, cut), ROW_NUMBER() OVER (ORDER BY date) AS ix, COUNT(*) OVER () AS n FROM sp "
            "WHERE role = 'train' AND label IS NOT NULL)"]
    for fold in range(1, CV_FOLDS + 1):
        ctes.append(
            f"f{fold} AS (SELECT * FROM (SELECT *, CASE WHEN ix <= FLOOR({fold} * n / {CV_FOLDS + 1}) - {gap} THEN 'train' "
            f"WHEN ix > FLOOR({fold} * n / {CV_FOLDS + 1}) AND ix <= FLOOR({fold + 1} * n / {CV_FOLDS + 1}) THEN 'test' END AS role "
            "FROM tr) WHERE role IS NOT NULL)")
    return ctes


def _fold_score(rows: str, prediction: str, fold: int, param_ix: int, name: str) -> str:
    return (f"SELECT '{name}' AS model, CAST({param_ix} AS INTEGER) AS param_ix, CAST({fold} AS INTEGER) AS fold, "
            f"(SELECT COUNT(*) FROM f{fold} WHERE role = 'train') AS n_train, COUNT(*) AS n_test, 'rmse' AS metric, "
            f"SQRT(AVG(POW({prediction} - label, 2))) AS score FROM {rows} WHERE role = 'test'")


def cv_tree_sql(sets: tuple[tuple[int, int], ...], columns: tuple[str, ...] = TREE_COLUMNS) -> str:
    """CV scores of trees of several (depth, bins)."""
    ctes, parts = _fold_rows(), []
    for fold in range(1, CV_FOLDS + 1):
        for ix, (depth, bins) in enumerate(sets):
            ctes += _tree_ctes(f"t{fold}{ix}", f"f{fold}", "label", columns, depth, bins)
            parts.append(_fold_score(f"t{fold}{ix}_p", "prediction", fold, ix, "dt"))
    return _with(*ctes) + f"SELECT model, param_ix, fold, n_train, n_test, metric, {_r('score')} FROM ({' UNION ALL '.join(parts)})"


def cv_boost_sql(depth: int, iterations: int, columns: tuple[str, ...] = TREE_COLUMNS, bins: int = 32) -> str:
    """CV scores after each boosting iteration."""
    ctes, parts = _fold_rows(), []
    for fold in range(1, CV_FOLDS + 1):
        ctes += _boost_ctes(f"b{fold}", f"f{fold}", depth, columns, bins, iterations)
        parts += [_fold_score(f"b{fold}_b", f"p{k + 1}", fold, k, "gbt") for k in range(iterations)]
    return _with(*ctes) + f"SELECT model, param_ix, fold, n_train, n_test, metric, {_r('score')} FROM ({' UNION ALL '.join(parts)})"


def ts_split_raw_sql() -> str:
    order = "date, store, dept, flag, weekly_sales"
    return _with(
        f"pos AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS row_ix, COUNT(*) OVER () AS n_rows FROM sales)",
        f"cut AS (SELECT *, CAST(CEIL(n_rows * {SPLIT_PCT}) AS BIGINT) AS cut FROM pos)") + (
        f"SELECT date, store, dept, flag, {_r('weekly_sales')}, row_ix, n_rows, cut, CASE WHEN row_ix <= cut THEN 'train' ELSE 'test' END AS role FROM cut")


def sma_ranges_sql(window: int) -> str:
    return _with(f"s AS (SELECT date, total_sales, AVG(total_sales) OVER (ORDER BY date ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING) "
                 "AS sma FROM panel)") + f"SELECT date, {_r('total_sales', 'sma')} FROM s"


def features_between_sql(start: str, end: str, keys: tuple[str, ...] = ()) -> str:
    """Everything is built, then the dates are picked."""
    src = PANEL_OF[keys]
    return _with(*_feature_ctes("fx", 1, False, src, keys)) + (
        f"SELECT {_feature_select(1, keys, True)} FROM fx_f WHERE date BETWEEN DATE '{start}' AND DATE '{end}'")


def period_lags_sql() -> str:
    """Lags by date arithmetic: a week without a row gives a null."""
    back = lambda name, k: f"LEFT JOIN {name} b{k} ON b{k}.store IS NOT DISTINCT FROM a.store AND b{k}.date = a.date - INTERVAL {7 * k} DAY"
    ks = range(1, 1 + N_LAGS)
    joins = " ".join(back("pd", k) for k in ks)
    lags = ", ".join(f"b{k}.diff_sales AS lag_{_suffix(k)}" for k in ks)
    return _with(
        f"pl AS (SELECT a.store, a.date, a.total_sales, b{SEASON}.total_sales AS lag_1year FROM panel_s a {back('panel_s', SEASON)})",
        "pd AS (SELECT *, total_sales - lag_1year AS diff_sales FROM pl)",
        f"pa AS (SELECT a.*, {lags}, f.diff_sales AS label FROM pd a {joins} LEFT JOIN pd f ON f.store IS NOT DISTINCT FROM a.store "
        "AND f.date = a.date + INTERVAL 7 DAY)") + (
        f"SELECT store, date, {_r('total_sales', 'lag_1year', 'diff_sales', *[f'lag_{_suffix(k)}' for k in ks], 'label')} FROM pa")


def _ridge_cv_ctes() -> list[str]:
    """Test error of each (regularisation, fold) over the purged training rows, in ``scores``."""
    gap, x = _gap(1), "lag_1week"
    return [
        *_feature_ctes("fx", 1, False), *_split_ctes("sp", "fx_f", gap, True),
        f"tr AS (SELECT date, label, {x} AS x, ROW_NUMBER() OVER (ORDER BY date) AS ix, COUNT(*) OVER () AS n FROM sp "
        "WHERE role = 'train' AND label IS NOT NULL)",
        "folds AS (SELECT UNNEST([1, 2]) AS fold)",
        f"fr AS (SELECT fold, label, x, CASE WHEN ix <= FLOOR(fold * n / {CV_FOLDS + 1}) - {gap} THEN 'train' "
        f"WHEN ix > FLOOR(fold * n / {CV_FOLDS + 1}) AND ix <= FLOOR((fold + 1) * n / {CV_FOLDS + 1}) THEN 'test' END AS role "
        "FROM tr, folds)",
        "regs AS (SELECT 0 AS param_ix, 0.0 AS reg UNION ALL SELECT 1, 0.1 UNION ALL SELECT 2, 0.5)",
        "coefs AS (SELECT fold, param_ix, slope, my - slope * mx AS intercept FROM (SELECT fold, param_ix, "
        "COVAR_POP(label, x) / VAR_POP(x) / (1 + ANY_VALUE(reg) / STDDEV_POP(label)) AS slope, AVG(label) AS my, AVG(x) AS mx "
        "FROM fr, regs WHERE role = 'train' GROUP BY fold, param_ix))",
        "sizes AS (SELECT fold, COUNT(*) FILTER (role = 'train') AS n_train, COUNT(*) FILTER (role = 'test') AS n_test "
        "FROM fr GROUP BY fold)",
        "scores AS (SELECT c.param_ix, c.fold, SQRT(AVG(POW(intercept + slope * x - label, 2))) AS score FROM coefs c "
        "JOIN fr ON fr.fold = c.fold AND fr.role = 'test' GROUP BY c.param_ix, c.fold)",
    ]


def cv_results_ridge_sql() -> str:
    return _with(*_ridge_cv_ctes()) + (
        "SELECT 'lr' AS model, CAST(param_ix AS INTEGER) AS param_ix, CAST(s.fold AS INTEGER) AS fold, n_train, n_test, "
        f"'rmse' AS metric, {_r('score')} FROM scores s JOIN sizes z ON z.fold = s.fold")


def best_params_ridge_sql() -> str:
    return _with(*_ridge_cv_ctes()) + (
        f"SELECT 'lr' AS model, CAST(param_ix AS INTEGER) AS param_ix, {_r('mean_score')}, folds FROM (SELECT param_ix, "
        "AVG(score) AS mean_score, COUNT(*) AS folds FROM scores GROUP BY param_ix ORDER BY mean_score, param_ix LIMIT 1)")


def ridge_table_sql(reference: bool, keys: tuple[str, ...] = ()) -> str:
    """sMAPE of the ridge and of the moving average for three horizons, pivoted."""
    src, ctes, parts = PANEL_OF[keys], [], []
    by = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    denom = "COUNT(*)" if reference else "NULLIF(COUNT(term), 0)"

    def score(model: str, h: int, rows: str, trim: int) -> None:
        tag = f"{model}{h}"
        keep = f"from_end > {trim} AND " if trim else ""
        ctes.append(f"{tag}_t AS (SELECT {by}CASE WHEN {keep}prediction IS NOT NULL AND label IS NOT NULL THEN "
                    f"{_smape_term('prediction', 'label')} END AS term FROM (SELECT *, ROW_NUMBER() OVER ({part}ORDER BY date DESC) "
                    f"AS from_end FROM ({rows})))")
        label = {"lr": "Linear Regression", "sma": "SMA"}[model]
        parts.append(f"SELECT {by}'{label}' AS model, {h} AS horizon, ROUND(SUM(term) / {denom} * 100.0, 4) AS smape "
                     f"FROM {tag}_t{group}")

    for h in (1, 2, 3):
        ctes += _ridge_ctes(f"r{h}", h, reference, src, keys)
        score("lr", h, f"SELECT {by}date, prediction + level AS prediction, label + level AS label FROM r{h}_p", h if reference else 0)
        if h == 1:
            continue
        if reference:
            ctes += _sma_ctes(f"b{h}", h, True)
            score("sma", h, f"SELECT * FROM b{h}", 0)
        else:
            same = "".join(f"t.{k} IS NOT DISTINCT FROM a.{k} AND " for k in keys)
            named = "".join(f"t.{k}, " for k in keys)
            ctes.append(f"a{h} AS (SELECT {by}date, AVG(total_sales) OVER ({part}ORDER BY date ROWS BETWEEN {h - 1} PRECEDING "
                        f"AND CURRENT ROW) AS prediction FROM {src})")
            score("sma", h, f"SELECT {named}t.date, a.prediction, t.label + t.level AS label FROM r{h}_p t LEFT JOIN a{h} a "
                            f"ON {same}t.date = a.date", 0)
    cells = ", ".join(f"ROUND(MAX(CASE WHEN horizon = {h} THEN smape END), 4) AS \"{h} {'week' if h == 1 else 'weeks'}\"" for h in (1, 2, 3))
    return _with(*ctes) + f"SELECT {by}model, {cells} FROM ({' UNION ALL '.join(parts)}) GROUP BY {by}model"


ORACLE: dict[str, str] = {
    "table_shapes": _with() + (
        "SELECT 'sales' AS table_name, COUNT(*) AS n_rows, 5 AS n_cols FROM sales UNION ALL "
        "SELECT 'features', COUNT(*), 5 FROM features UNION ALL SELECT 'stores', COUNT(*), 3 FROM stores"),
    "table_preview": _with() + (
        f"SELECT store, dept, flag, date, {_r('weekly_sales')} FROM sales ORDER BY store, dept, flag, date, sales.weekly_sales LIMIT 10"),
    "table_preview_features": _with() + (
        f"SELECT store, date, flag, {_r('temp', 'cpi')} FROM features ORDER BY store, date, flag LIMIT 10"),
    "table_preview_stores": _with() + (
        f"SELECT store, nation, {_r('acctbal')} FROM stores ORDER BY store LIMIT 10"),
    "merge_left_three_keys": _with() + f"SELECT store, dept, flag, date, {_r('weekly_sales', 'temp', 'cpi')} FROM merged",
    "merge_left_dimension": _with() + (
        f"SELECT store, dept, flag, date, nation, {_r('weekly_sales', 'temp', 'cpi', 'acctbal')} FROM merged_dim"),
    "flag_encode": _with() + (
        "SELECT store, dept, date, flag, CAST(CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS is_holiday "
        "FROM sales"),
    "date_parse": _with() + (
        "SELECT store, dept, flag, strftime(date, '%d/%m/%Y') AS date_text, "
        "CAST(strptime(strftime(date, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS date FROM sales"),
    "weekly_panel": _with() + (
        f"SELECT date, {_r('total_sales', 'temp', 'cpi', 'is_holiday')}, month, day FROM panel"),
    "weekly_panel_keyed": _with() + (
        f"SELECT nation, date, {_r('total_sales', 'temp', 'cpi', 'is_holiday')}, month, day FROM panel_k"),
    "weekly_panel_by_store": _with() + (
        f"SELECT store, date, {_r('total_sales', 'temp', 'cpi', 'is_holiday')}, month, day FROM panel_s"),
    "weekly_panel_by_store_filled": _with(*FILLED) + (
        f"SELECT store, date, {_r('total_sales', 'temp', 'cpi', 'is_holiday')}, month, day FROM filled"),
    "features_by_store_filled": _with(*FILLED, *_feature_ctes("fx", 1, False, "filled", ("store",))) + (
        f"SELECT {_feature_select(1, ('store',), True)} FROM fx_f"),
    "weekly_panel_wide_range": _with(
        "wide AS (SELECT date, CAST(ROUND(SUM(weekly_sales)) AS DOUBLE) AS total_sales, AVG(temp * 1e21) / 1e21 AS temp, "
        "AVG(cpi * 1e-19) / 1e-19 AS cpi, AVG(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS is_holiday FROM merged GROUP BY date)") + (
        f"SELECT date, {_r('total_sales', 'temp', 'cpi', 'is_holiday')}, CAST(month(date) AS INTEGER) AS month, "
        "CAST(dayofmonth(date) AS INTEGER) AS day FROM wide"),
    "weekly_panel_subcent": _with(
        "cents AS (SELECT date, CAST(ROUND(SUM(weekly_sales * 0.001)) AS DOUBLE) AS total_sales, AVG(temp) AS temp, "
        "AVG(cpi) AS cpi, AVG(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS is_holiday FROM merged GROUP BY date)") + (
        f"SELECT date, {_r('total_sales', 'temp', 'cpi', 'is_holiday')}, CAST(month(date) AS INTEGER) AS month, "
        "CAST(dayofmonth(date) AS INTEGER) AS day FROM cents"),
    "weekly_panel_retail_layout": _with(*RETAIL) + (
        f"SELECT date, {_r('total_sales', 'temp', 'cpi', 'is_holiday')}, month, day FROM rpanel"),
    "features_retail_layout": _with(*RETAIL, *_feature_ctes("fx", 1, True, "rpanel")) + f"SELECT {_feature_select(1)} FROM fx_f",
    "calendar_features": _with() + "SELECT date, month, day FROM panel",
    "seasonal_diff": _with(*_feature_ctes("fx", 1, True)[:2]) + (
        f"SELECT date, {_r('total_sales', 'lag_1year', 'diff_sales')} FROM fx_2"),
    "seasonal_diff_signed": _with(*_feature_ctes("fx", 1, False)[:2]) + (
        f"SELECT date, {_r('total_sales', 'lag_1year', 'diff_sales')} FROM fx_2"),
    "lag_features": _with(*_feature_ctes("fx", 1, True)[:3]) + (
        f"SELECT date, {_r('diff_sales', 'lag_1week', 'lag_2weeks', 'lag_3weeks', 'lag_4weeks')} FROM fx_3 "
        "WHERE lag_4weeks > 0"),
    "lead_label": _with(*_feature_ctes("fx", 3, True)[:2]) + (
        f"SELECT date, {_r('diff_sales')}, ROUND(CAST(LEAD(diff_sales, 3, 0) OVER (ORDER BY date) AS DOUBLE), 2) "
        "AS label FROM fx_2"),
    "rolling_mean": _with(*_feature_ctes("fx", 1, True)[:4]) + (
        f"SELECT date, {_r('lag_1week', 'ma_1week', 'ma_2weeks', 'ma_3weeks', 'ma_4weeks')} FROM fx_4 "
        "WHERE std_4weeks > 0"),
    "rolling_std": _with(*_feature_ctes("fx", 1, True)[:4]) + (
        f"SELECT date, {_r('lag_1week', 'std_1week', 'std_2weeks', 'std_3weeks', 'std_4weeks')} FROM fx_4 "
        "WHERE std_4weeks > 0"),
    "features_h1": features_sql(1),
    "features_h2": features_sql(2),
    "features_h3": features_sql(3),
    "features_keyed": features_sql(1, True, ("nation",)),
    "features_h1_corrected": features_sql(1, False, level=True),
    "features_by_store": features_sql(1, False, ("store",), level=True),
    "ts_split_train": split_sql(1, "train", False),
    "ts_split_test": split_sql(1, "test", False),
    "purged_train_h1": split_sql(1, "train", True),
    "purged_train_h2": split_sql(2, "train", True),
    "purged_train_h3": split_sql(3, "train", True),
    "ts_split_keyed": split_keyed_sql(),
    "rolling_folds": folds_sql(False),
    "rolling_folds_keyed": folds_keyed_sql(),
    "rolling_folds_fixed": folds_sql(True),
    "retrend_naive": retrend_sql(True),
    "retrend_corrected": retrend_sql(False),
    "retrend_by_key_join": retrend_by_key_join_sql(),
    "smape_naive": smape_sql(True),
    "smape_corrected": smape_sql(False),
    "smape_keyed": smape_keyed_sql(),
    "rmse_naive": rmse_sql(),
    "sma_2": sma_sql(2),
    "sma_3": sma_sql(3),
    "sma_smape": sma_smape_sql(False),
    "sma_smape_day_order": sma_smape_sql(True),
    "sma_smape_keyed": sma_smape_keyed_sql(),
    "lr_single_feature": lr_single_feature_sql(),
    "predict_lr_single": predict_lr_single_sql(),
    "predict_dt_stump": stump_sql(),
    "predict_gbt_stump": stump_sql(),
    "predict_rf_stump": stump_sql(),
    "feature_importance_stump": stump_importance_sql(False),
    "feature_selection_stump": stump_importance_sql(True),
    "predict_dt_depth2": tree_sql(2),
    "predict_rf_two": tree_sql(2),
    "predict_gbt_two": gbt_sql(1),
    "predict_gbt_two_depth2": gbt_sql(2),
    "feature_importance_depth2": tree_importance_sql(2),
    "predict_dt_depth3_binned": tree_sql(3, WIDE_COLUMNS, 20),
    "predict_rf_depth3_binned": tree_sql(3, WIDE_COLUMNS, 28),
    "predict_gbt_three_binned": gbt_sql(2, WIDE_COLUMNS, 23, 3),
    "feature_importance_depth3": tree_importance_sql(3, WIDE_COLUMNS, 28),
    "cv_results_dt_nested": cv_tree_sql(((1, 32), (2, 32))),
    "cv_results_dt_binned": cv_tree_sql(tuple((d, b) for d in (1, 2) for b in (20, 25)), WIDE_COLUMNS),
    "cv_results_gbt_nested": cv_boost_sql(1, 2),
    "cv_results_gbt_binned": cv_boost_sql(1, 3, WIDE_COLUMNS, 23),
    "features_h1_by_ranges": features_sql(1, False, level=True),
    "sma_by_ranges": sma_ranges_sql(3),
    "ts_split_raw": ts_split_raw_sql(),
    "features_between": features_between_sql(*BETWEEN),
    "features_between_by_store": features_between_sql(*BETWEEN, ("store",)),
    "features_by_period": period_lags_sql(),
    "merge_left_dimension_spread": _with() + (
        f"SELECT store, dept, flag, date, nation, {_r('weekly_sales', 'temp', 'cpi', 'acctbal')} FROM merged_dim"),
    "cv_results_ridge": cv_results_ridge_sql(),
    "best_params_ridge": best_params_ridge_sql(),
    "model_run_ridge": model_run_ridge_sql(),
    "accuracy_comparison_ridge": ridge_table_sql(False),
    "accuracy_comparison_ridge_reference": ridge_table_sql(True),
    "accuracy_comparison_ridge_keyed": ridge_table_sql(False, ("nation",)),
}
