"""SQL for the same results, runnable on the given tables by any ANSI engine with
``arg_max``, ``unnest`` and ``md5``."""

from __future__ import annotations

from ledgerline.catalog import views as V
from ledgerline.catalog.queries import (
    CATEGORICAL, COEFFICIENTS, FEATURES, KNOTS_X, KNOTS_Y, LOGIT, MEANS, NUMERIC, SCENARIOS, SEQ_COLUMNS, TEXTS,
    WIDE_COEFFICIENTS, WIDE_MEANS, WIDE_SCALE,
)
from ledgerline.functions.scores import PD_LIMITS, RISK_BANDS, TOP_BAND
from ledgerline.operators.presets import PRESETS
from ledgerline.operators.profile import GROUP_NAMES, MISSING_BUCKETS

ST, LB, PD = V.STATEMENTS_SQL, V.LABELS_SQL, V.PREDICTIONS_SQL
COLUMNS = [*NUMERIC, *CATEGORICAL]
# expected descriptions, written out per column and per statistic
_MEANS_OF = {
    "P_2": "payment", "D_39": "delinquency", "B_1": "balance", "R_1": "risk", "S_3": "spend",
    "B_30": "balance", "D_63": "delinquency", "D_64": "delinquency",
}
_NUMBER_TEXTS = {
    "mean": "average {} ({})", "std": "volatility of {} ({})", "min": "lowest {} ({})", "max": "highest {} ({})",
    "first": "earliest {} ({})", "last": "most recent {} ({})", "last_mean_diff": "recent deviation in {} ({})",
    "last_first_diff": "trend in {} ({})", "range": "range of {} ({})",
}
_CATEGORY_TEXTS = {"last": "most recent {} ({})", "nunique": "number of distinct {} ({})", "count": "number of {} ({})"}
DESCRIPTIONS = {f"{c}_{s}": t.format(_MEANS_OF[c], c) for c in NUMERIC for s, t in _NUMBER_TEXTS.items()}
DESCRIPTIONS |= {f"{c}_{s}": t.format(_MEANS_OF[c], c) for c in CATEGORICAL for s, t in _CATEGORY_TEXTS.items()}
DESCRIPTIONS |= {"statement_count": "statement count", "history_days": "length of history"}
TEXT_FEATURES = [f"{c}_last" for c in TEXTS]
TIE = "md5(customer_ID), customer_ID"


def dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _band(p: str) -> str:
    cases = " ".join(f"WHEN {p} < {dbl(t)} THEN '{n}'" for t, n in RISK_BANDS)
    return f"CASE {cases} ELSE '{TOP_BAND}' END"


def _features(source: str = "statements", name: str = "features") -> str:
    return V.features_sql(source, name)


def _term(f: str) -> str:
    return f"COALESCE({dbl(COEFFICIENTS[f])} * ({f} - {dbl(MEANS[f])}), 0e0)"


LOGIT_SQL = dbl(LOGIT.intercept) + "".join(f" + {_term(f)}" for f in COEFFICIENTS)
RAW_SQL = f"1e0 / (1e0 + EXP(-({LOGIT_SQL})))"

WIDE_LOGIT_SQL = dbl(-0.4) + "".join(
    f" + COALESCE({dbl(w / WIDE_SCALE)} * ({f} - {dbl(WIDE_MEANS[f])}), 0e0)" for f, w in WIDE_COEFFICIENTS.items())


def _interp(p: str) -> str:
    cases = [f"WHEN {p} < {dbl(KNOTS_X[0])} THEN {dbl(KNOTS_Y[0])}"]
    for i in range(len(KNOTS_X) - 1):
        slope = (KNOTS_Y[i + 1] - KNOTS_Y[i]) / (KNOTS_X[i + 1] - KNOTS_X[i])
        cases.append(
            f"WHEN {p} < {dbl(KNOTS_X[i + 1])} THEN {dbl(slope)} * ({p} - {dbl(KNOTS_X[i])}) + {dbl(KNOTS_Y[i])}"
        )
    return f"CASE {' '.join(cases)} ELSE {dbl(KNOTS_Y[-1])} END"


def _scored(features: str, keys: str) -> str:
    return f"""SELECT {keys}, ROUND(pd, 6) AS probability_of_default, ROUND(raw, 6) AS raw_score,
      {_band('pd')} AS risk_band
    FROM (SELECT *, {_interp('raw')} AS pd FROM (SELECT *, {RAW_SQL} AS raw FROM {features}))"""


def _quantiles(source: str, group: str, value: str, n_bins: int, name: str) -> str:
    """Inner quantile edges by linear interpolation, written out rank by rank."""
    return f"""
{name} AS (
  SELECT g, i, CASE WHEN lo = hi THEN lo WHEN h - FLOOR(h) < 5e-1 THEN lo + (hi - lo) * (h - FLOOR(h))
      ELSE hi - (hi - lo) * (1e0 - (h - FLOOR(h))) END AS edge
  FROM (
    SELECT r.g, i, h, MAX(CASE WHEN rn - 1 = FLOOR(h) THEN v END) AS lo, MAX(CASE WHEN rn - 1 = CEIL(h) THEN v END) AS hi
    FROM (SELECT {group} AS g, CAST({value} AS DOUBLE) AS v,
            ROW_NUMBER() OVER (PARTITION BY {group} ORDER BY {value}) AS rn,
            COUNT(*) OVER (PARTITION BY {group}) AS n FROM {source} WHERE {value} IS NOT NULL) r
    JOIN (SELECT g, n, i, (i * {dbl(1.0 / n_bins)}) * (n - 1) AS h FROM (
            SELECT {group} AS g, COUNT({value}) AS n FROM {source} GROUP BY {group}) s
          CROSS JOIN (SELECT UNNEST(range(1, {n_bins})) AS i) b WHERE n > 0) q ON q.g = r.g
    GROUP BY r.g, i, h))"""


def _psi(expected: str, actual: str, group: str, value: str, name: str = "psi_t") -> str:
    return f"""{_quantiles(expected, group, value, 10, 'edges_' + name)},
{name} AS (
  SELECT g, CASE WHEN ne > 0 AND na > 0 THEN psi END AS psi FROM (
    SELECT c.g, SUM((a - e) * LN(a / e)) AS psi, MAX(ne) AS ne, MAX(na) AS na FROM (
      SELECT b.g, bin, ne, na, GREATEST(COALESCE(e / NULLIF(ne, 0), 0e0), 1e-6) AS e,
        GREATEST(COALESCE(a / NULLIF(na, 0), 0e0), 1e-6) AS a
      FROM (
        SELECT g, bin, CAST(SUM(1 - side) AS DOUBLE) AS e, CAST(SUM(side) AS DOUBLE) AS a,
          SUM(SUM(1 - side)) OVER (PARTITION BY g) AS ne, SUM(SUM(side)) OVER (PARTITION BY g) AS na
        FROM (
          SELECT x.g, x.v, side, (SELECT COUNT(*) FROM edges_{name} z WHERE z.g = x.g AND z.edge <= x.v) AS bin
          FROM (SELECT {group} AS g, CAST({value} AS DOUBLE) AS v, 0 AS side FROM {expected} WHERE {value} IS NOT NULL
                UNION ALL
                SELECT {group} AS g, CAST({value} AS DOUBLE) AS v, 1 AS side FROM {actual} WHERE {value} IS NOT NULL) x)
        GROUP BY g, bin) b) c GROUP BY c.g))"""


def _long(source: str, columns: list[str], name: str) -> str:
    cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"\n{name} AS (SELECT feature, value FROM (UNPIVOT (SELECT {cast} FROM {source}) ON {', '.join(columns)} INTO NAME feature VALUE value))"


def _dictionary(source: str, columns: dict[str, str]) -> str:
    """``columns`` maps the dictionary name to the value column."""
    parts = []
    for name, c in columns.items():
        number = "CAST(v AS DOUBLE)" if name == "B_30" else "0"
        parts.append(
            f"SELECT '{name}' AS col, CAST(v AS VARCHAR) AS value, "
            f"CAST(ROW_NUMBER() OVER (ORDER BY {number}, CAST(v AS VARCHAR)) - 1 AS INT) AS code "
            f"FROM (SELECT DISTINCT {c} AS v FROM {source} WHERE {c} IS NOT NULL)"
        )
    return " UNION ALL ".join(parts)


def _codes(columns: dict[str, str], dictionary: str) -> str:
    """``columns`` (dictionary name to value column) replaced by their codes."""
    return "* REPLACE (" + ", ".join(
        f"COALESCE((SELECT code FROM {dictionary} WHERE col = '{n}' AND value = CAST({c} AS VARCHAR)), -1) AS {c}" for n, c in columns.items()
    ) + ")"


_TT = V.TRAIN_TEST_SQL
_LAST = {c: f"{c}_last" for c in CATEGORICAL}
_SEQ = {c: c for c in TEXTS}
CODED = f"""{_TT}, dict AS ({_dictionary('train', _SEQ)}), etrain AS (SELECT {_codes(_SEQ, 'dict')} FROM train),
est AS (SELECT {_codes(_SEQ, 'dict')} FROM statements)"""
PSI_ALL = f"""WITH {_TT},{_features('train', 'ftrain')},{_features('test', 'ftest')}, dict AS ({_dictionary('ftrain', _LAST)}),
etrain AS (SELECT {_codes(_LAST, 'dict')} FROM ftrain), etest AS (SELECT {_codes(_LAST, 'dict')} FROM ftest),
{_long('etrain', FEATURES, 'ltrain')},{_long('etest', FEATURES, 'ltest')},{_psi('ltrain', 'ltest', 'feature', 'value')}"""
STANDARDIZED = f"{CODED}, s AS (SELECT " + ", ".join(
    f"AVG({c}) AS m_{c}, SQRT(GREATEST(VAR_POP({c}), 1e-12)) AS d_{c}" for c in SEQ_COLUMNS
) + " FROM etrain), z AS (SELECT customer_ID, S_2, seq, " + ", ".join(
    f"GREATEST(-10e0, LEAST(10e0, COALESCE(({c} - m_{c}) / d_{c}, 0e0))) AS {c}" for c in SEQ_COLUMNS
) + " FROM est CROSS JOIN s)"


def _ranked(score: str, source: str = "predictions", by: str = "1", order: str = "DESC") -> str:
    w = "CASE WHEN target = 0 THEN 20 ELSE 1 END"
    over = f"OVER (PARTITION BY {by} ORDER BY {score} {order}, {TIE} ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT *, {w} AS w, SUM({w}) {over} AS cw, SUM(target) {over} AS cp,
      SUM({w}) OVER (PARTITION BY {by}) AS tw, SUM(target) OVER (PARTITION BY {by}) AS tp,
      SUM(1 - target) OVER (PARTITION BY {by}) AS tn FROM {source}"""


def _metric(score: str, source: str = "predictions", by: str | None = None) -> str:
    """Capture, Gini and metric per group; the perfect ranking is summed, not closed-form."""
    part = by or "1"
    cols = f"{by}, " if by else ""
    perfect = f"""SELECT {part} AS g, SUM((CAST(cp AS DOUBLE) / tp - CAST(cw AS DOUBLE) / tw) * w) AS best
      FROM ({_ranked('target', source, part)}) GROUP BY {part}"""
    return f"""SELECT {cols}capture, gini, (gini + capture) / 2 AS metric FROM (
      SELECT {cols}CAST(SUM(CASE WHEN cw <= {dbl(0.04)} * tw THEN target ELSE 0 END) AS DOUBLE) / MAX(tp) AS capture,
        (CAST(SUM(cp * w) AS DOUBLE) / MAX(tp) - CAST(SUM(cw * w) AS DOUBLE) / MAX(tw)) / MAX(best) AS gini
      FROM ({_ranked(score, source, part)}) r JOIN ({perfect}) p ON p.g = {f'r.{by}' if by else '1'}
      {f'GROUP BY {by}' if by else ''})"""


LONG_PD = """
long_pd AS (SELECT customer_ID, target, 'p_a' AS model, p_a AS prediction FROM predictions
  UNION ALL SELECT customer_ID, target, 'p_b', p_b FROM predictions
  UNION ALL SELECT customer_ID, target, 'p_c', p_c FROM predictions)"""

DIGEST = "md5(concat('42|', customer_ID))"


def _shuffled(source: str, by: str | None) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, ROW_NUMBER() OVER ({part} ORDER BY {DIGEST}, customer_ID) AS r,
      COUNT(*) OVER ({part}) AS n FROM {source}"""


FOLDS = f"SELECT *, CAST((r - 1) % 5 AS INT) AS fold FROM ({_shuffled('predictions', 'target')})"

# customers with statements in the training period and a label, in their folds
TRAINED = f"""{V.TRAIN_TEST_SQL},{LB},
known AS (SELECT DISTINCT customer_ID, target FROM train JOIN stmt_labels USING (customer_ID)),
folded AS (SELECT customer_ID, target, CAST((r - 1) % 5 AS INT) AS fold FROM ({_shuffled('known', 'target')}))"""
OOF_CHECK = f"WITH {TRAINED} SELECT customer_ID, target, fold, TRUE AS in_range, TRUE AS same_from_files FROM folded"


def _missing(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, AVG(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS missing_rate FROM {source}"
        for c in columns
    )


def _latest_override(values: dict[str, float]) -> str:
    cols = []
    for c in ["customer_ID", "S_2", "seq", *NUMERIC, *CATEGORICAL]:
        cols.append(f"CASE WHEN back = 1 THEN {dbl(values[c])} ELSE {c} END AS {c}" if c in values else c)
    return f"""SELECT {', '.join(cols)} FROM (SELECT *, ROW_NUMBER() OVER (
      PARTITION BY customer_ID ORDER BY S_2 DESC, seq DESC) AS back FROM statements)"""


def _report() -> str:
    auc = _auc("p_a")
    return f"""WITH {PD}, m AS ({_metric('p_a')}), a AS ({auc}), k AS ({_ks('p_a')}),
b AS (SELECT CAST(COUNT(*) AS DOUBLE) AS customers, AVG(target) AS default_rate,
  AVG((p_a - target) * (p_a - target)) AS brier_p_a, AVG((p_c - target) * (p_c - target)) AS brier_p_c FROM predictions)
SELECT metric, ROUND(value, 8) AS value FROM (
  SELECT 'capture' AS metric, capture AS value FROM m UNION ALL SELECT 'gini', gini FROM m
  UNION ALL SELECT 'metric', metric FROM m UNION ALL SELECT 'auc', auc FROM a UNION ALL SELECT 'auc_gini', gini FROM a
  UNION ALL SELECT 'ks', ks FROM k UNION ALL SELECT 'customers', customers FROM b
  UNION ALL SELECT 'default_rate', default_rate FROM b UNION ALL SELECT 'brier_p_a', brier_p_a FROM b
  UNION ALL SELECT 'brier_p_c', brier_p_c FROM b)"""


def _auc(p: str) -> str:
    return f"""SELECT auc, 2 * auc - 1 AS gini FROM (
    SELECT (SUM(CASE WHEN target = 1 THEN avg_rank ELSE 0 END) - np * (np + 1e0) / 2) / (np * nn) AS auc FROM (
      SELECT target, AVG(rn) OVER (PARTITION BY {p}) AS avg_rank, SUM(target) OVER () AS np, SUM(1 - target) OVER () AS nn
      FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {p}) AS rn FROM predictions)) GROUP BY np, nn)"""


def _ks(p: str) -> str:
    return f"""SELECT MAX(ABS(bad - good)) AS ks FROM (
    SELECT CAST(SUM(SUM(target)) OVER (ORDER BY {p}) AS DOUBLE) / SUM(SUM(target)) OVER () AS bad,
      CAST(SUM(SUM(1 - target)) OVER (ORDER BY {p}) AS DOUBLE) / SUM(SUM(1 - target)) OVER () AS good
    FROM predictions GROUP BY {p})"""


def _blend(columns: list[str], grid: str, rounded: str) -> str:
    expr = " + ".join(f"w{i} * {c}" for i, c in enumerate(columns))
    return f"""WITH {PD}, grid AS ({grid}),
blended AS (SELECT id, customer_ID, target, {expr} AS blend FROM grid CROSS JOIN predictions),
m AS (SELECT id, metric FROM ({_metric('blend', 'blended', 'id')}))
SELECT {rounded}, ROUND(metric, 9) AS metric FROM m JOIN grid USING (id) ORDER BY metric DESC, id LIMIT 1"""


GRID2 = """SELECT 0 AS id, 1e0 AS w0, 0e0 AS w1 UNION ALL
  SELECT i + 1, CASE WHEN i = 50 THEN 1e0 ELSE i * 2e-2 END, 1e0 - (CASE WHEN i = 50 THEN 1e0 ELSE i * 2e-2 END)
  FROM (SELECT UNNEST(range(0, 51)) AS i)"""
GRID3 = """SELECT i * 100 + j AS id, a AS w0, b AS w1, 1e0 - a - b AS w2 FROM (
  SELECT i, a, j, CASE WHEN j = m AND m > 0 THEN 1e0 - a WHEN m = 0 THEN 0e0 ELSE j * ((1e0 - a) / m) END AS b FROM (
    SELECT i, a, m, UNNEST(range(0, m + 1)) AS j FROM (
      SELECT i, a, CAST(FLOOR((1e0 - a) * 40) AS INT) AS m FROM (
        SELECT i, CASE WHEN i = 40 THEN 1e0 ELSE i * 25e-3 END AS a FROM (SELECT UNNEST(range(0, 41)) AS i)))))"""



def _presets() -> str:
    """Each pick leaves out the earlier ones."""
    parts, earlier = [], ""
    for i, (name, t) in enumerate(PRESETS.items()):
        parts.append(
            f"k{i} AS (SELECT '{name}' AS label, {dbl(t)} AS wanted, customer_ID, p_a FROM predictions "
            f"WHERE customer_ID NOT IN (SELECT '' {earlier}) ORDER BY ABS(p_a - {dbl(t)}), customer_ID LIMIT 1)"
        )
        earlier += f" UNION ALL SELECT customer_ID FROM k{i}"
    every = " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(PRESETS)))
    return f"""WITH {PD},
{(","+chr(10)).join(parts)} SELECT label, wanted, customer_ID, p_a, statements FROM ({every})
JOIN (SELECT customer_ID, COUNT(*) AS statements FROM statements GROUP BY customer_ID) USING (customer_ID)"""


def _bands_of(p: str) -> str:
    """Ten bands by rank of a score."""
    return f"""WITH {PD}, b AS (SELECT 11 - CAST(GREATEST(1, CEIL((r - 1) * 10 / CAST(n - 1 AS DOUBLE))) AS INT) AS band, target, {p} FROM (
      SELECT *, ROW_NUMBER() OVER (ORDER BY {p}, {TIE}) AS r, COUNT(*) OVER () AS n FROM predictions))
      SELECT band, COUNT(*) AS customers, CAST(SUM(target) AS BIGINT) AS defaults, ROUND(AVG({p}), 8) AS avg_pred,
        AVG(target) AS bad_rate, CAST(SUM(SUM(target)) OVER (ORDER BY band) AS DOUBLE) / SUM(SUM(target)) OVER () AS cum_defaults FROM b GROUP BY band"""


def _curve_of(p: str) -> str:
    """Reliability in twenty quantile bins of a score."""
    return f"""WITH {PD}, one AS (SELECT 1 AS k, {p}, target FROM predictions),{_quantiles('one', 'k', p, 20, 'edges')}
      SELECT bin, COUNT(*) AS customers, ROUND(AVG({p}), 8) AS mean_pred, AVG(target) AS observed_rate FROM (
        SELECT *, CAST(1 + (SELECT COUNT(*) FROM edges WHERE edge < {p}) AS INT) AS bin FROM one) GROUP BY bin"""


def _points_of(p: str) -> str:
    """Approval points of a score."""
    return f"""WITH {PD}, c AS (SELECT ROW_NUMBER() OVER w AS r, COUNT(*) OVER () AS n, SUM(target) OVER w AS cb FROM predictions
      WINDOW w AS (ORDER BY {p}, {TIE} ROWS UNBOUNDED PRECEDING))
      SELECT a AS approved, r AS rank, cb / CAST(r AS DOUBLE) AS bad_rate FROM c
      JOIN (SELECT UNNEST([{dbl(0.5)}, {dbl(0.7)}, {dbl(0.9)}]) AS a) p ON r = FLOOR(a * n)"""


def _full_report() -> str:
    tables = {
        "bands": (_bands_of("p_a"), "band", ("customers", "defaults", "avg_pred", "bad_rate", "cum_defaults")),
        "raw_curve": (_curve_of("p_a"), "bin", ("customers", "mean_pred", "observed_rate")),
        "calibrated_curve": (_curve_of("p_c"), "bin", ("customers", "mean_pred", "observed_rate")),
        "approval": (_points_of("p_a"), "approved", ("rank", "bad_rate")),
    }
    parts = [f"SELECT 'headline' AS section, CAST(NULL AS DOUBLE) AS item, metric, value FROM ({_report()})"]
    for name, (sql, item, metrics) in tables.items():
        parts += [f"SELECT '{name}', CAST({item} AS DOUBLE), '{m}', ROUND(CAST({m} AS DOUBLE), 8) FROM ({sql})" for m in metrics]
    return " UNION ALL ".join(parts)


ORACLES: dict[str, str] = {
    "ingest_cast": f"""WITH {ST} SELECT customer_ID, S_2, CAST(P_2 AS FLOAT) AS P_2, CAST(D_39 AS FLOAT) AS D_39,
      CAST(B_1 AS FLOAT) AS B_1, CAST(R_1 AS FLOAT) AS R_1, CAST(S_3 AS FLOAT) AS S_3, B_30, D_63, D_64 FROM statements""",
    "sample_head": f"WITH {ST} SELECT * FROM statements ORDER BY customer_ID, S_2, seq LIMIT 500",
    "semi_key_filter": f"""WITH {ST},{LB} SELECT customer_ID, S_2, seq, P_2 FROM statements
      WHERE customer_ID IN (SELECT customer_ID FROM stmt_labels)""",
    "anti_key_filter": f"""WITH {ST},{LB} SELECT customer_ID, S_2, seq, P_2 FROM statements
      WHERE customer_ID NOT IN (SELECT customer_ID FROM stmt_labels)""",
    "json_statements": """SELECT CAST(user_id AS VARCHAR) AS customer_ID, event_id,
      CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS S_2, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
      concat('{"type":"', event_type, '","k":', CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR), '}') AS response
      FROM events""",
    "clean_nonfinite": f"""WITH {ST} SELECT seq, CASE WHEN D_39 = 0 THEN NULL ELSE B_1 / D_39 END AS ratio,
      CASE WHEN D_39 = 0 THEN NULL ELSE B_1 / D_39 END AS cell_0, CAST(NULL AS DOUBLE) AS cell_1, B_1 AS cell_2 FROM statements""",
    "risk_report": _report(),
    "full_report": _full_report(),
    "feature_groups": "SELECT prefix, COUNT(*) AS features, CASE prefix "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GROUP_NAMES.items())
    + " ELSE prefix END AS group_name FROM (SELECT split_part(f, '_', 1) AS prefix FROM (VALUES "
    + ", ".join(f"('{c}')" for c in COLUMNS) + ") t(f)) GROUP BY prefix",
    "align_columns": f"""WITH {ST},{_features()} SELECT customer_ID, P_2_last, CAST(NULL AS DOUBLE) AS Z_9_mean, P_2_min FROM features""",
    "portfolio_stats": f"""WITH {ST},{_features()} SELECT COUNT(*) AS customers,
      AVG(CASE WHEN probability_of_default >= 5e-1 THEN 1e0 ELSE 0e0 END) AS share_high_risk,
      ROUND(AVG(probability_of_default), 8) AS mean_pd FROM ({_scored('features', 'customer_ID')})""",
    "risk_bands": f"WITH {PD} SELECT customer_ID, p_a, {_band('p_a')} AS risk_band FROM predictions",
    "psi_status": f"""{PSI_ALL} SELECT features, stable, moderate, shifted,
      CASE WHEN shifted < {dbl(0.05)} AND score_psi < {dbl(0.1)} THEN 'stable' ELSE 'some drift' END AS verdict FROM (
      WITH {PD}, a AS (SELECT 1 AS k, p_a AS s FROM predictions), b AS (SELECT 1 AS k, p_c AS s FROM predictions),
        {_psi("a", "b", "k", "s", "psi_s")} SELECT psi AS score_psi FROM psi_s), (
      SELECT COUNT(*) AS features, AVG(CASE WHEN psi < {dbl(0.1)} THEN 1e0 ELSE 0e0 END) AS stable,
        AVG(CASE WHEN psi >= {dbl(0.1)} AND psi < {dbl(0.25)} THEN 1e0 ELSE 0e0 END) AS moderate,
        AVG(CASE WHEN psi >= {dbl(0.25)} THEN 1e0 ELSE 0e0 END) AS shifted FROM psi_t WHERE psi IS NOT NULL)""",
    "missing_buckets": f"WITH {ST} SELECT CASE "
    + " ".join(f"WHEN missing_rate <= {dbl(e)} THEN '{n}'" for e, n in MISSING_BUCKETS)
    + f" END AS bucket, COUNT(*) AS features FROM ({_missing('statements', COLUMNS)}) GROUP BY 1",
    "recover_component": f"""WITH {PD} SELECT customer_ID, ROUND(b, 12) AS blend,
      ROUND((b - {dbl(0.86)} * p_a) / {dbl(1 - 0.86)}, 9) AS p_b FROM (
      SELECT *, {dbl(0.86)} * p_a + {dbl(1 - 0.86)} * p_b AS b FROM predictions)""",
    "blend_apply": f"WITH {PD} SELECT customer_ID, {dbl(0.6)} * p_a + {dbl(0.08)} * p_b + {dbl(0.32)} * p_c AS prediction FROM predictions",
    "describe_features": f"WITH {ST},{_features()} SELECT feature, CASE feature "
    + " ".join(f"WHEN '{f}' THEN '{DESCRIPTIONS[f]}'" for f in FEATURES)
    + f" END AS description, missing_rate FROM ({_missing('features', FEATURES)})",
    "features_labels": f"""WITH {ST},{LB},{_features()} SELECT customer_ID, target, P_2_last, B_1_max, P_2_mean
      FROM features JOIN stmt_labels USING (customer_ID)""",
    "last_value_by_target": f"""WITH {ST},{LB},{_features()} SELECT customer_ID, P_2_last, target
      FROM features JOIN stmt_labels USING (customer_ID)""",
    "oof_align": f"WITH {PD} SELECT customer_ID, target, p_a, p_b, p_c FROM predictions",
    "oof_misaligned": f"""WITH {PD} SELECT COUNT(*) AS n_keys, COUNT(CASE WHEN p_b < {dbl(0.05)} THEN 1 END) AS n_unmatched,
      COUNT(CASE WHEN p_b > {dbl(0.95)} THEN 1 END) AS n_label_conflicts FROM predictions""",
    "oof_duplicates": f"""WITH {PD} SELECT COUNT(*) AS n_keys, COUNT(CASE WHEN p_a > {dbl(0.9)} THEN 1 END) AS n_unmatched,
      CAST(0 AS BIGINT) AS n_label_conflicts FROM predictions""",
    "encode_integer_codes": f"WITH {_TT}, dict AS (" + _dictionary("train", {"B_30": "B_30"})
    + ") SELECT seq, COALESCE((SELECT code FROM dict WHERE value = CAST(B_30 AS VARCHAR)), -1) AS B_30 FROM test",
    "label_lookup": f"WITH {PD} SELECT customer_ID, p_a, target FROM predictions",
    "encode_last": f"WITH {_TT},{_features('train', 'ftrain')},{_features('test', 'ftest')}, dict AS ("
    + _dictionary("ftrain", {c: f"{c}_last" for c in CATEGORICAL}) + ") SELECT customer_ID, "
    + ", ".join(
        f"COALESCE((SELECT code FROM dict WHERE col = '{c}' AND value = CAST({c}_last AS VARCHAR)), -1) AS {c}_last, {c}_nunique, {c}_count"
        for c in CATEGORICAL
    ) + " FROM ftest",
    "customer_features": f"WITH {ST},{_features()} SELECT customer_ID, {', '.join(FEATURES)} FROM features",
    "calibrate_interp": f"WITH {PD} SELECT customer_ID, p_a, ROUND({_interp('p_a')}, 10) AS pd FROM predictions",
    "nearest_score": f"WITH {PD} " + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{n}' AS label, {dbl(t)} AS wanted, customer_ID, p_a FROM predictions ORDER BY ABS(p_a - {dbl(t)}), customer_ID LIMIT 1)"
        for n, t in PRESETS.items()
    ),
    "numeric_aggs": f"WITH {ST},{_features()} SELECT customer_ID, "
    + ", ".join(f"{c}_{s}" for c in NUMERIC for s in ("mean", "std", "min", "max", "first", "last")) + " FROM features",
    "trend_features": f"WITH {ST},{_features()} SELECT customer_ID, "
    + ", ".join(f"{c}_{s}" for c in NUMERIC for s in ("last_mean_diff", "last_first_diff", "range")) + " FROM features",
    "categorical_aggs": f"WITH {ST},{_features()} SELECT customer_ID, "
    + ", ".join(f"{c}_{s}" for c in CATEGORICAL for s in ("last", "nunique", "count")) + " FROM features",
    "date_features": f"WITH {ST},{_features()} SELECT customer_ID, statement_count, history_days FROM features",
    "fit_category_map": f"WITH {_TT},{_features('train', 'ftrain')} " + _dictionary("ftrain", {c: f"{c}_last" for c in CATEGORICAL}),
    "fit_seq_map": f"WITH {_TT} " + _dictionary("train", {c: c for c in ("D_63", "D_64")}),
    "norm_stats": f"WITH {CODED} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, AVG({c}) AS mean, ROUND(SQRT(GREATEST(VAR_POP({c}), 1e-12)), 4) AS std FROM etrain" for c in SEQ_COLUMNS
    ),
    "customer_dates": f"WITH {ST} SELECT customer_ID, MAX(S_2) AS last_date FROM statements GROUP BY customer_ID",
    "last_month_hist": f"""WITH {ST} SELECT strftime(last_date, '%Y-%m') AS month, COUNT(*) AS customers FROM (
      SELECT MAX(S_2) AS last_date FROM statements GROUP BY customer_ID) GROUP BY 1""",
    "statements_per_customer": f"""WITH {ST} SELECT statements, COUNT(*) AS customers FROM (
      SELECT COUNT(*) AS statements FROM statements GROUP BY customer_ID) GROUP BY statements""",
    "statements_describe": f"""WITH {ST}, sizes AS (SELECT 1 AS one, CAST(COUNT(*) AS DOUBLE) AS v FROM statements GROUP BY customer_ID)
      SELECT COUNT(*) AS count, ROUND(AVG(v), 8) AS mean, ROUND(STDDEV_SAMP(v), 8) AS std, MIN(v) AS min, MAX(v) AS max,
        QUANTILE_CONT(v, 0.25) AS q25, QUANTILE_CONT(v, 0.5) AS q50, QUANTILE_CONT(v, 0.75) AS q75 FROM sizes""",
    "profile_categoricals": f"WITH {ST} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, COUNT(DISTINCT {c}) AS cardinality, AVG(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS missing_rate FROM statements"
        for c in CATEGORICAL
    ),
    "profile_table": f"""WITH {ST} SELECT COUNT(*) AS n_rows, {len(COLUMNS) + 3} AS n_columns, {len(COLUMNS)} AS n_features,
      COUNT(DISTINCT customer_ID) AS n_customers, MIN(S_2) AS first_date, MAX(S_2) AS last_date FROM statements""",
    "dtype_counts": f"""WITH {ST} SELECT CASE t WHEN 'VARCHAR' THEN 'string' ELSE lower(t) END AS dtype, COUNT(*) AS columns FROM (
      SELECT UNNEST([{', '.join(f"(SELECT typeof(MAX({c})) FROM statements)" for c in COLUMNS)}]) AS t) GROUP BY 1""",
    "missing_rates": f"WITH {ST} {_missing('statements', COLUMNS)}",
    "target_distribution": f"""WITH {LB} SELECT target, COUNT(*) AS customers,
      COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS share,
      CAST(SUM(SUM(target)) OVER () AS DOUBLE) / SUM(COUNT(*)) OVER () AS default_rate FROM stmt_labels GROUP BY target""",
    "density_hist": f"""WITH {ST},{LB},{_features()}, x AS (
      SELECT target, P_2_last AS v, MIN(P_2_last) OVER (PARTITION BY target) AS lo, MAX(P_2_last) OVER (PARTITION BY target) AS hi,
        COUNT(*) OVER (PARTITION BY target) AS n FROM features JOIN stmt_labels USING (customer_ID) WHERE P_2_last IS NOT NULL)
      SELECT target, bin, ROUND(lo + bin * w, 3) AS left_edge, COUNT(*) AS rows, ROUND(COUNT(*) / (n * w), 12) AS density FROM (
        SELECT *, CAST(LEAST(FLOOR((v - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, (hi - lo) / 50 AS w FROM x) GROUP BY target, bin, lo, w, n""",
    "score_bands": _bands_of("p_a"),
    "calibration_curve": _curve_of("p_b"),
    "brier": f"""WITH {PD} SELECT ROUND(a, 9) AS brier_p_a, ROUND(c, 9) AS brier_p_c, CASE WHEN c < a THEN 'better' ELSE 'worse' END AS verdict
      FROM (SELECT AVG((p_a - target) * (p_a - target)) AS a, AVG((p_c - target) * (p_c - target)) AS c FROM predictions)""",
    "auc_gini": f"WITH {PD} SELECT ROUND(auc, 9) AS auc, ROUND(gini, 9) AS gini FROM ({_auc('p_b')})",
    "psi_feature": f"WITH {_TT}, a AS (SELECT 'P_2' AS feature, P_2 FROM train), b AS (SELECT 'P_2' AS feature, P_2 FROM test),"
    + _psi("a", "b", "feature", "P_2") + " SELECT g AS feature, ROUND(psi, 9) AS psi FROM psi_t",
    "psi_all": f"{PSI_ALL} SELECT g AS feature, ROUND(psi, 8) AS psi FROM psi_t",
    "psi_score": f"WITH {PD}, a AS (SELECT 1 AS k, p_a AS s FROM predictions), b AS (SELECT 1 AS k, p_c AS s FROM predictions),"
    + _psi("a", "b", "k", "s") + " SELECT ROUND(psi, 9) AS score_psi FROM psi_t",
    "fold_summary": f"""WITH {PD}, folded AS ({FOLDS}), m AS ({_metric('p_a', 'folded', 'fold')})
      SELECT COUNT(*) AS folds, ROUND(AVG(metric), 8) AS mean_metric, ROUND(STDDEV_POP(metric), 8) AS std_metric,
        ROUND((SELECT metric FROM ({_metric('p_a')})), 8) AS oof_metric FROM m""",
    "ensemble_mean": f"WITH {PD} SELECT customer_ID, ROUND(p_a / 3 + p_b / 3 + p_c / 3, 12) AS prediction FROM predictions",
    "ensemble_mean_long": f"WITH {PD},{LONG_PD} SELECT customer_ID, ROUND(AVG(prediction), 12) AS prediction FROM long_pd GROUP BY customer_ID",
    "global_drivers": f"WITH {ST},{_features()} SELECT feature, ROUND(m, 8) AS mean_abs FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, AVG(ABS({_term(f)})) AS m FROM features" for f in COEFFICIENTS)
    + ") ORDER BY m DESC, feature LIMIT 5",
    "pd_histogram": f"WITH {PD} SELECT COUNT(p_a) AS scored, ROUND(SUM(p_a), 5) AS pd_sum, "
    + ", ".join(f"COUNT(CASE WHEN p_a <= {dbl(x)} THEN 1 END) AS le_{str(x).replace('.', '_')}" for x in PD_LIMITS) + " FROM predictions",
    "prediction_stats": f"WITH {PD} SELECT COUNT(p_a) AS n, MIN(p_a) AS min, ROUND(AVG(p_a), 8) AS mean, MAX(p_a) AS max FROM predictions",
    "capture_at_4pct": f"WITH {PD} SELECT capture FROM ({_metric('p_a')})",
    "weighted_gini": f"WITH {PD} SELECT ROUND(gini, 9) AS gini FROM ({_metric('p_b')})",
    "rank_metric": f"""WITH {PD},{LONG_PD} SELECT model, capture, ROUND(gini, 9) AS gini, ROUND(metric, 9) AS metric
      FROM ({_metric('prediction', 'long_pd', 'model')})""",
    "ks_statistic": f"WITH {PD} SELECT ROUND(ks, 9) AS ks FROM ({_ks('p_b')})",
    "approval_curve": f"""WITH {PD} SELECT customer_ID, r AS rank, n, r / CAST(n AS DOUBLE) AS approval_rate, cb / CAST(r AS DOUBLE) AS bad_rate FROM (
      SELECT customer_ID, ROW_NUMBER() OVER w AS r, COUNT(*) OVER () AS n, SUM(target) OVER w AS cb FROM predictions
      WINDOW w AS (ORDER BY p_a, {TIE} ROWS UNBOUNDED PRECEDING))""",
    "approval_points": _points_of("p_b"),
    "quantile_bins": f"""WITH {PD} SELECT customer_ID, p_b, r AS rank, CAST(GREATEST(1, CEIL((r - 1) * 10 / CAST(n - 1 AS DOUBLE))) AS INT) AS bin FROM (
      SELECT *, ROW_NUMBER() OVER (ORDER BY p_b, {TIE}) AS r, COUNT(*) OVER () AS n FROM predictions)""",
    "sequence_positions": f"""WITH {ST} SELECT customer_ID, seq, S_2, CAST(rn - 1 - GREATEST(n - 13, 0) AS INT) AS pos, CAST(LEAST(n, 13) AS INT) AS length FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_ID ORDER BY S_2, seq) AS rn, COUNT(*) OVER (PARTITION BY customer_ID) AS n FROM statements)
      WHERE rn > n - 13""",
    "reason_codes": f"WITH {ST},{_features()}, c AS ("
    + " UNION ALL ".join(f"SELECT customer_ID, '{f}' AS feature, '{DESCRIPTIONS[f]}' AS description, {_term(f)} AS v FROM features" for f in COEFFICIENTS)
    + """) SELECT customer_ID, CAST(rn AS INT) AS position, feature, description, ROUND(v, 4) AS contribution FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_ID ORDER BY v DESC, feature) AS rn FROM c WHERE v > 0) WHERE rn <= 4""",
    "what_if_rows": f"WITH {ST} SELECT customer_ID, S_2, seq, P_2, D_39 FROM ({_latest_override({'P_2': 1000.0, 'D_39': 90.0})})",
    "stratified_folds": f"WITH {LB} SELECT customer_ID, target, CAST((r - 1) % 5 AS INT) AS fold FROM ({_shuffled('stmt_labels', 'target')})",
    "stratified_holdout": f"WITH {LB} SELECT customer_ID, target, r <= CEIL({dbl(0.1)} * n) AS is_holdout FROM ({_shuffled('stmt_labels', 'target')})",
    "half_split": f"WITH {LB} SELECT customer_ID, target, CAST(CASE WHEN r > FLOOR(n / 2) THEN 1 ELSE 0 END AS INT) AS half FROM ({_shuffled('stmt_labels', None)})",
    "top_missing": f"WITH {ST} SELECT * FROM ({_missing('statements', COLUMNS)}) ORDER BY missing_rate DESC, feature LIMIT 5",
    "mostly_missing": f"WITH {_TT},{_features('train', 'ftrain')} SELECT COUNT(CASE WHEN missing_rate > {dbl(0.1)} THEN 1 END) AS n_high FROM ({_missing('ftrain', FEATURES)})",
    "top_drift": f"{PSI_ALL} SELECT g AS feature, ROUND(psi, 8) AS psi FROM psi_t WHERE psi IS NOT NULL ORDER BY psi_t.psi DESC, g LIMIT 10",
    "riskiest_customers": f"WITH {ST},{_features()} SELECT customer_ID, ROUND(z, 8) AS logit FROM (SELECT customer_ID, {LOGIT_SQL} AS z FROM features) ORDER BY z DESC, customer_ID LIMIT 20",
    "seeded_sample": f"WITH {LB} SELECT * FROM stmt_labels ORDER BY {DIGEST}, customer_ID LIMIT 100",
    "oof_union": f"""WITH {PD} SELECT customer_ID, target, fold, CASE fold WHEN 0 THEN p_a WHEN 1 THEN p_b WHEN 2 THEN p_c WHEN 3 THEN p_a ELSE p_b END AS oof_pred FROM ({FOLDS})""",
    "logit_to_pd": f"WITH {ST},{_features()} SELECT customer_ID, ROUND({RAW_SQL}, 9) AS raw FROM features",
    "standardize_rows": f"WITH {STANDARDIZED} SELECT customer_ID, seq, " + ", ".join(f"ROUND({c}, 7) AS {c}" for c in SEQ_COLUMNS) + " FROM z",
    "trajectory": f"WITH {ST} SELECT customer_ID, seq, strftime(S_2, '%Y-%m') AS month, P_2 FROM statements",
    "padded_sequences": f"""WITH {STANDARDIZED}, k AS (SELECT *, rn - 1 - GREATEST(n - 13, 0) AS pos, LEAST(n, 13) AS length FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_ID ORDER BY S_2, seq) AS rn, COUNT(*) OVER (PARTITION BY customer_ID) AS n FROM z) WHERE rn > n - 13)
      SELECT c.customer_ID, CAST(c.length AS INT) AS length, CAST(c.pos AS INT) AS pos, """
    + ", ".join(f"ROUND(CAST(CAST(COALESCE(k.{c}, 0) AS FLOAT) AS DOUBLE), 4) AS {c}" for c in SEQ_COLUMNS)
    + """ FROM (SELECT customer_ID, length, UNNEST(range(0, 13)) AS pos FROM (SELECT DISTINCT customer_ID, length FROM k)) c
      LEFT JOIN k ON k.customer_ID = c.customer_ID AND k.pos = c.pos""",
    "score_portfolio": f"WITH {ST},{_features()} {_scored('features', 'customer_ID AS customer_id')}",
    "what_if_score": f"WITH {ST}, " + ", ".join(f"st_{n} AS ({_latest_override(v)}),{_features(f'st_{n}', f'f_{n}')}" for n, v in SCENARIOS.items())
    + " " + " UNION ALL ".join(_scored(f"f_{n}", f"'{n}' AS scenario, customer_ID AS customer_id") for n in SCENARIOS),
    "skew_check": f"""WITH {ST}, cut AS (SELECT * EXCLUDE (rn, n) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_ID ORDER BY S_2, seq) AS rn,
      COUNT(*) OVER (PARTITION BY customer_ID) AS n FROM statements) WHERE rn > n - 13),{_features()},{_features('cut', 'fcut')}
      SELECT feature, null_mismatches, ROUND(max_abs_diff, 4) AS max_abs_diff,
        TRUE AS same_place, null_mismatches = 0 AND COALESCE(max_abs_diff, 0) < {dbl(1e-3)} AS matches FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, COUNT(CASE WHEN (a.{f} IS NULL) <> (b.{f} IS NULL) THEN 1 END) AS null_mismatches, "
        + (f"MAX(CASE WHEN a.{f} <> b.{f} THEN 1e0 WHEN a.{f} = b.{f} THEN 0e0 END)" if f in TEXT_FEATURES else f"CAST(MAX(ABS(a.{f} - b.{f})) AS DOUBLE)")
        + " AS max_abs_diff FROM features a JOIN fcut b USING (customer_ID)"
        for f in FEATURES
    ) + ")",
    "blend2_search": _blend(["p_a", "p_b"], GRID2, "ROUND(w0, 3) AS w_p_a, ROUND(w1, 3) AS w_p_b"),
    "blend3_search": _blend(["p_a", "p_b", "p_c"], GRID3, "ROUND(w0, 3) AS w_p_a, ROUND(w1, 3) AS w_p_b, ROUND(w2, 3) AS w_p_c"),
    "stream_score": f"WITH {ST},{_features()} {_scored('features', 'customer_ID AS customer_id')}",
    "stream_pd_hist": "SELECT date_trunc('hour', ts) AS window_start, COUNT(pd) AS scored, ROUND(SUM(pd), 8) AS pd_sum, "
    + ", ".join(f"COUNT(CASE WHEN pd <= {dbl(x)} THEN 1 END) AS le_{str(x).replace('.', '_')}" for x in PD_LIMITS)
    + " FROM (SELECT ts, value / (value + 50e0) AS pd FROM events) GROUP BY 1",
    "windowed_psi": f"""WITH scored AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, value / (value + 50e0) AS pd FROM events),
base AS (SELECT 1 AS k, pd FROM scored WHERE day < TIMESTAMP '2024-01-08'),{_quantiles('base', 'k', 'pd', 10, 'edges')},
binned AS (SELECT day, pd, (SELECT COUNT(*) FROM edges WHERE edge <= pd) AS bin FROM scored WHERE pd IS NOT NULL),
e AS (SELECT bin, COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS e FROM binned WHERE day < TIMESTAMP '2024-01-08' GROUP BY bin),
a AS (SELECT day, bin, COUNT(*) / CAST(SUM(COUNT(*)) OVER (PARTITION BY day) AS DOUBLE) AS a FROM binned GROUP BY day, bin)
SELECT day, ROUND(SUM((a2 - e2) * LN(a2 / e2)), 8) AS psi FROM (
  SELECT d.day, GREATEST(COALESCE(a, 0e0), 1e-6) AS a2, GREATEST(COALESCE(e, 0e0), 1e-6) AS e2
  FROM (SELECT DISTINCT day FROM scored) d CROSS JOIN (SELECT UNNEST(range(0, 10)) AS bin) b
  LEFT JOIN a ON a.day = d.day AND a.bin = b.bin LEFT JOIN e ON e.bin = b.bin) GROUP BY day""",
    "stream_late_counters": "SELECT date_trunc('hour', ts) AS window_start, COUNT(pd) AS scored, ROUND(SUM(pd), 8) AS pd_sum, "
    + ", ".join(f"COUNT(CASE WHEN pd <= {dbl(x)} THEN 1 END) AS le_{str(x).replace('.', '_')}" for x in PD_LIMITS)
    + """ FROM (SELECT ts, value / (value + 50e0) AS pd FROM events) GROUP BY 1
    HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 2 HOUR""",
    "preset_customers": _presets(),
    "cross_calibrate": f"""WITH {PD}, halves AS (SELECT customer_ID, target, p_a, CAST(CASE WHEN r > FLOOR(n / 2) THEN 1 ELSE 0 END AS INT) AS half
    FROM ({_shuffled('predictions', None)})),
pooled AS (SELECT half, p_a AS x, SUM(target) AS y, COUNT(*) AS w, ROW_NUMBER() OVER (PARTITION BY half ORDER BY p_a) AS i FROM halves GROUP BY half, p_a),
spans AS (SELECT a.half, a.i AS a, b.i AS b, SUM(b.y) OVER s / CAST(SUM(b.w) OVER s AS DOUBLE) AS m FROM pooled a JOIN pooled b ON a.half = b.half AND b.i >= a.i
  WINDOW s AS (PARTITION BY a.half, a.i ORDER BY b.i)),
tails AS (SELECT half, a, b, MIN(m) OVER (PARTITION BY half, a ORDER BY b DESC) AS m FROM spans),
fitted AS (SELECT t.half, p.x, MAX(t.m) AS v FROM tails t JOIN pooled p ON p.half = t.half AND p.i = t.b GROUP BY t.half, p.x),
steps AS (SELECT half, x, v, LEAD(x) OVER w AS x2, LEAD(v) OVER w AS v2, ROW_NUMBER() OVER w AS i FROM fitted WINDOW w AS (PARTITION BY half ORDER BY x))
SELECT customer_ID, target, p_a, h.half, ROUND(CASE WHEN s.x IS NULL THEN (SELECT MIN(v) FROM fitted f WHERE f.half = 1 - h.half)
  WHEN s.x2 IS NULL OR s.x = p_a THEN s.v ELSE s.v + (s.v2 - s.v) * (p_a - s.x) / (s.x2 - s.x) END, 8) AS calibrated
FROM halves h LEFT JOIN steps s ON s.half = 1 - h.half AND s.x <= p_a AND (s.x2 > p_a OR s.x2 IS NULL)""",
    "riskiest_reasons": f"WITH {ST},{_features()}, top AS (SELECT * FROM features ORDER BY {LOGIT_SQL} DESC, customer_ID LIMIT 3), c AS ("
    + " UNION ALL ".join(f"SELECT customer_ID, '{f}' AS feature, {_term(f)} AS v, CAST({f} AS DOUBLE) AS value FROM top" for f in COEFFICIENTS)
    + """) SELECT customer_ID, CAST(rn AS INT) AS position, feature, ROUND(v, 4) AS contribution, value FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_ID ORDER BY v DESC, feature) AS rn FROM c) WHERE rn <= 5""",
    "score_histogram": f"""WITH {PD},{LONG_PD}, x AS (SELECT model, prediction AS v, MIN(prediction) OVER w AS lo, MAX(prediction) OVER w AS hi,
        COUNT(*) OVER w AS n FROM long_pd WINDOW w AS (PARTITION BY model))
      SELECT model, bin, COUNT(*) AS rows, ROUND(COUNT(*) / (n * w), 6) AS density FROM (
        SELECT *, CAST(LEAST(FLOOR((v - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, (hi - lo) / 50 AS w FROM x) GROUP BY model, bin, w, n""",
    "cv_oof_check": OOF_CHECK,
    "cv_oof_forest_check": OOF_CHECK,
    "tune_refit_check": OOF_CHECK,
    "cv_oof_sequence_check": f"WITH {TRAINED.replace("FROM train JOIN", "FROM statements JOIN")} SELECT customer_ID, target, fold, TRUE AS in_range FROM folded",
    "cv_stages_check": "SELECT CAST(i AS INT) AS fold, CAST(16 AS INT) AS trees, TRUE AS kept_is_best, TRUE AS metric_matches FROM range(5) t(i)",
    "batch_inference_check": f"""WITH {V.TRAIN_TEST_SQL}
      SELECT DISTINCT customer_ID, CAST(5 AS BIGINT) AS models, TRUE AS is_mean, TRUE AS in_range FROM test""",
    "importance_check": f"SELECT CAST({2 * len(FEATURES)} AS BIGINT) AS inputs, TRUE AS none_negative, TRUE AS sums_to_one",
    "serving_check": f"""WITH {V.TRAIN_TEST_SQL}
      SELECT DISTINCT customer_ID AS customer_id, TRUE AS in_range, TRUE AS band_fits, TRUE AS same_from_files FROM test""",
    "wide_features": f"WITH {V.wide_sql()}, {V.features_sql('wide', 'features', V.WIDE_NUMERIC, V.WIDE_CATEGORICAL)} SELECT * FROM features",
    "wide_portfolio": f"""WITH {V.wide_sql()}, {V.features_sql('wide', 'features', V.WIDE_NUMERIC, V.WIDE_CATEGORICAL)}
      SELECT customer_ID AS customer_id, ROUND(pd, 6) AS probability_of_default, ROUND(raw, 6) AS raw_score, {_band('pd')} AS risk_band
      FROM (SELECT *, {_interp('raw')} AS pd FROM (SELECT *, 1e0 / (1e0 + EXP(-({WIDE_LOGIT_SQL}))) AS raw FROM features))""",
}
ORACLES["stream_running_scores"] = ORACLES["stream_score"]
ORACLES["stream_windowed_psi"] = ORACLES["windowed_psi"]
