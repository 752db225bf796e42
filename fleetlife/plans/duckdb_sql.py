"""The registered queries once more, as DuckDB SQL on the test tables, for comparison."""

from __future__ import annotations

from fleetlife.models.survival import PERIOD_ENDS
from fleetlife.contracts import DRIFT_CATEGORICAL, DRIFT_NUMERIC, RISK_BIN_EDGES, RISK_BIN_NAMES, SMART_BIG5, WINDOWS, rolling_columns
from fleetlife.plans.registry import CUT_INPUTS, FIXED_EFFECTS, SLOPE_POINT, SPARSE_WINDOWS
from fleetlife.sources.testdata import EVENT_SETTINGS as S
from fleetlife.sources.testdata import FATAL_ERRORS

SMART = ", ".join(SMART_BIG5)


def _span(span, column: str = "date") -> str:
    return f"{column} BETWEEN DATE '{span.first}' AND DATE '{span.last}'"


def _kind(function: str, kind: str) -> str:
    return f"{function}(CASE WHEN event_type = '{kind}' THEN value END)"


EVENTS = f"""
unit_day AS (
  SELECT user_id, CAST(ts AS DATE) AS date,
    round({_kind('sum', 'error')}, 4) AS smart_5_raw,
    CAST(nullif({_kind('count', 'click')}, 0) AS DOUBLE) AS smart_187_raw,
    round({_kind('sum', 'view')}, 4) AS smart_188_raw,
    {_kind('max', 'purchase')} AS smart_197_raw,
    round({_kind('sum', 'signup')}, 4) AS smart_198_raw,
    CASE WHEN {_kind('count', 'error')} >= {FATAL_ERRORS} THEN 1 ELSE 0 END AS failure
  FROM events GROUP BY ALL),
lived AS (
  SELECT *, CAST(coalesce(sum(failure) OVER (PARTITION BY user_id ORDER BY date
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS life FROM unit_day),
panel AS (
  SELECT concat('U', user_id, '-', life) AS serial_number, date,
    concat('M', user_id % 5, '-', life) AS model,
    CAST((4 + 2 * (user_id % 5)) * 1000000000000 AS BIGINT) AS capacity_bytes, failure, {SMART}
  FROM lived)"""

LINEITEM = f"""
unit_day AS (
  SELECT l_partkey, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS smart_5_raw,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS smart_187_raw,
    round(sum(l_extendedprice), 2) AS smart_188_raw, max(l_discount) AS smart_197_raw,
    max(l_tax) AS smart_198_raw
  FROM lineitem GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN lead(date) OVER (PARTITION BY l_partkey ORDER BY date) IS NULL
    AND smart_187_raw IS NOT NULL THEN 1 ELSE 0 END AS failure FROM unit_day),
panel AS (
  SELECT concat('P', l_partkey) AS serial_number, date, p_brand AS model,
    CAST(p_size AS BIGINT) * 1000000000 AS capacity_bytes, failure, {SMART}
  FROM marked JOIN part ON l_partkey = p_partkey)"""


def _summary(name: str = "summary", where: str = "TRUE") -> str:
    return f"""
{name} AS (
  SELECT serial_number, min(date) AS first_date, max(date) AS last_date, max(failure) AS event,
    arg_max(model, date) AS model, arg_max(capacity_bytes, date) AS capacity_bytes,
    count(*) AS n_days_observed,
    CAST(date_diff('day', min(date), max(date)) + 1 AS INTEGER) AS lifetime_days
  FROM panel WHERE {where} GROUP BY serial_number)"""


SUMMARY = _summary()


def _label(n: int) -> str:
    return f"CASE WHEN event = 1 AND rul_time_days <= {n} THEN 1 WHEN rul_time_days >= {n} THEN 0 END"


LIFE = """
known AS (
  SELECT p.*, first_date, last_date, event,
    CAST(date_diff('day', first_date, date) AS INTEGER) AS drive_age_days,
    CAST(date_diff('day', date, last_date) AS INTEGER) AS rul_time_days,
    capacity_bytes / 1e9 AS capacity_gb
  FROM panel p JOIN (SELECT serial_number, first_date, last_date, event FROM summary) USING (serial_number))"""

LABELS = LIFE + ", lab AS (SELECT *, {} FROM known)".format(
    ", ".join(f"{_label(n)} AS will_fail_within_{n}" for n in S.horizons)
)


def _slot(*keys: str) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(concat('0x', substr(md5(concat({text})), 1, 8)) AS BIGINT))"


def _scores(horizon: int = 7) -> str:
    return f"""
hashed AS (SELECT *, {_slot('serial_number', 'date')} % 1000000 AS h FROM lab),
scores AS (
  SELECT serial_number, date, model, will_fail_within_{horizon} AS y, event,
    greatest(rul_time_days, 1) AS time,
    round((CAST(h AS DOUBLE) / 1e6 + event * 5e-1) / 15e-1, 6) AS score,
    round(round((CAST(h AS DOUBLE) / 1e6 + event * 5e-1) / 15e-1, 6), 1) AS score_tied,
    CAST(h % 40 + 1 AS DOUBLE) AS pred_time, -CAST(h % 40 + 1 AS DOUBLE) AS risk
  FROM hashed)"""


SCORES = _scores()
E_LIFE = f"{EVENTS},{SUMMARY},{LIFE}"
E_LABELS = f"{EVENTS},{SUMMARY},{LABELS}"
E_SCORES = f"{E_LABELS},{SCORES}"

_ROWS = "PARTITION BY serial_number ORDER BY date ROWS BETWEEN"


def _fill(source: str) -> str:
    cols = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({_ROWS} UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS {c}"
        for c in SMART_BIG5
    )
    return f"""
filled AS (SELECT serial_number, date, model, capacity_bytes,
  date_diff('day', DATE '1970-01-01', date) AS day, {cols} FROM {source})"""


def _over(w: int) -> str:
    return f"OVER (PARTITION BY serial_number ORDER BY day RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _each(expr) -> str:
    return ", ".join(expr(c, w) for c in SMART_BIG5 for w in WINDOWS)


ROLLED = "rolled AS (SELECT *, {}, {} FROM filled)".format(
    _each(lambda c, w: f"avg({c}) {_over(w)} AS {c}_rmean_{w}"),
    _each(lambda c, w: f"stddev_samp({c}) {_over(w)} AS {c}_rstd_{w}"),
)


def _rolling(span) -> str:
    """Rolled features of a span, read with 30 days before it, joined with the life of the unit."""
    dev = ", ".join(f"{c} - {c}_rmean_30 AS {c}_dev30" for c in SMART_BIG5)
    return f"""{EVENTS},{SUMMARY},
wide AS (SELECT * FROM panel WHERE {_span(span.with_lookback(30))}), {_fill('wide')}, {ROLLED},
features AS (
  SELECT r.*, {dev}, event, capacity_bytes / 1e9 AS capacity_gb,
    CAST(date_diff('day', first_date, date) AS INTEGER) AS drive_age_days,
    CAST(date_diff('day', date, last_date) AS INTEGER) AS rul_time_days
  FROM rolled r JOIN (SELECT serial_number, first_date, last_date, event FROM summary) USING (serial_number)
  WHERE {_span(span)})"""


_NUMBERS = ["capacity_gb", *SMART_BIG5, *rolling_columns()]


def _rounded(columns, digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _keep(label: str, ratio: float | None, source: str) -> str:
    if ratio is None:
        return "TRUE"
    pos = f"(SELECT count(*) FILTER ({label} = 1) FROM {source})"
    neg = f"(SELECT count(*) FILTER ({label} = 0) FROM {source})"
    share = f"CASE WHEN {neg} > {ratio}e0 * {pos} THEN {ratio}e0 * {pos} / {neg} ELSE 1e0 END"
    return f"({label} = 1 OR ({label} = 0 AND {_slot('serial_number', 'date')} / 4294967296e0 < {share}))"


def _rolling_split(name: str) -> str:
    ratio = S.negatives_per_positive if name == "train" else None
    return f"""WITH {_rolling(S.splits[name])},
labelled AS (SELECT *, {_label(S.horizon)} AS y FROM features),
sure AS (SELECT * FROM labelled WHERE y IS NOT NULL)
SELECT serial_number, date, model, drive_age_days, {_rounded(_NUMBERS, 6)}, y FROM sure
WHERE {_keep('y', ratio, 'sure')}"""


def _curve(score: str = "score", source: str = "scores") -> str:
    return f"""
cells AS (SELECT {score} AS score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
  FROM {source} WHERE y IS NOT NULL GROUP BY 1),
curve AS (SELECT score, pos, neg,
  CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
  CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp,
  CAST(sum(pos) OVER () AS BIGINT) AS p_total, CAST(sum(neg) OVER () AS BIGINT) AS n_total FROM cells)"""


AP = "sum(pos / nullif(p_total, 0) * (tp / (tp + fp)))"
ROC = "sum(neg * (tp - pos / 2e0) / (p_total * CAST(n_total AS DOUBLE)))"


def _budget(name: str, x: float) -> str:
    usable = "max(p_total) > 0 AND max(n_total) > 0"
    ok = f"fp / n_total <= {x}e0"
    return f"""SELECT '{name}' AS budget,
  round(CASE WHEN {usable} THEN coalesce(max(tp) FILTER ({ok}) / max(p_total), 0e0) END, 6) AS recall,
  round(CASE WHEN {usable} THEN coalesce(min(score) FILTER ({ok}), max(score)) END, 6) AS threshold,
  round(CASE WHEN {usable} THEN coalesce(max(fp) FILTER ({ok}) / max(n_total), 0e0) END, 6) AS fpr
FROM curve"""


def _points(budgets: dict[str, float]) -> str:
    return " UNION ALL ".join(_budget(n, x) for n, x in budgets.items())


FBETA = """
fb AS (SELECT score, tp / (tp + fp) AS p, tp / p_total AS r FROM curve),
best AS (SELECT CASE WHEN 4e0 * p + r > 0 THEN 5e0 * p * r / (4e0 * p + r) ELSE 0e0 END AS fbeta,
  score AS threshold, p AS precision, r AS recall FROM fb ORDER BY 1 DESC, 2 LIMIT 1)"""


def _psi(r: str, c: str) -> str:
    r, c = f"greatest({r}, 1e-6)", f"greatest({c}, 1e-6)"
    return f"({c} - {r}) * ln({c} / {r})"


def _numeric_drift(ref, cur, features) -> str:
    """CTEs up to ``stats``; ``panel`` must exist."""
    long = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({'capacity_bytes / 1e9' if f == 'capacity_gb' else f} AS DOUBLE) AS value, "
        f"{_span(ref)} AS in_ref, {_span(cur)} AS in_cur FROM panel WHERE {_span(ref)} OR {_span(cur)}"
        for f in features
    )
    probabilities = [i / 10 for i in range(11)]
    asked = ", ".join(f"('{f}')" for f in features)
    p_value = (
        "list_sum(list_transform(range(1, 101), lambda k: "
        "CASE WHEN k % 2 = 1 THEN 2e0 ELSE -2e0 END * exp(-2e0 * k * k * x)))"
    )
    return f"""
long AS (SELECT * FROM ({long}) WHERE value IS NOT NULL),
enough AS (SELECT feature, count(*) FILTER (in_ref) AS ref, count(*) FILTER (in_cur) AS cur,
    list_sort(list_distinct(quantile_cont(value, {probabilities}) FILTER (in_ref))) AS edges
  FROM long GROUP BY feature HAVING ref >= 50 AND cur >= 50),
counted AS (SELECT feature, value, count(*) FILTER (in_ref) AS n_ref, count(*) FILTER (in_cur) AS n_cur
  FROM long GROUP BY ALL),
placed AS (SELECT c.*, ref, cur, len(edges) AS edge_count,
    len(list_filter(edges[2:len(edges) - 1], lambda e: e <= c.value)) AS bin,
    abs(sum(n_ref) OVER w / ref - sum(n_cur) OVER w / cur) AS distance
  FROM counted c JOIN enough USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY value)),
bins AS (SELECT feature, bin, sum(n_ref) AS n_ref, sum(n_cur) AS n_cur, max(distance) AS distance,
    max(edge_count) AS edge_count, max(ref) AS ref, max(cur) AS cur FROM placed GROUP BY ALL),
moved AS (SELECT feature, CASE WHEN max(edge_count) < 3 THEN 0e0
      ELSE sum({_psi('n_ref / ref', 'n_cur / cur')}) END AS psi_raw,
    max(distance) AS ks_raw, CAST(max(edge_count) AS INTEGER) AS edge_count,
    CAST(max(ref) AS DOUBLE) * max(cur) / (max(ref) + max(cur)) * max(distance) * max(distance) AS x
  FROM bins GROUP BY feature),
stats AS (SELECT feature, round(psi_raw, 4) AS psi, round(ks_raw, 4) AS ks_stat,
    round(CASE WHEN x IS NULL THEN NULL WHEN x < 1e-2 THEN 1e0 ELSE least(1e0, greatest(0e0, {p_value})) END, 6) AS ks_pvalue,
    edge_count, coalesce(psi_raw > 1e-1, FALSE) AS drifted FROM (VALUES {asked}) AS asked(feature) LEFT JOIN moved USING (feature))"""


def _category_drift(ref, cur) -> str:
    return f"""
shares AS (SELECT model, count(*) FILTER ({_span(ref)}) AS n_ref, count(*) FILTER ({_span(cur)}) AS n_cur
  FROM panel WHERE {_span(ref)} OR {_span(cur)} GROUP BY model),
sides AS (SELECT sum(n_ref) AS ref, sum(n_cur) AS cur FROM shares),
shift AS (SELECT sum({_psi('n_ref / ref', 'n_cur / cur')}) AS psi_raw,
    count(*) FILTER (n_ref = 0 AND n_cur > 0) AS new_categories FROM shares, sides),
catstats AS (SELECT 'model' AS feature, round(psi_raw, 4) AS psi, new_categories,
    psi_raw > 1e-1 OR new_categories > 0 AS drifted FROM shift)"""


TRAIN, VAL, TEST = (S.splits[n] for n in ("train", "val", "test"))
_DRIFT_FEATURES = ["capacity_gb", *SMART_BIG5]
REPORT = f"""{_numeric_drift(TRAIN, TEST, _DRIFT_FEATURES)}, {_category_drift(TRAIN, TEST)},
report AS (
  SELECT feature, 'numeric' AS type, psi, ks_stat, ks_pvalue, edge_count,
    CAST(NULL AS BIGINT) AS new_categories, drifted FROM stats
  UNION ALL
  SELECT feature, 'categorical', psi, NULL, NULL, NULL, new_categories, drifted FROM catstats)"""

CARD = f"""{E_SCORES}, valscores AS (SELECT * FROM scores WHERE {_span(VAL)}), {_curve(source='valscores')},
limits AS (SELECT min(score) FILTER (fp / n_total <= 1e-2) AS critical,
  min(score) FILTER (fp / n_total <= 2e-1) AS warning FROM curve),
newest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY serial_number ORDER BY date DESC) = 1),
shown AS (SELECT serial_number, model, score AS raw_score, round(score, 4) AS failure_probability,
  CAST(CAST(round(score * 1e6) AS BIGINT) % 120 + 1 AS DOUBLE) AS rul_days FROM newest),
alerted AS (SELECT shown.*, CASE WHEN raw_score >= critical THEN 'critical' WHEN raw_score >= warning
  THEN 'warning' WHEN rul_days < 60 THEN 'watch' ELSE 'ok' END AS alert_level FROM shown, limits),
card AS (SELECT *, (alert_level IN ('critical', 'warning')) = (rul_days < 90) AS models_agree FROM alerted)"""

_RISK_CASES = " ".join(
    f"WHEN score > {a}e0 AND score <= {b}e0 THEN '{n}'"
    for a, b, n in zip(RISK_BIN_EDGES, RISK_BIN_EDGES[1:], RISK_BIN_NAMES)
)

_RECENT = {w: f"OVER ({_ROWS} {w - 1} PRECEDING AND CURRENT ROW)" for w in WINDOWS}
_REQUEST_COLUMNS = ", ".join(
    [
        *(f"round({c}, 6) AS {c}" for c in SMART_BIG5),
        *(f"round(avg({c}) {_RECENT[w]}, 6) AS {c}_rmean_{w}" for c in SMART_BIG5 for w in WINDOWS),
        *(
            f"round(coalesce(stddev_samp({c}) {_RECENT[w]}, 0e0), 6) AS {c}_rstd_{w}"
            for c in SMART_BIG5
            for w in WINDOWS
        ),
        *(f"round({c} - avg({c}) {_RECENT[30]}, 6) AS {c}_dev30" for c in SMART_BIG5),
    ]
)

_REASONS = " UNION ALL ".join(
    f"SELECT serial_number, date, '{f}' AS feature, {b}e0 * ({f} - {m}e0) AS share, CAST({f} AS DOUBLE) AS v FROM wide"
    for f, (b, m) in FIXED_EFFECTS.items()
)

_STEP_VALUES = ", ".join(f"round(CAST(CAST(coalesce(f.{c}, 0e0) AS FLOAT) AS DOUBLE), 2) AS {c}" for c in SMART_BIG5)


def oracle_sql() -> dict[str, str]:
    life_columns = "serial_number, first_date, last_date, event, model, capacity_bytes, n_days_observed, lifetime_days"
    label_lines = " UNION ALL ".join(
        f"SELECT CAST({n} AS INTEGER) AS horizon, count(*) FILTER (will_fail_within_{n} = 1) AS positives, "
        f"count(*) FILTER (will_fail_within_{n} = 0) AS negatives, "
        f"count(*) FILTER (will_fail_within_{n} IS NULL) AS censored FROM lab"
        for n in S.horizons
    )
    split_lines = " UNION ALL ".join(
        f"SELECT '{name}' AS split, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg "
        f"FROM scores WHERE {_span(span)}"
        for name, span in S.splits.items()
    )
    active = f"first_date <= DATE '{TEST.last}' AND last_date >= DATE '{TEST.first}'"
    units = f"""units AS (SELECT serial_number, event FROM summary WHERE {active}
  QUALIFY event = 1 OR row_number() OVER (PARTITION BY event ORDER BY {_slot('serial_number')}, serial_number) <= 60)"""
    slope = _each(
        lambda c, w: f"CASE WHEN count(*) {_over(w)} > 1 THEN round(regr_slope({c}, CAST(day AS DOUBLE)) {_over(w)}, 6) END AS {c}_rslope_{w}"
    )
    means = [f"{c}_rmean_{w}" for c in SMART_BIG5 for w in WINDOWS]
    stds = [f"{c}_rstd_{w}" for c in SMART_BIG5 for w in WINDOWS]
    stat_lines = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}) + 1e-6, 6) AS std FROM filled"
        for c in SMART_BIG5
    )

    def anchor_rows(span, per_event: int, per_censored: int) -> str:
        order = f"CASE WHEN event = 1 THEN -date_diff('day', DATE '1970-01-01', date) ELSE {_slot('serial_number', 'date')} END"
        return f"""anchors AS (SELECT serial_number, date, event, rul_time_days FROM known WHERE {_span(span)}
  QUALIFY row_number() OVER (PARTITION BY serial_number ORDER BY {order}, date)
    <= CASE WHEN event = 1 THEN {per_event} ELSE {per_censored} END)"""

    def sequence_sql(span) -> str:
        return f"""{E_LIFE}, {anchor_rows(span, 30, 4)},
wide AS (SELECT * FROM panel WHERE {_span(span.with_lookback(30))}), {_fill('wide')},
numbered AS (SELECT *, row_number() OVER (PARTITION BY serial_number ORDER BY date) AS place FROM filled),
steps AS (SELECT a.serial_number, a.date, a.event, greatest(a.rul_time_days, 1) AS dur, n.place, s.step
  FROM anchors a JOIN numbered n USING (serial_number, date), (SELECT unnest(range(30)) AS step) s),
windows AS (SELECT s.serial_number, s.date, s.event, s.dur, CAST(s.step AS INTEGER) AS step, {_STEP_VALUES}
  FROM steps s LEFT JOIN numbered f ON f.serial_number = s.serial_number AND f.place = s.place - 29 + s.step)"""
    windows = {name: sequence_sql(span) for name, span in S.splits.items()}
    step_stats = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_pop({c}) + 1e-6, 4) AS std FROM windows"
        for c in SMART_BIG5
    )

    def pit_sql(name: str) -> str:
        ratio = S.negatives_per_positive if name == "train" else None
        return f"""WITH {E_LABELS},
sure AS (SELECT *, will_fail_within_{S.horizon} AS y FROM lab
  WHERE will_fail_within_{S.horizon} IS NOT NULL AND {_span(S.splits[name])})
SELECT serial_number, date, model, capacity_gb, drive_age_days, {SMART}, y FROM sure
WHERE {_keep('y', ratio, 'sure')}"""

    def survival_sql(name: str) -> str:
        return f"""WITH {_rolling(S.splits[name])}
SELECT serial_number, date, model, drive_age_days, {_rounded(_NUMBERS, 6)}, event, rul_time_days AS duration
FROM features WHERE {_keep('event', S.survival_ratios[name], 'features')}"""

    cut_rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, greatest(duration, 1) AS day, event FROM base" for c in CUT_INPUTS
    )
    log_rank_sql = f"""WITH base AS ({survival_sql('train')}), long AS ({cut_rows}),
cuts AS (SELECT DISTINCT feature, unnest(quantile_cont(x, [0.25, 0.5, 0.75])) AS threshold FROM long GROUP BY feature),
days AS (SELECT day, count(*) AS n, count(*) FILTER (event = 1) AS d
  FROM (SELECT greatest(duration, 1) AS day, event FROM base) GROUP BY day),
risk AS (SELECT day, d, sum(n) OVER (ORDER BY day DESC) AS y FROM days),
counted AS (SELECT feature, threshold, day, count(*) AS n1, count(*) FILTER (event = 1) AS d1
  FROM long JOIN cuts USING (feature) WHERE x <= threshold GROUP BY ALL),
every AS (SELECT feature, threshold, r.day, d, y, coalesce(n1, 0) AS n1, coalesce(d1, 0) AS d1
  FROM cuts CROSS JOIN risk r LEFT JOIN counted USING (feature, threshold, day)),
left_risk AS (SELECT *, sum(n1) OVER (PARTITION BY feature, threshold ORDER BY day DESC) / CAST(y AS DOUBLE) AS p FROM every),
summed AS (SELECT feature, threshold, CAST(sum(n1) AS BIGINT) AS n_left, CAST(sum(d1) AS BIGINT) AS deaths_left,
    sum(d1 - d * p) AS apart, coalesce(sum(d * p * (1 - p) * (y - d) / (y - 1)) FILTER (y > 1), 0) AS spread
  FROM left_risk GROUP BY ALL)
SELECT feature, round(threshold, 6) AS threshold, n_left, deaths_left,
  round(CASE WHEN spread > 1e-12 THEN apart * apart / spread ELSE 0e0 END, 6) AS statistic FROM summed"""

    spread = {c: f"(CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1e0 END)" for c in CUT_INPUTS}
    eta = " + ".join(f"{b!r} * x{i}" for i, b in enumerate(SLOPE_POINT[1:-1]))
    slope_lines = " UNION ALL ".join(
        f"SELECT '{name}' AS parameter, round(avg({value}), 6) AS mean FROM rows"
        for name, value in [
            ("likelihood", f"event * ({SLOPE_POINT[-1]!r} + z - lived) - exp(z)"),
            ("intercept", f"exp({SLOPE_POINT[-1]!r}) * (exp(z) - event)"),
            *[(c, f"exp({SLOPE_POINT[-1]!r}) * (exp(z) - event) * x{i}") for i, c in enumerate(CUT_INPUTS)],
            ("ln_shape", "event * (1 + z) - z * exp(z)"),
        ]
    )
    weibull_sql = f"""WITH base AS ({survival_sql('train')}),
stats AS (SELECT {', '.join(f'avg({c}) AS m{i}, {spread[c]} AS s{i}' for i, c in enumerate(CUT_INPUTS))} FROM base),
scaled AS (SELECT ln(greatest(duration, 1)) AS lived, event,
  {', '.join(f'({c} - m{i}) / s{i} AS x{i}' for i, c in enumerate(CUT_INPUTS))} FROM base, stats),
rows AS (SELECT *, exp({SLOPE_POINT[-1]!r}) * (lived - {SLOPE_POINT[0]!r} - ({eta})) AS z FROM scaled)
{slope_lines}"""

    cox_eta = " + ".join(f"{b!r} * x{i}" for i, b in enumerate(SLOPE_POINT[1:-1]))
    cox_sums = ", ".join(
        f"round(sum(w * x{i}), 5) AS w_x{i}, round(coalesce(sum(x{i}) FILTER (event = 1), 0e0), 5) AS d_x{i}" for i in range(len(CUT_INPUTS))
    )
    cox_sql = f"""WITH base AS ({survival_sql('train')}),
stats AS (SELECT {', '.join(f'avg({c}) AS m{i}, {spread[c]} AS s{i}' for i, c in enumerate(CUT_INPUTS))} FROM base),
scaled AS (SELECT greatest(duration, 1) AS duration, event,
  {', '.join(f'({c} - m{i}) / s{i} AS x{i}' for i, c in enumerate(CUT_INPUTS))} FROM base, stats),
rows AS (SELECT *, {cox_eta} AS e, exp({cox_eta}) AS w FROM scaled)
SELECT duration, count(*) AS n, count(*) FILTER (event = 1) AS deaths, round(sum(w), 5) AS w,
  round(coalesce(sum(e) FILTER (event = 1), 0e0), 5) AS eta, {cox_sums} FROM rows GROUP BY duration"""
    starts = [0, *PERIOD_ENDS[:-1]]
    periods = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(starts, PERIOD_ENDS)))
    person_sql = f"""WITH base AS (SELECT serial_number, date, greatest(duration, 1) AS duration, event FROM ({survival_sql('train')}))
SELECT serial_number, date, duration, event, CAST(p AS INTEGER) AS period,
  CASE WHEN event = 1 AND duration <= hi THEN 1 ELSE 0 END AS fails
FROM base, (VALUES {periods}) AS t(p, lo, hi)
WHERE CASE WHEN event = 1 THEN duration > lo ELSE duration >= hi END"""
    card_sql = f"""WITH {_rolling(S.splits['test'])}
SELECT serial_number, date, model, drive_age_days, {', '.join(f'round({c}, 6) + 0e0 AS {c}' for c in _NUMBERS)} FROM features
QUALIFY row_number() OVER (PARTITION BY serial_number ORDER BY date DESC) = 1"""
    inputs_sql = f"""WITH train AS ({pit_sql('train')}), test AS ({pit_sql('test')}),
book AS (SELECT model, row_number() OVER (ORDER BY model) AS code FROM (SELECT DISTINCT model FROM train WHERE model IS NOT NULL))
SELECT serial_number, date, CAST(capacity_gb AS DOUBLE) AS capacity_gb, CAST(drive_age_days AS DOUBLE) AS drive_age_days, {SMART},
  CAST(coalesce(code, 0) AS DOUBLE) AS model_index, y FROM test LEFT JOIN book USING (model)"""

    def anchors_sql(span) -> str:
        return f"WITH {E_LIFE}, {anchor_rows(span, 3, 2)} SELECT serial_number, date, event FROM anchors"

    return {
        "ingest_audit": f"""WITH {LINEITEM}
SELECT concat(year(date), '-Q', quarter(date)) AS quarter, count(DISTINCT date) AS days, count(*) AS rows,
  CAST(sum(failure) AS BIGINT) AS failures FROM panel GROUP BY 1""",
        "drive_summary": f"WITH {LINEITEM},{SUMMARY} SELECT {life_columns} FROM summary",
        "drive_summary_as_of": f"""WITH {EVENTS},{_summary(where=f"date <= DATE '{TRAIN.last}'")}
SELECT {life_columns} FROM summary""",
        "labels": f"""WITH {E_LABELS} SELECT date, serial_number, model, capacity_bytes, failure, event, rul_time_days,
  {', '.join(f'will_fail_within_{n}' for n in S.horizons)} FROM lab""",
        "labels_by_days": f"""WITH {E_LABELS} SELECT date, serial_number, model, capacity_bytes, failure, event, rul_time_days,
  {', '.join(f'will_fail_within_{n}' for n in S.horizons)} FROM lab""",
        "fleet_totals": f"""WITH {LINEITEM},{SUMMARY} SELECT count(*) AS drives, CAST(sum(event) AS BIGINT) AS failed,
  round(100.0 * sum(event) / count(*), 3) AS failed_pct FROM summary""",
        "label_balance": f"""WITH {E_LABELS}, counts AS ({label_lines})
SELECT *, CASE WHEN positives + negatives > 0 THEN round(100e0 * positives / (positives + negatives), 5) END
    AS positive_rate_pct,
  CASE WHEN positives > 0 THEN round(negatives / positives, 1) END AS negatives_per_positive FROM counts""",
        "failures_by_month": f"""WITH {LINEITEM} SELECT CAST(date_trunc('month', date) AS DATE) AS month,
  CAST(sum(failure) AS BIGINT) AS failures, count(*) AS drive_days FROM panel GROUP BY 1""",
        "model_failure_rates": f"""WITH {LINEITEM},{SUMMARY} SELECT model, count(*) AS drives,
  CAST(sum(event) AS BIGINT) AS failures, round(100e0 * sum(event) / count(*), 6) AS failure_rate_pct
FROM summary GROUP BY model HAVING count(*) >= {S.min_drives} ORDER BY failure_rate_pct DESC, model LIMIT 15""",
        "fleet_kpis": f"""WITH {LINEITEM},{SUMMARY} SELECT CAST(sum(n_days_observed) AS BIGINT) AS total_drive_days,
  count(*) AS unique_drives, CAST(sum(event) AS BIGINT) AS failed_drives,
  round(100e0 * sum(event) / count(*), 3) AS drive_level_failure_pct,
  round(100e0 * sum(event) / sum(n_days_observed), 5) AS drive_day_failure_pct,
  CAST(floor(median(lifetime_days)) AS INTEGER) AS median_lifetime_days_all,
  CAST(floor(median(lifetime_days) FILTER (event = 1)) AS INTEGER) AS median_lifetime_days_failed FROM summary""",
        "rul_histogram": f"""WITH {LINEITEM},{SUMMARY},{LIFE},
near AS (SELECT rul_time_days AS d FROM known WHERE event = 1 AND rul_time_days <= 180),
ends AS (SELECT min(d) AS lo, max(d) AS hi FROM near),
binned AS (SELECT lo, hi, CAST(least(coalesce(floor((d - lo) * 60 / nullif(hi - lo, 0)), 0), 59) AS INTEGER) AS bin
  FROM near, ends)
SELECT bin, count(*) AS drive_days, round(max(lo) + bin * (max(hi) - max(lo)) / 60e0, 6) AS left_edge
FROM binned GROUP BY bin""",
        "active_units": f"""WITH {EVENTS},{SUMMARY} SELECT serial_number, first_date, last_date, event FROM summary
WHERE first_date <= DATE '{VAL.last}' AND last_date >= DATE '{VAL.first}'""",
        "ffill": f"WITH {EVENTS},{_fill('panel')} SELECT serial_number, date, {_rounded(SMART_BIG5, 4)} FROM filled",
        "rolling_mean": f"""WITH {LINEITEM},{_fill('panel')},{ROLLED}
SELECT serial_number, date, {_rounded(means, 6)} FROM rolled""",
        "rolling_std": f"""WITH {LINEITEM},{_fill('panel')},{ROLLED}
SELECT serial_number, date, {_rounded(stds, 3)} FROM rolled""",
        "rolling_slope": f"WITH {EVENTS},{_fill('panel')} SELECT serial_number, date, {slope} FROM filled",
        **{f"rolling_features_{name}": _rolling_split(name) for name in S.splits},
        "latest_snapshot": f"""WITH {LINEITEM} SELECT serial_number, date, model, capacity_bytes, {SMART} FROM panel
QUALIFY row_number() OVER (PARTITION BY serial_number ORDER BY date DESC) = 1""",
        "pit_features": pit_sql("train"),
        **{f"pit_features_{name}": pit_sql(name) for name in ("val", "test")},
        "split_counts": f"WITH {E_SCORES} {split_lines}",
        "survival_table": survival_sql("val"),
        "log_rank_splits": log_rank_sql,
        "cox_risk_sums": cox_sql,
        "person_period_rows": person_sql,
        "scorecard_units": card_sql,
        "prepared_inputs": inputs_sql,
        "training_counts": f"""WITH {E_LABELS},
c AS (SELECT count(*) AS train_rows, count(*) FILTER (will_fail_within_{S.horizon} = 1) AS class_pos,
  count(*) FILTER (will_fail_within_{S.horizon} = 0) AS class_neg FROM lab WHERE {_span(TRAIN)})
SELECT *, round(class_neg / greatest(class_pos, 1), 6) AS weight FROM c""",
        "day_sketch_counts": f"WITH {EVENTS} " + " UNION ALL ".join(
            f"SELECT date, '{c}' AS feature, count({'capacity_bytes' if c == 'capacity_gb' else c}) AS n FROM panel GROUP BY date"
            for c in DRIFT_NUMERIC
        ),
        "day_category_counts": f"WITH {EVENTS} " + " UNION ALL ".join(
            f"SELECT date, '{c}' AS feature, CAST({c} AS VARCHAR) AS category, count(*) AS n FROM panel GROUP BY ALL"
            for c in DRIFT_CATEGORICAL
        ),
        "calibration_map": f"""WITH {E_SCORES},
cells AS (SELECT score_tied AS score, sum(y) AS pos, count(*) AS n FROM scores WHERE y IS NOT NULL GROUP BY 1),
upto AS (SELECT score, sum(pos) OVER (ORDER BY score) AS pos, sum(n) OVER (ORDER BY score) AS n FROM cells),
ends AS (SELECT * FROM upto UNION ALL SELECT -1e0, 0, 0),
begins AS (SELECT c.score, max(e.score) AS earlier FROM cells c JOIN ends e ON e.score < c.score GROUP BY c.score),
blocks AS (SELECT b.score AS lo, h.score AS hi, (h.pos - e.pos) / CAST(h.n - e.n AS DOUBLE) AS rate
  FROM begins b JOIN ends e ON e.score = b.earlier JOIN upto h ON h.score >= b.score)
SELECT score, round(max(least_rate), 6) AS probability
FROM (SELECT c.score, b.lo, min(b.rate) AS least_rate FROM cells c JOIN blocks b ON b.lo <= c.score AND b.hi >= c.score GROUP BY c.score, b.lo)
GROUP BY score""",
        "weibull_slopes": weibull_sql,
        **{f"survival_table_{name}": survival_sql(name) for name in ("train", "test")},
        "encode_category": f"""WITH {EVENTS},
book AS (SELECT model, CAST(row_number() OVER (ORDER BY model) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT model FROM panel WHERE {_span(TRAIN)} AND model IS NOT NULL))
SELECT serial_number, date, model, coalesce(code, -1) AS model_code FROM panel LEFT JOIN book USING (model)
WHERE {_span(TEST)}""",
        "ordered_category_means": f"""WITH {E_SCORES},
prior AS (SELECT avg(y) AS p FROM scores WHERE y IS NOT NULL),
placed AS (SELECT serial_number, date, model, y, count(*) OVER before AS n, coalesce(sum(y) OVER before, 0) AS pos
  FROM scores WHERE y IS NOT NULL
  WINDOW before AS (PARTITION BY model ORDER BY {_slot('serial_number', 'date')}, serial_number, date
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT serial_number, date, model, y, round((pos + p) / (n + 1), 6) AS category_mean FROM placed, prior""",
        "class_weights": f"""WITH {E_SCORES}, c AS (SELECT count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scores)
SELECT pos, neg, round(neg / greatest(pos, 1), 6) AS scale_pos_weight,
  CASE WHEN pos > 0 THEN round((pos + neg) / (2e0 * pos), 6) END AS balanced_pos,
  CASE WHEN neg > 0 THEN round((pos + neg) / (2e0 * neg), 6) END AS balanced_neg FROM c""",
        "feature_stats": f"WITH {EVENTS},{_fill('panel')} {stat_lines}",
        "undersample": f"""WITH {E_SCORES}, sure AS (SELECT * FROM scores WHERE y IS NOT NULL)
SELECT serial_number, date, y FROM sure WHERE {_keep('y', S.negatives_per_positive, 'sure')}""",
        "cap_negatives": f"""WITH {E_SCORES} SELECT serial_number, date, y FROM scores
WHERE y = 1 OR (y = 0 AND {_slot('model', 'date')} / 4294967296e0
  < least(1e0, 700e0 / greatest((SELECT count(*) FROM scores WHERE y = 0), 1)))""",
        "sample_n": f"""WITH {LINEITEM} SELECT serial_number, date, smart_5_raw FROM panel
ORDER BY {_slot('serial_number', 'date')}, serial_number, date LIMIT 5000""",
        "unit_sample": f"WITH {EVENTS},{SUMMARY}, {units} SELECT serial_number, event FROM units",
        "unit_prune": f"""WITH {EVENTS},{SUMMARY}, {units}
SELECT serial_number, date, model FROM panel WHERE serial_number IN (SELECT serial_number FROM units)""",
        "balanced_cap": f"""WITH {E_SCORES},
c AS (SELECT count(*) FILTER (event = 1) AS ev, count(*) FILTER (event = 0) AS ce FROM scores),
half AS (SELECT ev, ce, least(ev, 1200 - least(ce, 600)) AS keep_ev FROM c),
room AS (SELECT keep_ev, least(ce, 1200 - keep_ev) AS keep_ce FROM half)
SELECT serial_number, date, event FROM scores, room
QUALIFY row_number() OVER (PARTITION BY event ORDER BY {_slot('serial_number', 'date')}, serial_number, date)
  <= CASE WHEN event = 1 THEN keep_ev ELSE keep_ce END""",
        "drift_numeric": f"""WITH {LINEITEM}, {_numeric_drift(*SPARSE_WINDOWS, SMART_BIG5)}
SELECT feature, psi, ks_stat, ks_pvalue, edge_count, drifted FROM stats""",
        "drift_categorical": f"WITH {EVENTS}, {_category_drift(TRAIN, TEST)} SELECT * FROM catstats",
        "drift_report": f"WITH {EVENTS}, {REPORT} SELECT * FROM report",
        "retrain_decision": f"""WITH {E_SCORES}, {REPORT},
before AS (SELECT score, y FROM scores WHERE {_span(TRAIN)}),
b_cells AS (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM before
  WHERE y IS NOT NULL GROUP BY 1),
b_curve AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p_total FROM b_cells),
n_cells AS (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scores
  WHERE y IS NOT NULL AND {_span(TEST)} GROUP BY 1),
n_curve AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p_total FROM n_cells),
gap AS (SELECT b, n, b - n AS fall FROM (SELECT (SELECT {AP} FROM b_curve) AS b, (SELECT {AP} FROM n_curve) AS n)),
s AS (SELECT count(*) AS n_features, count(*) FILTER (drifted) AS n_drifted,
  round(count(*) FILTER (drifted) / greatest(count(*), 1), 3) AS drifted_share FROM report),
r AS (SELECT s.*, CAST(drifted_share >= 5e-1 AS INTEGER) + CAST(coalesce(fall >= 5e-2, FALSE) AS INTEGER) AS n_reasons,
    concat_ws('; ', CASE WHEN drifted_share >= 5e-1 THEN concat('drift in ', n_drifted, ' of ', n_features, ' features') END,
      CASE WHEN fall >= 5e-2 THEN concat('pr_auc fell from ', round(b, 3), ' to ', round(n, 3)) END) AS reasons
  FROM s, gap)
SELECT n_features, n_drifted, drifted_share, n_reasons, reasons, n_reasons > 0 AS retrain FROM r""",
        "rank_curve": f"WITH {E_SCORES},{_curve()} SELECT * FROM curve",
        "recall_at_fpr": f"""WITH {E_SCORES},{_curve('score_tied')}
{_points({'0.1%': 0.001, '1%': 0.01, '5%': 0.05, '20%': 0.2})}""",
        "recall_at_fpr_degenerate": f"""WITH {E_LABELS},{_scores(max(S.horizons))},
last AS (SELECT * FROM scores WHERE {_span(TEST)}), {_curve(source='last')}
{_points({'fpr_1pct': 0.01, 'fpr_0_1pct': 0.001})}""",
        "best_fbeta": f"""WITH {E_SCORES},{_curve()},{FBETA}
SELECT {_rounded(['fbeta', 'threshold', 'precision', 'recall'], 6)} FROM best""",
        "pr_auc": f"WITH {E_SCORES},{_curve('score_tied')} SELECT round({AP}, 6) AS pr_auc FROM curve",
        "roc_auc": f"WITH {E_SCORES},{_curve('score_tied')} SELECT round({ROC}, 6) AS roc_auc FROM curve",
        "classification_bundle": f"""WITH {E_SCORES},{_curve()},{FBETA},
m AS (SELECT CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives,
  sum(pos) / sum(pos + neg) AS base_rate, {AP} AS pr_auc, {ROC} AS roc_auc,
  sum(pos * (1 - score) * (1 - score) + neg * score * score) / sum(pos + neg) AS brier,
  max(tp) FILTER (fp / n_total <= 1e-2) / max(p_total) AS recall_1pct,
  max(tp) FILTER (fp / n_total <= 1e-3) / max(p_total) AS recall_0_1pct FROM curve)
SELECT n, positives, round(base_rate, 6) AS base_rate, round(pr_auc, 6) AS pr_auc,
  round(pr_auc / base_rate, 6) AS pr_auc_lift, round(roc_auc, 6) AS roc_auc, round(brier, 6) AS brier,
  round(fbeta, 6) AS fbeta, round(threshold, 6) AS fbeta_threshold,
  round(recall_1pct, 6) AS recall_1pct, round(coalesce(recall_0_1pct, 0e0), 6) AS recall_0_1pct FROM m, best""",
        "operating_points": f"""WITH {E_SCORES}, v AS (SELECT * FROM scores WHERE {_span(VAL)}), {_curve(source='v')}
{_points({'fpr_1pct': 0.01, 'fpr_0_1pct': 0.001})}""",
        "pr_curve": f"""WITH {E_SCORES},{_curve()},
steps AS (SELECT CAST(ceil(tp * 20 / p_total) AS INTEGER) AS step, * FROM curve WHERE p_total > 0 AND tp > 0)
SELECT step, score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p_total, 6) AS recall
FROM steps QUALIFY row_number() OVER (PARTITION BY step ORDER BY score) = 1""",
        "calibration_curve": f"""WITH {E_SCORES} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin,
  round(avg(score), 6) AS mean_score, round(avg(y), 6) AS observed_rate, count(*) AS n
FROM scores WHERE y IS NOT NULL GROUP BY 1""",
        "c_index": f"""WITH {E_SCORES},
pairs AS (SELECT CAST(sum(CASE WHEN j.risk < i.risk THEN 1 ELSE 0 END) AS BIGINT) AS concordant,
    CAST(sum(CASE WHEN j.risk = i.risk THEN 1 ELSE 0 END) AS BIGINT) AS tied, count(*) AS comparable
  FROM scores i JOIN scores j ON i.event = 1 AND (j.time > i.time OR (j.time = i.time AND j.event = 0)))
SELECT round((concordant + tied / 2e0) / comparable, 6) AS c_index, * FROM pairs""",
        "rul_error": f"""WITH {E_SCORES} SELECT count(*) AS n, count(*) FILTER (event = 1) AS events,
  round(avg(abs(pred_time - time)) FILTER (event = 1), 6) AS rul_mae_days,
  round(median(time) FILTER (event = 1), 6) AS rul_median_true_days FROM scores""",
        "rul_clip": f"""WITH {E_SCORES} SELECT serial_number, date,
  CASE WHEN pred_time IN (1, 2, 4) THEN 400e0 WHEN pred_time = 3 THEN 1e0
    ELSE greatest(1e0, least(400e0, (pred_time - 20) * 30)) END AS rul_days FROM scores""",
        "censored_rul_loss": f"""WITH {E_SCORES},
gaps AS (SELECT event, abs(pred_time - time) AS gap, greatest(time - pred_time, 0e0) AS short FROM scores),
parts AS (SELECT coalesce(avg(CASE WHEN gap < 1 THEN 5e-1 * gap * gap ELSE gap - 5e-1 END) FILTER (event = 1), 0e0) AS a,
  coalesce(avg(short) FILTER (event = 0), 0e0) AS b FROM gaps)
SELECT round(a, 6) AS observed_loss, round(b, 6) AS censored_loss, round(a + b, 6) AS loss FROM parts""",
        "risk_sets": f"""WITH {E_SCORES},
days AS (SELECT time AS duration, count(*) AS n, count(*) FILTER (event = 1) AS deaths, sum(exp(score)) AS weight
  FROM scores GROUP BY time)
SELECT duration, deaths, CAST(sum(n) OVER (ORDER BY duration DESC) AS BIGINT) AS at_risk,
  round(sum(weight) OVER (ORDER BY duration DESC), 6) AS risk_weight FROM days""",
        "sequence_anchors": anchors_sql(VAL),
        "sequence_anchors_train": anchors_sql(TRAIN),
        "sequence_anchors_test": anchors_sql(TEST),
        "sequence_windows": f"WITH {windows['test']} SELECT * FROM windows",
        "sequence_windows_train": f"WITH {windows['train']} SELECT * FROM windows",
        "sequence_windows_val": f"WITH {windows['val']} SELECT * FROM windows",
        "sequence_stats": f"WITH {windows['train']} {step_stats}",
        "fleet_alerts": f"""WITH {CARD} SELECT serial_number, model, raw_score, failure_probability, rul_days, alert_level,
  models_agree, CASE WHEN models_agree THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN models_agree THEN NULL WHEN alert_level IN ('critical', 'warning')
    THEN 'high failure score but long expected life' ELSE 'short expected life but low failure score' END AS note FROM card""",
        "fleet_alert_counts": f"WITH {CARD} SELECT alert_level, count(*) AS drives FROM card GROUP BY 1",
        "top_risk": f"""WITH {CARD} SELECT serial_number, model, failure_probability, rul_days, alert_level FROM card
ORDER BY failure_probability DESC, serial_number LIMIT 12""",
        "risk_histogram": f"""WITH {E_SCORES} SELECT CASE {_RISK_CASES} ELSE 'outside' END AS risk_bin, count(*) AS drives
FROM scores GROUP BY 1""",
        "request_features": f"""WITH {E_LIFE}, {_fill('panel')}
SELECT serial_number, model, round(capacity_bytes / 1e9, 6) AS capacity_gb,
  CAST(date_diff('day', first_date, date) AS INTEGER) AS drive_age_days, {_REQUEST_COLUMNS}
FROM filled JOIN (SELECT serial_number, first_date, last_date FROM summary) USING (serial_number)
QUALIFY date = last_date""",
        "top_reasons": f"""WITH {EVENTS}, {_fill('panel')},
wide AS (SELECT *, capacity_bytes / 1e9 AS capacity_gb FROM filled), shares AS ({_REASONS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY serial_number, date ORDER BY abs(share) DESC, feature) AS place FROM shares)
SELECT serial_number, date, CAST(place - 1 AS INTEGER) AS place, feature, round(share, 4) AS contribution,
  round(v, 3) AS value FROM ranked WHERE place <= 5""",
    }
