"""SQL that gives the rows of the registered queries, written from their definitions."""

from __future__ import annotations

import math

from tremor.config import ALIASES, BANDS, CLASSES

CLASS = "['healthy', 'imbalanced', 'obstruction'][({}) % 3 + 1]"
K = "CAST(regexp_extract(props, '\"k\": *(-?[0-9.]+)', 1) AS DOUBLE)"


def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0::DOUBLE"


E = f"""e AS (
  SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, epoch_us(ts)::DOUBLE / 1000::DOUBLE AS t,
         value AS x, value / 2 AS y, {K} AS z, {K} - 50 AS zf, {CLASS.format('user_id')} AS label, event_id
  FROM events)"""
E2 = f"""e0 AS (
  SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq,
         epoch_us(ts)::DOUBLE / 1000::DOUBLE - CASE WHEN event_id % 50 = 0 THEN 172.8e6 ELSE 0 END AS t0,
         value AS x, value / 2 AS y, {K} AS z, {K} - 50 AS zf, {CLASS.format('user_id')} AS label, event_id
  FROM events),
e AS (SELECT * EXCLUDE (t0), CASE WHEN event_id % 77 = 0 THEN coalesce(lag(t0) OVER (PARTITION BY stream_id ORDER BY seq), t0) ELSE t0 END AS t FROM e0),
dts AS (SELECT *, t - lag(t) OVER (PARTITION BY stream_id ORDER BY seq) AS dt FROM e)"""
SEGMENTS = f"""{E2},
s AS (SELECT *, CAST(sum(CASE WHEN dt <= 0 OR dt > 86.4e6 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq) AS BIGINT) AS segment_id FROM dts),
si AS (SELECT *, row_number() OVER (PARTITION BY stream_id, segment_id ORDER BY seq) - 1 AS idx FROM s),
report AS (
  SELECT stream_id, segment_id, arg_min(label, seq) AS label, count(*) AS samples, arg_min(t, seq) AS start_ms, arg_max(t, seq) AS end_ms,
         CASE WHEN count(*) >= 16 THEN 'KEPT' ELSE 'REJECTED' END AS status, CASE WHEN count(*) >= 16 THEN 'valid' ELSE 'too_short' END AS reason
  FROM si GROUP BY stream_id, segment_id)"""
LINES = f"""l AS (
  SELECT l_suppkey AS stream_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount + 0.0::DOUBLE, l_tax + 0.0::DOUBLE, l_returnflag, l_linestatus, l_shipdate) - 1 AS seq,
         l_quantity AS x, (l_tax + 0.0::DOUBLE) * 100 AS y, l_extendedprice / 1000 AS z, (l_discount + 0.0::DOUBLE) * 100 - 5 AS zf, {CLASS.format('l_suppkey')} AS label
  FROM lineitem)"""


def line_windows(size: int, hop: int) -> str:
    """w: a row for each sample of each complete window; full: a row for each window."""
    return f"""{LINES},
w0 AS (SELECT *, unnest(range(greatest(0, seq // {hop} - {size // hop - 1}), seq // {hop} + 1)) AS local_id FROM l),
full_ AS (SELECT stream_id, local_id, any_value(label) AS label FROM w0 GROUP BY stream_id, local_id HAVING count(*) = {size}),
w AS (SELECT w0.*, 0::BIGINT AS segment_id, seq - local_id * {hop} AS i FROM w0 JOIN full_ USING (stream_id, local_id))"""


WINDOWS = line_windows(128, 64)
WINDOW_KEYS = "stream_id, segment_id, local_id"
TIME = f"""m AS (SELECT *, z - avg(z) OVER (PARTITION BY stream_id, local_id) AS c FROM w),
tf AS (
  SELECT stream_id, segment_id, local_id, any_value(label) AS label, sqrt(avg(x * x)) AS rms_x, sqrt(avg(y * y)) AS rms_y, sqrt(avg(z * z)) AS rms_z,
         max(abs(c)) / sqrt(avg(c * c)) AS crest, avg(c * c * c * c) / (avg(c * c) * avg(c * c)) - 3 AS kurt
  FROM m GROUP BY stream_id, segment_id, local_id)"""
# no mean is removed before the transform
LINE_SPECTRUM = """spec AS (
  SELECT stream_id, local_id, k, sqrt(pow(sum(v * cos(2 * pi() * k * i / 128)), 2) + pow(sum(v * sin(2 * pi() * k * i / 128)), 2)) / 128 AS mag
  FROM (SELECT stream_id, local_id, i, zf * (0.5 - 0.5 * cos(2 * pi() * i / 127)) AS v FROM w), range(0, 65) g(k) GROUP BY stream_id, local_id, k)"""
EMB = f"""emb AS (SELECT vec_id, {CLASS.format('label')} AS label, embedding[i + 1]::DOUBLE AS z, i FROM embeddings, range(0, 64) g(i)),
mags AS (
  SELECT vec_id, k, sqrt(pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2)) / 64 AS mag, k * 500.0::DOUBLE / 64 AS f
  FROM (SELECT vec_id, i, z * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS v FROM emb), range(0, 33) g(k) GROUP BY vec_id, k)"""


def band(mag: str, f: str, low: float, high: float, closed: bool) -> str:
    return f"coalesce(sum(CASE WHEN {f} >= {low} AND {f} {'<=' if closed else '<'} {high} THEN {mag} * {mag} END), 0)"


BAND_SQL = {name: (low, high, name == BANDS[-1][0]) for name, low, high in BANDS}
FEATURES = ("RMS_X", "RMS_Y", "RMS_Z", "Band_Power_Z_Low", "Band_Power_Z_Mid", "Band_Power_Z_High", "CrestFactor_Z", "Kurtosis_Z")
EMB_FEATURES = "ef AS (SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(FEATURES)) + f", {CLASS.format('label')} AS label FROM embeddings)"
NAMES = "['healthy', 'normal', 'good', 'imbalance', 'imbalanced', 'obstruction', 'clogged', 'blocked', 'unknown']"
PATHS = f"paths AS (SELECT event_id, {NAMES}[event_id % 9 + 1] AS folder, user_id || '_' || {NAMES}[user_id % 9 + 1] || '_' || event_type AS stem FROM events)"
ALIAS_CASE = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in ALIASES.items()) + " ELSE {0} END"
CLASS_LIST = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
ALIAS_LIST = "[" + ", ".join(f"'{a}'" for a in ALIASES) + "]"

ODD_LABELS = f"""{E2},
odd AS (SELECT * EXCLUDE (label), CASE WHEN stream_id % 4 = 1 THEN 'Normal' WHEN stream_id % 4 = 2 AND seq % 2 = 1 THEN 'obstruction' WHEN stream_id % 4 = 3 THEN NULL ELSE label END AS label FROM dts),
firsts AS (SELECT stream_id, label, min(seq) AS first FROM odd WHERE label IS NOT NULL GROUP BY stream_id, label),
lab AS (SELECT stream_id, count(*) AS n_labels, string_agg(label, ';' ORDER BY first, label) AS labels FROM firsts GROUP BY stream_id),
prof AS (SELECT s.stream_id, coalesce(n_labels, 0) AS n_labels, CASE WHEN n_labels = 1 THEN {ALIAS_CASE.format('lower(labels)')} ELSE labels END AS label,
         coalesce(n_labels = 1 AND {ALIAS_CASE.format('lower(labels)')} <> lower(labels), false) AS renamed
         FROM (SELECT DISTINCT stream_id FROM e) s LEFT JOIN lab USING (stream_id))"""


def facts(source: str, expected: str, low: str, high: str, gap: str, rate: str, extreme: str) -> str:
    """A row for each stream with what the validation counts, from source (stream_id, seq, t, dt, x, y, z)."""
    return f"""f0 AS (
  SELECT stream_id, count(*) AS total_samples, avg(dt) AS mean_dt, stddev_samp(dt) AS std_dt, count_if(dt <= 0) AS n_back, count_if(dt < {low} OR dt > {high}) AS n_bad, count_if(dt > {gap}) AS n_gap,
         count(*) - count(DISTINCT t) AS n_same, count_if(greatest(abs(x), abs(y), abs(z)) > {extreme}) AS n_extreme
  FROM {source} GROUP BY stream_id),
f AS (SELECT *, CASE WHEN mean_dt > 0 THEN abs(1000 / mean_dt - {rate}) / {rate} END AS fs_error, CASE WHEN mean_dt > 0 THEN coalesce(std_dt / mean_dt, 0) END AS jitter FROM f0)"""


EVENT_FACTS = facts("dts", "26e6", "13e6", "39e6", "86.4e6", "(1000::DOUBLE / 26e6)", "100")


def reasons(real: bool, labels: bool) -> str:
    soft = "WARNING" if real else "FAIL"
    w = "warning" if real else "fail"
    rules = []
    if labels:
        rules += [
            ("WARNING", "renamed", "'label_normalized_to_' || label"),
            ("FAIL" if real else "WARNING", "n_labels = 0", "'missing_label_column_and_cannot_infer_from_filename'" if real else "'label_column_empty_using_filename'"),
            ("FAIL", "n_labels > 1", "'mixed_labels_in_file'"),
            ("FAIL", f"label IS NULL OR NOT list_contains({CLASS_LIST}, label)", "'invalid_or_missing_label: ' || coalesce(label, 'None')"),
        ]
    rules += [
        ("WARNING", "n_extreme > 0", "'extreme_sensor_values_detected'"),
        ("FAIL", "n_back > 0", "'non_increasing_timestamp'"),
        ("FAIL", "n_same > 0", "'duplicate_timestamps'"),
        (soft, "n_bad > 0", "'inconsistent_sampling_interval'"),
        (soft, "n_gap > 0", f"'large_timestamp_gap{'_warning' if real else ''}'"),
        (soft, "fs_error > 0.10", f"'effective_sampling_rate_deviation_{w}'"),
        ("WARNING", "fs_error > 0.05 AND fs_error <= 0.10", "'effective_sampling_rate_deviation_warning'"),
        (soft, "jitter > 0.20", f"'high_sampling_jitter_{w}'"),
    ]
    cases = ", ".join(f"CASE WHEN {c} THEN '{s}|' || {t} END" for s, c, t in rules)
    return f"list_filter([{cases}], lambda v: v IS NOT NULL)"


def verdict(found: str, source: str) -> str:
    return f"""v AS (SELECT *, {found} AS found FROM {source}),
verdicts AS (SELECT *, CASE WHEN len(list_filter(found, lambda v: starts_with(v, 'FAIL'))) > 0 THEN 'FAIL' WHEN len(found) > 0 THEN 'WARNING' ELSE 'PASS' END AS status,
         CASE WHEN len(found) = 0 THEN 'ok' ELSE array_to_string(list_transform(found, lambda v: split_part(v, '|', 2)), ';') END AS reasons FROM v)"""


def validated(real: bool) -> str:
    return f"{ODD_LABELS}, {EVENT_FACTS}, joined AS (SELECT f.*, n_labels, label, renamed FROM f JOIN prof USING (stream_id)), {verdict(reasons(real, True), 'joined')}"


def line_validated(source: str, real: bool) -> str:
    return f"{facts(source, '2', '1', '3', '12', '500', '1000')}, {verdict(reasons(real, False), 'f')}"


LINE_DTS = f"{LINES}, ld AS (SELECT *, seq * 2.0::DOUBLE AS t, CASE WHEN seq > 0 THEN 2.0::DOUBLE END AS dt FROM l)"
HOLED = "CASE WHEN stream_id % 9 = 0 AND i = 7 THEN NULL WHEN stream_id % 9 = 1 AND i = 9 THEN 'inf'::DOUBLE ELSE x END"
SPLIT = """dig AS (SELECT *, md5('42:' || vec_id) AS dg FROM ef),
sp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dg, vec_id) <= ceil(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM dig)"""


def logits() -> str:
    z = [f"(({c} - 0.01) / 0.1)" for c in FEATURES]
    out = []
    for i, b in enumerate((0.1, -0.2, 0.05)):
        out.append(f"{b!r}::DOUBLE + " + " + ".join(f"{x} * ({math.cos(5 * i + j)!r}::DOUBLE)" for j, x in enumerate(z)))
    return ", ".join(f"{o} AS g{i}" for i, o in enumerate(out))


SOFTMAX = f"{EMB_FEATURES}, lg AS (SELECT vec_id, label, {logits()} FROM ef), ex AS (SELECT *, exp(g0 - greatest(g0, g1, g2)) AS e0, exp(g1 - greatest(g0, g1, g2)) AS e1, exp(g2 - greatest(g0, g1, g2)) AS e2 FROM lg), pr AS (SELECT vec_id, label, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM ex)"
SIGMOID = f"{EMB_FEATURES}, lg AS (SELECT vec_id, label, {logits()} FROM ef), pr AS (SELECT vec_id, label, 1 / (1 + exp(-g0)) AS p0, 1 / (1 + exp(-g1)) AS p1, 1 / (1 + exp(-g2)) AS p2 FROM lg)"
BEST = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'healthy' WHEN p1 >= p2 THEN 'imbalanced' ELSE 'obstruction' END"
SCORES = f"SELECT vec_id, {BEST} AS prediction, {r('greatest(p0, p1, p2)')} AS confidence, {r('p0')} AS p0, {r('p1')} AS p1, {r('p2')} AS p2 FROM pr"


def dense() -> str:
    parts, names = [EMB_FEATURES], [f"(({c} - 0.01) / 0.1)" for c in FEATURES]
    sizes, source = (8, 16, 8, 3), "ef"
    for k, (n, m) in enumerate(zip(sizes, sizes[1:])):
        cols = []
        for i in range(m):
            value = f"{0.1 * math.sin(i + k)!r}::DOUBLE + " + " + ".join(f"{names[j]} * ({math.cos(7 * i + 3 * j + k) / math.sqrt(n)!r}::DOUBLE)" for j in range(n))
            cols.append(f"{value if k == 2 else f'greatest({value}, 0)'} AS {'g' if k == 2 else f'h{k}_'}{i}")
        parts.append(f"d{k} AS (SELECT vec_id, {', '.join(cols)} FROM {source})")
        names, source = [f"h{k}_{i}" for i in range(m)], f"d{k}"
    parts.append("ex AS (SELECT vec_id, exp(g0 - greatest(g0, g1, g2)) AS e0, exp(g1 - greatest(g0, g1, g2)) AS e1, exp(g2 - greatest(g0, g1, g2)) AS e2 FROM d2), pr AS (SELECT vec_id, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM ex)")
    return ", ".join(parts)


LOG = f"""good AS (SELECT user_id AS device, event_id, {CLASS.format('user_id')} AS prediction, round(least(1, value / 100), 4) AS confidence, 'on' AS fan_state, event_type, value, {K} AS k FROM events WHERE event_type IN ('click', 'purchase')),
log AS (SELECT device, event_id, event_id::VARCHAR AS timestamp, prediction, {r('confidence')} AS confidence, fan_state,
  CASE WHEN event_type <> 'click' THEN {r('value')} END AS rms_x, CASE WHEN event_type <> 'click' THEN {r('value / 2')} END AS rms_y, CASE WHEN event_type <> 'click' THEN {r('k')} END AS rms_z,
  CASE WHEN event_type <> 'click' THEN {r('k / 2')} END AS bp_low, CASE WHEN event_type <> 'click' THEN {r('k / 4')} END AS bp_mid, CASE WHEN event_type <> 'click' THEN {r('k / 8')} END AS bp_high FROM good)"""

REPORT_ROWS = f"""cell AS (SELECT label, {BEST} AS prediction, count(*) AS n FROM pr GROUP BY 1, 2),
one AS (SELECT c AS label, coalesce(sum(CASE WHEN label = c AND prediction = c THEN n END), 0) AS tp, coalesce(sum(CASE WHEN prediction = c THEN n END), 0) AS p, coalesce(sum(CASE WHEN label = c THEN n END), 0) AS s FROM cell, unnest({CLASS_LIST}) u(c) GROUP BY c),
rates AS (SELECT label, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS precision, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS recall, CASE WHEN p + s > 0 THEN 2 * tp / (p + s) ELSE 0 END AS f1, s AS support, tp FROM one),
reps AS (SELECT label, precision, recall, f1, support FROM rates
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rates
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM rates
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM rates)"""

FEATURE_SELECT = f"""bp AS (SELECT stream_id, local_id, {', '.join(f"{band('mag', '(k * 500.0::DOUBLE / 128)', *BAND_SQL[n])} AS {n}" for n in BAND_SQL)} FROM spec GROUP BY stream_id, local_id)
SELECT {WINDOW_KEYS}, {r('rms_x')} AS "RMS_X", {r('rms_y')} AS "RMS_Y", {r('rms_z')} AS "RMS_Z", {r('low')} AS "Band_Power_Z_Low", {r('mid')} AS "Band_Power_Z_Mid", {r('high')} AS "Band_Power_Z_High", {r('crest')} AS "CrestFactor_Z", {r('kurt')} AS "Kurtosis_Z", label
FROM tf JOIN bp USING (stream_id, local_id)"""

LIVE_SCORES = f"""WITH RECURSIVE {LINES.replace('l AS (', 'l0 AS (', 1)},
hp AS (
  SELECT stream_id, seq, z, 0.9936::DOUBLE * z AS h FROM l0 WHERE seq = 0
  UNION ALL SELECT l0.stream_id, l0.seq, l0.z, 0.9936::DOUBLE * (hp.h + l0.z - hp.z) FROM hp JOIN l0 ON l0.stream_id = hp.stream_id AND l0.seq = hp.seq + 1),
l AS (SELECT l0.* EXCLUDE (zf), hp.h AS zf FROM l0 JOIN hp USING (stream_id, seq)),
{WINDOWS.removeprefix(LINES + ',')}, {TIME}, {LINE_SPECTRUM}, {FEATURE_SELECT.partition('SELECT stream_id, segment_id')[0]},
q AS (SELECT stream_id, local_id, sqrt(avg(zf * zf)) AS rms FROM w GROUP BY 1, 2),
t AS (SELECT stream_id, local_id, rms, lag(rms) OVER (PARTITION BY stream_id ORDER BY local_id) AS before FROM q),
ef AS (SELECT stream_id, local_id, coalesce(before > 0 AND abs(rms - before) / before > 0.05, false) AS is_transient,
  {', '.join(f'{own} AS "{c}"' for own, c in zip(('rms_x', 'rms_y', 'rms_z', 'low', 'mid', 'high', 'crest', 'kurt'), FEATURES))}
  FROM tf JOIN bp USING (stream_id, local_id) JOIN t USING (stream_id, local_id)),
lg AS (SELECT *, {logits()} FROM ef),
ex AS (SELECT *, exp(g0 - greatest(g0, g1, g2)) AS e0, exp(g1 - greatest(g0, g1, g2)) AS e1, exp(g2 - greatest(g0, g1, g2)) AS e2 FROM lg),
pr AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM ex)
SELECT stream_id, local_id, is_transient, {', '.join(f'{r(c)} AS "{c}"' for c in FEATURES)}, {BEST} AS prediction, {r('greatest(p0, p1, p2)')} AS confidence, 20 AS n_raw, {BEST} AS told FROM pr"""

SQL: dict[str, str] = {
    "normalize_label": f"WITH {PATHS}, p AS (SELECT ' ' || upper(folder) AS raw, folder FROM paths) SELECT raw, {ALIAS_CASE.format('folder')} AS label, count(*) AS n FROM p GROUP BY 1, 2",
    "path_labels": f"""WITH {PATHS}, a AS (SELECT *, list_filter({CLASS_LIST}, lambda c: contains(stem, c)) AS named, list_distinct(list_transform(list_filter({ALIAS_LIST}, lambda c: contains(stem, c)), lambda c: {ALIAS_CASE.format('c')})) AS found FROM paths)
      SELECT CASE WHEN len(named) = 1 THEN named[1] END AS by_stem, CASE WHEN list_contains({CLASS_LIST}, folder) THEN folder WHEN len(found) = 1 THEN found[1] END AS by_path,
        CASE WHEN list_contains({CLASS_LIST}, folder) THEN folder ELSE named[1] END AS by_first, count(*) AS n FROM a GROUP BY 1, 2, 3""",
    "rewrite_labels": f"WITH {E} SELECT stream_id, {CLASS_LIST}[stream_id % 2 + 1] AS label, count(*) AS n, bool_or(label <> {CLASS_LIST}[stream_id % 2 + 1]) AS relabeled FROM e GROUP BY 1, 2",
    "to_number": f"SELECT event_id, CASE WHEN event_type IN ('view', 'purchase') THEN {r('value')} END AS number FROM events",
    "drop_bad_rows": f"WITH {E} SELECT stream_id, count(*) AS n FROM e WHERE seq % 7 <> 0 GROUP BY stream_id",
    "header_rows": "SELECT user_id AS stream_id, bool_or(event_type = 'view') AS repeated_header FROM events GROUP BY user_id",
    "resolve_column": "SELECT count(value) AS n, round(sum(value), 2) AS total FROM events",
    "scale_counts": f"SELECT l_suppkey, {r('sum(l_quantity / 2048)')} AS g, {r('sum(l_extendedprice / 16384)')} AS fine, {r('max(l_partkey / 1000)')} AS ms FROM lineitem GROUP BY l_suppkey",
    "finite_rows": f"WITH {LINES} SELECT stream_id, count(*) AS n FROM l WHERE seq % 11 <> 0 AND seq % 13 <> 0 GROUP BY stream_id",
    "confidence_level": """WITH c AS (SELECT round(value / 100, 1) AS c FROM events)
      SELECT CASE WHEN c > 0.7::DOUBLE THEN 'high' WHEN c > 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS level, CASE WHEN c >= 0.7::DOUBLE THEN 'high' WHEN c >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS bar, count(*) AS n FROM c GROUP BY 1, 2""",
    "dt_profile": f"""WITH {E2}, a AS (SELECT stream_id, avg(dt) AS m, stddev_samp(dt) AS s, min(dt) AS lo, max(dt) AS hi FROM dts GROUP BY stream_id)
      SELECT stream_id, {r('m', 2)} AS mean_dt_ms, {r('s', 2)} AS std_dt_ms, {r('lo', 2)} AS min_dt_ms, {r('hi', 2)} AS max_dt_ms, {r('CASE WHEN m > 0 THEN 1000 / m END', 2)} AS effective_fs,
        {r('CASE WHEN m > 0 THEN abs(1000 / m - 1000 / 26e6) / (1000 / 26e6) END', 2)} AS fs_error_ratio, {r('CASE WHEN m > 0 THEN coalesce(s / m, 0) END', 2)} AS jitter_ratio FROM a""",
    "timing_faults": f"""WITH {E2} SELECT stream_id, count_if(dt <= 0) AS num_non_increasing_ts, count_if(dt < 13e6 OR dt > 39e6) AS num_bad_dt, count_if(dt > 86.4e6) AS num_large_gaps,
        CAST(greatest(0, coalesce(sum(CASE WHEN dt > 86.4e6 THEN round_even(dt / 26e6, 0) - 1 END), 0)) AS BIGINT) AS estimated_missing_samples, count(*) - count(DISTINCT t) AS num_duplicate_timestamps FROM dts GROUP BY stream_id""",
    "value_faults": f"WITH {E} SELECT stream_id, count_if(seq % 17 = 0) AS num_nan_rows, count_if(seq % 17 <> 0 AND seq % 19 = 0) AS num_inf_rows, count_if((seq % 17 <> 0 AND (seq % 19 = 0 OR x > 100)) OR y > 100 OR abs(z) > 100) AS num_extreme_sensor_rows FROM e GROUP BY stream_id",
    "label_profile": f"WITH {ODD_LABELS} SELECT * FROM prof",
    "validate_mock": f"WITH {validated(False)} SELECT stream_id, label, total_samples, status, reasons FROM verdicts",
    "validate_real": f"WITH {validated(True)} SELECT stream_id, label, total_samples, status, reasons FROM verdicts",
    "validation_summary": f"""WITH a AS (WITH {validated(True)} SELECT status FROM verdicts), b AS (WITH {LINE_DTS}, {line_validated('ld', False)} SELECT status FROM verdicts), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
      SELECT count(*) AS total, count_if(status = 'PASS') AS pass, count_if(status = 'WARNING') AS warning, count_if(status = 'FAIL') AS fail FROM u""",
    "status_mismatch": f"""WITH a AS (WITH {LINE_DTS}, {line_validated('ld', False)} SELECT status FROM verdicts), b AS (WITH {E2}, {EVENT_FACTS}, {verdict(reasons(False, False), 'f')} SELECT status FROM verdicts)
      SELECT (SELECT count_if(status <> 'PASS') FROM a) + (SELECT count_if(status <> 'FAIL') FROM b) AS mismatches, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS total""",
    "route": f"""WITH {LINES}, n AS (SELECT stream_id, count(*) AS samples, stream_id % 3 = 0 AS warned FROM l GROUP BY stream_id)
      SELECT flag AS accept_warnings, side, coalesce(CAST(sum(samples) AS BIGINT), 0) AS samples, count(samples) AS streams
      FROM (SELECT unnest([false, true]) AS flag), (SELECT unnest(['accepted', 'rejected']) AS side) LEFT JOIN n ON (side = 'accepted') = (flag OR NOT warned) GROUP BY 1, 2""",
    "ingest": f"""WITH {LINES}, n AS (SELECT stream_id, count(*) AS samples FROM l GROUP BY stream_id)
      SELECT CASE WHEN stream_id % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS side, CAST(sum(samples) AS BIGINT) AS samples, count(*) AS streams, count(DISTINCT stream_id % 2) AS ingests FROM n GROUP BY 1""",
    "segment_report": f"""WITH {SEGMENTS} SELECT stream_id, segment_id, label, samples, {r('start_ms', 3)} AS start_ms, {r('end_ms', 3)} AS end_ms, status, reason, {r('samples / (1000 / 26e6)', 3)} AS duration_s,
        CASE WHEN status = 'KEPT' THEN CAST(count_if(status = 'KEPT') OVER (PARTITION BY stream_id ORDER BY segment_id) - 1 AS BIGINT) END AS kept_segment_id FROM report""",
    "split_long_streams": f"WITH {SEGMENTS} SELECT stream_id, segment_id, count(*) AS samples, min(seq) AS first, max(idx) AS last_idx FROM si GROUP BY 1, 2",
    "kept_samples": f"WITH {SEGMENTS} SELECT stream_id, count(*) AS n, {r('sum(x)', 4)} AS x FROM si JOIN report USING (stream_id, segment_id) WHERE status = 'KEPT' GROUP BY stream_id",
    "segment_summary": f"WITH {SEGMENTS} SELECT label, status, count(*) AS segments FROM report GROUP BY 1, 2",
    "segment_precheck": "SELECT DISTINCT user_id AS stream_id, CASE WHEN user_id % 5 IN (1, 2, 3) THEN 'FAILED' ELSE 'OK' END AS status, CASE user_id % 5 WHEN 1 THEN 'no_label' WHEN 2 THEN 'invalid_label' WHEN 3 THEN 'no_numeric_rows' ELSE 'ok' END AS reason FROM events",
    "validate_segments": f"WITH {SEGMENTS} SELECT stream_id, segment_id, CASE WHEN samples < 16 THEN 'FAILED' ELSE 'OK' END AS status, CASE WHEN samples < 16 THEN 'too_short' ELSE 'valid' END AS reason FROM report",
    "sliding_windows": f"WITH {WINDOWS} SELECT {WINDOW_KEYS}, local_id * 64 AS start_idx, any_value(label) AS label, {r('sum(x)')} AS x, {r('sum(zf)')} AS z, {r('arg_min(z, i)')} AS first, {r('arg_max(z, i)')} AS last FROM w GROUP BY {WINDOW_KEYS}",
    "tumbling_windows": f"WITH {line_windows(128, 128)} SELECT {WINDOW_KEYS}, local_id * 128 AS start_idx, {r('sum(x)', 4)} AS x FROM w GROUP BY {WINDOW_KEYS}",
    "window_report": f"WITH {WINDOWS} SELECT {WINDOW_KEYS}, any_value(label) AS label, min(seq) AS start_idx, max(seq) + 1 AS end_idx_exclusive, max(seq) AS end_idx_inclusive, min(seq) * 2.0::DOUBLE AS start_ms, max(seq) * 2.0::DOUBLE AS end_ms, count(*) AS size, {r('count(*) / 500')} AS duration_s FROM w GROUP BY {WINDOW_KEYS}",
    "cap_per_label": f"WITH {WINDOWS} SELECT stream_id, 0::BIGINT AS segment_id, local_id, label FROM full_ QUALIFY row_number() OVER (PARTITION BY label ORDER BY stream_id, local_id) <= 100",
    "label_shortfall": f"WITH {WINDOWS}, n AS (SELECT label, count(*) AS n FROM full_ WHERE label <> 'obstruction' GROUP BY label) SELECT c AS label, coalesce(n, 0) AS windows, greatest(0, 250 - coalesce(n, 0)) AS missing FROM unnest({CLASS_LIST}) u(c) LEFT JOIN n ON label = c",
    "global_window_id": f"WITH {WINDOWS} SELECT stream_id, 0::BIGINT AS segment_id, local_id, label, row_number() OVER (ORDER BY list_position({CLASS_LIST}, label), stream_id, local_id) - 1 AS window_id FROM full_",
    "window_summary": f"WITH {WINDOWS} SELECT label, count(*) AS windows FROM full_ GROUP BY label",
    "spectrum": f"WITH {EMB} SELECT vec_id, k::INTEGER AS bin, {r('mag', 8)} AS magnitude, {r('f', 8)} AS frequency_hz FROM mags",
    "fft_report": f"""WITH {WINDOWS}, o AS (SELECT stream_id, 0::BIGINT AS segment_id, local_id, CASE WHEN stream_id % 10 = 0 THEN 'unknown' WHEN stream_id % 7 = 0 THEN CASE WHEN local_id < 2 THEN 'healthy' ELSE 'obstruction' END ELSE label END AS label FROM full_),
      q AS (SELECT *, CASE WHEN local_id = 3 THEN 'invalid_window_size' WHEN stream_id % 7 = 0 AND local_id < 2 THEN 'mixed_labels' WHEN label = 'unknown' THEN 'invalid_label' ELSE 'valid' END AS reason FROM o)
      SELECT {WINDOW_KEYS}, label, CASE WHEN reason = 'valid' THEN 'OK' ELSE 'FAIL' END AS status, reason, CASE WHEN reason = 'valid' THEN 65::INTEGER END AS n_bins, CASE WHEN reason = 'valid' THEN 250.0::DOUBLE END AS max_frequency_hz, CASE WHEN reason = 'valid' THEN 3.90625::DOUBLE END AS resolution_hz, false AS dc_removed FROM q""",
    "spectrum_warnings": """SELECT vec_id, CASE vec_id % 5 WHEN 1 THEN 'length_mismatch' WHEN 2 THEN 'negative_magnitude' WHEN 3 THEN 'nan_found' WHEN 4 THEN 'invalid_bins | length_mismatch | unexpected_maximum_frequency' ELSE '' END AS warnings FROM embeddings""",
    "spectral_table": f"""WITH {EMB}, c AS (SELECT vec_id, sum(f * mag) / sum(mag) AS c FROM mags GROUP BY vec_id)
      SELECT vec_id, {r('arg_max(f, mag)')} AS dominant_frequency, {r('max(mag)')} AS max_magnitude, {r('avg(mag)')} AS mean_magnitude, {r('stddev_pop(mag)')} AS std_magnitude, {r('sum(mag * mag)')} AS total_energy, {r('any_value(c)')} AS spectral_centroid,
        {r('sqrt(sum((f - c) * (f - c) * mag) / sum(mag))')} AS spectral_bandwidth, {', '.join(f'{r(band("mag", "f", *BAND_SQL[n]))} AS "Band_Power_Z_{n.capitalize()}"' for n in BAND_SQL)} FROM mags JOIN c USING (vec_id) GROUP BY vec_id""",
    "band_power_by_table": f"WITH {EMB} " + " UNION ALL ".join(f"SELECT vec_id, '{n}' AS band, {r(band('mag', 'f', *BAND_SQL[n]), 8)} AS power FROM mags GROUP BY vec_id" for n in BAND_SQL),
    "band_power_bins": f"WITH {EMB} SELECT vec_id, " + ", ".join(f"{r(f'sum(CASE WHEN k >= {int(lo / 7.8125)} AND k {chr(60) + chr(61) if c else chr(60)} {int(hi / 7.8125)} THEN mag * mag END)', 8)} AS {n}" for n, (lo, hi, c) in BAND_SQL.items()) + " FROM mags GROUP BY vec_id",
    "band_power_unscaled": f"WITH {EMB} SELECT vec_id, " + ", ".join(f"{r(band('(mag * 64)', 'f', lo, hi, False))} AS {n}" for n, (lo, hi, _) in BAND_SQL.items()) + " FROM mags WHERE k < 32 GROUP BY vec_id",
    "band_share": f"""WITH {EMB}, p AS (SELECT vec_id, sum(CASE WHEN f <= 50 THEN mag * mag * 4096 ELSE 0 END) AS lo, sum(CASE WHEN f > 50 AND f <= 200 THEN mag * mag * 4096 ELSE 0 END) AS mi, sum(CASE WHEN f > 200 AND f <= 300 THEN mag * mag * 4096 ELSE 0 END) AS hi FROM mags GROUP BY vec_id),
      s AS (SELECT vec_id, lo / (lo + mi + hi + 1e-9) AS low, mi / (lo + mi + hi + 1e-9) AS mid, hi / (lo + mi + hi + 1e-9) AS high FROM p)
      SELECT vec_id, {r('low')} AS low, {r('mid')} AS mid, {r('high')} AS high, CASE WHEN high > 0.3 THEN 'high' WHEN mid > 0.3 THEN 'medium' ELSE 'normal' END AS level FROM s""",
    "tapered_energy": f"WITH {EMB} SELECT vec_id, {r('sum(pow(z * (0.5 - 0.5 * cos(2 * pi() * i / 63)), 2))', 8)} AS energy FROM emb GROUP BY vec_id",
    "time_features": f"""WITH {WINDOWS}, {TIME} SELECT {WINDOW_KEYS}, {r('rms_x')} AS "RMS_X", {r('rms_y')} AS "RMS_Y", {r('rms_z')} AS "RMS_Z", {r('crest')} AS "CrestFactor_Z", {r('kurt')} AS "Kurtosis_Z" FROM tf""",
    "edge_kurtosis": f"WITH {WINDOWS}, {TIME} SELECT {WINDOW_KEYS}, {r('CASE WHEN stream_id % 4 = 0 THEN 0 ELSE kurt END')} AS kurtosis, {r('CASE WHEN stream_id % 4 = 0 THEN 0 ELSE crest END')} AS crest FROM tf",
    "features": f"WITH {WINDOWS}, {TIME}, {LINE_SPECTRUM}, {FEATURE_SELECT}",
    "window_quality": f"""WITH {WINDOWS} SELECT stream_id, 0::BIGINT AS segment_id, local_id, CASE stream_id % 9 WHEN 0 THEN 'nan_in_window' WHEN 1 THEN 'infinite_in_window' ELSE '' END AS warnings, stream_id % 9 > 1 AS usable FROM full_""",
    "feature_report": f"""WITH {WINDOWS} SELECT stream_id, 0::BIGINT AS segment_id, local_id, label, CASE WHEN stream_id % 9 <= 1 THEN 'FAILED' ELSE 'OK' END AS status, 65 AS n_bins, 0.0::DOUBLE AS freq_min, 250.0::DOUBLE AS freq_max, CASE stream_id % 9 WHEN 0 THEN 'nan_in_window' WHEN 1 THEN 'infinite_in_window' ELSE '' END AS warnings FROM full_""",
    "join_spectra_windows": f"WITH {WINDOWS} SELECT stream_id, 0::BIGINT AS segment_id, local_id, CASE WHEN local_id = 2 THEN 'FAILED' ELSE 'OK' END AS status FROM full_",
    "feature_summary": f"WITH {WINDOWS} SELECT label, count(*) AS rows FROM full_ GROUP BY label",
    "missing_per_column": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {'count_if(vec_id % 6 = 0)' if c == 'RMS_X' else '0::BIGINT'} AS missing FROM embeddings{'' if c == 'RMS_X' else ' HAVING true'}" for c in FEATURES),
    "high_pass": f"""WITH RECURSIVE {LINES}, hp AS (
      SELECT stream_id, seq, x, z, 0.9936::DOUBLE * x AS hx, 0.9936::DOUBLE * z AS hz FROM l WHERE seq = 0
      UNION ALL SELECT l.stream_id, l.seq, l.x, l.z, 0.9936::DOUBLE * (hp.hx + l.x - hp.x), 0.9936::DOUBLE * (hp.hz + l.z - hp.z) FROM hp JOIN l ON l.stream_id = hp.stream_id AND l.seq = hp.seq + 1)
      SELECT stream_id, seq, {r('hx')} AS hp_x, {r('hz')} AS hp_z FROM hp WHERE seq >= 500""",
    "transients": f"""WITH {SEGMENTS}, w0 AS (SELECT *, unnest(range(greatest(0, idx // 8 - 1), idx // 8 + 1)) AS local_id FROM si),
      q AS (SELECT {WINDOW_KEYS}, sqrt(avg(zf * zf)) AS rms FROM w0 GROUP BY {WINDOW_KEYS} HAVING count(*) = 16), p AS (SELECT *, lag(rms) OVER (PARTITION BY stream_id ORDER BY segment_id, local_id) AS before FROM q)
      SELECT {WINDOW_KEYS}, {r('rms')} AS "RMS_Z", coalesce(before > 0 AND abs(rms - before) / before > 0.1, false) AS is_transient FROM p""",
    "check_features": f"WITH {EMB_FEATURES}, c AS (SELECT 'row_count' AS \"check\", abs(count(*) - 500) AS failures FROM ef "
    + " ".join(f"UNION ALL SELECT 'missing:{c}', count_if({c} IS NULL) FROM ef UNION ALL SELECT 'not_finite:{c}', count_if({c} IS NULL) FROM ef" + ("" if c == "RMS_Y" else f" UNION ALL SELECT 'negative:{c}', count_if({c} < 0) FROM ef") for c in FEATURES)
    + " UNION ALL SELECT 'out_of_range:RMS_Y', count_if(RMS_Y < 0 OR RMS_Y > 0.2) FROM ef) SELECT \"check\", failures, failures = 0 AS ok FROM c",
    "class_distribution": f"""WITH {EMB_FEATURES}, n AS (SELECT label, count(*) AS n FROM ef GROUP BY label), x AS (SELECT * FROM (VALUES ('healthy', 200), ('imbalanced', 150), ('other', 1)) v(label, expected))
      SELECT coalesce(n.label, x.label) AS label, coalesce(n, 0) AS rows, coalesce(expected, 0)::BIGINT AS expected, coalesce(n, 0) = coalesce(expected, 0) AS ok FROM n FULL JOIN x ON n.label = x.label""",
    "class_means": f"WITH {EMB_FEATURES} SELECT label, " + ", ".join(f'{r(f"avg({c})")} AS "{c}"' for c in FEATURES) + " FROM ef GROUP BY label",
    "class_balance": f"WITH {EMB_FEATURES} SELECT label, count(*) AS rows, {r('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()')} AS percent FROM ef GROUP BY label",
    "window_index": f"WITH {EMB_FEATURES} SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS window_index FROM ef",
    "clipping": f"WITH {E} " + " UNION ALL ".join(f"SELECT label, '{n}' AS axis, {r(f'max(abs({c}))')} AS peak, max(abs({c})) >= 50 AS clipped FROM e GROUP BY label" for n, c in (("accX_raw", "x"), ("accY_raw", "y"), ("accZ_filt", "zf"))),
    "snr": f"""WITH {E}, v AS (SELECT label, var_pop(CASE WHEN label = 'obstruction' THEN x * 4 ELSE x END) AS v FROM e GROUP BY label), b AS (SELECT v AS noise FROM v WHERE label = 'healthy'), d AS (SELECT label, v, noise, 10 * log10(v / noise) AS db FROM v, b WHERE label <> 'healthy')
      SELECT label, {r('v', 4)} AS variance, {r('noise', 4)} AS noise, {r('db', 4)} AS snr_db, CASE WHEN db > 10 THEN 'well' WHEN db > 3 THEN 'fairly' ELSE 'poorly' END AS separable FROM d""",
    "histogram": f"""WITH {E}, b AS (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS w FROM e)
      SELECT CAST(least(floor((x - lo) / w), 49) AS BIGINT) AS bin, {r('any_value(lo) + bin * any_value(w)', 4)} AS low, {r('any_value(lo) + (bin + 1) * any_value(w)', 4)} AS high, count(*) AS rows FROM e, b GROUP BY 1""",
    "stratified_split": f"WITH {EMB_FEATURES}, {SPLIT} SELECT vec_id, label, is_test FROM sp",
    "scaled_features": f"WITH {EMB_FEATURES}, {SPLIT}, sc AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(FEATURES)) + " FROM sp WHERE NOT is_test) SELECT vec_id, " + ", ".join(f'{r(f"({c} - m{i}) / s{i}")} AS "{c}"' for i, c in enumerate(FEATURES)) + " FROM sp, sc",
    "encode_labels": f"WITH {EMB_FEATURES} SELECT label, list_position({CLASS_LIST}, label)::BIGINT - 1 AS code, label AS decoded, count(*) AS n FROM ef GROUP BY 1, 2, 3",
    "model_table_of_scaler": f"WITH {EMB_FEATURES}, sc AS (" + " UNION ALL ".join(f"SELECT {j} AS j, '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std FROM ef" for j, c in enumerate(FEATURES)) + f""") SELECT c AS label, {r('CAST([0.1, -0.2, 0.05][i + 1] AS FLOAT)::DOUBLE')} AS bias, feature, {r('mean::FLOAT::DOUBLE')} AS mean, {r('std::FLOAT::DOUBLE')} AS std, {r('cos(5 * i + j)::FLOAT::DOUBLE')} AS weight
      FROM sc, (SELECT unnest({CLASS_LIST}) AS c, unnest(range(3)) AS i) k""",
    "score_logreg": f"WITH {SOFTMAX} {SCORES}",
    "score_sigmoid": f"WITH {SIGMOID} {SCORES}",
    "score_mlp": f"WITH {dense()} {SCORES}",
    "logreg_gradient": f"SELECT label, feature, 0.0::DOUBLE AS gradient, n FROM (SELECT DISTINCT {CLASS.format('label')} AS label FROM embeddings), unnest({[*FEATURES, 'bias']}) u(feature), (SELECT count(*) AS n FROM embeddings)",
    "mlp_gradient": "SELECT layer, 0.0::DOUBLE AS gap, n FROM range(3) r(layer), (SELECT count(*) AS n FROM embeddings)",
    "confusion": f"WITH {SOFTMAX} SELECT CAST(list_position({CLASS_LIST}, c) - 1 AS INTEGER) AS place, c AS label, " + ", ".join(f"count_if(label = c AND {BEST} = '{x}') AS {x}" for x in CLASSES) + f" FROM pr, unnest({CLASS_LIST}) u(c) GROUP BY c",
    "classification_report": f"WITH {SOFTMAX}, {REPORT_ROWS} SELECT label, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, CAST(support AS BIGINT) AS support FROM reps",
    "parse_serial_lines": f"SELECT user_id AS device, count_if(event_type IN ('click', 'purchase')) AS n, {r(f'''sum(CASE WHEN event_type IN ('click', 'purchase') THEN -({K}) END)''')} AS total, count_if(event_type = 'signup') AS malformed, count_if(event_type = 'error') AS system FROM events GROUP BY user_id",
    "telemetry_log": f"WITH {LOG} SELECT * FROM log",
    "latest_snapshot": f"WITH g AS (SELECT *, {CLASS.format('user_id')} AS p FROM events WHERE event_type IN ('click', 'purchase', 'signup')) SELECT user_id AS device, max(event_id) AS event_id, arg_max(p, event_id) AS prediction, CASE WHEN arg_max(event_type, event_id) <> 'signup' THEN 'on' END AS fan_state FROM g GROUP BY user_id",
    "explode_scores": f"WITH g AS (SELECT event_id, least(1, value / 100) AS h FROM events WHERE event_type IN ('click', 'purchase', 'signup')), s AS (SELECT event_id, 'healthy' AS class, round(h, 4) AS s FROM g UNION ALL SELECT event_id, 'imbalanced', round(1 - h, 4) FROM g) SELECT event_id, class, {r('s')} AS score, {r('round(round(s * 100, 6), 1)')} AS percent FROM s",
    "history": f"WITH {LOG} SELECT * EXCLUDE (device) FROM log ORDER BY event_id DESC LIMIT 50",
    "to_telemetry_json": f"WITH {WINDOWS} SELECT {WINDOW_KEYS}, 20 AS n_raw, 32 AS n_mag, 3 AS n_scores, {r('arg_max(z, i)')} AS last_z, {r('sqrt(avg(x * x))')} AS rms_x FROM w GROUP BY {WINDOW_KEYS}",
    "export_log": f"WITH {LOG} SELECT * EXCLUDE (device, timestamp) FROM log",
    "write_by_label": f"WITH {WINDOWS} SELECT label, 2 * count(*) AS n, count(*) AS windows FROM full_ GROUP BY label",
    "read_samples": f"WITH {E} SELECT stream_id, seq, {r('t', 3)} AS timestamp_ms, {r('x', 3)} AS \"accX_raw\", {r('zf', 3)} AS \"accZ_filt\", label FROM e",
    "list_incoming": "SELECT 'PASS' AS status, 'ok' AS reason, count(DISTINCT user_id) AS files, count(*) AS rows FROM events",
    "validate_files": """WITH k AS (SELECT user_id, user_id % 8 AS kind FROM events)
      SELECT kind, mode, CASE kind WHEN 0 THEN '' WHEN 1 THEN 'missing_label_column;invalid_or_missing_label: None'
        WHEN 2 THEN CASE mode WHEN 'mock' THEN 'label_column_empty_using_filename' ELSE 'missing_label_column_and_cannot_infer_from_filename' END || ';invalid_or_missing_label: None'
        WHEN 3 THEN 'mixed_labels_in_file;invalid_or_missing_label: healthy;obstruction' WHEN 4 THEN 'missing_required_columns: accY_raw' WHEN 5 THEN 'empty_file' WHEN 6 THEN 'not_csv_file' ELSE 'cannot_read_file' END AS reasons,
        CASE kind WHEN 0 THEN 'ok' WHEN 1 THEN 'missing_columns: label' WHEN 2 THEN 'no_label' WHEN 3 THEN 'ok' WHEN 4 THEN 'missing_columns: accY_raw' WHEN 5 THEN 'empty_input' WHEN 7 THEN 'empty_input' END AS precheck,
        count(DISTINCT user_id) AS files, CASE WHEN kind < 5 THEN count(*) ELSE 0 END AS samples
      FROM k, (VALUES ('mock'), ('real')) m(mode) GROUP BY kind, mode""",
    "write_features": f"WITH {WINDOWS}, q AS (SELECT stream_id, local_id, sqrt(avg(x * x)) AS rms FROM w GROUP BY stream_id, local_id) SELECT count(*) AS n, {r('avg(rms)')} AS rms_x, count(*) AS ok FROM q",
    "stream_telemetry": f"WITH {LOG} SELECT * FROM log",
    "stream_windows": f"""WITH RECURSIVE {LINES}, hp AS (
      SELECT stream_id, seq, z, 0.9936::DOUBLE * z AS h FROM l WHERE seq = 0
      UNION ALL SELECT l.stream_id, l.seq, l.z, 0.9936::DOUBLE * (hp.h + l.z - hp.z) FROM hp JOIN l ON l.stream_id = hp.stream_id AND l.seq = hp.seq + 1),
      w0 AS (SELECT *, unnest(range(greatest(0, seq // 64 - 1), seq // 64 + 1)) AS local_id FROM hp),
      q AS (SELECT stream_id, local_id, sqrt(avg(h * h)) AS rms, arg_min(h, seq) AS first FROM w0 GROUP BY 1, 2 HAVING count(*) = 128),
      p AS (SELECT *, lag(rms) OVER (PARTITION BY stream_id ORDER BY local_id) AS before FROM q)
      SELECT stream_id, local_id, local_id * 64 AS start_seq, {r('rms')} AS rms, coalesce(before > 0 AND abs(rms - before) / before > 0.05, false) AS is_transient, {r('first')} AS first, 128 AS n FROM p""",
    "stream_scores": LIVE_SCORES,
}
SQL["stream_snapshot"] = SQL["latest_snapshot"]
# the same rows from tables that are dealt otherwise
SQL["join_bucketed"], SQL["kept_bucketed"] = SQL["join_spectra_windows"], SQL["kept_samples"]
