"""DuckDB SQL for the independent oracle check.

Each registered query has an ANSI-SQL twin written from the definitions (not
generated from the Spark plan).  Fragments here are shared by those SQL texts:
the events -> impressions adapter and the encodings.  DuckDB dialect notes:
``||`` is null-propagating (its ``concat`` is not), hex parses with
``cast('0x' || s as ubigint)``, and ``md5_number_upper`` is the first eight
digest bytes read little-endian.
"""

from __future__ import annotations

from impressa.schema import CATEGORICAL_COLS, FEATURE_INDEX, NUMERIC_COLS
from impressa.sources.events import (
    EPOCH, LABEL_BASE, LABEL_K_BONUS, LABEL_NIGHT_BONUS, NULLABLE_CATEGORICALS,
)


def _md5_hex(prefix: str, src: str, digits: int) -> str:
    return f"substr(md5('{prefix}' || CAST({src} AS VARCHAR)), 1, {digits})"


def adapter_cte(name: str = "imp") -> str:
    """``{name} AS (...)``: impressions from events, as in sources/events.py."""
    srcs = {0: "user_id", 1: "k", 2: "hr", 3: "(event_id % 1000)"}
    cats = []
    for c in CATEGORICAL_COLS:
        i = int(c[1:])
        e = _md5_hex(f"c{i}_", srcs[i % 4], 8)
        if i in NULLABLE_CATEGORICALS:
            e = f"CASE WHEN k % {i - 9} <> 0 THEN {e} END"
        cats.append(f"{e} AS {c}")
    u = f"CAST(('0x' || {_md5_hex('y_', 'event_id', 7)}) AS UBIGINT)"
    thr = (f"({LABEL_BASE} + CASE WHEN k >= 50 THEN {LABEL_K_BONUS} ELSE 0 END"
           f" + CASE WHEN hr < 6 THEN {LABEL_NIGHT_BONUS} ELSE 0 END)")
    return f"""_ev AS (
  SELECT CAST(event_id AS BIGINT) AS event_id, ts, CAST(user_id AS BIGINT) AS user_id,
         event_type, CAST(value AS DOUBLE) AS value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(hour(ts) AS BIGINT) AS hr
  FROM events
),
{name} AS (
  SELECT event_id,
    CAST(date_diff('day', DATE '{EPOCH}', CAST(ts AS DATE)) AS INTEGER) AS day,
    CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS INTEGER) AS label_click,
    CAST(CASE WHEN {u} % 1000 < {thr} THEN 1 ELSE 0 END AS INTEGER) AS label,
    CAST(floor(value) AS BIGINT) AS i1,
    CAST(user_id - 3 AS BIGINT) AS i2,
    hr AS i3,
    CAST(minute(ts) AS BIGINT) AS i4,
    CAST(second(ts) AS BIGINT) AS i5,
    k AS i6,
    k * k AS i7,
    user_id * 37 AS i8,
    CAST(floor(value * 100) AS BIGINT) AS i9,
    CASE WHEN k % 5 <> 0 THEN k - 2 END AS i10,
    CASE WHEN user_id % 7 <> 0 THEN user_id * user_id END AS i11,
    event_id % 11 AS i12,
    CAST(day(ts) AS BIGINT) AS i13,
    {", ".join(cats)}
  FROM _ev
)"""


def hex_to_uint(c: str) -> str:
    return (f"CASE WHEN regexp_full_match({c}, '[0-9A-Fa-f]{{1,8}}') "
            f"THEN CAST(CAST(('0x' || {c}) AS UBIGINT) AS BIGINT) END")


def log_square(c: str) -> str:
    return f"(CASE WHEN {c} > 2 THEN CAST(floor(pow(ln({c}), 2)) AS BIGINT) ELSE {c} END)"


def uint_to_hex8(v: str) -> str:
    return f"lpad(lower(hex({v})), 8, '0')"


def libsvm_line(label: str = "label") -> str:
    parts = [f"CAST({label} AS VARCHAR)"]
    parts += [f"'{FEATURE_INDEX[c]}:' || CAST({c} AS VARCHAR)" for c in NUMERIC_COLS]
    parts += [f"'{FEATURE_INDEX[c]}:' || CAST({hex_to_uint(c)} AS VARCHAR)" for c in CATEGORICAL_COLS]
    return "concat_ws(' ', " + ", ".join(parts) + ")"


def tokens() -> list[str]:
    out = [f"'{FEATURE_INDEX[c]}_' || CAST({log_square(c)} AS VARCHAR)" for c in NUMERIC_COLS]
    out += [f"'{FEATURE_INDEX[c]}_' || {uint_to_hex8(hex_to_uint(c))}" for c in CATEGORICAL_COLS]
    return out


def hash_index(tok: str, m: int) -> str:
    return f"CAST(md5_number_upper({tok}) % {int(m)} AS INTEGER)"


def hashed_indices(m: int) -> str:
    """Strictly ascending distinct INT list of hashed token indices."""
    items = ", ".join(hash_index(t, m) for t in tokens())
    return f"list_sort(list_distinct(list_filter([{items}], lambda x: x IS NOT NULL)))"


def hashed_rows_cte(m: int, name: str = "hrows", src: str = "imp") -> str:
    """``{name}(event_id, day, label, indices)`` from the adapter."""
    return (f"{name} AS (SELECT event_id, day, label, {hashed_indices(m)} AS indices "
            f"FROM {src})")


def sample_hash(key: str, salt: str) -> str:
    return f"md5('{salt}:' || CAST({key} AS VARCHAR))"


_LN = "ln"


def bayes_sweep_ctes(sizes: list[int], hash_spaces: list[int], names: list[str]) -> list[str]:
    """CTEs ending in ``met(m, size, roc_auc, log_loss)``: naive Bayes in SQL form per
    (hash space, ladder size), the ladder cut after the first size covering the train rows."""
    hr = " UNION ALL ".join(
        f"SELECT CAST({m} AS BIGINT) AS m, event_id, day, label, {hashed_indices(m)} AS indices FROM imp"
        for m in hash_spaces)
    ladder = ", ".join(f"({n}, '{nm}')" for n, nm in zip(sizes, names))
    a1 = "(n1 + 2.0)"
    a0 = "(n0 + 2.0)"
    return [
        f"hrows AS ({hr})",
        "maxday AS (SELECT max(day) AS d FROM imp)",
        "train AS (SELECT h.* FROM hrows h, maxday WHERE h.day < maxday.d)",
        "test AS (SELECT h.* FROM hrows h, maxday WHERE h.day = maxday.d)",
        "ntrain AS (SELECT count(*) AS n FROM imp, maxday WHERE day < maxday.d)",
        f"ladder AS (SELECT * FROM (VALUES {ladder}) t(size, name))",
        "sizes AS (SELECT size, name FROM ladder WHERE size <= (SELECT n FROM ntrain) OR size = "
        "(SELECT min(size) FROM ladder WHERE size >= (SELECT n FROM ntrain)))",
        "samp AS (SELECT s.size, t.* FROM sizes s JOIN train t ON TRUE QUALIFY row_number() OVER "
        "(PARTITION BY t.m, s.size ORDER BY md5(s.name || ':' || CAST(t.event_id AS VARCHAR)), t.event_id) "
        "<= s.size)",
        "n AS (SELECT m, size, CAST(sum(label) AS BIGINT) AS n1, CAST(count(*) - sum(label) AS BIGINT) AS n0 "
        "FROM samp GROUP BY m, size)",
        "cnt AS (SELECT m, size, idx, sum(label) AS c1, sum(1 - label) AS c0 FROM "
        "(SELECT m, size, label, unnest(indices) AS idx FROM samp) GROUP BY m, size, idx)",
        f"w AS (SELECT cnt.m, cnt.size, idx, "
        f"CAST(round(((ln(c1 + 1.0) - ln{a1}) - (ln({a1} - c1 - 1.0) - ln{a1}) "
        f"- (ln(c0 + 1.0) - ln{a0}) + (ln({a0} - c0 - 1.0) - ln{a0})) * 1e9) AS BIGINT) AS w, "
        f"CAST(round(((ln({a1} - c1 - 1.0) - ln{a1}) - (ln({a0} - c0 - 1.0) - ln{a0})) * 1e9) AS BIGINT) "
        "AS absent FROM cnt JOIN n ON cnt.m = n.m AND cnt.size = n.size)",
        "wst AS (SELECT m, size, count(*) AS k, CAST(sum(absent) AS BIGINT) AS s FROM w GROUP BY m, size)",
        f"model AS (SELECT n.m, n.size, "
        f"CAST(round(((ln(1.0) - ln{a1}) - (ln(n1 + 1.0) - ln{a1}) - (ln(1.0) - ln{a0}) "
        f"+ (ln(n0 + 1.0) - ln{a0})) * 1e9) AS BIGINT) AS default_w, "
        f"CAST(round((ln(n1 + 1.0) - ln(n0 + 1.0)) * 1e9) AS BIGINT) + wst.s + "
        f"CAST(round((n.m - wst.k) * ((ln(n1 + 1.0) - ln{a1}) - (ln(n0 + 1.0) - ln{a0})) * 1e9) AS BIGINT) "
        "AS intercept FROM n JOIN wst ON n.m = wst.m AND n.size = wst.size)",
        "tx AS (SELECT m, event_id, unnest(indices) AS idx FROM test)",
        "scored AS (SELECT mo.m, mo.size, t.event_id, t.label, CAST(mo.intercept + "
        "COALESCE(sum(CASE WHEN x.idx IS NULL THEN 0 ELSE COALESCE(w.w, mo.default_w) END), 0) AS BIGINT) "
        "AS score FROM model mo JOIN test t ON t.m = mo.m LEFT JOIN tx x ON x.m = t.m AND x.event_id = t.event_id "
        "LEFT JOIN w ON w.m = mo.m AND w.size = mo.size AND w.idx = x.idx "
        "GROUP BY mo.m, mo.size, t.event_id, t.label, mo.intercept)",
        "pred AS (SELECT m, size, label, 1.0 / (1.0 + exp(-(CAST(score AS DOUBLE) / 1e9))) AS p FROM scored)",
        "hist AS (SELECT m, size, p AS score, CAST(sum(label) AS BIGINT) AS pos, "
        "CAST(sum(1 - label) AS BIGINT) AS neg FROM pred GROUP BY m, size, p)",
        "met AS (SELECT m, size, "
        "CAST(sum(2 * CAST(pos AS HUGEINT) * neg_below + CAST(pos AS HUGEINT) * neg) AS DOUBLE) / "
        "CAST(2 * CAST(sum(pos) AS HUGEINT) * sum(neg) AS DOUBLE) AS roc_auc, "
        "round(sum(pos * -ln(least(greatest(score, 1e-15), 1 - 1e-15)) + "
        "neg * -ln(1.0 - least(greatest(score, 1e-15), 1 - 1e-15))) / (sum(pos) + sum(neg)), 9) AS log_loss "
        "FROM (SELECT *, sum(neg) OVER (PARTITION BY m, size ORDER BY score ROWS BETWEEN UNBOUNDED "
        "PRECEDING AND CURRENT ROW) - neg AS neg_below FROM hist) GROUP BY m, size)",
    ]


def boosted_tree_ctes(p, features: list[int], src: str = "imp") -> list[str]:
    """CTEs of the first boosted tree over the as-is features.

    ``bin(event_id, f, bin)``, ``split(node, f, bin, ml, gain)`` and
    ``node(node, depth, g, h, n, weight)``; ``t<d>`` moves the test rows down
    the tree.  ``features``: positions of those that the tree may use.
    """
    values = ", ".join(f"CAST({c} AS BIGINT)" for c in NUMERIC_COLS + [hex_to_uint(c) for c in CATEGORICAL_COLS])
    last = f"(SELECT max(day) FROM {src})"
    soft = lambda g: f"(CASE WHEN {g} > {p.alpha} THEN {g} - {p.alpha} WHEN {g} < -{p.alpha} THEN {g} + {p.alpha} ELSE 0.0::DOUBLE END)"
    unit = lambda x: f"(CAST({x} AS DOUBLE) / 1e9::DOUBLE)"
    worth = lambda g, h: f"({soft(unit(g))} * {soft(unit(g))} / ({unit(h)} + {p.reg_lambda}::DOUBLE))"
    least = int(p.min_child_weight * 10**9)
    left = "((x.bin < 0 AND b.ml = 1) OR (x.bin >= 0 AND x.bin <= b.bin))"
    out = [
        f"long AS MATERIALIZED (SELECT event_id, day, unnest(range(0, 39)) AS f, unnest([{values}]) AS v FROM {src})",
        f"ranked AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS rn, count(*) OVER (PARTITION BY f) AS n "
        f"FROM long WHERE v IS NOT NULL AND day < {last})",
        f"cuts AS (SELECT f, list(DISTINCT v) AS cl FROM ranked JOIN (SELECT unnest(range(1, {p.bins})) AS k) "
        f"ON rn = CAST(ceil(k * n / {p.bins}.0) AS BIGINT) GROUP BY f)",
        "bin AS MATERIALIZED (SELECT l.event_id, l.f, CASE WHEN v IS NULL THEN -1 WHEN cl IS NULL THEN 0 "
        "ELSE len(list_filter(cl, lambda c: c <= v)) END AS bin FROM long l LEFT JOIN cuts ON l.f = cuts.f)",
        f"a0 AS (SELECT event_id, CAST(0 AS BIGINT) AS node, CASE WHEN label = 1 THEN -500000000 ELSE 500000000 END AS g, 250000000 AS h "
        f"FROM {src} WHERE day < {last} AND CAST(('0x' || substr({sample_hash('event_id', 'tree0')}, 1, 13)) AS UBIGINT) "
        f"< {int(p.subsample * 2**52)})",
        f"t0 AS (SELECT event_id, label, CAST(0 AS BIGINT) AS node FROM {src} WHERE day = {last})",
    ]
    for d in range(p.max_depth):
        sums = ", ".join(f"CAST(sum({c}) OVER one AS BIGINT) AS a{c}, CAST(sum({c}) OVER upto AS BIGINT) AS u{c}, "
                         f"CAST(sum(CASE WHEN bin < 0 THEN {c} ELSE 0 END) OVER one AS BIGINT) AS m{c}" for c in "ghn")
        lefts = ", ".join(f"u{c} - CASE WHEN ml = 1 THEN 0 ELSE m{c} END AS l{c}" for c in "ghn")
        out += [
            f"h{d} AS (SELECT node, f, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM a{d} JOIN bin USING (event_id) "
            f"WHERE f IN ({', '.join(map(str, features))}) GROUP BY node, f, bin)",
            f"c{d} AS (SELECT node, f, bin, {sums} FROM h{d} WINDOW one AS (PARTITION BY node, f), upto AS (PARTITION BY node, f "
            "ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
            f"s{d} AS (SELECT node, f, bin, ml, ag, ah, an, {lefts} FROM c{d}, (VALUES (1), (0)) AS t(ml))",
            f"v{d} AS (SELECT *, {worth('lg', 'lh')} + {worth('(ag - lg)', '(ah - lh)')} - {worth('ag', 'ah')} AS gain FROM s{d})",
            f"b{d} AS MATERIALIZED (SELECT * FROM v{d} WHERE bin >= 0 AND lh >= {least} AND ah - lh >= {least} AND gain >= {p.gamma}::DOUBLE "
            "AND gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin, ml DESC) = 1)",
            f"a{d + 1} AS MATERIALIZED (SELECT a.event_id, 2 * a.node + CASE WHEN {left} THEN 1 ELSE 2 END AS node, a.g, a.h "
            f"FROM a{d} a JOIN b{d} b ON a.node = b.node JOIN bin x ON x.event_id = a.event_id AND x.f = b.f)",
            f"t{d + 1} AS MATERIALIZED (SELECT a.event_id, a.label, CASE WHEN b.node IS NULL THEN a.node WHEN {left} THEN 2 * a.node + 1 "
            f"ELSE 2 * a.node + 2 END AS node FROM t{d} a LEFT JOIN b{d} b ON a.node = b.node "
            "LEFT JOIN bin x ON x.event_id = a.event_id AND x.f = b.f)",
        ]
    sides = " UNION ALL ".join(
        f"SELECT 2 * node + 1, {d + 1}, lg, lh, ln FROM b{d} UNION ALL SELECT 2 * node + 2, {d + 1}, ag - lg, ah - lh, an - ln FROM b{d}"
        for d in range(p.max_depth))
    out += [
        "split AS (" + " UNION ALL ".join(f"SELECT node, f, bin, ml, gain FROM b{d}" for d in range(p.max_depth)) + ")",
        f"stats AS (SELECT DISTINCT node, 0 AS depth, ag AS g, ah AS h, an AS n FROM c0 UNION ALL {sides})",
        f"node AS (SELECT *, CAST(round((-{soft(unit('g'))} / ({unit('h')} + {p.reg_lambda}::DOUBLE) * {p.eta}::DOUBLE) * 1e9::DOUBLE) AS BIGINT) "
        "AS weight FROM stats)",
    ]
    return out


def fast_index(feature: int, value: str, m: int) -> str:
    """Fast mode of P10: ((v mod P) * a + (v div P) * b + c) * a, modulo P and then m."""
    from impressa.functions.hashing import FAST_PRIME as p
    from impressa.functions.hashing import fast_factors

    a, b, c = fast_factors(feature)
    mod = lambda x: f"((({x}) % {p} + {p}) % {p})"
    mixed = f"(({mod(value)} * {a} + {mod(f'CAST(floor({value} / {p}.0) AS BIGINT)')} * {b} % {p} + {c}) % {p})"
    return f"CAST({mixed} * {a} % {p} % {int(m)} AS INTEGER)"
