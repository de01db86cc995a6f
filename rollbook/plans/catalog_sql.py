"""DuckDB SQL with the same result as the queries of the same name.

Written independently of the Spark code: sequences are built by joining every user with
every position, overlaps are counted by comparing substrings, curves use plain windows.
"""

from __future__ import annotations

from itertools import combinations

from rollbook.plans.catalog_data import DEEP_FEATURES, DEEP_TREE

# One character per date of the academic year, June to May, 31 positions a month.
_POSITIONS = """
positions AS (
  SELECT p::INTEGER AS pos, ((p // 31 + 5) % 12 + 1)::INTEGER AS month, (p % 31 + 1)::INTEGER AS day FROM range(372) AS r(p)
)"""

_EVENT_DAYS = (
    _POSITIONS
    + """,
marks AS (
  SELECT user_id, month(ts) AS month, day(ts) AS day,
         CASE WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 'p' ELSE 'a' END AS status
  FROM events GROUP BY ALL
),
dense AS (
  SELECT u.user_id AS id, p.pos, p.month, p.day, coalesce(m.status, 'm') AS status
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN positions p
  LEFT JOIN marks m ON m.user_id = u.user_id AND m.month = p.month AND m.day = p.day
)"""
)

_ORDER_DAYS = (
    _POSITIONS
    + """,
year_orders AS (
  SELECT *, (year(o_orderdate) - CASE WHEN month(o_orderdate) < 6 THEN 1 ELSE 0 END)::INTEGER AS year FROM orders
),
marks AS (
  SELECT {'o_custkey': o_custkey, 'year': year} AS id, month(o_orderdate) AS month, day(o_orderdate) AS day,
         CASE WHEN count(*) FILTER (o_orderstatus <> 'F') > 0 THEN 'p' ELSE 'a' END AS status
  FROM year_orders GROUP BY ALL
),
dense AS (
  SELECT u.id, p.pos, p.month, p.day, coalesce(m.status, 'm') AS status
  FROM (SELECT DISTINCT id FROM marks) u CROSS JOIN positions p
  LEFT JOIN marks m ON m.id = u.id AND m.month = p.month AND m.day = p.day
)"""
)

_REAL_DATE = """
  (day <= 29 OR month NOT IN (2)) AND (day <= 30 OR month NOT IN (4, 6, 9, 11))"""

_SHARES = (
    """
shares AS (
  SELECT pos, month, day, avg(CASE WHEN status = 'm' THEN 1.0::DOUBLE ELSE 0.0 END) AS missing_share
  FROM dense WHERE """
    + _REAL_DATE
    + """ GROUP BY ALL
)"""
)

_SUNDAYS = "(SELECT month(ts), day(ts) FROM events WHERE dayofweek(ts) = 0)"


def _sequence(group: str, where: str, same: str = "TRUE") -> str:
    return f"""
{group} AS (
  SELECT d.id, string_agg(d.status, '' ORDER BY d.pos) AS s, count(*) AS len
  FROM dense d JOIN valid v ON v.pos = d.pos AND {same} WHERE {where} GROUP BY d.id
)"""


_SAME_YEAR = "v.year = d.id.year"
_ALL_IDS = "(SELECT DISTINCT id FROM marks) m"


def _overlaps(text: str, pattern: str) -> str:
    k = len(pattern)
    return (
        f"len(list_filter(range(1, length({text}) - {k} + 2), lambda i: substr({text}, i::INTEGER, {k}) = '{pattern}'))"
    )


def _most(length: str, pattern: str) -> str:
    """Occurrences in the string that repeats the pattern's shortest period: no string of that length holds more."""
    unit = next(pattern[:p] for p in range(1, len(pattern) + 1) if (pattern[:p] * len(pattern)).startswith(pattern))
    return _overlaps(f"substr(repeat('{unit}', (({length}) // {len(unit)} + 1)::INTEGER), 1, ({length})::INTEGER)", pattern)


def _fractions(group: str, parts: int, patterns: list[str]) -> str:
    columns = []
    for i in range(1, parts + 1):
        size = f"({group}.len // {parts}" + (f" + {group}.len % {parts})" if i == parts else ")")
        part = f"substr({group}.s, ({group}.len // {parts} * {i - 1} + 1)::INTEGER, {size}::INTEGER)"
        for pattern in patterns:
            columns.append(
                f"{_overlaps(part, pattern)}::DOUBLE / {_most(size, pattern)}::DOUBLE"
                f" AS {group}_partns_{parts}_partn_{i}_frac_{pattern}"
            )
    return ",\n  ".join(columns)


def _lasts(group: str) -> str:
    return ",\n  ".join(
        f"CASE WHEN contains({group}.s, '{c}') THEN {group}.len - instr(reverse({group}.s), '{c}') + 1 ELSE 0 END"
        f" / ({group}.len + 1e-10::DOUBLE) AS {group}_last_{c}"
        for c in "amp"
    )


def _binary(group: str, thresholds: list[int]) -> str:
    return ",\n  ".join(
        f"CASE WHEN contains(right({group}.s, {t}), 'p') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS binary_absence_{t}"
        for t in thresholds
    )


_VALID_EVENTS = (
    _EVENT_DAYS
    + ","
    + _SHARES
    + f""",
valid AS (SELECT * FROM shares WHERE missing_share < 1 AND (month, day) NOT IN {_SUNDAYS})"""
)
# Each academic year by itself: its own shares and its own Sundays and 25ths.
_YEAR_SHARES = _SHARES.replace("SELECT pos", "SELECT id.year AS year, pos")
_OFF = "(SELECT year, month(o_orderdate), day(o_orderdate) FROM year_orders WHERE dayofweek(o_orderdate) = 0 OR day(o_orderdate) = 25)"
_VALID_ORDERS = (
    _ORDER_DAYS + "," + _YEAR_SHARES + f", valid AS (SELECT * FROM shares WHERE missing_share < 1 AND (year, month, day) NOT IN {_OFF})"
)

_ALL_MONTHS = "TRUE"
_BINARY_MONTHS = "d.month IN (12, 1, 2, 3, 4)"
_PATTERNS = sorted({a + b + c for a in "ap" for b in ("", *"ap") for c in ("", *"ap")} | {a + b for a in "mp" for b in ("", *"mp")})


def _scored(digits: int | None = None) -> str:
    score = "o_totalprice / 500000" if digits is None else f"round(o_totalprice / 500000, {digits})"
    return f"""
scored AS (
  SELECT o_orderkey AS id, {score} AS score, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders
),
groups AS (SELECT score, count(*) AS n, sum(label)::BIGINT AS pos FROM scored GROUP BY score),
ranked AS (
  SELECT score, n, pos, row_number() OVER w AS place, (sum(n) OVER w)::BIGINT AS cum_n, (sum(pos) OVER w)::BIGINT AS cum_pos,
         (sum(n) OVER ())::BIGINT AS total_n, (sum(pos) OVER ())::BIGINT AS total_pos
  FROM groups WINDOW w AS (ORDER BY score DESC)
),
curve AS (
  SELECT score AS threshold, cum_pos::DOUBLE / cum_n AS precision, cum_pos::DOUBLE / total_pos AS recall,
         (cum_n - cum_pos)::DOUBLE / (total_n - total_pos) AS fpr, place, n, pos
  FROM ranked
)"""


def _recall_at_k(points: int, cap: bool) -> str:
    p = f"least((SELECT count(*) FROM scored), {points})" if cap else str(points)
    k = "(i::DOUBLE / (p - 1))" if cap else "(CASE WHEN i = p - 1 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / (p - 1)) END)"
    return f"""
cuts AS (
  SELECT i::BIGINT AS point, {k} AS k, floor((SELECT count(*) FROM scored) * {k})::BIGINT AS cut
  FROM (SELECT {p} AS p), LATERAL range(p) AS r(i)
),
ordered AS (
  SELECT row_number() OVER w AS rank, (sum(label) OVER w)::BIGINT AS hits FROM scored WINDOW w AS (ORDER BY score DESC, id)
),
at_k AS (
  SELECT point, k, cut, coalesce(hits, 0)::DOUBLE / (SELECT sum(label) FROM scored) AS recall,
         coalesce(hits, 0)::DOUBLE / (SELECT sum(label) FROM scored) - k AS lift
  FROM cuts LEFT JOIN ordered ON rank = cut
)"""


def _max_f1(eps: str) -> str:
    return (
        f"SELECT threshold FROM curve ORDER BY 2.0::DOUBLE * precision * recall / (precision + recall + {eps}::DOUBLE) DESC,"
        " threshold LIMIT 1"
    )


_MAX_LIFT = """SELECT threshold FROM curve
  ORDER BY abs(recall - (SELECT recall FROM at_k ORDER BY lift DESC, point LIMIT 1)), threshold LIMIT 1"""

# Even spacing by a common step; the last edge exact.
_GRID = """
grid AS (SELECT i::INTEGER AS i, CASE WHEN i = 99 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 99) END AS threshold FROM range(100) AS r(i)),
swept AS (
  SELECT threshold, sum(CASE WHEN score >= threshold THEN pos ELSE 0 END) AS tp,
         sum(CASE WHEN score >= threshold THEN n - pos ELSE 0 END) AS fp,
         sum(CASE WHEN score < threshold THEN pos ELSE 0 END) AS fn,
         sum(CASE WHEN score < threshold THEN n - pos ELSE 0 END) AS tn
  FROM grid CROSS JOIN groups GROUP BY threshold
)"""

_BINS = """
edges AS (SELECT list(i * (1.0::DOUBLE / 20) ORDER BY i) AS e FROM range(1, 20) AS r(i)),
bins AS (
  SELECT len(list_filter(e, lambda x: x < score))::INTEGER AS bin, sum(n)::BIGINT AS n,
         sum(score * n) / sum(n) AS mean_score, sum(pos)::DOUBLE / sum(n) AS positive_rate
  FROM groups CROSS JOIN edges GROUP BY 1
)"""


def _histogram(source: str, value: str, by: str = "", digits: int | None = None) -> str:
    """50 even bins; an edge belongs to the upper bin, the largest value to the last one."""
    low, high = "e[b + 1]", "e[b + 2]"
    if digits is not None:
        low, high = f"round({low}, {digits})", f"round({high}, {digits})"
    group = f"{by}, " if by else ""
    return f"""
ends AS (SELECT min({value}) AS lo, max({value}) AS hi FROM {source}),
cuts50 AS (
  SELECT list(CASE WHEN i = 50 THEN hi ELSE i * ((hi - lo) / 50) + lo END ORDER BY i) AS e FROM ends, range(51) AS r(i)
),
placed AS (
  SELECT {group}e, least(len(list_filter(e, lambda x: x <= {value})) - 1, 49)::INTEGER AS b FROM {source} CROSS JOIN cuts50
)
SELECT {group}b AS bin, {low} AS low, {high} AS high, count(*) AS n FROM placed GROUP BY {group}b, e"""


_LABELS = """
enrolled AS (
  SELECT DISTINCT o_custkey, year(o_orderdate) - CASE WHEN month(o_orderdate) < 6 THEN 1 ELSE 0 END AS year FROM orders
),
dropouts AS (
  SELECT a.o_custkey, a.year::INTEGER AS year, CASE WHEN b.o_custkey IS NULL THEN 1 ELSE 0 END::INTEGER AS target
  FROM enrolled a LEFT JOIN enrolled b ON b.o_custkey = a.o_custkey AND b.year = a.year + 1
  WHERE a.year < (SELECT max(year) FROM enrolled)
)"""

_UNIFIED = (
    _ORDER_DAYS
    + ","
    + _LABELS
    + """,
strings AS (SELECT id, string_agg(status, '' ORDER BY pos) AS days FROM dense GROUP BY id),
best AS (
  SELECT o_custkey, year, max(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent_score,
         max(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS low_score
  FROM year_orders GROUP BY ALL
),
unified AS (
  SELECT d.o_custkey, d.year, d.target, n_name AS nation, nullif(c_mktsegment, 'MACHINERY') AS segment,
         CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, s.days, urgent_score, low_score
  FROM dropouts d JOIN customer ON c_custkey = d.o_custkey JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN strings s ON s.id.o_custkey = d.o_custkey AND s.id.year = d.year
  LEFT JOIN best b ON b.o_custkey = d.o_custkey AND b.year = d.year
)"""
)

# Attribution values of lineitem as in the catalog.
_VALUES = """
vals AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS preds_proba_1, l_discount - 0.05::DOUBLE AS d, l_tax - 0.04::DOUBLE AS t,
         (l_quantity - 25) / 100 AS q, l_extendedprice / 100000 - 0.5::DOUBLE AS p
  FROM lineitem
),
contribs AS (
  SELECT *,
    0.0::DOUBLE + CASE WHEN d > 0 THEN d ELSE 0 END + CASE WHEN t > 0 THEN t ELSE 0 END AS terms_1,
    0.0::DOUBLE + CASE WHEN d <= 0 THEN -d ELSE 0 END + CASE WHEN t <= 0 THEN -t ELSE 0 END AS terms_0,
    CASE WHEN q > 0 THEN q ELSE 0 END AS size_1, CASE WHEN q <= 0 THEN -q ELSE 0 END AS size_0,
    CASE WHEN p > 0 THEN p ELSE 0 END AS money_1, CASE WHEN p <= 0 THEN -p ELSE 0 END AS money_0,
    CASE WHEN d > 0 AND (t <= 0 OR d >= t) THEN 'discount' WHEN t > 0 THEN 'tax' END AS terms_1_top,
    CASE WHEN d <= 0 AND (t > 0 OR -d >= -t) THEN 'discount' WHEN t <= 0 THEN 'tax' END AS terms_0_top,
    CASE WHEN q > 0 THEN 'quantity' END AS size_1_top, CASE WHEN q <= 0 THEN 'quantity' END AS size_0_top,
    CASE WHEN p > 0 THEN 'price' END AS money_1_top, CASE WHEN p <= 0 THEN 'price' END AS money_0_top
  FROM vals
),
listed AS (
  SELECT *, list_sort([
      {'c': -terms_1, 'o': 0, 'g': 'terms', 't': terms_1_top}, {'c': -size_1, 'o': 1, 'g': 'size', 't': size_1_top},
      {'c': -money_1, 'o': 2, 'g': 'money', 't': money_1_top}]) AS r1,
    list_sort([
      {'c': -terms_0, 'o': 0, 'g': 'terms', 't': terms_0_top}, {'c': -size_0, 'o': 1, 'g': 'size', 't': size_0_top},
      {'c': -money_0, 'o': 2, 'g': 'money', 't': money_0_top}]) AS r0
  FROM contribs
)"""

_ROW = "l_orderkey, l_linenumber, l_partkey"


def _places(pattern: str) -> str:
    return ", ".join(pattern.format(i=i) for i in (1, 2, 3))


def _md5_order(key: str, seed: int) -> str:
    return f"('0x' || substr(md5({key} || ':{seed}'), 1, 15))::BIGINT"


def _first(month: int) -> str:
    return f"substr(days, {(month + 6) % 12 * 31 + 1}, 1)"


def _smoothed(column: str) -> str:
    mean = f"(sum(target) OVER (PARTITION BY {column}) + 2.0::DOUBLE * avg(target) OVER ()) / (count(*) OVER (PARTITION BY {column}) + 2.0::DOUBLE)"
    return f"round({mean}, 9) AS number_{column}"


def _before(column: str) -> str:
    frame = f"OVER (PARTITION BY {column} ORDER BY place, studentid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"round((coalesce(sum(target) {frame}, 0) + 0.5::DOUBLE) / (count(*) {frame} + 1.0::DOUBLE), 9) AS number_{column}"


_SPLIT_SIZES = """,
counts AS (SELECT label, count(*) AS n, floor(0.7::DOUBLE * (SELECT count(*) FROM scored)) * count(*) / (SELECT count(*) FROM scored) AS exact FROM scored GROUP BY label),
sizes AS (
  SELECT label, n, floor(exact)::BIGINT + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, label)
         <= floor(0.7::DOUBLE * (SELECT count(*) FROM scored)) - (SELECT sum(floor(exact)) FROM counts) THEN 1 ELSE 0 END AS size FROM counts
)
"""

# Features of two values: a tree of one split gives each of them a number.
_STUMP = """ given AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
         CASE WHEN o_totalprice > 250000 AND o_orderstatus <> 'O' THEN 1 ELSE 0 END AS large,
         CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END AS closed, o_orderkey % 10 >= 7 AS held FROM orders),
leaves AS (SELECT large, 1 / (1 + exp(-2 * avg(2 * label - 1))) AS p FROM given WHERE NOT held GROUP BY large)"""


def _stump_losses(steps: int, rate: float) -> str:
    """Weighted rows by value, part and sign; each step moves a value's margin by the mean of 4s / (1 + exp(2sf))."""
    boosted = "".join(
        f""",
f{i} AS (
  SELECT closed, any_value(f) + {rate}::DOUBLE * sum(w * 4 * s / (1 + exp(2 * s * f))) / sum(w) AS f
  FROM cells JOIN f{i - 1} USING (closed) WHERE NOT held GROUP BY closed)"""
        for i in range(1, steps)
    )
    loss = "sum(w * 2 * ln(1 + exp(-2 * s * f))) FILTER ({part}) / sum(w) FILTER ({part})"
    rows = " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS iteration, round({loss.format(part='NOT held')}, 9) AS trn, round({loss.format(part='held')}, 9) AS val"
        f" FROM cells JOIN f{i} USING (closed)"
        for i in range(steps)
    )
    return f"""WITH{_STUMP},
counts AS (SELECT label, count(*) AS n FROM given WHERE NOT held GROUP BY label),
weights AS (SELECT label, (SELECT max(n) FROM counts) / n::DOUBLE AS w FROM counts),
cells AS (SELECT closed, held, 2 * label - 1 AS s, sum(w) AS w FROM given JOIN weights USING (label) GROUP BY ALL),
f0 AS (SELECT closed, sum(w * s) / sum(w) AS f FROM cells WHERE NOT held GROUP BY closed){boosted}
{rows}"""


def _tree_value(known: tuple[str, ...], i: int = 0) -> str:
    """What the fixed deep tree says if only the `known` features are: other tests are averaged by cover."""
    nodes = {n["id"]: n for n in DEEP_TREE}
    node, names = nodes[i], list(DEEP_FEATURES)
    if node["left"] < 0:
        return f"{node['prediction']}::DOUBLE"
    low, high = _tree_value(known, node["left"]), _tree_value(known, node["right"])
    if (name := names[node["feature"]]) in known:
        return f"CASE WHEN {DEEP_FEATURES[name]} <= {node['threshold']}::DOUBLE THEN {low} ELSE {high} END"
    share = nodes[node["left"]]["cover"] / node["cover"]
    return f"({share!r}::DOUBLE * {low} + {1 - share!r}::DOUBLE * {high})"


def _shapley(weight: float) -> str:
    """Mean over all orders of three features of the difference that each makes."""
    names = list(DEEP_FEATURES)
    subsets = [s for k in range(4) for s in combinations(names, k)]
    values = ", ".join(f"{_tree_value(s)} AS {'_'.join(('v', *s))}" for s in subsets)
    terms = {
        name: " + ".join(
            f"(v_{'_'.join(sorted((*s, name), key=names.index))} - {'_'.join(('v', *s))}) / {6 if len(s) == 1 else 3}"
            for s in subsets if name not in s
        )
        for name in names
    }
    numbers = ", ".join(f"round({weight}::DOUBLE * ({t}), 9) + 0.0::DOUBLE AS {name}" for name, t in terms.items())
    return f"WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, {values} FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, {numbers} FROM v"


SQL: dict[str, str] = {
    "year_and_grade": """
WITH y AS (SELECT o_orderkey, year(o_orderdate) - CASE WHEN month(o_orderdate) < 6 THEN 1 ELSE 0 END AS y FROM orders),
n AS (SELECT o_orderkey, substr(y::VARCHAR, 3, 2) || substr((y + 1)::VARCHAR, 3, 2) AS acad_year, (o_orderkey % 12 + 1)::VARCHAR AS grade FROM y)
SELECT o_orderkey, '/data/ay' || acad_year || '_grade' || grade || '.parquet' AS path, acad_year, grade FROM n""",
    "holidays": """
WITH y AS (SELECT o_orderdate AS d, year(o_orderdate) - CASE WHEN month(o_orderdate) < 6 THEN 1 ELSE 0 END AS y FROM orders)
SELECT DISTINCT substr(y::VARCHAR, 3, 2) || substr((y + 1)::VARCHAR, 3, 2) AS acad_year, month(d)::INTEGER AS month, day(d)::INTEGER AS day
FROM y WHERE dayofweek(d) = 0 OR day(d) = 25""",
    "metrics_long": "WITH" + _scored() + """
SELECT 'orders' AS split, unnest(['tn', 'fp', 'fn', 'tp']) AS metric, unnest([
  count(*) FILTER (label = 0 AND score < 0.5)::DOUBLE, count(*) FILTER (label = 0 AND score >= 0.5)::DOUBLE,
  count(*) FILTER (label = 1 AND score < 0.5)::DOUBLE, count(*) FILTER (label = 1 AND score >= 0.5)::DOUBLE]) AS value
FROM scored""",
    "metrics_round_trip": "WITH" + _scored() + """
SELECT 'orders' AS split, unnest(['tn', 'fp', 'fn', 'tp']) AS metric, unnest([
  count(*) FILTER (label = 0 AND score < 0.5)::DOUBLE, count(*) FILTER (label = 0 AND score >= 0.5)::DOUBLE,
  count(*) FILTER (label = 1 AND score < 0.5)::DOUBLE, count(*) FILTER (label = 1 AND score >= 0.5)::DOUBLE]) AS value
FROM scored""",
    "recode": """
SELECT event_type, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'p' WHEN event_type = 'error' THEN 'a' ELSE event_type END AS status,
       count(*) AS n FROM events GROUP BY ALL""",
    "lower_names": "SELECT * FROM events",
    "dedup_first": "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
    "cast_to_contract": """
SELECT c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment, c_acctbal::DOUBLE AS c_acctbal, c_custkey::BIGINT AS c_custkey FROM customer""",
    "exam_rectify": """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 35 OR l_quantity < 5 THEN 0.0::DOUBLE ELSE l_quantity END AS maths_score,
       CASE WHEN l_quantity > 35 THEN 'm' WHEN l_quantity < 5 THEN 'a' ELSE 'p' END AS maths_attnd FROM lineitem""",
    "fill_status_and_text": """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'm' ELSE event_type END AS status, CASE WHEN value > 50 THEN props ELSE 'nan' END AS props
FROM events""",
    "fill_mean": """
WITH v AS (SELECT *, CASE WHEN l_tax BETWEEN 0.02 AND 0.05 THEN l_tax END AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(t, (SELECT avg(t) FROM v)), 9) AS tax, round(l_discount, 9) AS discount FROM v""",
    "column_filters": """
SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_nationkey NOT IN (1, 2, 3)""",
    "drop_columns": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
    "quality_report": """
WITH c AS (
  SELECT count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS label, count(*) FILTER (o_orderpriority = '5-LOW') AS nulls,
         count(*) FILTER (o_orderpriority NOT IN ('5-LOW', '1-URGENT', '2-HIGH')) AS unknown,
         count(*) FILTER (o_totalprice <= 100000) AS cheap FROM orders
),
d AS (SELECT count(*) AS dup FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1))
SELECT unnest(['studentid', 'target', 'target', 'target', '6_1', '6_1', 'price', 'price', 'studentid']) AS "column",
       unnest(['null', 'null', 'bad_cast', 'bad_label', 'null', 'unknown_status', 'null', 'bad_cast', 'duplicate_ids']) AS "check",
       unnest([0, 0, 0, label, nulls, unknown, 0, cheap, dup])::BIGINT AS n FROM c, d""",
    "preprocess": "WITH" + _UNIFIED + """,
filled AS (
  SELECT o_custkey || '-' || year AS studentid, nation, coalesce(segment, 'nan') AS segment,
         CASE WHEN urgent_score IS NULL THEN 'm' WHEN urgent_score > 0 THEN 'p' ELSE 'a' END AS urgent_attnd,
         CASE WHEN low_score IS NULL THEN 'm' WHEN low_score > 0 THEN 'p' ELSE 'a' END AS low_attnd,
         round(coalesce(balance, (SELECT avg(balance) FROM unified)), 6) AS balance,
         coalesce(urgent_score, 0) AS urgent_score, coalesce(low_score, 0) AS low_score, target::BIGINT AS target,
         """ + ", ".join(f"substr(days, {(m + 6) % 12 * 31 + 1}, 1) AS \"{m}_1\"" for m in range(1, 13)) + """
  FROM unified
)
SELECT * FROM filled WHERE nation <> 'NATION_3' AND segment IN ('nan', 'BUILDING', 'HOUSEHOLD')""",
    "dropout_label": "WITH" + _LABELS + " SELECT * FROM dropouts",
    "unified_row": "WITH" + _UNIFIED + " SELECT * FROM unified",
    "prevalence_sample": "WITH" + _scored() + """,
counts AS (SELECT count(*) FILTER (label = 0) AS neg, count(*) FILTER (label = 1) AS pos FROM scored),
sizes AS (
  SELECT CASE WHEN 0.2 < pos / (neg + pos) THEN neg ELSE ceil(pos * (1 - 0.2::DOUBLE) / 0.2::DOUBLE) END AS keep_0,
         CASE WHEN 0.2 < pos / (neg + pos) THEN ceil(neg * 0.2::DOUBLE / (1 - 0.2::DOUBLE)) ELSE pos END AS keep_1 FROM counts
)
SELECT id, score, label FROM scored, sizes
QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= CASE WHEN label = 0 THEN keep_0 ELSE keep_1 END""",
    "prevalence_sample_up": "WITH" + _scored() + """,
counts AS (SELECT count(*) FILTER (label = 1) AS pos FROM scored)
SELECT id, score, label FROM scored, counts QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= pos""",
    "prevalence_sample_seeded": "WITH" + _scored() + f""",
counts AS (SELECT count(*) FILTER (label = 0) AS neg FROM scored)
SELECT id, score, label FROM scored, counts
QUALIFY label = 0 OR row_number() OVER (PARTITION BY label ORDER BY {_md5_order("id", 5)}, id) <= ceil(neg * 0.25::DOUBLE / 0.75::DOUBLE)""",
    "prevalence_sample_text_key": "WITH" + _scored() + """,
counts AS (SELECT count(*) FILTER (label = 0) AS neg FROM scored)
SELECT 'order-' || id AS id, score, label FROM scored, counts
QUALIFY label = 0 OR row_number() OVER (PARTITION BY label ORDER BY 'order-' || id) <= ceil(neg * 0.2::DOUBLE / (1 - 0.2::DOUBLE))""",
    "stratified_split": "WITH" + _scored() + _SPLIT_SIZES + f"""
SELECT id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_md5_order("id", 42)}, id) <= size THEN 'train' ELSE 'val' END AS split
FROM scored JOIN sizes USING (label)""",
    "split_sizes": "WITH" + _scored() + _SPLIT_SIZES + """
SELECT 'train' AS split, label, size AS n, size AS ids FROM sizes UNION ALL SELECT 'val', label, n - size, n - size FROM sizes""",
    "seq_build": "WITH" + _EVENT_DAYS + "SELECT id AS user_id, string_agg(status, '' ORDER BY pos) AS days FROM dense GROUP BY id",
    "missing_shares": "WITH" + _ORDER_DAYS + "," + _SHARES + " SELECT * FROM shares",
    "valid_days": "WITH" + _EVENT_DAYS + "," + _SHARES
    + f" SELECT month, day, pos, missing_share FROM shares WHERE missing_share < 0.08 AND (month, day) NOT IN {_SUNDAYS}",
    "attendance_features": "WITH" + _VALID_EVENTS + "," + _sequence("full", _ALL_MONTHS).replace("\nfull", '\n"full"') + ","
    + _sequence("bin", _BINARY_MONTHS) + "\nSELECT f.id AS user_id,\n  "
    + ",\n  ".join(
        x.replace("full.", "f.")
        for x in (_fractions("full", 3, ["a", "m", "p"]), _lasts("full"), _binary("bin", [10, 15, 20, 30, 40, 50, 60]))
    )
    + '\nFROM "full" f JOIN bin USING (id)',
    "seq_pattern_overlap": "WITH" + _VALID_EVENTS + "," + _sequence("jan", "d.month = 1") + "\nSELECT id AS user_id,\n  "
    + ",\n  ".join((_fractions("jan", 1, _PATTERNS), _fractions("jan", 2, _PATTERNS), _lasts("jan"))) + "\nFROM jan",
    "month_groups": "WITH" + _VALID_ORDERS + "," + _sequence("f", "d.month IN (6, 7, 8)", _SAME_YEAR) + ","
    + _sequence("x", "d.month IN (12, 1, 5)", _SAME_YEAR) + "\nSELECT m.id.o_custkey AS o_custkey, m.id.year AS year,\n  "
    + ",\n  ".join(
        y.replace(f"AS {g}_", f"AS {name}_")
        for g, name in (("f", "first"), ("x", "mixed")) for y in (_fractions(g, 2, ["a", "p"]), _lasts(g))
    )
    + f"\nFROM {_ALL_IDS} LEFT JOIN f ON f.id = m.id LEFT JOIN x ON x.id = m.id",
    "seq_last": "WITH" + _VALID_ORDERS + "," + _sequence("f", _ALL_MONTHS, _SAME_YEAR)
    + "\nSELECT m.id.o_custkey AS o_custkey, m.id.year AS year,\n  " + _lasts("f").replace("AS f_", "AS full_")
    + f"\nFROM {_ALL_IDS} LEFT JOIN f ON f.id = m.id",
    "seq_binary_absence": "WITH" + _VALID_ORDERS + "," + _sequence("bin", _BINARY_MONTHS, _SAME_YEAR)
    + "\nSELECT m.id.o_custkey AS o_custkey, m.id.year AS year,\n  "
    + _binary("bin", [10, 30, 60, 400]).replace("CASE WHEN", "CASE WHEN bin.s IS NULL THEN NULL WHEN")
    + f"\nFROM {_ALL_IDS} LEFT JOIN bin ON bin.id = m.id",
    "missing_shares_by_year": "WITH" + _ORDER_DAYS + "," + _YEAR_SHARES + " SELECT * FROM shares",
    "valid_days_by_year": "WITH" + _ORDER_DAYS + "," + _YEAR_SHARES
    + f" SELECT * FROM shares WHERE missing_share < 0.995 AND (year, month, day) NOT IN {_OFF}",
    "wide_to_long": """
SELECT user_id, 1::INTEGER AS month, d::INTEGER AS day, max(CASE WHEN event_type <> 'error' AND day(ts) = d THEN 'p' END) AS status
FROM events CROSS JOIN range(1, 32) AS r(d) GROUP BY ALL""",
    "seq_from_wide": "WITH" + _EVENT_DAYS + """
SELECT id AS user_id, string_agg(CASE WHEN month = 1 AND status = 'p' THEN 'p' ELSE 'm' END, '' ORDER BY pos) AS days FROM dense GROUP BY id""",
    "quality_while_cleaning": """
WITH given AS (
  SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS target, nullif(o_orderpriority, '5-LOW') AS day,
         CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price FROM orders),
copies AS (SELECT o_custkey FROM given GROUP BY 1 HAVING count(*) > 1)
SELECT 'studentid' AS column, 'null' AS check, count(*) FILTER (o_custkey IS NULL) AS n FROM given
UNION ALL SELECT 'studentid', 'duplicate_ids', count(*) FROM copies
UNION ALL SELECT 'target', 'null', count(*) FILTER (target IS NULL) FROM given
UNION ALL SELECT 'target', 'bad_cast', count(*) FILTER (target IS NOT NULL AND try_cast(target AS BIGINT) IS NULL) FROM given
UNION ALL SELECT 'target', 'bad_label', count(*) FILTER (target NOT IN (0, 1)) FROM given
UNION ALL SELECT '6_1', 'null', count(*) FILTER (day IS NULL) FROM given
UNION ALL SELECT '6_1', 'unknown_status', count(*) FILTER (day NOT IN ('1-URGENT', '2-HIGH')) FROM given
UNION ALL SELECT 'price', 'null', count(*) FILTER (price IS NULL) FROM given
UNION ALL SELECT 'price', 'bad_cast', count(*) FILTER (price IS NOT NULL AND try_cast(price AS DOUBLE) IS NULL) FROM given""",
    # Two leaves, at most two bins with knots; bins out of order are pooled with equal weight.
    "stump_score": "WITH" + _STUMP + """,
bins AS (
  SELECT ceil(p * 20) AS bin, avg(p) AS mean_score, avg(label) AS rate FROM given JOIN leaves USING (large) WHERE held GROUP BY 1),
pool AS (SELECT *, max_by(rate, mean_score) OVER () < min_by(rate, mean_score) OVER () AS mixed, avg(rate) OVER () AS pooled FROM bins),
calibrated AS (SELECT large, CASE WHEN mixed THEN pooled ELSE rate END AS p1 FROM leaves JOIN pool ON ceil(leaves.p * 20) = bin),
held AS (SELECT p1, count(*) AS n, sum(label) AS pos FROM given JOIN calibrated USING (large) WHERE held GROUP BY p1),
points AS (
  SELECT p1, sum(pos) OVER w / sum(n) OVER w AS precision, sum(pos) OVER w / sum(pos) OVER () AS recall FROM held WINDOW w AS (ORDER BY p1 DESC)),
best AS (SELECT p1 AS threshold FROM points ORDER BY 2 * precision * recall / (precision + recall + 1e-8) DESC, p1 LIMIT 1)
SELECT id, label::INTEGER AS label, round(1 - p1, 9) AS preds_proba_0, round(p1, 9) AS preds_proba_1, (p1 >= threshold)::INTEGER AS preds
FROM given JOIN calibrated USING (large), best""",
    "stump_losses": _stump_losses(3, 0.3),
    "stump_search": "WITH" + _STUMP + """,
held AS (SELECT p, count(*) AS n, sum(label) AS pos FROM given JOIN leaves USING (large) WHERE held GROUP BY p),
points AS (
  SELECT p, sum(pos) OVER w / sum(n) OVER w AS precision, sum(pos) OVER w / sum(pos) OVER () AS recall FROM held WINDOW w AS (ORDER BY p DESC)),
steps AS (SELECT recall - lag(recall, 1, 0) OVER w AS dx, precision + lag(precision, 1, 1) OVER w AS y FROM points WINDOW w AS (ORDER BY p DESC))
SELECT trial::INTEGER AS trial, '1' AS "maxIter", '1' AS "maxDepth", 'variance' AS impurity, '0.3' AS "stepSize", NULL::VARCHAR AS "subsamplingRate",
       (SELECT round(sum(dx * y / 2), 9) FROM steps) AS score FROM range(2) AS t(trial)""",
    "tree_shap_deep": _shapley(0.7),
    "score_table": "WITH" + _scored(3) + " SELECT *, lead(n) OVER w AS next_n, lead(pos) OVER w AS next_pos FROM ranked WINDOW w AS (ORDER BY place)",
    "pr_curve": "WITH" + _scored() + " SELECT threshold, precision, recall FROM curve UNION ALL SELECT NULL, 1.0, 0.0",
    "roc_curve": "WITH" + _scored() + """
SELECT threshold, fpr, recall AS tpr FROM curve
WINDOW w AS (ORDER BY place)
QUALIFY lead(n) OVER w IS NULL OR lag(n) OVER w IS NULL OR lead(n - pos) OVER w <> n - pos OR lead(pos) OVER w <> pos
UNION ALL SELECT NULL, 0.0, 0.0""",
    "roc_curve_full": "WITH" + _scored(2) + " SELECT threshold, fpr, recall AS tpr FROM curve UNION ALL SELECT NULL, 0.0, 0.0",
    "auc_roc": "WITH" + _scored(2) + """,
steps AS (SELECT fpr - lag(fpr, 1, 0) OVER w AS dx, recall + lag(recall, 1, 0) OVER w AS y FROM curve WINDOW w AS (ORDER BY place))
SELECT round(sum(dx * y / 2), 9) AS roc_auc FROM steps""",
    "auc_pr": "WITH" + _scored(2) + """,
steps AS (SELECT recall - lag(recall, 1, 0) OVER w AS dx, precision + lag(precision, 1, 1) OVER w AS y FROM curve WINDOW w AS (ORDER BY place))
SELECT round(sum(dx * y / 2), 9) AS pr_auc FROM steps""",
    "avg_precision": "WITH" + _scored(2) + """,
steps AS (SELECT recall - lag(recall, 1, 0) OVER w AS dx, precision FROM curve WINDOW w AS (ORDER BY place))
SELECT round(sum(dx * precision), 9) AS avg_precision FROM steps""",
    "recall_at_k": "WITH" + _scored() + "," + _recall_at_k(1000, True) + " SELECT * FROM at_k",
    "recall_at_k_ties": "WITH" + _scored(1) + "," + _recall_at_k(400, True) + " SELECT * FROM at_k",
    "recall_at_k_model": "WITH" + _scored(2) + "," + _recall_at_k(1000, False) + " SELECT * FROM at_k",
    "confusion": "WITH" + _scored() + """
SELECT count(*) FILTER (label = 0 AND score < 0.4) AS tn, count(*) FILTER (label = 0 AND score >= 0.4) AS fp,
       count(*) FILTER (label = 1 AND score < 0.4) AS fn, count(*) FILTER (label = 1 AND score >= 0.4) AS tp FROM scored""",
    "metrics_at": "WITH" + _scored() + """
SELECT name, threshold, coalesce(sum(label) FILTER (score >= threshold)::DOUBLE / nullif(count(*) FILTER (score >= threshold), 0), 0) AS precision,
       coalesce(sum(label) FILTER (score >= threshold), 0)::DOUBLE / sum(label) AS recall
FROM scored, (VALUES ('low', 0.1::DOUBLE), ('high', 0.9::DOUBLE), ('beyond', 2.0::DOUBLE)) AS t(name, threshold) GROUP BY ALL""",
    "calibration_bins": "WITH" + _scored(2) + "," + _BINS
    + " SELECT bin, n, round(mean_score, 9) AS mean_score, round(positive_rate, 9) AS positive_rate FROM bins",
    "hist": "WITH" + _histogram("lineitem", "l_extendedprice"),
    "hist_by_label": "WITH" + _scored(2) + "," + _histogram("scored", "score", "label"),
    "error_hist": "WITH" + _scored() + ", errors AS (SELECT label, CASE WHEN label = 1 THEN score - 1 ELSE 1.0::DOUBLE - score END AS error FROM scored),"
    + _histogram("errors", "error", "label", 9),
    "error_hist_signed": "WITH" + _scored() + ", errors AS (SELECT label, score - label AS error FROM scored),"
    + _histogram("errors", "error", "label", 9),
    "ppv_npv": "WITH" + _scored() + "," + _GRID
    + " SELECT threshold, tp::DOUBLE / nullif(tp + fp, 0) AS ppv, tn::DOUBLE / nullif(tn + fn, 0) AS npv FROM swept",
    "flag_rate": "WITH" + _scored(2) + "," + _GRID + " SELECT threshold, (tp + fp)::DOUBLE / (tp + fp + fn + tn) AS rate FROM swept",
    "best_thresholds": "WITH" + _scored(2) + "," + _recall_at_k(1000, False)
    + f" SELECT ({_max_f1('1e-8')}) AS max_f1, ({_MAX_LIFT}) AS max_lift",
    "split_thresholds": "WITH" + _scored() + "," + _recall_at_k(1000, True) + f""",
named AS (
  SELECT 'max_f1' AS name, ({_max_f1('1e-10')}) AS threshold UNION ALL SELECT 'max_lift', ({_MAX_LIFT}) UNION ALL SELECT 'max_f1 (val)', 0.3
)
SELECT name, threshold, sum(label) FILTER (score >= threshold)::DOUBLE / count(*) FILTER (score >= threshold) AS precision,
       sum(label) FILTER (score >= threshold)::DOUBLE / sum(label) AS recall FROM scored, named GROUP BY ALL""",
    "threshold_for_recall": "WITH" + _scored()
    + " SELECT threshold, recall FROM curve ORDER BY abs(recall - 0.4::DOUBLE), threshold LIMIT 1",
    "summary": "WITH" + _scored() + f""",
best AS ({_max_f1('1e-10')}),
steps AS (
  SELECT (fpr - lag(fpr, 1, 0) OVER w) * (recall + lag(recall, 1, 0) OVER w) / 2 AS a, (recall - lag(recall, 1, 0) OVER w) * precision AS p
  FROM curve WINDOW w AS (ORDER BY place)
)
SELECT (SELECT sum(label)::DOUBLE / count(*) FROM scored) AS prevalence, threshold, precision, recall,
       (SELECT round(sum(a), 9) FROM steps) AS auc, (SELECT round(sum(p), 9) FROM steps) AS ap
FROM curve JOIN best USING (threshold)""",
    "isotonic": "WITH" + _scored() + "," + _BINS + """,
knots AS (
  SELECT row_number() OVER (ORDER BY bin) AS i, mean_score AS x, positive_rate AS y FROM bins
),
spans AS (SELECT a.i AS lo, b.i AS hi, avg(c.y) AS m FROM knots a JOIN knots b ON a.i <= b.i JOIN knots c ON c.i BETWEEN a.i AND b.i GROUP BY ALL),
fitted AS (
  SELECT k.i, k.x, max(m.least_mean) AS y FROM knots k
  JOIN (SELECT s.lo, k2.i AS k, min(s.m) AS least_mean FROM spans s JOIN knots k2 ON s.lo <= k2.i AND s.hi >= k2.i GROUP BY ALL) m ON m.k = k.i
  GROUP BY ALL
),
pieces AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY i) AS x1, lead(y) OVER (ORDER BY i) AS y1 FROM fitted),
bounds AS (SELECT min(x) AS xa, min_by(y, x) AS ya, max(x) AS xb, max_by(y, x) AS yb FROM fitted)
SELECT id, round(CASE WHEN score <= xa THEN ya WHEN score >= xb THEN yb ELSE
  (SELECT y0 + (y1 - y0) * (score - x0) / (x1 - x0) FROM pieces WHERE score >= x0 AND score < x1) END, 7) AS calibrated
FROM scored, bounds""",
    "group_contrib": "WITH" + _VALUES + f""" SELECT {_ROW},
  terms_0 AS terms_0_contrib, terms_0_top AS terms_0_top_driver, size_0 AS size_0_contrib, size_0_top AS size_0_top_driver,
  money_0 AS money_0_contrib, money_0_top AS money_0_top_driver, terms_1 AS terms_1_contrib, terms_1_top AS terms_1_top_driver,
  size_1 AS size_1_contrib, size_1_top AS size_1_top_driver, money_1 AS money_1_contrib, money_1_top AS money_1_top_driver FROM contribs""",
    "group_rank": "WITH" + _VALUES + f" SELECT {_ROW}, "
    + _places("r1[{i}].g AS predictor_group_{i}_for_dropout, r1[{i}].t AS predictor_group_{i}_for_dropout_top_driver") + ", "
    + _places("r0[{i}].g AS predictor_group_{i}_for_notdropout, r0[{i}].t AS predictor_group_{i}_for_notdropout_top_driver")
    + " FROM listed",
    "explained_groups": "WITH" + _VALUES
    + f", chosen AS (SELECT *, CASE WHEN preds_proba_1 >= 0.05::DOUBLE THEN r1 ELSE r0 END AS r FROM listed) SELECT {_ROW}, preds_proba_1,"
    + " CASE WHEN preds_proba_1 >= 0.05::DOUBLE THEN 'dropout' ELSE 'notdropout' END AS preds, "
    + _places("r[{i}].g AS predictor_group_{i}, r[{i}].t AS predictor_group_{i}_top_driver") + " FROM chosen",
    # v(S) of a tree with the features outside S averaged by cover; two features, so phi is the mean of two differences.
    "tree_shap_fixed": """
WITH v AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity <= 25 AS q, l_discount <= 0.05::DOUBLE AS d, l_discount <= 0.03::DOUBLE AS e FROM lineitem
),
w AS (
  SELECT *, 0.4 * -1.0 + 0.6 * (0.25 * 2.0 + 0.75 * 1.0) AS none,
    CASE WHEN q THEN -1.0 ELSE 0.25 * 2.0 + 0.75 * 1.0 END AS only_q,
    0.4 * -1.0 + 0.6 * CASE WHEN d THEN 2.0 ELSE 1.0 END AS only_d,
    CASE WHEN q THEN -1.0 WHEN d THEN 2.0 ELSE 1.0 END AS both_known,
    0.5 * (CASE WHEN e THEN 4.0 ELSE -2.0 END - (0.4 * 4.0 + 0.6 * -2.0)) AS second FROM v
)
SELECT l_orderkey, l_linenumber, l_partkey, round((((only_q - none) + (both_known - only_d)) / 2)::DOUBLE, 9) AS quantity,
       round((((only_d - none) + (both_known - only_q)) / 2 + second)::DOUBLE, 9) AS discount FROM w""",
    "category_means": "WITH" + _UNIFIED + f"""
SELECT o_custkey || '-' || year AS studentid, {_smoothed("nation")}, {_smoothed("segment")} FROM unified""",
    "category_means_ordered": "WITH" + _UNIFIED + f""",
ordered AS (SELECT *, {_md5_order("studentid", 3)} AS place FROM (SELECT *, o_custkey || '-' || year AS studentid FROM unified))
SELECT studentid, {_before("nation")}, {_before("segment")} FROM ordered""",
    "class_weights": "WITH" + _UNIFIED + """,
counts AS (SELECT target, count(*) AS n FROM unified GROUP BY target)
SELECT o_custkey || '-' || year AS studentid, round((SELECT max(n) FROM counts) / n::DOUBLE, 9) AS balanced,
       round(sqrt((SELECT max(n) FROM counts) / n::DOUBLE), 9) AS root FROM unified JOIN counts USING (target)""",
    "read_years": "WITH" + _UNIFIED + f"""
SELECT o_custkey || '-' || year AS studentid, target::BIGINT AS target, CASE WHEN year = 1996 THEN {_first(6)} END AS "6_1", {_first(9)} AS "9_1",
       CASE WHEN year = 1997 THEN {_first(1)} END AS "1_1", CASE year WHEN 1996 THEN '9697' ELSE '9798' END AS acad_year,
       CASE year WHEN 1996 THEN '1' ELSE '12' END AS grade FROM unified WHERE year IN (1996, 1997)""",
    "frames_round_trip": "WITH" + _scored() + _SPLIT_SIZES + f"""
SELECT CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_md5_order("id", 42)}, id) <= size THEN 'train' ELSE 'val' END AS split, id, score, label
FROM scored JOIN sizes USING (label)""",
    "scores_round_trip": "WITH" + _scored() + " SELECT * FROM scored",
    "feature_kinds": "WITH" + _UNIFIED + """
SELECT unnest(['nation', 'segment', 'days', 'balance', 'urgent_score', 'low_score']) AS feature,
       unnest(['categorical', 'categorical', 'categorical', 'numerical', 'numerical', 'numerical']) AS kind,
       unnest([count(nation), count(segment), count(days), count(balance), count(urgent_score), count(low_score)]) AS n FROM unified""",
    "fill_training_means": "WITH" + _UNIFIED + """
SELECT o_custkey || '-' || year AS studentid, round(coalesce(balance, (SELECT avg(balance) FROM unified WHERE year < 1998)), 6) AS balance,
       coalesce(urgent_score, 0) AS urgent_score, CASE WHEN urgent_score IS NULL THEN 'm' WHEN urgent_score > 0 THEN 'p' ELSE 'a' END AS urgent_attnd
FROM unified WHERE year >= 1998""",
    "dedup_first_ties": """
SELECT o_custkey, day, priced FROM (
  SELECT o_custkey, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate::DATE::VARCHAR END AS day, o_totalprice > 0 AS priced FROM orders
) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day NULLS FIRST) = 1""",
    "model_checks": "WITH" + _UNIFIED + """
SELECT o_custkey || '-' || year AS studentid, target, TRUE AS sums_to_one, TRUE AS a_probability, TRUE AS follows_threshold, TRUE AS same_when_loaded
FROM unified""",
    "attribution_checks": "WITH" + _UNIFIED + " SELECT o_custkey || '-' || year AS studentid, TRUE AS adds_up FROM unified",
}
