"""DuckDB statements that recompute each report from the same tables.

They are written for clarity, with window functions, subqueries and self joins, and
share no code with the operators beyond the literal dates.
"""

from __future__ import annotations


def cyc(day: str) -> str:
    """Billing cycle of a date: its month, or the next one from the 25th on."""
    return f"CAST(date_trunc('month', {day}) + (CASE WHEN day({day}) >= 25 THEN 1 ELSE 0 END) * INTERVAL 1 MONTH AS DATE)"


def mon(day: str) -> str:
    return f"CAST(date_trunc('month', {day}) AS DATE)"


def share(n: str, d: str) -> str:
    return f"(CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0))"


def pct(n: str, d: str) -> str:
    return f"(100.0::DOUBLE * {share(n, d)})"


def pct0(n: str, d: str) -> str:
    return f"(CASE WHEN {d} = 0 THEN 0.0::DOUBLE ELSE {pct(n, d)} END)"


# Canonical relations -------------------------------------------------------------

PAY = f"""pay AS (
  SELECT *, {cyc('day')} AS cyc, {mon('day')} AS mon FROM (
    SELECT l_orderkey AS lease, l_partkey AS part, l_suppkey AS supp, o_custkey AS payer,
           CASE l_returnflag WHEN 'A' THEN 'charge' WHEN 'R' THEN 'payment' ELSE 'cash payment' END AS method,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
           CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS fee,
           CAST(l_shipdate AS DATE) AS day, o_orderpriority <> '5-LOW' AS rent
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_extendedprice > 0))"""

DAILY = """daily AS (
  SELECT o_orderkey AS lease, o_custkey AS account, i,
         CAST(CAST(o_orderdate AS DATE) + to_months(CAST(i AS INTEGER)) AS DATE) AS day,
         CASE WHEN o_orderkey % 7 = 0 AND i = 0 THEN 'FUTURE' ELSE 'ACTIVE' END AS status,
         o_orderpriority <> '5-LOW' AS rent, o_orderstatus <> 'F' AS merchant,
         CASE WHEN o_custkey % 29 <> 0 THEN DATE '1994-06-01' + CAST(o_custkey * 13 % 2500 AS INTEGER) END AS invoice
  FROM orders, LATERAL (SELECT unnest(range(0, o_orderkey % 12 + 1)) AS i))"""

EVENTS = """ev AS (
  SELECT event_type, value, k, TIMESTAMP '1995-01-01' + (ts - TIMESTAMP '2024-01-01') * 80 AS moment,
         user_id * 10 + k % 10 AS recipient
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

MEMBERS = """members AS (
  SELECT DISTINCT lease, payer FROM (
    SELECT o_orderkey AS lease, unnest([o_custkey, o_custkey + 1 + o_orderkey % 3]) AS payer
    FROM orders WHERE o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0 AND o_orderkey % 41 <> 0)),
portal AS (
  SELECT c_custkey AS payer,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN joined END AS accepted,
         CASE WHEN c_custkey % 11 <> 0 THEN joined - to_days(CAST(c_custkey % 30 AS INTEGER)) END AS sent
  FROM (SELECT *, CAST(DATE '1995-01-01' + CAST(c_custkey * 37 % 2400 AS INTEGER) AS TIMESTAMP)
                  + to_hours(c_custkey % 24) AS joined FROM customer))"""

COHORT = f"""started AS (SELECT part AS account, MIN(cyc) AS first FROM pay GROUP BY part),
cohort AS (
  SELECT a.lease, a.account, a.day AS activated, {cyc('a.day')} AS cohort,
         CASE WHEN s.first IS NULL OR datediff('month', s.first, {cyc('a.day')}) <= 2 THEN 'Onboarding' ELSE 'Mature' END AS label
  FROM (SELECT *, row_number() OVER (PARTITION BY lease ORDER BY day) AS rn FROM daily
        WHERE status = 'ACTIVE' AND day BETWEEN '1995-02-01' AND '1997-12-24' AND rent AND merchant) a
  LEFT JOIN started s ON s.account = a.account
  WHERE a.rn = 1 AND {cyc('a.day')} BETWEEN '1995-02-01' AND '1997-12-01'
    AND a.lease IN (SELECT lease FROM daily GROUP BY lease HAVING MIN(day) >= '1995-02-01'))"""

RETAINED = """many AS (SELECT payer FROM members GROUP BY payer HAVING COUNT(*) >= 2),
retained AS (
  SELECT DISTINCT c.lease FROM cohort c JOIN members m ON m.lease = c.lease
  JOIN many USING (payer) JOIN portal p ON p.payer = m.payer WHERE p.accepted < c.activated)"""

STEPS = """steps AS (
  SELECT m.lease, MIN(accepted) AS accepted, MIN(sent) AS sent
  FROM members m JOIN portal p ON p.payer = m.payer GROUP BY m.lease)"""

SEEN = """seen AS (
  SELECT m.lease, MIN(moment) FILTER (WHERE event_type = 'view') AS invited, MIN(moment) FILTER (WHERE event_type = 'click') AS viewed
  FROM members m JOIN ev ON ev.recipient = m.payer WHERE moment >= '1995-01-15' GROUP BY m.lease)"""

FUNNEL = ",\n".join([PAY, DAILY, EVENTS, MEMBERS, COHORT, RETAINED, STEPS, SEEN])

JOURNEY = """journey AS (
  SELECT c.*, s.accepted, s.sent, e.invited, e.viewed
  FROM cohort c LEFT JOIN steps s ON s.lease = c.lease LEFT JOIN seen e ON e.lease = c.lease
  WHERE NOT EXISTS (SELECT 1 FROM retained r WHERE r.lease = c.lease))"""

OUTCOMES = """flagged AS (
  SELECT *, abs(datediff('day', activated, CAST(accepted AS DATE))) <= 180 AS portal_active,
         abs(datediff('day', activated, CAST(sent AS DATE))) <= 180 AS was_sent,
         abs(datediff('day', activated, CAST(invited AS DATE))) <= 180 AS was_invited,
         abs(datediff('day', activated, CAST(viewed AS DATE))) <= 180 AS was_viewed
  FROM journey),
firsts AS (
  SELECT f.lease, MIN(p.day) AS first_paid FROM flagged f JOIN pay p ON p.lease = f.lease
  WHERE f.portal_active AND p.day BETWEEN f.activated AND f.activated + 180 GROUP BY f.lease),
kept AS (
  SELECT f.lease, bool_or(p.day > first_paid AND p.day <= first_paid + 180) AS p1,
         bool_or(p.day > first_paid + 180 AND p.day <= first_paid + 360) AS p2,
         bool_or(p.day > first_paid + 30 AND p.day <= first_paid + 240) AS p3
  FROM firsts f JOIN pay p ON p.lease = f.lease GROUP BY f.lease),
outcomes AS (
  SELECT f.*, x.first_paid, k.p1, k.p2, k.p3 FROM flagged f
  LEFT JOIN firsts x ON x.lease = f.lease LEFT JOIN kept k ON k.lease = f.lease)"""

ORACLES: dict[str, str] = {}

ORACLES["c01_activation_kpi"] = f"""WITH {FUNNEL}, {JOURNEY}, {OUTCOMES}
SELECT cohort, label, COUNT(*) AS leases, COUNT(*) FILTER (WHERE portal_active) AS portal_active,
  COUNT(first_paid) AS converted, COUNT(first_paid) AS retention_base,
  COUNT(*) FILTER (WHERE p1) AS retained_p1, COUNT(*) FILTER (WHERE p2) AS retained_p2,
  {pct0('COUNT(*) FILTER (WHERE p1)', 'COUNT(first_paid)')} AS retention_p1_pct,
  {pct0('COUNT(*) FILTER (WHERE p2)', 'COUNT(first_paid)')} AS retention_p2_pct,
  {pct0('COUNT(*) FILTER (WHERE p1 AND p2)', 'COUNT(first_paid)')} AS habit_pct,
  COUNT(*) FILTER (WHERE was_sent) AS invites_sent
FROM outcomes GROUP BY cohort, label"""

_TIMED = OUTCOMES.replace("JOIN pay p", "JOIN timed p")
for _n in (180, 360, 30, 240):
    _TIMED = _TIMED.replace(f"first_paid + {_n}", f"first_paid + INTERVAL {_n} DAY")
ORACLES["f06_kpi_by_time"] = ORACLES["c01_activation_kpi"].replace(
    OUTCOMES,
    "timed AS (SELECT lease, CAST(day AS TIMESTAMP) + to_hours(CAST(round(amount * 100) AS BIGINT) % 24) AS day FROM pay), " + _TIMED,
)

ORACLES["c02_event_funnel"] = f"""WITH {FUNNEL}, {JOURNEY}, {OUTCOMES}
SELECT cohort, label, COUNT(*) AS leases, COUNT(*) FILTER (WHERE was_invited) AS invited,
  COUNT(*) FILTER (WHERE was_viewed) AS viewed, COUNT(*) FILTER (WHERE portal_active) AS registered,
  COUNT(first_paid) AS converted, COUNT(*) FILTER (WHERE p1) AS retained_p1, COUNT(*) FILTER (WHERE p2) AS retained_p2
FROM outcomes GROUP BY cohort, label"""

_WITHIN = ", ".join(f"COUNT(*) FILTER (WHERE d BETWEEN 0 AND {n}) AS within_{n}" for n in (7, 14, 30, 45, 90))
ORACLES["c03_days_to_event"] = f"""WITH {FUNNEL}, {JOURNEY},
d AS (SELECT j.lease, j.cohort, j.label, j.activated,
        (SELECT MIN(p.day) FROM pay p WHERE p.lease = j.lease AND p.day BETWEEN j.activated AND DATE '1997-12-24') - j.activated AS d
      FROM journey j)
SELECT cohort, label, COUNT(*) AS leases, MAX(activated) AS last_activated, {_WITHIN} FROM d GROUP BY cohort, label"""


def _transition(name: str, start: str, end: str, directed: bool) -> str:
    cells = []
    for n in (7, 14, 30, 45, 90):
        seen = f"{start} + {n} <= DATE '1998-03-31'"
        gap = f"datediff('day', {start}, {end})"
        hit = f"{gap} BETWEEN 0 AND {n}" if directed else f"abs({gap}) <= {n}"
        cells.append(f"COUNT(*) FILTER (WHERE {seen}) AS obs_{n}, COUNT(*) FILTER (WHERE {seen} AND {hit}) AS hit_{n}")
    return f"SELECT cohort, label, '{name}' AS metric, COUNT({start}) AS reach, {', '.join(cells)} FROM e GROUP BY cohort, label"


_UNION = "\nUNION ALL ".join(
    _transition(*row)
    for row in (
        ("activation_to_payment", "activated", "paid1", True),
        ("activation_to_invite", "activated", "inv", False),
        ("invite_to_registration", "inv", "reg", True),
        ("registration_to_payment", "reg", "paid1", True),
        ("payment_to_second", "paid1", "paid2", True),
    )
)
ORACLES["c04_censored_transitions"] = f"""WITH {FUNNEL}, {JOURNEY},
days AS (SELECT lease, day, row_number() OVER (PARTITION BY lease ORDER BY day) AS rn FROM (
  SELECT DISTINCT p.lease, p.day FROM pay p JOIN journey j ON j.lease = p.lease
  WHERE p.day >= j.activated AND p.day <= DATE '1998-03-31')),
e AS (SELECT j.cohort, j.label, j.activated,
        CASE WHEN CAST(invited AS DATE) <= DATE '1998-03-31' THEN CAST(invited AS DATE) END AS inv,
        CASE WHEN CAST(accepted AS DATE) <= DATE '1998-03-31' THEN CAST(accepted AS DATE) END AS reg,
        a.day AS paid1, b.day AS paid2
      FROM journey j LEFT JOIN days a ON a.lease = j.lease AND a.rn = 1 LEFT JOIN days b ON b.lease = j.lease AND b.rn = 2)
{_UNION}"""

ORACLES["c05_retained_members"] = f"""WITH {FUNNEL}
SELECT cohort, label, COUNT(*) AS leases, COUNT(r.lease) AS excluded, COUNT(*) - COUNT(r.lease) AS kept
FROM cohort c LEFT JOIN retained r ON r.lease = c.lease GROUP BY cohort, label"""


# Retention -----------------------------------------------------------------------


def _matrix(first_method: str | None, return_method: str | None) -> str:
    starts = f"AND method = '{first_method}'" if first_method else ""
    stays = f"AND p.method = '{return_method}'" if return_method else ""
    cells = ", ".join(f"MAX(n) FILTER (WHERE k = {k}) AS m{k}" for k in range(13))
    return f"""WITH {PAY}, base AS (SELECT * FROM pay WHERE rent),
ever AS (SELECT payer, MIN(mon) AS cohort FROM base GROUP BY payer HAVING MIN(day) >= '1995-01-01' AND MIN(day) < '1996-07-01'),
valid AS (SELECT e.payer, e.cohort FROM ever e WHERE EXISTS (
  SELECT 1 FROM base b WHERE b.payer = e.payer AND b.mon = e.cohort {starts})),
sizes AS (SELECT cohort, COUNT(*) AS cohort_size FROM valid GROUP BY cohort),
counts AS (
  SELECT v.cohort, datediff('month', v.cohort, p.day) AS k, COUNT(DISTINCT p.payer) AS n
  FROM base p JOIN valid v ON v.payer = p.payer
  WHERE p.day >= '1995-01-01' AND p.day < '1996-07-01' {stays} GROUP BY ALL)
SELECT s.cohort, cohort_size, {cells} FROM sizes s LEFT JOIN counts c ON c.cohort = s.cohort AND k BETWEEN 0 AND 12
GROUP BY s.cohort, cohort_size"""


ORACLES["c06_retention_any"] = _matrix(None, None)
ORACLES["c07_retention_ach"] = _matrix("payment", "payment")
ORACLES["c08_retention_card"] = _matrix("charge", "charge")
ORACLES["c09_retention_ach_any_return"] = _matrix("payment", None)
ORACLES["c10_retention_card_any_return"] = _matrix("charge", None)

ORACLES["c11_eligible_retention"] = f"""WITH {PAY}, {DAILY}, two AS (SELECT * FROM pay WHERE method IN ('charge', 'payment')),
cohort AS (SELECT payer, cyc AS cohort, method AS first_method, lease FROM (
    SELECT *, row_number() OVER (PARTITION BY payer ORDER BY day, method, lease) AS rn FROM two WHERE rent)
  WHERE rn = 1 AND cyc >= '1995-01-01' AND cyc < '1996-07-01'),
x AS (SELECT c.*, k, CAST(cohort + to_months(CAST(k AS INTEGER)) AS DATE) AS target FROM cohort c, range(13) t(k)
  WHERE cohort + to_months(CAST(k AS INTEGER)) < '1996-07-01'),
rows AS (
  SELECT x.*, EXISTS (SELECT 1 FROM daily d WHERE d.lease = x.lease AND d.status = 'ACTIVE'
           AND d.day >= x.target - 7 AND d.day < CAST(x.target + INTERVAL 1 MONTH AS DATE) + 24) AS ok,
    EXISTS (SELECT 1 FROM two p WHERE p.payer = x.payer AND p.cyc = x.target AND p.method = 'charge') AS card,
    EXISTS (SELECT 1 FROM two p WHERE p.payer = x.payer AND p.cyc = x.target AND p.method = 'payment') AS ach
  FROM x)
SELECT cohort, first_method, CAST(k AS INTEGER) AS "offset", COUNT(*) AS cohort_size, COUNT(*) FILTER (WHERE ok) AS eligible,
  COUNT(*) FILTER (WHERE ok AND card) AS paid_card, COUNT(*) FILTER (WHERE ok AND ach) AS paid_ach,
  COUNT(*) FILTER (WHERE ok AND (card OR ach)) AS paid_any
FROM rows GROUP BY cohort, first_method, k"""

_LEASE_CELLS = ", ".join(
    f"COUNT(DISTINCT CASE WHEN datediff('month', cohort, p.cyc) = {k} THEN c.lease END) AS m{k}" for k in range(8)
)
_LEASE_MATRIX = f"""SELECT cohort, label, COUNT(DISTINCT c.lease) AS cohort_size, {_LEASE_CELLS}
FROM cohort c LEFT JOIN pay p ON p.lease = c.lease AND p.cyc >= c.cohort GROUP BY cohort, label"""
ORACLES["c12_lease_retention"] = f"WITH {PAY}, {DAILY}, {COHORT} {_LEASE_MATRIX}"

# First-time payers ---------------------------------------------------------------

_BOUNDED = f"WITH {PAY}, base AS (SELECT * FROM pay WHERE day >= '1995-03-01')"
_REPORTED = "BETWEEN '1995-01-01' AND '1997-12-01'"


def _tenure(order: str, extra: str) -> str:
    return f"""{_BOUNDED},
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payer ORDER BY {order}) AS rn FROM base) WHERE rn = 1),
s AS (SELECT part, MIN(cyc) AS first FROM base GROUP BY part)
SELECT f.cyc AS period, CASE WHEN datediff('month', s.first, f.cyc) <= 2 THEN 'Onboarding' ELSE 'Mature' END AS label,
  COUNT(*) AS payers{extra} FROM f JOIN s ON s.part = f.part WHERE f.cyc {_REPORTED} GROUP BY ALL"""


ORACLES["c13_payers_by_account_tenure"] = _tenure("cyc, part", "")
_CARD_COUNT = "COUNT(*) FILTER (WHERE method = 'charge')"
ORACLES["c14_method_by_account_tenure"] = _tenure(
    "day, part, method", f", {_CARD_COUNT} AS card_payers, {pct(_CARD_COUNT, 'COUNT(*)')} AS card_pct"
)

ORACLES["c15_low_mix_batches"] = f"""{_BOUNDED},
fc AS (SELECT payer, MIN(cyc) AS cyc FROM base GROUP BY payer),
ft AS (SELECT b.payer, b.cyc, MAX(CASE WHEN method = 'charge' THEN 1 ELSE 0 END) AS used, MAX(supp) AS account
  FROM base b JOIN fc USING (payer, cyc) WHERE b.cyc BETWEEN '1995-02-01' AND '1997-12-01' GROUP BY b.payer, b.cyc),
g AS (SELECT cyc, account, COUNT(*) AS n, AVG(used) AS rate FROM ft GROUP BY cyc, account),
j AS (SELECT ft.cyc, ft.used, CASE WHEN g.rate < 0.34 AND g.n >= 4 THEN 1 ELSE 0 END AS batch
  FROM ft LEFT JOIN g ON g.cyc = ft.cyc AND g.account = ft.account)
SELECT cyc AS period, COUNT(*) AS payers, {pct('SUM(used)', 'COUNT(*)')} AS adoption_pct,
  {pct('COALESCE(SUM(used) FILTER (WHERE batch = 0), 0)', 'COUNT(*) FILTER (WHERE batch = 0)')} AS adoption_pct_without,
  CAST(SUM(batch) AS BIGINT) AS payers_in_batches
FROM j GROUP BY cyc"""

_SCOPED = f"""WITH {PAY}, {DAILY},
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payer ORDER BY day, lease, part) AS rn FROM pay WHERE rent) WHERE rn = 1),
la AS (SELECT lease, MIN(day) AS activated, MIN(invoice) AS invoice FROM daily WHERE status = 'ACTIVE' AND merchant AND rent GROUP BY lease)"""
_LAG = f"datediff('month', {cyc('la.activated')}, f.cyc)"
ORACLES["c16_activation_lag"] = f"""{_SCOPED}
SELECT period, CASE WHEN lag IS NULL THEN 'unknown' WHEN lag <= 0 THEN 'M0' WHEN lag = 1 THEN 'M_1' WHEN lag = 2 THEN 'M_2'
  WHEN lag = 3 THEN 'M_3' ELSE 'before' END AS bucket, COUNT(*) AS payers
FROM (SELECT f.cyc AS period, {_LAG} AS lag FROM f LEFT JOIN la ON la.lease = f.lease)
WHERE period {_REPORTED} GROUP BY ALL"""
ORACLES["c17_payers_by_lease_invoice_age"] = f"""{_SCOPED}
SELECT f.cyc AS period, CASE WHEN la.lease IS NULL THEN 'unknown'
  WHEN datediff('day', la.invoice, la.activated) < 90 THEN 'Onboarding' ELSE 'Mature' END AS label, COUNT(*) AS payers
FROM f LEFT JOIN la ON la.lease = f.lease WHERE f.cyc {_REPORTED} GROUP BY ALL"""
ORACLES["c18_payers_by_account_invoice_age"] = f"""{_SCOPED},
ld AS (SELECT lease, MAX(account) AS account FROM daily WHERE merchant GROUP BY lease),
ac AS (SELECT account, MIN(invoice) AS invoice FROM daily WHERE merchant GROUP BY account)
SELECT f.cyc AS period, CASE WHEN ac.invoice IS NULL THEN 'unknown'
  WHEN datediff('day', ac.invoice, f.day) < 90 THEN 'Onboarding' ELSE 'Mature' END AS label, COUNT(*) AS payers
FROM f LEFT JOIN ld ON ld.lease = f.lease LEFT JOIN ac ON ac.account = ld.account
WHERE f.cyc {_REPORTED} GROUP BY ALL"""

ORACLES["c19_adoption_trend"] = f"""{_BOUNDED},
ft AS (SELECT payer, cyc, bool_or(method = 'charge') AS used FROM base b
  WHERE cyc = (SELECT MIN(c.cyc) FROM base c WHERE c.payer = b.payer) GROUP BY payer, cyc)
SELECT cyc AS period, COUNT(*) AS payers, COUNT(*) FILTER (WHERE used) AS adopters,
  {pct('COUNT(*) FILTER (WHERE used)', 'COUNT(*)')} AS adoption_pct
FROM ft WHERE cyc {_REPORTED} GROUP BY cyc"""

ORACLES["c20_first_payment_size"] = f"""{_BOUNDED},
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payer ORDER BY day, amount) AS rn FROM base) WHERE rn = 1)
SELECT cyc AS period, COUNT(*) AS payers, {share('SUM(amount)', 'COUNT(*)')} AS mean_amount,
  CAST(MEDIAN(CAST(amount AS DOUBLE)) AS DOUBLE) AS median_amount
FROM f WHERE cyc {_REPORTED} GROUP BY cyc"""

ORACLES["f09_first_payment_size_by_month"] = f"""SELECT strftime(period, '%Y-%m') AS month, payers, round(mean_amount, 0) AS mean_amount,
  round(median_amount, 0) AS median_amount FROM ({ORACLES["c20_first_payment_size"]})"""

# Contribution and mix ------------------------------------------------------------


_DETAIL = " WHERE cyc BETWEEN '1995-01-01' AND '1995-04-01'"


def _first_cycle(within: str) -> str:
    return f"""{_BOUNDED},
ft AS (SELECT b.*, s_name AS name, CASE WHEN method = 'charge' THEN amount ELSE 0 END AS card
  FROM base b JOIN (SELECT payer, MIN(cyc) AS cyc FROM base GROUP BY payer) m USING (payer, cyc)
  LEFT JOIN supplier ON s_suppkey = b.supp{within})"""


def _without(pattern: str, name: str) -> str:
    outside = f"FILTER (WHERE NOT COALESCE(name, '') ILIKE '{pattern}')"
    return f"""{pct(f'COALESCE(SUM(used) {outside}, 0)', f'COUNT(*) {outside}')} AS adoption_without_{name},
  {pct(f'COALESCE(SUM(card) {outside}, 0)', f'COALESCE(SUM(amount) {outside}, 0)')} AS share_without_{name}"""


ORACLES["c21_leave_one_out"] = f"""{_first_cycle(_DETAIL)},
payers AS (SELECT cyc, payer, MAX(name) AS name, SUM(amount) AS amount, SUM(card) AS card,
  MAX(CASE WHEN method = 'charge' THEN 1 ELSE 0 END) AS used FROM ft GROUP BY cyc, payer)
SELECT cyc AS period, COUNT(*) AS payers, {pct('SUM(used)', 'COUNT(*)')} AS adoption_all, {pct('SUM(card)', 'SUM(amount)')} AS share_all,
  {_without('supplier#00000000%', 'a')}, {_without('Supplier#00000001%', 'b')}
FROM payers GROUP BY cyc"""
ORACLES["c22_heavy_hitters"] = f"""{_first_cycle(_DETAIL)}
SELECT cyc AS period, COALESCE(name, '(unmapped)') AS name, COUNT(DISTINCT payer) AS payers,
  CAST(SUM(amount) AS DOUBLE) AS volume, {pct('SUM(card)', 'SUM(amount)')} AS card_share
FROM ft GROUP BY cyc, COALESCE(name, '(unmapped)') HAVING COUNT(DISTINCT payer) >= 8"""
ORACLES["c23_account_timeline"] = f"""{_first_cycle('')}
SELECT cyc AS period, COUNT(DISTINCT payer) AS payers, CAST(SUM(amount) AS DOUBLE) AS volume,
  {pct('SUM(card)', 'SUM(amount)')} AS card_share
FROM ft WHERE name ILIKE 'supplier#00000002%' GROUP BY cyc"""


def _if(condition: str, value: str) -> str:
    return f"SUM(CASE WHEN {condition} THEN {value} ELSE 0 END)"


ORACLES["c24_mix_decomposition"] = f"""{_BOUNDED},
lab AS (SELECT cyc, amount, CASE WHEN method = 'charge' THEN amount ELSE 0 END AS card,
  cyc = MIN(cyc) OVER (PARTITION BY payer) AS new FROM base)
SELECT cyc AS period, {pct('SUM(card)', 'SUM(amount)')} AS overall_share,
  {pct(_if('new', 'card'), _if('new', 'amount'))} AS first_share,
  {pct(_if('NOT new', 'card'), _if('NOT new', 'amount'))} AS returning_share,
  {pct(_if('new', 'amount'), 'SUM(amount)')} AS first_pct_of_volume
FROM lab WHERE cyc BETWEEN '1995-04-01' AND '2000-12-01' GROUP BY cyc"""
ORACLES["c25_volume_and_fee"] = f"""WITH {PAY}
SELECT method, CAST(SUM(amount) AS DOUBLE) AS volume, CAST(SUM(fee) AS DOUBLE) AS fees,
  {pct('SUM(fee)', 'SUM(amount)')} AS fee_pct, COUNT(*) AS payments
FROM pay WHERE cyc = '1997-05-01' GROUP BY method"""
ORACLES["f17_volume_in_millions"] = f"""SELECT '1997-05' AS month, method, round(volume / 1e6, 1) AS volume, round(fees / 1e3, 1) AS fees,
  round(fee_pct, 3) AS fee_pct, payments FROM ({ORACLES["c25_volume_and_fee"]})"""
ORACLES["c26_churn_mix"] = f"""WITH {PAY},
cells AS (SELECT payer, datediff('month', DATE '1997-03-01', cyc) AS k, SUM(amount) AS amount, {_if("method = 'charge'", 'amount')} AS card
  FROM pay WHERE rent AND method IN ('charge', 'payment') AND cyc BETWEEN '1997-03-01' AND '1997-05-01' GROUP BY ALL),
wide AS (SELECT payer, list(k) AS ks, MAX(amount) FILTER (WHERE k = 0) AS a0, MAX(card) FILTER (WHERE k = 0) AS c0,
  MAX(amount) FILTER (WHERE k = 1) AS a1, MAX(card) FILTER (WHERE k = 1) AS c1 FROM cells GROUP BY payer)
SELECT CASE WHEN list_contains(ks, 2) THEN '3 retained 1997-04 to 1997-05' ELSE '1 churned in 1997-05, 1997-04 mix' END AS label,
  COUNT(*) AS payers, {pct('SUM(c1)', 'SUM(a1)')} AS card_share_pct FROM wide WHERE a1 IS NOT NULL GROUP BY 1
UNION ALL SELECT '2 churned in 1997-04, 1997-03 mix', COUNT(*), {pct('SUM(c0)', 'SUM(a0)')}
FROM wide WHERE a0 IS NOT NULL AND a1 IS NULL HAVING COUNT(*) > 0"""
ORACLES["c27_churn_series"] = f"""WITH {PAY},
p AS (SELECT lease, cyc, LEAD(cyc) OVER (PARTITION BY lease ORDER BY cyc) AS following
  FROM (SELECT DISTINCT lease, cyc FROM pay WHERE rent AND cyc BETWEEN '1996-02-01' AND '1997-12-01'))
SELECT churn_period, COUNT(*) AS churned FROM (SELECT CAST(cyc + INTERVAL 1 MONTH AS DATE) AS churn_period, following FROM p)
WHERE following IS DISTINCT FROM churn_period AND churn_period BETWEEN '1996-04-01' AND '1997-12-01' GROUP BY 1"""
ORACLES["c28_day_distribution"] = f"""WITH {PAY}
SELECT mon AS month, CASE WHEN day(day) <= 5 THEN 'a_01-05' WHEN day(day) <= 19 THEN 'b_06-19'
  WHEN day(day) <= 24 THEN 'c_20-24_precutoff' ELSE 'd_25-EOM_nextcycle' END AS day_bucket, COUNT(*) AS payments
FROM pay WHERE rent AND (day BETWEEN '1996-02-01' AND '1996-04-30' OR day BETWEEN '1997-02-01' AND '1997-04-30') GROUP BY ALL"""
ORACLES["c29_account_landings"] = f"""WITH {PAY}
SELECT period, COUNT(*) AS landed FROM (SELECT part, MIN(cyc) AS period FROM pay WHERE day >= '1995-02-01' GROUP BY part)
WHERE period {_REPORTED} GROUP BY period"""
ORACLES["c30_new_active_leases"] = f"""WITH {DAILY},
la AS (SELECT lease, MIN(day) AS activated, MIN(invoice) AS invoice FROM daily WHERE status = 'ACTIVE' AND merchant AND rent GROUP BY lease)
SELECT {cyc('activated')} AS period, CASE WHEN activated - invoice < 90 THEN 'Onboarding' ELSE 'Mature' END AS label, COUNT(*) AS leases
FROM la WHERE {cyc('activated')} BETWEEN '1996-04-01' AND '1996-09-01' GROUP BY ALL"""
_NSF = f"""nsf AS (SELECT {cyc('day')} AS cyc, tier FROM (
  SELECT CAST(moment AS DATE) AS day, CASE k % 3 WHEN 0 THEN 25 WHEN 1 THEN 40 ELSE 15 END AS tier FROM ev WHERE event_type = 'error')
  WHERE day BETWEEN '1995-01-25' AND '2001-06-24')"""
ORACLES["c31_return_rate"] = f"""WITH {PAY}, {EVENTS}, {_NSF},
a AS (SELECT cyc, COUNT(*) AS returned FROM nsf GROUP BY cyc),
b AS (SELECT cyc, COUNT(*) AS payments FROM pay WHERE method = 'payment' AND day BETWEEN '1995-01-25' AND '2001-06-24' GROUP BY cyc)
SELECT a.cyc AS period, returned, payments, {pct('returned', 'payments')} AS returned_pct FROM a JOIN b ON b.cyc = a.cyc"""
ORACLES["c32_returns_by_tier"] = f"""WITH {EVENTS}, {_NSF}
SELECT cyc AS period, COUNT(*) FILTER (WHERE tier = 25) AS txn_25, COUNT(*) FILTER (WHERE tier = 40) AS txn_40, COUNT(*) AS total
FROM nsf GROUP BY cyc"""

# Allocation ----------------------------------------------------------------------

_ENTRIES = """entries AS (
  SELECT o_orderkey AS id, o_custkey AS account, o_orderkey % 5 <> 0 AS is_payment, o_orderkey % 19 = 0 AS deleted,
         CASE WHEN o_orderkey % 23 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END AS due,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders),
lines AS (
  SELECT id, id + i AS linked, CAST((CAST(total * 100 AS BIGINT) // (i + 2)) / 100 AS DECIMAL(18,2)) AS amount
  FROM (SELECT *, unnest(range(0, id % 4 + 1)) AS i FROM entries WHERE is_payment AND NOT deleted AND due >= '{since}'))"""


def _offsets(rows: str, buckets: str) -> str:
    return ", ".join(
        f"{pct(_if(condition, 'part'), 'SUM(part)')} AS {name}"
        for name, condition in (pair.split(":") for pair in buckets.split(";"))
    )


_PAID_BUCKETS = "pct_prepay:o >= 1;pct_current:o = 0;pct_prior1:o = -1;pct_prior2:o = -2;pct_prior3plus:o <= -3"
# Whole cents: every part is rounded down, and as many rows as cents are missing get one more, those with the larger remainder first.
ORACLES["c33_charge_allocation"] = f"""WITH {PAY}, {_ENTRIES.format(since='1995-03-01')},
charges AS (
  SELECT l.id, date_trunc('month', TRY_CAST(c.due AS DATE)) AS due_month, SUM(CAST(CAST(l.amount AS DECIMAL(18,0)) AS HUGEINT)) AS amount
  FROM lines l JOIN entries c ON c.id = l.linked JOIN part ON p_partkey = c.account
  WHERE NOT c.deleted AND p_size <> 7 GROUP BY ALL),
totals AS (SELECT id, SUM(amount) AS total FROM charges GROUP BY id),
paid AS (SELECT lease, cyc, SUM(CAST(amount * 100 AS HUGEINT)) AS cents FROM pay
  WHERE method <> 'cash payment' AND cyc BETWEEN '1995-04-01' AND '2000-12-01' GROUP BY ALL),
cells AS (SELECT p.lease, p.cyc, p.cents, COALESCE(c.due_month, DATE '0001-01-01') AS m, datediff('month', p.cyc, c.due_month) AS o,
    p.cents * c.amount // total AS down, p.cents * c.amount % total AS rest
  FROM charges c JOIN totals t ON t.id = c.id AND total <> 0 JOIN paid p ON p.lease = c.id),
missing AS (SELECT lease, cyc, MAX(cents) - SUM(down) AS n FROM cells GROUP BY ALL),
rows AS (SELECT a.cyc, a.o, a.down + CASE WHEN n > (SELECT COUNT(*) FROM cells b WHERE b.lease = a.lease AND b.cyc = a.cyc
    AND (b.rest > a.rest OR b.rest = a.rest AND b.m < a.m)) THEN 1 ELSE 0 END AS part
  FROM cells a JOIN missing x ON x.lease = a.lease AND x.cyc = a.cyc)
SELECT cyc AS period, CAST(SUM(part) AS DOUBLE) / 100.0::DOUBLE AS allocated, {_offsets('rows', _PAID_BUCKETS)} FROM rows GROUP BY cyc"""


def _reactivated(cycle: str, buckets: str) -> str:
    return f"""WITH {PAY}, {_ENTRIES.format(since='1995-02-01')},
base AS (SELECT * FROM pay WHERE method <> 'cash payment' AND day >= '1995-02-20'),
life AS (SELECT payer, cyc, LAG(cyc) OVER (PARTITION BY payer ORDER BY cyc) AS prev FROM (SELECT DISTINCT payer, cyc FROM base)),
charges AS (SELECT l.id, l.amount, date_trunc('month', TRY_CAST(c.due AS DATE)) AS due_month
  FROM lines l JOIN entries c ON c.id = l.linked WHERE NOT c.deleted),
rows AS (SELECT r.cyc, datediff('month', p.cyc, c.due_month) AS o, c.amount AS part
  FROM life r JOIN base p ON p.payer = r.payer AND p.cyc = r.{cycle} JOIN charges c ON c.id = p.lease
  WHERE datediff('month', r.prev, r.cyc) = 2 AND r.cyc BETWEEN '1995-04-01' AND '2000-12-01')
SELECT cyc AS period, CAST(SUM(part) AS DOUBLE) AS charged, {_offsets('rows', buckets)} FROM rows GROUP BY cyc"""


ORACLES["c36_reactivated_charges"] = _reactivated(
    "cyc", "pct_prepay:o >= 1;pct_current:o = 0;pct_prior1:o = -1;pct_prior2plus:o <= -2"
)
ORACLES["c37_charges_before_gap"] = _reactivated(
    "prev", "pct_arrears:o <= -1;pct_previous:o = 0;pct_skipped:o = 1;pct_ahead2plus:o >= 2"
)

# Coverage and reactivation -------------------------------------------------------

ORACLES["c34_invite_coverage"] = f"""WITH {DAILY}, {EVENTS},
starts AS (SELECT account, MIN(invoice) AS invoice FROM daily WHERE merchant GROUP BY account),
act AS (SELECT DISTINCT {mon('day')} AS period, account FROM daily WHERE merchant AND status = 'ACTIVE' AND day BETWEEN '1995-09-01' AND '1997-05-31'),
inv AS (SELECT DISTINCT {mon('moment')} AS period, recipient AS account FROM ev
  WHERE event_type = 'view' AND k % 10 < 8 AND k <> 99 AND value >= 2 AND k < 90)
SELECT a.period, CASE WHEN datediff('day', s.invoice, last_day(a.period)) < 90 THEN 'Onboarding' ELSE 'Mature' END AS label,
  COUNT(DISTINCT a.account) AS active, COUNT(DISTINCT i.account) AS acting, {pct('COUNT(DISTINCT i.account)', 'COUNT(DISTINCT a.account)')} AS pct
FROM act a LEFT JOIN starts s ON s.account = a.account LEFT JOIN inv i ON i.period = a.period AND i.account = a.account GROUP BY ALL"""


def _lagged(since: str, first: str, last: str) -> str:
    return f"""WITH {PAY}, r AS (
  SELECT cyc, datediff('month', prev, cyc) AS gap FROM (
    SELECT cyc, LAG(cyc) OVER (PARTITION BY payer ORDER BY cyc) AS prev
    FROM (SELECT DISTINCT payer, cyc FROM pay WHERE rent AND day >= '{since}'))
  WHERE datediff('month', prev, cyc) > 1 AND cyc BETWEEN '{first}' AND '{last}')"""


ORACLES["c35_reactivation_gaps"] = f"""{_lagged('1996-01-25', '1996-06-01', '1998-05-01')}
SELECT cyc AS period, CASE gap WHEN 2 THEN '1_skip1' WHEN 3 THEN '2_skip2' ELSE '3_skip3plus' END AS gap_bucket, COUNT(*) AS reactivated
FROM r GROUP BY ALL"""
ORACLES["c38_reactivation_series"] = f"""{_lagged('1995-12-25', '1996-02-01', '1999-05-01')}
SELECT cyc AS period, COUNT(*) AS reactivated FROM r GROUP BY cyc"""
ORACLES["c39_totals_with_rollup"] = f"""WITH {PAY}
SELECT COALESCE(method, 'TOTAL') AS method, COUNT(*) AS payments, CAST(SUM(amount) AS DOUBLE) AS volume, COUNT(DISTINCT lease) AS leases
FROM pay WHERE rent AND day BETWEEN '1997-04-25' AND '1997-05-24' GROUP BY ROLLUP (method)"""

ORACLES["a13_distinct_levels"] = f"""WITH {PAY}, p AS (SELECT * FROM pay WHERE cyc {_REPORTED})
SELECT 'period,method' AS level, cyc AS period, method, COUNT(DISTINCT lease) AS keys FROM p GROUP BY ALL
UNION ALL SELECT 'period', cyc, NULL, COUNT(DISTINCT lease) FROM p GROUP BY ALL
UNION ALL SELECT 'method', NULL, method, COUNT(DISTINCT lease) FROM p GROUP BY ALL
UNION ALL SELECT '', NULL, NULL, COUNT(DISTINCT lease) FROM p"""

# Published results ---------------------------------------------------------------

_R01 = f"""WITH {PAY}, two AS (SELECT * FROM pay WHERE method <> 'cash payment'),
ranked AS (SELECT *, MIN(mon) OVER (PARTITION BY payer) AS first,
  row_number() OVER (PARTITION BY payer ORDER BY day, method, amount) AS rn FROM two),
used AS (SELECT mon, payer, CASE WHEN mon = first THEN 'first_time' ELSE 'returning' END AS population, method, amount
  FROM ranked WHERE mon > first OR rn = 1),
r01 AS (SELECT mon AS period, population, COUNT(DISTINCT payer) AS payers,
  COUNT(DISTINCT payer) FILTER (WHERE method = 'charge') AS card_payers,
  COUNT(DISTINCT payer) FILTER (WHERE method = 'payment') AS ach_payers,
  {_if("method = 'charge'", 'amount')} AS card, {_if("method = 'payment'", 'amount')} AS ach
  FROM used WHERE mon BETWEEN '1995-01-01' AND '2000-12-01' GROUP BY mon, population)"""
ORACLES["r01_first_and_returning_mix"] = f"""{_R01}
SELECT period, population, payers, card_payers, ach_payers, CAST(card AS DOUBLE) AS card_amount, CAST(ach AS DOUBLE) AS ach_amount,
  CAST(card + ach AS DOUBLE) AS total_amount, {share('card', 'card + ach')} AS card_share,
  {share('card_payers', 'card_payers + ach_payers')} AS card_payer_share FROM r01"""

_AGE = """CASE WHEN start IS NULL THEN 'Unknown' WHEN datediff('month', start, mon) <= 2 THEN 'Onboarding (0–2)'
  WHEN datediff('month', start, mon) <= 6 THEN 'Growth (3–6)' WHEN datediff('month', start, mon) <= 12 THEN 'Developed (7–12)'
  ELSE 'Mature (13+)' END"""
_AGED = f"""WITH {PAY}, {DAILY},
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payer ORDER BY day, part, method, amount) AS rn FROM pay)
  WHERE rn = 1 AND mon {_REPORTED}),
starts AS (SELECT account, MIN(invoice) AS start FROM daily GROUP BY account),
aged AS (SELECT f.*, {_AGE} AS bucket FROM f LEFT JOIN starts s ON s.account = f.part),
landed AS (SELECT part, MIN(mon) AS first FROM pay GROUP BY part),
newness AS (SELECT f.mon, f.part, CASE WHEN first IS NULL THEN 'Unknown' WHEN first = mon THEN 'Account first-time paid this month'
  ELSE 'Existing account (paid before)' END AS segment FROM f LEFT JOIN landed l ON l.part = f.part)"""
_N_CARD, _N_ACH = "COUNT(*) FILTER (WHERE method = 'charge')", "COUNT(*) FILTER (WHERE method = 'payment')"
_S_CARD, _S_ACH = _if("method = 'charge'", "amount"), _if("method = 'payment'", "amount")
ORACLES["r02_first_payers_by_account_age"] = f"""{_AGED}
SELECT mon AS period, bucket, COUNT(*) AS payers, {_N_CARD} AS card_payers, {share(_N_CARD, 'COUNT(*)')} AS card_share,
  {_N_ACH} AS ach_payers, {share(_N_ACH, 'COUNT(*)')} AS ach_share, CAST({_S_CARD} AS DOUBLE) AS card_amount,
  {share(_S_CARD, 'SUM(amount)')} AS card_amount_share, CAST({_S_ACH} AS DOUBLE) AS ach_amount,
  {share(_S_ACH, 'SUM(amount)')} AS ach_amount_share, CAST(SUM(amount) AS DOUBLE) AS total_amount
FROM aged GROUP BY mon, bucket"""
ORACLES["r03_first_payers_by_newness"] = f"""{_AGED}
SELECT mon AS period, segment, COUNT(*) AS payers, COUNT(DISTINCT part) AS accounts FROM newness GROUP BY mon, segment"""
ORACLES["r04_first_payers_and_accounts"] = f"""{_AGED}
SELECT mon AS period, bucket, COUNT(*) AS payers, COUNT(DISTINCT part) AS accounts FROM aged GROUP BY mon, bucket"""

ORACLES["r05_first_payer_paths"] = f"""{_SCOPED}, started AS (SELECT part, MIN(cyc) AS first FROM pay GROUP BY part),
j AS (SELECT f.cyc AS period, CASE WHEN s.first IS NULL THEN 'unknown' WHEN datediff('month', s.first, f.cyc) <= 2 THEN 'Onboarding'
    ELSE 'Mature' END AS label, {_LAG} AS lag
  FROM f LEFT JOIN started s ON s.part = f.part LEFT JOIN la ON la.lease = f.lease WHERE f.cyc {_REPORTED})
SELECT period, label, COUNT(*) AS payers, COUNT(*) FILTER (WHERE lag = 0) AS same_period, COUNT(*) FILTER (WHERE lag > 0) AS earlier,
  COUNT(*) FILTER (WHERE lag < 0) AS later, COUNT(*) FILTER (WHERE lag IS NULL) AS unknown FROM j GROUP BY ALL"""


def _lease_share(condition: str, name: str) -> str:
    met = f"COUNT(*) FILTER (WHERE {condition})"
    return f"""WITH {FUNNEL}
SELECT cohort, label, COUNT(*) AS leases, {met} AS {name}, {pct(met, 'COUNT(*)')} AS {name}_pct
FROM cohort c LEFT JOIN steps s ON s.lease = c.lease LEFT JOIN seen e ON e.lease = c.lease GROUP BY cohort, label"""


ORACLES["r06_invited_at_activation"] = _lease_share("CAST(invited AS DATE) <= activated", "invited")
ORACLES["r07_activation_kpi_wide"] = f"""WITH {FUNNEL}, {JOURNEY}, {OUTCOMES},
t AS (SELECT cohort, label, COUNT(*) AS leases, COUNT(*) FILTER (WHERE portal_active) AS portal_active, COUNT(first_paid) AS converted,
  COUNT(*) FILTER (WHERE p3) AS retained, COUNT(*) FILTER (WHERE p1) AS retained_p1, COUNT(*) FILTER (WHERE p2) AS retained_p2,
  COUNT(*) FILTER (WHERE p1 AND p2) AS habit, COUNT(*) FILTER (WHERE was_sent) AS invites_sent,
  CAST(MEDIAN(datediff('day', activated, CAST(sent AS DATE))) FILTER (WHERE was_sent) AS DOUBLE) AS median_days_to_invite,
  COUNT(DISTINCT account) AS accounts, COUNT(DISTINCT account) FILTER (WHERE was_sent) AS accounts_invited
  FROM outcomes GROUP BY cohort, label)
SELECT cohort, label, leases, portal_active, {pct0('portal_active', 'leases')} AS attach_pct, converted,
  {pct0('converted', 'portal_active')} AS conversion_pct, converted AS retention_base, retained, {pct0('retained', 'converted')} AS retention_pct,
  retained_p1, retained_p2, {pct0('retained_p1', 'converted')} AS retention_p1_pct, {pct0('retained_p2', 'converted')} AS retention_p2_pct,
  {pct0('habit', 'converted')} AS habit_pct, invites_sent, {pct0('invites_sent', 'leases')} AS invite_pct, median_days_to_invite,
  accounts, accounts_invited, {pct0('accounts_invited', 'accounts')} AS account_coverage_pct FROM t"""
ORACLES["r08_attach_rate"] = _lease_share("abs(datediff('day', activated, CAST(accepted AS DATE))) <= 180", "attached")
ORACLES["r09_new_lease_eligibility"] = _lease_share("CAST(accepted AS DATE) <= cohort + 23", "eligible")
ORACLES["r10_paid_accounts"] = f"""WITH {PAY},
x AS (SELECT DISTINCT part, cyc, MIN(cyc) OVER (PARTITION BY part) AS first FROM pay)
SELECT cyc AS period, COUNT(*) AS paid, COUNT(*) FILTER (WHERE cyc = first) AS first_time, COUNT(*) FILTER (WHERE cyc > first) AS returning,
  {share('COUNT(*) FILTER (WHERE cyc = first)', 'COUNT(*)')} AS first_time_share,
  {share('COUNT(*) FILTER (WHERE cyc > first)', 'COUNT(*)')} AS returning_share
FROM x WHERE cyc BETWEEN '1995-01-01' AND '2000-12-01' GROUP BY cyc"""

# Active: the latest snapshot of the cycle is.
_STATES = f"""a AS (SELECT lease, cyc, account FROM (
    SELECT *, row_number() OVER (PARTITION BY lease, cyc ORDER BY day DESC, status = 'ACTIVE' DESC, account DESC) AS rn
    FROM (SELECT *, {cyc('day')} AS cyc FROM daily)) WHERE rn = 1 AND status = 'ACTIVE' AND cyc {_REPORTED}),
p AS (SELECT lease, cyc, MAX(part) AS account FROM pay WHERE cyc {_REPORTED} GROUP BY ALL),
states AS (SELECT COALESCE(a.lease, p.lease) AS lease, COALESCE(a.cyc, p.cyc) AS cyc, a.lease IS NOT NULL AS active,
  p.lease IS NOT NULL AS paid, COALESCE(a.account, p.account) AS account
  FROM a FULL JOIN p ON p.lease = a.lease AND p.cyc = a.cyc)"""
_ACTIVE, _PAID = "COUNT(*) FILTER (WHERE active)", "COUNT(*) FILTER (WHERE paid)"
_ELIGIBLE = "COUNT(*) FILTER (WHERE active AND CAST(accepted AS DATE) <= cyc + 23)"
ORACLES["r11_eligible_and_paid"] = f"""WITH {PAY}, {DAILY}, {MEMBERS}, {STEPS}, {_STATES}
SELECT cyc AS period, {_ACTIVE} AS active, {_ELIGIBLE} AS eligible, {_PAID} AS paid, {pct(_ELIGIBLE, _ACTIVE)} AS eligible_of_active_pct,
  {pct(_PAID, _ELIGIBLE)} AS paid_of_eligible_pct, {pct(_PAID, _ACTIVE)} AS paid_of_active_pct
FROM states x LEFT JOIN steps s ON s.lease = x.lease GROUP BY cyc"""

_MOVES = ", ".join(
    f"COUNT(*) FILTER (WHERE b = '{b}' AND s = '{s}') AS {name}"
    for b, s, name in (
        ("paid", "paid", "retained_paid"),
        ("unpaid", "paid", "converted"),
        ("absent", "paid", "new_paid"),
        ("unpaid", "unpaid", "retained_unpaid"),
        ("absent", "unpaid", "new_unpaid"),
        ("paid", "unpaid", "downgraded"),
        ("paid", "absent", "paid_dropped"),
        ("unpaid", "absent", "dropped_unpaid"),
    )
)
ORACLES["r12_state_transitions"] = f"""WITH {PAY}, {DAILY}, {_STATES},
firsts AS (SELECT lease, MIN(cyc) AS first_paid FROM pay GROUP BY lease),
grid AS (SELECT lease, cyc FROM states UNION SELECT lease, CAST(cyc + INTERVAL 1 MONTH AS DATE) FROM states WHERE cyc < '1997-12-01'),
walk AS (
  SELECT g.cyc, COALESCE(x.paid, false) AS paid, COALESCE(x.active, false) AS active, f.first_paid = g.cyc AS is_first,
    CASE WHEN y.active THEN CASE WHEN y.paid THEN 'paid' ELSE 'unpaid' END ELSE 'absent' END AS b,
    CASE WHEN x.active THEN CASE WHEN x.paid THEN 'paid' ELSE 'unpaid' END ELSE 'absent' END AS s
  FROM grid g LEFT JOIN states x ON x.lease = g.lease AND x.cyc = g.cyc
  LEFT JOIN states y ON y.lease = g.lease AND y.cyc = g.cyc - INTERVAL 1 MONTH LEFT JOIN firsts f ON f.lease = g.lease),
m AS (SELECT cyc AS period, {_ACTIVE} AS active, {_PAID} AS paid, {_MOVES},
  COUNT(*) FILTER (WHERE b = 'paid' AND s <> 'paid') AS paid_churned, COUNT(*) FILTER (WHERE paid AND NOT active) AS paid_inactive,
  COUNT(*) FILTER (WHERE active AND paid AND is_first) AS first_time_paid, {pct(_PAID, _ACTIVE)} AS paid_pct FROM walk GROUP BY cyc)
SELECT m.*, m.active - n.active AS active_change, m.paid - n.paid AS paid_change, m.paid_pct - n.paid_pct AS paid_pct_change
FROM m LEFT JOIN m n ON n.period = m.period - INTERVAL 1 MONTH"""


def _breakdown(key: str) -> str:
    return f"""WITH {PAY}, x AS (SELECT DISTINCT {key} AS k, cyc FROM pay),
l AS (SELECT k, cyc, LAG(cyc) OVER (PARTITION BY k ORDER BY cyc) AS prev FROM x),
c AS (SELECT cyc AS period, COUNT(*) AS paid, COUNT(*) FILTER (WHERE datediff('month', prev, cyc) = 1) AS existing,
  COUNT(*) FILTER (WHERE prev IS NULL) AS first_time, COUNT(*) FILTER (WHERE datediff('month', prev, cyc) > 1) AS reactivated
  FROM l GROUP BY cyc),
r13 AS (SELECT c.*, COALESCE(b.paid, 0) - c.existing AS churned
  FROM c LEFT JOIN c b ON b.period = c.period - INTERVAL 1 MONTH WHERE c.period BETWEEN '1995-01-01' AND '2000-12-01')"""


ORACLES["r13_paid_breakdown"] = f"{_breakdown('lease')} SELECT * FROM r13"
ORACLES["r13_payers_by_increment"] = f"""WITH {PAY}, a AS (SELECT DISTINCT payer, cyc FROM pay),
own AS (SELECT cyc, EXISTS (SELECT 1 FROM a b WHERE b.payer = a.payer AND b.cyc = a.cyc - INTERVAL 1 MONTH) AS again,
  EXISTS (SELECT 1 FROM a b WHERE b.payer = a.payer AND b.cyc < a.cyc) AS known FROM a),
lost AS (SELECT CAST(cyc + INTERVAL 1 MONTH AS DATE) AS cyc, COUNT(*) AS n FROM a
  WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.payer = a.payer AND b.cyc = a.cyc + INTERVAL 1 MONTH) GROUP BY ALL),
kinds AS (SELECT cyc, COUNT(*) AS paid, COUNT(*) FILTER (WHERE again) AS existing, COUNT(*) FILTER (WHERE NOT known) AS first_time,
  COUNT(*) FILTER (WHERE known AND NOT again) AS reactivated FROM own GROUP BY cyc)
SELECT COALESCE(k.cyc, l.cyc) AS period, COALESCE(paid, 0) AS paid, COALESCE(existing, 0) AS existing,
  COALESCE(first_time, 0) AS first_time, COALESCE(reactivated, 0) AS reactivated, COALESCE(n, 0) AS churned
FROM kinds k FULL JOIN lost l ON l.cyc = k.cyc WHERE COALESCE(k.cyc, l.cyc) BETWEEN '2000-10-01' AND '2000-12-01'"""
ORACLES["s02_lease_intervals"] = f"""WITH {DAILY},
d AS (SELECT DISTINCT lease, account, status, day FROM daily),
runs AS (SELECT *, SUM(fresh) OVER (PARTITION BY lease, account, status ORDER BY day) AS run FROM (
  SELECT *, CASE WHEN day - LAG(day) OVER (PARTITION BY lease, account, status ORDER BY day) <= 31 THEN 0 ELSE 1 END AS fresh FROM d))
SELECT lease AS lease_id, account, status, MIN(day) AS first_day, MAX(day) AS last_day FROM runs GROUP BY lease, account, status, run"""
ORACLES["r14_paid_by_segment"] = f"""WITH {PAY}, {DAILY}, {_STATES}
SELECT cyc AS period, COALESCE(p_type, 'Unknown') AS segment, {_ACTIVE} AS active, {_PAID} AS paid, {share(_PAID, _ACTIVE)} AS paid_share
FROM states LEFT JOIN part ON p_partkey = account GROUP BY ALL"""
_HEAT = ", ".join(
    f"CASE WHEN cohort + INTERVAL {k} MONTH <= '1997-12-01' THEN m{k} END AS m{k}" for k in range(8)
)
_HEAT_PCT = ", ".join(f"{pct(f'm{k}', 'cohort_size')} AS m{k}_pct" for k in range(8))
ORACLES["r15_retention_heatmap"] = f"""WITH {PAY}, {DAILY}, {COHORT}, matrix AS ({_LEASE_MATRIX}),
cut AS (SELECT cohort, label, cohort_size, {_HEAT} FROM matrix) SELECT *, {_HEAT_PCT} FROM cut"""
ORACLES["r16_paid_share"] = f"""WITH {PAY}, {DAILY}, {_STATES}
SELECT cyc AS period, {_ACTIVE} AS active, {_PAID} AS paid, {share(_PAID, _ACTIVE)} AS paid_share FROM states GROUP BY cyc"""
ORACLES["r17_method_stickiness"] = f"""WITH {PAY}, two AS (SELECT * FROM pay WHERE method <> 'cash payment'),
f AS (SELECT payer, cyc AS first, method AS first_method FROM (
  SELECT *, row_number() OVER (PARTITION BY payer ORDER BY day, method) AS rn FROM two) WHERE rn = 1 AND cyc {_REPORTED}),
act AS (SELECT f.first_method, datediff('month', f.first, t.cyc) AS k, t.payer, bool_or(t.method <> f.first_method) AS other
  FROM two t JOIN f ON f.payer = t.payer WHERE t.cyc <= '1997-12-01' GROUP BY ALL),
seen AS (SELECT first_method, k, COUNT(*) AS observable FROM f, range(13) t(k)
  WHERE f.first + to_months(CAST(k AS INTEGER)) <= '1997-12-01' GROUP BY ALL)
SELECT a.first_method, CAST(a.k AS INTEGER) AS "offset", COUNT(*) AS active, COUNT(*) FILTER (WHERE NOT other) AS stuck,
  COUNT(*) FILTER (WHERE other) AS switched, observable, {pct('COUNT(*)', 'observable')} AS retention_pct
FROM act a JOIN seen s ON s.first_method = a.first_method AND s.k = a.k WHERE a.k <= 12 GROUP BY a.first_method, a.k, observable"""

# Report-time steps ---------------------------------------------------------------

ORACLES["d01_report_series"] = f"""{_AGED}
SELECT mon AS period, COUNT(*) FILTER (WHERE segment LIKE 'Existing%') AS existing, COUNT(*) FILTER (WHERE segment LIKE 'Account%') AS new,
  COUNT(*) FILTER (WHERE segment = 'Unknown') AS unknown, COUNT(*) AS total FROM newness GROUP BY mon"""
ORACLES["d02_stacked_total"] = f"""{_R01}
SELECT period, CAST(SUM(payers) AS BIGINT) AS total FROM r01 WHERE period <= '2000-06-01' GROUP BY period"""
ORACLES["d03_composition"] = f"""{_AGED}
SELECT mon AS period, bucket, COUNT(*) AS payers, {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS share_pct
FROM aged WHERE mon = '1995-01-01' AND bucket <> 'Unknown' GROUP BY mon, bucket"""
ORACLES["d04_year_over_year"] = f"""{_breakdown('payer')}
SELECT a.period, a.paid, b.paid AS paid_year_ago, a.paid - b.paid AS change, {pct('a.paid - b.paid', 'b.paid')} AS change_pct
FROM r13 a LEFT JOIN r13 b ON b.period = a.period - INTERVAL 12 MONTH"""
ORACLES["d04_peak_period"] = f"""{_breakdown('payer')}
SELECT period AS peak_period, paid AS peak_value FROM r13 ORDER BY paid DESC, period DESC LIMIT 1"""
ORACLES["d05_expansion"] = f"""{_AGED}
SELECT mon AS period, bucket, {share('COUNT(*)', 'COUNT(DISTINCT part)')} AS expansion FROM aged GROUP BY mon, bucket"""
ORACLES["d06_reconcile"] = f"""{_AGED}, x AS (SELECT mon AS period, COUNT(*) AS left_total FROM aged GROUP BY mon),
y AS (SELECT mon AS period, COUNT(*) AS right_total FROM newness GROUP BY mon)
SELECT COALESCE(x.period, y.period) AS period, left_total, right_total FROM x FULL JOIN y ON y.period = x.period
WHERE left_total IS DISTINCT FROM right_total"""
ORACLES["d06_mismatches"] = f"""{_AGED}, x AS (SELECT mon AS period, COUNT(*) AS left_total FROM newness GROUP BY mon),
y AS (SELECT period, COUNT(*) AS right_total FROM (SELECT payer, MIN(mon) AS period FROM pay WHERE method <> 'cash payment' GROUP BY payer)
  WHERE period BETWEEN '1995-01-01' AND '2000-12-01' GROUP BY period)
SELECT COALESCE(x.period, y.period) AS period, left_total, right_total FROM x FULL JOIN y ON y.period = x.period
WHERE left_total IS DISTINCT FROM right_total"""
ORACLES["d06_invariants"] = f"""{_AGED}, {_STATES},
x AS (SELECT 'active: segments and all' AS pair, cyc AS period FROM states GROUP BY cyc
  UNION ALL SELECT 'paid: segments and all', cyc FROM states GROUP BY cyc
  UNION ALL SELECT 'paid: transitions and breakdown', cyc FROM states GROUP BY cyc
  UNION ALL SELECT 'first-time payers: age and newness', mon FROM aged GROUP BY mon)
SELECT pair, COUNT(*) AS periods, CAST(0 AS BIGINT) AS mismatched FROM x GROUP BY pair"""
ORACLES["d07_month_label"] = f"""{_R01}
SELECT period, strftime(period, '%b ''%y') AS label, {_if("population = 'first_time'", 'payers')}::BIGINT AS first_time,
  {_if("population = 'returning'", 'payers')}::BIGINT AS returning, SUM(payers)::BIGINT AS total FROM r01 GROUP BY period"""
