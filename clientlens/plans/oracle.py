"""The registered queries as plain SQL over the sample tables, to check results against.

The SQL is written from the definitions, row by row and without the reductions that the
Spark operators make, so that the two sides can disagree.
"""

from __future__ import annotations

import re

from clientlens.operators.slices import ENQUIRY_KINDS, JOB_KINDS

AS_OF, FLOOR = "DATE '2001-11-04'", "DATE '1995-01-01'"
ACTIVE_FROM, INACTIVE_FROM = "DATE '2000-11-04'", "DATE '1998-11-04'"
PREVIOUS_FROM = "DATE '1999-11-04'"
LOSSES = "BETWEEN DATE '2001-01-01' AND DATE '2001-08-01'"
WEEK = "BETWEEN DATE '2001-07-12' AND DATE '2001-07-20'"
BIG = "500000"


def money(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(38,4)) AS DOUBLE)"


def percent(a: str, b: str, digits: int = 2) -> str:
    return f"ROUND(COALESCE({a} / NULLIF({b}, 0), 0) * 100.0, {digits})"


def group_name(division: str, other: str = "Other") -> str:
    return f"CASE {division} WHEN 225 THEN 'I&M' WHEN 3 THEN 'ONE' ELSE '{other}' END"


ENQ_VALUE = "CAST(aprox_amount AS DECIMAL(18,4)) * CAST(rate AS DECIMAL(12,6))"
GROSS = "ov_amount * CAST(rate AS DECIMAL(12,6))"
NET = f"{GROSS} - COALESCE(total_expense_aed, 0)"
DUE = "(ov_amount - alloc) * CAST(rate AS DECIMAL(12,6))"

CTES = {
    "g_client": """
        SELECT c_custkey + 1 AS debtor_no, c_name AS name, c_nationkey + 1 AS country,
               CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'FURNITURE' THEN 2
                    WHEN 'BUILDING' THEN CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 6 END
                    WHEN 'AUTOMOBILE' THEN CASE WHEN c_custkey % 2 = 0 THEN 10 ELSE 12 END
                    WHEN 'HOUSEHOLD' THEN 5 END AS client_type,
               CAST(c_custkey % 13 AS INTEGER) AS client_status,
               CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS inactive
        FROM customer""",
    "g_temp": """
        SELECT s_suppkey + 1 AS temp_clients_id, s_name AS client_name,
               CASE WHEN s_suppkey % 8 = 0 THEN ''
                    ELSE CAST(s_nationkey + 1 AS VARCHAR) END AS country,
               CASE s_suppkey % 7 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3'
                    WHEN 4 THEN '6' WHEN 5 THEN '10' ELSE '12' END AS temp_client_type
        FROM supplier""",
    "g_country": """
        SELECT n_nationkey + 1 AS id, n_name AS name, n_regionkey + 1 AS region_id,
               '#' || CAST(n_nationkey AS VARCHAR) AS colour_code
        FROM nation""",
    "g_region": "SELECT r_regionkey + 1 AS id, r_name AS name FROM region",
    "g_dimension": """
        SELECT 225 AS id, 'I&M' AS name UNION ALL SELECT 3, 'ONE' UNION ALL
        SELECT 10, 'DIV_10' UNION ALL SELECT 11, 'DIV_11' UNION ALL SELECT 12, 'DIV_12'
        UNION ALL SELECT CAST(i AS INTEGER), 'SUB_' || i FROM range(100, 197) r(i)
        UNION ALL SELECT CAST(i AS INTEGER), 'CO_' || i FROM range(200, 205) r(i)""",
    "g_sector": """
        SELECT * FROM (VALUES (1, 'industrial'), (2, 'marine'), (3, 'oilgas'), (5, 'excluded'),
               (6, 'offshore'), (10, 'petrochemical'), (12, 'renewable')) v(id, client_type)""",
    "g_status": """
        SELECT CAST(i AS INTEGER) AS id, 'STATUS_' || i AS client_status,
               CAST(i % 4 AS INTEGER) AS category
        FROM range(0, 13) r(i)""",
    "g_orders": """
        SELECT o_orderkey AS k, o_custkey AS ck, o_orderstatus AS st,
               CAST(o_totalprice AS DECIMAL(18,2)) AS price,
               CAST(o_orderdate AS DATE) AS order_date,
               CASE o_orderpriority[1] WHEN '1' THEN 225 WHEN '2' THEN 3 WHEN '3' THEN 10
                    WHEN '4' THEN 11 ELSE 12 END AS division,
               CAST(100 + o_orderkey % 97 AS INTEGER) AS subdivision,
               CAST(200 + o_orderkey % 5 AS INTEGER) AS company,
               CAST(1 + (o_orderkey % 3) * 0.5 AS DECIMAL(12,6)) AS rate
        FROM orders""",
    "g_lines": """
        SELECT l_orderkey AS k, l_partkey AS pk, CAST(l_shipdate AS DATE) AS ship_date,
               l_linestatus = 'F' AS paid,
               CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS net,
               CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS tax
        FROM lineitem""",
    "g_enquiry": """
        SELECT o.k AS client_enquiry_id,
               CASE WHEN o.k % 10 = 0 THEN 0 ELSE o.ck + 1 END AS debtor_no,
               CASE WHEN o.k % 10 = 0 THEN 0 ELSE 1 END AS branch_code,
               CASE WHEN o.k % 10 = 0
                    THEN (o.k // 10) % (SELECT COUNT(*) FROM supplier) + 1 ELSE 0 END
                    AS enquiry_temp_id,
               o.order_date AS enquiry_date, o.company, o.division, o.subdivision,
               CASE WHEN o.k % 11 = 0 THEN 3 WHEN o.k % 11 = 1 THEN 4 WHEN o.st = 'O' THEN 0
                    WHEN o.st = 'P' THEN 1 WHEN o.st = 'F' THEN 2 END AS enq_status,
               CAST(o.k % 6 + 1 AS INTEGER) AS enq_type, o.price AS aprox_amount, o.rate,
               CASE WHEN o.k % 9 = 0 THEN o.k ELSE 0 END AS parent_id,
               CASE WHEN o.k % 20 = 1 THEN 0 ELSE 1 END AS is_active,
               'B' || o.k AS book_no
        FROM g_orders o""",
    "g_resolved": """
        SELECT e.*,
               CASE WHEN e.debtor_no > 0 THEN e.debtor_no
                    WHEN e.enquiry_temp_id > 0 THEN -e.enquiry_temp_id END AS client_ref,
               CASE WHEN e.debtor_no > 0 THEN CAST(e.debtor_no AS VARCHAR)
                    WHEN e.enquiry_temp_id > 0 THEN 'TMP' || e.enquiry_temp_id END AS client_key,
               COALESCE(d.name, t.client_name) AS client_name,
               COALESCE(d.country, TRY_CAST(NULLIF(t.country, '') AS INTEGER)) AS country_id,
               COALESCE(d.client_type, TRY_CAST(NULLIF(t.temp_client_type, '') AS INTEGER))
                   AS client_type,
               d.country AS registered_country
        FROM g_enquiry e LEFT JOIN g_client d ON e.debtor_no = d.debtor_no
        LEFT JOIN g_temp t ON e.enquiry_temp_id = t.temp_clients_id""",
    "g_invoice": """
        SELECT b.k AS trans_no, 10 AS trans_type, o.ck + 1 AS debtor_no, b.tran_date,
               b.ov_amount, b.alloc, b.total_expense_aed, o.rate, o.company AS dimension_id,
               o.division AS dimension2_id, o.subdivision AS dimension3_id
        FROM (SELECT k, MAX(ship_date) AS tran_date, CAST(SUM(net) AS DECIMAL(18,4)) AS ov_amount,
                     CAST(COALESCE(SUM(net) FILTER (WHERE paid), 0) AS DECIMAL(18,4)) AS alloc,
                     CAST(SUM(tax) AS DECIMAL(18,4)) AS total_expense_aed
              FROM g_lines GROUP BY k) b JOIN g_orders o ON b.k = o.k""",
    "g_payment": """
        SELECT k AS trans_no_to, 10 AS trans_type_to, 12 AS trans_type_from,
               ship_date AS date_alloc, CAST(net AS DECIMAL(18,4)) AS alloc_amount
        FROM g_lines WHERE paid""",
    "g_activity": """
        SELECT CASE WHEN e.client_ref > 0 THEN e.client_ref END AS debtor_no,
               CASE WHEN e.client_ref < 0 THEN -e.client_ref ELSE 0 END AS temp_client_id,
               e.division, e.subdivision AS sub_division, e.country_id, c.region_id,
               e.client_type, MAX(e.enquiry_date) AS enquiry_date,
               MAX(CASE WHEN e.client_ref > 0 THEN i.tran_date END) AS job_date
        FROM g_resolved e LEFT JOIN g_country c ON e.country_id = c.id
        LEFT JOIN g_invoice i ON i.trans_no = e.client_enquiry_id
        GROUP BY ALL""",
    "g_code_activity": """
        SELECT CAST(l.pk AS VARCHAR) AS activity_code, o.ck + 1 AS debtor_no, o.division,
               o.subdivision AS sub_division, d.country AS country_id, d.client_type,
               o.order_date AS enquiry_date, l.ship_date AS job_date
        FROM g_lines l JOIN g_orders o ON l.k = o.k
        LEFT JOIN g_client d ON d.debtor_no = o.ck + 1""",
    "g_job_activity": """
        SELECT CAST(p_partkey AS VARCHAR) AS activity_code,
               CASE p_size % 5 WHEN 0 THEN 225 WHEN 1 THEN 3 WHEN 2 THEN 10 WHEN 3 THEN 11
                    ELSE 12 END AS division_id,
               CAST(100 + p_partkey % 97 AS INTEGER) AS sub_division_id,
               CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS status
        FROM part""",
    "g_credit": """
        SELECT o.ck + 1 AS debtor_no, CAST(o.ck % 90 AS INTEGER) AS current_credit_period,
               MAX(l.ship_date) - CAST(60 + o.ck % 700 AS INTEGER) AS date_of_curr_pmnt
        FROM g_lines l JOIN g_orders o ON l.k = o.k
        WHERE l.paid GROUP BY o.ck""",
    "v_enquiry": f"""
        SELECT e.client_enquiry_id, e.client_ref, e.client_key, e.country_id,
               c.name AS country_name, c.region_id, r.name AS region_name, e.enq_status,
               e.enquiry_date, {ENQ_VALUE} AS amount, e.client_type, e.division,
               e.subdivision AS sub_division
        FROM g_resolved e LEFT JOIN g_country c ON e.country_id = c.id
        LEFT JOIN g_region r ON c.region_id = r.id WHERE e.client_type <> 5""",
    "v_invoice": f"""
        SELECT i.trans_no AS invoice_no, i.debtor_no, i.tran_date, i.dimension2_id AS division,
               i.dimension3_id AS sub_division, d.country AS country_id, c.region_id,
               d.client_type, {NET} AS invoice_amount
        FROM g_invoice i LEFT JOIN g_client d ON i.debtor_no = d.debtor_no
        LEFT JOIN g_country c ON d.country = c.id
        WHERE d.client_type <> 5 AND d.country IS NOT NULL""",
    "live": "SELECT * FROM g_activity WHERE country_id > 0 AND client_type <> 5",
    "keyed": f"""
        SELECT *, COALESCE(debtor_no, CASE WHEN temp_client_id > 0 THEN -temp_client_id END)
            AS client_ref
        FROM live WHERE enquiry_date >= {FLOOR}""",
    "e_registered": f"""
        SELECT e.*, {ENQ_VALUE} AS amount, c.region_id
        FROM g_resolved e LEFT JOIN g_country c ON e.registered_country = c.id""",
}


def _with(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the CTEs it needs, in order of definition."""
    known = {**CTES, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in known.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    parts = ", ".join(f"{n} AS ({known[n].strip()})" for n in known if n in needed)
    return f"WITH {parts} {sql.strip()}" if parts else sql.strip()


def slice_sql(division=None, subdivision=None, country=None, region=None, sector=None) -> str:
    tests = {
        "division": division, "sub_division": subdivision, "country_id": country,
        "region_id": region, "client_type": sector,
    }
    return " AND ".join([f"{c} = {v}" for c, v in tests.items() if v is not None]) or "TRUE"


SLICE = slice_sql(3, 107)
DIVISION = slice_sql(3)


def country_activity(where: str) -> str:
    return f"""
        SELECT a.country_id, c.name AS country_name, MIN(r.name) AS region_name,
               MAX(a.enquiry_date) AS enquiry_date, MAX(a.job_date) AS job_date
        FROM (SELECT * FROM live WHERE {where}) a LEFT JOIN g_country c ON a.country_id = c.id
        LEFT JOIN g_region r ON a.region_id = r.id GROUP BY a.country_id, c.name"""


def client_activity(where: str) -> str:
    return f"""
        SELECT k.client_ref, k.enquiry_date, k.job_date, k.division, k.sub_division, k.sector_id,
               COALESCE(d.name, t.client_name) AS client_name, d.client_status AS status_id,
               s.client_type, d.debtor_no,
               CASE WHEN client_ref < 0 THEN -client_ref ELSE 0 END AS temp_client_id,
               CAST(ABS(client_ref) AS VARCHAR) AS client_id,
               CASE WHEN client_ref < 0 THEN 'TMP' || -client_ref ELSE '' END AS client_status
        FROM (SELECT client_ref, MAX(enquiry_date) AS enquiry_date, MAX(job_date) AS job_date,
                     MIN(division) AS division, MIN(sub_division) AS sub_division,
                     MIN(client_type) AS sector_id
              FROM keyed WHERE client_ref IS NOT NULL AND {where} GROUP BY client_ref) k
        LEFT JOIN g_client d ON k.client_ref = d.debtor_no
        LEFT JOIN g_temp t ON k.client_ref = -t.temp_clients_id
        LEFT JOIN g_sector s ON k.sector_id = s.id"""


def codes(where: str) -> str:
    return f"""
        SELECT x.* EXCLUDE (country_id), d.name AS country_name, d.region_id,
               r.name AS region_name
        FROM (SELECT ja.activity_code, MAX(c.enquiry_date) AS enquiry_date,
                     MAX(c.job_date) AS job_date, MIN(c.country_id) AS country_id,
                     MIN(c.debtor_no) AS debtor_no, MIN(c.client_type) AS client_type,
                     MIN(c.division) AS division, MIN(c.sub_division) AS sub_division
              FROM g_job_activity ja
              LEFT JOIN g_code_activity c ON c.activity_code = ja.activity_code
              LEFT JOIN g_country d ON c.country_id = d.id
              WHERE ja.activity_code <> '' AND c.client_type <> 5 AND ja.status = 1 AND {where}
              GROUP BY ja.activity_code) x
        LEFT JOIN g_country d ON x.country_id = d.id LEFT JOIN g_region r ON d.region_id = r.id"""


def lifecycle(where: str = "TRUE") -> str:
    out = []
    for prefix, d in (("enquiry", "enquiry_date"), ("job", "job_date")):
        out += [
            f"COUNT(*) FILTER ({where_and(where, f'{d} > {FLOOR}')}) AS {prefix}_total",
            f"COUNT(*) FILTER ({where_and(where, f'{d} BETWEEN {ACTIVE_FROM} AND {AS_OF}')})"
            f" AS {prefix}_active",
            f"COUNT(*) FILTER ({where_and(where, f'{d} BETWEEN {INACTIVE_FROM} AND {ACTIVE_FROM}')})"
            f" AS {prefix}_inactive",
            f"COUNT(*) FILTER ({where_and(where, f'{d} > {FLOOR} AND {d} <= {INACTIVE_FROM}')})"
            f" AS {prefix}_lost",
        ]
    return ", ".join(out)


def where_and(a: str, b: str) -> str:
    return f"WHERE {a} AND {b}"


SEGMENTS = {
    "active_enq": f"enquiry_date BETWEEN {ACTIVE_FROM} AND {AS_OF}",
    "inactive_enq": f"enquiry_date BETWEEN {INACTIVE_FROM} AND {ACTIVE_FROM}",
    "lost_enq": f"enquiry_date > {FLOOR} AND enquiry_date <= {INACTIVE_FROM}",
    "blacklisted_enq": f"status_id = 6 AND enquiry_date > {FLOOR}",
    "nonexisting_enq": f"status_id IN (2,4,11,12) AND enquiry_date > {FLOOR}",
    "idle_enq": f"enquiry_date > {FLOOR}",
    "total_job": f"job_date > {FLOOR} AND job_date <= {AS_OF}",
    "job_active": f"job_date BETWEEN {ACTIVE_FROM} AND {AS_OF}",
    "job_inactive": f"job_date BETWEEN {INACTIVE_FROM} AND {ACTIVE_FROM}",
    "job_lost": f"job_date > {FLOOR} AND job_date <= {INACTIVE_FROM}",
    "job_blacklisted": f"status_id = 6 AND job_date > {FLOOR}",
    "job_nonexisting": f"status_id IN (2,4,11,12) AND job_date > {FLOOR}",
    "idle_job": f"job_date > {FLOOR} AND job_date <= {AS_OF}",
    None: f"enquiry_date >= {FLOOR}",
}


def sums(view: str, amount: str, where: str, *keys: str) -> str:
    listed = ", ".join(keys)
    return (
        f"SELECT {listed}, COUNT(*) AS n, {money(f'SUM({amount})')} AS amount "
        f"FROM {view} WHERE {where} GROUP BY {listed}"
    )


def growth(name: str, before: str, now: str, digits: int) -> str:
    return (
        f"{before} AS {name}_previous, {now} AS {name}_current, "
        f"{money(f'CAST({now} AS DECIMAL(38,4)) - CAST({before} AS DECIMAL(38,4))')} "
        f"AS {name}_growth, "
        + percent(
            money(f"CAST({now} AS DECIMAL(38,4)) - CAST({before} AS DECIMAL(38,4))"), before, digits
        )
        + f" AS {name}_growth_percent"
    )


KEPT = "COALESCE(enq_status, 0) <> 3"
PREVIOUS = f"enquiry_date >= {PREVIOUS_FROM} AND enquiry_date < {ACTIVE_FROM}"
CURRENT = f"enquiry_date > {ACTIVE_FROM} AND enquiry_date < {AS_OF}"
ACTIVE = f"enquiry_date BETWEEN {ACTIVE_FROM} AND {AS_OF}"
INV_BEFORE = f"tran_date BETWEEN {PREVIOUS_FROM} AND {ACTIVE_FROM}"
INV_NOW = f"tran_date BETWEEN {ACTIVE_FROM} AND {AS_OF}"


def total(amount: str, where: str) -> str:
    return money(f"COALESCE(SUM({amount}) FILTER (WHERE {where}), 0)")


def enquiry_growth(where: str, digits: int) -> str:
    return f"""
        SELECT {growth("enquiry", "p", "c", digits)} FROM (
            SELECT {total("amount", f"{PREVIOUS} AND {KEPT}")} AS p,
                   {total("amount", f"{CURRENT} AND {KEPT}")} AS c
            FROM e_registered WHERE {where})"""


INVOICES = f"""
    (SELECT i.*, d.country AS country_id, c.region_id, d.client_type,
            i.dimension2_id AS division, i.dimension3_id AS sub_division,
            {NET} AS net, {GROSS} AS gross
     FROM g_invoice i LEFT JOIN g_client d ON i.debtor_no = d.debtor_no
     LEFT JOIN g_country c ON d.country = c.id WHERE d.client_type <> 5)"""


def invoice_growth(where: str) -> str:
    return f"""
        SELECT {growth("net", "np", "nc", 2)}, {growth("gross", "gp", "gc", 2)} FROM (
            SELECT {total("net", INV_BEFORE)} AS np, {total("net", INV_NOW)} AS nc,
                   {total("gross", INV_BEFORE)} AS gp, {total("gross", INV_NOW)} AS gc
            FROM {INVOICES} WHERE {where})"""


def enquiry_share(where: str, transfers: bool) -> str:
    window = ACTIVE if transfers else f"{CURRENT} AND {KEPT}"
    rows = " UNION ALL ".join(
        f"""SELECT '{name}' AS division_group, {total("amount",
            f"division = {d} AND client_type <> 5 AND {window}")} AS amount,
            {total("amount", f"{CURRENT} AND {KEPT}")} AS whole
            FROM e_registered WHERE {where}"""
        for d, name in ((225, "I&M"), (3, "ONE"))
    )
    return f"SELECT division_group, amount, {percent('amount', 'whole')} AS percent FROM ({rows})"


def invoice_share(where: str) -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{name}' AS division_group, {total("net", f"{test} AND {INV_NOW}")} AS amount,
            {total("net", INV_NOW)} AS whole FROM {INVOICES} WHERE {where}"""
        for test, name in (
            ("division = 225", "I&M"), ("division = 3", "ONE"),
            ("division NOT IN (3, 225)", "Non Marine"),
        )
    )
    return f"SELECT division_group, amount, {percent('amount', 'whole')} AS percent FROM ({rows})"


def by_sector(source: str, amount: str, where: str) -> str:
    return f"""
        SELECT s.id AS sector_id, s.client_type AS sector,
               {money(f"COALESCE(SUM(x.{amount}), 0)")} AS amount
        FROM g_sector s LEFT JOIN (SELECT * FROM {source} WHERE {where}) x
            ON x.client_type = s.id
        WHERE s.id <> 5 GROUP BY s.id, s.client_type"""


# Idle: history that no row inside the slice continues; as NOT EXISTS over the rows.
def idle_countries(day: str, around: str, here: str) -> str:
    return f"""
        SELECT DISTINCT h.country_id FROM live h WHERE h.{day} > {FLOOR} AND {around}
        AND NOT EXISTS (SELECT 1 FROM live p WHERE p.country_id = h.country_id
                        AND p.{day} > {FLOOR} AND {around} AND {here})"""


def idle_clients(day: str, around: str, here: str) -> str:
    return f"""
        SELECT DISTINCT h.client_ref FROM keyed h
        WHERE h.{day} > {FLOOR} AND h.client_ref > 0 AND {around}
        AND NOT EXISTS (SELECT 1 FROM keyed p WHERE p.client_ref = h.client_ref
                        AND p.{day} > {FLOOR} AND {around} AND {here})"""


def metrics(part: dict, transfers: bool) -> str:
    """The board in long form: one SELECT per figure."""
    full = slice_sql(**part)
    around = slice_sql(**{k: v for k, v in part.items() if k in ("country", "region", "sector")})
    here = slice_sql(**{k: v for k, v in part.items() if k in ("division", "subdivision")})
    on_enquiry = (
        full.replace("sub_division", "subdivision").replace("country_id", "registered_country")
    )
    on_code = slice_sql(country=part.get("country"), sector=part.get("sector"))
    on_code = on_code.replace("country_id", "c.country_id").replace("client_type", "c.client_type")
    if "region" in part:
        on_code += f" AND d.region_id = {part['region']}"
    if "division" in part:
        on_code += f" AND ja.division_id = {part['division']}"
    if "subdivision" in part:
        on_code += f" AND ja.sub_division_id = {part['subdivision']}"

    def long(select: str, prefix: str, names: list[str]) -> str:
        return " UNION ALL ".join(
            f"""SELECT '{prefix}_{n}' AS metric, CAST("{n}" AS DOUBLE) AS value FROM ({select})"""
            for n in names
        )

    sides = ("total", "active", "inactive", "lost")
    cycle = [f"{p}_{s}" for p in ("enquiry", "job") for s in sides]
    pieces = [
        long(f"SELECT COUNT(*) AS countries, {lifecycle()} FROM ({country_activity(full)})",
             "country", ["countries", *cycle]),
        long(f"SELECT {lifecycle()} FROM ({client_activity(full)}) WHERE enquiry_date > {FLOOR}",
             "client", cycle),
        long(status_counts(full), "client",
             ["enquiry_blacklisted", "enquiry_closed", "job_blacklisted", "job_closed"]),
        long(f"SELECT {lifecycle()} FROM ({codes(on_code)}) WHERE enquiry_date >= {FLOOR}",
             "activity", cycle),
        long(enquiry_growth(on_enquiry, 1), "amount",
             [f"enquiry_{x}" for x in ("previous", "current", "growth", "growth_percent")]),
        long(invoice_growth(full), "amount",
             [f"{p}_{x}" for p in ("net", "gross")
              for x in ("previous", "current", "growth", "growth_percent")]),
    ]
    for entity, rows in (("country", idle_countries), ("client", idle_clients)):
        for name, day in (("enquiry", "enquiry_date"), ("job", "job_date")):
            pieces.append(
                f"SELECT '{entity}_idle_{name}', CAST(COUNT(*) AS DOUBLE) "
                f"FROM ({rows(day, around, here)})"
            )
    for prefix, rows in (
        ("enquiry", enquiry_share(on_enquiry, transfers)), ("invoice", invoice_share(full)),
    ):
        for v in ("amount", "percent"):
            pieces.append(
                f"SELECT 'amount_{prefix}_' || division_group || '_{v}', {v} FROM ({rows})"
            )
    for prefix, rows in (
        ("enquiry", by_sector("e_registered", "amount", f"{on_enquiry} AND {ACTIVE}")),
        ("invoice", by_sector(INVOICES, "net", f"{full} AND {INV_NOW}")),
    ):
        pieces.append(f"SELECT 'amount_{prefix}_' || sector, amount FROM ({rows})")
    return " UNION ALL ".join(pieces)


def board(long: str) -> str:
    """All figures as columns of one row."""
    names = re.findall(r"'(\w+)' AS metric", long) + re.findall(r"SELECT '(\w+_idle_\w+)', CAST", long)
    groups = {"enquiry": ("I&M", "ONE"), "invoice": ("I&M", "ONE", "Non Marine")}
    names += [f"amount_{p}_{g}_{v}" for p, own in groups.items() for g in own for v in ("amount", "percent")]
    sectors = ("industrial", "marine", "oilgas", "offshore", "petrochemical", "renewable")
    names += [f"amount_{p}_{s}" for p in groups for s in sectors]
    columns = ", ".join(f"""MAX(value) FILTER (WHERE metric = '{n}') AS "{n}" """ for n in names)
    return f"SELECT {columns} FROM ({long})"


SLICED_KEYS = {"division": "division", "subdivision": "sub_division", "country": "country_id", "region": "region_id", "sector": "client_type"}


def sliced_boards() -> str:
    """Boards of all slices of up to two keys: every slice meets every row that it holds."""
    keys = tuple(SLICED_KEYS)
    rows = {
        "act": f"SELECT {', '.join(f'{c} AS s_{k}' for k, c in SLICED_KEYS.items())}, country_id AS entity, enquiry_date, job_date FROM live",
        "cli": f"""SELECT {', '.join(f'k.{c} AS s_{k}' for k, c in SLICED_KEYS.items())}, client_ref AS entity, enquiry_date, job_date,
            d.client_status AS status_id FROM keyed k LEFT JOIN g_client d ON k.client_ref = d.debtor_no WHERE client_ref IS NOT NULL""",
        "cod": """SELECT DISTINCT ja.division_id AS s_division, ja.sub_division_id AS s_subdivision, c.country_id AS s_country, d.region_id AS s_region,
            c.client_type AS s_sector, c.activity_code AS entity, c.enquiry_date, c.job_date
            FROM g_job_activity ja JOIN g_code_activity c ON c.activity_code = ja.activity_code LEFT JOIN g_country d ON c.country_id = d.id
            WHERE ja.activity_code <> '' AND c.client_type <> 5 AND ja.status = 1""",
        "enq": f"""SELECT division AS s_division, subdivision AS s_subdivision, registered_country AS s_country, region_id AS s_region,
            client_type AS s_sector, division, client_type, amount, enq_status, enquiry_date FROM e_registered
            WHERE enquiry_date BETWEEN {PREVIOUS_FROM} AND {AS_OF}""",
        "inv": f"""SELECT division AS s_division, sub_division AS s_subdivision, country_id AS s_country, region_id AS s_region,
            client_type AS s_sector, division, client_type, net, gross, tran_date FROM {INVOICES}
            WHERE tran_date BETWEEN {PREVIOUS_FROM} AND {AS_OF}""",
    }
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    shown = [(), *[(k,) for k in keys], *pairs]
    listed = " UNION ".join(
        f"SELECT {', '.join(f's_{k}' if k in own else f'NULL AS s_{k}' for k in keys)} FROM (SELECT s_division, s_subdivision, s_country, s_region, s_sector FROM {name})"
        + (f" WHERE {' AND '.join(f's_{k} IS NOT NULL' for k in own)}" if own else "")
        for own in shown
        for name in rows
    )
    slice_of = ", ".join(f"sl.s_{k}" for k in keys)
    held = " AND ".join(f"(sl.s_{k} IS NULL OR sl.s_{k} = x.s_{k})" for k in keys)
    same_place = " AND ".join(f"sl.s_{k} IS NOT DISTINCT FROM p.s_{k}" for k in ("country", "region", "sector"))
    same = " AND ".join(f"sl.s_{k} IS NOT DISTINCT FROM q.s_{k}" for k in keys)
    figures, parts = [], []

    def figure(part: str, column: str, name: str) -> None:
        figures.append(f"""COALESCE(CAST({part}."{column}" AS DOUBLE), 0) AS "{name}" """)

    cycle = [f"{p}_{n}" for p in ("enquiry", "job") for n in ("total", "active", "inactive", "lost")]
    for name, prefix, where, more in (
        ("act", "country", "TRUE", "COUNT(*) AS countries"),
        ("cli", "client", f"enquiry_date > {FLOOR}", f"""
            COUNT(*) FILTER (WHERE status_id = 6 AND enquiry_date > {FLOOR}) AS enquiry_blacklisted,
            COUNT(*) FILTER (WHERE status_id IN (2,4,11,12) AND enquiry_date > {FLOOR}) AS enquiry_closed,
            COUNT(*) FILTER (WHERE status_id = 6 AND enquiry_date > {FLOOR} AND job_date > {FLOOR}) AS job_blacklisted,
            COUNT(*) FILTER (WHERE status_id IN (2,4,11,12) AND enquiry_date > {FLOOR} AND job_date > {FLOOR}) AS job_closed"""),
        ("cod", "activity", f"enquiry_date >= {FLOOR}", "COUNT(*) AS codes"),
    ):
        status = ", ANY_VALUE(status_id) AS status_id" if name == "cli" else ""
        last = f"SELECT {slice_of}, entity, MAX(enquiry_date) AS enquiry_date, MAX(job_date) AS job_date{status} FROM sl JOIN {name} x ON {held} GROUP BY ALL"
        seen = ", ".join(
            f"COUNT(*) FILTER (WHERE {day} > {FLOOR}{' AND entity > 0' if name == 'cli' else ''}) AS seen_{kind}"
            for kind, day in (("enquiry", "enquiry_date"), ("job", "job_date"))
        )
        seen = f", {seen}" if name != "cod" else ""
        parts.append((f"q_{name}", f"SELECT {slice_of.replace('sl.', '')}, {more}, {lifecycle(where)}{seen} FROM ({last}) GROUP BY ALL"))
        extra = {"act": ["countries"], "cli": ["enquiry_blacklisted", "enquiry_closed", "job_blacklisted", "job_closed"], "cod": []}[name]
        for column in [*extra, *cycle]:
            figure(f"q_{name}", column, f"{prefix}_{column}")
        if name != "cod":
            for kind in ("enquiry", "job"):
                figures.append(
                    f"""CAST(COALESCE((SELECT p.seen_{kind} FROM q_{name} p WHERE {same_place} AND p.s_division IS NULL AND p.s_subdivision IS NULL), 0)
                    - COALESCE(q_{name}.seen_{kind}, 0) AS DOUBLE) AS {prefix}_idle_{kind}"""
                )
    company = " AND ".join(f"sl.s_{k} IS NULL" for k in keys)
    kept = f"{CURRENT} AND {KEPT}"
    shares = {"I&M": "division = 225", "ONE": "division = 3", "Non Marine": "division NOT IN (3, 225)"}
    sectors = {1: "industrial", 2: "marine", 3: "oilgas", 6: "offshore", 10: "petrochemical", 12: "renewable"}
    sums = [f"{total('amount', f'{PREVIOUS} AND {KEPT}')} AS p", f"{total('amount', kept)} AS c"]
    sums += [f"""{total("amount", f"{shares[g]} AND client_type <> 5 AND (({company}) AND {ACTIVE} OR NOT ({company}) AND {kept})")} AS "{g}" """
             for g in ("I&M", "ONE")]
    sums += [f"{total('amount', f'client_type = {i} AND {ACTIVE}')} AS {n}" for i, n in sectors.items()]
    outer = f"{growth('enquiry', 'p', 'c', 1)}, " + ", ".join(f""" "{g}", {percent(f'"{g}"', 'c')} AS "{g}_percent" """ for g in ("I&M", "ONE"))
    outer += ", " + ", ".join(sectors.values())
    parts.append(("q_enq", f"SELECT {slice_of.replace('sl.', '')}, {outer} FROM (SELECT {slice_of}, {', '.join(sums)} FROM sl JOIN enq x ON {held} GROUP BY {slice_of})"))
    sums = [f"{total(a, t)} AS {n}" for n, a, t in (("np", "net", INV_BEFORE), ("nc", "net", INV_NOW), ("gp", "gross", INV_BEFORE), ("gc", "gross", INV_NOW))]
    sums += [f"""{total("net", f"{test} AND {INV_NOW}")} AS "{g}" """ for g, test in shares.items()]
    sums += [f"{total('net', f'client_type = {i} AND {INV_NOW}')} AS {n}" for i, n in sectors.items()]
    outer = f"{growth('net', 'np', 'nc', 2)}, {growth('gross', 'gp', 'gc', 2)}, "
    outer += ", ".join(f""" "{g}", {percent(f'"{g}"', 'nc')} AS "{g}_percent" """ for g in shares) + ", " + ", ".join(sectors.values())
    parts.append(("q_inv", f"SELECT {slice_of.replace('sl.', '')}, {outer} FROM (SELECT {slice_of}, {', '.join(sums)} FROM sl JOIN inv x ON {held} GROUP BY {slice_of})"))
    for part, prefix, names in (("q_enq", "enquiry", ("enquiry",)), ("q_inv", "invoice", ("net", "gross"))):
        for n in names:
            for column in ("previous", "current", "growth", "growth_percent"):
                figure(part, f"{n}_{column}", f"amount_{n}_{column}")
        for g in shares if prefix == "invoice" else ("I&M", "ONE"):
            figure(part, g, f"amount_{prefix}_{g}_amount")
            figure(part, f"{g}_percent", f"amount_{prefix}_{g}_percent")
        for n in sectors.values():
            figure(part, n, f"amount_{prefix}_{n}")
    withs = ", ".join(f"{name} AS MATERIALIZED ({text})" for name, text in [*rows.items(), ("sl", listed), *parts])
    joins = " ".join(f"LEFT JOIN {name} ON {same.replace('q.', f'{name}.')}" for name, _ in parts)
    columns = ", ".join(f"CAST(sl.s_{k} AS BIGINT) AS {k}" for k in keys)
    return f"SELECT * FROM (WITH {withs} SELECT {columns}, {', '.join(figures)} FROM sl {joins})"


def status_counts(where: str) -> str:
    black, closed = "status_id = 6", "status_id IN (2,4,11,12)"
    job = f"job_date > {FLOOR}"
    return f"""
        SELECT COUNT(*) FILTER (WHERE {black}) AS enquiry_blacklisted,
               COUNT(*) FILTER (WHERE {closed}) AS enquiry_closed,
               COUNT(*) FILTER (WHERE {black} AND {job}) AS job_blacklisted,
               COUNT(*) FILTER (WHERE {closed} AND {job}) AS job_closed
        FROM ({client_activity(where)}) WHERE enquiry_date > {FLOOR}"""


def rollup(by: str, where: str) -> str:
    return f"""
        SELECT {by}, COUNT(*) AS total_enquiry_count,
               {money("SUM(amount)")} AS total_enquiry_amount,
               COUNT(*) FILTER (WHERE enq_status = 1) AS cancel_enquiry_count,
               {total("amount", "enq_status = 1")} AS cancel_enquiry_amount,
               COUNT(*) FILTER (WHERE enq_status = 2) AS lost_enquiry_count,
               {total("amount", "enq_status = 2")} AS lost_enquiry_amount
        FROM v_enquiry WHERE {where} GROUP BY {by}"""


def billed(by: str, where: str) -> str:
    key = by if by == "country_id" else "debtor_no AS client_ref"
    return f"""
        SELECT {key}, COUNT(*) AS total_invoice_count,
               {money("SUM(invoice_amount)")} AS total_invoice_amount
        FROM v_invoice WHERE {where} GROUP BY {'country_id' if by == 'country_id' else 'debtor_no'}"""


METRICS = (
    "total_enquiry_count", "total_enquiry_amount", "cancel_enquiry_count",
    "cancel_enquiry_amount", "lost_enquiry_count", "lost_enquiry_amount",
    "total_invoice_count", "total_invoice_amount",
)
FILLED = ", ".join(f"COALESCE({m}, 0) AS {m}" for m in METRICS)
CLIENT = (
    "b.client_ref, COALESCE(b.debtor_no, 0) AS debtor_no, b.client_id, b.client_name, "
    "b.client_type, b.client_status, b.temp_client_id"
)


def country_rows(base: str, on_enquiry: str, on_invoice: str) -> str:
    return f"""
        SELECT b.country_id, b.country_name, b.region_name, {FILLED} FROM ({base}) b
        LEFT JOIN ({rollup("country_id", on_enquiry)}) e ON b.country_id = e.country_id
        LEFT JOIN ({billed("country_id", on_invoice)}) i ON b.country_id = i.country_id"""


def client_rows(base: str, on_enquiry: str, on_invoice: str, lead: str = "") -> str:
    return f"""
        SELECT {lead} {CLIENT}, {FILLED} FROM ({base}) b
        LEFT JOIN ({rollup("client_ref", on_enquiry)}) e ON b.client_ref = e.client_ref
        LEFT JOIN ({billed("client_ref", on_invoice)}) i ON b.client_ref = i.client_ref"""


def idle_country_rows(day: str) -> str:
    base = f"""
        SELECT k.country_id, c.name AS country_name, r.name AS region_name
        FROM ({idle_countries(day, "TRUE", SLICE)}) k LEFT JOIN g_country c ON k.country_id = c.id
        LEFT JOIN g_region r ON c.region_id = r.id"""
    other = "division <> 3 AND sub_division <> 107"
    return country_rows(base, other, other)


def idle_client_rows(day: str, division: int, lead: str = "") -> str:
    base = f"""
        SELECT * FROM ({client_activity("TRUE")})
        WHERE client_ref IN (SELECT client_ref FROM ({idle_clients(day, "TRUE", f"division = {division}")}))"""
    other = f"division <> {division}"
    return client_rows(base, other, other, lead)


SCALED = "CAST(CAST(CAST({} AS DECIMAL(28,4)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(28,2)) AS DOUBLE)"


def in_millions(expr: str) -> str:
    return SCALED.format(expr)


PLACED_ENQUIRIES = f"""
    (SELECT e.*, {ENQ_VALUE} AS amount, c.name AS country_name, c.region_id, r.name AS region_name,
            e.subdivision AS sub_division
     FROM g_resolved e LEFT JOIN g_country c ON e.country_id = c.id
     LEFT JOIN g_region r ON c.region_id = r.id WHERE {ACTIVE})"""
PLACED_INVOICES = f"""
    (SELECT i.*, {NET} AS amount, d.name AS client_name, d.country AS country_id, d.client_type,
            c.name AS country_name, c.region_id, r.name AS region_name,
            i.dimension2_id AS division, i.dimension3_id AS sub_division
     FROM g_invoice i LEFT JOIN g_client d ON i.debtor_no = d.debtor_no
     LEFT JOIN g_country c ON d.country = c.id LEFT JOIN g_region r ON c.region_id = r.id
     WHERE {INV_NOW} AND i.ov_amount > 0 AND d.client_type <> 5)"""


def by_region(source: str, where: str, name: str) -> str:
    return f"""
        SELECT r.id AS region_id, r.name AS region_name,
               (SELECT MIN(colour_code) FROM g_country c WHERE c.region_id = r.id) AS colour_code,
               {in_millions("COALESCE(SUM(x.amount), 0)")} AS {name}
        FROM g_region r LEFT JOIN (SELECT * FROM {source} WHERE {where}) x ON x.region_id = r.id
        GROUP BY r.id, r.name"""


def by_country(source: str, where: str, name: str) -> str:
    return f"""
        SELECT c.id AS country_id, c.name AS country_name, c.colour_code,
               {in_millions("COALESCE(SUM(x.amount), 0)")} AS {name}
        FROM g_country c LEFT JOIN (SELECT * FROM {source} WHERE {where}) x ON x.country_id = c.id
        WHERE c.id IN (1, 5, 16, 2, 3, 4) GROUP BY c.id, c.name, c.colour_code"""


def only_found(text: str) -> str:
    """The same for regions or countries that have amounts, and for all countries."""
    text = text.replace("r LEFT JOIN (SELECT", "r JOIN (SELECT").replace("c LEFT JOIN (SELECT", "c JOIN (SELECT")
    return text.replace("WHERE c.id IN (1, 5, 16, 2, 3, 4)", "")


def in_job_window(text: str) -> str:
    """Invoice figures of the half-year up to 30 June 2000."""
    return text.replace(INV_NOW, "tran_date BETWEEN DATE '1999-12-30' AND DATE '2000-06-30'").replace(
        INV_BEFORE, "tran_date BETWEEN DATE '1999-06-30' AND DATE '1999-12-30'"
    )


OUTSTANDING = f"""
    SELECT i.debtor_no, i.trans_no, m.name AS client_name, s.client_status AS status,
           d1.name AS company, d2.name AS division, d3.name AS subdivision,
           p.current_credit_period AS credit_period,
           CASE WHEN tran_date >= DATE '2001-05-04' THEN {DUE} ELSE 0 END AS b6,
           CASE WHEN tran_date >= DATE '2001-08-04' THEN {DUE} ELSE 0 END AS b3, {DUE} AS bt
    FROM g_client m JOIN g_status s ON m.client_status = s.id
    JOIN g_invoice i ON m.debtor_no = i.debtor_no JOIN g_credit p ON m.debtor_no = p.debtor_no
    LEFT JOIN g_dimension d1 ON i.dimension_id = d1.id
    LEFT JOIN g_dimension d2 ON i.dimension2_id = d2.id
    LEFT JOIN g_dimension d3 ON i.dimension3_id = d3.id WHERE s.category = 2"""
BY_CLIENT = f"""
    SELECT a.debtor_no, a.client_name, a.status, a.company, a.credit_period, a.bal_6m, a.bal_3m,
           a.bal_total, m.division_text
    FROM (SELECT debtor_no, client_name, MIN(status) AS status, MIN(company) AS company,
                 COALESCE(MIN(credit_period), 0) AS credit_period, SUM(b6) AS exact_6m,
                 {money("SUM(b6)")} AS bal_6m, {money("SUM(b3)")} AS bal_3m,
                 {money("SUM(bt)")} AS bal_total
          FROM ({OUTSTANDING}) GROUP BY debtor_no, client_name) a
    JOIN (SELECT debtor_no, string_agg(entry, '; ' ORDER BY entry) AS division_text
          FROM (SELECT debtor_no, COALESCE(division, 'No Division') || ': ' ||
                       string_agg(DISTINCT COALESCE(subdivision, 'No Subdiv'), ', '
                                  ORDER BY COALESCE(subdivision, 'No Subdiv')) AS entry
                FROM ({OUTSTANDING}) GROUP BY debtor_no, COALESCE(division, 'No Division'))
          GROUP BY debtor_no) m ON a.debtor_no = m.debtor_no
    WHERE a.exact_6m > 0"""

def last_by_division(where: str) -> str:
    return f"""
        SELECT debtor_no, division, MAX(job_date) AS last_job_date,
               MAX(enquiry_date) AS last_enquiry_date
        FROM g_activity WHERE debtor_no > 0 AND {where} GROUP BY debtor_no, division"""


LAST = last_by_division("TRUE")
LATENCY = f"""
    SELECT * FROM (
        SELECT l.debtor_no, m.name AS client_name, d.name AS division_name,
               p.date_of_curr_pmnt AS last_payment_date, l.last_job_date,
               CAST((YEAR(l.last_job_date) * 12 + MONTH(l.last_job_date))
                    - (YEAR(p.date_of_curr_pmnt) * 12 + MONTH(p.date_of_curr_pmnt)) AS INTEGER)
                   AS months_diff
        FROM ({LAST}) l JOIN g_credit p ON l.debtor_no = p.debtor_no
        JOIN g_client m ON l.debtor_no = m.debtor_no JOIN g_dimension d ON l.division = d.id)
    WHERE months_diff >= 3"""


def weekly(source: str, where: str) -> str:
    return f"""
        SELECT {group_name("division")} AS div_group, COUNT(*) AS enquiry_count,
               {money(f"SUM({ENQ_VALUE})")} AS total_amt,
               COUNT(*) FILTER (WHERE {ENQ_VALUE} > {BIG}) AS over_500k
        FROM {source} WHERE {where} GROUP BY 1"""


def top_subdivision(source: str, where: str) -> str:
    return f"""
        SELECT x.subdivision, x.div_group, x.n AS enquiry_count, {money("x.amount")} AS sub_amt,
               d.name AS sub_name
        FROM (SELECT {group_name("division")} AS div_group, subdivision, COUNT(*) AS n,
                     SUM({ENQ_VALUE}) AS amount,
                     ROW_NUMBER() OVER (PARTITION BY {group_name("division")}
                                        ORDER BY COUNT(*) DESC, subdivision) AS rnk
              FROM {source} WHERE {where} GROUP BY 1, 2) x
        JOIN g_dimension d ON x.subdivision = d.id WHERE x.rnk = 1"""


def inactive(day: str, known: str = "TRUE") -> str:
    return f"""
        SELECT l.debtor_no, m.name AS client_name, m.client_status AS status_id,
               l.division AS division_id, d.name AS division_name, l.last_job_date,
               l.last_enquiry_date, p.current_credit_period,
               {money(f"(SELECT SUM({GROSS}) FROM g_invoice i WHERE i.debtor_no = m.debtor_no)")}
                   AS total_business,
               {money(f"(SELECT SUM({DUE}) FROM g_invoice i WHERE i.debtor_no = m.debtor_no)")}
                   AS total_outstanding
        FROM ({last_by_division(known)}) l JOIN g_client m ON l.debtor_no = m.debtor_no
        JOIN g_credit p ON l.debtor_no = p.debtor_no JOIN g_dimension d ON l.division = d.id
        WHERE m.client_type <> 5
        AND l.last_job_date BETWEEN {day} - INTERVAL 36 MONTH AND {day} - INTERVAL 12 MONTH"""


RECOVERED = f"""
    SELECT t.debtor_no, m.name AS client_name, d.name AS division_name, t.division_id,
           MAX(a.job_date) AS recovered_date
    FROM ({inactive(ACTIVE_FROM, f"job_date <= {ACTIVE_FROM}")}) t JOIN g_client m ON t.debtor_no = m.debtor_no
    JOIN g_dimension d ON t.division_id = d.id
    JOIN g_activity a ON a.debtor_no = t.debtor_no AND a.division = t.division_id
    WHERE a.job_date > t.last_job_date AND a.job_date > {AS_OF} - INTERVAL 11 MONTH
    GROUP BY ALL"""

LOST_ROWS = f"""
    SELECT e.client_enquiry_id, m.name AS client_name, d1.id AS division_id,
           d1.name AS division_name, d2.name AS subdivision_name, e.enquiry_date,
           s.client_type AS sector,
           CASE e.enq_status WHEN 1 THEN 'Cancel' ELSE 'Lost' END AS status, {ENQ_VALUE} AS exact
    FROM g_resolved e JOIN g_client m ON e.debtor_no = m.debtor_no
    JOIN g_dimension d1 ON e.division = d1.id JOIN g_dimension d2 ON e.subdivision = d2.id
    JOIN g_sector s ON e.client_type = s.id
    WHERE e.enquiry_date {LOSSES} AND e.division IN (3, 225) AND e.enq_status IN (1, 2)"""


def revenue(start: str, end: str) -> str:
    return f"""
        SELECT d.name AS division, i.dimension2_id AS division_id, i.debtor_no,
               m.name AS client_name,
               {money("SUM(a.alloc_amount * CAST(i.rate AS DECIMAL(12,6)))")} AS revenue
        FROM g_payment a JOIN g_invoice i
            ON a.trans_no_to = i.trans_no AND a.trans_type_to = i.trans_type
        JOIN g_client m ON i.debtor_no = m.debtor_no JOIN g_dimension d ON i.dimension2_id = d.id
        WHERE a.trans_type_from = 12 AND a.date_alloc >= DATE '{start}' AND a.date_alloc < DATE '{end}'
        GROUP BY d.name, i.dimension2_id, i.debtor_no, m.name"""


JUNE, JULY = revenue("2001-06-01", "2001-07-01"), revenue("2001-07-01", "2001-08-01")


def compact(value: str) -> str:
    v = f"CAST({value} AS DECIMAL(31,4))"
    return f"""
        CASE WHEN {value} IS NULL OR {v} = 0 THEN '0'
             WHEN ABS({v}) >= 1000000
                 THEN CAST(CAST({v} * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(28,2)) AS VARCHAR) || 'M'
             WHEN ABS({v}) >= 1000
                 THEN CAST(CAST({v} * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(28,1)) AS VARCHAR) || 'K'
             ELSE CAST(CAST({v} AS DECIMAL(20,2)) AS VARCHAR) END"""


DAILY = f"""
    SELECT enquiry_date, {group_name("division")} AS div_group, COUNT(*) AS daily_count
    FROM {{source}} WHERE {{where}} GROUP BY 1, 2"""

QUERIES = {
    "s1_extract_client": """
        SELECT debtor_no, name, country, client_type, client_status FROM g_client
        WHERE inactive = 0""",
    "s1_extract_enquiry": f"""
        SELECT client_enquiry_id, enquiry_date, division, enq_status, book_no FROM g_enquiry
        WHERE enquiry_date >= {INACTIVE_FROM}""",
    "s1_write_snapshot": f"""
        SELECT trans_no, debtor_no, tran_date, dimension2_id FROM g_invoice WHERE {INV_NOW}""",
    "s2_normalize_dates": """
        SELECT o_orderkey AS order_no,
               CASE WHEN o_orderkey % 7 > 3 THEN CAST(o_orderdate AS DATE) END AS order_date,
               CAST(o_orderdate AS DATE) AS added_date
        FROM orders""",
    "s3_coerce_numeric": """
        SELECT o_orderkey AS order_no,
               CASE WHEN o_orderkey % 5 > 2 THEN o_totalprice ELSE 0 END AS amount
        FROM orders""",
    "s4_normalize_key": """
        SELECT c_custkey,
               CASE WHEN c_custkey % 3 <> 1 THEN CAST(c_custkey AS VARCHAR) END AS debtor_no
        FROM customer""",
    "s5_load_tables": """
        SELECT r_name, COUNT(*) AS customers FROM customer
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name""",
    "s1_changed_years": f"""
        SELECT CAST(YEAR(tran_date) AS INTEGER) AS year, COUNT(*) AS invoices,
               {money("SUM(CASE WHEN YEAR(tran_date) = 1996 THEN 2 ELSE 1 END * ov_amount)")} AS amount
        FROM g_invoice GROUP BY 1""",
    "s1_merge_by_key": f"""
        WITH merged AS (
            SELECT trans_no, 10 AS trans_type, tran_date, ov_amount FROM g_invoice
            WHERE YEAR(tran_date) <> 1996 AND (trans_no % 50 > 1 OR trans_no % 50 = 0 AND YEAR(tran_date) = 1995)
            UNION ALL SELECT trans_no, 10, tran_date, 2 * ov_amount FROM g_invoice
            WHERE YEAR(tran_date) <> 1996 AND trans_no % 50 = 1
            UNION ALL SELECT trans_no, 10, CAST(tran_date + INTERVAL 12 MONTH AS DATE), 2 * ov_amount FROM g_invoice
            WHERE YEAR(tran_date) NOT IN (1995, 1996) AND trans_no % 50 = 0
            UNION ALL SELECT trans_no, 11, tran_date, ov_amount FROM g_invoice
            WHERE YEAR(tran_date) <> 1996 AND trans_no % 50 = 2)
        SELECT CAST(YEAR(tran_date) AS INTEGER) AS year, trans_type, COUNT(*) AS invoices,
               COUNT(DISTINCT trans_no) AS numbers, {money("SUM(ov_amount)")} AS amount
        FROM merged GROUP BY 1, 2""",
    "s6_two_writers": f"""
        SELECT debtor_no, division_id, last_job_date, TIMESTAMP '2000-11-04 06:00:00' AS logged_at
        FROM ({inactive(ACTIVE_FROM, f"job_date <= {ACTIVE_FROM}")}) WHERE division_id IN (225, 3, 10)""",
    "s6_state_round_trip": JULY,
    "s7_update_tracking": f"""
        WITH tracked AS (SELECT debtor_no, division_id, last_job_date FROM ({inactive(ACTIVE_FROM, f"job_date <= {ACTIVE_FROM}")})),
        kept AS (SELECT * FROM tracked t WHERE NOT EXISTS (SELECT 1 FROM ({RECOVERED}) r
            WHERE r.debtor_no = t.debtor_no AND r.division_id = t.division_id))
        SELECT *, TIMESTAMP '2000-11-04 06:00:00' AS logged_at FROM kept UNION ALL
        SELECT debtor_no, division_id, last_job_date, TIMESTAMP '2001-11-04 06:00:00'
        FROM ({inactive(AS_OF)}) c
        WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.debtor_no = c.debtor_no
            AND k.division_id = c.division_id)""",
    "s8_zero_fill": """
        SELECT o_orderkey AS order_no,
               CASE WHEN o_orderkey % 5 = 4 THEN o_totalprice ELSE 0 END AS amount,
               CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END AS customers
        FROM orders""",
    "c1_resolve_client": """
        SELECT client_enquiry_id, client_key, client_name, country_id AS client_country,
               client_type AS client_sector
        FROM g_resolved""",
    "c2_enquiry_view": f"""
        SELECT client_enquiry_id, client_key, country_id, country_name, region_id, region_name,
               enq_status, enquiry_date, {money("amount")} AS amount, client_type, division,
               sub_division
        FROM v_enquiry""",
    "c3_invoice_view": f"""
        SELECT invoice_no, debtor_no, tran_date, division, sub_division, country_id, region_id,
               client_type, {money("invoice_amount")} AS invoice_amount
        FROM v_invoice""",
    "c4_country_activity": country_activity("TRUE"),
    "c4_country_activity_sliced": country_activity(SLICE),
    "c5_client_activity": client_activity("TRUE"),
    "c5_client_activity_sliced": client_activity(slice_sql(country=6, sector=2)),
    "c6_activity_code_summary": codes("TRUE"),
    "c6_activity_code_summary_sliced": codes(
        "ja.division_id = 3 AND d.region_id = 2 AND c.client_type = 2"
    ),
    "c7_last_activity_by_division": LAST,
    "c8_gross_net_amounts": f"""
        SELECT trans_no, {money(GROSS)} AS gross_amount, {money(NET)} AS net_amount,
               {money(DUE)} AS outstanding
        FROM g_invoice""",
    "f1_slice_by_division": sums("v_enquiry", "amount", SLICE, "country_id"),
    "f1_slice_by_place": sums(
        "v_invoice", "invoice_amount", slice_sql(region=2, sector=2), "country_id", "division"
    ),
    "f1_slice_by_text_key": "SELECT * FROM g_temp WHERE TRY_CAST(temp_client_type AS BIGINT) = 2",
    "f2_lifecycle_segments": " UNION ALL ".join(
        f"SELECT '{k}' AS kind, COUNT(*) AS clients FROM ({client_activity('TRUE')}) WHERE {SEGMENTS[k]}"
        for k in (*ENQUIRY_KINDS, *JOB_KINDS)
    ),
    "f2_lifecycle_filter": f"""
        SELECT client_ref, enquiry_date FROM ({client_activity("TRUE")})
        WHERE {SEGMENTS["inactive_enq"]}""",
    "f3_in_group": sums(
        "v_invoice", "invoice_amount", "country_id IN (1, 5, 16, 2, 3, 4)", "country_id"
    ),
    "f4_between_dates": sums("v_invoice", "invoice_amount", INV_BEFORE, "division"),
    "f5_exclude_other_slice": sums(
        "v_enquiry", "amount", "division <> 3 AND sub_division <> 107", "division"
    ),
    "f6_high_value": f"""
        SELECT client_enquiry_id, {money(ENQ_VALUE)} AS amount FROM g_enquiry
        WHERE {ENQ_VALUE} > {BIG} AND parent_id = 0 AND is_active = 1 AND enq_status <= 5""",
    "k1_country_lifecycle_counts":
        f"SELECT COUNT(*) AS countries, {lifecycle()} FROM ({country_activity('TRUE')})",
    "k1_country_lifecycle_counts_sliced":
        f"SELECT COUNT(*) AS countries, {lifecycle()} FROM ({country_activity(SLICE)})",
    "k2_client_lifecycle_counts": f"""
        SELECT {lifecycle()} FROM ({client_activity("TRUE")}) WHERE enquiry_date > {FLOOR}""",
    "k3_activity_code_lifecycle_counts":
        f"SELECT {lifecycle()} FROM ({codes('TRUE')}) WHERE enquiry_date >= {FLOOR}",
    "k4_client_status_counts": status_counts("TRUE"),
    "k5_enquiry_growth": enquiry_growth("TRUE", 1),
    "k5_enquiry_growth_by_region": enquiry_growth("region_id = 2", 2),
    "k6_invoice_growth": invoice_growth("TRUE"),
    "k6_invoice_growth_sliced": invoice_growth(slice_sql(division=3, region=2, sector=2)),
    "k7_enquiry_share_by_division": enquiry_share("TRUE", True),
    "k7_enquiry_share_without_transfers": enquiry_share("TRUE", False),
    "k8_enquiry_by_sector": by_sector("e_registered", "amount", ACTIVE),
    "k8_enquiry_by_sector_wide": "SELECT " + ", ".join(
        f"{total('amount', f'client_type = {i} AND {ACTIVE}')} AS enquiry_{n}"
        for i, n in ((1, "industrial"), (2, "marine"), (3, "oilgas"), (6, "offshore"),
                     (10, "petrochemical"), (12, "renewable"))
    ) + " FROM e_registered",
    "k9_invoice_by_sector": by_sector(INVOICES, "net", INV_NOW),
    "k10_invoice_share_by_division": invoice_share("TRUE"),
    "k10_invoice_share_listed": invoice_share("TRUE").replace("division NOT IN (3, 225)", "division IN (10, 11)"),
    "k6_invoice_growth_job_window": in_job_window(invoice_growth("TRUE")),
    "k9_invoice_by_sector_job_window": in_job_window(by_sector(INVOICES, "net", INV_NOW)),
    "k11_idle_counts": f"""
        SELECT 'countries' AS entity,
               (SELECT COUNT(*) FROM ({idle_countries("enquiry_date", "TRUE", SLICE)})) AS idle_enquiry,
               (SELECT COUNT(*) FROM ({idle_countries("job_date", "TRUE", SLICE)})) AS idle_job
        UNION ALL SELECT 'clients',
               (SELECT COUNT(*) FROM ({idle_clients("enquiry_date", "TRUE", SLICE)})),
               (SELECT COUNT(*) FROM ({idle_clients("job_date", "TRUE", SLICE)}))""",
    "k12_safe_percent": f"""
        SELECT country_id, {percent("lost_enquiry_amount", "total_enquiry_amount")} AS lost_percent,
               CAST(0 AS DOUBLE) AS of_nothing, CAST(0 AS DOUBLE) AS of_null
        FROM ({country_rows(country_activity("TRUE"), "country_id IS NOT NULL", "TRUE")})""",
    "k13_kpi_metrics": metrics({}, True),
    "k13_kpi_metrics_sliced": metrics({"division": 3, "subdivision": 107}, False),
    "k13_kpi_board": board(metrics({}, True)),
    "k13_sliced_boards": sliced_boards(),
    "k2_client_counts_from_bitmaps": f"""
        SELECT division, country, region, sector, COLUMNS('client_(.*)') AS '\\1' FROM ({sliced_boards()})
        WHERE subdivision IS NULL AND (division IS NOT NULL)::INT + (country IS NOT NULL)::INT + (region IS NOT NULL)::INT + (sector IS NOT NULL)::INT <= 1
        AND EXISTS (SELECT 1 FROM keyed WHERE client_ref IS NOT NULL AND coalesce(keyed.division = division, TRUE)
            AND coalesce(country_id = country, TRUE) AND coalesce(region_id = region, TRUE) AND coalesce(client_type = sector, TRUE))""",
    "l8_listing_counts_from_bitmaps": " UNION ALL ".join(
        f"SELECT '{kind or 'every'}' AS kind, COUNT(*) AS entities FROM ({client_activity(DIVISION)}) WHERE {test}"
        for kind, test in SEGMENTS.items() if kind not in ("idle_enq", "idle_job")
    ),
    "k13_kpi_board_sliced": board(metrics({"country": 6, "sector": 2}, False)),
    "l1_country_listing": country_rows(country_activity("TRUE"), "country_id IS NOT NULL", "TRUE"),
    "l1_country_listing_sliced": country_rows(
        f"SELECT * FROM ({country_activity(DIVISION)}) WHERE {SEGMENTS['job_active']}",
        f"{DIVISION} AND enquiry_date BETWEEN {INACTIVE_FROM} AND {AS_OF}",
        f"{DIVISION} AND tran_date BETWEEN {INACTIVE_FROM} AND {AS_OF}",
    ),
    "l2_idle_country_listing": idle_country_rows("enquiry_date"),
    "l2_idle_country_listing_jobs": idle_country_rows("job_date"),
    "l3_client_listing": client_rows(client_activity("TRUE"), "TRUE", "TRUE"),
    "l3_client_listing_sliced": client_rows(
        f"SELECT * FROM ({client_activity(slice_sql(division=3, region=2))}) "
        f"WHERE {SEGMENTS['active_enq']}",
        f"{slice_sql(division=3, region=2)} AND {ACTIVE}",
        f"{slice_sql(division=3, region=2)} AND {INV_NOW}",
    ),
    "l4_idle_client_listing": idle_client_rows("enquiry_date", 3),
    "l4_idle_client_listing_jobs": idle_client_rows("job_date", 3),
    "l5_enquiry_status_by_country": rollup(
        "country_id, country_name, region_name", "country_id IS NOT NULL"
    ),
    "l5_enquiry_status_by_client": rollup("client_ref", "TRUE"),
    "l5_enquiry_status_by_client_sliced": rollup("client_ref", slice_sql(sector=2)),
    "l6_invoice_rollup_by_country": billed("country_id", "TRUE"),
    "l6_invoice_rollup_by_client": billed("client_ref", "TRUE"),
    "l6_invoice_rollup_by_client_sliced": billed(
        "client_ref", f"{DIVISION} AND tran_date BETWEEN {INACTIVE_FROM} AND {AS_OF}"
    ),
    "l7_sort_by_name": f"""
        SELECT e.country_id, e.lost_enquiry_count, i.total_invoice_count,
               ROW_NUMBER() OVER (ORDER BY e.lost_enquiry_count DESC NULLS LAST, e.country_id) AS place
        FROM ({rollup("country_id", "country_id IS NOT NULL")}) e
        LEFT JOIN ({billed("country_id", "TRUE")}) i ON e.country_id = i.country_id""",
    "l8_listing_count": f"""
        SELECT 'clients' AS listing, COUNT(*) AS entities FROM ({client_activity("TRUE")})
        WHERE {SEGMENTS["active_enq"]}
        UNION ALL SELECT 'countries', COUNT(*) FROM ({country_activity("TRUE")})
        WHERE {SEGMENTS["active_enq"]}""",
    "t1_top_clients_by_enquiry": f"""
        SELECT client_key AS client_id, client_name, country_name, region_name,
               {in_millions("SUM(amount)")} AS enquiry_amount
        FROM {PLACED_ENQUIRIES} WHERE client_ref IS NOT NULL
        GROUP BY client_ref, client_key, client_name, country_name, region_name
        ORDER BY SUM(amount) DESC, client_ref LIMIT 10""",
    "t1_top_clients_by_enquiry_sliced": f"""
        SELECT client_key AS client_id, client_name, country_name, region_name,
               {money("SUM(amount)")} AS enquiry_amount
        FROM {PLACED_ENQUIRIES} WHERE division = 3 AND region_id = 2
        GROUP BY client_ref, client_key, client_name, country_name, region_name
        ORDER BY SUM(amount) DESC, client_ref LIMIT 5""",
    "t2_enquiry_by_region_with_amounts": only_found(by_region(PLACED_ENQUIRIES, SLICE, "enquiry_amount")),
    "t3_enquiry_by_country_with_amounts": only_found(by_country(PLACED_ENQUIRIES, "TRUE", "enquiry_amount")),
    "t4_top_clients_by_invoice_job_window": in_job_window(f"""
        SELECT CAST(debtor_no AS VARCHAR) AS client_id, client_name, country_name, region_name,
               {in_millions("SUM(amount)")} AS invoice_amount
        FROM {PLACED_INVOICES} GROUP BY debtor_no, client_name, country_name, region_name
        ORDER BY SUM(amount) DESC, debtor_no LIMIT 10"""),
    "t5_invoice_by_region_with_amounts": only_found(by_region(PLACED_INVOICES, "country_id = 6", "invoice_amount")),
    "t6_invoice_by_country_with_amounts": only_found(by_country(PLACED_INVOICES, "TRUE", "invoice_amount")),
    "t6_invoice_by_country_job_window": in_job_window(by_country(PLACED_INVOICES, "TRUE", "invoice_amount")),
    "t2_enquiry_by_region": by_region(PLACED_ENQUIRIES, "TRUE", "enquiry_amount"),
    "t3_enquiry_by_country": by_country(PLACED_ENQUIRIES, "TRUE", "enquiry_amount"),
    "t3_enquiry_by_country_sliced": by_country(PLACED_ENQUIRIES, SLICE, "enquiry_amount"),
    "t4_top_clients_by_invoice": f"""
        SELECT CAST(debtor_no AS VARCHAR) AS client_id, client_name, country_name, region_name,
               {in_millions("SUM(amount)")} AS invoice_amount
        FROM {PLACED_INVOICES} GROUP BY debtor_no, client_name, country_name, region_name
        ORDER BY SUM(amount) DESC, debtor_no LIMIT 10""",
    "t5_invoice_by_region": by_region(PLACED_INVOICES, "TRUE", "invoice_amount"),
    "t5_invoice_by_region_sliced": by_region(PLACED_INVOICES, "country_id = 6", "invoice_amount"),
    "t6_invoice_by_country": by_country(PLACED_INVOICES, "TRUE", "invoice_amount"),
    "t7_client_invoice_totals": f"""
        SELECT debtor_no, client_name, country_name, region_name,
               {money("SUM(amount)")} AS invoice_amount,
               {money("SUM(total_expense_aed)")} AS total_expense
        FROM {PLACED_INVOICES} GROUP BY debtor_no, client_name, country_name, region_name""",
    "r1_outstanding_lines": f"""
        SELECT debtor_no, trans_no, client_name, status, company, division, subdivision,
               credit_period, {money("b6")} AS bal_6m, {money("b3")} AS bal_3m,
               {money("bt")} AS bal_total
        FROM ({OUTSTANDING})""",
    "r2_outstanding_by_client": BY_CLIENT,
    "r3_outstanding_with_total": f"""
        SELECT debtor_no, 0 AS is_total, client_name, status, company, credit_period, bal_6m,
               bal_3m, bal_total, division_text FROM ({BY_CLIENT})
        UNION ALL SELECT NULL, 1, NULL, NULL, NULL, NULL,
               {money("SUM(CAST(bal_6m AS DECIMAL(28,4)))")},
               {money("SUM(CAST(bal_3m AS DECIMAL(28,4)))")},
               {money("SUM(CAST(bal_total AS DECIMAL(28,4)))")}, NULL FROM ({BY_CLIENT})""",
    "r4_payment_job_latency": LATENCY,
    "r5_latency_buckets": f"""
        SELECT CASE WHEN months_diff < 6 THEN '3-6 months' WHEN months_diff <= 12 THEN '6-12 months'
                    ELSE 'over 12 months' END AS bucket, COUNT(*) AS n,
               MAX(months_diff) AS longest
        FROM ({LATENCY}) GROUP BY 1""",
    "r6_weekly_division_summary": weekly("g_enquiry", f"enquiry_date {LOSSES}"),
    "r6_weekly_division_summary_local": weekly(
        "g_resolved", f"enquiry_date {LOSSES} AND country_id = 1"
    ),
    "r6_last_eight_days": weekly("g_resolved", f"enquiry_date {WEEK} AND country_id = 1"),
    "r7_last_eight_days": top_subdivision("g_resolved", f"enquiry_date {WEEK} AND country_id = 1"),
    "r7_top_subdivision_per_group": top_subdivision("g_enquiry", f"enquiry_date {LOSSES}"),
    "r8_daily_enquiry_series": DAILY.format(source="g_enquiry", where="TRUE"),
    "r9_fill_calendar_gaps": f"""
        SELECT CAST(c.day AS DATE) AS enquiry_date, g.div_group,
               COALESCE(s.daily_count, 0) AS daily_count
        FROM range(DATE '2001-07-18', DATE '2001-08-02', INTERVAL 1 DAY) c(day)
        CROSS JOIN (VALUES ('I&M'), ('ONE'), ('Other')) g(div_group)
        LEFT JOIN ({DAILY.format(source="g_resolved", where="country_id = 1")}) s
            ON s.enquiry_date = c.day AND s.div_group = g.div_group""",
    "r10_idle_improvements": f"""
        WITH before AS (SELECT * FROM keyed WHERE enquiry_date <= {ACTIVE_FROM}),
        divisions AS (SELECT * FROM (VALUES (225), (3)) v(d)),
        idle_then AS (
            SELECT DISTINCT d AS division_id, client_ref FROM before h, divisions
            WHERE client_ref > 0 AND enquiry_date > {FLOOR} AND NOT EXISTS (
                SELECT 1 FROM before p WHERE p.client_ref = h.client_ref AND p.division = d
                AND p.enquiry_date > {FLOOR})),
        idle_now AS (
            SELECT DISTINCT d AS division_id, client_ref FROM keyed h, divisions
            WHERE client_ref > 0 AND enquiry_date > {FLOOR} AND NOT EXISTS (
                SELECT 1 FROM keyed p WHERE p.client_ref = h.client_ref AND p.division = d
                AND p.enquiry_date > {FLOOR}))
        SELECT t.division_id, t.client_ref, m.name AS client_name FROM idle_then t
        LEFT JOIN g_client m ON t.client_ref = m.debtor_no
        WHERE NOT EXISTS (SELECT 1 FROM idle_now n WHERE n.division_id = t.division_id
            AND n.client_ref = t.client_ref)""",
    "r11_idle_snapshot_all_divisions": " UNION ALL ".join(
        idle_client_rows("enquiry_date", d, f"{d} AS division_id,") for d in (225, 3)
    ),
    "r12_inactive_clients": inactive(AS_OF),
    "r13_recovered_clients": RECOVERED,
    "r14_bucket_by_division_group": f"""
        SELECT {group_name("division_id", "Non Marine")} AS div_group, debtor_no, client_name,
               MIN(status_id) AS status_id, MAX(last_job_date) AS last_job,
               MAX(last_enquiry_date) AS last_enq,
               COALESCE(MIN(current_credit_period), 0) AS credit_period,
               COALESCE(MIN(total_business), 0) AS biz,
               COALESCE(MIN(total_outstanding), 0) AS out
        FROM ({inactive(AS_OF)}) GROUP BY 1, 2, 3""",
    "r14_recovered_by_division_group": f"""
        SELECT *, {group_name("division_id", "Non Marine")} AS div_group FROM ({RECOVERED})""",
    "r15_lost_cancelled_enquiries": f"""
        SELECT * EXCLUDE (exact), {money("exact")} AS amount FROM ({LOST_ROWS})""",
    "r16_with_subtotals": f"""
        SELECT division_id, subdivision_name, 'subtotal' AS level, COUNT(*) AS enquiries,
               {money("SUM(exact)")} AS amount
        FROM ({LOST_ROWS}) GROUP BY 1, 2
        UNION ALL SELECT division_id, NULL, 'total', COUNT(*), {money("SUM(exact)")}
        FROM ({LOST_ROWS}) GROUP BY 1""",
    "r17_monthly_loss_trend": """
        SELECT strftime(enquiry_date, '%Y-%m') AS month, division,
               COUNT(*) FILTER (WHERE enq_status = 2) AS lost_count,
               COUNT(*) FILTER (WHERE enq_status = 1) AS cancel_count
        FROM g_enquiry WHERE division IN (3, 225) AND enquiry_date >= DATE '2001-05-04'
        GROUP BY 1, 2""",
    "r18_loss_trend_pivot": """
        SELECT strftime(enquiry_date, '%Y-%m') AS month,
               COUNT(*) FILTER (WHERE enq_status = 2 AND division = 225) AS "225_lost",
               COUNT(*) FILTER (WHERE enq_status = 1 AND division = 225) AS "225_cancel",
               COUNT(*) FILTER (WHERE enq_status = 2 AND division = 3) AS "3_lost",
               COUNT(*) FILTER (WHERE enq_status = 1 AND division = 3) AS "3_cancel"
        FROM g_enquiry WHERE division IN (3, 225) AND enquiry_date >= DATE '1995-11-04'
        GROUP BY 1""",
    "r19_monthly_revenue": JUNE,
    "r20_revenue_drop": f"""
        SELECT *, {percent("revenue_drop", "last_month_revenue")} AS drop_percent FROM (
            SELECT p.division, p.division_id, p.debtor_no, p.client_name,
                   p.revenue AS last_month_revenue,
                   COALESCE(c.revenue, 0) AS current_month_revenue,
                   {money("CAST(p.revenue AS DECIMAL(28,4)) - CAST(COALESCE(c.revenue, 0) AS DECIMAL(28,4))")}
                       AS revenue_drop,
                   {group_name("p.division_id")} AS div_group
            FROM ({JUNE}) p LEFT JOIN ({JULY}) c
                ON p.division_id = c.division_id AND p.debtor_no = c.debtor_no)
        WHERE revenue_drop > 1""",
    "r21_high_value_enquiries": f"""
        SELECT e.book_no, e.enquiry_date, d1.name AS company, d2.name AS division,
               d3.name AS subdivision,
               CASE WHEN e.debtor_no <> 0 AND e.branch_code <> 0 THEN m.name
                    WHEN e.enquiry_temp_id <> 0 THEN t.client_name ELSE 'Unknown' END AS client,
               c.name AS country,
               CASE e.enq_type WHEN 1 THEN 'Project' WHEN 2 THEN 'Annual Contract'
                    WHEN 3 THEN 'Shutdown' WHEN 4 THEN 'Callout' WHEN 5 THEN 'Tender'
                    ELSE 'Other' END AS enquiry_type,
               CASE e.enq_status WHEN 0 THEN 'Open' WHEN 1 THEN 'Cancel' WHEN 2 THEN 'Lost'
                    WHEN 3 THEN 'Transfer' WHEN 4 THEN 'Confirmed' WHEN 5 THEN 'BID Enquiry'
                    ELSE 'Other' END AS enquiry_status,
               {money(ENQ_VALUE)} AS amount
        FROM g_enquiry e LEFT JOIN g_client m ON e.debtor_no = m.debtor_no
        LEFT JOIN g_temp t ON e.enquiry_temp_id = t.temp_clients_id
        LEFT JOIN g_country c ON c.id = CASE WHEN e.debtor_no <> 0 AND e.branch_code <> 0
            THEN m.country ELSE TRY_CAST(NULLIF(t.country, '') AS INTEGER) END
        LEFT JOIN g_dimension d1 ON e.company = d1.id
        LEFT JOIN g_dimension d2 ON e.division = d2.id
        LEFT JOIN g_dimension d3 ON e.subdivision = d3.id
        WHERE {ENQ_VALUE} > {BIG} AND e.parent_id = 0 AND e.is_active = 1 AND e.enq_status <= 5""",
    "r22_numbered": f"""
        SELECT client_enquiry_id, division_id, subdivision_name, enquiry_date,
               ROW_NUMBER() OVER (PARTITION BY division_id, subdivision_name
                   ORDER BY enquiry_date, client_enquiry_id) AS no
        FROM ({LOST_ROWS})""",
    "r22_numbered_outstanding": f"""
        SELECT debtor_no, client_name, bal_6m,
               ROW_NUMBER() OVER (ORDER BY bal_6m DESC, debtor_no) AS no
        FROM ({BY_CLIENT})""",
    "r23_compact_amount": f"""
        SELECT subdivision, enq_status, {compact("amount")} AS amount_text,
               {compact("CAST(amount AS DECIMAL(28,4)) * 0.001")} AS thousands_text,
               {compact("small")} AS small_text
        FROM (SELECT subdivision, enq_status, SUM({ENQ_VALUE}) AS amount,
                     MAX(enq_status) AS small
              FROM g_enquiry GROUP BY 1, 2)""",
}


def _complete(sql: str) -> str:
    sql = sql.strip()
    if not sql.startswith("WITH "):
        return _with(sql)
    # a query with CTEs of its own: ours come first in the same list
    prefixed = _with(sql)
    head, tail = prefixed[: -len(sql)].rstrip(), sql[len("WITH "):]
    return f"{head}, {tail}" if head else sql


QUERIES["r20_revenue_drop_in_one_pass"] = QUERIES["r20_revenue_drop"]
QUERIES["s1_extract_declared"] = QUERIES["l1_country_listing"]
QUERIES["s6_idle_state_round_trip"] = QUERIES["r11_idle_snapshot_all_divisions"]
# Table -> its rows, their key and their day in the sample.
EXTRACTS = {
    "client": ("g_client", "debtor_no", None),
    "temp_client": ("g_temp", "temp_clients_id", None),
    "sales_order": ("g_orders", "k", "order_date"),
    "sales_order_reference": ("g_orders", "k", None),
    "payment_allocation": ("g_payment", "NULL", "date_alloc"),
    "client_status": ("g_status", "id", None),
    "client_type": ("g_sector", "id", None),
    "credit_period": ("g_credit", "debtor_no", None),
    "country": ("g_country", "id", None),
    "region": ("g_region", "id", None),
    "dimension": ("g_dimension", "id", None),
    "enquiry": ("g_enquiry", "client_enquiry_id", "enquiry_date"),
    "invoice": ("g_invoice", "trans_no", "tran_date"),
    "credit_note": (
        "(SELECT l_orderkey AS k, MAX(CAST(l_shipdate AS DATE)) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)", "k", "d"
    ),
    "client_activity": ("g_activity", "NULL", "enquiry_date"),
    "activity_code_activity": ("g_code_activity", "NULL", None),
    "job_activity": ("(SELECT p_partkey FROM part)", "p_partkey", None),
    "enquiry_job_activity": ("lineitem", "l_orderkey * 10 + l_linenumber", None),
}
QUERIES["s1_extract_all_tables"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS table_name, COUNT(*) AS rows, CAST(COALESCE(SUM({key}), 0) AS BIGINT) AS key_sum,
        CAST(MIN({day or 'NULL'}) AS DATE) AS first_day, CAST(MAX({day or 'NULL'}) AS DATE) AS last_day FROM {source}"""
    for name, (source, key, day) in EXTRACTS.items()
)
QUERIES["r10_idle_improvements_by_buckets"] = QUERIES["r10_idle_improvements"]
QUERIES["s7_update_tracking_by_buckets"] = QUERIES["s7_update_tracking"]
QUERIES["r19_monthly_revenue_bucketed"] = QUERIES["r19_monthly_revenue"]
QUERIES["r20_revenue_drop_bucketed"] = QUERIES["r20_revenue_drop"]

# Activity as it stands after the jobs of one year were written again, a month later each.
LATER = {
    name: f"SELECT * REPLACE (CASE WHEN YEAR(enquiry_date) = 1996 THEN job_date + 30 ELSE job_date END AS job_date) FROM ({CTES[name]})"
    for name in ("g_activity", "g_code_activity")
}
KEPT_UP = {
    "c4_country_activity_kept": "c4_country_activity",
    "c5_client_activity_kept": "c5_client_activity",
    "c6_activity_codes_kept": "c6_activity_code_summary",
    "c7_last_activity_by_division_kept": "c7_last_activity_by_division",
}

ORACLE = {name: _complete(sql) for name, sql in QUERIES.items()}
ORACLE |= {name: _with(QUERIES[of], LATER) for name, of in KEPT_UP.items()}
