"""The survey tables of `fieldtally.sources.star`, written in plain SQL.

The counterparts label rows first and aggregate after, unlike the Spark reports.
"""

from __future__ import annotations

from fieldtally import domains as D


def texts(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def group_of(code: str) -> str:
    return f"CASE WHEN ltrim({code}, '0') IN ({texts(D.MARINE_CODES)}) THEN 'Marine' ELSE 'Inland' END"


def calendar(date: str) -> str:
    return f"""CAST({date} AS DATE) AS date,
        CAST(year({date}) AS INTEGER) AS year, CAST(month({date}) AS INTEGER) AS month,
        'Q' || quarter({date}) AS quarter,
        'Week' || CAST(ceil(day({date}) / 7.0) AS INTEGER) AS week"""


def _area(flag: str, fresh: str) -> str:
    return f"CASE WHEN {flag} = '{fresh}' THEN '1' ELSE '2' END"


TYPE_ANSWER = """CASE l_linenumber WHEN 1 THEN 'pond' WHEN 2 THEN 'Ponds_batch'
    WHEN 3 THEN 'plastic-soung' WHEN 4 THEN ' batches  Pond ' WHEN 5 THEN 'other'
    WHEN 6 THEN '' END"""
SPECIES_CODE = """CASE WHEN l_returnflag = 'R' THEN 'FM' || lpad(CAST(l_partkey % 100 AS VARCHAR), 3, '0')
    ELSE CAST(l_partkey % 100 AS VARCHAR) END"""

table_sql = {
    "provinces": f"""SELECT CAST(n_nationkey + 1 AS VARCHAR) AS code,
        list_extract([{texts(D.PROVINCES)}], n_nationkey + 1) AS province_kh, n_name AS province_en
        FROM nation""",
    "fish": """SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS fish_name_kh,
        upper(p_name) AS fish_name_en FROM part WHERE p_size <> 50""",
    "kinds": """SELECT CAST(r_regionkey AS VARCHAR) AS code, lower(r_name) AS proc_name_kh,
        r_name AS proc_name_en FROM region""",
    "areas": """SELECT * FROM (VALUES ('1', 'ទឹកសាប', 'Inland Fresh'), ('2', 'សមុទ្រ', 'Marine'))
        AS t(code, area_kh, area_en)""",
    "capture0": f"""SELECT l_orderkey AS id, l_linenumber AS pos, {calendar('l_shipdate')},
        CAST(l_suppkey % 26 AS VARCHAR) AS province, (l_quantity - 3) / 2 AS catch,
        {_area('l_linestatus', 'O')} AS area_code,
        CASE l_returnflag WHEN 'R' THEN '1' WHEN 'A' THEN '2' ELSE '3' END AS fishing_type,
        CAST(l_partkey AS VARCHAR) AS fish_code FROM lineitem""",
    "aqu0": f"""SELECT l_orderkey AS id, l_linenumber AS pos, {calendar('l_shipdate')},
        CAST(l_suppkey % 26 AS VARCHAR) AS province, l_quantity / 2 - 1 AS catch,
        {_area('l_linestatus', 'O')} AS area_code, {TYPE_ANSWER} AS aqu_type,
        {SPECIES_CODE} AS fish_code FROM lineitem""",
    "processing0": f"""SELECT o_orderkey AS id, 0 AS pos, {calendar('o_orderdate')},
        CAST(o_custkey % 26 AS VARCHAR) AS province, o_totalprice AS processing_amount,
        substr(o_orderpriority, 1, 1) AS proc_code, {_area('o_orderstatus', 'F')} AS area_code
        FROM orders""",
    "patrol0": f"""SELECT event_id AS id, 0 AS pos, {calendar('ts')},
        CAST(user_id % 26 AS VARCHAR) AS province, value AS patrol_amountcrime,
        CAST(k // 10 AS VARCHAR) || ' ' || CAST(k % 10 AS VARCHAR) AS patrol_enforcement
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
}


def _labelled(base: str, *lists: str) -> str:
    """Label columns by left joins where NULL matches NULL."""
    columns = {
        "provinces": ("province", "coalesce(p.province_kh, t.province) AS province_kh, "
                      "coalesce(p.province_en, t.province) AS province_en"),
        "fish": ("fish_code", "coalesce(f.fish_name_kh, t.fish_code) AS fish_name_kh, "
                 "coalesce(f.fish_name_en, t.fish_code) AS fish_name_en"),
        "areas": ("area_code", "a.area_kh, coalesce(a.area_en, t.area_code) AS area_en"),
        "kinds": ("proc_code", "coalesce(k.proc_name_kh, t.proc_code) AS proc_name_kh, "
                  "coalesce(k.proc_name_en, t.proc_code) AS proc_name_en"),
    }
    shown = ", ".join(columns[name][1] for name in lists)
    joins = " ".join(
        f"LEFT JOIN {name} {name[0]} ON t.{columns[name][0]} IS NOT DISTINCT FROM {name[0]}.code"
        for name in lists
    )
    return f"SELECT t.*, {group_of('t.province')} AS province_group, {shown} FROM {base} t {joins}"


table_sql["capture"] = _labelled("capture0", "provinces", "fish", "areas")
table_sql["aqu"] = _labelled("aqu0", "provinces", "areas")
table_sql["aquf"] = _labelled("aqu0", "provinces", "fish", "areas")
table_sql["processing"] = _labelled("processing0", "provinces", "areas", "kinds")
table_sql["patrol"] = _labelled("patrol0", "provinces")
table_sql["subs"] = f"""SELECT l_orderkey * 8 + l_linenumber AS id, l_linenumber AS line,
    strftime(l_shipdate, '%Y-%m-%d') AS date,
    CASE WHEN l_linenumber = 2 THEN CASE WHEN l_suppkey % 26 < 10 THEN '0' ELSE '' END ELSE '' END
        || CAST(l_suppkey % 26 AS VARCHAR) AS province,
    CASE WHEN l_linenumber = 3 THEN 'none' ELSE CAST(l_linenumber AS VARCHAR) END AS inspectorate,
    CASE l_linenumber WHEN 4 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 5 THEN 'unknown'
        ELSE strftime(l_shipdate, '%Y-%m-%d') || 'T08:30:05' END AS submission_time,
    CAST((l_quantity - 3) / 2 AS VARCHAR) AS caught, {_area('l_linestatus', 'O')} AS area,
    translate(l_returnflag, 'RAN', '123') AS kind, CAST(l_partkey AS VARCHAR) AS part,
    CAST(l_partkey % 10 AS VARCHAR) || ' ' || CAST(l_linenumber AS VARCHAR) AS codes,
    {TYPE_ANSWER} AS aqu_type, lower(l_linestatus) AS validation_label,
    l_returnflag || ',' || l_linestatus AS tags,
    l_partkey, l_quantity FROM lineitem"""
_NEEDS = {
    "capture": ("provinces", "fish", "areas", "capture0"),
    "aqu": ("provinces", "areas", "aqu0"),
    "aquf": ("provinces", "fish", "areas", "aqu0"),
    "processing": ("provinces", "areas", "kinds", "processing0"),
    "patrol": ("provinces", "patrol0"),
}


def with_tables(body: str, *names: str, **more: str) -> str:
    """A query on survey tables: ``names`` from above, ``more`` given as SQL, in that order."""
    wanted = dict.fromkeys(n for name in names for n in (*_NEEDS.get(name, ()), name))
    parts = [f"{n} AS ({table_sql[n]})" for n in wanted] + [f"{n} AS ({q})" for n, q in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
