"""The schedule model as views over the driver's tables: the same definitions in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.dates import MONTHS
from ..operators import store

#: The months' headings of a page's tables.
HEADS = "".join(f"<th>{m}</th>" for m in MONTHS)
#: View name -> SQL. SHA(...), TEXT, DATES(...) and HASHED(...) stand for what the two engines write differently.
VIEWS = {
    "v_locations": """
select c_custkey as id, r_name as seniunija, n_name as village, n_nationkey,
  case when c_custkey % 40 = 1 then concat('Gatve ', c_custkey) when n_nationkey % 3 = 0 and c_custkey % 5 = 0 then '' else c_mktsegment end as street,
  case when c_custkey % 3 = 0 then null else cast(c_custkey % 7 as TEXT) end as house_numbers,
  concat('k1_', substr(SHA(concat(n_name, '|', case when c_custkey % 40 = 1 then concat('Gatve ', c_custkey) when n_nationkey % 3 = 0 and c_custkey % 5 = 0 then '' else c_mktsegment end)), 1, 12)) as kaimai_hash
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "v_group_dates": """
select distinct l.kaimai_hash, cast(o_orderdate as date) as d,
  case when l.n_nationkey % 4 = 1 then case when o_orderkey % 2 = 0 then 'plastikas' else 'stiklas' end
  else case o_orderkey % 3 when 0 then 'bendros' when 1 then 'plastikas' else 'stiklas' end end as waste_type
from orders join v_locations l on l.id = o_custkey""",
    "v_groups": """
select concat('sg_', substr(SHA(concat(waste_type, ':', kaimai_hash)), 1, 12)) as id, kaimai_hash, waste_type, dates, iso,
  substr(SHA(iso), 1, 16) as dates_hash, first_date, last_date, date_count
from (select kaimai_hash, waste_type, DATES(d) as dates, ISO(d) as iso, min(d) as first_date, max(d) as last_date, count(*) as date_count from v_group_dates group by kaimai_hash, waste_type) g""",
    "v_pdf_rows": """
select l_orderkey * 10 + l_linenumber as id, r_name as seniunija, case when l_orderkey % 4 = 0 then null when l_orderkey % 9 = 5 then 'OTHER' else r_name end as mapped_seniunija,
  n_name as village, case when l_orderkey % 6 = 5 then concat(substr(n_name, 1, length(n_name) - 1), case when n_name like '%A' then 'E' when n_name like '%E' then 'A' else substr(n_name, length(n_name), 1) end) end as mapped_village,
  case when l_orderkey % 10 = 3 then concat('Gatve ', 1 + 40 * (l_partkey % 30)) when l_partkey % 4 = 0 then '' when l_partkey % 4 = 1 then null when l_partkey % 4 = 2 then 'BUILDING' else 'MACHINERY' end as street, cast(null as TEXT) as mapped_street,
  case l_orderkey % 4 when 0 then null when 1 then '' when 2 then 'ALL' else cast(l_partkey % 7 as TEXT) end as house_numbers,
  case when l_linenumber % 2 = 0 then 'plastikas' else 'stiklas' end as waste_type,
  concat('k1_', substr(SHA(concat(n_name, '|', case l_partkey % 4 when 2 then 'BUILDING' when 3 then 'MACHINERY' else '' end)), 1, 12)) as kaimai_hash,
  cast(l_shipdate as date) as d
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "v_streams": """
select concat('cs_', substr(SHA(concat(waste_type, '|', dates_hash, '|0')), 1, 12)) as id, waste_type, dates_hash, max(iso) as iso, min(first_date) as first_date, max(last_date) as last_date, max(date_count) as date_count,
  case when substr(dates_hash, 1, 1) < '6' then null else concat('cal_', dates_hash) end as calendar_id,
  case when substr(dates_hash, 1, 1) < 'b' then null else max(last_date) end as calendar_synced_at,
  case when substr(dates_hash, 2, 1) < '2' then max(last_date) end as pending_clean_started_at
from v_groups group by waste_type, dates_hash""",
    "v_links": """
select id as schedule_group_id, concat('cs_', substr(SHA(concat(waste_type, '|', dates_hash, '|0')), 1, 12)) as calendar_stream_id
from v_groups where substr(dates_hash, 3, 1) <> '7'""",
    "v_desired": """select distinct user_id as stream, cast(ts as date) as d from events where event_type in ('view', 'purchase', 'signup')""",
    "v_existing": """
select user_id as stream, cast(ts as date) as d, case when max(case when event_type = 'error' then 1 else 0 end) = 1 then 'error' else 'created' end as status
from events where event_type in ('click', 'error') group by user_id, cast(ts as date)""",
    # what arrives: sheets of months by rows, parses of cells by a model, logs of fetches, tables of pages
    "v_days": """select distinct o_custkey as k, month(o_orderdate) as m, day(o_orderdate) as n from orders""",
    "v_filled": """select k, m, DAYLIST(n) as txt from v_days group by k, m""",
    "v_paper": f"""
select concat('f', cast(floor(c_custkey / 50) as integer)) as file, c_custkey as row_no, case c_custkey % 4 when 0 then n_name when 1 then '' when 2 then '  ' else null end as seniunija,
  case c_custkey % 8 when 0 then concat('Vieta', c_custkey % 997) when 1 then concat(' Vieta', c_custkey % 997, ' (Aukso g., Beržo al.)') when 2 then concat('Vieta', c_custkey % 997, ' (Aukso g. nuo 1 iki 9)')
  when 3 then '   ' when 5 then concat('Vieta', c_custkey % 997, ', Aukso g.') when 6 then concat('Vieta', c_custkey % 997, ' (Ievų g., Liepų g. (nuo Nr. 2 iki 8), Klevų skg.)')
  when 7 then concat('Vieta', c_custkey % 997, ' (Uosių g. 5, 7)') else null end as kaimai,
  {", ".join(f"max(case when m = {k} then txt end) as m{k}" for k in range(1, 13))}
from customer join nation on c_nationkey = n_nationkey left join v_filled on k = c_custkey group by c_custkey, n_name""",
    "v_parses": """
select substr(SHA(trim(kaimai)), 1, 16) as key, max(case row_no % 997 % 5
  when 0 then concat('{"village": "Vieta', row_no % 997, '", "streets": [{"street": "Aukso g.", "house_numbers": "nuo 1 iki 9"}]}')
  when 1 then concat('```json\n{"village": " Vieta', row_no % 997, '", "streets": [{"street": "Aukso g. ", "house_numbers": "1 iki 9"}]}\n```')
  when 2 then '{"village": " ", "streets": []}'
  when 3 then concat('[{"village": "Vieta', row_no % 997, '", "streets": []}]')
  else concat('{"village": "Vieta', row_no % 997, '", "streets": [{"street": "Aukso g.", "house_numbers": "x"}]}') end) as parsed_result
from v_paper where row_no % 8 in (2, 5, 6, 7) and row_no % 11 <> 0 group by trim(kaimai)""",
    "v_arrived": """
select c_custkey as item, case c_custkey % 11 when 0 then '' when 1 then ' ' else n_name end as seniunija,
  case c_custkey % 7 when 0 then '' when 1 then 'Vieta (Aukso g.' when 2 then 'Aukso g. Beržo g.' when 3 then 'Vieta, Aukso g.' when 4 then '(Vieta, Aukso g' else 'Vieta' end as village,
  case when c_custkey % 13 = 0 then null else '' end as street, o.dates
from customer join nation on c_nationkey = n_nationkey left join (select k, DATES(d) as dates from (select distinct o_custkey as k, cast(o_orderdate as date) as d from orders) x group by k) o on o.k = c_custkey""",
    "v_log": """
select event_id as id, case when event_type in ('view', 'click') then 'xlsx' else 'pdf' end as kind, concat('u', user_id) as source_url, case when event_id % 3 = 0 then null else concat('e', event_id % 2) end as etag,
  cast(cast(ts as date) as TEXT) as last_modified, event_id % 5 as content_length, concat('h', event_id % 4) as content_hash, case event_id % 4 when 0 then 'failed' when 1 then 'seeded' else 'success' end as status, ts as created_at
from events""",
    "v_offered": """
select kind, source_url, case when count(*) % 3 = 0 then '' else concat('e', count(*) % 2) end as etag, max(last_modified) as last_modified, max(id) % 5 as content_length, concat('h', count(*) % 4) as content_hash
from v_log group by kind, source_url""",
    "v_named": """
select 'village' as category, n_name as source_value, concat(n_name, ' k.') as target_value, 'rule' as mapping_method from nation where n_nationkey % 2 = 0
union all select 'seniunija', r_name, lower(r_name), 'rule' from region where r_regionkey % 2 = 1
union all select 'street', 'BUILDING', 'Building g.', 'model' from region where r_regionkey = 0""",
    "v_outside": """
select concat('cal_', dates_hash) as calendar_id, concat('Atliekos - ', waste_type, case when substr(dates_hash, 1, 1) < '8' then ' - grafikas' else '' end) as summary from v_groups group by dates_hash, waste_type""",
    "v_changed": """
select id, waste_type, kaimai_hash, case when substr(id, 5, 1) < '4' then substr(SHA(cast(first_date as TEXT)), 1, 16) else dates_hash end as dates_hash,
  case when substr(id, 5, 1) < '4' then LISTOF(first_date) else dates end as dates, first_date, case when substr(id, 5, 1) < '4' then first_date else last_date end as last_date, case when substr(id, 5, 1) < '4' then 1 else date_count end as date_count
from v_groups""",
    "v_pages": f"""
select doc, concat('<p>Grafikas</p><table><tr><th>Seniūnijos pavadinimas</th><th>Atliekos</th>{HEADS}</tr>', JOINEDX, '</table>') as html from (
select cast(floor(c_custkey / 20) as integer) as doc, c_custkey as k, concat(
  case c_custkey % 20 when 7 then '<tr><th>Seniūnijos<br>pavadinimas</th><th>Atliekos</th>{HEADS}</tr>'
  when 13 then '<tr><th>Gyvenvietės pavadinimas</th><th rowspan="2">Atliekos</th><th colspan="12"></th></tr><tr><td></td>{HEADS.replace("th>", "td>")}</tr>' else '' end,
  '<tr><td> ', n_name, ' k. ', c_custkey, '</td><td>', case c_custkey % 3 when 0 then 'Pakuotė' when 1 then 'Stiklas' else '' end, '</td>',
  {", ".join(f"'<td>', coalesce(max(case when m = {k} then txt end), ''), '</td>'" for k in range(1, 13))}, '</tr>', case c_custkey % 20 when 19 then '<tr><td colspan="14">Parengė : skyrius</td></tr>' else '' end) as x
from customer join nation on c_nationkey = n_nationkey left join v_filled on k = c_custkey group by c_custkey, n_name) t group by doc""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def spark_sql(sql: str) -> str:
    return sql.replace("SHA(", "sha2x(").replace("TEXT", "string").replace("DATES(d)", "array_sort(collect_list(d))").replace("ISO(d)", "array_join(array_sort(collect_list(cast(d as string))), ',')").replace("DAYLIST(n)", "array_join(transform(array_sort(collect_list(n)), v -> concat(v, ' d.')), ', ')").replace("LISTOF(", "array(").replace("JOINEDX", "array_join(transform(array_sort(collect_list(struct(k, x))), s -> s.x), '')")


def duck_sql(sql: str) -> str:
    return sql.replace("SHA(", "sha256(").replace("TEXT", "varchar").replace("DATES(d)", "list(d order by d)").replace("ISO(d)", "string_agg(cast(d as varchar), ',' order by d)").replace("DAYLIST(n)", "string_agg(concat(n, ' d.'), ', ' order by n)").replace("LISTOF(", "list_value(").replace("JOINEDX", "string_agg(x, '' order by k)")


class Views(dict):
    """Tables and views of a folder by name, each planned once, when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in TABLES:
            self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        else:
            body = spark_sql(VIEWS[name]).replace("{", "{{").replace("}", "}}")
            used = {k: self[k] for k in (*TABLES, *VIEWS) if re.search(rf"\b(from|join) {k}\b", body)}
            self[name] = self.spark.sql(with_bits(body, used), **used)
        return self[name]


    def once(self, *names: str) -> "Views":
        """Computes views once and writes them down, for queries that read them, or views made from them, in several places."""
        for name in names:
            self[name] = store.written(self[name])
        return self


def views(spark: SparkSession, sf_dir: str) -> Views:
    """The views as DataFrames; nothing is registered, so queries over different folders don't meet."""
    return Views(spark, sf_dir)


def with_bits(body: str, used: dict) -> str:
    """Writes sha2x(x) as sha2(x, 256), and table names as parameters of the statement."""
    out, i = [], 0
    while (at := body.find("sha2x(", i)) >= 0:
        out.append(body[i:at] + "sha2(")
        depth, j = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(body[j], 0)
            j += 1
        out.append(with_bits(body[at + 6 : j - 1], {}) + ", 256)")
        i = j
    body = "".join([*out, body[i:]])
    for name in used:
        body = re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", body)
    return body


def oracle(sql: str) -> str:
    """DuckDB SQL over the views that it names, as one statement."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name in text and name not in needed:
                need(VIEWS[name])
                needed.append(name)

    need(sql)
    ctes = ", ".join(f"{n} as ({duck_sql(VIEWS[n])})" for n in VIEWS if n in needed)
    sql = duck_sql(sql).strip()
    if not ctes:
        return sql
    if sql.lower().startswith("with "):
        return f"with {ctes}, {sql[5:]}"
    return f"with {ctes} {sql}"
