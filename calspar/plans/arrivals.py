"""The registered queries of what arrives and of what is written, with their SQL oracles, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import MONTHS
from ..operators import ingest, lookup, mapping, sections, store, streams, sync
from ..sources.html import html_tables
from . import domain

NOW = "2026-01-01"
VILLAGE = "concat('Vieta', row_no % 997)"
#: Dates of a sheet's row, and the rows that have a district above them and a date.
DATED = """dated as (
select k, string_agg(cast(d as varchar), ',' order by d) as iso from (select k, try_cast(concat('2026-', lpad(cast(m as varchar), 2, '0'), '-', lpad(cast(n as varchar), 2, '0')) as date) as d from v_days) x where d is not null group by k
), filled as (
select p.*, last_value(nullif(trim(seniunija), '') ignore nulls) over (partition by file order by row_no rows between unbounded preceding and current row) as above from v_paper p
), usable as (select file, row_no, above as seniunija, iso, row_no % 8 as form, row_no % 997 % 5 as kind from filled join dated on k = row_no where above is not null)"""


def paper(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = domain.views(spark, sf_dir)
    rows = v["v_paper"].select("file", F.col("row_no").alias("row"), "seniunija", "kaimai", *[F.col(f"m{k + 1}").alias(m) for k, m in enumerate(MONTHS)])
    return rows, v["v_parses"]


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("file", "row", "seniunija", "village", "street", "house_numbers", F.array_join(F.col("dates").cast("array<string>"), ",").alias("iso"))


def sheet_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules of all sheets' rows by the rules alone."""
    return shown(ingest.sheet_schedules(paper(spark, sf_dir)[0], MONTHS))


def sheet_schedules_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules of all sheets' rows, hard cells answered by the parses known."""
    rows, parses = paper(spark, sf_dir)
    return shown(ingest.sheet_schedules(rows, MONTHS, cache=parses))


def row_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.issues(domain.views(spark, sf_dir)["v_arrived"], "item")


def source_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.views(spark, sf_dir)
    return ingest.source_plan(v["v_offered"], v["v_log"])


def latest_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_fetches(domain.views(spark, sf_dir)["v_log"]).select("kind", "source_url", "id", "etag", "content_hash", "status")


def table_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules from all pages' tables: headings, sections, labels and rows that run on."""
    found = sections.table_schedules(html_tables(domain.views(spark, sf_dir)["v_pages"], "doc", "html"))
    return found.select("doc", "section", "location", "waste_type", F.array_join(F.col("dates").cast("array<string>"), ",").alias("iso"), "error")


def group_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.views(spark, sf_dir)
    return lookup.group_links(v["v_links"], v["v_streams"])


def schedule_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group's answer as one JSON text."""
    v = domain.views(spark, sf_dir)
    return lookup.schedule_json(v["v_groups"], v["v_locations"])


def month_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of days by months, as the CSV export has them."""
    names = F.array(*map(F.lit, MONTHS))
    rows = domain.views(spark, sf_dir)["v_pdf_rows"].select("kaimai_hash", "waste_type", F.get(names, F.month("d") - 1).alias("month"), F.dayofmonth("d").alias("day")).distinct()
    days = rows.groupBy("kaimai_hash", "waste_type", "month").agg(F.collect_list("day").alias("days"))
    return store.month_export(days, ["kaimai_hash", "waste_type"])


def available_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.available_calendars(domain.views(spark, sf_dir)["v_outside"], ["Atliekos", "grafikas"])


def orphan_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.views(spark, sf_dir)
    return streams.orphan_calendars(v["v_outside"], v["v_streams"])


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.subscriptions(domain.views(spark, sf_dir)["v_streams"], "https://calendar.example/render?cid=").select("id", "link")


def mapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.views(spark, sf_dir)
    rows = v["v_pdf_rows"].select("id", "seniunija", "village", "street")
    return mapping.apply(rows, v["v_named"]).select("id", "mapped_seniunija", "mapped_village", "mapped_street", "mapping_method")


def unmapped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.views(spark, sf_dir)
    return mapping.unmapped(v["v_pdf_rows"], v["v_named"])


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once the plan was carried out, with every third action failing."""
    v = domain.views(spark, sf_dir)
    todo = sync.plan(v["v_desired"], v["v_existing"])
    ok = (F.col("stream") + F.dayofmonth("d")) % 3 != 0
    results = todo.select("*", ok.alias("ok"), F.concat("stream", F.lit("/"), "d").alias("event_id"), F.lit("no answer").alias("error_message"))
    return sync.apply_results(v["v_existing"], results, F.lit(NOW).cast("timestamp")).select("stream", "d", "status", "event_id", "error_message")


def upsert_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups once their dates have changed: those of another pattern lose their sync time."""
    v = domain.views(spark, sf_dir)
    old = v["v_groups"].drop("iso").withColumns({"calendar_synced_at": F.to_timestamp("last_date"), "created_at": F.to_timestamp("first_date"), "updated_at": F.to_timestamp("first_date")})
    out = store.upsert_groups(old, v["v_changed"], F.lit(NOW).cast("timestamp"))
    return out.select("id", "dates_hash", "date_count", F.col("calendar_synced_at").isNotNull().alias("synced"), (F.col("updated_at") == F.lit(NOW).cast("timestamp")).alias("updated"))


def reconciled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = domain.views(spark, sf_dir).once("v_groups", "v_changed")
    none, marked = F.lit(None).cast("timestamp"), F.to_timestamp("pending_clean_started_at")
    held = v["v_streams"].select(
        "id", *streams.PATTERN, F.split("iso", ",").cast("array<date>").alias("dates"), "first_date", "last_date", "date_count", "calendar_id", F.to_timestamp("calendar_synced_at").alias("calendar_synced_at"),
        marked.alias("pending_clean_started_at"), (marked + F.expr("interval 4 days")).alias("pending_clean_until"), none.alias("pending_clean_notice_sent_at"), F.to_timestamp("first_date").alias("created_at"), F.to_timestamp("first_date").alias("updated_at"),
    )
    return streams.reconcile(held, v["v_links"], v["v_changed"], F.lit(NOW).cast("timestamp"))


def reconcile_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reconciled(spark, sf_dir)[0]
    return out.select("id", "waste_type", "dates_hash", "first_date", F.col("date_count").cast("long").alias("date_count"), "calendar_id", F.col("calendar_synced_at").isNotNull().alias("synced"), F.col("pending_clean_started_at").isNotNull().alias("leaving"))


def reconcile_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled(spark, sf_dir)[1]


#: Streams taken over, split, left and made once the groups' dates have changed.
RECONCILED = """linked as (
select l.schedule_group_id, l.calendar_stream_id as sid, g.waste_type, g.dates_hash, g.first_date, g.date_count from v_links l join v_changed g on g.id = l.schedule_group_id
), shape as (
select sid, count(distinct dates_hash) as patterns, min(dates_hash) as h, min(first_date) as f, min(date_count) as n from linked group by sid
), moved as (
select s.id, s.waste_type, case when patterns = 1 then h else s.dates_hash end as dates_hash, case when patterns = 1 then f else s.first_date end as first_date, case when patterns = 1 then n else s.date_count end as date_count, s.calendar_id,
  s.calendar_synced_at is not null and not (coalesce(patterns, 0) = 1 and h <> s.dates_hash) as synced, case when patterns = 1 then false when patterns > 1 then true else true end as leaving, s.first_date as created_at
from v_streams s left join shape on sid = s.id
), going as (select k.* from linked k join shape using (sid) where patterns > 1
), open as (select waste_type, dates_hash, arg_min(id, (created_at, id)) as stream_id from moved where not leaving and dates_hash <> '' group by 1, 2
), made as (
select concat('cs_', substr(sha256(concat(waste_type, '|', dates_hash, '|', coalesce(g, 0))), 1, 12)) as id, waste_type, dates_hash, first_date, date_count from (
  select waste_type, dates_hash, min(first_date) as first_date, min(date_count) as date_count from going where dates_hash <> '' group by 1, 2) p
left join (select waste_type, dates_hash, count(*) as g from moved group by 1, 2) c using (waste_type, dates_hash) where not exists (select 1 from open o where o.waste_type = p.waste_type and o.dates_hash = p.dates_hash))"""

#: Rows of pages' tables, with the customer that each comes from.
TABLES = """base as (
select c_custkey as k, cast(floor(c_custkey / 20) as integer) as doc, 1 + (case when c_custkey % 20 >= 7 then 1 else 0 end) + (case when c_custkey % 20 >= 13 then 1 else 0 end) as section,
  concat(n_name, ' k. ', c_custkey) as location, case c_custkey % 3 when 0 then 'plastikas' when 1 then 'stiklas' end as own, (select count(*) from v_days where k = c_custkey) = 0 as blank,
  (select string_agg(cast(d as varchar), ',' order by d) from (select try_cast(concat('2026-', lpad(cast(m as varchar), 2, '0'), '-', lpad(cast(n as varchar), 2, '0')) as date) as d from v_days where k = c_custkey) x where d is not null) as iso
from customer join nation on c_nationkey = n_nationkey
), lined as (
select *, last_value(own ignore nulls) over w as waste_type, lead(blank) over (partition by doc, section order by k) as next_blank, lag(blank) over (partition by doc, section order by k) as last_blank,
  lead(location) over (partition by doc, section order by k) as next_location, lead(iso) over (partition by doc, section order by k) as next_iso
from base window w as (partition by doc, section order by k rows between unbounded preceding and current row)), placed as (
select k, doc, section, case when blank and not next_blank then concat(location, ' ', next_location) else location end as location, coalesce(waste_type, 'bendros') as waste_type,
  coalesce(case when blank and not next_blank then next_iso else iso end, '') as iso, case when blank and coalesce(next_blank, true) then 'no month values' end as error
from lined where not (not blank and coalesce(last_blank, false)))"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "sheet_schedules": (sheet_schedules, f"""
with {DATED} select file, row_no as row, seniunija, {VILLAGE} as village, unnest(case form when 0 then [''] else ['Aukso g.', 'Beržo al.'] end) as street, cast(null as varchar) as house_numbers, iso from usable where form in (0, 1)"""),
    "sheet_schedules_cached": (sheet_schedules_cached, f"""
with {DATED}, answered as (select *, case when form in (2, 5, 6, 7) and row_no % 11 <> 0 and kind in (0, 1, 3) then kind end as known from usable
), spread as (
select *, unnest(case when form = 0 or known = 3 then [{{'s': '', 'h': null}}] when form = 1 then [{{'s': 'Aukso g.', 'h': null}}, {{'s': 'Beržo al.', 'h': null}}]
  when known = 0 then [{{'s': 'Aukso g.', 'h': '1-9'}}] when known = 1 then [{{'s': 'Aukso g.', 'h': '1-9'}}]
  when form = 2 then [{{'s': 'Aukso g.', 'h': 'nuo 1 iki 9'}}] when form = 6 then [{{'s': 'Ievų g.', 'h': null}}, {{'s': 'Liepų g.', 'h': 'nuo Nr. 2 iki 8'}}, {{'s': 'Klevų skg.', 'h': null}}]
  when form = 7 then [{{'s': 'Uosių g.', 'h': '5'}}, {{'s': '7', 'h': null}}] else [] end) as x from answered where form not in (3, 4))
select file, row_no as row, seniunija, {VILLAGE} as village, x.s as street, x.h as house_numbers, iso from spread"""),
    "row_issues": (row_issues, """
with found as (select item, unnest([case when trim(seniunija) = '' then 'empty seniunija' end, case when village = '' then 'empty village' when item % 7 in (1, 2, 3) then 'invalid village format' end,
  case when street is null then 'missing required key: street' end, case when dates is null then 'no pickup dates' end]) as issue from v_arrived)
select item, issue, issue <> 'no pickup dates' as critical from found where issue is not null"""),
    "source_plan": (source_plan, """
with last as (select * from (select *, row_number() over (partition by kind, source_url order by created_at desc, id desc) as rn from v_log where status in ('success', 'seeded')) t where rn = 1)
select o.kind, o.source_url, case when o.etag <> '' and o.etag = l.etag or o.last_modified = l.last_modified and o.content_length = l.content_length then 'unchanged'
  when exists (select 1 from v_log p where p.kind = o.kind and p.source_url = o.source_url and p.content_hash = o.content_hash and p.status = 'success') then 'parsed' else 'fetch' end as action
from v_offered o left join last l on l.kind = o.kind and l.source_url = o.source_url"""),
    "latest_fetches": (latest_fetches, """
select kind, source_url, id, etag, content_hash, status from (select *, row_number() over (partition by kind, source_url order by created_at desc, id desc) as rn from v_log where status in ('success', 'seeded')) t where rn = 1"""),
    "table_schedules": (table_schedules, f"with {TABLES} select doc, section, location, waste_type, iso, error from placed"),
    "group_links": (group_links, "select l.schedule_group_id, s.id, s.waste_type, s.dates_hash, s.date_count, s.calendar_id from v_links l join v_streams s on s.id = l.calendar_stream_id"),
    "schedule_json": (schedule_json, """
select g.id, cast(to_json(struct_pack(schedule_group_id := g.id, waste_type := g.waste_type, dates := g.dates, locations := coalesce(p.l, []))) as varchar) as body from v_groups g
left join (select kaimai_hash, list(struct_pack(id := id, seniunija := seniunija, village := village, street := street, house_numbers := house_numbers) order by id) as l from v_locations group by kaimai_hash) p using (kaimai_hash)"""),
    "month_table": (month_table, "with d as (select distinct kaimai_hash, waste_type, month(d) as m, day(d) as n from v_pdf_rows) select kaimai_hash, waste_type, "
        + ", ".join(f"""string_agg(concat(n, ' d.'), ', ' order by n) filter (m = {k + 1}) as "{m}" """ for k, m in enumerate(MONTHS)) + " from d group by kaimai_hash, waste_type"),
    "available_calendars": (available_calendars, "select calendar_id, summary from v_outside where contains(summary, 'Atliekos') and contains(summary, 'grafikas')"),
    "orphan_calendars": (orphan_calendars, "select calendar_id, summary from v_outside o where not exists (select 1 from v_streams s where s.calendar_id = o.calendar_id)"),
    "subscriptions": (subscriptions, "select id, concat('https://calendar.example/render?cid=', calendar_id) as link from v_streams where calendar_id is not null"),
    "mapped_rows": (mapped_rows, """
select p.id, coalesce(a.target_value, p.seniunija) as mapped_seniunija, coalesce(b.target_value, p.village) as mapped_village, coalesce(c.target_value, p.street) as mapped_street, coalesce(b.mapping_method, 'none') as mapping_method
from v_pdf_rows p left join v_named a on a.category = 'seniunija' and a.source_value = p.seniunija left join v_named b on b.category = 'village' and b.source_value = p.village left join v_named c on c.category = 'street' and c.source_value = p.street"""),
    "unmapped_names": (unmapped_names, """
with n as (select 'seniunija' as category, seniunija as source_value from v_pdf_rows union select 'village', village from v_pdf_rows union select 'street', street from v_pdf_rows)
select * from n where source_value <> '' and not exists (select 1 from v_named m where m.category = n.category and m.source_value = n.source_value)"""),
    "event_states": (event_states, """
with live as (select distinct stream from v_desired), todo as (
select coalesce(w.stream, e.stream) as stream, coalesce(w.d, e.d) as d, case when w.stream is null then 'delete' when e.status is null then 'add' when e.status = 'error' then 'retry' end as action
from v_desired w full join v_existing e on w.stream = e.stream and w.d = e.d where coalesce(w.stream, e.stream) in (select stream from live))
select stream, d, status, cast(null as varchar) as event_id, cast(null as varchar) as error_message from v_existing e where not exists (select 1 from todo t where t.stream = e.stream and t.d = e.d and action is not null)
union all select stream, d, case when (stream + day(d)) % 3 <> 0 then 'created' else 'error' end, case when (stream + day(d)) % 3 <> 0 then concat(stream, '/', d) end, case when (stream + day(d)) % 3 = 0 then 'no answer' end from todo where action in ('add', 'retry')"""),
    "upsert_groups": (upsert_groups, """
select n.id, n.dates_hash, cast(n.date_count as bigint) as date_count, o.dates_hash = n.dates_hash as synced, o.dates_hash <> n.dates_hash as updated from v_changed n join v_groups o using (id)"""),
    "reconcile_streams": (reconcile_streams, f"""
with {RECONCILED} select id, waste_type, dates_hash, first_date, date_count, calendar_id, synced, leaving from moved
union all select id, waste_type, dates_hash, first_date, date_count, null, false, false from made"""),
    "reconcile_links": (reconcile_links, f"""
with {RECONCILED} select schedule_group_id, calendar_stream_id from v_links where schedule_group_id not in (select schedule_group_id from going)
union all select g.schedule_group_id, e.stream_id from going g join (select waste_type, dates_hash, stream_id from open union all select waste_type, dates_hash, id from made) e using (waste_type, dates_hash)"""),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: domain.oracle(sql) for name, (_, sql) in QUERIES.items()}
