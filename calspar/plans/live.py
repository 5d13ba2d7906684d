"""The registered queries of what runs in steps: streams over several runs and what they leave, with their SQL oracles.

Each writes what arrives, as Spark derives it from the tables, into a folder of its own in the shared one, and lets
streams take it in several runs, as a worker that is started again and again would.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.dates import MONTHS
from ..operators import answers, incremental, ingest, outbox, places, requests, schemas, sections, store, streams
from ..sources import changed, xlsx
from ..sources.html import html_tables
from ..streaming import events, queue, runs
from . import arrivals, domain, registry

#: When the first rows arrive.
START = "2026-01-01 08:00:00"


def at(minutes: int) -> Column:
    return (F.lit(START).cast("timestamp") + F.expr(f"interval {minutes} minutes")).alias("at")


def filled(rows: DataFrame, schema: str) -> DataFrame:
    """rows with the columns that a schema has and they lack, as nulls."""
    want = [part.split(" ", 1) for part in schema.split(", ")]
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in want])


def arrive(rows: DataFrame, folder: str, schema: str) -> None:
    filled(rows, schema).write.mode("append").parquet(folder)


def sync_queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every stream's work item, and how often it was due, after five runs.

    All streams arrive, some first in an older form without a calendar; they come again unchanged; the items due are
    answered, those of half of the streams by a failure; then half an hour passes.
    """
    own, folder = runs.stateful(spark), store.new_folder(spark, "queue")
    rows = domain.views(spark, sf_dir)["v_streams"].select("id", F.lit("row").alias("kind"), F.col("calendar_id"), "calendar_synced_at", "pending_clean_started_at", "dates_hash")
    older = rows.withColumn("calendar_id", F.lit(None)).withColumn("pending_clean_started_at", F.lit(None))

    def run() -> DataFrame:
        runs.drain(queue.work_queue(runs.arriving(own, f"{folder}/in", queue.ARRIVAL)), f"{folder}/log", f"{folder}/state")
        return spark.read.parquet(f"{folder}/log")

    arrive(older.filter("substr(id, 4, 1) < '8'").select("*", at(0)), f"{folder}/in", queue.ARRIVAL)
    run()
    arrive(older.select("*", at(-1)).unionByName(rows.select("*", at(5))), f"{folder}/in", queue.ARRIVAL)
    run()
    arrive(rows.select("*", at(6)), f"{folder}/in", queue.ARRIVAL)
    due = queue.open_items(run())
    arrive(due.select("id", F.lit("result").alias("kind"), "dates_hash", "attempt", (F.substring("id", 5, 1) < "8").alias("ok"), at(10)), f"{folder}/in", queue.ARRIVAL)
    run()
    clock = spark.range(1).select(F.lit("").alias("id"), F.lit("row").alias("kind"), F.lit("none").alias("calendar_id"), F.lit(START).alias("calendar_synced_at"), at(200))
    arrive(clock, f"{folder}/in", queue.ARRIVAL)
    log = run()
    counts = log.groupBy("id").agg(F.count_if(F.col("event") == "due").alias("n_due"))
    return runs.last_rows(log, ["id"]).join(counts, "id").select("id", "dates_hash", "event", "attempt", "n_due")


def event_states_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that `event_states` gives, from a stream: patterns in two runs, then results, with late rows among them."""
    own, folder = runs.stateful(spark), store.new_folder(spark, "events")
    v = domain.views(spark, sf_dir)
    filled(v["v_existing"], events.SEED).write.parquet(f"{folder}/seed")
    existing = spark.read.schema(events.SEED).parquet(f"{folder}/seed")
    wanted = store.in_files(v["v_desired"].groupBy("stream").agg(F.array_sort(F.collect_list("d")).alias("dates")))
    patterns = wanted.select("stream", F.lit("pattern").alias("kind"), "dates")

    def run() -> DataFrame:
        # the seed is read by the stream's own session
        seed = own.read.schema(events.SEED).parquet(f"{folder}/seed")
        runs.drain(events.event_log(runs.arriving(own, f"{folder}/in", events.ARRIVAL), seed), f"{folder}/log", f"{folder}/state")
        return spark.read.parquet(f"{folder}/log")

    half = F.col("stream") % 2
    arrive(patterns.filter(half == 0).select("*", at(0)), f"{folder}/in", events.ARRIVAL)
    run()
    arrive(patterns.filter(half == 1).select("*", at(1)), f"{folder}/in", events.ARRIVAL)
    todo = store.in_files(events.open_actions(run()))
    ok = (F.col("stream").cast("long") + F.dayofmonth("d")) % 3 != 0
    results = todo.select("*", F.lit("result").alias("kind"), ok.alias("ok"), F.concat("stream", F.lit("/"), "d").alias("event_id"), F.lit("no answer").alias("error_message"))
    # the same results again, results of an attempt that was never made, and patterns of long ago change nothing
    again = results.select("*", at(4))
    unknown = results.withColumn("attempt", F.col("attempt") + 5).withColumn("ok", ~F.col("ok")).select("*", at(2))
    stale = patterns.withColumn("dates", F.slice("dates", 1, 1)).select("*", at(-1))
    arrive(results.select("*", at(3)), f"{folder}/in", events.ARRIVAL)
    arrive(unknown, f"{folder}/in", events.ARRIVAL)
    arrive(stale, f"{folder}/in", events.ARRIVAL)
    run()
    arrive(again, f"{folder}/in", events.ARRIVAL)
    done = events.event_rows(existing, run())
    return done.select(F.col("stream").cast(v["v_existing"].schema["stream"].dataType).alias("stream"), "d", "status", "event_id", "error_message")


def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each page's file was opened and parsed in three runs, and the hash of its last content.

    All pages are written as files and read; then some change, some are only touched; then nothing happens.
    """
    own, folder = runs.stateful(spark), store.new_folder(spark, "pages")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")

    def put(rows: DataFrame) -> None:
        changed.write_files(rows.select(F.concat("page_id", F.lit(".html")).alias("name"), F.col("html").alias("content")), f"{folder}/in")

    def run() -> None:
        runs.drain(changed.fetches(changed.changed_files(own, f"{folder}/in", f"{folder}/listings")).drop("content"), f"{folder}/log", f"{folder}/state")

    put(pages)
    run()
    last = F.col("page_id") % 10
    put(pages.filter(last == 0).withColumn("html", F.concat("html", F.lit("<!-- changed -->"))).unionByName(pages.filter(last == 1)))
    run()
    run()
    log = spark.read.parquet(f"{folder}/log")
    out = log.groupBy("name").agg(F.count("*").alias("opened"), F.count_if(F.col("seen") == 0).alias("parsed"), F.max_by("content_hash", "tag").alias("content_hash"))
    return out.select(F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("page_id"), "opened", "parsed", "content_hash")


def reconciled_in_part(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(streams, links, ids of touched streams, changed groups) after some groups' dates have changed in a model in which every group has the stream of its pattern."""
    v = domain.views(spark, sf_dir).once("v_groups", "v_changed")
    groups = v["v_changed"]
    before = v["v_groups"].select("id", "waste_type", "dates_hash")
    none = F.lit(None).cast("timestamp")
    first = F.to_timestamp("first_date").alias("created_at")
    held = v["v_streams"].select("id", *streams.PATTERN, F.split("iso", ",").cast("array<date>").alias("dates"), "first_date", "last_date", "date_count", "calendar_id", F.to_timestamp("calendar_synced_at").alias("calendar_synced_at"), *[none.alias(c) for c in streams.PENDING], first, first.alias("updated_at"))
    links = before.join(held.select(F.col("id").alias("calendar_stream_id"), *streams.PATTERN), streams.PATTERN).select(F.col("id").alias("schedule_group_id"), "calendar_stream_id")
    held, links = store.written(held), store.written(links)
    changed = groups.join(before.select("id", F.col("dates_hash").alias("_before")), "id").filter("dates_hash <> _before").drop("_before")
    changed = store.written(changed)
    after, linked, touched = incremental.reconcile_touched(held, links, groups, changed, F.lit(START).cast("timestamp"), linking=False)
    return after, linked, touched, changed


def incremental_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All streams after a part of the groups has changed, only those touched computed anew."""
    out = reconciled_in_part(spark, sf_dir)[0]
    return out.select("id", *streams.PATTERN, "first_date", F.col("date_count").cast("long").alias("date_count"), "calendar_id", F.col("calendar_synced_at").isNotNull().alias("synced"), F.col("pending_clean_started_at").isNotNull().alias("leaving"))


def incremental_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled_in_part(spark, sf_dir)[1]


def incremental_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups changed, and how many streams were computed anew for them."""
    _, _, touched, changed = reconciled_in_part(spark, sf_dir)
    return changed.agg(F.count("*").alias("n")).select(F.lit("groups changed").alias("what"), "n").unionByName(touched.agg(F.count("*").alias("n")).select(F.lit("streams touched").alias("what"), "n"))


#: The model in which every group has the stream of its pattern, and what reconciling all of it gives.
WHOLE_MODEL = """b_streams as (select id, waste_type, dates_hash, first_date, date_count, calendar_id, calendar_synced_at from v_streams
), b_links as (select id as schedule_group_id, concat('cs_', substr(sha256(concat(waste_type, '|', dates_hash, '|0')), 1, 12)) as calendar_stream_id from v_groups
), """ + arrivals.RECONCILED.replace("v_links", "b_links").replace("v_streams", "b_streams")


def workbook_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules of all sheets' rows, each file's rows written as a workbook and read from it by its headings."""
    rows, _ = arrivals.paper(spark, sf_dir)
    names = ["Nr", "seniunija", "kaimai", *MONTHS]

    def packed(table: pa.Table) -> pa.Table:
        lines = sorted(zip(*(table.column(c).to_pylist() for c in names)))
        content = xlsx.workbook([["Grafikas"], names, *[[str(r[0]), *r[1:]] for r in lines]])
        return pa.table({"name": [f"{table.column('file')[0].as_py()}.xlsx"], "content": [content]})

    folder = store.new_folder(spark, "workbooks")
    changed.write_files(rows.withColumnRenamed("row", "Nr").groupBy("file").applyInArrow(packed, "name string, content binary"), folder)
    xlsx.register(spark)
    read = xlsx.with_headings(spark.read.format("xlsx").option("path", folder).load(), names)
    sheet = read.select(F.substring_index("file", ".", 1).alias("file"), F.col("Nr").cast("long").alias("row"), "seniunija", "kaimai", *MONTHS)
    return arrivals.shown(ingest.sheet_schedules(sheet, MONTHS))


#: What a parser answers for the place of customer k, by k % 6, in Spark and in DuckDB SQL; 5: nothing.
ANSWERED = """select c_custkey as k, concat(n_name, ' k. ', c_custkey) as location, case c_custkey % 6
  when 0 then '{"seniunija": "S", "groups": [{"village": " V  k. ", "include_streets": [{"street": "Aukso g.", "house_numbers": "1-9"}, {"street": "Beržo g.", "house_numbers": null}], "exclude_streets": [{"street": "Uosių g.", "house_numbers": null}]}]}'
  when 1 then '[{"seniunija": null, "groups": [{"village": "M. Riešės k."}]}, {"seniunija": "T", "groups": [{"village": "B", "seniunija": "U"}]}]'
  when 2 then '```json\n{"groups": [{"village": "Seniūnija X"}]}\n```' when 3 then 'no object' when 4 then '{"groups": []}' end as parsed_result
from customer join nation on c_nationkey = n_nationkey"""


def place_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of streets from all pages' tables: places by known answers, or by the rules where these are missing or wrong."""
    v = domain.views(spark, sf_dir)
    known = spark.sql(ANSWERED.replace("{", "{{").replace("}", "}}").replace("from customer join nation", "from {customer} join {nation}"), customer=v["customer"], nation=v["nation"])
    types = F.explode(F.array(*map(F.lit, ("bendros", "plastikas", "stiklas")))).alias("waste_type")
    cache = known.filter("parsed_result is not null").select(ids.location_hash(F.col("location")).alias("kaimai_hash"), "parsed_result", types)
    rows = sections.table_schedules(html_tables(v["v_pages"], "doc", "html"))
    found = places.place_rows(rows, cache)
    return found.select("doc", "kaimai_str", "seniunija", "village", "street", "house_numbers", F.array_join(F.transform("exclude_streets", lambda s: s["street"]), ",").alias("excluded"), "waste_type", F.array_join(F.col("dates").cast("array<string>"), ",").alias("iso"))


def cache_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each cached parse was last used, after the cells of all sheets were asked for in three reads and some parses came anew."""
    v = domain.views(spark, sf_dir)
    cache = answers.AnswerCache(spark, store.new_folder(spark, "cache"), ["key"])
    parses = store.written(v["v_parses"].withColumn("tokens_used", F.lit(0)))
    cells = store.written(v["v_paper"].filter("kaimai is not null").select("row_no", ids.parser_cache_key(F.trim("kaimai")).alias("key")))
    day = lambda k: F.lit(START).cast("timestamp") + F.expr(f"interval {k} days")
    cache.put(parses, day(0))
    for k in (1, 2, 3):
        cache.get(cells.filter(F.col("row_no") % 3 == k - 1), day(k))
    cache.put(parses.filter("substr(key, 1, 1) < '4'").withColumn("parsed_result", F.lit("{}")), day(2))
    return cache.entries().select("key", F.to_date("created_at").alias("created"), F.to_date("last_used_at").alias("last_used"), "reads", (F.col("parsed_result") == "{}").alias("anew"))


#: A request for each order, of twelve kinds, from what its customer's location says, in Spark and in DuckDB SQL.
ASKED = """select o_orderkey as n, o_orderkey % 12 as kind, case when o_orderkey % 47 = 0 then 'POST' else 'GET' end as method,
  concat('/api/v1/', case o_orderkey % 12 when 7 then 'streets' when 8 then 'house-numbers' when 9 then concat('schedule-group/', case when o_orderkey % 5 = 0 then 'none' else coalesce(g.id, 'none') end)
    when 10 then concat('calendar-info/', case when o_orderkey % 5 = 0 then 'none' else coalesce(s.calendar_id, 'none') end) when 11 then 'elsewhere' when 4 then 'schedule-multi' when 5 then 'schedule-multi' when 6 then 'schedule-multi' else 'schedule' end) as path,
  case when o_orderkey % 12 = 0 then cast(case when o_orderkey % 5 = 0 then -l.id else l.id end as TEXT) end as location_id,
  case when o_orderkey % 12 in (0, 11) or o_orderkey % 31 = 0 then null else l.seniunija end as seniunija, case when o_orderkey % 12 in (0, 11) then null else l.village end as village,
  case when o_orderkey % 12 in (0, 3, 6, 7, 11) then null when o_orderkey % 29 = 0 then 'nowhere' else l.street end as street,
  case when o_orderkey % 12 in (1, 4, 5, 6) then coalesce(l.house_numbers, '') when o_orderkey % 12 = 2 and l.house_numbers is not null and o_orderkey % 7 > 0 then l.house_numbers end as houses
from orders join v_locations l on l.id = o_custkey left join v_groups g on g.kaimai_hash = l.kaimai_hash and g.waste_type = 'bendros' left join v_links k on k.schedule_group_id = g.id left join v_streams s on s.id = k.calendar_stream_id"""


def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to a request for every order: status, error, and what was found."""
    v = domain.views(spark, sf_dir).once("v_locations", "v_groups", "v_streams")
    sql = ASKED.replace("TEXT", "string")
    for name in ("orders", "v_locations", "v_groups", "v_links", "v_streams"):
        sql = re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", sql)
    asked = store.written(spark.sql(sql, **{name: v[name] for name in ("orders", "v_locations", "v_groups", "v_links", "v_streams")}))
    given = {"location_id": "location_id", "seniunija": "seniunija", "village": "village", "street": "street", "house_numbers": "houses"}
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in given.items()]), lambda p: p["v"].isNotNull())
    asked = asked.select("n", "method", "path", F.map_from_entries(pairs).alias("params"))
    found = requests.answers(asked, v["v_locations"], v["v_groups"], v["v_pdf_rows"], v["v_links"], v["v_streams"], dates=lambda c: F.sha2(requests.dates_text(c), 256), entries=F.size)
    return found.select("n", "status", "error", "location_id", "schedule_group_id", "calendar_id", "calendar_status", F.col("dates").alias("dates_sha256"), F.coalesce("entries", F.lit(-1)).alias("n_entries"))


def migrated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of files as the present schema has them, written by three writers: of the first schema, of one in the middle, and of the present."""
    rows = domain.views(spark, sf_dir)["v_pdf_rows"]
    rows = store.written(rows.withColumn("dates", F.array("d")).withColumn("source_file", F.col("waste_type")).withColumn("kaimai_str", F.col("village")).withColumn("mapping_method", F.lit("rule")).withColumn("source_year", F.year("d")))
    old = rows.withColumn("dates_json", F.to_json("dates"))
    table = schemas.Table(spark, store.new_folder(spark, "rows"), schemas.MODEL["pdf_rows"])
    writer = F.col("id") % 10
    table.append(old.filter(writer <= 2).drop("dates"), 1)
    table.append(old.filter(writer.isin(3, 4)).drop("dates"), 5)
    table.append(rows.filter(writer >= 5).withColumn("dates_hash", ids.dates_hash(F.col("dates"))))
    read = table.read()
    return read.select("id", "source_file", "kaimai_str", "village", "street", "seniunija", "mapped_seniunija", "mapped_village", "source_year", "mapping_method", F.coalesce(F.size("exclude_streets"), F.lit(-1)).alias("n_excluded"), F.array_join(F.col("dates").cast("array<string>"), ",").alias("iso"), "dates_hash")


class Answering:
    """A service without a memory: no calendars for every eighth stream, no events for every third sum of stream and day."""

    def answered(self, keys: list[str]) -> dict[str, str | None]:
        return {}

    def send(self, message: outbox.Message) -> str | None:
        stream = int(message.stream)
        if stream % 8 == 0 if message.action == "create" else (stream + message.d.day) % 3 == 0:
            raise ValueError("no answer")
        return f"cal_{message.name}" if message.action == "create" else f"{message.calendar_id}/{message.d}"


def sync_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream's calendar and events after two rounds of plan, messages, answers and commit."""
    v = domain.views(spark, sf_dir)
    existing = v["v_existing"].select(F.col("stream").cast("string").alias("stream"), "d", "status", F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("string").alias("error_message"))
    wanted = v["v_desired"].groupBy("stream").agg(F.array_sort(F.collect_list("d")).alias("dates"))
    held = v["v_existing"].select("stream").union(v["v_desired"].select("stream")).distinct().join(wanted, "stream", "left")
    none = F.lit(None).cast("timestamp")
    held = held.select(
        F.col("stream").cast("string").alias("id"), F.coalesce("dates", F.array().cast("array<date>")).alias("dates"), F.when(F.col("stream") % 4 != 0, F.concat(F.lit("own_"), "stream")).alias("calendar_id"),
        none.alias("calendar_synced_at"), none.alias("pending_clean_started_at"),
    )
    versions = store.Versions(spark, store.new_folder(spark, "chain"))
    versions.commit({"streams": held, "events": existing})
    for _ in range(2):
        outbox.sync_round(versions, Answering, F.lit(START).cast("timestamp"))
    calendars = versions.read("streams").select(F.col("id").alias("stream"), "calendar_id", F.col("calendar_synced_at").isNotNull().alias("synced"))
    return calendars.join(versions.read("events").drop("updated_at"), "stream", "left")


def event_states_sql() -> str:
    return arrivals.QUERIES["event_states"][1]


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "sync_queue_stream": (sync_queue_stream, """
with s as (select id, dates_hash, (calendar_id is null or calendar_synced_at is null) and pending_clean_started_at is null as due, substr(id, 5, 1) < '8' as ok from v_streams)
select id, dates_hash, case when not due then 'withdrawn' when ok then 'done' else 'due' end as event, cast(case when due and not ok then 2 else 1 end as integer) as attempt, cast(case when due and not ok then 2 else 1 end as bigint) as n_due from s"""),
    "changed_pages": (changed_pages, """
select page_id, cast(case when page_id % 10 in (0, 1) then 2 else 1 end as bigint) as opened, cast(case when page_id % 10 = 0 then 2 else 1 end as bigint) as parsed,
  sha256(case when page_id % 10 = 0 then concat(html, '<!-- changed -->') else html end) as content_hash from pages"""),
    "incremental_streams": (incremental_streams, f"""
with {WHOLE_MODEL} select id, waste_type, dates_hash, first_date, date_count, calendar_id, synced, leaving from moved
union all select id, waste_type, dates_hash, first_date, date_count, null, false, false from made"""),
    "incremental_links": (incremental_links, f"""
with {WHOLE_MODEL} select schedule_group_id, calendar_stream_id from b_links where schedule_group_id not in (select schedule_group_id from going)
union all select g.schedule_group_id, e.stream_id from going g join (select waste_type, dates_hash, stream_id from open union all select waste_type, dates_hash, id from made) e using (waste_type, dates_hash)"""),
    "incremental_counts": (incremental_counts, """
with c as (select n.id, n.waste_type, n.dates_hash as after, o.dates_hash as before from v_changed n join v_groups o using (id) where n.dates_hash <> o.dates_hash)
select 'groups changed' as what, count(*) as n from c union all
select 'streams touched', count(*) from v_streams s where (waste_type, dates_hash) in (select (waste_type, before) from c) or (waste_type, dates_hash) in (select (waste_type, after) from c)"""),
    "workbook_schedules": (workbook_schedules, arrivals.QUERIES["sheet_schedules"][1]),
    "place_rows": (place_rows, f"""
with {arrivals.TABLES}, answered as ({ANSWERED}), cells as (
select p.*, case when a.k % 6 in (0, 1, 4) then a.k % 6 else 9 end as kind from placed p left join answered a on a.location = p.location
), each as (
select *, unnest(case kind when 0 then [{{'v': 'V k.', 's': 'S', 'st': 'Aukso g.', 'h': '1-9', 'x': 'Uosių g.'}}, {{'v': 'V k.', 's': 'S', 'st': 'Beržo g.', 'h': null, 'x': 'Uosių g.'}}]
  when 1 then [{{'v': 'Mažosios Riešės k.', 's': 'T', 'st': '', 'h': null, 'x': ''}}, {{'v': 'B', 's': 'U', 'st': '', 'h': null, 'x': ''}}]
  when 4 then [] else [{{'v': location, 's': '', 'st': '', 'h': null, 'x': ''}}] end) as y from cells
), numbered as (select *, row_number() over (partition by doc, y.s, y.v, y.st, coalesce(y.h, ''), waste_type, iso order by section, k) as nth from each)
select doc, location as kaimai_str, y.s as seniunija, y.v as village, y.st as street, y.h as house_numbers, y.x as excluded, waste_type, iso from numbered where nth = 1"""),
    "cache_touches": (cache_touches, """
with cells as (select substr(SHA(trim(kaimai)), 1, 16) as key, row_no % 3 + 1 as read from v_paper where kaimai is not null
), used as (select key, max(read) as last, count(distinct read) as reads from cells group by key)
select p.key, date '2026-01-01' + case when p.key < '4' then 2 else 0 end as created, date '2026-01-01' + cast(greatest(coalesce(last, 0), case when p.key < '4' then 2 else 0 end) as integer) as last_used, coalesce(reads, 0) as reads, p.key < '4' as anew
from v_parses p left join used u on u.key = p.key"""),
    "request_answers": (request_answers, f"""
with asked as ({ASKED}), has as (select seniunija, village, max(street) <> '' as streets from v_locations group by all
), judged as (
select a.*, coalesce(streets, false) as streets, case when kind = 8 then coalesce(a.street, '') when coalesce(streets, false) then a.street else '' end as st, coalesce(seniunija, '') <> '' and coalesce(village, '') <> '' as placed from asked a left join has using (seniunija, village)
), {registry.SELECTIONS.replace("from v_locations)", "from v_locations union select seniunija, village, st, coalesce(houses, '') from judged where kind in (4, 5, 6) and placed and st is not null)", 1)}, {registry.WIDE}, {registry.DATED}, said as (
select j.*, case when method <> 'GET' then 'Only GET method is allowed' when (kind in (1, 2, 3) or kind = 0 and cast(location_id as bigint) = 0) and not placed then 'Must provide either location_id or both seniunija and village' when kind in (4, 5, 6) and not placed then 'Must provide seniunija and village'
  when kind in (7, 8) and not placed then 'seniunija and village parameters required' when kind in (1, 2, 3, 4, 5, 6) and streets and st is null then 'This village has streets. Please select a street.'
  when kind in (1, 2, 3) and coalesce(hb, 0) = 1 and houses is null then 'This street has specific house numbers. Please select a house number.' when kind = 11 then 'Not found' end as error
from judged j left join flags f on f.seniunija = j.seniunija and f.village = j.village and f.street = j.st
), placed1 as (
select s.n, l.id, row_number() over (partition by s.n order by case when l.house_numbers is null then 0 else 1 end, l.id) as rn from said s join v_locations l on kind = 0 and l.id = try_cast(s.location_id as bigint) or kind in (1, 2, 3) and l.seniunija = s.seniunija and l.village = s.village and l.street = s.st and (coalesce(houses, '') = '' or l.house_numbers = houses) where error is null and kind <= 3
), one as (
select p.n, l.id as location_id, g.id as schedule_group_id, s.calendar_id, case when s.calendar_id is null then 'pending' when s.calendar_synced_at is null then 'needs_update' else 'synced' end as calendar_status,
  list_transform(coalesce(g.dates, []), lambda d: concat(d, ' bendros')) as dates
from placed1 p join v_locations l on l.id = p.id left join v_groups g on g.kaimai_hash = l.kaimai_hash and g.waste_type = 'bendros' left join v_links k on k.schedule_group_id = g.id left join v_streams s on s.id = k.calendar_stream_id where rn = 1
), days as (select seniunija, village, street, bucket, list(concat(d, ' ', waste_type) order by d, waste_type) as dates from dated group by all
), multi as (select n, coalesce(dates, []) as dates from said s left join days d on d.seniunija = s.seniunija and d.village = s.village and d.street = s.st and d.bucket = coalesce(houses, '') where error is null and kind in (4, 5, 6)
), grouped as (select n, substr(path, 24) as schedule_group_id, g.id is not null as there, s.calendar_id, list_transform(coalesce(g.dates, []), lambda d: concat(d, ' bendros')) as dates
from said left join v_groups g on g.id = substr(path, 24) left join v_links k on k.schedule_group_id = g.id left join v_streams s on s.id = k.calendar_stream_id where error is null and kind = 9
), n_streets as (select seniunija, village, count(distinct street) as c from v_locations group by all
), n_houses as (select seniunija, village, street, sum(c) as c from (
  select seniunija, village, street, count(distinct house_numbers) as c from v_locations where house_numbers <> '' group by all
  union all select seniunija, village, street, 1 from flags where hb = 0 or (seniunija, village, street) in (select (seniunija, village, street) from wide)) t group by all
), calendars as (select distinct calendar_id from v_streams where calendar_id is not null)
select s.n, case when s.error = 'Only GET method is allowed' then 405 when s.error = 'Not found' then 404 when s.error is not null then 400 when kind <= 3 and one.n is null or kind = 10 and c.calendar_id is null then 404 else 200 end as status,
  coalesce(s.error, case when kind <= 3 and one.n is null then 'Location not found' when kind = 10 and c.calendar_id is null then 'Calendar not found' when kind = 9 and not there then 'Schedule group not found' end) as error,
  one.location_id, coalesce(one.schedule_group_id, g.schedule_group_id) as schedule_group_id, coalesce(one.calendar_id, g.calendar_id, c.calendar_id) as calendar_id, one.calendar_status,
  sha256(array_to_string(coalesce(one.dates, multi.dates, g.dates), ',')) as dates_sha256, cast(case when s.error is null and kind = 7 then coalesce(ns.c, 0) when s.error is null and kind = 8 then coalesce(nh.c, 0) else -1 end as integer) as n_entries
from said s left join one on one.n = s.n left join multi on multi.n = s.n left join grouped g on g.n = s.n left join calendars c on kind = 10 and s.error is null and c.calendar_id = substr(path, 23)
left join n_streets ns on kind = 7 and ns.seniunija = s.seniunija and ns.village = s.village left join n_houses nh on kind = 8 and nh.seniunija = s.seniunija and nh.village = s.village and nh.street = s.st"""),
    "migrated_rows": (migrated_rows, """
select id, waste_type as source_file, village as kaimai_str, village, street, case when id % 10 >= 3 then seniunija end as seniunija, case when id % 10 >= 3 then mapped_seniunija end as mapped_seniunija, case when id % 10 >= 5 then mapped_village end as mapped_village,
  case when id % 10 >= 3 then cast(year(d) as integer) end as source_year, case when id % 10 >= 5 then 'rule' else 'none' end as mapping_method, case when id % 10 in (1, 2) then 0 else -1 end as n_excluded, cast(d as varchar) as iso, substr(SHA(cast(d as varchar)), 1, 16) as dates_hash from v_pdf_rows"""),
    "sync_chain": (sync_chain, """
with s as (select *, case when stream % 4 <> 0 then concat('own_', stream) when stream % 8 <> 0 then concat('cal_', stream) end as calendar_id from (select stream from v_existing union select stream from v_desired) x
), todo as (
select coalesce(w.stream, e.stream) as stream, coalesce(w.d, e.d) as d, case when w.stream is null then 'delete' when e.status is null then 'add' when e.status = 'error' then 'retry' end as action
from v_desired w full join v_existing e on w.stream = e.stream and w.d = e.d where coalesce(w.stream, e.stream) in (select stream from v_desired) and coalesce(w.stream, e.stream) % 8 <> 0
), events as (
select stream, d, status, cast(null as varchar) as event_id, cast(null as varchar) as error_message from v_existing e where not exists (select 1 from todo t where t.stream = e.stream and t.d = e.d and action is not null)
union all select stream, d, case when (stream + day(d)) % 3 <> 0 then 'created' else 'error' end, case when (stream + day(d)) % 3 <> 0 then concat(calendar_id, '/', d) end, case when (stream + day(d)) % 3 = 0 then 'no answer' end
from todo join s using (stream) where action in ('add', 'retry'))
select cast(s.stream as varchar) as stream, s.calendar_id, s.calendar_id is not null as synced, d, status, event_id, error_message from s left join events using (stream)"""),
    "event_states_stream": (event_states_stream, event_states_sql()),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: domain.oracle(sql) for name, (_, sql) in QUERIES.items()}
