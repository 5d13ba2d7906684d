"""The registered queries of the schedule engine and their SQL oracles, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import compare, lookup, mapping, store, streams, sync
from . import domain

PLACE = "seniunija, village, street"
#: Common table expressions that several oracles start with.
WANTED = f"w as (select distinct {PLACE}, coalesce(house_numbers, '') as bucket from v_locations)"
GENERAL = f"gen as (select distinct {PLACE}, coalesce(house_numbers, '') as hn from v_locations where kaimai_hash in (select kaimai_hash from v_groups where waste_type = 'bendros'))"
ROWS = "p as (select id, coalesce(mapped_seniunija, seniunija) as seniunija, coalesce(mapped_village, village) as village, coalesce(mapped_street, street, '') as street, coalesce(house_numbers, '') as hn, waste_type, kaimai_hash from v_pdf_rows)"
HAVE = f"""have as (
select w.seniunija, w.village, w.street, w.bucket, 'bendros' as waste_type from w join gen using ({PLACE}) where gen.hn = w.bucket
union
select w.seniunija, w.village, w.street, w.bucket, p.waste_type from w join p on p.seniunija = w.seniunija and p.village = w.village and p.street in (w.street, '')
where lower(p.hn) = lower(w.bucket) or lower(p.hn) in ('', 'all'))"""
FLAGS = f"flags as (select {PLACE}, max(case when coalesce(house_numbers, '') <> '' then 1 else 0 end) as hb from v_locations group by {PLACE})"
WIDE = f"wide as (select distinct {PLACE}, waste_type from p where lower(hn) in ('', 'all'))"
BEST = f"""best as (
select * from (select w.seniunija, w.village, w.street, w.bucket, p.waste_type, p.kaimai_hash, case when p.street = w.street then 0 else 1 end as street_rank,
  case when p.hn = w.bucket then 0 when lower(p.hn) in ('', 'all') then 1 else 2 end as bucket_rank,
  row_number() over (partition by w.seniunija, w.village, w.street, w.bucket, p.waste_type order by case when p.street = w.street then 0 else 1 end,
    case when p.hn = w.bucket then 0 when lower(p.hn) in ('', 'all') then 1 else 2 end, p.id, p.kaimai_hash) as rn
  from w join p on p.seniunija = w.seniunija and p.village = w.village and p.street in (w.street, '')) t where rn = 1)"""
DATED = f"""dated as (
select c.seniunija, c.village, c.street, c.bucket, c.waste_type, g.id as group_id, unnest(g.dates) as d from (
  select seniunija, village, street, bucket, 'bendros' as waste_type, kaimai_hash from (
    select w.seniunija, w.village, w.street, w.bucket, l.kaimai_hash, row_number() over (partition by w.seniunija, w.village, w.street, w.bucket order by case when l.house_numbers is null then 0 else 1 end, l.id) as rn
    from w join flags using ({PLACE}) join v_locations l using ({PLACE}) where (hb = 0 or w.bucket <> '') and (w.bucket = '' or l.house_numbers = w.bucket)) t where rn = 1
  union all select seniunija, village, street, bucket, waste_type, kaimai_hash from best) c
join have using ({PLACE}, bucket, waste_type) join v_groups g on g.kaimai_hash = c.kaimai_hash and g.waste_type = c.waste_type)"""
SELECTIONS = ", ".join([WANTED, GENERAL, ROWS, HAVE, FLAGS, BEST])


def model(spark: SparkSession, sf_dir: str, *once: str) -> tuple[DataFrame, ...]:
    """Locations, groups and rows of files; those named are computed once."""
    v = domain.views(spark, sf_dir).once(*once)
    return v["v_locations"], v["v_groups"], v["v_pdf_rows"]


def all_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.all_locations(model(spark, sf_dir)[0])


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 locations that hold "asi": a top-k report."""
    return lookup.search(model(spark, sf_dir)[0], "asi", 50)


def villages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.villages(*model(spark, sf_dir))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.streets(*model(spark, sf_dir))


def house_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.house_numbers(*model(spark, sf_dir, "v_groups"))


def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waste types of every selection."""
    found = model(spark, sf_dir)
    return lookup.availability(lookup.selections(found[0]), *found)


def streetwide(spark: SparkSession, sf_dir: str) -> DataFrame:
    locations, _, rows = model(spark, sf_dir)
    return lookup.streetwide(locations, rows)


def best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    locations, _, rows = model(spark, sf_dir)
    return lookup.best_rows(lookup.selections(locations), rows)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date of every waste type of every selection."""
    found = model(spark, sf_dir, "v_locations", "v_groups")
    return lookup.multi_schedule(lookup.selections(found[0]), *found)


def calendar_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model(spark, sf_dir, "v_locations", "v_groups")
    return lookup.calendar_grid(lookup.chosen_groups(lookup.selections(found[0]), *found))


def location_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.views(spark, sf_dir)
    return lookup.location_schedules(v["v_locations"], v["v_groups"], v["v_links"], v["v_streams"])


def group_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    locations, groups, _ = model(spark, sf_dir)
    return lookup.group_schedules(groups, locations).select("id", "waste_type", "iso", "dates_hash", "location_count", F.array_join(F.transform("locations", lambda x: x["id"].cast("string")), ",").alias("location_ids"))


def needing_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.needing_sync(domain.views(spark, sf_dir)["v_streams"]).select("id", "waste_type", "dates_hash", "iso")


def pending_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams whose clean-up was due on 2001-07-20, four days after they were marked."""
    marked = domain.views(spark, sf_dir)["v_streams"].withColumn("pending_clean_until", F.date_add("pending_clean_started_at", 4))
    return streams.pending_cleanup(marked, F.lit("2001-07-20").cast("date")).select("id", "pending_clean_until")


def unlinked_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.views(spark, sf_dir)
    return streams.unlinked(v["v_streams"], v["v_links"]).select("id", "waste_type", "dates_hash")


def representative_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.views(spark, sf_dir)
    return streams.representative_district(v["v_streams"], v["v_links"], v["v_groups"], v["v_locations"])


def calendar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.views(spark, sf_dir)
    return streams.calendar_plan(v["v_streams"], representative_district(spark, sf_dir), {"bendros": "General"}, "Unknown")


def cleanup_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.cleanup_notices(domain.views(spark, sf_dir)["v_streams"]).select("id", "calendar_id", "d")


def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.views(spark, sf_dir)
    return sync.plan(v["v_desired"], v["v_existing"])


def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.counts(sync_plan(spark, sf_dir))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    locations, _, rows = model(spark, sf_dir)
    return compare.match(rows, locations)


def compare_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.methods(matched(spark, sf_dir))


def compare_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = model(spark, sf_dir, "v_groups")[1]
    theirs = groups.filter("waste_type = 'bendros'").select(F.col("kaimai_hash").alias("match_hash"), F.col("dates").alias("_theirs"))
    # every fifth row has the dates of the place that it matches, the others a day; rows alike in all that the outcome depends on are compared once, and counted
    alike = matched(spark, sf_dir).groupBy("waste_type", "match_hash", F.when(F.col("id") % 5 != 0, F.col("d")).alias("own"), (F.col("id") % 5 == 0).alias("same")).agg(F.count("*").alias("times"))
    dated = alike.join(theirs, "match_hash", "left").withColumn("dates", F.when(F.col("same"), F.reverse("_theirs")).otherwise(F.array("own"))).drop("_theirs")
    return compare.report(compare.outcome(dated, groups), F.col("times"))


def fix_villages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's village: its own, or the only one of its district that has its street."""
    locations, _, rows = model(spark, sf_dir)
    named = rows.select("id", *[F.coalesce(f"mapped_{c}", c, F.lit("")).alias(f"mapped_{c}") for c in mapping.CATEGORIES], F.lit("none").alias("mapping_method"))
    return mapping.fix_villages(named, locations)


def upsert_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All locations, then all places of the rows of files: every key once, the later one wins."""
    keys = ["seniunija", "village", "street", "house_numbers"]
    locations, _, rows = model(spark, sf_dir)
    first = store.latest(locations.select(*keys, "id", "kaimai_hash"), keys, ["id"])
    second = store.latest(rows.select("seniunija", "village", F.coalesce("street", F.lit("")).alias("street"), "house_numbers", "id", "kaimai_hash"), keys, ["id"])
    return store.upsert(first, second, keys)


def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, and the same with marks on some letters, in the forms that comparison uses."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.explode(F.array("n_name", F.translate("n_name", *MARKED))).alias("name"))
    return nations.select("n_nationkey", "name", text.fold(F.col("name")).alias("folded"), text.stem(F.col("name")).alias("stem"))


#: Letters, and the same with marks.
MARKED = ("ACEIUSZ", "ĄČĘĮŲŠŽ")

QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    all_locations, search, villages, streets, house_numbers, availability, streetwide, best_rows, flagship, calendar_grid, location_schedules, group_schedules,
    needing_sync, pending_cleanup, unlinked_streams, representative_district, calendar_names, cleanup_notices, sync_plan, sync_counts,
    compare_methods, compare_report, fix_villages, upsert_locations, folded_names,
]


def stem_sql(s: str) -> str:
    cases = " ".join(f"when {s} like '%{e}' and length({s}) > {len(e) + 1} then left({s}, length({s}) - {len(e)})" for e in text.ENDINGS)
    return f"case {cases} else {s} end"


def match_sql() -> str:
    """CTE `matched`: rows with their match by the first tier that has their key. The names here need lower case only."""
    keys = f"lower({{0}}) as s, lower({{1}}) as v, {stem_sql('lower({1})')} as vs, lower({{2}}) as st, case when lower({{3}}) = 'all' then '' else lower({{3}}) end as h"
    loc = "loc as (select id, kaimai_hash, " + keys.format("seniunija", "village", "street", "coalesce(house_numbers, '')") + " from v_locations)"
    row = "r as (select *, " + keys.format("seniunija", "village", "street", "hn") + " from (select p.*, d from (select v_pdf_rows.id, v_pdf_rows.d, coalesce(mapped_seniunija, seniunija) as seniunija, coalesce(mapped_village, village) as village, coalesce(mapped_street, street, '') as street, coalesce(house_numbers, '') as hn, waste_type from v_pdf_rows) p) q)"
    tiers = [f"t_{t} as (select {', '.join(on)}, min_by(kaimai_hash, id) as {t} from loc group by {', '.join(on)}{' having count(*) = 1' if t in compare.UNIQUE else ''})" for t, on in compare.TIERS.items()]
    joins = " ".join(f"left join t_{t} using ({', '.join(on)})" for t, on in compare.TIERS.items())
    method = "case " + " ".join(f"when {t} is not null then '{t}'" for t in compare.TIERS) + " end"
    found = f"matched as (select id, waste_type, d, coalesce({', '.join(compare.TIERS)}) as match_hash, {method} as match_method from r {joins})"
    return ", ".join([loc, row, *tiers, found])


LINKED = "join v_groups g on g.id = k.schedule_group_id join v_locations l on l.kaimai_hash = g.kaimai_hash"
DISTRICTS = f"dist as (select k.calendar_stream_id as id, min(l.seniunija) as seniunija from v_links k {LINKED} group by k.calendar_stream_id)"
PLAN = """plan as (select stream, d, case when w.one is null then 'delete' when e.status is null then 'add' when e.status = 'error' then 'retry' end as action
from (select stream, d, 1 as one from v_desired) w full join v_existing e using (stream, d) where stream in (select stream from v_desired))"""
SCOPE = "case when {0} is null then 'none' when {0} = 1 then 'all' else 'some' end"
TYPES = "coalesce(string_agg(distinct {0}, ',' order by {0}), '') as types"


def oracle_sources() -> dict[str, str]:
    return {
        "all_locations": "select id, seniunija, village, street, house_numbers, kaimai_hash from v_locations",
        "search": "select id, seniunija, village, street, house_numbers, kaimai_hash from v_locations where lower(seniunija) like '%asi%' or lower(village) like '%asi%' or lower(street) like '%asi%' order by seniunija, village, street, id limit 50",
        "villages": f"""with {ROWS}, b as (select l.seniunija, l.village, max(case when l.street = '' then 1 else 0 end) as bendros from v_locations l join v_groups g on g.kaimai_hash = l.kaimai_hash and g.waste_type = 'bendros' group by l.seniunija, l.village),
o as (select seniunija, village, max(case when waste_type = 'plastikas' then case when street = '' then 1 else 0 end end) as plastikas, max(case when waste_type = 'stiklas' then case when street = '' then 1 else 0 end end) as stiklas from p group by seniunija, village)
select seniunija, village, {SCOPE.format('b.bendros')} as bendros, {SCOPE.format('o.plastikas')} as plastikas, {SCOPE.format('o.stiklas')} as stiklas,
  concat_ws(',', case when b.bendros is not null then 'bendros' end, case when o.plastikas is not null then 'plastikas' end, case when o.stiklas is not null then 'stiklas' end) as available
from (select distinct seniunija, village from v_locations where village <> '') v left join b using (seniunija, village) left join o using (seniunija, village)""",
        "streets": f"""with {GENERAL}, {ROWS}, s as (select distinct {PLACE} from v_locations), h as (select {PLACE}, 'bendros' as waste_type from gen union select s.seniunija, s.village, s.street, p.waste_type from s join p on p.seniunija = s.seniunija and p.village = s.village and p.street in (s.street, ''))
select seniunija, village, street, {TYPES.format('h.waste_type')} from s left join h using ({PLACE}) group by seniunija, village, street""",
        "house_numbers": f"""with {SELECTIONS}, {WIDE}, whole as (select {PLACE}, 'bendros' as waste_type from gen join flags using ({PLACE}) where hb = 0 union select {PLACE}, waste_type from wide)
select seniunija, village, street, '' as bucket, {TYPES.format('whole.waste_type')} from flags left join whole using ({PLACE}) where hb = 0 or (seniunija, village, street) in (select (seniunija, village, street) from wide) group by seniunija, village, street
union all select w.seniunija, w.village, w.street, w.bucket, {TYPES.format('have.waste_type')} from w left join have using ({PLACE}, bucket) where w.bucket <> '' group by w.seniunija, w.village, w.street, w.bucket""",
        "availability": f"with {SELECTIONS} select * from have",
        "streetwide": f"with {ROWS}, {WIDE} select {PLACE}, waste_type from wide where (seniunija, village, street) in (select (seniunija, village, street) from v_locations)",
        "best_rows": f"with {SELECTIONS} select {PLACE}, bucket, waste_type, kaimai_hash, street_rank, bucket_rank from best",
        "flagship": f"with {SELECTIONS}, {DATED} select * from dated",
        "calendar_grid": f"with {SELECTIONS}, {DATED} select {PLACE}, bucket, d, string_agg(distinct waste_type, ',' order by waste_type) as types from dated group by {PLACE}, bucket, d",
        "location_schedules": """select l.id, l.seniunija, l.village, l.street, l.house_numbers, g.id as group_id, g.date_count, k.calendar_stream_id as stream_id, s.calendar_id,
  case when s.calendar_id is null then 'pending' when s.calendar_synced_at is null then 'needs_update' else 'synced' end as status
from v_locations l left join v_groups g on g.kaimai_hash = l.kaimai_hash and g.waste_type = 'bendros' left join v_links k on k.schedule_group_id = g.id left join v_streams s on s.id = k.calendar_stream_id""",
        "group_schedules": "select g.id, g.waste_type, g.iso, g.dates_hash, count(l.id) as location_count, string_agg(l.id, ',' order by l.seniunija, l.village, l.street, l.house_numbers nulls first, l.id) as location_ids from v_groups g left join v_locations l using (kaimai_hash) group by g.id, g.waste_type, g.iso, g.dates_hash",
        "needing_sync": "select id, waste_type, dates_hash, iso from v_streams where (calendar_id is null or calendar_synced_at is null) and pending_clean_started_at is null",
        "pending_cleanup": "select id, cast(pending_clean_started_at + 4 as date) as pending_clean_until from v_streams where pending_clean_started_at + 4 <= date '2001-07-20'",
        "unlinked_streams": "select id, waste_type, dates_hash from v_streams where id not in (select calendar_stream_id from v_links)",
        "representative_district": f"with {DISTRICTS} select id, seniunija from dist",
        "calendar_names": f"with {DISTRICTS} select s.id, concat(coalesce(seniunija, 'Unknown'), ' - ', case waste_type when 'bendros' then 'General' else waste_type end, ' - ', substr(s.id, 1, 6)) as name from v_streams s left join dist on dist.id = s.id where calendar_id is null",
        "cleanup_notices": "select id, calendar_id, cast(pending_clean_started_at + k as date) as d from v_streams, (select unnest([0, 1, 2]) as k) x where pending_clean_started_at is not null and calendar_id is not null",
        "sync_plan": f"with {PLAN} select stream, d, action from plan where action is not null",
        "sync_counts": f"with {PLAN} select stream, count(*) filter (action = 'delete') as n_delete, count(*) filter (action = 'add') as n_add, count(*) filter (action = 'retry') as n_retry from plan where action is not null group by stream",
        "compare_methods": f"with {match_sql()} select t.match_method, count(m.match_method) as n from (select unnest({list(compare.TIERS)}) as match_method) t left join matched m on m.match_method = t.match_method group by t.match_method",
        "compare_report": f"""with {match_sql()}, o as (select m.waste_type, case when g.dates is null then 'no_match' when m.id % 5 = 0 or g.dates = [m.d] then 'overlap' else 'conflict' end as outcome from matched m left join v_groups g on g.kaimai_hash = m.match_hash and g.waste_type = 'bendros')
select waste_type, count(*) as total, count(*) filter (outcome <> 'no_match') as matched, count(*) filter (outcome = 'overlap') as overlap, count(*) filter (outcome = 'conflict') as conflict, count(*) filter (outcome = 'no_match') as no_match from o group by rollup (waste_type)""",
        "fix_villages": """with r as (select id, coalesce(mapped_seniunija, seniunija) as s, coalesce(mapped_village, village) as v, coalesce(mapped_street, street, '') as st from v_pdf_rows),
only1 as (select seniunija as s, street as st, min(village) as single from v_locations group by seniunija, street having count(distinct village) = 1),
known as (select distinct seniunija as s, village as v, street as st, true as known from v_locations)
select id, s as mapped_seniunija, case when known is null and single is not null then single else v end as mapped_village, st as mapped_street, case when known is null and single is not null then 'none+db_fixup' else 'none' end as mapping_method
from r left join known using (s, v, st) left join only1 using (s, st)""",
        "upsert_locations": """with a as (select seniunija, village, street, house_numbers, max(id) as id, max_by(kaimai_hash, id) as kaimai_hash from v_locations group by all),
b as (select seniunija, village, coalesce(street, '') as street, house_numbers, max(id) as id, max_by(kaimai_hash, id) as kaimai_hash from v_pdf_rows group by seniunija, village, coalesce(street, ''), house_numbers)
select * from b union all select * from a where not exists (select 1 from b where b.seniunija = a.seniunija and b.village = a.village and b.street = a.street and b.house_numbers is not distinct from a.house_numbers)""",
        "folded_names": f"select n_nationkey, unnest([n_name, translate(n_name, '{MARKED[0]}', '{MARKED[1]}')]) as name, unnest([lower(n_name), lower(n_name)]) as folded, unnest([{stem_sql('lower(n_name)')}, {stem_sql('lower(n_name)')}]) as stem from nation",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__ if q is not flagship else "multi_schedule": q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"multi_schedule" if k == "flagship" else k: domain.oracle(sql) for k, sql in oracle_sources().items()}
