"""Queries of the core's data operators over this project's tables: pN_ names of the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagre.operators.schema_drift import drift, named_values, one_table
from almagre.operators.snapshot_diff import hour_and_minute, snapshot_changes
from almagre.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The festejos added, removed or changed from each snapshot of a feed to the next."""
    va, on = table(spark, sf_dir, "vadetoros"), table(spark, sf_dir, "onetoro")
    people = F.array_sort(F.array_distinct("participants"))
    compared = {
        "vadetoros": (va, [F.col("date"), hour_and_minute(F.col("time")), F.col("channel"), F.col("televised"), F.col("type"), people]),
        "onetoro": (on, [F.col("date"), F.col("published"), F.col("live")]),
    }
    parts = [
        snapshot_changes(df, "fetchedAt", "id", cols, "loaded_at", "row_id").select(
            F.lit(feed).alias("feed"), "id", F.date_format("fetchedAt", "yyyy-MM-dd HH:mm:ss").alias("snapshot"), "change"
        )
        for feed, (df, cols) in compared.items()
    ]
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field added, removed, renamed or retyped from one file of a feed to the next."""
    return drift(table(spark, sf_dir, "rawrecords"))[2]


def p7_one_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files as one table: a typed column per name, whatever the fields are called in a file."""
    return one_table(table(spark, sf_dir, "rawrecords"))


def p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of all files under its field's first name, with the name's type and whether the value fits it; objects by their keys."""
    values = named_values(table(spark, sf_dir, "rawrecords"))
    keys = F.array_join(F.array_sort(F.json_object_keys("value")), ",")
    return values.withColumn("value", F.when(F.col("value").startswith("{"), keys).otherwise(F.col("value")))


QUERIES = {"p2_found": p2_found, "p7_found": p7_found, "p7_one_table": p7_one_table, "p7_values": p7_values}

_TIME = r"""case when trim(coalesce("time", '')) = '' then ''
  when regexp_matches("time", '^\s*\d{1,2}\s*[:.hH]\s*\d{2}')
  then lpad(regexp_extract("time", '^\s*(\d{1,2})\s*[:.hH]\s*(\d{2})', 1), 2, '0') || ':' || regexp_extract("time", '^\s*(\d{1,2})\s*[:.hH]\s*(\d{2})', 2)
  else trim("time") end"""

_DRIFT = r"""
with raw as (select feed, file_no, payload::json as j from rawrecords where json_valid(payload) and json_type(payload::json) = 'OBJECT'),
f as (select feed, file_no, json_extract_string(j, '$.id') as id, k as field, json_extract(j, '$."' || k || '"') as v from (select *, unnest(json_keys(j)) as k from raw)),
v as (select feed, file_no, id, field, v, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'NULL' then null else 'number' end as t,
  case when json_type(v) = 'VARCHAR' then json_extract_string(v, '$') else v::varchar end as content from f),
files as (select *, row_number() over (partition by feed order by file_no) as ord, count(*) over (partition by feed) as files from (select distinct feed, file_no from rawrecords)),
n as (select feed, file_no, field, t, count(*) as c from v group by all),
own as (select feed, file_no, field, first(t order by c desc, case t when 'string' then 1 when 'number' then 2 when 'boolean' then 3 when 'array' then 4 else 5 end) filter (t is not null) as own from n group by all),
cat as (select o.*, ord, files, ord - row_number() over (partition by o.feed, field order by ord) as island from own o join files using (feed, file_no)),
isl as (select feed, field, island, min(ord) as a, max(ord) as b, max(files) as files from cat group by all),
s as (select feed, field, a as ord from isl where a > 1), e as (select feed, field, b + 1 as ord from isl where b < files),
vo as (select distinct feed, ord, id, field, content from v join files using (feed, file_no) where t is not null and id is not null),
cand as (select e.feed, e.ord, e.field, s.field as new_field, count(distinct x.id) as n_both, count(distinct case when x.content = y.content then x.id end) as same
  from e join s on e.feed = s.feed and e.ord = s.ord join vo x on x.feed = e.feed and x.ord = e.ord - 1 and x.field = e.field join vo y on y.feed = e.feed and y.ord = e.ord and y.field = s.field and y.id = x.id group by all),
ren as (select feed, ord, field, new_field from (select *, row_number() over (partition by feed, ord, field order by same / n_both desc, same desc, new_field) as r1, row_number() over (partition by feed, ord, new_field order by same / n_both desc, same desc, field) as r2
  from cand where same >= 0.8 * n_both) where r1 = 1 and r2 = 1),
ty as (select *, last_value(own ignore nulls) over (partition by feed, field, island order by ord rows unbounded preceding) as t from cat),
tn as (select feed, ord, field, t from ty),
old as (select ty.feed, ty.file_no, ty.ord, ty.field, ty.t, coalesce(p.t, q.t) as before from ty left join tn p on p.feed = ty.feed and p.ord = ty.ord - 1 and p.field = ty.field
  left join ren on ren.feed = ty.feed and ren.ord = ty.ord and ren.new_field = ty.field left join tn q on q.feed = ty.feed and q.ord = ty.ord - 1 and q.field = ren.field),
"""

SQL = {
    "p2_found": f"""
with v as (select fetchedAt s, id, row(date, {_TIME}, channel, televised, type, list_sort(list_distinct(participants)), null) x, loaded_at, row_id,
  'vadetoros' feed from vadetoros where id is not null and fetchedAt is not null),
o as (select fetchedAt s, id, row(date, published, live) x, loaded_at, row_id, 'onetoro' feed from onetoro where id is not null and fetchedAt is not null),
rows as (select feed, s, id, md5(x::varchar) x from (select *, row_number() over (partition by s, id order by loaded_at desc, row_id desc) r from v) where r = 1
  union all select feed, s, id, md5(x::varchar) x from (select *, row_number() over (partition by s, id order by loaded_at desc, row_id desc) r from o) where r = 1),
step as (select feed, s, lag(s) over (partition by feed order by s) before from (select distinct feed, s from rows)),
a as (select step.feed, step.s, id, x from step join rows on rows.feed = step.feed and rows.s = step.s where before is not null),
b as (select step.feed, step.s, id, x from step join rows on rows.feed = step.feed and rows.s = step.before)
select coalesce(a.feed, b.feed) feed, coalesce(a.id, b.id) id, strftime(coalesce(a.s, b.s), '%Y-%m-%d %H:%M:%S') snapshot,
  case when b.id is null then 'added' when a.id is null then 'removed' else 'changed' end change
from a full join b on a.feed = b.feed and a.s = b.s and a.id = b.id where a.id is null or b.id is null or a.x <> b.x""",
    "p7_found": _DRIFT + """log as (select feed, ord, 'added' as change, field, '' as new_field from s where not exists (select 1 from ren where ren.feed = s.feed and ren.ord = s.ord and ren.new_field = s.field)
  union all select feed, ord, 'removed', field, '' from e where not exists (select 1 from ren where ren.feed = e.feed and ren.ord = e.ord and ren.field = e.field)
  union all select feed, ord, 'renamed', field, new_field from ren union all select feed, ord, 'retyped', field, '' from old where before <> t)
select feed, file_no, change, field, new_field from log join files using (feed, ord)""",
    "p7_values": _DRIFT.replace("with raw", "with recursive raw", 1) + r"""
spans as (select feed, field, island, min(ord) as a, max(ord) as b from ty group by all),
way as (select feed, field, island, field as name, a as since from spans
  union all select w.feed, w.field, w.island, o.field, o.a from way w join ren r on r.feed = w.feed and r.ord = w.since and r.new_field = w.name join spans o on o.feed = r.feed and o.field = r.field and o.b = r.ord - 1),
first_name as (select feed, field, island, arg_min(name, since) as name from way group by all),
given as (select ty.feed, ty.file_no, ty.field, fn.name, coalesce(ty.t, q.t) as t from ty join first_name fn using (feed, field, island) join spans s using (feed, field, island)
  left join ren on ren.feed = ty.feed and ren.ord = s.a and ren.new_field = ty.field left join tn q on q.feed = ty.feed and q.ord = s.a - 1 and q.field = ren.field),
kinds as (select name, t, count(*) as n from given where t is not null group by all),
best as (select name, first(t order by n desc, case t when 'string' then 1 when 'number' then 2 when 'boolean' then 3 when 'array' then 4 else 5 end) as t from kinds group by all),
whole as (select r.feed, r.file_no, r.line_no, k as field, json_type(payload, '$."' || k || '"') as jt, json_extract_string(payload, '$."' || k || '"') as v from (select *, unnest(json_keys(payload)) as k from rawrecords where json_valid(payload) and json_type(payload::json) = 'OBJECT') r)
select w.feed, w.file_no, w.line_no, g.name, coalesce(b.t, 'string') as type, case when w.jt = 'OBJECT' then array_to_string(list_sort(json_keys(w.v)), ',') when w.jt <> 'NULL' then w.v end as value,
  case when w.jt = 'NULL' or coalesce(b.t, 'string') = 'string' then true when b.t = 'number' then regexp_matches(w.v, '^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$') when b.t = 'boolean' then lower(w.v) in ('true', 'false')
  else case w.jt when 'ARRAY' then 'array' when 'OBJECT' then 'object' else '' end = b.t end as fits
from whole w join given g on g.feed = w.feed and g.file_no = w.file_no and g.field = w.field left join best b on b.name = g.name""",
}
