"""Queries over initiative event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlake.operators import eventlog as ev
from planlake.operators import merge as mg
from planlake.plans.fixture_sql import over
from planlake.plans.registry import query
from planlake.sources import fixtures as fx

SHOWN = ["title", "priority", "scope", "status", "releaseTargetDate", "releaseWindowStart", "releaseWindowEnd", "approvedAt", "archivedAt"]
_F, _S, _D, _N = "type = 'InitiativeFieldUpdated'", "type = 'InitiativeStatusChanged'", "type = 'ReleaseDateChanged'", "type = 'InitiativeCreated'"
P = "(payload::json)"


def _sql_field(f: str) -> str:
    """The value of the field's last write, as SQL."""
    cases, conds = [f"when {_F} then {P} ->> '$.newValue'"], [f"({_F} and {P} ->> '$.field' = '{f}')"]
    if f in ev.CREATED:
        cases.append(f"when {_N} then {P} ->> '$.{f}'")
        conds.append(_N)
    if f == "status":
        cases.append(f"when {_S} then {P} ->> '$.newStatus'")
        conds.append(_S)
    for s, x in ev.LIFECYCLE.items():
        if x == f:
            cases.append(f"when {_S} then epoch_ms(occurred_at)::varchar")
            conds.append(f"({_S} and {P} ->> '$.newStatus' = '{s}')")
    for t, x in ev.RELEASE.items():
        if x == f:
            cases.append(f"when {_D} then nullif({P} ->> '$.newDate', '0')")
            conds.append(f"({_D} and {P} ->> '$.dateType' = '{t}')")
    return f"(array_agg(case {' '.join(cases)} end order by sequence desc) filter (where {' or '.join(conds)}))[1] as \"{f}\""


VERSION = "max(sequence) filter (where type <> 'InitiativeCommentAdded') as \"currentVersion\""


def fold_sql(where: str = "true", by: str = "initiative_id", source: str = "initiative_events", fields: list[str] = SHOWN) -> str:
    return f"select {by}, {', '.join(map(_sql_field, fields))}, {VERSION} from {source} where {where} group by {by}"


def _log(spark, d):
    return fx.initiative_events(spark, d)


@query("e01_fold", over("initiative_events", fold_sql()))
def _(spark, d):
    return ev.fold(_log(spark, d)).select("initiative_id", *SHOWN, "currentVersion")


@query("e02_state_as_of_version", over("initiative_events", fold_sql("sequence <= 5")))
def _(spark, d):
    return ev.state_as_of(_log(spark, d), version=5).select("initiative_id", *SHOWN, "currentVersion")


@query("e02_state_as_of_time", over("initiative_events", fold_sql("occurred_at <= timestamp '1996-06-30'")))
def _(spark, d):
    return ev.state_as_of(_log(spark, d), time="1996-06-30").select("initiative_id", *SHOWN, "currentVersion")


@query("e02_states_at_cuts", over("initiative_events", fold_sql("sequence <= cut", "initiative_id, cut", "(select * from initiative_events, (select unnest([3, 6, 9]) as cut))")))
def _(spark, d):
    e = _log(spark, d)
    cuts = e.select("initiative_id").distinct().withColumn("cut", F.explode(F.array(*map(F.lit, (3, 6, 9)))))
    return ev.states_at(e, cuts, SHOWN).select("initiative_id", "cut", *SHOWN, "currentVersion")


LONG = "select initiative_id, unnest([" + ", ".join(f"'{f}'" for f in SHOWN) + "]) as field, unnest([" + ", ".join(f'"{f}"' for f in SHOWN) + "]) as value from "


@query(
    "e03_version_diff",
    over("initiative_events", "select initiative_id, field, a.value as from_value, b.value as to_value from a full join b using (initiative_id, field) where a.value is distinct from b.value", a=f"{LONG} ({fold_sql('sequence <= 3')})", b=f"{LONG} ({fold_sql('sequence <= 8')})"),
)
def _(spark, d):
    return ev.version_diff(_log(spark, d), 3, 8).where(F.col("field").isin(SHOWN))


@query("e04_snapshots", over("initiative_events", f"select initiative_id, cut as version, {', '.join(chr(34) + f + chr(34) for f in SHOWN)} from ({fold_sql('sequence <= cut', 'initiative_id, cut', '(select e.*, c.cut from initiative_events e join (select initiative_id, sequence as cut from initiative_events where sequence % 5 = 0) c using (initiative_id))')})"))
def _(spark, d):
    return ev.snapshots(_log(spark, d), 5, SHOWN)


@query("e04_fold_from_snapshot", over("initiative_events", f"select initiative_id, {', '.join(chr(34) + f + chr(34) for f in SHOWN)} from ({fold_sql('n >= 5', source='(select *, max(sequence) over (partition by initiative_id) as n from initiative_events)')})"))
def _(spark, d):
    e = _log(spark, d)
    snap = ev.snapshots(e.where("sequence <= 5"), 5, SHOWN)
    return ev.fold_from(snap, e, SHOWN)


PATCH = f"""select 'p' || initiative_id as suggestion_id, initiative_id, c, priority, status, timestamp '2024-03-01' as created_at from (select *, substr(initiative_id, 2)::bigint as c from ({fold_sql(fields=['priority', 'status'])}))"""
STALE = "(c % 8 = 0 and 'stale' is distinct from priority)"
BAD = "(c % 12 = 0 and not (status = 'draft'))"


def _patches(spark, d):
    s = ev.fold(_log(spark, d), fields=["priority", "status"]).withColumn("c", F.substring("initiative_id", 2, 20).cast("bigint"))
    op = lambda o, p, f, v: F.struct(F.lit(o).alias("op"), F.lit(p).alias("path"), f.alias("from"), F.lit(v).alias("value"))
    expected = F.when(F.col("c") % 8 == 0, "stale").otherwise(F.col("priority"))
    two = F.array(op("replace", "/priority", expected, "p1"), op("add", "/goal", F.lit(None).cast("string"), "g"))
    ops = F.when(F.col("c") % 12 == 0, F.concat(two, F.array(op("replace", "/status", F.col("status"), "proposed")))).otherwise(two)
    return s.select(F.concat(F.lit("p"), "initiative_id").alias("suggestion_id"), "initiative_id", F.to_json(ops).alias("operations"), F.lit("2024-03-01").cast("timestamp").alias("created_at"))


@query(
    "e06_validate_patches",
    over("initiative_events", f"select suggestion_id, initiative_id, not ({STALE} or {BAD}) as valid, concat_ws(',', case when {STALE} then 'conflict:/priority' end, case when {BAD} then 'transition:/status' end) as conflicts from p", p=PATCH),
)
def _(spark, d):
    return ev.validate_patches(_patches(spark, d), ev.fold(_log(spark, d), fields=["priority", "status", "goal"]), ["priority", "status", "goal"])


@query(
    "e07_patch_events",
    over("initiative_events", f"select initiative_id, suggestion_id, nth, (['SuggestionApplied', 'InitiativeFieldUpdated', 'InitiativeFieldUpdated', 'InitiativeStatusChanged'])[nth + 1] as type, ([null, 'priority', 'goal', 'status'])[nth + 1] as field, ([null, 'p1', 'g', 'proposed'])[nth + 1] as new_value from p, (select unnest(range(0, 4)) as nth) where not ({STALE} or {BAD}) and (nth < 3 or c % 12 = 0)", p=PATCH),
)
def _(spark, d):
    p = _patches(spark, d)
    return ev.patch_events(p, ev.validate_patches(p, ev.fold(_log(spark, d), fields=["priority", "status", "goal"]), ["priority", "status", "goal"]))


CHANGE = f"select initiative_id, 'title' as field, title as old_value, 'New title' as new_value from ({fold_sql(fields=['title'])}) where title is distinct from 'New title' union all select initiative_id, 'priority', priority, case when substr(initiative_id, 2)::bigint % 3 = 0 then priority else '1-URGENT' end from ({fold_sql(fields=['priority'])}) where substr(initiative_id, 2)::bigint % 3 <> 0 and priority is distinct from '1-URGENT'"


def _changes(spark, d):
    s = ev.fold(_log(spark, d), fields=["title", "priority"])
    wish = s.withColumns({"title": F.lit("New title"), "priority": F.when(F.substring("initiative_id", 2, 20).cast("bigint") % 3 == 0, F.col("priority")).otherwise("1-URGENT")})
    return ev.changes_to(s, wish, ["title", "priority"])


@query("e05_change_events", over("initiative_events", CHANGE))
def _(spark, d):
    return _changes(spark, d).select("initiative_id", "field", "old_value", "new_value")


@query("e08_build_operations", over("initiative_events", "select initiative_id, count(*) as n_operations, sum((old_value is null)::int) as n_add from x group by 1", x=CHANGE))
def _(spark, d):
    b = ev.build_operations(_changes(spark, d)).withColumn("o", F.from_json("operations", ev.OPERATIONS))
    return b.select("initiative_id", F.size("o").cast("bigint").alias("n_operations"), F.size(F.filter("o", lambda x: x["op"] == "add")).cast("bigint").alias("n_add"))


@query("e09_undo", over("initiative_events", f"select initiative_id, sequence as undoes, type, case when {_F} then {P} ->> '$.field' when {_S} then 'status' else {P} ->> '$.dateType' end as field, case when {_F} then {P} ->> '$.newValue' when {_S} then {P} ->> '$.newStatus' else {P} ->> '$.newDate' end as old_value, null::varchar as new_value, {_F} as undo_tracked, row_number() over (partition by initiative_id order by sequence desc) as nth from initiative_events where {_F} or {_S} or {_D}"))
def _(spark, d):
    return ev.undo_events(_log(spark, d))


@query(
    "e10_integrity",
    over("initiative_events", "select initiative_id, count(*) as n_events, min(sequence) as first_sequence, max(sequence) as last_sequence, count(*) filter (where sequence - p > 1) as gaps, count(*) filter (where sequence = p) as duplicates, min(sequence) filter (where type = 'InitiativeCreated') as created_at_sequence, count(*) filter (where sequence - p > 1 or sequence = p) = 0 and coalesce(min(sequence) filter (where type = 'InitiativeCreated') = min(sequence), false) as ok from (select *, lag(sequence) over (partition by initiative_id order by sequence) as p from initiative_events where order_key % 37 <> 0) group by 1"),
)
def _(spark, d):
    return ev.integrity(_log(spark, d).where("order_key % 37 <> 0"))


@query("e10_quarantine", over("initiative_events", "select initiative_id, sequence, type from x where not exists (select 1 from x y where y.initiative_id = x.initiative_id and y.type = 'InitiativeCreated' and y.sequence <= x.sequence)", x="select * from initiative_events where order_key % 37 <> 0"))
def _(spark, d):
    return ev.quarantine(_log(spark, d).where("order_key % 37 <> 0")).select("initiative_id", "sequence", "type")


@query("s06_append", over("initiative_events", "select initiative_id, sequence, order_key, row_number() over (order by occurred_at, order_key) as global_sequence from initiative_events"))
def _(spark, d):
    """The whole log, numbered anew from an empty store."""
    e = _log(spark, d)
    stored = e.limit(0).withColumn("global_sequence", F.lit(0).cast("bigint"))
    new = e.drop("sequence")
    return mg.append_numbered(stored, new, "initiative_id", ["occurred_at", "order_key"]).select("initiative_id", "sequence", "order_key", "global_sequence")


@query("f06_audit_trail", over("initiative_events", "select initiative_id, sequence, type from initiative_events where occurred_at between timestamp '1995-01-01' and timestamp '1996-12-31' and type in ('InitiativeStatusChanged', 'ReleaseDateChanged') and actor_user_id = '2-HIGH'"))
def _(spark, d):
    return ev.audit_trail(_log(spark, d), "1995-01-01", "1996-12-31", [ev.STATUS, ev.DATE], "2-HIGH").select("initiative_id", "sequence", "type")


@query("f07_event_range", over("initiative_events", "select initiative_id, sequence, type from initiative_events where sequence between 3 and 6"))
def _(spark, d):
    return ev.event_range(_log(spark, d), 3, 6).select("initiative_id", "sequence", "type")


@query("f08_listing", over("initiatives", "select initiative_id, status from initiatives where status in ('draft', 'active') order by created_at desc, initiative_id limit 20"))
def _(spark, d):
    return ev.listing(fx.initiatives(spark, d).withColumnRenamed("created_at", "createdAt"), ["draft", "active"], 20).select("initiative_id", "status")


COMMENT = "select order_key as comment_id, initiative_id, occurred_at as created_at, order_key % 11 = 0 as is_deleted, order_key % 5 = 0 as is_resolved, case when nth > 1 then root end as parent_id from (select *, row_number() over (partition by initiative_id order by sequence) as nth, first_value(order_key) over (partition by initiative_id order by sequence) as root from initiative_events where type = 'InitiativeCommentAdded')"


@query(
    "f09_threads",
    over("initiative_events", "select r.comment_id, r.initiative_id, coalesce(x.ids, '') as reply_ids, coalesce(x.n, 0) as n_replies from c r left join (select parent_id, string_agg(comment_id, ',' order by created_at, comment_id) as ids, count(*) as n from c where parent_id is not null and not is_deleted group by 1) x on x.parent_id = r.comment_id where r.parent_id is null and not r.is_deleted and not r.is_resolved", c=COMMENT),
)
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("initiative_id").orderBy("sequence")
    c = _log(spark, d).where("type = 'InitiativeCommentAdded'").withColumns({"nth": F.row_number().over(w), "root": F.first("order_key").over(w)})
    k = F.col("order_key")
    c = c.select(k.alias("comment_id"), "initiative_id", F.col("occurred_at").alias("created_at"), (k % 11 == 0).alias("is_deleted"), (k % 5 == 0).alias("is_resolved"), F.when(F.col("nth") > 1, F.col("root")).alias("parent_id"))
    return ev.threads(c)


NEXT = " ".join(f"when '{s}' then '{','.join(n)}'" for s, n in ev.TRANSITIONS.items())
WAS = f"select initiative_id, sequence, type, lag(s) over (partition by initiative_id order by sequence) as old_status, s as new_status from (select *, case when {_S} then {P} ->> '$.newStatus' when {_N} then {P} ->> '$.status' end as s from initiative_events) where s is not null"


@query("f10_w08_transition_audit", over("initiative_events", f"select initiative_id, sequence, old_status, new_status, list_contains(string_split(case old_status {NEXT} end, ','), new_status) as valid from ({WAS}) where type <> 'InitiativeCreated'"))
def _(spark, d):
    return ev.transition_audit(_log(spark, d))


@query("f10_allowed_next", over("initiative_events", f"select initiative_id, status, case status {NEXT} end as allowed from ({fold_sql(fields=['status'])})"))
def _(spark, d):
    return ev.fold(_log(spark, d), fields=["status"]).select("initiative_id", "status", F.array_join(ev.allowed_next(F.col("status")), ",").alias("allowed"))


@query("j14_slug_duplicates", over("initiative_events", "select slug, count(*) as n from (select substr(initiative_id, 2)::bigint % 100 as slug from initiative_events where type = 'InitiativeCreated') group by 1 having count(*) > 1"))
def _(spark, d):
    s = ev.fold(_log(spark, d), fields=["slug"]).select((F.substring("slug", 2, 20).cast("bigint") % 100).alias("slug"))
    return ev.duplicates(s, ["slug"])


LINKS = "select 'i' || o_custkey as initiative_id, 'tracker' as system, (o_orderkey % 2000)::varchar as resource_id, o_orderdate as created_at, o_orderkey from orders"


@query("j13_link_duplicates", f"select system, resource_id, initiative_id, count(*) as n from ({LINKS}) group by all having count(*) > 1")
def _(spark, d):
    o = fx.table(spark, d, "orders")
    links = o.select(F.concat(F.lit("i"), F.col("o_custkey").cast("string")).alias("initiative_id"), F.lit("tracker").alias("system"), (F.col("o_orderkey") % 2000).cast("string").alias("resource_id"))
    return ev.duplicates(links, ["system", "resource_id", "initiative_id"])


@query("m16_who_changed_what", over("initiative_events", "select a.actor, a.n as total_changes, coalesce(f.s, '') as field_changes, a.last_change_at from (select actor, count(*) as n, max(occurred_at) as last_change_at from x group by 1) a left join (select actor, string_agg(f || ':' || n, ',' order by f || ':' || n) as s from (select actor, " + P + " ->> '$.field' as f, count(*) as n from x where " + _F + " group by 1, 2) group by 1) f using (actor)", x="select *, coalesce(actor_user_id, 'system') as actor from initiative_events"))
def _(spark, d):
    return ev.who_changed_what(_log(spark, d))


@query("m17_suggestion_impact", over("initiative_events", "select 'is' || order_key as suggestion_id, 1 as event_count, 0 as n_changes from initiative_events where type = 'SuggestionApplied'"))
def _(spark, d):
    return ev.suggestion_impact(_log(spark, d)).select("suggestion_id", "event_count", "n_changes")


@query("w03_once_per_command", over("initiative_events", "select command, order_key from (select 'c' || (order_key % 5000) as command, order_key, order_key = min(order_key) over (partition by order_key % 5000) as first_one from initiative_events) where first_one"))
def _(spark, d):
    e = _log(spark, d).withColumn("command_id", F.concat(F.lit("c"), (F.col("order_key") % 5000).cast("string")))
    return ev.once_per_command(e, "order_key").select(F.col("command_id").alias("command"), "order_key")


@query("w09_field_history", over("initiative_events", f"select initiative_id, {P} ->> '$.field' as field, sequence, occurred_at, null::varchar as old_value, {P} ->> '$.newValue' as new_value, lag({P} ->> '$.newValue') over (partition by initiative_id, {P} ->> '$.field' order by sequence) as previous_value, null::varchar as undo_of from initiative_events where {_F}"))
def _(spark, d):
    return ev.field_history(_log(spark, d))


@query("w10_time_in_status", over("initiative_events", f"select initiative_id, sequence, s as status, date_diff('day', occurred_at::date, coalesce(lead(occurred_at) over (partition by initiative_id order by sequence), timestamp '2000-01-01')::date) as days from (select *, case when {_S} then {P} ->> '$.newStatus' when {_N} then {P} ->> '$.status' end as s from initiative_events) where s is not null"))
def _(spark, d):
    return ev.time_in_status(_log(spark, d), "2000-01-01")


@query("w11_rate_limit", over("suggestion_events", "select event_id, coalesce(created_at - p < interval 1 hour, false) as blocked from (select *, lag(created_at) over (partition by note_id order by created_at, event_id) as p from suggestion_events)"))
def _(spark, d):
    """Runs that another run of the note came before by less than an hour."""
    from pyspark.sql import Window

    e = fx.suggestion_events(spark, d)
    p = F.lag("created_at").over(Window.partitionBy("note_id").orderBy("created_at", "event_id"))
    gap = F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.col("p").cast("timestamp"))
    return e.withColumn("p", p).select("event_id", F.coalesce(gap < 3_600_000_000, F.lit(False)).alias("blocked"))


@query("w12_latest_runs", over("suggestion_events", "select note_id, event_id, created_at from (select *, row_number() over (partition by note_id order by created_at desc, event_id desc) as r from suggestion_events) where r = 1"))
def _(spark, d):
    e = fx.suggestion_events(spark, d).groupBy("note_id").agg(F.max(F.struct("created_at", "event_id")).alias("x"))
    return e.select("note_id", "x.event_id", "x.created_at")


@query("t21_t22_canonical_state")
def _(spark, d):
    return ev.canonical_json(ev.fold(_log(spark, d)))
