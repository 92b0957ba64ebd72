"""Jobs over append-only logs of initiative events: state, history, diffs, patches, undo, integrity.

A log row has initiative_id, sequence, type, payload (JSON), occurred_at, actor_user_id, command_id and suggestion_id.
State values are kept as strings (JSON text for anything but strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The status machine, the lifecycle field of a status, the release field of a date type.
TRANSITIONS = {
    "draft": ["proposed"],
    "proposed": ["approved", "cancelled"],
    "approved": ["in_progress", "cancelled"],
    "in_progress": ["blocked", "released", "cancelled"],
    "blocked": ["in_progress", "cancelled"],
    "released": ["completed", "cancelled"],
    "completed": ["archived"],
    "cancelled": ["archived"],
    "archived": [],
}
LIFECYCLE = {"proposed": "proposedAt", "approved": "approvedAt", "in_progress": "startedAt", "blocked": "blockedAt", "released": "releasedAt", "completed": "completedAt", "cancelled": "cancelledAt", "archived": "archivedAt"}
RELEASE = {"target": "releaseTargetDate", "windowStart": "releaseWindowStart", "windowEnd": "releaseWindowEnd"}
CREATED = ["slug", "title", "description", "status", "ownerUserId"]
PLAIN = ["businessUnit", "goal", "integrationHints", "priority", "productArea", "quarter", "releaseNotes", "riskLevel", "scope", "sponsorUserId", "successMetrics", "tags", "teamId"]
FIELDS = sorted([*CREATED, *PLAIN, *LIFECYCLE.values(), *RELEASE.values()])
SILENT = ["SuggestionApplied", "SuggestionFailed", "SuggestionUndoApplied"]
FIELD, STATUS, DATE, NEW = "InitiativeFieldUpdated", "InitiativeStatusChanged", "ReleaseDateChanged", "InitiativeCreated"


def allowed_next(status: Column) -> Column:
    pairs = [x for s, nexts in TRANSITIONS.items() for x in (F.lit(s), F.array(*map(F.lit, nexts)).cast("array<string>"))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), status), F.array().cast("array<string>"))


def valid_transition(old: Column, new: Column) -> Column:
    return F.coalesce(F.array_contains(allowed_next(old), new), F.lit(False))


def parsed(events: DataFrame) -> DataFrame:
    j = lambda k: F.get_json_object("payload", f"$.{k}")
    names = {"p_field": "field", "p_new": "newValue", "p_old": "oldValue", "p_status": "newStatus", "p_date_type": "dateType", "p_date": "newDate"}
    return events.withColumns({c: j(k) for c, k in names.items()} | {f"c_{k}": j(k) for k in CREATED} | {"at_ms": F.unix_millis(F.col("occurred_at").cast("timestamp"))})


def _writes(field: str) -> tuple[Column, Column]:
    """Whether an event writes the field, and what: a set date of 0 or null clears."""
    t = F.col("type")
    when, value = (t == FIELD) & (F.col("p_field") == field), F.when(t == FIELD, F.col("p_new"))
    if field in CREATED:
        when, value = when | (t == NEW), value.when(t == NEW, F.col(f"c_{field}"))
    if field == "status":
        when, value = when | (t == STATUS), value.when(t == STATUS, F.col("p_status"))
    for s, f in LIFECYCLE.items():
        if f == field:
            when, value = when | ((t == STATUS) & (F.col("p_status") == s)), value.when(t == STATUS, F.col("at_ms").cast("string"))
    for d, f in RELEASE.items():
        if f == field:
            when, value = when | ((t == DATE) & (F.col("p_date_type") == d)), value.when(t == DATE, F.nullif("p_date", F.lit("0")))
    return when, value


CHANGES = [NEW, FIELD, STATUS, DATE]


def fold(events: DataFrame, by: tuple[str, ...] = ("initiative_id",), fields: list[str] | None = None) -> DataFrame:
    """Current state of every initiative: for each field the value of its last write since the last creation.

    max_by is algebraic, so logs shrink before they move, and a hot initiative needs no ordered pass. Unknown types write
    nothing and do not move the version; initiatives without a creation have no state.
    """
    fields = fields or FIELDS
    aggs = []
    for f in fields:
        when, value = _writes(f)
        seq = F.when(when, F.col("sequence"))
        aggs.append(F.max_by(F.struct(value.alias("v"), F.col("sequence").alias("s")), seq).alias(f))
    created = F.when(F.col("type") == NEW, F.col("sequence"))
    g = parsed(events).groupBy(*by).agg(
        *aggs,
        F.max(created).alias("created_seq"),
        F.max_by("at_ms", created).alias("createdAt"),
        F.max_by("at_ms", F.when(F.col("type").isin(CHANGES), F.col("sequence"))).alias("updatedAt"),
        F.max(F.when(F.col("type").isin(CHANGES + SILENT), F.col("sequence"))).alias("currentVersion"),
    )
    g = g.where("created_seq is not null")
    return g.select(*by, *(F.when(F.col(f)["s"] >= F.col("created_seq"), F.col(f)["v"]).alias(f) for f in fields), "createdAt", "updatedAt", "currentVersion")


def long_state(state: DataFrame, fields: list[str] | None = None) -> DataFrame:
    fields = fields or FIELDS
    return state.select("initiative_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select("initiative_id", "x.field", "x.value")


def state_as_of(events: DataFrame, version: int | None = None, time: str | None = None) -> DataFrame:
    if version is not None:
        events = events.where(F.col("sequence") <= version)
    if time is not None:
        events = events.where(F.col("occurred_at") <= F.lit(time).cast("timestamp"))
    return fold(events)


def states_at(events: DataFrame, cuts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """State at many cut-offs (initiative_id, cut) in one pass."""
    return fold(events.join(cuts, "initiative_id").where(F.col("sequence") <= F.col("cut")), ("initiative_id", "cut"), fields)


def version_diff(events: DataFrame, start: int, end: int) -> DataFrame:
    """Fields whose value differs between two versions, for every initiative that has both."""
    a, b = (long_state(fold(events.where(F.col("sequence") <= v))) for v in (start, end))
    both = a.withColumnRenamed("value", "from_value").join(b.withColumnRenamed("value", "to_value"), ["initiative_id", "field"], "full")
    return both.where(~F.col("from_value").eqNullSafe(F.col("to_value")))


def snapshots(events: DataFrame, every: int, fields: list[str] | None = None) -> DataFrame:
    """State at each version that `every` divides, in one running pass by initiative."""
    fields = fields or FIELDS
    era = F.sum(F.when(F.col("type") == NEW, 1).otherwise(0)).over(Window.partitionBy("initiative_id").orderBy("sequence"))
    e = parsed(events).withColumn("era", era).where("era > 0")
    w = Window.partitionBy("initiative_id", "era").orderBy("sequence")
    cols = []
    for f in fields:
        when, value = _writes(f)
        cols.append(F.last(F.when(when, F.struct(value.alias("v"))), ignorenulls=True).over(w)["v"].alias(f))
    return e.select("initiative_id", F.col("sequence").alias("version"), *cols).where(F.col("version") % every == 0)


def fold_from(snapshot: DataFrame, events: DataFrame, fields: list[str]) -> DataFrame:
    """State from a snapshot per initiative (initiative_id, version, fields) and the events after it."""
    tail = events.join(snapshot.select("initiative_id", "version"), "initiative_id").where(F.col("sequence") > F.col("version"))
    aggs = []
    for f in fields:
        when, value = _writes(f)
        aggs.append(F.max_by(F.struct(value.alias("v")), F.when(when, F.col("sequence"))).alias(f"n_{f}"))
    new = parsed(tail).groupBy("initiative_id").agg(*aggs)
    out = snapshot.join(new, "initiative_id", "left")
    return out.select("initiative_id", *(F.when(F.col(f"n_{f}").isNotNull(), F.col(f"n_{f}")["v"]).otherwise(F.col(f)).alias(f) for f in fields))


def changes_to(state: DataFrame, desired: DataFrame, fields: list[str]) -> DataFrame:
    """One field event for each field of `desired` that differs."""
    a, b = long_state(state, fields).withColumnRenamed("value", "old_value"), long_state(desired, fields).withColumnRenamed("value", "new_value")
    return b.join(a, ["initiative_id", "field"]).where(~F.col("old_value").eqNullSafe(F.col("new_value"))).withColumn("type", F.lit(FIELD))


OPERATIONS = "array<struct<op:string,path:string,`from`:string,value:string>>"


def validate_patches(patches: DataFrame, state: DataFrame, fields: list[str]) -> DataFrame:
    """suggestion_id, initiative_id, valid, conflicts. A patch with any conflict fails as a whole."""
    ops = patches.select("suggestion_id", "initiative_id", F.explode(F.from_json("operations", OPERATIONS)).alias("o"))
    ops = ops.select("suggestion_id", "initiative_id", "o.op", "o.path", F.col("o.from").alias("expected"), "o.value", pointer_field(F.col("o.path")).alias("field"))
    now = ops.join(long_state(state, fields).withColumnRenamed("value", "current"), ["initiative_id", "field"], "left")
    replace = F.col("op") == "replace"
    stale = replace & ~F.col("current").eqNullSafe(F.col("expected"))
    bad_status = replace & (F.col("path") == "/status") & ~valid_transition(F.col("current"), F.col("value"))
    found = F.when(stale, F.concat(F.lit("conflict:"), "path")).when(bad_status, F.concat(F.lit("transition:"), "path"))
    g = now.withColumn("found", found).groupBy("suggestion_id", "initiative_id")
    return g.agg(F.max(F.col("found").isNotNull()).alias("bad"), F.array_join(F.array_sort(F.collect_set("found")), ",").alias("conflicts")).select("suggestion_id", "initiative_id", (~F.col("bad")).alias("valid"), "conflicts")


def pointer_field(path: Column) -> Column:
    """The field that a JSON pointer of one step names."""
    return F.replace(F.replace(F.substring(path, 2, 1 << 20), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def patch_events(patches: DataFrame, checked: DataFrame) -> DataFrame:
    """Events of the valid patches, one patch for each initiative: the first by created_at; others wait."""
    first = F.row_number().over(Window.partitionBy("initiative_id").orderBy("created_at", "suggestion_id"))
    go = patches.join(checked.where("valid").select("suggestion_id"), "suggestion_id", "left_semi").withColumn("nth", first).where("nth = 1")
    ops = go.select("initiative_id", "suggestion_id", F.posexplode(F.from_json("operations", OPERATIONS)).alias("i", "o"))
    kind = F.when(F.col("o.path") == "/status", STATUS).otherwise(FIELD)
    rows = ops.select("initiative_id", "suggestion_id", (F.col("i") + 1).alias("nth"), kind.alias("type"), pointer_field(F.col("o.path")).alias("field"), F.col("o.value").alias("new_value"))
    head = go.select("initiative_id", "suggestion_id", F.lit(0).alias("nth"), F.lit("SuggestionApplied").alias("type"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("new_value"))
    return head.unionByName(rows)


def build_operations(changes: DataFrame) -> DataFrame:
    """JSON operations of each initiative's field changes (initiative_id, field, old_value, new_value)."""
    op = F.when(F.col("old_value").isNull(), F.lit("add")).otherwise(F.lit("replace"))
    item = F.struct(op.alias("op"), F.concat(F.lit("/"), "field").alias("path"), F.col("old_value").alias("from"), F.col("new_value").alias("value"))
    return changes.groupBy("initiative_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("field", item.alias("o"))))["o"]).alias("operations"))


def undo_events(events: DataFrame) -> DataFrame:
    """Compensating events, newest first, of those that can be undone and are not undone yet."""
    e = parsed(events).withColumns({"undo_of": F.get_json_object("payload", "$.undoOfEventId"), "p_old_status": F.get_json_object("payload", "$.oldStatus"), "p_old_date": F.get_json_object("payload", "$.oldDate")})
    done = e.where("undo_of is not null").select("initiative_id", F.col("undo_of").cast("bigint").alias("sequence")).distinct()
    todo = e.where(F.col("type").isin(FIELD, STATUS, DATE)).join(done, ["initiative_id", "sequence"], "left_anti")
    t = F.col("type")
    pick = lambda a, b, c: F.when(t == FIELD, a).when(t == STATUS, b).otherwise(c)
    back = F.row_number().over(Window.partitionBy("initiative_id").orderBy(F.desc("sequence")))
    return todo.select(
        "initiative_id", F.col("sequence").alias("undoes"), "type", pick(F.col("p_field"), F.lit("status"), F.col("p_date_type")).alias("field"),
        pick(F.col("p_new"), F.col("p_status"), F.col("p_date")).alias("old_value"), pick(F.col("p_old"), F.col("p_old_status"), F.col("p_old_date")).alias("new_value"),
        (t == FIELD).alias("undo_tracked"), back.alias("nth"),
    )


def integrity(events: DataFrame) -> DataFrame:
    """Gaps, duplicates and events before the creation, by initiative."""
    w = Window.partitionBy("initiative_id").orderBy("sequence")
    e = events.withColumn("step", F.col("sequence") - F.lag("sequence").over(w))
    created = F.min(F.when(F.col("type") == NEW, F.col("sequence")))
    g = e.groupBy("initiative_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"),
                                       F.count_if(F.col("step") > 1).alias("gaps"), F.count_if(F.col("step") == 0).alias("duplicates"), created.alias("created_at_sequence"))
    return g.withColumn("ok", (F.col("gaps") == 0) & (F.col("duplicates") == 0) & F.coalesce(F.col("created_at_sequence") == F.col("first_sequence"), F.lit(False)))


def quarantine(events: DataFrame) -> DataFrame:
    """Events that come before their initiative's first creation, or have none."""
    first = events.where(F.col("type") == NEW).groupBy("initiative_id").agg(F.min("sequence").alias("c"))
    return events.join(first, "initiative_id", "left").where(F.col("c").isNull() | (F.col("sequence") < F.col("c"))).drop("c")


def audit_trail(events: DataFrame, start: str | None = None, end: str | None = None, types: list[str] | None = None, actor: str | None = None) -> DataFrame:
    if start:
        events = events.where(F.col("occurred_at") >= F.lit(start).cast("timestamp"))
    if end:
        events = events.where(F.col("occurred_at") <= F.lit(end).cast("timestamp"))
    if types:
        events = events.where(F.col("type").isin(types))
    return events.where(F.col("actor_user_id") == actor) if actor else events


def event_range(events: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Closed on both ends."""
    if first is not None:
        events = events.where(F.col("sequence") >= first)
    return events if last is None else events.where(F.col("sequence") <= last)


def listing(state: DataFrame, statuses: list[str], limit: int) -> DataFrame:
    return state.where(F.col("status").isin(statuses)).orderBy(F.desc("createdAt"), "initiative_id").limit(limit)


def threads(comments: DataFrame, include_resolved: bool = False) -> DataFrame:
    """Root comments that are not deleted, each with its replies in order."""
    live = comments.where(~F.coalesce("is_deleted", F.lit(False)))
    roots = live.where("parent_id is null")
    if not include_resolved:
        roots = roots.where(~F.coalesce("is_resolved", F.lit(False)))
    replies = live.where("parent_id is not null").groupBy(F.col("parent_id").alias("comment_id")).agg(F.array_sort(F.collect_list(F.struct("created_at", F.col("comment_id").alias("id")))).alias("r"))
    out = roots.join(replies, "comment_id", "left")
    return out.select("comment_id", "initiative_id", F.coalesce(F.array_join(F.transform("r.id", lambda x: x.cast("string")), ","), F.lit("")).alias("reply_ids"), F.coalesce(F.size("r"), F.lit(0)).alias("n_replies"))


def who_changed_what(events: DataFrame) -> DataFrame:
    e = parsed(events).withColumn("actor", F.coalesce(F.nullif("actor_user_id", F.lit("")), F.lit("system")))
    field = F.when(F.col("type") == FIELD, F.col("p_field"))
    per = e.groupBy("actor", field.alias("field")).agg(F.count(F.lit(1)).alias("n"), F.max("occurred_at").alias("last"))
    named = F.when(F.col("field").isNotNull(), F.concat_ws(":", "field", F.col("n").cast("string")))
    return per.groupBy("actor").agg(F.sum("n").alias("total_changes"), F.array_join(F.array_sort(F.collect_list(named)), ",").alias("field_changes"), F.max("last").alias("last_change_at"))


def suggestion_impact(events: DataFrame) -> DataFrame:
    e = parsed(events.where("suggestion_id is not null"))
    change = F.when(F.col("type") == FIELD, F.struct("sequence", F.col("p_field").alias("field"), F.col("p_new").alias("value"))).when(F.col("type") == STATUS, F.struct("sequence", F.lit("status").alias("field"), F.col("p_status").alias("value")))
    return e.groupBy("suggestion_id").agg(F.count(F.lit(1)).alias("event_count"), F.array_sort(F.collect_list(change)).alias("changes")).withColumn("n_changes", F.size("changes"))


def once_per_command(events: DataFrame, batch: str = "global_sequence") -> DataFrame:
    """Events of a command's first batch: rows whose batch number is the command's smallest."""
    first = events.groupBy("command_id").agg(F.min(batch).alias("first_batch"))
    return events.join(first, "command_id").where(F.col(batch) == F.col("first_batch")).drop("first_batch")


def transition_audit(events: DataFrame) -> DataFrame:
    """Every status written, with the one before it and whether the step is allowed."""
    status = F.when(F.col("type") == STATUS, F.col("p_status")).when(F.col("type") == NEW, F.col("c_status")).when((F.col("type") == FIELD) & (F.col("p_field") == "status"), F.col("p_new"))
    e = parsed(events).withColumn("new_status", status).where("new_status is not null")
    old = F.lag("new_status").over(Window.partitionBy("initiative_id").orderBy("sequence"))
    e = e.withColumn("old_status", old)
    return e.where(F.col("type") != NEW).select("initiative_id", "sequence", "old_status", "new_status", valid_transition(F.col("old_status"), F.col("new_status")).alias("valid"))


def field_history(events: DataFrame) -> DataFrame:
    e = parsed(events.where(F.col("type") == FIELD))
    before = F.lag("p_new").over(Window.partitionBy("initiative_id", "p_field").orderBy("sequence"))
    return e.select("initiative_id", F.col("p_field").alias("field"), "sequence", "occurred_at", F.col("p_old").alias("old_value"), F.col("p_new").alias("new_value"), before.alias("previous_value"),
                    F.get_json_object("payload", "$.undoOfEventId").alias("undo_of"))


def time_in_status(events: DataFrame, as_of: str) -> DataFrame:
    """Days from each status to the next one, or to as_of."""
    status = F.when(F.col("type") == STATUS, F.get_json_object("payload", "$.newStatus")).when(F.col("type") == NEW, F.get_json_object("payload", "$.status"))
    e = events.withColumn("status", status).where("status is not null")
    until = F.lead("occurred_at").over(Window.partitionBy("initiative_id").orderBy("sequence"))
    e = e.withColumn("until", F.coalesce(until, F.lit(as_of).cast("timestamp")))
    return e.select("initiative_id", "sequence", "status", F.datediff("until", "occurred_at").alias("days"))


def canonical_json(state: DataFrame) -> DataFrame:
    """State as JSON with sorted keys; missing and falsy values are null."""
    plain = {*CREATED[:4]}
    cols = [F.col(f) if f in plain else F.nullif(F.nullif(F.col(f), F.lit("")), F.lit("0")).alias(f) for f in FIELDS]
    cols += [F.col("createdAt").cast("string").alias("createdAt"), F.col("updatedAt").cast("string").alias("updatedAt")]
    names = sorted([*FIELDS, "createdAt", "updatedAt"])
    by = dict(zip([*FIELDS, "createdAt", "updatedAt"], cols, strict=True))
    return state.select("initiative_id", F.to_json(F.struct(*(by[n].alias(n) for n in names)), {"ignoreNullFields": "false"}).alias("canonical"))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
