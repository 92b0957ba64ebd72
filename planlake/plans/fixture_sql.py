"""The derived planning tables in DuckDB's SQL."""

from __future__ import annotations

from planlake.sources.fixtures import BELIEF_SENTENCES, CUT_TO, DISMISS_REASONS, HEADINGS, PLANTED, SENTENCES, STATUSES


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_PLACE = f"(doc_id * 7 + (i - 1) * 13 + length(x)) % {len(PLANTED)}"
VIEWS = {
    "minutes": f"""
select 'd' || doc_id as note_id, doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
  ({_list([a for a, _ in PLANTED])})[{_PLACE} + 1] || case when {_PLACE} < 8 then substr(x, 1, {CUT_TO}) else x end || ({_list([b for _, b in PLANTED])})[{_PLACE} + 1]), chr(10)) as body
from documents""",
    "suggestion_events": f"""
select event_id, 'n' || user_id as note_id, 's' || user_id || '_' || (k % 7) as suggestion_id, kind as event_type, ts as created_at,
  case when user_id % 5 <> 0 then 't' || (user_id % 5) end as team_id,
  case when event_id % 4 = 0 then null when event_id % 97 = 0 then '' else 'surface' || (event_id % 4) end as ui_surface,
  case k % 5 when 1 then 'idea' when 2 then 'project_update' when 3 then 'risk' when 4 then 'bug' end as suggestion_family,
  case when k % 11 <> 0 then 'rule' || (k % 20) end as rule_or_prompt_id,
  case event_id % 17 when 0 then true when 1 then false end as exclude_from_metrics,
  case when kind = 'dismissed' and event_id % 9 <> 0 then ({_list(DISMISS_REASONS)})[event_id % 9] end as dismiss_reason,
  case when kind = 'applied' and event_id % 2 = 0 then value end as self_reported_time_saved_minutes,
  case when kind in ('applied', 'dismissed') and event_id % 5 <> 0 then event_id % 600 end as time_to_event_seconds
from (select *, cast(props::json ->> '$.k' as int) as k, case event_type when 'signup' then 'generated' when 'view' then 'shown' when 'purchase' then 'applied'
  when 'error' then 'dismissed' else case when event_id % 3 = 0 then 'clarification_answered' else 'clarification_requested' end end as kind from events)""",
    "suggestions": """
select suggestion_id, note_id, created_at, coalesce(status, 'new') as status, rule_or_prompt_id, suggestion_family,
  case when m % 6 = 0 then null when m % 6 = 1 then 0.0::double else (m % 100) / 100.0::double end as model_confidence_score,
  (['none', 'suggested', 'requested', 'answered'])[m % 4 + 1] as clarification_state, m % 10 = 0 as regenerated,
  case when u % 23 = 0 then true end as invalidated_by_note_deletion,
  case when status = 'applied' and u % 3 <> 0 then 'i' || (u % 12) end as initiative_id, m % 3 as note_version_at_creation, u % 3 as note_updated_at
from (select suggestion_id, note_id, substr(note_id, 2)::bigint as u, min(created_at) as created_at, min(event_id) as m,
  (array_agg(event_type order by created_at desc, event_id desc) filter (where event_type in ('applied', 'dismissed')))[1] as status,
  (array_agg(rule_or_prompt_id order by created_at, event_id))[1] as rule_or_prompt_id, (array_agg(suggestion_family order by created_at, event_id))[1] as suggestion_family
  from suggestion_events group by all)""",
    "event_notes": """
select 'n' || user_id as note_id, case when user_id % 2 = 1 then 'Note ' || user_id end as title, 'Notes of the weekly planning meeting of group ' || user_id as body,
  timestamp '2024-01-01' + to_days((user_id % 30)::int) as created_at, case when user_id % 29 = 0 then true end as is_deleted
from (select distinct user_id from events)""",
    "notes": f"""
select 'd' || doc_id as note_id, case when doc_id % 2 <> 0 then substr(text, 1, 40) end as title,
  text || chr(10) || chr(10) || '## ' || ({_list(HEADINGS)})[doc_id % 8 + 1] || chr(10) || ({_list(SENTENCES)})[doc_id % 16 + 1] || chr(10) || '- ' || ({_list(SENTENCES)})[(doc_id + 5) % 16 + 1]
  || chr(10) || '- ' || ({_list(SENTENCES)})[(doc_id + 9) % 16 + 1] as body,
  timestamp '2024-01-01' + to_days((doc_id % 30)::int) as created_at, case when doc_id % 29 = 0 then true end as is_deleted, doc_id
from documents""",
    "minute_initiatives": "select 'INI-' || (doc_id // 50 + 1) as initiative_id, substr(text, 1, (1 + doc_id // 50 * 7 % 40)::int) as title from documents where doc_id % 50 = 0",
    "initiatives": """
select 'i' || (doc_id // 50 + 1) as initiative_id, substr(body, 1, 40) as title, body as description, (['draft', 'active', 'done'])[doc_id % 3 + 1] as status, created_at
from notes where doc_id % 50 = 0""",
    "initiative_events": f"""
select 'i' || o_custkey as initiative_id, sequence, type,
  case type when 'InitiativeCreated' then '{{"slug":"s' || o_custkey || '","title":"Title ' || o_custkey || '","description":"About ' || o_custkey || '","status":"draft"}}'
    when 'InitiativeFieldUpdated' then '{{"field":"' || (['title', 'priority', 'scope'])[o_orderkey % 3 + 1] || '","oldValue":null,"newValue":' || case when o_orderkey % 13 = 0 then 'null' else '"' || o_orderpriority || '"' end || '}}'
    when 'InitiativeStatusChanged' then '{{"newStatus":"' || ({_list(STATUSES)})[o_orderkey % 9 + 1] || '"}}'
    when 'ReleaseDateChanged' then '{{"dateType":"' || (['target', 'windowStart', 'windowEnd'])[o_orderkey % 3 + 1] || '","newDate":' || case when o_orderkey % 5 = 0 then 'null' else epoch_ms(o_orderdate::timestamp)::varchar end || '}}'
    else '{{}}' end as payload,
  o_orderdate::timestamp as occurred_at, case when o_orderkey % 7 <> 0 then o_orderpriority end as actor_user_id, 'ui' as origin, 'c' || o_orderkey as command_id, 'w' || o_custkey as correlation_id,
  case when type = 'SuggestionApplied' then 'is' || o_orderkey end as suggestion_id, o_orderkey as order_key
from (select *, case when sequence = 1 then 'InitiativeCreated' when o_orderkey % 6 < 2 then 'InitiativeFieldUpdated' when o_orderkey % 6 = 2 then 'InitiativeStatusChanged'
    when o_orderkey % 6 = 3 then 'ReleaseDateChanged' when o_orderkey % 6 = 4 then 'SuggestionApplied' else 'InitiativeCommentAdded' end as type
  from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as sequence from orders))""",
    "decisions": r"""
select note_id, suggestion_key, status, updated_at, initiative_id, 'not_relevant' as dismiss_reason from (
  select note_id, suggestion_id as suggestion_key, status, created_at as updated_at, initiative_id from suggestions where status <> 'new'
  union all select note_id, suggestion_id, case status when 'applied' then 'dismissed' else 'applied' end, created_at + interval 1 hour, 'i99' from suggestions where status <> 'new' and suggestion_id like '%\_3' escape '\')""",
    "meetings": f"""
select 'm' || conv_id as meeting_id, string_agg(regexp_replace(text, '\\s+', ' ', 'g') || ' ' || ({_list(BELIEF_SENTENCES)})[(conv_id + turn) % 8 + 1], chr(10) order by turn, text) as raw_markdown from conversations group by conv_id""",
    "feedback_events": """
select suggestion_id, action, created_at as timestamp, case when action = 'dismissed' then (['not_relevant', 'wrong_initiative', 'too_speculative', 'already_handled', 'spam', 'duplicate', 'other'])[event_id % 7 + 1] end as dismiss_reason,
  time_to_event_seconds as time_to_action_seconds, event_id
from (select *, case event_type when 'applied' then 'accepted' when 'dismissed' then 'dismissed' when 'clarification_answered' then 'edited' end as action from suggestion_events) where action is not null""",
}
NEEDS = {"suggestions": ["suggestion_events"], "initiatives": ["notes"], "decisions": ["suggestions"], "feedback_events": ["suggestion_events"]}


def over(views: str, body: str, **more: str) -> str:
    """body as SQL over the named derived tables; `more` adds tables of its own, in order."""
    names: list[str] = []

    def need(v: str) -> None:
        for x in NEEDS.get(v, []):
            need(x)
        if v not in names:
            names.append(v)

    for v in views.split():
        need(v)
    parts = [f"{v} as ({VIEWS[v]})" for v in names] + [f"{k} as ({v})" for k, v in more.items()]
    return f"with recursive {', '.join(parts)} {body}" if parts else body
