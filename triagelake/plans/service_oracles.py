"""DuckDB SQL for the queries over requests, listings, the dashboard and small checks."""

from __future__ import annotations

from .. import fixed
from ..sources.tickets import GENERATED
from . import oracles as O  # noqa: E812, N812


_MATTERS = f"""matters as (
  select *, row_ord // 24 as block, case when {O._any("lower(ticket_text)", fixed.HINGLISH_PARTS)} then 'hinglish' when {O._any("lower(ticket_text)", fixed.GUJARATI_PARTS)} then 'gujarati' else 'english' end as lang from tickets
)"""
_CONSISTENT = f"""{O._BAYES}, {_MATTERS}, sums as (select ticket_id, label, sum(weight * logp) as s from weighted join likelihood using (term) group by 1, 2),
predicted as (select ticket_id, label as prediction from sums join priors using (label) qualify row_number() over (partition by ticket_id order by round(s + prior, 9) desc, label) = 1),
told as (select block, category, count(distinct lang) as languages, count(distinct prediction) = 1 as consistent, bool_and(prediction = category) as perfect from matters join predicted using (ticket_id) group by 1, 2 having count(distinct lang) >= 2)"""


def _text(body: str, name: str) -> str:
    """A text field of a body that is known to be JSON or null."""
    return f"case when json_type({body}, '$.{name}') = 'VARCHAR' then json_extract_string({body}, '$.{name}') end"


def _truth(body: str, default: int) -> str:
    kind, value = f"json_type({body}, '$.validated')", f"json_extract_string({body}, '$.validated')"
    return f"case when {kind} is null then {default} when {kind} = 'NULL' then 0 when {kind} = 'VARCHAR' then ({value} in ('1', 'true'))::int when {kind} = 'BOOLEAN' then ({value} = 'true')::int else ({value}::double = 1)::int end"


_BODY = """'{"ticket_text": "' || coalesce(ticket_text, '') || '"}'"""
TEXT_REQUESTS = f"""{O.RAW}, asked as (select row_ord, case when row_ord % 31 = 0 then null when row_ord % 29 = 0 then '[' || {_BODY} || ']' when row_ord % 23 = 0 then '{{"ticket_text": "cut'
  when row_ord % 19 = 0 then '{{"text": "x"}}' when row_ord % 17 = 0 then '{{"ticket_text": 17}}' else {_BODY} end as body from raw),
bodies as (select row_ord, case when json_valid(body) then body end as body from asked), texts as (select row_ord, {_text("body", "ticket_text")} as ticket_text from bodies)"""

_FLAGS = """['1', 'true', '"1"', '"true"', '0', 'false', '"yes"', 'null', '1.0']"""
FEEDBACK_REQUESTS = f"""{O.STORE}, asked as (select row_ord, case when row_ord % 37 = 0 then 'not json' else '{{"ticket_id": "'
  || case when row_ord % 13 = 0 then '  ' when row_ord % 11 = 0 then 'NONE-' || row_ord else ' TICK-' || row_ord end || '", "corrected_priority": " '
  || case when row_ord % 7 = 0 then 'Urgent' else ({O._list(fixed.PRIORITIES)})[row_ord % 4 + 1] end || '"'
  || case when row_ord % 2 = 0 then ', "validated": ' || ({_FLAGS})[row_ord % 9 + 1] else '' end
  || case when row_ord % 3 = 0 then ', "reviewer": "  "' when row_ord % 3 = 1 then ', "reviewer": "lead "' else '' end || '}}' end as body from raw),
bodies as (select row_ord, case when json_valid(body) then body end as body from asked),
fields as (select row_ord, coalesce(trim({_text("body", "ticket_id")}), '') as ticket_id, coalesce(trim({_text("body", "corrected_priority")}), '') as corrected_priority,
  coalesce(nullif(trim({_text("body", "reviewer")}), ''), 'agent') as reviewer, {_truth("body", 0)} as validated from bodies)"""

VALIDATION_REQUESTS = f"""{O.STORE}, asked as (select id * 2 + place as row_ord, '{{"feedback_id": "' || case when id % 7 = 0 then '' when id % 11 = 0 then 'FB-none' else feedback_id end || '"'
  || case when place = 1 then ', "validated": "true"' when id % 3 = 0 then ', "validated": 0' when id % 3 = 1 then ', "validated": true' else '' end || '}}' as body
  from (select *, unnest(range(0, case when id % 5 = 0 then 2 else 1 end)) as place from feedback)),
fields as (select row_ord, coalesce(trim({_text("body", "feedback_id")}), '') as feedback_id, {_truth("body", 1)} as flag from asked),
answered as (select f.*, case when f.feedback_id = '' then 400 when k.feedback_id is null then 404 else 200 end as status_code from fields f left join (select distinct feedback_id from feedback) k using (feedback_id))"""

ID_REQUESTS = f"""{O.STORE}, asked as (select row_ord * 2 + place as row_ord, case when row_ord % 41 = 0 then ' ' when row_ord % 43 = 0 then 'GONE-' || row_ord else ticket_id end as ticket_id
  from (select *, unnest(range(0, case when row_ord % 6 = 0 then 2 else 1 end)) as place from raw))"""
DELETED = f"""{ID_REQUESTS}, going as (select * from asked where ticket_id in (select ticket_id from kept where department = 'Refund Team') or trim(ticket_id) = '' or ticket_id like 'GONE-%'),
answered as (select row_ord, ticket_id, case when trim(ticket_id) = '' then 400 when ticket_id in (select ticket_id from kept) and row_ord = min(row_ord) over (partition by ticket_id) then 200 else 404 end as status_code from going),
stay as (select * from kept where ticket_id not in (select ticket_id from answered where status_code = 200))"""
ASSIGNED = f"""{ID_REQUESTS}, teams as (select department, list(id) as team from agents where is_active = 1 group by department),
own as (select k.ticket_id, k.department, k.assigned_agent_id, t.team from kept k left join teams t using (department)),
pairs as (select ticket_id, unnest(team) as a, assigned_agent_id from own), picked as (select ticket_id, min_by(a, md5(ticket_id || '|' || a)) as agent_id from pairs where a is distinct from assigned_agent_id group by ticket_id),
answered as (select q.row_ord, q.ticket_id, o.department, p.agent_id::bigint as agent_id, g.name, o.team is not null as staffed, o.ticket_id is not null as known
  from asked q left join own o using (ticket_id) left join picked p using (ticket_id) left join agents g on g.id = p.agent_id)"""


def _rule_signal() -> tuple[str, str]:
    return O._rule("text", O._s("Medium"), O._s("")), "greatest(" + ", ".join(O._signal("text", s) for s in fixed.SIGNALS) + ")"


def _row(section: str, sql: str, columns) -> str:  # noqa: ANN001
    """A single row's columns as (section, name, value)."""
    names, values = ", ".join(map(O._s, columns)), ", ".join(f"{c}::double" for c in columns)
    return f"select '{section}' as section, unnest([{names}]) as name, unnest([{values}]) as value from ({sql})"


def _counted(section: str, source: str, name: str) -> str:
    return f"select '{section}' as section, coalesce({name}, 'none') as name, count(*)::double as value from {source} group by 2"


_GENERATED = tuple(dict.fromkeys(c for c, *_ in GENERATED))


def _streamed() -> str:
    """The fold over even orders, then odd ones, with nothing there before."""
    return f"""with recursive {O.INCOMING}, taken as (
  select *, trim(ticket_id) as i, lower(trim(ticket_text)) as t, row_ord % 2 as batch, (row_ord % 2) * 1000000000000 + row_ord as place from incoming
), open as (select place as row_ord, i, t from taken where len({O._reasons()}) = 0), {O._ROUNDS}, marked as (
  select k.*, coalesce(a.row_ord < k.place, false) as known_i, coalesce(b.row_ord < k.place, false) as known_t
  from taken k left join (select row_ord, i from rounds where won) a on a.i = k.i left join (select row_ord, t from rounds where won) b on b.t = k.t
), told as (select batch, ticket_text, array_to_string({O._reasons("known_i", "known_t")}, '; ') as rejection_reason from marked)
select batch::int as batch, rejection_reason, count(*) as n, count(distinct ticket_text) as texts from told group by 1, 2"""


def _routed() -> str:
    """Where the accepted and the rejected rows of the fold go, and the dataset that the accepted ones join, of equal texts one."""
    fold = O._fold()
    cut = fold.rindex("select row_ord, case when rejection_reason")
    return fold[:cut].rstrip() + """, decided as (
  select n.row_ord, n.ticket_text, lower(trim(coalesce(n.source, 'external'))) as source, rejection_reason = '' as ok from told join incoming n using (row_ord)
), placed as (
  select case when not ok then 'rejected' when source = 'manual' then 'manual' else 'external' end as place, ticket_text from decided
), dataset as (
  select distinct ticket_text from (select ticket_text from raw join orders on o_orderkey = row_ord where o_orderstatus = 'F' and ticket_text is not null union all select ticket_text from decided where ok)
)
select place, count(*) as n, count(distinct ticket_text) as texts from placed group by place union all select 'dataset', count(*), count(*) from dataset"""


def reports(known: dict[str, str]) -> dict[str, str]:
    """The reports' sections from the SQL of single queries."""
    length = [f"{m}_{c}" for c in ("words", "chars") for m in ("mean", "min", "max", "median")]
    language = f"case when {O._any('lower(ticket_text)', fixed.HINGLISH_PARTS)} then 'hinglish' when {O._any('lower(ticket_text)', fixed.GUJARATI_PARTS)} then 'gujarati' else 'english' end"
    top = O._top(f"select category, unnest({O._TOKENS}) as term from tickets", "category", 5)
    vocabulary = known["vocab_ttr"].replace("coalesce(text, '')", "coalesce(ticket_text, '')").replace("from documents", "from tickets")
    parts = [_row("length", known["length_stats"], length), _row("buckets", known["length_buckets"], ("short", "medium", "long")), _row("vocabulary", f"with {O.TICKETS} {vocabulary}", ("total_tokens", "unique_tokens", "ttr"))]
    parts += [f"select * from (with {O.TICKETS} {_counted('language', 'tickets', language)})", f"select 'keywords' as section, category || ': ' || term as name, n::double as value from (with {O.TICKETS} {top})"]
    told = f"with {O.INCOMING}, told as (select {O._reasons()} as r from incoming), each_ as (select regexp_replace(unnest(r), '[ ]?[''(:].*', '') as reason from told)"
    passed = "case when len(r) = 0 then 'approved' else 'rejected' end"
    checks = f"{told} select 'rows' as section, 'total' as name, count(*)::double as value from told union all {_counted('rows', 'told', passed)} union all {_counted('reasons', 'each_', 'reason')}"
    sizes = ["select 'sizes', 'raw', count(*)::double from raw", "select 'sizes', 'cleaned', count(*)::double from dense", "select 'sizes', 'unique', count(distinct ticket_text)::double from dense"]
    shared = lambda a, b: " union all ".join(
        f"select 'shared by {a} and {b}', 'shared_{k}', count(*)::double from (select {v} from marked where split = '{a}' intersect select {v} from marked where split = '{b}')" for k, v in (("patterns", "pattern"), ("texts", "ticket_text"), ("normal", "lower(trim(ticket_text))"))
    )
    version = f"with {O.DENSE}, {O._SPLITS} select 'split' as section, split as name, count(*)::double as value from marked group by split union all " + " union all ".join(
        [*sizes, *[f"select '{c}', coalesce({c}, 'none'), count(*)::double from dense group by 2" for c in ("source", "category", "priority")], *[shared(a, b) for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))]]
    )
    measures = [f"{k}_{m}" for k in ("macro", "weighted") for m in ("precision", "recall", "f1")]
    always = known["macro_weighted"].replace(O._rule("ticket_text", O._s("Medium"), O._s("")) + " as predicted", "'Medium' as predicted")
    told_by = lambda model, sql: f"select '{model}' as model, * from ({sql})"
    both = f"{told_by('predicted', known['macro_weighted'])} union all by name {told_by('always', always)}"
    names = ", ".join(f"'{m}'" for m in measures)
    compared = f"with both_ as ({both}) select 'models for priority' as section, model || ': ' || unnest([{names}]) as name, unnest([{', '.join(m + '::double' for m in measures)}]) as value from both_ union all select 'best model for priority', model, 1.0::double from (select model from both_ order by weighted_f1 desc, model = 'always' limit 1)"
    return {"diversity_report": " union all ".join(parts), "validation_report": checks, "version_report": version, "comparison_report": compared}


def service() -> dict[str, str]:
    """Name -> SQL."""
    rule, top = _rule_signal()
    blank = "(ticket_text is null or trim(ticket_text) = '')"
    signals = ", ".join(f"case when not {blank} then {O._signal('ticket_text', s)} end as {s}" for s in fixed.SIGNALS)
    listed = ", ".join(f"''{p}''" for p in fixed.PRIORITIES)
    code = f"case when ticket_id = '' or corrected_priority not in ({', '.join(map(O._s, fixed.PRIORITIES))}) then 400 when t is null then 404 else 201 end"
    subset = lambda c, allowed: f"select '{c}' as name, count(distinct {c}) filter ({c} not in ({', '.join(map(O._s, allowed))})) as others, count(distinct {c}) filter ({c} not in ({', '.join(map(O._s, allowed))})) = 0 as is_subset from raw"
    beyond = lambda kind, cs: f"select '{kind}' as kind, (select count(*) from incoming) - (select count(*) from (select distinct {cs} from incoming)) as n"
    shared = lambda v: f"(select count(*) from (select {v} from m where source = 'manual' intersect select {v} from m where source = 'external'))"
    return {
        "request_texts": O._gate(TEXT_REQUESTS, "texts"),
        "feedback_answers": f"""with {FEEDBACK_REQUESTS}, joined as (select f.*, k.ticket_id as t, k.priority as original_priority, coalesce(k.priority_confidence, k.confidence) as original_priority_confidence from fields f left join kept k using (ticket_id)),
coded as (select *, {code} as status_code from joined) select row_ord, ticket_id, corrected_priority, reviewer, validated, original_priority, original_priority_confidence, status_code,
case when ticket_id = '' then 'ticket_id is required.' when status_code = 400 then 'corrected_priority must be one of [{listed}].' when status_code = 404 then 'Ticket ''' || ticket_id || ''' not found.' else 'Priority feedback submitted successfully.' end as message from coded""",
        "validation_answers": f"with {VALIDATION_REQUESTS} select row_ord, feedback_id, flag as validated, status_code, case when status_code = 400 then 'feedback_id is required.' when status_code = 404 then 'Feedback ''' || feedback_id || ''' not found.' else 'Feedback ''' || feedback_id || ''' validation status updated to ' || flag || '.' end as message from answered",
        "feedback_after_validation": f"with {VALIDATION_REQUESTS}, last_ as (select feedback_id, list(flag order by row_ord desc, flag desc)[1] as flag from answered where status_code = 200 group by 1) select feedback_id, ticket_id, corrected_priority, coalesce(flag, validated) as validated from feedback left join last_ using (feedback_id)",
        "delete_answers": f"with {DELETED} select row_ord, status_code, case status_code when 400 then 'Ticket ID is required.' when 200 then 'Ticket ''' || ticket_id || ''' deleted successfully.' else 'Ticket ''' || ticket_id || ''' was not found.' end as message from answered",
        "delete_keeps_feedback": f"with {DELETED} select (select count(*) from stay) as tickets, (select count(*) from feedback) as feedback, (select count(*) from feedback where ticket_id in (select ticket_id from kept) and ticket_id not in (select ticket_id from stay)) as orphans",
        "assign_answers": f"""with {ASSIGNED} select row_ord, ticket_id, case when not known then 404 when agent_id is null then 409 else 200 end as status_code, case when not known then 'Ticket ''' || ticket_id || ''' was not found.'
when not staffed then 'No active agents are available for department ''' || department || '''. The ticket was not changed.' when agent_id is null then 'Ticket ''' || ticket_id || ''' is already assigned to the only active agent in ''' || department || ''' and cannot be reassigned.'
else 'Ticket ''' || ticket_id || ''' assigned to ' || name || '.' end as message, agent_id from answered""",
        "tickets_after_assignment": f"with {ASSIGNED}, given as (select distinct ticket_id, agent_id from answered where known and agent_id is not null) select ticket_id, coalesce(agent_id, assigned_agent_id) as assigned_agent_id, priority from kept left join given using (ticket_id)",
        "dashboard_bundle": f"""with {O.STORE}, counts as (select 'total' as section, 'tickets' as key, count(*)::varchar as value from kept union all {" union all ".join(f"select '{c}', {c}, count(*)::varchar from kept group by {c}" for c in ("category", "priority", "department"))}
union all select 'feedback', case when validated = 1 then 'validated' else 'pending' end, count(*)::varchar from feedback group by 2),
t as (select *, row_number() over (order by id desc) as place from kept qualify place <= 10), f as (select *, row_number() over (order by id desc, feedback_id, ticket_id, corrected_priority, validated) as place from feedback qualify place <= 10)
select * from counts union all select 'recent_ticket', place::varchar, ticket_id || ' | ' || priority || ' | ' || coalesce(a.name, 'Unassigned') from t left join agents a on a.id = t.assigned_agent_id
union all select 'recent_feedback', place::varchar, feedback_id || ' | ' || corrected_priority from f union all select 'saved_accuracy', 'category', '97.87%' union all select 'saved_accuracy', 'priority', '—'""",
        "ticket_listing": f"with {O.STORE} select ticket_id, coalesce(a.name, 'Unassigned') as agent, case when coalesce(category_confidence, confidence) is null then '--' else printf('%.2f%%', coalesce(category_confidence, confidence)) end as confidence, case when a.name is not null then 'Reassign Agent' else 'Assign Agent' end as action from kept k left join agents a on a.id = k.assigned_agent_id",
        "known_confidence": f"with {O.STORE} select ticket_id, coalesce(coalesce(category_confidence, confidence)::varchar, '--') as shown from kept",
        "usable_feedback": f"with {O.STORE} select feedback_id, ticket_text, corrected_priority as priority from feedback join (select ticket_id, ticket_text from raw) r using (ticket_id) where validated = 1 and ticket_text is not null and ticket_text <> ''",
        "value_subsets": f"with {O.RAW} " + " union all ".join((subset("category", fixed.CATEGORIES), subset("priority", fixed.PRIORITIES), subset("source", fixed.SOURCES))),
        "surplus_rows": f"with {O.INCOMING} " + " union all ".join((beyond("row", "ticket_id, ticket_text, category"), *(beyond(c, c) for c in ("ticket_id", "ticket_text", "category")))),
        "keyword_values": f"with {O.TICKETS}, h as (select unnest(list_distinct(string_split_regex(lower(ticket_text), '[^\\p{{L}}\\p{{N}}_]+'))) as word, priority, category from tickets), k as (select word, 'priority' as field, priority as value from h union all select word, 'category', category from h) select word, field, value, count(*) as n from k where word in ({', '.join(map(O._s, fixed.TARGET_WORDS))}) group by 1, 2, 3",
        "source_overlap": f"with {O.TICKETS}, m as (select source, ticket_text, lower(trim(ticket_text)) as normal, {O._masked('ticket_text', fixed.MASKS, fixed.NOISE)} as pattern from tickets) select {shared('pattern')} as shared_patterns, {shared('ticket_text')} as shared_texts, {shared('normal')} as shared_normal",
        "reference_numbers": f"with {O.RAW} select row_ord, 'TICK-' || upper(left(md5(row_ord::varchar), 6)) as ticket, 'FB-' || upper(left(md5(row_ord::varchar), 6)) as feedback from raw",
        "language_pairs": f"with {O.TICKETS}, {_MATTERS}, v as (select block, category, arg_min(ticket_text, row_ord) filter (lang = 'english') as en, arg_min(ticket_text, row_ord) filter (lang = 'hinglish') as hi from matters group by 1, 2), texts as (select block, category, l.lang, l.text from v, unnest([{{'lang': 'en', 'text': en}}, {{'lang': 'hi', 'text': hi}}]) u(l) where en is not null and hi is not null), "
        f"s as (select block, category, lang, {rule} as label, {top} as top from texts) select e.block, e.category, e.label as en_label, e.top as en_top, h.label as hi_label, h.top as hi_top, e.label = h.label as agree from s e join s h on e.block = h.block and e.category = h.category and e.lang = 'en' and h.lang = 'hi'",
        "language_consistency": _CONSISTENT + " select * from told",
        "language_consistency_score": _CONSISTENT + " select round(count(*) filter (perfect) * 100 / count(*), 4) as score from told",
        "scenario_accuracy": f"with {O.TICKETS}, masked as (select *, {O._masked('ticket_text', fixed.AUDIT_MASKS, fixed.AUDIT_NOISE)} as template from tickets), firsts as (select template, arg_min(ticket_text, row_ord) as text from masked group by 1), most as (select template, priority as expected from (select template, priority, count(*) as n from masked group by 1, 2) qualify row_number() over (partition by template order by n desc, priority) = 1), "
        f"s as (select expected, {rule} as triggers, case when {top} >= 0.95 then 'Critical' when {top} >= 0.8 then 'High' when {top} >= 0.4 then 'Medium' else 'Low' end as signals from firsts join most using (template)) "
        + " union all ".join(f"select '{m}' as model, count(*) filter ({m} = expected) as matches, count(*) as scenarios, round(count(*) filter ({m} = expected) * 100 / count(*), 1) as accuracy from s" for m in ("triggers", "signals")),
        "csv_round_trip": f"with {O.RAW} select ticket_id, ticket_text, category, priority, source from raw",
        "optional_sources": f"with {O.RAW} select ticket_id, ticket_text, category, priority, source from raw where source in ('manual', 'external')",
        "routed_ingest": _routed(),
        "bootstrap_tickets": f"with {O.TICKETS} select row_ord as id, ticket_id, ticket_text, category, {O._rule('ticket_text', O._s('Medium'), O._s(''))} as priority, department, 90.0::double as confidence, case when row_ord % 2 = 0 then 90.0 else 95.0 end::double as category_confidence, 80.0::double as priority_confidence, 'Open' as status from tickets order by row_ord limit 25",
        "json_metrics": f"with {O.TICKETS} select 'category' as field, category as name, count(*) as n from tickets group by 2 union all select 'priority', priority, count(*) from tickets group by 2",
        "generated_rules": f"with n as (select count(*) as n, ceil(count(*) / {len(_GENERATED)})::bigint as each_ from orders), c as (select unnest(range({len(_GENERATED)})) as i, unnest({O._list(_GENERATED)}) as category) select category, least(each_, n - i * each_)::bigint as n, least(each_, n - i * each_)::bigint as ids, true as sound from c, n where i * each_ < n",
        "landing_stream": _streamed(),
        "store_replay": f"with {O.STORE} select id, ticket_id, category, case when id % 21 = 0 then 'Reopened' when id % 5 = 0 then 'Closed' else 'Open' end as status, assigned_agent_id from kept where (id % 7 <> 0 or id % 21 = 0) and id % 11 <> 0",
        "predict_tickets": f"with {O.RAW} select row_ord, case when {blank} then 'error' else 'success' end as status, case when {blank} then 'Input ticket text cannot be empty.' end as error, {signals}, case when not {blank} then true end as sound, true as routed from raw",
    }
