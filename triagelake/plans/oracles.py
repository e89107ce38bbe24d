"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from .. import fixed
from ..sources.tickets import TEMPLATES


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:  # noqa: ANN001
    return "[" + ", ".join(map(_s, xs)) + "]"


def _case(pairs, default: str) -> str:  # noqa: ANN001
    return "case " + " ".join(f"when {a} then {b}" for a, b in pairs) + f" else {default} end"


def _any(c: str, parts) -> str:  # noqa: ANN001
    return "(" + " or ".join(f"contains({c}, {_s(p)})" for p in parts) + ")"


def _signal(c: str, name: str) -> str:
    rules = sorted(fixed.SIGNALS[name], key=lambda r: -r[1])
    return _case([(f"regexp_matches(lower({c}), {_s(p)})", f"{v}::double") for p, v in rules], "0.0::double")


def _clean(c: str) -> str:
    out = f"lower(coalesce({c}, ''))"
    for pattern, by in ((r"https?://\S+|www\.\S+", ""), (r"<.*?>", ""), (r"[^\p{L}\p{M}\p{Nl}\s]", " "), (r"\s+", " ")):
        out = f"regexp_replace({out}, {_s(pattern)}, {_s(by)}, 'g')"
    return f"trim({out})"


def _words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')"


def _preprocess(c: str) -> str:
    return f"list_filter(string_split({_clean(c)}, ' '), lambda x: length(x) > 1 and not list_contains({_list(fixed.STOP_WORDS)}, x))"


def _department(c: str) -> str:
    return _case([(f"trim(coalesce({c}, '')) = {_s(k)}", _s(v)) for k, v in fixed.DEPARTMENTS.items()], _s(fixed.DEFAULT_DEPARTMENT))


def _title(c: str, allowed) -> str:  # noqa: ANN001
    return _case([(f"lower(trim({c})) = {_s(a.lower())}", _s(a)) for a in allowed], "null")


def _rule(c: str, base: str, suffix: str) -> str:
    low = f"lower({c})"
    end = f"lower({suffix})"
    main = f"(case when {end} <> '' and suffix({low}, {end}) then trim(left({low}, length({low}) - length({end}))) else {low} end)"
    settled = f"(case when {_any(main, fixed.LOW_TRIGGERS)} then 'Low' else {base} end)"
    lifted = f"(case when {_any(end, fixed.URGENT_SUFFIXES)} and {settled} = 'Low' then 'Medium' else {settled} end)"
    return _case(
        [
            (_any(main, fixed.CRITICAL_TRIGGERS), "'Critical'"),
            (_any(main, fixed.HIGH_TRIGGERS), "'High'"),
            (_any(main, fixed.MEDIUM_TRIGGERS), f"case when {base} in ('High', 'Critical') then {base} else 'Medium' end"),
        ],
        lifted,
    )


def _masked(c: str, masks, noise) -> str:  # noqa: ANN001
    out = f"trim(lower(coalesce({c}, '')))"
    for pattern, by in masks:
        if "(?=" in pattern:  # looks ahead to a digit later in the line: mask up to the last word with one, then '#' marks in the rest
            head = f"regexp_extract({out}, '^(.*[0-9][a-z0-9_-]*)', 1)"
            rest = f"substr({out}, length({head}) + 1)"
            out = f"regexp_replace({head}, '#[A-Za-z0-9_-]+|\\b[A-Za-z0-9_-]{{4,12}}\\b', '<ID>', 'gi') || regexp_replace({rest}, '#[A-Za-z0-9_-]+', '<ID>', 'gi')"
            out = f"({out})"
            continue
        flag = "gi" if pattern.startswith("(?i)") else "g"
        out = f"regexp_replace({out}, {_s(pattern.removeprefix('(?i)'))}, {_s(by)}, {_s(flag)})"
    out = f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"
    for phrase in noise:
        out = f"trim(replace({out}, {_s(phrase)}, ''))"
    return out


def _pii(c: str) -> str:
    found = ", ".join(f"case when regexp_matches({c}, {_s(p)}) then {_s(n)} end" for n, p in fixed.PII)
    return f"list_filter([{found}], lambda x: x is not null)"


_TEXT = f"replace(({_list(t for _, t in TEMPLATES)})[o_orderkey % {len(TEMPLATES)} + 1], '{{id}}', o_orderkey::varchar)"
_CATEGORY = f"({_list(c for c, _ in TEMPLATES)})[o_orderkey % {len(TEMPLATES)} + 1]"
RAW = f"""
raw as (
  select 'TICK-' || o_orderkey as ticket_id,
    case when o_orderkey % 97 = 0 then null when o_orderkey % 89 = 0 then '   ' when o_orderkey % 11 = 0 then '  ' || {_TEXT} else {_TEXT} end as ticket_text,
    case when o_orderkey % 83 = 0 then 'Unknown' when o_custkey % 5 = 0 then upper({_CATEGORY}) else {_CATEGORY} end as category,
    case when o_orderkey % 79 = 0 then null else {_case([("left(o_orderpriority, 1) = '1'", "'Critical'"), ("left(o_orderpriority, 1) = '2'", "'High'"), ("left(o_orderpriority, 1) = '5'", "'Low'")], "'Medium'")} end as priority,
    ({_list(fixed.SOURCES)})[o_custkey % 3 + 1] as source, o_orderdate as created_at, o_orderkey as row_ord
  from orders
)"""
TICKETS = f"""{RAW}, tidy as (
  select row_ord, ticket_id, trim(ticket_text) as ticket_text, {_title("category", fixed.CATEGORIES)} as category, {_title("priority", fixed.PRIORITIES)} as priority, source, created_at from raw
), tickets as (
  select *, {_department("category")} as department from tidy where ticket_text is not null and ticket_text <> '' and category is not null and priority is not null
)"""
DENSE = f"{TICKETS}, dense as (select * from tickets qualify row_number() over (partition by ticket_text order by row_ord) = 1)"
INCOMING = f"""{TICKETS}, incoming as (
  select case when row_ord % 7 = 0 then 'TICK-1' else ticket_id end as ticket_id,
    case when row_ord % 13 = 0 then 'hi' when row_ord % 17 = 0 then ticket_text || ' mail me at a.b@c.org' when row_ord % 19 = 0 then ticket_text || ' call 555-123-4567' else ticket_text end as ticket_text,
    category, priority, case when row_ord % 23 = 0 then 'fax' else source end as source, row_ord
  from raw
)"""
AGENTS = "agents as (select * from (values " + ", ".join(f"({i}, {_s(n)}, {_s(t)}, {int(i % 5 != 0)})" for i, (n, t) in enumerate(fixed.AGENTS, 1)) + ") a(id, name, department, is_active))"
STORE = f"""{TICKETS}, {AGENTS}, kept as (
  select row_ord as id, ticket_id, ticket_text, category, priority, department, created_at, case when row_ord % 4 = 0 then null else row_ord % 20 + 1 end as assigned_agent_id,
    case when row_ord % 9 <> 0 then sure end as confidence, case when row_ord % 3 <> 0 then sure end as category_confidence, case when row_ord % 5 <> 0 then sure / 2 end as priority_confidence
  from (select *, (row_ord * 37 % 10000) / 100.0::double as sure from tickets)
), feedback as (
  select 'FB-' || l_orderkey || '-' || l_linenumber as feedback_id, 'TICK-' || l_orderkey as ticket_id, ({_list(fixed.PRIORITIES)})[l_linenumber % 4 + 1] as corrected_priority,
    (l_linestatus = 'F')::int as validated, l_orderkey * 8 + l_linenumber as id
  from lineitem where l_returnflag = 'R'
)"""
JUDGED = f"{TICKETS}, judged as (select *, {_rule('ticket_text', _s('Medium'), _s(''))} as predicted from tickets)"
_SCORES = """scores as (
  select label, sum(t) as support, sum(p) as guessed, sum(t * hit) as hits from (
    select priority as label, 1 as t, 0 as p, (priority = predicted)::int as hit from judged union all select predicted, 0, 1, (priority = predicted)::int from judged) group by label
), classes as (
  select label, coalesce(hits / nullif(guessed, 0), 0)::double as p, coalesce(hits / nullif(support, 0), 0)::double as r, support from scores
), rated as (select label, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1, support::bigint as support from classes)"""
_REASONS = {
    name: _case([(f"{name} >= {t}", _s(p)) for t, p in steps], "null") for name, steps in fixed.REASONS
}
_TOKENS = "list_filter(string_split_regex(lower(ticket_text), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{2,}') and not list_contains(" + _list(fixed.NGRAM_STOP_WORDS) + ", x))"


def _top(source: str, group: str, k: int) -> str:
    return f"select {group}, term, count(*) as n, row_number() over (partition by {group} order by count(*) desc, term)::int as rank from ({source}) group by {group}, term qualify rank <= {k}"


def _gate(rows: str = "", source: str = "incoming") -> str:
    parts = "list_filter(string_split_regex(t, '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    mashes = _list(fixed.KEYBOARD_MASHES)
    empty, vague = _s("Please enter a ticket description."), _s("Please enter a meaningful description of the issue.")
    message = _case(
        [
            ("ticket_text is null", empty),
            (f"length(ticket_text) > {fixed.MAX_TICKET_LENGTH}", _s(f"Please keep your ticket description under {fixed.MAX_TICKET_LENGTH} characters.")),
            ("t = ''", empty),
            ("not regexp_matches(t, '\\p{L}')", _s("Please describe the issue using words.")),
            (f"len(list_filter({parts}, lambda x: length(x) >= 6 and len(list_distinct(string_split(x, ''))) = 1)) > 0", vague),
            (f"len(list_filter({parts}, lambda x: list_contains({mashes}, lower(x)))) > 0 and len(list_filter({parts}, lambda x: regexp_full_match(x, '\\p{{L}}+') and not list_contains({mashes}, lower(x)))) = 0", vague),
        ],
        "null",
    )
    return f"""with {rows or INCOMING}, seen as (select row_ord, ticket_text, trim(ticket_text) as t from {source}), said as (select *, {message} as message from seen)
select row_ord, case when message is null then t end as ticket_text, message, case when message is not null then case when length(ticket_text) > {fixed.MAX_TICKET_LENGTH} then 413 else 400 end end as status_code from said"""


def _reasons(known_id: str = "false", known_text: str = "false") -> str:
    t = "trim(ticket_text)"
    has = f"coalesce({t} <> '' and {t} <> 'nan', false)"
    items = [
        f"case when ticket_id is null or trim(ticket_id) in ('', 'nan') then 'Missing ticket_id' when {known_id} then 'Duplicate ticket_id ''' || trim(ticket_id) || '''' end",
        f"case when not {has} then 'Missing or empty ticket_text' when length({t}) < 5 then 'Text too short (' || length({t}) || ' chars, min 5)' when length({t}) > 2000 then 'Text too long (' || length({t}) || ' chars, max 2000)' end",
        f"case when {has} and {known_text} then 'Exact duplicate ticket_text already in dataset' end",
        f"case when {has} and len({_pii(t)}) > 0 then 'PII detected: ' || array_to_string({_pii(t)}, ', ') end",
        f"case when ({_title('category', fixed.CATEGORIES)}) is null then 'Invalid category ''' || coalesce(category, 'nan') || '''' end",
        f"case when ({_title('priority', fixed.PRIORITIES)}) is null then 'Invalid priority ''' || coalesce(priority, 'nan') || '''' end",
        f"case when lower(trim(coalesce(source, 'external'))) not in ({', '.join(map(_s, fixed.SOURCES))}) then 'Invalid source ''' || coalesce(source, 'nan') || '''' end",
    ]
    return f"list_filter([{', '.join(items)}], lambda x: x is not null)"


#: ``rounds`` over ``open`` (row_ord, i, t): the first of both its keys has won, rows that share a key with it go, and it starts anew.
_FIRST = "row_ord = min(row_ord) over (partition by i) and row_ord = min(row_ord) over (partition by t)"
_ROUNDS = f"""rounds(row_ord, i, t, won) as (
  select row_ord, i, t, {_FIRST} from open
  union all
  select row_ord, i, t, {_FIRST} from (
    select row_ord, i, t from rounds r where not won and i not in (select i from rounds where won) and t not in (select t from rounds where won))
)"""


def _violations() -> str:
    required = [f"when {c} is null then 'NOT NULL constraint failed: tickets.{c}'" for c in ("ticket_id", "ticket_text", "category", "priority", "department", "confidence")]
    return f"""with recursive {INCOMING}, {STORE.split(TICKETS)[1].lstrip(", ")}, given as (
  select row_ord, case when row_ord % 10 < 6 then row_ord + 1 else row_ord end as id, ticket_id, ticket_text, category, priority, {_department("category")} as department,
    case when row_ord % 31 <> 0 then 0.5 end as confidence, case when row_ord % 4 <> 0 then row_ord % 23 + 1 end as assigned_agent_id from incoming
), seen as (
  select g.*, case {" ".join(required)} when assigned_agent_id is not null and assigned_agent_id not in (select id from agents) then 'FOREIGN KEY constraint failed: tickets.assigned_agent_id' end as base,
    id in (select id from kept where id % 3 = 0) as id_there, ticket_id in (select ticket_id from kept where id % 3 = 0) as ticket_there from given g
), open as (select row_ord, id as i, ticket_id as t from seen where base is null and not id_there and not ticket_there), {_ROUNDS}, told as (
  select s.row_ord as seq, ticket_id, coalesce(base, case when id_there or a.row_ord < s.row_ord then 'UNIQUE constraint failed: tickets.id' when ticket_there or b.row_ord < s.row_ord then 'UNIQUE constraint failed: tickets.ticket_id' end) as violation
  from seen s left join (select row_ord, i from rounds where won) a on a.i = s.id left join (select row_ord, t from rounds where won) b on b.t = s.ticket_id
)
select * from told where violation is not null"""


def _lemmas() -> str:
    """Suffixes detached in rounds; of a word's first round with forms in the lexicon the shortest, then the first found."""
    from .queries import IRREGULAR

    rules = ", ".join(f"({i}, {_s(a)}, {_s(b)})" for i, (a, b) in enumerate(fixed.NOUN_SUFFIXES))
    irregular = ", ".join(f"({_s(a)}, {_s(b)})" for a, b in IRREGULAR)
    return f"""with recursive kept as (select doc_id, {_preprocess("text")} as ws from documents), placed as (
  select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as place from kept
), lexicon as (select distinct unnest(string_split({_clean("text")}, ' ')) as w from conversations), rules(i, old, new) as (values {rules}), irregular(w, form) as (values {irregular}), forms(w, form, n, path) as (
  select distinct w, w, 0, '' from placed
  union all
  select f.w, left(form, length(form) - length(old)) || new, n + 1, path || i from forms f, rules where suffix(form, old) and f.w not in (select w from irregular)
), tried as (
  select w, form, greatest(n, 1) as n, path from forms union all select i.w, i.form, 1, 'x' from irregular i where i.w in (select w from placed)
), found as (
  select w, arg_min(form, (n, length(form), path)) as lemma from tried where form in (select w from lexicon where w <> '') group by w
), told as (select doc_id, string_agg(coalesce(lemma, p.w), ' ' order by place) as words from placed p left join found f on f.w = p.w group by doc_id)
select k.doc_id, coalesce(words, '') as words from kept k left join told t on t.doc_id = k.doc_id"""


def _fold() -> str:
    return f"""with recursive {INCOMING}, old as (
  select trim(ticket_id) as i, lower(trim(ticket_text)) as t from raw join orders on o_orderkey = row_ord where o_orderstatus = 'F'
), taken as (
  select n.*, trim(ticket_id) as i, lower(trim(ticket_text)) as t, coalesce(trim(ticket_id) in (select i from old where i is not null), false) as old_i, coalesce(lower(trim(ticket_text)) in (select t from old where t is not null), false) as old_t
  from incoming n join orders on o_orderkey = row_ord where o_orderstatus <> 'F'
), open as (
  select row_ord, i, t from taken where len({_reasons("old_i", "old_t")}) = 0
), {_ROUNDS[:-2]}
), marked as (
  select k.*, old_i or coalesce(a.row_ord < k.row_ord, false) as known_i, old_t or coalesce(b.row_ord < k.row_ord, false) as known_t
  from taken k left join (select row_ord, i from rounds where won) a on a.i = k.i left join (select row_ord, t from rounds where won) b on b.t = k.t
), told as (select row_ord, array_to_string({_reasons("known_i", "known_t")}, '; ') as rejection_reason from marked)
select row_ord, case when rejection_reason = '' then 'approved' else 'rejected' end as validation_status, rejection_reason from told"""


_SPLITS = f"""patterns as (
  select pattern, min_by(category, row_ord) as category from (select *, {_masked("ticket_text", fixed.MASKS, fixed.NOISE)} as pattern from dense) group by pattern
), ranked as (
  select *, row_number() over (partition by category order by md5(pattern || '42'), pattern) as rank, count(*) over (partition by category) as n from patterns
), splits as (
  select pattern, category, case when rank <= greatest(1, round_even(n * 0.70::double, 0)) then 'train'
    when rank <= greatest(1, round_even(n * 0.70::double, 0)) + greatest(1, round_even(n * 0.15::double, 0)) then 'validation' else 'test' end as split from ranked
), marked as (
  select d.*, s.split, s.pattern from (select *, {_masked("ticket_text", fixed.MASKS, fixed.NOISE)} as p from dense) d join splits s on s.pattern = d.p
)"""


def _terms(source: str, rows: str, letters: bool = False) -> str:
    words = "case when len(w) = 0 then ['ticket'] else w end"
    if letters:
        words = f"list_filter(string_split_regex(array_to_string({words}, ' '), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1)"
    return f"""words as (select ticket_id, {words} as w from (select ticket_id, {_preprocess("ticket_text")} as w from {rows})),
{source} as (select ticket_id, term, count(*) as tf from (
  select ticket_id, unnest(w) as term from words union all select ticket_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from words) group by ticket_id, term)"""


_WEIGHTS = """raw_weights as (select ticket_id, term, (1 + ln(tf)) * idf as w from counted join vocab using (term)),
weighted as (select ticket_id, term, w / sqrt(sum(w * w) over (partition by ticket_id)) as weight from raw_weights)"""
_BAYES = f"""with {TICKETS}, {_terms("counted", "tickets")}, train as (select ticket_id, category as label from tickets where row_ord % 4 <> 0),
stats as (select term, count(*) as df, sum(tf) as total from counted where ticket_id in (select ticket_id from train) group by term),
vocab as (select term, ln((1 + (select count(*) from train)) / (1 + df)) + 1 as idf from stats order by total desc, term limit 10000),
{_WEIGHTS}, mass as (select label, term, sum(weight) as mass from weighted join train using (ticket_id) group by label, term),
cells as (select label, term, coalesce(mass, 0) + 1.0 as mass from (select distinct label from train) cross join (select distinct term from weighted where ticket_id in (select ticket_id from train)) left join mass using (label, term)),
likelihood as (select label, term, ln(mass / sum(mass) over (partition by label)) as logp from cells),
priors as (select label, ln(count(*) / sum(count(*)) over ()) as prior from train group by label)"""


def _tfidf(size: int, sublinear: bool, letters: bool) -> str:
    weights = _WEIGHTS if sublinear else _WEIGHTS.replace("(1 + ln(tf))", "tf")
    return f"""with {TICKETS}, {_terms('counted', 'tickets', letters)}, stats as (select term, count(*) as df, sum(tf) as total from counted group by term),
vocab as (select term, ln((1 + (select count(*) from tickets)) / (1 + df)) + 1 as idf from stats order by total desc, term limit {size}), {weights} select ticket_id, term, round(weight, 6) as weight from weighted"""


_WINDOWS = "select distinct {key}, n, array_to_string(w[i : i + n - 1], ' ') as run from (select {key}, w, n, unnest(range(1, len(w) - n + 2)) as i from {rows})"
_LEAKAGE = f"""with d as (select doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') as w from documents),
b as (select item_id, w, least(len(w), 13) as n from (select item_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') as w from benchmark) where len(w) > 0),
dn as (select doc_id, w, n from d, (select distinct n from b) where len(w) >= n),
dw as ({_WINDOWS.format(key="doc_id", rows="dn")}), bw as ({_WINDOWS.format(key="item_id", rows="b")})
select item_id, count(distinct doc_id) as documents from dw join bw using (n, run) group by item_id"""


def oracle_sql() -> dict[str, str]:
    """Name -> SQL; queries without an entry have no equivalent in SQL."""
    from .service_oracles import reports, service

    sig = ", ".join(f"{_signal('ticket_text', s)} as {s}" for s in fixed.SIGNALS)
    told = f"array_to_string(list_filter([{', '.join(_REASONS[n] for n, _ in fixed.REASONS)}], lambda x: x is not null), ', ')"
    t = f"with {TICKETS} "
    judged = f"with {JUDGED} "
    others = "case when assigned_agent_id is null then team else list_filter(team, lambda a: a <> assigned_agent_id) end"
    assigned = f"""with {STORE}, teams as (select department, list(id order by id) as team from agents where is_active = 1 group by department),
 open_ as (select k.*, team from kept k left join teams using (department)),
 pairs as (select ticket_id, unnest({others}) as a from open_),
 picked as (select ticket_id, min_by(a, md5(ticket_id || '|' || a)) as agent_id from pairs group by ticket_id),
 out_ as (select o.ticket_id, o.department, p.agent_id::bigint as agent_id, case when p.agent_id is null then 409 else 200 end as status from open_ o left join picked p using (ticket_id)) """
    hist = lambda c: f"(select string_agg({c} || '=' || n, ', ' order by {c} || '=' || n) from (select {c}, count(*) as n from dense group by {c})) as {c}_distribution"
    known = {
        "dept_priority_counts": t + f"select department, priority, count(*) as n, round(avg({_signal('ticket_text', 'urgency')}), 6) as mean_urgency from tickets group by 1, 2",
        "clean_text_docs": f"select doc_id, {_clean('text')} as cleaned from documents",
        "clean_html_pages": f"select page_id, {_clean('concat_ws(chr(32), url, html)')} as cleaned from pages",
        "preprocess_docs": f"select doc_id, array_to_string({_preprocess('text')}, ' ') as words from documents",
        "lemmas_docs": _lemmas(),
        "word_stats": f"select doc_id, len({_words('text')})::bigint as n_words, length(text)::bigint as n_len from documents",
        "length_stats": t + f", sized as (select len({_words('ticket_text')}) as words, length(ticket_text) as chars from tickets) select "
        + ", ".join(f"round(avg({c}), 6) as mean_{c}, min({c})::bigint as min_{c}, max({c})::bigint as max_{c}, quantile_cont({c}, 0.5)::double as median_{c}" for c in ("words", "chars")) + " from sized",
        "length_buckets": t + f", s as (select len({_words('ticket_text')}) as n from tickets) select count(*) filter (n <= 6) as short, count(*) filter (n > 6 and n <= 20) as medium, count(*) filter (n > 20) as long from s",
        "vocab_ttr": f"select count(*) as total_tokens, count(distinct t) as unique_tokens, round(count(distinct t) / count(*), 8) as ttr from (select unnest(list_filter(string_split({_clean('text')}, ' '), lambda x: x <> '')) as t from documents)",
        "top_tokens_by_lang": _top(f"select lang, unnest(list_filter(string_split({_clean('text')}, ' '), lambda x: x <> '')) as term from documents", "lang", 8),
        "top_words_by_priority": t + _top(f"select priority, unnest({_TOKENS}) as term from tickets", "priority", 10),
        "bigrams_by_priority": t + _top(f"select priority, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from (select priority, {_TOKENS} as w from tickets)", "priority", 10),
        "priority_signals": t + f"select ticket_id, {sig} from tickets",
        "signals_by_rules": t + f"select ticket_id, {sig} from tickets",
        "sketched_profile": t + f", s as (select source, ticket_text, {_masked('ticket_text', fixed.AUDIT_MASKS, fixed.AUDIT_NOISE)} as p from tickets) select source, count(*) as n, count(distinct ticket_text) as texts, count(distinct p) as templates, true as n_same, true as texts_near, true as templates_near, true as words_near, true as chars_near from s group by source",
        "signal_explanation": t + f", s as (select ticket_id, priority, {sig} from tickets), r as (select ticket_id, priority, lower({told}) as j from s) select ticket_id, priority || ' priority: ' || case when j = '' then case when priority in ('Low', 'Medium') then {_s(fixed.ROUTINE)} else {_s(fixed.ELEVATED)} end else upper(left(j, 1)) || substr(j, 2) || ' detected.' end as explanation from r",
        "signal_bands": t + f", s as (select {_signal('ticket_text', 'security_risk')} as v from tickets) select case when v >= 0.7 then 'danger' when v >= 0.4 then 'warning' else 'normal' end as band, count(*) as n from s group by 1",
        "rule_priority": t + f", s as (select *, case when suffix(ticket_text, 'Urgent attention required.') then 'Urgent attention required.' else '' end as e from tickets) select ticket_id, {_rule('ticket_text', 'priority', 'e')} as label from s",
        "route_department": f"with {RAW}, c as (select ticket_id, {_title('category', fixed.CATEGORIES)} as category from raw) select ticket_id, {_department('category')} as department from c",
        "ticket_gate": _gate(),
        "pii_scan": f"select doc_id, array_to_string({_pii('text')}, ', ') as found from documents where len({_pii('text')}) > 0",
        "ingest_fold": _fold(),
        "store_violations": _violations(),
        "validate_incoming": f"with {INCOMING} select row_ord, array_to_string({_reasons()}, '; ') as rejection_reason from incoming",
        "reject_reasons": f"with {INCOMING}, r as (select unnest({_reasons()}) as r from incoming) select regexp_replace(r, '[ ]?[''(:].*', '') as reason, count(*) as n from r group by 1",
        "quality_report": f"with {RAW} " + " union all ".join(f"select '{c}' as name, count(*) filter ({c} is null) as nulls, count(*) filter (trim({c}) = '') as blanks, count(*) - (count(distinct {c}) + (count(*) filter ({c} is null) > 0)::int) as duplicates from raw" for c in ("ticket_id", "ticket_text", "category", "priority", "source")),
        "clean_dataset": t + "select row_ord, ticket_text, category, priority, source from tickets",
        "exact_dedup": f"with {DENSE} select row_ord, ticket_text, category from dense",
        "sequential_ids": f"with {DENSE} select row_ord, format('T{{:05d}}', row_number() over (order by row_ord)) as ticket_id from dense",
        "near_dup_templates": t + f", s as (select {_masked('ticket_text', fixed.AUDIT_MASKS, fixed.AUDIT_NOISE)} as p from tickets) select count(*) as rows, count(distinct p) as templates, count(*) - count(distinct p) as near_duplicates from s",
        "template_signature": t + f"select ticket_id, {_masked('ticket_text', fixed.MASKS, fixed.NOISE)} as pattern from tickets",
        "audit_signature_docs": t + f"select ticket_id, {_masked('ticket_text', fixed.AUDIT_MASKS, fixed.AUDIT_NOISE)} as pattern from tickets",
        "group_split": f"with {DENSE}, {_SPLITS} select pattern, category, split from splits",
        "split_sizes": f"with {DENSE}, {_SPLITS} select split, count(*) as n, count(distinct category) as categories from marked group by split",
        "split_overlap": f"with {DENSE}, {_SPLITS}, rows_ as (select 'row' as kind, case when row_ord % 10 < 7 then 'train' else 'test' end as split, {_masked('ticket_text', fixed.MASKS, fixed.NOISE)} as pattern, ticket_text from tickets), both_ as (select 'pattern' as kind, split, pattern, ticket_text from marked union all select * from rows_) select k.kind, "
        + ", ".join(f"(select count(*) from (select {v} from both_ b where b.kind = k.kind and split = 'train' intersect select {v} from both_ b where b.kind = k.kind and split = 'test')) as {n}" for n, v in (("shared_patterns", "pattern"), ("shared_texts", "ticket_text"), ("shared_normal", "lower(trim(ticket_text))"))) + " from (select 'pattern' as kind union all select 'row') k",
        "dataset_version": f"with {DENSE}, {_SPLITS} select (select count(*) from raw) as total_raw, (select count(*) from dense) as total_cleaned, (select count(distinct ticket_text) from dense) as unique_records, {hist('source')}, {hist('category')}, {hist('priority')}, "
        + ", ".join(f"(select count(*) from marked where split = '{s}') as {s}_size" for s in ("train", "validation", "test")),
        "pairwise_leakage": f"with {RAW}, x as (select distinct 'set' || (row_ord % 3) as s, lower(trim(ticket_text)) as t from raw where ticket_text is not null) select a.s as a, b.s as b, count(*) as n from x a join x b on a.t = b.t and a.s < b.s group by 1, 2",
        "benchmark_leakage": _LEAKAGE,
        "category_counts": t + "select category, count(*) as n from tickets group by 1",
        "priority_share": t + "select priority, count(*) as n, round(count(*) * 100 / sum(count(*)) over (), 4) as pct from tickets group by 1",
        "cat_pri_crosstab": t + "select category, " + ", ".join(f"count(*) filter (priority = '{p}') as \"{p}\"" for p in fixed.PRIORITIES) + " from tickets group by 1",
        "crosstab_margins": t + "select case when grouping(category) = 1 then 'All' else category end as category, case when grouping(priority) = 1 then 'All' else priority end as priority, count(*) as n from tickets group by cube (category, priority)",
        "zero_filled_grid": t + f", g as (select * from (select unnest({_list(fixed.CATEGORIES)}) as category) cross join (select unnest({_list(fixed.PRIORITIES)}) as priority)), c as (select category, priority, count(*) as n from tickets group by 1, 2) select category, priority, coalesce(n, 0) as n from g left join c using (category, priority)",
        "keyword_profile": t + f", h as (select unnest(list_distinct(string_split_regex(lower(ticket_text), '[^\\p{{L}}\\p{{N}}_]+'))) as word, priority, category from tickets), w as (select unnest({_list(fixed.TARGET_WORDS)}) as word), "
        + ", ".join(f"m_{c} as (select word, {c} from (select word, {c}, count(*) as n from h group by 1, 2) qualify row_number() over (partition by word order by n desc, {c}) = 1)" for c in ("priority", "category"))
        + ", n as (select word, count(*) as n from h group by 1) select w.word, coalesce(n.n, 0) as n, coalesce(p.priority, 'None') as dominant_priority, coalesce(c.category, 'None') as dominant_category from w left join n using (word) left join m_priority p using (word) left join m_category c using (word)",
        "dominant_priority": t + "select category, priority from (select category, priority, count(*) as n from tickets group by 1, 2) qualify row_number() over (partition by category order by n desc, priority) = 1",
        "lang_mix_a": t + f"select case when {_any('lower(ticket_text)', fixed.HINGLISH_PARTS)} then 'hinglish' when {_any('lower(ticket_text)', fixed.GUJARATI_PARTS)} then 'gujarati' else 'english' end as lang, count(*) as n from tickets group by 1",
        "lang_mix_b": t + f", l as (select priority, case when regexp_matches(ticket_text, '[ऀ-ॿ]') then 'Hindi (Devanagari)' when len(list_intersect(list_filter(string_split_regex(lower(ticket_text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{2,}}')), {_list(fixed.HINGLISH_WORDS)})) > 0 then 'Hinglish / Romanized Hindi' else 'English / Other' end as lang from tickets) select case when grouping(lang) = 1 then 'All' else lang end as lang, case when grouping(priority) = 1 then 'All' else priority end as priority, count(*) as n from l group by cube (lang, priority)",
        "stratification_drift": f"with {DENSE}, {_SPLITS}, p as (select category, split, count(*) * 100 / sum(count(*)) over (partition by split) as pct from marked where split in ('train', 'test') group by 1, 2) select category, round(abs(coalesce(max(pct) filter (split = 'train'), 0) - coalesce(max(pct) filter (split = 'test'), 0)), 6) as drift from p group by 1",
        "longest_ticket": t + f", s as (select ticket_text, row_ord, len({_words('ticket_text')}) as n from tickets) select (select ticket_text from s order by n, row_ord limit 1) as shortest, (select ticket_text from s order by n desc, row_ord limit 1) as longest",
        "null_profile": f"with {RAW} select " + ", ".join(f"count(*) filter ({c} is null) as {c}_nulls" for c in ("ticket_id", "ticket_text", "category", "priority", "source")) + " from raw",
        "sample_heads": t + "select priority, row_number() over (partition by priority order by row_ord)::int as rank, ticket_text from tickets qualify rank <= 4",
        "invalid_values_except": f"with {RAW} select distinct category from raw where category not in ({', '.join(map(_s, fixed.CATEGORIES))})",
        "union_ragged": f"with {INCOMING} select ticket_id, ticket_text, department, null::varchar as source from tickets union all select ticket_id, ticket_text, null, source from incoming",
        "accuracy": judged + "select round(avg((priority = predicted)::int::double), 6) as accuracy from judged",
        "per_class_prf": f"with {JUDGED}, {_SCORES} select * from rated",
        "macro_weighted": f"with {JUDGED}, {_SCORES} select " + ", ".join(f"round(avg({c}), 4) as macro_{c}, round(sum({c} * support) / sum(support), 4) as weighted_{c}" for c in ("precision", "recall", "f1")) + " from rated",
        "classification_report": f"with {JUDGED}, {_SCORES} select label, round(precision, 4) as precision, round(recall, 4) as recall, round(f1, 4) as f1, support from rated union all select 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support)::bigint from rated union all select 'weighted avg', "
        + ", ".join(f"round(sum({c} * support) / sum(support), 4)" for c in ("precision", "recall", "f1")) + ", sum(support)::bigint from rated",
        "confusion_matrix": judged + f", g as (select * from (select unnest({_list(fixed.PRIORITIES)}) as priority) cross join (select unnest({_list(fixed.PRIORITIES)}) as predicted)), c as (select priority, predicted, count(*) as n from judged group by 1, 2) select priority, predicted, coalesce(n, 0) as n from g left join c using (priority, predicted)",
        "misclassified_top": judged + "select row_ord, priority, predicted, replace(left(ticket_text, 80), '|', '\\|') as ticket_text from judged where priority <> predicted order by row_ord limit 10",
        "group_consistency": judged + "select (row_ord // 3)::bigint as g, count(distinct predicted) = 1 as consistent, bool_and(predicted = priority) as perfect from judged group by 1",
        "consistency_score": judged + ", c as (select row_ord // 3 as g, bool_and(predicted = priority) as perfect from judged group by 1) select round(count(*) filter (perfect) * 100 / count(*), 4) as score from c",
        "best_model": judged + f", r as (select *, {_rule('ticket_text', _s('Low'), _s(''))} as low, case when contains(ticket_text, 'refund') then 'Refund' when contains(ticket_text, 'order') then 'Shipping' else 'Account' end as worded from judged), m as ("
        + " union all ".join(f"select '{target}' as target, '{model}' as model, {i} as ord, round(avg(({target} = {v})::int::double), 6) as accuracy from r" for i, (target, model, v) in enumerate((("priority", "low", "low"), ("priority", "predicted", "predicted"), ("priority", "always", "'Medium'"), ("category", "billing", "'Billing'"), ("category", "worded", "worded"), ("category", "account", "'Account'"))))
        + ") select * from m qualify row_number() over (partition by target order by accuracy desc, ord) = 1",
        "promotion_gate": judged + ", s as (select avg((priority = predicted)::int::double) filter (row_ord % 2 = 0) as h, avg((priority = 'Medium')::int::double) filter (row_ord % 2 = 0) as p, avg((priority = predicted)::int::double) filter (row_ord % 2 = 1) as v from judged) select round(h, 6) as holdout, round(p, 6) as production, round(v, 6) as validation, h >= p and v >= 0.85 as promote from s",
        "class_weights": t + "select priority, round(sum(count(*)) over () / (count(*) over () * count(*)), 8) as weight from tickets group by 1",
        "softmax_conf": t + ", s as (" + " union all ".join(f"select ticket_id, '{s}' as name, {_signal('ticket_text', s)} as m from tickets" for s in fixed.SIGNALS) + "), e as (select ticket_id, name, exp(m - max(m) over (partition by ticket_id)) as e from s) select ticket_id, name, round(e / sum(e) over (partition by ticket_id) * 100, 2) as confidence from e",
        "conversation_latest": "select conv_id, turn, role, text from conversations qualify row_number() over (partition by conv_id order by turn desc, role desc, text desc) = 1",
        "tickets_with_agent": f"with {STORE} select ticket_id, coalesce(a.name, 'Unassigned') as agent from kept k left join agents a on a.id = k.assigned_agent_id",
        "recent_tickets": f"with {STORE} select k.id, ticket_id, coalesce(a.name, 'Unassigned') as agent from kept k left join agents a on a.id = k.assigned_agent_id order by created_at desc, k.id desc limit 10",
        "feedback_join": f"with {STORE} select feedback_id, ticket_text, priority as original_priority, coalesce(priority_confidence, confidence) as original_priority_confidence, corrected_priority, validated from feedback join kept using (ticket_id)",
        "feedback_stats": f"with {STORE} select count(*) as total, count(*) filter (validated = 1) as validated, count(*) - count(*) filter (validated = 1) as pending from feedback",
        "feedback_status": f"with {STORE} select case when validated = 1 then 'Validated' else 'Pending Review' end as label, corrected_priority, count(*) as n from feedback group by 1, 2",
        "assign_agent": assigned + "select ticket_id, agent_id, status from out_",
        "reassign_conflicts": assigned + "select department, status, count(*) as n from out_ group by 1, 2",
        "latest_state": f"with {STORE} select ticket_id, id, feedback_id, corrected_priority, validated from feedback qualify row_number() over (partition by ticket_id order by id desc, feedback_id desc, corrected_priority desc, validated desc) = 1",
        "insert_or_ignore": f"with {INCOMING}, o as (select ticket_id, ticket_text, row_ord from tickets where source = 'manual'), n as (select ticket_id, ticket_text, row_ord from incoming where ticket_id not in (select ticket_id from o) qualify row_number() over (partition by ticket_id order by row_ord, ticket_text) = 1) select * from o union all select * from n",
        "dashboard": f"with {STORE} select 'total' as metric, 'tickets' as key, count(*) as n from kept union all " + " union all ".join(f"select '{c}', {c}, count(*) from kept group by {c}" for c in ("category", "priority", "department")) + " union all select 'feedback', case when validated = 1 then 'validated' else 'pending' end, count(*) from feedback group by 2",
        "tfidf_weights": _tfidf(10000, True, False),
        "tfidf_baseline": _tfidf(5000, False, True),
        "tfidf_demo": _tfidf(10, False, True),
        "nb_train": _BAYES + " select label, term, round(logp, 6) as logp from likelihood",
        "nb_predict": _BAYES + ", s as (select ticket_id, label, sum(weight * logp) as s from weighted join likelihood using (term) where ticket_id not in (select ticket_id from train) group by 1, 2) select ticket_id, label as prediction from s join priors using (label) qualify row_number() over (partition by ticket_id order by round(s + prior, 9) desc, label) = 1",
    } | service()
    return known | reports(known)
