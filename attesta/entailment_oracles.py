"""DuckDB SQL of the entailment tier, over the tables that ``oracles.LOCATED`` makes."""

from attesta import constants as K
from attesta.oracles import ANAPHORS, GENERIC, LOCATED, NEGATIONS, NOT_NAMES, STOP, band, clean, content, names, quoted, scored_claims, sentences, verbatim, weights, words

SHARE = "len(list_intersect(ct, {})) / greatest(len(ct), 1)"
TIE = "page_id, rk"


def conflicts(source: str) -> str:
    """``source`` (claim, sent, ...) with ``hit``: whether the two disagree on a slot."""
    known = lambda x: f"list_filter({names(x)}, lambda n: lower(regexp_extract(n, '^\\S+')) not in ({quoted(NOT_NAMES)}))"
    return f"""(select *, len(a) > 0 and len(b) > 0 and len(list_intersect(a, b)) / len(a) >= {K.SLOT_MIN_SHARED} - 1e-9 and (
  list_has_any(c0, [{quoted(NEGATIONS)}]) <> list_has_any(b, [{quoted(NEGATIONS)}])
  or (len(n1) > 0 and len(n2) > 0 and len(list_filter(n1, lambda x: not list_contains(n2, x))) > 0 and len(list_filter(a, lambda x: not list_contains(b, x) and x not in ({quoted(GENERIC)}) and not regexp_full_match(x, '{K.NUMBER}'))) = 0)
  or (len(e1) > 0 and len(e2) > 0 and not list_has_any(e1, e2) and len(list_filter(list_intersect(a, b), lambda x: x not in ({quoted(GENERIC)}))) = 0)) hit
  from (select *, {content(clean('claim'))} a, {content('sent')} b, {content('claim')} c0, regexp_extract_all(claim, '{K.NUMBER}') n1, regexp_extract_all(sent, '{K.NUMBER}') n2, {known('claim')} e1, {known('sent')} e2 from {source}))"""


WIDE = "array_to_string(ss[greatest(pos - 1, 1):pos + 1], ' ')"
#: prem: what a scorer reads of each eligible citation (q).
PREMISES = f"""{LOCATED},
w as materialized ({weights("st", "page_id", "claim")}),
q as materialized (select st.page_id, {clean('claim')} cl, {content(clean('claim'))} ct, target, ps from st join pp using (page_id) where t1 = 'supported' and located and len(ps) > 0),
pg as materialized (select page_id, unnest(range(len(ps))) i, unnest(ps) x from q),
ph as (select page_id, i, round_even(sum(weight) / any_value(total), 4) score from (select distinct page_id, i, unnest({content('x')}) term from pg) join w using (page_id, term) group by page_id, i),
tp as materialized (select page_id, rk, x, {sentences('x')} ss from (select page_id, x, row_number() over (partition by page_id order by coalesce(score, 0) desc, i) - 1 rk from pg left join ph using (page_id, i)) where rk < {K.TOP_K}),
ts as (select {TIE}, unnest(range(len(ss))) k, unnest(ss) s from tp),
tn as (select {TIE}, k, s, row_number() over (partition by {TIE} order by {SHARE.format(content('s'))} desc, k) n from ts join q using (page_id)),
clips as materialized (select *, {sentences('c')} cc from (select {TIE}, case when len(ss) <= 2 then x else j end c from tp left join (select {TIE}, string_agg(s, ' ' order by k) j from tn where n <= 2 group by {TIE}) using ({TIE}))),
bs as (select {TIE}, unnest(range(1, len(cc) + 1)) k, unnest(cc) s from clips),
bv as (select {TIE}, k, {SHARE.format(content('s'))} + (trim(lower(regexp_extract(s, '^\\S+')), ',;:') in ({quoted(ANAPHORS)}))::int v from bs join q using (page_id)),
bp as materialized (select {TIE}, case when len(cc) <= 1 then c when v > 1 and k > 1 then cc[k - 1] || ' ' || cc[k] else cc[k] end p from clips left join (select {TIE}, arg_max(k, (v, -k)) k, max(v) v from bv group by {TIE}) using ({TIE})),
xh as materialized (select {TIE}, p, ss, list_transform(ss, lambda s: case when contains(lower(p), lower(s)) or contains(lower(s), lower(p)) then length(s) else 0 end) h from bp join (select page_id, {sentences('target')} ss from q) using (page_id)),
pm as materialized (select page_id, rk::int i, case when p = '' or coalesce(list_max(h), 0) = 0 or length({WIDE}) > {K.CONTEXT_MAX_CHARS} then p else {WIDE} end premise from (select *, list_position(h, list_max(h)) pos from xh)),
vt as materialized (select page_id, {verbatim('cl')} t, ' ' || array_to_string({verbatim('target')}, ' ') || ' ' l, target from q),
vs as materialized (select page_id, regexp_extract(target, '(?i)(?:^|[^0-9A-Za-z])(' || array_to_string(list_transform(t, lambda x: regexp_escape(x)), '[^0-9A-Za-z]+') || ')(?:[^0-9A-Za-z]|$)', 1) span
  from vt where len(t) >= {K.VERBATIM_MIN_TOKENS} and contains(l, ' ' || array_to_string(t, ' ') || ' ')),
prem as materialized (select page_id, i, premise, 'passage' kind from pm union all select page_id, n::int, span, 'verbatim' from vs join (select page_id, count(*) n from pm group by page_id) using (page_id))"""

NLI = f"""{PREMISES},
tt as materialized (select distinct page_id as key, i, unnest({content('x')}) term from (select page_id, unnest(range(len(ps))) i, unnest(ps) x from pp)), k as (select page_id as key, claim from st), {scored_claims('k')},
nm as (select page_id, low, string_split(regexp_replace(p, '\\s+', ' ', 'g'), ' ') ws from (select page_id, lower(target) low, unnest({names(clean('claim'))}) p from st)),
un as (select distinct page_id from (select page_id, low, array_to_string(ws[list_position(list_transform(ws, lambda w: lower(w) not in ({quoted(NOT_NAMES)})), true):], ' ') p from nm where list_contains(list_transform(ws, lambda w: lower(w) not in ({quoted(NOT_NAMES)})), true))
  where len(list_filter({words('lower(p)')}, lambda t: length(t) >= 3 and t not in ({quoted(STOP)}) and not contains(low, t))) > 0),
sc as materialized (select page_id, i, case when hit then 0 else {SHARE.format(content('sent'))} end ent, case when hit then 0.9 else 0 end con from {conflicts("(select page_id, i, cl claim, ct, premise sent from prem join q using (page_id))")}),
bt as (select page_id, arg_max(ent, (ent, -i)) ent, arg_max(con, (ent, -i)) con from sc group by page_id),
po as (select distinct page_id from {conflicts(f"(select page_id, claim, sent from (select page_id, cl claim, ct, unnest({sentences('premise')}) sent from prem join q using (page_id)) where length(sent) >= {K.POOL_MIN_CHARS} and len(ct) > 0 and {SHARE.format(content('sent'))} >= {K.POOL_MIN_OVERLAP})")} where hit),
r as (select page_id, t1, located, score, case when t1 <> 'supported' then t1 when not located then 'ambiguous' else {band('score')} end s2 from st join compound on key = page_id),
f as (select r.*, bt.page_id is not null el, ent, con, span, po.page_id is not null pooled, case when con >= {K.CONTRADICTION} then 'unsupported' when ent >= {K.ENTAIL_SUPPORTED} then 'supported' when ent >= {K.ENTAIL_AMBIGUOUS} then 'ambiguous' else 'unsupported' end s3
  from r left join bt using (page_id) left join po using (page_id) left join vs using (page_id)),
g as (select *, el and pooled and s3 = 'supported' veto from f),
h as (select *, case when not el then s2 when veto then 'unsupported' else s3 end s4 from g),
u as (select *, s4 = 'supported' and located and t1 = 'supported' and page_id in (select page_id from un) guarded from h)"""

SQL = {
    "premise_pairs": f"with recursive {PREMISES} select page_id::varchar doc_id, kind, i, premise from prem",
    "verdicts_nli": f"""with recursive {NLI} select page_id::varchar doc_id, case when guarded then 'unsupported' else s4 end status, case when el then 3 when t1 = 'supported' then 2 else 1 end tier_reached,
  case when el then round_even(ent, 4)::double when t1 = 'supported' and located then score::double end score,
  (1 + (t1 = 'supported')::int + case when el then 2 + (con >= {K.CONTRADICTION})::int + veto::int + (s4 <> s2)::int + (span is not null)::int else 0 end + guarded::int)::int n_notes from u""",
}
