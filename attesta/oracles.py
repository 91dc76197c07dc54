"""DuckDB SQL over the same tables, one statement for each registered query that SQL can express."""

from __future__ import annotations

from attesta import constants as K


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


# Pieces of SQL. RE2 has no lookbehind, so a sentence's end is marked by a control character first.
WORD = K.WORD.replace("'", "''")
STOP, NOT_NAMES, ANAPHORS, NEGATIONS, GENERIC = ([*map(str, v)] for v in (K.STOPWORDS, K.NOT_NAMES, K.ANAPHORS, K.NEGATIONS, K.GENERIC_TERMS))
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def clean(x: str) -> str:
    links = f"regexp_replace({x}, '\\[([^\\[\\]\\n]+)\\]\\(\\s*([^()\\s]+)\\s*\\)', '\\1', 'g')"
    return flat(f"regexp_replace({links}, '\\[(\\d+)\\]', ' ', 'g')")


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


def content(x: str) -> str:
    kept = f"list_filter({words(x)}, lambda w: length(w) >= 2 or regexp_matches(w, '^[0-9]'))"
    return f"list_distinct(list_filter(list_transform({kept}, lambda w: lower(w)), lambda w: w not in ({quoted(STOP)})))"


def entities(x: str) -> str:
    named = f"list_filter(list_transform(list_filter({words(x)}, lambda w: regexp_matches(w, '^([0-9]|[A-Z].)')), lambda w: lower(w)), lambda w: w not in ({quoted(STOP)}))"
    phrases = f"""list_filter(list_transform(regexp_extract_all({x}, '{K.QUOTED.replace("'", "''")}'), lambda q: lower({strip("q[2:length(q) - 1]")})), lambda q: length(q) >= 2)"""
    return f"list_distinct({named} || {phrases})"


def sentences(x: str) -> str:
    cut = f"string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: s <> '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def verbatim(x: str) -> str:
    return f"""list_transform(regexp_extract_all({x}, '{K.VERBATIM_TOKEN.replace("'", "''")}'), lambda t: lower(t))"""


def runs(x: str, n: int = 6) -> str:
    """Windows of ``n`` of the list ``x``, which should be a plain column."""
    return f"list_transform(range(1, greatest(len({x}) - {n - 2}, 1)), lambda i: array_to_string({x}[i:i + {n - 1}], ' '))"


def names(x: str) -> str:
    """Letters beyond ASCII count as word characters at a boundary."""
    return f"regexp_extract_all(regexp_replace({x}, '[À-ɏ]', '_', 'g'), '\\b[A-Z][a-zA-Z0-9]{{2,}}(?:\\s+[A-Z][a-zA-Z0-9]+)*\\b')"


def band(score: str) -> str:
    return f"case when {score} >= {K.HIGH_OVERLAP} then 'supported' when {score} >= {K.LOW_OVERLAP} then 'ambiguous' else 'unsupported' end"


def line(terms: str) -> str:
    return f"array_to_string(list_sort({terms}), ' ')"


def weights(table: str, key: str, text: str) -> str:
    """(key, term, weight, total) of the cleaned claims of a table."""
    return f"""select {key}, term, max(weight) weight, sum(max(weight)) over (partition by {key}) total from (
    select {key}, unnest({content(clean(text))}) term, {K.CONTENT_WEIGHT} weight from {table} union all select {key}, unnest({entities(clean(text))}), {K.ENTITY_WEIGHT} from {table}) group by {key}, term"""


PASSAGES = f"""p0 as materialized (select key, {sentences(flat("text"))} s from src),
p1 as (select key, s, 1 i, cast([] as varchar[]) done, '' buf, '' bef from p0
  union all select key, s, i + 1, case when sp then list_append(done, buf) else done end, case when sp or buf = '' then f else buf || ' ' || f end, s[i]
  from (select *, buf <> '' and length(buf) + 1 + length(f) > {K.PASSAGE_MAX_CHARS} sp from (
    select *, case when regexp_extract(lower(s[i]), '^\\S+') in ({quoted(ANAPHORS)}) and bef <> '' and ((buf <> '' and length(buf) + 1 + length(s[i]) > {K.PASSAGE_MAX_CHARS}) or not ends_with(buf, bef)) then bef || ' ' || s[i] else s[i] end f
    from p1 where i <= len(s)))),
passages as materialized (select key, case when buf = '' then done when len(done) > 0 and length(buf) < {K.PASSAGE_MIN_CHARS} then list_append(done[1:len(done) - 1], done[len(done)] || ' ' || buf) else list_append(done, buf) end ps
  from p1 where i = len(s) + 1)"""

ITEMS = "(select *, dense_rank() over (order by item_id) - 1 place, (select count(distinct item_id) from benchmark) n_items from benchmark)"
CLAIMS_OF_DOCUMENTS = f"cd as materialized (select doc_id, d.text, b.text claim from documents d join {ITEMS} b on b.place = d.doc_id % b.n_items)"
PAIRS = f"""w as materialized ({weights("benchmark", "item_id", "text")}), t as (select doc_id, unnest({content("text")}) term from documents),
pairs as (select item_id, doc_id, round_even(sum(weight) / any_value(total), 4) score from t join w using (term) group by item_id, doc_id)"""
BEST = f"{PAIRS}, best as (select item_id, arg_max(doc_id, (score, -doc_id)) doc_id, max(score) score from pairs group by item_id), v as (select *, {band('score')} status from best)"


def scored_claims(claims: str) -> str:
    """``compound(key, score)`` for ``claims(key, claim)`` against ``terms(key, i, t)``, i from 1, as CTEs.

    A clause or claim without terms scores 0.
    """
    cut = f"string_split(regexp_replace({clean('claim')}, '{'|'.join(K.CONJUNCTIONS)}', chr(2), 'g'), chr(2))"
    return f"""cl as materialized (select key, claim from {claims}),
cs as materialized (select key, list_filter(list_transform({cut}, lambda c: trim(c)), lambda c: c <> '') c from cl),
ce as materialized (select key, 0 k, claim c from cl union all select key, unnest(range(1, len(c) + 1)), unnest(c) from cs where len(c) > 1),
cw as materialized (select key, k, term, max(weight) weight from (select key, k, unnest({content(clean('c'))}) term, 1.0 weight from ce union all select key, k, unnest({entities(clean('c'))}), 2.0 from ce) group by all),
ct as (select key, k, sum(weight) total from cw group by all),
ch as (select cw.key, k, i, sum(weight) hit from cw join tt on tt.key = cw.key and tt.term = cw.term group by all),
cb as (select ce.key, ce.k, coalesce(max(round_even(hit / total, 4)), 0) score from ce left join ct using (key, k) left join ch using (key, k) group by all),
compound as (select key, case when count(*) > 1 and max(score) filter (k > 0) >= {K.LOW_OVERLAP} and min(score) filter (k > 0) < {K.LOW_OVERLAP} then {K.LOW_OVERLAP} else max(score) filter (k = 0) end score from cb group by key)"""


RAW = "raw as materialized (select page_id, url, case page_id % 10 when 3 then html || '<p>Subscribe to continue reading</p>' when 4 then html || '<p>RETRACTED</p>' when 5 then '<noscript>Turn on scripts</noscript>' else html end html, page_id % 10 <> 7 ok from pages)"
PAYWALL = "'(?i)" + "|".join(f"(?:{p})" for p in K.PAYWALL).replace("'", "''") + "'"
RETRACTION = "'(?i)" + "|".join(f"(?:{p})" for p in K.RETRACTION) + "'"


def norm(url: str) -> str:
    shape = "'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*'"
    return f"(lower(regexp_extract({url}, {shape})) || regexp_replace({url}, {shape}, ''))"


def html_text(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    return flat(f"regexp_replace({bare}, '(?s)<[^>]+>', ' ', 'g')")


TIER1 = f"case when not ok then 'unreachable' when regexp_matches(html, {PAYWALL}) then 'paywalled' when regexp_matches(html, {RETRACTION}) then 'unsupported' else 'supported' end"
CITED = f"""{RAW}, pt as materialized (select page_id, {html_text('html')} text, {TIER1} t1 from raw), own as (select page_id, {html_text('html')} text from pages),
src as materialized (select 2 * page_id key, text from own union all select 2 * page_id + 1, text from pt),
{PASSAGES},
cit as materialized (select p.page_id, p.page_id % 50 <> 1 known, case when p.page_id % 4 = 0 then b.text else ps[1] end claim, case when p.page_id % 4 = 2 then b.text end excerpt
  from pages p join {ITEMS} b on b.place = p.page_id % b.n_items join passages on key = 2 * p.page_id)"""

PAGE_URL = "'http://h' || (doc_id // 10 % 50) || '/' || (doc_id // 10)"
CASES = f"""cases as materialized (select doc_id::varchar id, ([{quoted(sorted(K.CANONICAL))}])[(doc_id % 12 + 1)::int] category,
  case when toxic = 1 then 'unsupported' when quality = 0 and doc_id % 2 = 0 then 'ambiguous' when quality = 0 then 'unsupported' else 'supported' end expected_status,
  ([{quoted(K.CONFIDENCES)}])[(doc_id % 3 + 1)::int] labeler_confidence, case when doc_id % 97 = 3 then 'http://lost/' || doc_id else {PAGE_URL} end url, coalesce(s[1], '') claim, '' notes, coalesce(s[-1], '') sup, 'nothing like this is said anywhere at all' unsup, doc_id
  from (select labels.*, {sentences("coalesce(text, '')")} s from labels join documents using (doc_id)))"""


def records(arm: int = 0, name: str = "rec") -> str:
    r = f"((doc_id * 7 + {arm * 3}) % 10)"
    said = f"case when {r} < 6 then expected_status when {r} = 6 then 'supported' when {r} = 7 then 'unsupported' when {r} = 8 then 'error' else 'paywalled' end"
    return f"{name} as materialized (select *, predicted = expected m from (select id, doc_id, category, expected_status expected, {said} predicted, doc_id % 3 + 1 tier_reached, url, labeler_confidence from cases))"


RECORDS = f"with {CASES}, {records()}"
BOTH = f"{RECORDS}, {records(1, 'rec1')}"
Z = K.Z95


def wilson(k: str, n: str) -> tuple[str, str]:
    p = f"({k} / {n}::double)"
    centre, half, wide = f"({p} + {Z * Z} / (2 * {n}))", f"({Z} * sqrt({p} * (1 - {p}) / {n} + {Z * Z} / (4.0 * {n} * {n})))", f"(1 + {Z * Z} / {n})"
    return f"greatest(0, ({centre} - {half}) / {wide})", f"least(1, ({centre} + {half}) / {wide})"


STATUS_ROWS = f"(select unnest([{quoted(K.STATUSES)}]) status)"
CANON_ROWS = f"(select unnest([{quoted(K.CANONICAL)}]) category, unnest([{quoted(K.CANONICAL.values())}]) canonical_status)"


def authorable(s: str) -> str:
    n = f"len(list_filter(string_split(regexp_replace({s}, '\\s+', ' ', 'g'), ' '), lambda w: w <> ''))"
    return f"{n} between {K.SENTENCE_WORDS[0]} and {K.SENTENCE_WORDS[1]} and regexp_full_match({s}, '[A-Za-z0-9 ,.\\-''’%$£€/]+') and regexp_matches({s}, '^[A-Z]') and ends_with({s}, '.') and (regexp_matches({s}, '\\d') or regexp_matches({s}[2:], '\\b[A-Z][a-z]{{3,}}'))"


CANDIDATES = f"""cand as materialized (select doc_id page_id, row_number() over (partition by doc_id order by i) - 1 i, s sentence, count(*) over (partition by doc_id) n
  from (select doc_id, unnest(range(len(s))) i, unnest(s) s from (select doc_id, {sentences('text')} s from documents)) where {authorable('s')})"""
NEGATED = "case " + " ".join(f"when instr(sentence, '{a}') > 0 then instr(sentence, '{a}') + {len(a) - 1}" for a in K.AUXILIARIES) + " end"
SWAP_AT = "length(regexp_extract(s, '^(.*?[a-z] )[A-Z][a-z]{3,}', 1))"

#: Citations with their page (st) and its passages (pp), for the second tier.
LOCATED = f"""{CITED}, ex as materialized (select page_id, excerpt from cit where excerpt is not null),
xs as materialized (select page_id as key, {sentences(flat('excerpt'))} s from ex),
x1 as (select key, s, 1 i, cast([] as varchar[]) done, '' buf from xs union all select key, s, i + 1, case when sp then list_append(done, buf) else done end, case when sp or buf = '' then s[i] else buf || ' ' || s[i] end
from (select *, buf <> '' and length(buf) + 1 + length(s[i]) > {K.PASSAGE_MAX_CHARS} sp from x1 where i <= len(s))),
xp as (select key, case when len(done) > 0 and length(buf) < {K.PASSAGE_MIN_CHARS} then list_append(done[1:len(done) - 1], done[len(done)] || ' ' || buf) else list_append(done, buf) end ps from x1 where i = len(s) + 1),
st as materialized (select cit.page_id, case when known then t1 else 'unreachable' end t1, excerpt is not null or length(text) >= {K.MIN_PAGE_CHARS} located, coalesce(excerpt, text) target, claim from cit join pt using (page_id)),
pp as materialized (select st.page_id, coalesce(xp.ps, ps2.ps) ps from st left join xp on xp.key = st.page_id left join passages ps2 on ps2.key = 2 * st.page_id + 1)"""

I = "doc_id::varchar"
CASE_PAGES = f"pool as materialized (select url, k % 13 <> 1 ok, case when k % 11 <> 2 then t end text from (select {PAGE_URL} url, string_agg(text, chr(10) order by doc_id) t, min(doc_id) k from documents group by 1))"


def shingles(x: str) -> str:
    """A list expression; words by white space."""
    return f"list_transform([list_filter(string_split({flat(f'lower({x})')}, ' '), lambda w: w <> '')], lambda t: list_transform(range(1, greatest(len(t) - 4, 1)), lambda i: array_to_string(t[i:i + 5], ' ')))[1]"



def oracle_sql() -> dict[str, str]:
    low, high = wilson("correct", "total")
    lown, highn = wilson("correct", "n")
    lowm, highm = wilson("matched", "total")
    slot = f"""d as (select doc_id, unnest(range(len(s))) i, unnest(s) s from (select doc_id, {sentences('text')} s from documents)),
p as (select doc_id, lag(s) over (partition by doc_id order by i) claim, s || ' not 12' sent from d),
q as materialized (select doc_id, claim, sent, {content(clean('claim'))} a, {content('sent')} b, {content('claim')} c0, regexp_extract_all(claim, '{K.NUMBER}') n1, regexp_extract_all(sent, '{K.NUMBER}') n2,
  list_filter({names('claim')}, lambda x: lower(regexp_extract(x, '^\\S+')) not in ({quoted(NOT_NAMES)})) e1, list_filter({names('sent')}, lambda x: lower(regexp_extract(x, '^\\S+')) not in ({quoted(NOT_NAMES)})) e2 from p where claim is not null),
r as (select doc_id, len(a) > 0 and len(b) > 0 and len(list_intersect(a, b)) / len(a) >= {K.SLOT_MIN_SHARED} - 1e-9 and (
  list_has_any(c0, [{quoted(NEGATIONS)}]) <> list_has_any(b, [{quoted(NEGATIONS)}])
  or (len(n1) > 0 and len(n2) > 0 and len(list_filter(n1, lambda x: not list_contains(n2, x))) > 0 and len(list_filter(a, lambda x: not list_contains(b, x) and x not in ({quoted(GENERIC)}) and not regexp_full_match(x, '{K.NUMBER}'))) = 0)
  or (len(e1) > 0 and len(e2) > 0 and not list_has_any(e1, e2) and len(list_filter(list_intersect(a, b), lambda x: x not in ({quoted(GENERIC)}))) = 0)) hit from q)"""
    best = f"""c as materialized (select doc_id, {content(clean('claim'))} ct, {sentences('text')} s, text from cd),
e as (select doc_id, unnest(range(1, len(s) + 1)) i, unnest(s) x from c),
o as materialized (select doc_id, i, x, len(list_intersect(ct, {content('x')})) / greatest(len(ct), 1) ov, trim(lower(regexp_extract(x, '^\\S+')), ',;:') in ({quoted(ANAPHORS)}) an from e join c using (doc_id)),
b as (select doc_id, arg_max(i, (ov + an::int, -i)) i, max(ov + an::int) v from o group by doc_id),
t as (select doc_id, string_agg(x, ' ' order by i) clip from (select *, row_number() over (partition by doc_id order by ov desc, i) k from o) where k <= 2 group by doc_id)"""
    return {
        "claim_terms": f"select item_id, {line(content('text'))} terms from benchmark",
        "entity_terms": f"select item_id, {line(entities('t'))} terms from (select item_id, text || ' He said \"Two Words\" in 3.5 days.' t from benchmark)",
        "term_weights": f"select item_id, term, max(weight)::double weight from (select item_id, unnest({content('text')}) term, 1.0 weight from benchmark union all select item_id, unnest({entities('text')}), 2.0 from benchmark) group by all",
        "sentences": f"select doc_id, unnest(range(len(s)))::int i, unnest(s) sentence from (select doc_id, {sentences('text')} s from documents)",
        "sentence_stats": f"select lang, count(*) n_docs, sum(n)::bigint n_sentences, max(n)::bigint most_sentences, sum(t)::bigint n_terms from (select lang, len({sentences('text')}) n, len({content('text')}) t from documents) group by lang",
        "passages": f"with recursive src as (select doc_id as key, text from documents), {PASSAGES} select key doc_id, unnest(range(len(ps)))::int i, unnest(ps) passage from passages",
        "context_window": f"""select doc_id, i::int i, case when length(w) > {K.CONTEXT_MAX_CHARS} then x else w end context from (select doc_id, i, x, string_agg(x, ' ') over (partition by doc_id order by i rows between 1 preceding and 1 following) w
            from (select doc_id, unnest(range(len(s))) i, unnest(s) x from (select doc_id, {sentences('text')} s from documents)))""",
        "antecedents": f"select * from (select doc_id, i::int i, sentence, lag(sentence) over (partition by doc_id order by i) before from (select doc_id, unnest(range(len(s))) i, unnest(s) sentence from (select doc_id, {sentences('text')} s from documents))) where lower(regexp_extract(sentence, '^\\S+')) in ({quoted(ANAPHORS)})",
        "evidence_clips": f"select doc_id, case when length(t) <= 300 then t else regexp_replace(t[1:299], '\\s+$', '') || '…' end evidence from (select doc_id, {strip('text')} t from documents)",
        "best_sentences": f"with {CLAIMS_OF_DOCUMENTS}, {best} select doc_id, case when len(s) <= 1 then c.text when b.v > 1 and b.i > 1 then s[b.i - 1] || ' ' || s[b.i] else s[b.i] end best, case when len(s) <= 2 then c.text else clip end clip from c left join b using (doc_id) left join t using (doc_id)",
        "contradiction_pool": f"with {CLAIMS_OF_DOCUMENTS}, c as (select doc_id, {content(clean('claim'))} ct, {sentences('text')} s from cd) select doc_id, len(list_filter(s, lambda x: length(x) >= {K.POOL_MIN_CHARS} and len(list_intersect(ct, {content('x')})) / greatest(len(ct), 1) >= 0.2))::bigint n_pool from c",
        "negated_sentences": f"select item_id, count_if(list_has_any({content('s')}, [{quoted(NEGATIONS)}]))::bigint n_negated, count(*) n from (select item_id, unnest({sentences('t')}) s from (select item_id, text || ' It is not so. Nobody never came.' t from benchmark)) group by item_id",
        "slot_conflicts": f"with {slot} select doc_id, count_if(hit)::bigint n_conflicts, count(*) n_pairs from r group by doc_id",
        "proper_nouns": f"select doc_id, {line(f'''list_distinct(list_filter({names('text')}, lambda x: lower(regexp_extract(x, '^\\S+')) not in ({quoted(NOT_NAMES)})))''')} names from documents",
        "ungrounded_entities": f"""with {CLAIMS_OF_DOCUMENTS}, a as (select doc_id, lower(text) low, unnest(range(len(n))) i, unnest(n) p from (select doc_id, text, {names('claim')} n from cd)),
            b as (select doc_id, low, string_split(regexp_replace(p, '\\s+', ' ', 'g'), ' ') ws from a),
            c as (select doc_id, low, array_to_string(ws[list_position(list_transform(ws, lambda w: lower(w) not in ({quoted(NOT_NAMES)})), true):], ' ') p from b where list_contains(list_transform(ws, lambda w: lower(w) not in ({quoted(NOT_NAMES)})), true)),
            g as (select doc_id, list(p) ps from c where len(list_filter({words('lower(p)')}, lambda t: length(t) >= 3 and t not in ({quoted(STOP)}) and not contains(low, t))) > 0 group by doc_id)
            select doc_id, {line('coalesce(ps, [])')} names from cd left join g using (doc_id)""",
        "probe_sentences": f"select item_id, case when len(l) > 0 then len(l) else len(s) end::bigint n from (select item_id, s, list_filter(s, lambda x: length(x) >= 12) l from (select item_id, {sentences('text')} s from benchmark))",
        "best_source": f"with {BEST} select item_id, doc_id, score, status from v",
        "topk_sources": f"with {PAIRS} select item_id, doc_id, score, rank::int rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from pairs) where rank <= {K.TOP_K}",
        "status_histogram": f"with {BEST} select {', '.join(f'''count_if(status = '{s}')::bigint {s}''' for s in K.VERDICTS)} from v",
        "report_rollup": f"with {BEST} select count(*) total, count_if(status = 'supported')::bigint supported, count_if(status = 'unsupported')::bigint unsupported, count_if(status not in ('supported', 'unsupported'))::bigint unverifiable, round_even(count_if(status = 'supported') / count(*), 4) pass_rate from v",
        "exit_rule": f"with {BEST} select round_even(count_if(status = 'supported') / count(*), 4) pass_rate, (round_even(count_if(status = 'supported') / count(*), 4) < 0.5 or count_if(status in ('ambiguous', 'unsupported')) > 0)::int exit_code from v",
        "verbatim_support": f"with b as (select item_id, {verbatim('text')} t from benchmark), d as materialized (select doc_id, ' ' || array_to_string({verbatim('text')}, ' ') || ' ' l from documents) select item_id, doc_id from b join d on contains(l, ' ' || array_to_string(t, ' ') || ' ') where len(t) >= {K.VERBATIM_MIN_TOKENS}",
        "positional_runs": f"""with bt as (select item_id, {verbatim('text')} t from benchmark), dt as (select doc_id, {verbatim('text')} t from documents),
            b as (select item_id, unnest(range(1, greatest(len(t) - 4, 1))) i, unnest({runs('t')}) g from bt), d as (select doc_id, unnest(range(1, greatest(len(t) - 4, 1))) j, unnest({runs('t')}) g from dt),
            m as (select item_id, doc_id, i, j - i dg, i - row_number() over (partition by item_id, doc_id, j - i order by i) isl from b join d using (g)), r as (select item_id, doc_id, dg, isl, count(*) + 5 n from m group by all)
            select item_id, doc_id, max(n)::bigint longest from r group by all""",
        "shingle_overlap": f"with b as (select distinct item_id, unnest({shingles('text')}) g from benchmark), d as (select distinct doc_id, unnest({shingles('text')}) g from documents) select item_id, doc_id, count(*) shared from b join d using (g) group by all",
        "contaminated_docs": f"select distinct doc_id from (select doc_id, unnest({shingles('text')}) g from documents) where g in (select unnest({shingles('text')}) from benchmark)",
        "clean_docs": f"select doc_id from documents where doc_id not in (select doc_id from (select doc_id, unnest({shingles('text')}) g from documents) where g in (select unnest({shingles('text')}) from benchmark))",
        "ngram_counts": f"select gram, count(*) n from (select unnest({runs('t')}) gram from (select {tokens('text')} t from conversations)) group by gram having count(*) > 1",
        "compound_clauses": f"select item_id, unnest(range(len(c)))::int i, unnest(c) clause from (select item_id, list_filter(list_transform(string_split(regexp_replace({clean('x')}, '{'|'.join(K.CONJUNCTIONS)}', chr(2), 'g'), chr(2)), lambda y: trim(y)), lambda y: y <> '') c from (select item_id, text || ' and also more [1] but [less](u) while and' x from benchmark))",
        "compound_score": f"with {CLAIMS_OF_DOCUMENTS}, k as (select doc_id as key, claim from cd), tt as materialized (select distinct doc_id as key, i, unnest({content('x')}) term from (select doc_id, unnest(range(len(s))) i, unnest(s) x from (select doc_id, {sentences('text')} s from cd))), {scored_claims('k')} select key doc_id, score::double score from compound",
        "html_text": f"select page_id, length(t)::bigint n_chars, sha256(t) text_sha256 from (select page_id, {html_text('html')} t from pages)",
        "table_prose": "select n_nationkey, 'Intro. ' || n_name || '. key was ' || n_nationkey || '. empty. region was ' || n_regionkey || '. End.' prose from nation",
        "page_hosts": "select regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) host, count(*) n from pages group by 1",
        "normalized_urls": f"select page_id, {norm('u')} norm_url from (select page_id, regexp_replace(url, '^http://', 'HTTP://User@') u from pages)",
        "cache_keys": f"select page_id, sha256({norm('url')} || '|' || page_id)[1:40] || '.json' cache_key from pages",
        "reachability": f"with {RAW} select {TIER1} status, count(*) n from raw group by 1",
        "usable_pages": f"with {RAW} select {norm('url')} norm_url from raw where ok and length({html_text('html')}) >= {K.USABLE_PAGE_CHARS}",
        "fresh_cache": "select 'http://h/' || user_id norm_url, arg_max(event_id, ts) event_id from events where ts between timestamp '2024-01-19 00:00:00' and timestamp '2024-01-20 00:00:00' group by 1",
        "robots": "select page_id, not starts_with(p, '/fr') or starts_with(p, '/fr/8') allowed from (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) p from pages)",
        "retry_after": "select event_id, case when n >= 0 then least(n, 30.0)::double end \"seconds\" from (select event_id, case when event_type <> 'error' then (value - 10)::decimal(10, 2)::double end n from events)",
        "extract_markers": f"""select {I} doc_id, 0 seq, '1' citation_id, 'http://one/' || doc_id url, 'First by ' || source || ' says [1].' claim from documents
            union all select {I}, 1, 'see A. B ' || doc_id, 'http://h/' || doc_id, 'Then [see A.' from documents
            union all select {I}, 2, '2', 'http://two/' || doc_id, 'All in ' || lang || ' [2] and [9] here?' from documents
            union all select {I}, 3, '3', 'http://three/' || doc_id, 'Next [3][1]!' from documents
            union all select {I}, 4, '1', 'http://one/' || doc_id, 'Next [3][1]!' from documents""",
        "dropped_markers": f"select {I} doc_id, '[9]' marker, 'All in ' || lang || ' [2] and [9] here?' context from documents",
        "url_map_priority": f"""select {I} doc_id, 0 seq, '1' citation_id, 'http://over' url from documents union all select {I}, 1, 'see A. B ' || doc_id, 'http://h/' || doc_id from documents
            union all select {I}, 2, '2', 'http://two/' || doc_id from documents union all select {I}, 3, '9', 'http://given' from documents
            union all select {I}, 4, '3', 'http://three/' || doc_id from documents union all select {I}, 5, '1', 'http://over' from documents""",
        "json_citations": """select item_id::varchar doc_id, 0 seq, 'c1' citation_id, 'http://s/' || item_id url, text claim, null::varchar excerpt from benchmark
            union all select item_id::varchar, 1, 'c2', './p/' || item_id, 'x', 'quoted' from benchmark""",
        "verdicts_tier1": f"with {RAW} select page_id::varchar doc_id, case when page_id % 50 = 1 then 'unreachable' else {TIER1} end status, 1 tier_reached from raw",
        "verdicts": f"""with recursive {LOCATED},
            tt as materialized (select distinct page_id as key, i, unnest({content('x')}) term from (select page_id, unnest(range(len(ps))) i, unnest(ps) x from pp)), k as (select page_id as key, claim from st), {scored_claims('k')},
            nm as (select page_id, low, string_split(regexp_replace(p, '\\s+', ' ', 'g'), ' ') ws from (select page_id, lower(target) low, unnest({names(clean('claim'))}) p from st)),
            un as (select distinct page_id from (select page_id, low, array_to_string(ws[list_position(list_transform(ws, lambda w: lower(w) not in ({quoted(NOT_NAMES)})), true):], ' ') p from nm where list_contains(list_transform(ws, lambda w: lower(w) not in ({quoted(NOT_NAMES)})), true))
              where len(list_filter({words('lower(p)')}, lambda t: length(t) >= 3 and t not in ({quoted(STOP)}) and not contains(low, t))) > 0),
            r as (select page_id, t1, located, score, case when t1 <> 'supported' then t1 when not located then 'ambiguous' else {band('score')} end s2 from st join compound on key = page_id)
            select page_id::varchar doc_id, case when s2 = 'supported' and located and t1 = 'supported' and page_id in (select page_id from un) then 'unsupported' else s2 end status, case when t1 = 'supported' then 2 else 1 end tier_reached, case when t1 = 'supported' and located then score::double end score from r""",
        "entailment_bands": f"""select doc_id, case when doc_id % 13 = 0 then 'ambiguous' when f = 'supported' and pooled >= {K.CONTRADICTION} then 'unsupported' else f end status, case when doc_id % 13 = 0 then 2 else 3 end tier_reached, case when doc_id % 13 <> 0 then round_even(ent, 4) end score
            from (select doc_id, ent, pooled, case when quality <> 1 then 'ambiguous' when con >= {K.CONTRADICTION} then 'unsupported' when ent >= {K.ENTAIL_SUPPORTED} then 'supported' when ent >= {K.ENTAIL_AMBIGUOUS} then 'ambiguous' else 'unsupported' end f
              from (select doc_id, quality, (doc_id % 11) / 10 ent, (doc_id % 7) / 10 con, (doc_id % 5) / 5 pooled from labels))""",
        "combined_clauses": f"select l_orderkey, case when count(*) > 1 and max(s) >= {K.ENTAIL_AMBIGUOUS} and min(s) < {K.ENTAIL_AMBIGUOUS} then {K.ENTAIL_AMBIGUOUS}::double else min(s) end score from (select l_orderkey, round_even(l_discount * 10, 2) s from lineitem) group by l_orderkey",
        "confusion_matrix": f"{RECORDS} select status expected, {', '.join(f'''coalesce(count_if(predicted = '{s}'), 0)::bigint {s}''' for s in K.STATUSES)} from {STATUS_ROWS} left join rec on expected = status group by status",
        "category_recall": f"{RECORDS} select c.category, canonical_status, count(id) total, coalesce(count_if(predicted = canonical_status), 0)::bigint correct, case when count(id) = 0 then 'nan'::double else count_if(predicted = canonical_status) / count(id) end recall from {CANON_ROWS} c left join rec on rec.category = c.category group by 1, 2",
        "status_pr": f"""{RECORDS}, x as (select status, count_if(expected = status and predicted = status)::bigint tp, count_if(expected <> status and predicted = status)::bigint fp, count_if(expected = status and predicted <> status)::bigint fn from {STATUS_ROWS}, rec group by status)
            select *, case when tp + fp = 0 then 'nan'::double else tp / (tp + fp) end "precision", case when tp + fn = 0 then 'nan'::double else tp / (tp + fn) end recall from x""",
        "safety_rate": f"{RECORDS} select category, count_if(predicted = 'supported' and expected = 'unsupported')::bigint false_supported, count(*) total, count_if(predicted = 'supported' and expected = 'unsupported') / count(*) rate from rec where category in ('negation-flip', 'entity-swap') group by 1",
        "agreement_by_tier": f"{RECORDS}, g as (select tier_reached::int tier, count_if(m)::bigint correct, count(*) total from rec group by 1) select *, correct / total agreement, {low} low, {high} high from g",
        "confidence_breakdown": f"{RECORDS} select labeler_confidence, count_if(m)::bigint correct, count(*) total, count_if(m) / count(*) agreement from rec group by 1",
        "ablation": f"""{BOTH}, a as (select 'one' config, * from rec union all select 'two', * from rec1),
            g as (select config, tier_reached::int tier, labeler_confidence confidence, count_if(m)::bigint matched, count(*) total from a group by grouping sets ((config), (config, tier_reached), (config, labeler_confidence)))
            select *, round_even(100 * (matched / total), 2) accuracy_pct, round_even(100 * {lowm}, 2) low_pct, round_even(100 * {highm}, 2) high_pct from g""",
        "mcnemar": f"""{BOTH}, x as (select count_if(b.m and not a.m)::bigint b, count_if(a.m and not b.m)::bigint c from rec a join rec1 b using (id))
            select b, c, b::double statistic, case when b = c then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))) from range(least(b, c) + 1) t(k))) end p_value from x""",
        "run_diff": f"{BOTH} select id, a.category, case when b.m then 'gained' else 'lost' end change from rec a join rec1 b using (id) where a.m <> b.m",
        "family_deltas": f"{BOTH} select a.category, count_if(a.m)::bigint base_correct, count(*) base_total, count_if(b.m)::bigint rule_correct, count(*) rule_total, (count_if(b.m) - count_if(a.m))::bigint delta from rec a join rec1 b using (id) group by 1",
        "acceptance_gate": f"""{BOTH}, d as (select a.category, (count_if(b.m) - count_if(a.m))::bigint delta from rec a join rec1 b using (id) group by 1), g as (select coalesce(sum(delta) filter (category = 'partially-true-mixed'), 0)::bigint gain, sum(delta)::bigint overall, greatest(0, max(-delta))::bigint worst_loss from d)
            select *, gain >= 0 and overall >= -2 and worst_loss <= 2 passed from g""",
        "contrast": f"""{RECORDS}, g as (select url, min(id) filter (expected = 'supported') positive_id, count_if(expected = 'supported') p, count_if(expected = 'unsupported') n, coalesce(bool_or(predicted = 'supported' and category = 'negation-flip') filter (expected = 'unsupported'), false) pol,
              coalesce(bool_or(predicted = 'supported' and category <> 'negation-flip') filter (expected = 'unsupported'), false) bind from rec where category is not null or expected <> 'unsupported' group by url)
            select g.url, positive_id, case when predicted <> 'supported' then 'miss' when pol and bind then 'polarity-bug+binding-bug' when pol then 'polarity-bug' when bind then 'binding-bug' else 'clean' end verdict from (select url, count_if(expected = 'unsupported') nn from rec group by url) z join g using (url) join rec on id = positive_id where p > 0 and nn >= 2""",
        "model_scores": f"""{BOTH}, a as (select 'base' model, * from rec union all select 'large', * from rec1), g as (select model, category, count_if(m)::bigint correct, count(*) total, count_if(expected = 'unsupported' and predicted = 'supported')::bigint false_supported, count_if(expected = 'unsupported')::bigint unsupported from a group by 1, 2)
            select *, round_even(correct / total, 4) recall, case when unsupported > 0 then round_even(false_supported / unsupported, 4) end false_rate from g""",
        "arm_summary": f"{BOTH}, a as (select 'arm0' arm, * from rec union all select 'arm1', * from rec1) select arm, count_if(expected = p)::bigint correct, count(*) total, count_if(expected = 'unsupported' and p = 'supported')::bigint false_supported from (select *, predicted p from a) group by 1",
        "arm_flips": f"{BOTH} select id, case when a.predicted = 'error' then 'error: timeout' else a.predicted end a, case when b.predicted = 'error' then 'error: timeout' else b.predicted end b from rec a join rec1 b using (id) where a.predicted <> b.predicted",
        "set_summary": f"with {CASES} select category, count(*) n_cases, count(distinct regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) n_hosts from cases group by 1",
        "baselines": f"""{RECORDS}, b as (select count(*) n, count_if(expected = 'supported')::bigint s, count_if(expected = 'unsupported')::bigint u, count_if(expected = case when tier_reached = 1 then 'supported' else 'unsupported' end)::bigint t from rec), mx as (select max(c) m from (select count(*) c from rec group by expected)),
            r as (select unnest(['always_supported', 'always_unsupported', 'majority_class', 'tier1_always_supported']) name, unnest([s, u, m, t])::bigint correct, n from b, mx) select *, correct / n accuracy, {lown} low, {highn} high from r""",
        "uncertainty": f"{RECORDS}, s as (select 'all' scope, m from rec union all select category, m from rec where category in ('negation-flip', 'entity-swap')), g as (select scope, count_if(m)::bigint correct, count(*) total from s group by 1) select scope, correct, total, round_even({low}, 4) low, round_even({high}, 4) high from g",
        "sweep_grid": SWEPT,
        "sweep_best": f"select * from ({SWEPT}) order by agreement desc, swap_false, negation_false desc, min_overlap, margin limit 10",
        "authorable_sentences": f"with {CANDIDATES} select page_id, i::int i, sentence from cand",
        "spread_sentences": f"with {CANDIDATES} select page_id, i::int i, sentence from cand where i % greatest(1, n // 28) = 0",
        "negation_flip": f"with {CANDIDATES}, e as (select *, {NEGATED} cut from cand) select page_id, i::int i, sentence[1:cut] || 'not ' || sentence[cut + 1:] claim, len({tokens('sentence[1:cut]')})::bigint edit from e where cut is not null",
        "entity_swap": f"""with {CANDIDATES}, e as (select page_id, i, 'So Lorem ' || sentence s, text from cand join documents on doc_id = page_id), f as (select *, {SWAP_AT} cut, list_filter([{quoted(K.SWAP_NAMES)}], lambda n: not contains(lower(text), lower(n)))[1] nm from e)
            select page_id, i::int i, s[1:cut] || nm || regexp_replace(s[cut + 1:], '^[A-Z][a-z]{{3,}}', '') claim, len({tokens('s[1:cut]')})::bigint edit from f where cut > 0 and nm is not null""",
        "crossing_ngrams": f"select item_id, unnest({runs('t[1:10]')}) gram from (select item_id, {tokens('text')} t from benchmark)",
        "label_problems": f"""with {CASES}, {CASE_PAGES}, d as (select c.*, p.ok, p.text ptext from cases c left join pool p using (url)), s as (select *, case when ptext is not null then list_has_any({shingles('claim')}, {shingles('ptext')}) end sh from d),
            r as (select id, case when ok is null then 'url-not-in-pool' when ptext is null and ok then 'no-saved-text' when expected_status = 'supported' and not sh then 'supported-but-absent' when expected_status = 'unsupported' and sh then 'unsupported-but-present' end rule from s)
            select id, rule from r where rule is not null union all select url, 'too-few-negatives' from d where ok is not null group by url having count_if(expected_status = 'supported') > 0 and count_if(expected_status = 'unsupported') < 2""",
        "case_problems": f"""with {CASES}, {CASE_PAGES}, d as (select c.*, p.ok, p.text ptext from cases c left join pool p using (url)), s as (select *, category is null miss, case when ptext is not null then list_has_any({shingles('sup')}, {shingles('ptext')}) end sh, case when ptext is not null then list_has_any({shingles('unsup')}, {shingles('ptext')}) end uh from d),
            r as (select id, unnest([case when miss then {{'severity': 'problem', 'rule': 'missing-keys'}} end, case when not miss and not starts_with(id, '1') then {{'severity': 'problem', 'rule': 'id-prefix'}} end, case when not miss and trim(claim) = '' then {{'severity': 'problem', 'rule': 'empty-claim'}} end,
              case when not miss and ok is null and expected_status not in ('unreachable', 'paywalled') then {{'severity': 'problem', 'rule': 'url-not-in-pool'}} end, case when not miss and ok and ptext is null then {{'severity': 'problem', 'rule': 'no-saved-text'}} end,
              case when not miss and not sh then {{'severity': 'problem', 'rule': 'supported-clause-absent'}} end, case when not miss and uh then {{'severity': 'warning', 'rule': 'unsupported-clause-present'}} end]) x from s)
            select id, x.severity severity, x.rule rule from r where x is not null union all select id, 'problem', 'id-collision' from cases where expected_status = 'ambiguous' union all select distinct url, 'warning', 'url-reused' from cases where url in (select url from cases where expected_status = 'ambiguous')""",
        "perf_subset": f"with {CASES} select id, expected_status from cases where expected_status in ('supported', 'unsupported', 'ambiguous') order by doc_id limit 5",
    }


SWEPT = f"""with {CASES}, c as (select id, doc_id, category, expected_status expected, (doc_id % 10) / 10 ent from cases), s as (select id, ((doc_id + j * 3) % 11) / 10 overlap, ((doc_id * 3 + j) % 10) / 10 con from c, range(4) t(j) where j <= doc_id % 4),
g as (select mo::double min_overlap, mg::double margin from (select unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0]) mo), (select unnest([0.0, 0.05, 0.1, 0.15, 0.2, 0.3]) mg)),
x as (select min_overlap, margin, c.id, category, expected, ent, coalesce(max(con), 0) con from g cross join c left join s on s.id = c.id and overlap >= min_overlap group by all),
y as (select *, case when ent < {K.ENTAIL_SUPPORTED} or (con >= {K.CONTRADICTION} and con > ent + margin) then 'unsupported' else 'supported' end p from x)
select min_overlap, margin, count_if(p = expected)::bigint agreement, count_if(expected = 'unsupported' and p = 'supported' and category = 'negation-flip')::bigint negation_false, count_if(expected = 'unsupported' and p = 'supported' and category = 'entity-swap')::bigint swap_false from y group by 1, 2"""
