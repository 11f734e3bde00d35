"""The results of the queries in DuckDB SQL, where it can express them."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The patterns are written out again, one condition each, so that the rule language is checked too.
_URLS = f"""
with split as (
  select page_id, url, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') as bare,
         case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') else '' end as raw_host,
         case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
named as (select *, translate(raw_host, '{_UPPER}', '{_LOWER}') as host from split),
sites(rule, verdict) as (values ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
fitting as (
  select n.*, (select max(struct_pack(size := length(s.rule), rule := s.rule, verdict := s.verdict)) from sites s
               where (n.host = split_part(s.rule, '/', 1) or ends_with(n.host, '.' || split_part(s.rule, '/', 1)))
                 and starts_with(n.path, substr(s.rule, instr(s.rule, '/')))) as best
  from named n),
patterned as (
  select *, least(
    case when contains(bare, '://') and regexp_matches(bare, '^.*?://(?:[^/?#]*\\.)?edu(?:[^0-9a-z_.%-]|$)') then '||edu^' end,
    case when contains(bare, '://') and regexp_matches(bare, '^.*?://(?:[^/?#]*\\.)?gov(?:[^0-9a-z_.%-]|$)') then '||gov^' end) as allowed,
  least(
    case when contains(bare, '/ads/') then '/ads/' end,
    case when regexp_matches(bare, '^.*?://(?:[^/?#]*\\.)?ads\\.') then '||ads.' end,
    case when regexp_matches(bare, '^.*?://(?:[^/?#]*\\.)?doubleclick\\.') then '||doubleclick.' end,
    case when regexp_matches(bare, '[^0-9a-z_.%-]utm_source=') then '^utm_source=' end,
    case when regexp_matches(bare, '[^0-9a-z_.%-]gclid=') then '^gclid=' end,
    case when regexp_matches(bare, '[^0-9a-z_.%-]sessionid=') then '^sessionid=' end,
    case when contains(bare, '/cgi-bin/') then '/cgi-bin/' end,
    case when contains(bare, '/wp-login.') then '/wp-login.' end,
    case when regexp_matches(bare, '/login(?:[^0-9a-z_.%-]|$)') then '/login^' end,
    case when regexp_matches(bare, '/signup(?:[^0-9a-z_.%-]|$)') then '/signup^' end,
    case when regexp_matches(bare, '/cart(?:[^0-9a-z_.%-]|$)') then '/cart^' end,
    case when regexp_matches(bare, '/search[^0-9a-z_.%-].*q=') then '/search^*q=' end,
    case when ends_with(bare, '.exe') then '.exe|' end,
    case when ends_with(bare, '.apk') then '.apk|' end,
    case when ends_with(bare, '.zip') then '.zip|' end,
    case when regexp_matches(bare, '[^0-9a-z_.%-]casino(?:[^0-9a-z_.%-]|$)') then '^casino^' end,
    case when regexp_matches(bare, '[^0-9a-z_.%-]porn(?:[^0-9a-z_.%-]|$)') then '^porn^' end,
    case when regexp_matches(bare, '[^0-9a-z_.%-]xxx(?:[^0-9a-z_.%-]|$)') then '^xxx^' end) as blocked
  from fitting)
select page_id, host, path, best.rule as rule,
       case when best is not null then best.verdict when allowed is not null then 'allow'
            when blocked is not null then 'block' else 'allow' end as verdict,
       case when best is null then coalesce(allowed, blocked) end as pattern
from patterned
"""

# CRC-32 bit by bit. The program over rows and states carries cost, audit and repaired text together: the least of them
# in this order is what the operator keeps.
_WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_REPAIR = f"""
with recursive
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                 coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
drawn as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint) % 20 as d
  from keyed),
damaged as (
  select conv_id, turn, case when d = 4 then 'user' else role end as role,
         case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(case when d = 3 then [1, 2] else [1] end) as copy from drawn where d <> 0)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as i,
                  rtrim(text, {_WHITE}) as bare from damaged),
judged as (
  select *, case when bare = '' then 'blank'
                 when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                 when right(bare, 1) not in ('.', '!', '?') then 'truncated' else 'ok' end as fault,
         left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) as before
  from placed),
steps(state, initial, onto) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
-- no, one or two rows inserted; more only go round
inserts(state, onto, cost, letters, roles) as (values
  (0, 0, 0, '', []::varchar[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (3, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']),
  (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
moves as (
  select conv_id, i, state, onto, 3 * (fault = 'truncated')::int as cost, 'K' as letter, [role || ':' || text] as line
  from judged join steps using (initial) where fault not in ('blank', 'duplicate')
  union all
  select conv_id, i, s.state, s.onto, 3 + 3 * (fault = 'truncated')::int, 'R',
         [case s.initial when 'u' then 'user:' else 'assistant:' end || text]
  from judged join steps s on s.initial <> 's' where fault not in ('blank', 'duplicate')
  union all
  select conv_id, i, s.state, s.state, 4, 'D', [] from judged, (values (0), (1), (2), (3)) s(state)),
paths as (
  select conv_id, 0::bigint as i, n.onto as state, {{'cost': n.cost::bigint, 'audit': n.letters, 'lines': n.roles}} as best
  from (select distinct conv_id from judged) c join inserts n on n.state = 0
  union all
  select p.conv_id, p.i + 1, n.onto, min({{'cost': (p.best.cost + m.cost + n.cost)::bigint,
      'audit': p.best.audit || m.letter || n.letters, 'lines': list_concat(p.best.lines, m.line, n.roles)}})
  from paths p join moves m on m.conv_id is not distinct from p.conv_id and m.i = p.i + 1 and m.state = p.state
  join inserts n on n.state = m.onto
  group by p.conv_id, p.i, n.onto),
ended as (
  select p.conv_id, min(best) as best from paths p
  join (select conv_id, max(i) as i from judged group by conv_id) e on e.conv_id is not distinct from p.conv_id and e.i = p.i
  where state in (0, 3) group by p.conv_id),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.cost, 0) as cost,
       coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted c on c.conv_id is not distinct from o.conv_id
left join ended e on e.conv_id is not distinct from o.conv_id
"""

_PHRASES = f"""
with split as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
worded as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from split),
started as (select lang, w, unnest(range(1, len(w) + 1)) as i from worded),
runs as (select lang, w[i : i + m - 1] as p from started, (values (1), (2), (3), (4)) t(m) where i + m - 1 <= len(w)),
known as (select lang, array_to_string(p, ' ') as phrase, any_value(p) as p, count(*) as f from runs group by 1, 2),
totals as (select lang, count(*) as n from started group by 1),
candidates as (select * from known where len(p) > 1 and f >= 30),
cuts as (
  select c.lang, c.phrase, c.f as a, k, x.f as l, y.f as r, (2000000::hugeint * c.f) // (x.f + y.f) as score
  from (select *, unnest(range(1, len(p))) as k from candidates) c
  join known x on x.lang = c.lang and x.phrase = array_to_string(c.p[1 : k], ' ')
  join known y on y.lang = c.lang and y.phrase = array_to_string(c.p[k + 1 :], ' ')),
scored as (select lang, phrase, a, min({{'score': score, 'k': k, 'l': l, 'r': r}}) as cut from cuts group by all),
inside as (
  select lang, array_to_string(p[i : i + m - 1], ' ') as phrase, max(f) as longer
  from (select *, unnest(range(1, len(p) - m + 2)) as i from candidates, (values (2), (3)) t(m) where m < len(p)) group by 1, 2),
ranked as (
  select s.*, row_number() over (partition by s.lang order by s.cut.score desc, s.a desc, s.phrase) as rank
  from scored s left join inside i on i.lang = s.lang and i.phrase = s.phrase where not coalesce(100 * i.longer >= 80 * s.a, false))
select lang, rank, phrase, a, cut.l as l, cut.r as r, n, cut.score::bigint as score from ranked join totals using (lang) where rank <= 2000
"""

_TEXT_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
# CRC-32 of an ASCII text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({}, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint)"""

_CHAT = """
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256
from turns group by conv_id
"""

_TOKENS = f"""
with documents_in as (select row_number() over () as r, doc_id, {_CRC.format("doc_id::varchar")} % 7 = 2 as held_out,
                             list_append({_TEXT_WORDS.format(_FOLDED)}, chr(10)) as w from documents),
tokens as (select r, held_out, unnest(w) as token from documents_in),
known as (select token, count(*) as c from tokens where not held_out group by token),
model as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from known)
select any_value(d.doc_id) as doc_id, any_value(d.held_out) as held_out, count(*) as n_tokens, count(k.token) as n_known,
       any_value(n) as train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + 1.0 * (v + 1)))), 4) as base_score
from tokens t join documents_in d using (r) left join known k on k.token = t.token, model group by r
"""

# All pairs of different shingle sets, and everything that can be reached over links.
_NEAR = f"""
with recursive
worded as (select doc_id, {_TEXT_WORDS.format(_FOLDED)} as w from documents),
sets as (select doc_id, list_sort(list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')]
           else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end)) as s
         from worded where len(w) > 0),
keyed as (select doc_id, md5(array_to_string(s, chr(10))) as fp, s from sets),
different as (select fp, any_value(s) as s, min(doc_id) as rep, count(*) as n_copies from keyed group by fp),
places as (select fp, len(s) as size, unnest(s) as shingle from different),
linked as (select a.fp as a, b.fp as b from places a join places b on a.shingle = b.shingle and a.fp <> b.fp
           group by a.fp, b.fp, a.size, b.size having 10 * count(*) >= 8 * (a.size + b.size - count(*))),
reached(a, b) as (select fp, fp from different union select r.a, l.b from reached r join linked l on l.a = r.b),
classes as (select r.a as fp, min(d.rep) as class_id from reached r join different d on d.fp = r.b group by r.a),
links as (select a as fp, count(*) as n_links from linked group by a)
select w.doc_id, coalesce(c.class_id, w.doc_id) as class_id, coalesce(l.n_links, 0) as n_links, coalesce(d.n_copies, 1) as n_copies
from documents w left join keyed k on k.doc_id = w.doc_id left join different d on d.fp = k.fp
left join classes c on c.fp = k.fp left join links l on l.fp = k.fp
"""

SQL = {"chat_digests": _CHAT, "token_scores": _TOKENS, "op10_near": _NEAR, "op11_urls": _URLS, "op12_phrases": _PHRASES, "op13_repair": _REPAIR}
