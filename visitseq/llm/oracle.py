"""DuckDB SQL for the queries that SQL can express."""

from visitseq.llm import licences

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE = {}

ORACLE["op4_decontaminate"] = f"""
with docs as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
items as (select item_id, {_WORDS} as w from benchmark),
sized as (select item_id, w, least(10, len(w)) as l from items where len(w) > 0),
item_windows as (
  select distinct item_id, l, array_to_string(w[i:i + l - 1], ' ') as k
  from (select item_id, w, l, unnest(range(1, len(w) - l + 2)) as i from sized)),
doc_windows as (
  select r, l, i, array_to_string(w[i:i + l - 1], ' ') as k
  from (select r, w, l, unnest(range(1, len(w) - l + 2)) as i
        from docs, (select distinct l from item_windows) where len(w) >= l)),
hits as (select r, d.l, i, item_id from doc_windows d join item_windows using (l, k)),
marked as (select r, count(distinct p) as n from
           (select r, unnest(range(i, i + l)) as p from hits) group by r),
listed as (select r, count(distinct item_id) as n,
                  string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
           from hits group by r)
select doc_id, len(w) as n_words, coalesce(m.n, 0) as n_hit, coalesce(i.n, 0) as n_items,
       sha256(coalesce(i.ids, '')) as items_sha256, coalesce(m.n, 0) > 0 as contaminated
from docs left join marked m using (r) left join listed i using (r)
"""

_ESCAPE = r"regexp_replace({}, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))', '\1\\\2\3', 'g')"

ORACLE["op2_chat"] = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text))
         as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text)
                       filter (role = 'assistant'), '')) as loss_sha256,
       (3 + sum(length({_ESCAPE.format('text')}) + case role when 'user' then 15
                when 'assistant' then 4 else 17 + length({_ESCAPE.format('role')}) end))::bigint
         as formatted_chars
from turns group by conv_id
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical(source: str, key: str) -> str:
    """(key, line number, canonical line) of the rows of a table with a text."""
    cases = " ".join(f"when {_text(a)} then {_text(b)}" for a, b in licences.SPELLINGS.items())
    return f"""
      select {key}, n, array_to_string(list_transform(string_split(line, ' '),
               lambda w: case w {cases} else w end), ' ') as line
      from (select {key}, n, trim(regexp_replace(line, '{licences.NOT_WORD}', ' ', 'g')) as line
            from (select {key}, unnest(lines) as line, unnest(range(len(lines))) as n
                  from (select {key}, string_split(lower(replace(coalesce(text, ''), '©', ' (c) ')),
                                                   chr(10)) as lines from {source})))
      where line <> '' and not regexp_matches(line, '{licences.COPYRIGHT}')"""


_KNOWN = ", ".join(f"({i}, {_text(name)}, {_text(text)})"
                   for i, (name, text) in enumerate(licences.known_texts()))

ORACLE["op7_licences"] = f"""
with docs as (select row_number() over () as r, doc_id, text from documents),
lines as ({_canonical('docs', 'r')}),
texts as (select r, string_agg(line, ' ' order by n) as line from lines group by r),
known_rows(k, licence, text) as (values {_KNOWN}),
known_lines as ({_canonical('known_rows', 'k')}),
known as (select distinct licence, line from known_rows join
          (select k, string_agg(line, ' ' order by n) as line from known_lines group by k) using (k)),
of_text as (select r, string_agg(distinct licence, ',' order by licence) as ids
            from texts join known using (line) group by r),
of_lines as (select r, string_agg(distinct licence, ',' order by licence) as ids,
                    count(distinct licence) as n from lines join known using (line) group by r)
select doc_id, coalesce(t.ids, '') as whole, coalesce(l.ids, '') as licences,
       coalesce(l.n, 0) as n_licences
from docs left join of_text t using (r) left join of_lines l using (r)
"""

ORACLE["op12_spelling"] = r"""
with recursive tab as (
  select list_transform(range(256), lambda x: list_reduce(
    list_concat([x], range(8)),
    lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
runs as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run
  from documents),
counted as (select doc_id, run, count(*) as c from runs where length(run) >= 5 group by all),
coded as (select run, c, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as code
          from counted),
summed as (
  select run, c, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(1, len(code), 2),
                                             lambda i: ('0x' || substr(code, i, 2))::bigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) as h
  from coded, tab),
changed as (
  select c, case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint)
                 || substr(run, (h % length(run))::bigint + 2) else run end as word from summed),
words as (select word, sum(c)::bigint as n from changed where length(word) >= 5
          group by word having sum(c) >= 3),
gaps as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
         from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (
  select distinct a.word, b.word as near, b.n from gaps a join gaps b using (i, rest)
  where a.word != b.word
  union select distinct g.word, w.word, w.n from gaps g join words w on g.rest = w.word
  union select distinct w.word, g.word, g.n from gaps g join words w on g.rest = w.word),
ranked as (select *, row_number() over (partition by word order by n desc, near) as r,
                  count(*) over (partition by word) as n_near from pairs),
forms as (select w.word, w.n, coalesce(r.n_near, 0) as n_near,
                 case when r.n >= 2 * w.n then r.near end as form,
                 case when r.n >= 2 * w.n then r.n end as form_n
          from words w left join ranked r on r.word = w.word and r.r = 1),
chains as (select word, word as root, form as next from forms
           union all select c.word, f.word, f.form from chains c join forms f on f.word = c.next)
select f.word, f.n, f.n_near, f.form, f.form_n, c.root
from forms f join chains c using (word) where c.next is null
"""
