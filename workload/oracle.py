"""The registered queries in DuckDB SQL, put together from common table expressions."""

from workload.tables import GAPPED_SPECIALS

SHORT, MLM, PREDICTION = 16, 64, 100
MIN_COUNT = 30
BATCH, BATCH_SIZE = 64, 256
SEED = 7

_EVENTS = """raw as (select o_custkey patid, cast(o_orderdate as date) eventdate, p_brand code
  from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey),
ev as (select distinct * from raw)"""

_PART_EVENTS = """raw as (select o_custkey patid, cast(o_orderdate as date) eventdate,
  cast(l_partkey as varchar) code from orders join lineitem on l_orderkey = o_orderkey),
ev as (select distinct * from raw)"""

_PEOPLE = "people as (select c_custkey patid, 1930 + c_custkey % 60 yob from customer)"

_AGED = """aged as (select patid, eventdate, code,
  (year(eventdate) - yob) * 12 + month(eventdate) - 1 age from ev join people using (patid))"""

# One row per token; s orders the separator behind the codes of its visit.
_TOKENS = """tok0 as (select patid, eventdate, 0 s, code token, age from aged
  union all select distinct patid, eventdate, 1, 'SEP', age from aged),
tok as (select *, row_number() over (partition by patid order by eventdate, s, token) - 1 pos
  from tok0),
days as (select patid, eventdate, row_number() over (partition by patid order by eventdate) visit_no,
  count(*) over (partition by patid) n_visits, max(eventdate) over (partition by patid) last_date
  from (select distinct patid, eventdate from ev))"""

_BASE = ",\n".join([_EVENTS, _PEOPLE, _AGED, _TOKENS])


def _cut(source: str, max_len: int) -> str:
    """seq: the last max_len - 1 tokens of a person in a table (patid, pos, token, age, n)."""
    return f"seq as (select patid, pos, token, age from {source} where pos >= n - {max_len - 1})"


def _tails(max_len: int) -> str:
    """seq for the persons with five visits."""
    return f"""long_tok as (select tok.*, count(*) over (partition by tok.patid) n from tok
  where patid in (select patid from days where n_visits >= 5)),
{_cut("long_tok", max_len)}"""


# Start token, from a table seq(patid, pos, token, age) that is cut already.
_STARTED = """cut as (select patid, row_number() over (partition by patid order by pos) - 1 i,
  token, age from seq),
head as (select patid, token = 'SEP' on_sep, age from cut where i = 0),
started as (select cut.patid, i + (case when on_sep then 0 else 1 end) i,
    case when on_sep and i = 0 then 'CLS' else token end token, cut.age
  from cut join head using (patid)
  union all select patid, 0, 'CLS', age from head where not on_sep)"""


def _padded(max_len: int) -> str:
    return f"""grid as (select patid, range pos from (select distinct patid from started),
  range({max_len})),
pads as (select grid.patid, grid.pos, coalesce(token, 'PAD') token, age,
    cast(token is not null as bigint) mask,
    cast(coalesce(sum(case when token = 'SEP' then 1 else 0 end) over (
      partition by grid.patid order by grid.pos
      rows between unbounded preceding and 1 preceding), 0) as bigint) as position
  from grid left join started on started.patid = grid.patid and started.i = grid.pos)"""


_GAPPED = " ".join(f"when '{t}' then {i}" for t, i in GAPPED_SPECIALS.items())


def _vocab(source: str, min_count: int = 1, gapped: bool = False) -> str:
    """vocab(token, token_id) and names(token, label_id)."""
    own = f"case token {_GAPPED} else id * 10 + 3 end" if gapped else "id"
    return f"""ranked as (select code token, row_number() over (order by count(*) desc, code) + 4 id
  from {source} group by code having count(*) >= {min_count}),
vocab as (select token, cast({own} as int) token_id from (select * from ranked union all
  select * from (values ('PAD', 0), ('UNK', 1), ('SEP', 2), ('CLS', 3), ('MASK', 4)) x(token, id))),
names as (select token, cast(row_number() over (order by token_id) - 1 as int) label_id
  from vocab where token not in ('PAD', 'SEP', 'CLS', 'MASK'))"""


def _special(token: str) -> str:
    return f"(select token_id from vocab where token = '{token}')"


def _draw(key: str, number: int = 0) -> str:
    return f"('0x' || substr(md5({key}), {1 + 8 * number}, 8))::bigint / 4294967296.0"


_CUTS = f"""cuts as (select *,
  4 + cast(floor({_draw(f"patid || '|cut|{SEED}'")} * (n_visits - 4)) as bigint) cut_no
  from days where n_visits > 4),
cut_days as (select patid, eventdate cut_date, last_date, cut_no from cuts
  where visit_no = cut_no)"""


def _labelled(months: int | None) -> str:
    """hist: the whole history of the persons with a cut; lab: their label codes."""
    end = f"cut_date + interval {months} month"
    people = f"last_date >= {end}" if months else "true"
    rule = f"eventdate > cut_date and eventdate <= {end}" if months else "visit_no = cut_no + 1"
    return f"""{_CUTS},
held as (select * from cut_days where {people}),
hist as (select tok.patid, eventdate, pos, token, age, count(*) over (partition by patid) n
  from tok join held using (patid) where eventdate <= cut_date),
lab as (select distinct patid, code from ev join held using (patid)
  join cuts using (patid, eventdate, cut_no) where {rule})"""


# A row takes the visits of the months that start in the same hundred thousand tokens.
def _parts(source: str) -> str:
    return f"""parted as (select *, min(pos) over (
  partition by patid, date_trunc('month', eventdate)) // 100000 part from {source}),
texts as (select patid, part, string_agg(token, ' ' order by pos) code,
  string_agg(cast(age as varchar), ' ' order by pos) age from parted group by patid, part)"""


def _label_text(months: int | None) -> str:
    return f"""with {_BASE}, {_labelled(months)}, {_parts('hist')}
select patid, cast(cut_date as varchar) cut_date, part, code, age, coalesce(label, '') as label
from held join texts using (patid)
  left join (select patid, string_agg(code, ' ' order by code) as label from lab group by 1)
    using (patid)"""


def _tail_label_text(months: int) -> str:
    return f"""with {_BASE}, {_labelled(months)},
ends as (select patid, string_agg(token, ' ' order by pos) code,
  string_agg(cast(age as varchar), ' ' order by pos) age
  from hist where pos >= n - {PREDICTION - 1} group by 1)
select patid, cast(cut_date as varchar) cut_date, cast({months} as bigint) as months, code, age,
  coalesce(label, '') as label
from held join ends using (patid)
  left join (select patid, string_agg(code, ' ' order by code) as label from lab group by 1)
    using (patid)"""


# Label ids in order.
_LABEL_IDS = """lab_ids as (select patid, coalesce(label_id, 0) label_id, row_number() over (
  partition by patid order by label_id) - 1 pos
  from lab join names on names.token = lab.code)"""


def _encoded(months: int | None = None, gapped: bool = False) -> str:
    return f"""{_BASE}, {_labelled(months)}, {_cut('hist', PREDICTION)}, {_STARTED},
{_padded(PREDICTION)}, {_vocab('ev', gapped=gapped)}, {_LABEL_IDS}"""


def _encode(months: int | None = None) -> str:
    return f"""with {_encoded(months)}
select pads.patid, pads.pos,
  cast(case when mask = 0 then 0 else least(age, 99999) + 2 end as bigint) age,
  cast(coalesce(token_id, 1) as bigint) code, position, position % 2 segment, mask,
  cast(coalesce(label_id, -1) as bigint) as label
from pads left join vocab using (token) left join lab_ids using (patid, pos)"""


def _hot(gapped: bool = False) -> str:
    return f"""with {_encoded(gapped=gapped)}
select held.patid, cast(names.label_id as bigint) label_id,
  cast(lab_ids.patid is not null as bigint) target
from held cross join names left join lab_ids
  on lab_ids.patid = held.patid and lab_ids.label_id = names.label_id"""


def _mask_draws(drop_kept: bool = False) -> str:
    kept = "null" if drop_kept else "token_id"
    return f"""drawn as (select patid, i pos, cast(coalesce(token_id, {_special('UNK')}) as bigint) token_id,
    {_draw(f"patid || '|' || i || '|1|{SEED}'")} u,
    {_draw(f"patid || '|' || i || '|1|{SEED}'", 1)} u2
  from started left join vocab using (token)),
sizes as (select list(token_id order by token_id) ids, count(*) n from vocab),
masked as (select patid, pos, token_id,
  cast(case when u < 0.12 then {_special('MASK')}
    when u < 0.135 then ids[cast(floor(u2 * n) as int) + 1]
    when u < 0.15 then {kept} else token_id end as bigint) output_id,
  cast(case when u < 0.15 then token_id else -1 end as bigint) as label from drawn, sizes)"""


def _random_mask(gapped: bool = False, drop_kept: bool = False) -> str:
    return f"""with {_BASE}, {_tails(MLM)}, {_STARTED}, {_vocab('ev', gapped=gapped)},
{_mask_draws(drop_kept)} select * from masked"""


def _mlm(gapped: bool = False, more: str = "", columns: str = "", joins: str = "") -> str:
    return f"""with {_BASE}, {_tails(MLM)}, {_STARTED}, {_padded(MLM)}, {_vocab('ev', gapped=gapped)},
{_mask_draws()}{more}
select pads.patid, {columns} pads.pos, cast(case when mask = 0 then 0 else age + 2 end as bigint) age,
  coalesce(output_id, {_special('PAD')}) code, position, position % 2 segment, mask,
  coalesce(masked.label, -1) as label
from pads left join masked using (patid, pos) {joins}"""


_SCORED = """scored as (select vec_id sample_id, k label_id,
  round(cast(embedding[k + 1] as double), 1) + 0.0 logit,
  case when k = label or (vec_id * 7 + k * 13) % 5 = 0 then 1 else 0 end target
  from embeddings, range(64) t(k))"""

_LOSS = "greatest(logit, 0.0) - logit * target + ln(1 + exp(-abs(logit)))"

_SAMPLES = f"""groups as (select sample_id, logit, cast(sum(target) as double) tp,
  cast(count(*) as double) n from scored group by 1, 2),
running as (select sample_id, tp, n,
  sum(tp) over (partition by sample_id order by logit desc rows unbounded preceding) ctp,
  sum(n) over (partition by sample_id order by logit desc rows unbounded preceding) cn,
  sum(tp) over (partition by sample_id) p, sum(n) over (partition by sample_id) t from groups),
samples as (select sample_id,
  case when max(p) = 0 then 0.0 else sum(tp / nullif(p, 0) * ctp / cn) end ap,
  sum(tp * ((t - p) - (cn - ctp) + 0.5 * (n - tp))) / nullif(max(p * (t - p)), 0) auc
  from running group by 1),
losses as (select sample_id, sum({_LOSS}) loss, count(*) n from scored group by 1)"""

_MASKED = """masked as (select vec_id, k, label, round(cast(embedding[k + 1] as double), 2) + 0.0 x
  from embeddings, range(64) t(k) where vec_id % 7 <> 0)"""

_BATCH_LOSSES = """steps as (select cast(l_linenumber as bigint) epoch, row_number() over (
    partition by l_linenumber order by l_orderkey, l_partkey, l_suppkey) - 1 step,
  l_discount loss, l_quantity examples from lineitem)"""

_EPOCH_LOSSES = """sums as (select epoch, sum(loss) loss, sum(examples) examples,
  count(*) steps from steps group by 1)"""

# Scores by counting: distinct history labels and next labels of each person.
_SCORES = f"""split as (select patid, {_draw(f"patid || '|split|{SEED}'")} < 0.2 test from held),
history as (select distinct patid, label_id code from started join names using (token)),
after as (select patid, label_id from lab_ids),
train as (select patid from split where not test),
n_label as (select label_id, count(*) n from after join train using (patid) group by 1),
n_code as (select code, count(*) n from history join train using (patid) group by 1),
joint as (select code, label_id, count(*) n from history join after using (patid)
  join train using (patid) group by 1, 2 having count(*) >= {{support}}),
kept as (select * from joint qualify row_number() over (
  partition by code order by n desc, label_id) <= {{most}}),
weights as (select names.label_id, cast(round(1e6 * ln((coalesce(n, 0) + 0.5)
    / ((select count(*) from train) - coalesce(n, 0) + 0.5))) as bigint) w_out
  from names left join n_label using (label_id)),
pairs as (select code, label_id, cast(round(1e6 * (
    ln((k.n + 0.5) / (c.n - k.n + 0.5)) - ln((l.n - k.n + 0.5)
      / ((select count(*) from train) - c.n - l.n + k.n + 0.5)))) as bigint) w
  from kept k join n_code c using (code) join n_label l using (label_id)),
spoken as (select patid, label_id, sum(w) w from history join pairs using (code) group by 1, 2),
scored as (select split.patid sample_id, cast(o.label_id as bigint) label_id,
  cast(o.w_out + coalesce(w, 0) as double) / 1e6 logit, o.w_out / 1e6 w_out,
  w is not null or a.patid is not null own, cast(a.patid is not null as bigint) target
  from split cross join weights o
  left join spoken s on s.patid = split.patid and s.label_id = o.label_id
  left join after a on a.patid = split.patid and a.label_id = o.label_id where test)"""


def _scores(support: int = 3, most: int = 200) -> str:
    return _SCORES.format(support=support, most=most)


def _next_code_scores(*limits: int) -> str:
    return f"""with {_encoded()}, {_scores(*limits)}
select s.sample_id patid, s.label_id, round(logit, 9) logit, target, round(s.w_out, 9) if_new,
  (select cast(count(*) as bigint) from weights o where o.w_out / 1e6 >= logit) as least,
  (select cast(count(*) as bigint) from weights o where o.w_out / 1e6 > logit) as above
from scored s where own"""


def _report(months: int | None = None, gapped: bool = False) -> str:
    return f"""with {_encoded(months, gapped)}, {_scores()}, {_SAMPLES}
select round(avg(ap), 9) ap, round(avg(auc), 9) auc, count(auc) rated, count(*) samples
from samples"""


def _part_ids(min_count: int = 1, unknown: str = "1") -> str:
    return f"""with {_PART_EVENTS}, {_vocab('ev', min_count)}
select patid, cast(eventdate as varchar) eventdate, code token,
  cast(coalesce(token_id, {unknown}) as bigint) token_id from ev left join vocab on token = code"""


_YEARS = f"""with {_EVENTS}, {_PEOPLE}, years as (select patid, eventdate, code,
  cast(year(eventdate) - yob as bigint) age from ev join people using (patid))"""

ORACLE = {
    "clean_events": f"""with {_EVENTS}
select patid, cast(eventdate as varchar) eventdate, code from ev""",

    "events_with_age": f"""with {_EVENTS}, {_PEOPLE}, {_AGED}
select patid, cast(eventdate as varchar) eventdate, cast(age as varchar) age, code from aged""",

    "events_with_age_years": f"""{_YEARS}
select patid, cast(eventdate as varchar) eventdate, code, age from years""",

    "demographic_conflicts": """select count(*) persons, count(*) filter (lo < hi) conflicting
from (select o_custkey, min(year(o_orderdate)) lo, max(year(o_orderdate)) hi
  from orders group by 1)""",

    "visits": f"""with {_BASE}
select patid, cast(eventdate as varchar) eventdate, string_agg(token, ' ' order by pos) code,
  string_agg(cast(age as varchar), ' ' order by pos) age from tok group by patid, eventdate""",

    "sequences": f"with {_BASE}, {_parts('tok')} select patid, part, code, age from texts",

    "part_sequences": f"""with {_PART_EVENTS}, {_PEOPLE}, {_AGED}, {_TOKENS}, {_parts('tok')}
select patid, part, code, age from texts""",

    "running_history": f"""with {_BASE},
ends as (select patid, eventdate, visit_no, (select count(*) from tok t
  where t.patid = days.patid and t.eventdate <= days.eventdate) n from days)
select ends.patid, cast(ends.eventdate as varchar) eventdate, visit_no n_visits, n n_tokens,
  string_agg(token, ' ' order by pos) code, string_agg(cast(age as varchar), ' ' order by pos) age
from ends join tok on tok.patid = ends.patid and pos < n and pos >= n - {MLM - 1}
group by 1, 2, 3, 4""",

    "history_prefixes": f"""with {_BASE},
ends as (select patid, eventdate, visit_no, (select count(*) from tok t
  where t.patid = days.patid and t.eventdate <= days.eventdate) n from days)
select ends.patid, cast(ends.eventdate as varchar) eventdate, cast(0 as bigint) part,
  visit_no n_visits, n n_tokens, md5(string_agg(token, ' ' order by pos) || '|' ||
    string_agg(cast(age as varchar), ' ' order by pos)) digest
from ends join tok on tok.patid = ends.patid and pos < n group by 1, 2, 3, 4, 5""",

    "min_visits": f"""with {_EVENTS}
select patid, cast(eventdate as varchar) eventdate, string_agg(code, ' ' order by code) code
from ev where patid in (select patid from ev group by 1 having count(distinct eventdate) >= 10)
group by patid, eventdate""",

    "sequence_tails": f"""with {_BASE}, {_tails(MLM)}
select patid, string_agg(token, ' ' order by pos) code,
  string_agg(cast(age as varchar), ' ' order by pos) age from seq group by patid""",

    "row_index": f"""with {_EVENTS}
select patid, row_number() over (order by patid) - 1 row_index
from ev group by patid having count(distinct eventdate) >= 5""",

    "code_vocab": f"with {_EVENTS}, {_vocab('ev')} select token, token_id from vocab",

    "part_vocab": f"with {_PART_EVENTS}, {_vocab('ev')} select token, token_id from vocab",

    "age_vocab": f"""with {_EVENTS}, {_PEOPLE}, {_AGED}
select cast(age as varchar) age, count(*) n, cast(age + 2 as bigint) age_id,
  cast(age + 2 as bigint) computed_id,
  cast(case when age < 720 then age + 2 else 1 end as bigint) capped_id
from (select distinct patid, eventdate, age from aged) group by age""",

    "age_vocab_years": f"""{_YEARS}
select cast(age as varchar) age, count(*) n, age + 2 age_id, age + 2 computed_id,
  case when age < 60 then age + 2 else 1 end capped_id from years group by age""",

    "label_vocab": f"with {_EVENTS}, {_vocab('ev')} select token, label_id from names",

    "label_vocab_gapped": f"""with {_EVENTS}, {_vocab('ev', gapped=True)}
select token, label_id from names""",

    "encode_tokens": _part_ids(),

    "encode_tokens_unknown": _part_ids(MIN_COUNT),

    "encode_tokens_null": _part_ids(MIN_COUNT, "null"),

    "encode_tokens_masked": f"""with {_EVENTS}, {_vocab('ev')}
select patid, cast(eventdate as varchar) eventdate, code token,
  cast(case when code = 'Brand#11' then 1 else token_id end as bigint) token_id
from ev join vocab on token = code""",

    "encode_tokens_shuffled": _part_ids(),

    "encode_labels": f"""with {_PART_EVENTS}, {_vocab('ev')}
select patid, cast(eventdate as varchar) eventdate, code token,
  cast(coalesce(label_id, 0) as bigint) label_id from ev left join names on token = code""",

    "decode_tokens": f"""with {_PART_EVENTS}, {_vocab('ev')}
select patid, cast(eventdate as varchar) eventdate, cast(token_id as bigint) token_id, token
from ev join vocab on token = code""",

    "tail_cls": f"""with {_BASE}, {_tails(SHORT)}, {_STARTED}
select patid, string_agg(token, ' ' order by i) code,
  string_agg(cast(age as varchar), ' ' order by i) age from started group by patid""",

    "position_segment": f"""with {_BASE}, {_tails(SHORT)}, {_STARTED}, {_padded(SHORT)}
select patid, pos, position, position % 2 segment from pads""",

    "attention_mask": f"""with {_BASE}, {_tails(MLM)}, {_STARTED}, {_padded(MLM)}
select patid, pos, mask from pads""",

    "padded": f"""with {_BASE}, {_tails(MLM)}, {_STARTED}, {_padded(MLM)}
select patid, pos, token from pads""",

    "random_mask": _random_mask(),

    "random_mask_gapped": _random_mask(gapped=True),

    "random_mask_dropped": _random_mask(drop_kept=True),

    "encode_mlm": _mlm(),

    "encode_mlm_gapped": _mlm(gapped=True),

    "format_then_encode": _mlm(),

    "encode_next_visit": _encode(),

    "encode_6m": _encode(6),

    "encode_12m": _encode(12),

    "split_patients": f"""select c_custkey patid,
  case when {_draw(f"c_custkey || '|split|{SEED}'")} < 0.2 then 'test' else 'train' end split
from customer""",

    "label_next_visit": _label_text(None),

    "label_6m": _label_text(6),

    "label_12m": _label_text(12),

    "tails_horizons": " union all ".join(f"select * from ({_tail_label_text(m)})" for m in (6, 12)),

    "distinct_labels": f"""with {_EVENTS}
select patid, string_agg(distinct code, ' ' order by code) as label from ev group by patid""",

    "positive_labels": f"""with {_encoded(12)}
select patid, cast(label_id as bigint) label_id from lab_ids""",

    "multi_hot": _hot(),

    "multi_hot_gapped": _hot(gapped=True),

    "packed_labels": f"""with {_encoded(12)}
select patid, cast(label_id // 64 as bigint) word,
  bit_or(cast(1 as bigint) << cast(label_id % 64 as int)) bits from lab_ids group by 1, 2""",

    "epoch_order": f"""select c_custkey patid, row_number() over (
  order by {_draw(f"c_custkey || '|3|{SEED}'")}, c_custkey) - 1 row_index from customer""",

    "batches": f"""select c_custkey patid, (row_number() over (
    order by {_draw(f"c_custkey || '|2|{SEED}'")}, c_custkey) - 1) // {BATCH_SIZE} train_batch,
  (row_number() over (order by c_custkey) - 1) // {BATCH_SIZE} test_batch from customer""",

    "average_precision": f"""with {_SCORED}, {_SAMPLES}
select sample_id, round(ap, 9) ap from samples""",

    "roc_auc": f"""with {_SCORED}, {_SAMPLES}
select sample_id, round(auc, 9) auc from samples""",

    "mean_metrics": f"""with {_SCORED}, {_SAMPLES}
select round(avg(ap), 9) ap, round(avg(auc), 9) auc, count(auc) rated, count(*) samples
from samples""",

    "evaluate": f"""with {_SCORED}, {_SAMPLES},
numbered as (select *, (row_number() over (order by sample_id) - 1) // {BATCH} batch_id
  from samples join losses using (sample_id)),
per_batch as (select batch_id, sum(loss) / sum(n) loss from numbered group by 1)
select round(avg(ap), 9) ap, round(avg(auc), 9) auc,
  (select round(sum(loss), 9) from per_batch) loss, count(*) samples, count(auc) rated,
  count(distinct batch_id) batches from numbered""",

    "step_precision": f"""with {_SCORED}, {_SAMPLES},
numbered as (select *, (row_number() over (
  order by {_draw(f"sample_id || '|1|{SEED}'")}, sample_id) - 1) // {BATCH} batch_id from samples)
select batch_id, round(avg(ap), 9) ap, count(*) samples from numbered group by 1""",

    "masked_precision": f"""with {_MASKED},
tops as (select vec_id, label, first(k order by x desc, k) top from masked group by 1, 2)
select round(avg(case when top = label then 1.0 else 0.0 end), 9) as precision,
  count(*) positions from tops""",

    "masked_cross_entropy": f"""with {_MASKED},
tops as (select vec_id, max(x) m, max(x) filter (k = label) own from masked group by 1),
sums as (select vec_id, sum(exp(x - m)) s from masked join tops using (vec_id) group by 1)
select round(avg(m + ln(s) - own), 9) loss from tops join sums using (vec_id)""",

    "multilabel_soft_margin": f"with {_SCORED} select round(avg({_LOSS}), 9) loss from scored",

    "loss_progress": f"""with {_BATCH_LOSSES}
select epoch, cast(ceil(step / 200) as bigint) * 200 report_step, round(avg(loss), 9) mean_loss,
  count(*) steps from (select *, max(step) over (partition by epoch) reached from steps)
group by epoch, 2, reached having report_step <= reached""",

    "epoch_losses": f"""with {_BATCH_LOSSES}, {_EPOCH_LOSSES}
select epoch, round(loss, 6) loss, examples, steps, round(loss / examples, 9) loss_per_example
from sums""",

    "best_epochs": """with runs as (select l_suppkey run_id, cast(l_linenumber as bigint) epoch,
  round(avg(l_discount), 6) ap, round(avg(l_tax), 6) auc from lineitem group by 1, 2)
select * from runs qualify ap > greatest(0.045, coalesce(max(ap) over (partition by run_id
  order by epoch rows between unbounded preceding and 1 preceding), 0.045))""",

    "next_code_scores": _next_code_scores(),

    "next_code_scores_bounded": _next_code_scores(20, 5),

    "prediction_report": _report(),

    "report_6m": _report(6),

    "report_12m": _report(12),

    "report_gapped": _report(6, gapped=True),

    "score_batches": f"""with {_encoded()},
found as (select patid, token, count(*) n from started group by 1, 2)
select held.patid, case when {_draw(f"held.patid || '|split|{SEED}'")} < 0.2 then 'test'
    else 'train' end split,
  cast(token_id as bigint) label_id, cast(coalesce(n, 0) as double) logit
from held cross join vocab left join found using (patid, token)""",

    "pretraining_table": _mlm(more=f""",
numbered as (select patid, (row_number() over (
    order by {_draw(f"patid || '|1|{SEED}'")}, patid) - 1) // {BATCH_SIZE} batch_id
  from (select distinct patid from seq))""", columns="batch_id,", joins="join numbered using (patid)"),

    "read_tsv": """select cast(o_orderkey as varchar) o_orderkey, cast(o_custkey as varchar) o_custkey,
  o_orderpriority from orders""",

    "read_csv": """select cast(o_orderkey as varchar) o_orderkey, cast(o_custkey as varchar) o_custkey,
  o_orderpriority from orders""",

    "write_parquet": f"""with {_EVENTS}
select patid, cast(eventdate as varchar) eventdate, code from ev""",

    "binary_as_string": "select event_id, event_type code from events",

    "vocab_store": f"with {_PART_EVENTS}, {_vocab('ev')} select token, token_id from vocab",

    "write_tsv": f"""with {_BATCH_LOSSES}, {_EPOCH_LOSSES}
select epoch, round(loss / examples, 6) loss, steps from sums""",

    "append_log": """select l_suppkey run_id, cast(l_linenumber as bigint) epoch,
  round(avg(l_discount), 6) ap, round(avg(l_tax), 6) auc from lineitem group by 1, 2""",

    "epoch_store": f"""select *, row_index // {BATCH} batch_id from (
  select o_orderkey, o_custkey, row_number() over (
    order by {_draw(f"o_orderkey || '|2|{SEED}'")}, o_orderkey) - 1 row_index from orders)
where row_index >= {2 * BATCH}""",

    "extend_vocab": f"""with {_PART_EVENTS}, early as (select * from ev where eventdate < '1996-01-01'),
{_vocab('early', 2)},
more as (select code token, row_number() over (order by count(*) desc, code) - 1 place from ev
  where code not in (select token from vocab) group by code)
select token, token_id, cast(0 as int) version from vocab union all
select token, cast(place + 1 + (select max(token_id) from vocab) as int), cast(1 as int) from more""",

    "keyed_uniform": f"""select o_orderkey, {_draw(f"o_orderkey || '|1|{SEED}'")} u0,
  {_draw(f"o_orderkey || '|1|{SEED}'", 1)} u1 from orders""",
}
