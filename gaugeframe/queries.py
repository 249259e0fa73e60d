"""Registered queries on the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import functions as F

from .functions import parsers, text
from .operators import artifacts, cost, judge, metrics, perf, rank, scoring, stats
from .plans import matrix, provider, sampling, tasks
from .sources import artifacts as artifact_source
from .sources import config

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


ROOT = str(Path(__file__).resolve().parents[1])


def read(spark, sf_dir, table):
    # Python workers that see this folder find the package, whatever folder the driver was started in
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- calls derived from events -------------------------------------------------------------------------------

CARD = {
    "usd_per_dbu": 0.07,
    "models": {
        "ep0": {"dbu_in": 20.0, "dbu_out": 62.857},
        "ep1": {"context_threshold_tokens": 200000, "short": {"dbu_in": 50.0, "dbu_out": 300.0, "dbu_cache_write": 60.0, "dbu_cache_read": 5.0}, "long": {"dbu_in": 100.0, "dbu_out": 450.0, "dbu_cache_write": 120.0, "dbu_cache_read": 10.0}},
        "ep2": {"context_threshold_tokens": 200000, "promo_multiplier": 0.8, "short": {"dbu_in": 35.0, "dbu_out": 214.0, "dbu_cache_read": 3.5}, "long": {"dbu_in": 71.0, "dbu_out": 321.0, "dbu_cache_read": 7.0}},
    },
}


def calls(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    prompt = k * 1000 * (1 + F.col("event_id") % 5)
    usage = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 2 == 0, prompt).alias("prompt_tokens"),
            F.when(F.col("event_id") % 2 == 1, prompt).alias("input_tokens"),
            (k * 7).alias("completion_tokens"),
            F.when(F.col("event_id") % 3 == 0, F.struct((k * 2).alias("reasoning_tokens"))).alias("completion_tokens_details"),
            F.when(F.col("event_id") % 4 == 0, F.struct((k * 100).alias("cached_tokens"))).alias("prompt_tokens_details"),
            F.when(F.col("event_id") % 5 == 0, k).alias("cache_creation_input_tokens"),
        )
    )
    return e.select(
        "event_id",
        "user_id",
        "ts",
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"),
        F.concat(F.lit("ep"), (F.col("user_id") % 4).cast("string")).alias("endpoint"),
        (F.col("event_type") == "error").alias("is_error"),
        F.col("value").alias("latency_ms"),
        k.alias("in_tokens"),
        (k * 7).alias("out_tokens"),
        usage.alias("usage"),
    )


CALLS = """with calls as (select event_id, user_id, ts, 'm' || (user_id % 3) as model_id, 'ep' || (user_id % 4) as endpoint, event_type = 'error' as is_error, value as latency_ms,
  (props->>'k')::bigint as k from events),
tok as (select *, k * 1000 * (1 + event_id % 5) as prompt, case when event_id % 4 = 0 then k * 100 else 0 end as cached, case when event_id % 5 = 0 then k else 0 end as cache_write,
  k * 7 + case when event_id % 3 = 0 then k * 2 else 0 end as billable_out from calls),
rates(endpoint, lo, hi, tier, dbu_in, dbu_out, dbu_cr, dbu_cw, promo) as (values
  ('ep0', null, null, 'flat', 20.0::double, 62.857::double, 0::double, 0::double, 1::double), ('ep1', null, 200000, 'short', 50, 300, 5, 60, 1), ('ep1', 200000, null, 'long', 100, 450, 10, 120, 1),
  ('ep2', null, 200000, 'short', 35, 214, 3.5, 0, 0.8), ('ep2', 200000, null, 'long', 71, 321, 7, 0, 0.8)),
priced as (select t.*, greatest(0, prompt - cached) as billable_in, tier, dbu_in, dbu_out, dbu_cr, dbu_cw, promo from tok t left join rates r on r.endpoint = t.endpoint and prompt >= coalesce(lo, -1) and prompt < coalesce(hi, 1000000000000))
"""


def perf_input(spark, sf_dir):
    """Calls with what each cost; an endpoint without rates costs nothing."""
    return cost.with_usd(calls(spark, sf_dir), cost.rate_table(spark, CARD), CARD["usd_per_dbu"])


USD = "0.07::double * (billable_in * dbu_in + billable_out * dbu_out + cached * dbu_cr + cache_write * dbu_cw) / 1000000::double * promo"


@query(
    CALLS
    + f""", spent as (select model_id, sum({USD}) as usd from priced where not is_error group by model_id)"""
    + """, ok as (select model_id, latency_ms, row_number() over (partition by model_id order by latency_ms) - 1 as r, count(*) over (partition by model_id) as n from calls where not is_error)
select c.model_id, count(*)::bigint as n_calls, count(*) filter (is_error)::bigint as errors,
  (select (min(latency_ms) filter (r = (n - 1) // 2) + min(latency_ms) filter (r = n // 2)) / 2.0::double from ok where ok.model_id = c.model_id)::double as latency_ms_median,
  (select min(latency_ms) filter (r = round_even(0.95::double * (n - 1), 0)::bigint) from ok where ok.model_id = c.model_id)::double as latency_ms_p95,
  (select round(coalesce(usd, 0), 6) from spent where spent.model_id = c.model_id)::double as total_usd,
  sum(k) filter (not is_error)::bigint as in_tokens, sum(k * 7) filter (not is_error)::bigint as out_tokens from calls c group by c.model_id"""
)
def perf_by_model(spark, sf_dir):
    return perf.perf_by_model(perf_input(spark, sf_dir)).withColumn("total_usd", F.round("total_usd", 6))


@query(
    CALLS
    + """select endpoint, tier, n, billable_in, billable_out, cached, cache_write,
 0.07::double * (billable_in * dbu_in + billable_out * dbu_out + cached * dbu_cr + cache_write * dbu_cw) / 1000000::double * promo as usd
from (select endpoint, tier, count(*)::bigint as n, sum(billable_in)::bigint as billable_in, sum(billable_out)::bigint as billable_out, sum(cached)::bigint as cached, sum(cache_write)::bigint as cache_write,
 any_value(dbu_in) as dbu_in, any_value(dbu_out) as dbu_out, any_value(dbu_cr) as dbu_cr, any_value(dbu_cw) as dbu_cw, any_value(promo) as promo from priced group by endpoint, tier)"""
)
def cost_by_model(spark, sf_dir):
    return cost.cost_by_endpoint(calls(spark, sf_dir), cost.rate_table(spark, CARD), CARD["usd_per_dbu"])


@query(CALLS + "select event_id, tier, 0.07::double * (billable_in * dbu_in + billable_out * dbu_out + cached * dbu_cr + cache_write * dbu_cw) / 1000000::double * promo as usd from priced")
def cost_of_calls(spark, sf_dir):
    return cost.with_usd(calls(spark, sf_dir), cost.rate_table(spark, CARD), CARD["usd_per_dbu"]).select("event_id", "tier", "usd")


@query("select event_id, case when event_id % 3 = 0 then (props->>'k')::bigint * 2 else 0 end as reasoning_tokens from events")
def reasoning_token_counts(spark, sf_dir):
    return calls(spark, sf_dir).select("event_id", cost.reasoning_tokens(F.col("usage")).alias("reasoning_tokens"))


def usage_rows(spark, sf_dir):
    """A usage table that has the requests of even events only."""
    e = calls(spark, sf_dir).where("event_id % 2 = 0")
    return e.select(F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"), F.col("ts").cast("timestamp_ntz").alias("event_time"), F.col("endpoint").alias("endpoint_name"), F.when(F.col("is_error"), 500).otherwise(200).alias("status_code"), "latency_ms", F.col("in_tokens").alias("input_tokens"))


USAGE = """with u as (select 'req-' || event_id as request_id, ts as event_time, 'ep' || (user_id % 4) as endpoint_name, (case when event_type = 'error' then 500 else 200 end)::int as status_code, value as latency_ms, (props->>'k')::bigint as input_tokens from events where event_id % 2 = 0) """


@query(USAGE + "select r.event_id, 'req-' || r.event_id as request_id, u.latency_ms, u.input_tokens from events r left join u on u.request_id = 'req-' || r.event_id")
def usage_join(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"))
    return cost.with_usage(e, usage_rows(spark, sf_dir)).select("event_id", "request_id", "latency_ms", "input_tokens")


@query(USAGE + "select request_id, event_time, endpoint_name, status_code, latency_ms, input_tokens from u where request_id in (select 'req-' || event_id from events where event_type = 'error') order by event_time desc, request_id")
def usage_of_errors(spark, sf_dir):
    """The usage of the calls that failed, newest first."""
    failed = calls(spark, sf_dir).where("is_error").select(F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"))
    return cost.usage_of(usage_rows(spark, sf_dir), failed).select("request_id", "event_time", "endpoint_name", "status_code", "latency_ms", "input_tokens")


@query(
    """with p as (select user_id, round(avg(value) filter (event_type = 'click'), 6) as a, round(avg(value) filter (event_type = 'view'), 6) as b from events group by user_id),
d as (select user_id % 4 as grp, (a - b)::double as d from p where a is not null and b is not null),
r as (select grp, d, rank() over (partition by grp order by abs(d)) + (count(*) over (partition by grp, abs(d)) - 1) / 2.0 as rk from d where d <> 0)
select g.grp, n::bigint as n, coalesce(nz, 0)::bigint as n_nonzero, w::double as w from (select grp, count(*) as n from d group by grp) g
left join (select grp, count(*) as nz, least(coalesce(sum(rk) filter (d > 0), 0), coalesce(sum(rk) filter (d < 0), 0)) as w from r group by grp) x on g.grp = x.grp"""
)
def wilcoxon_w(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    mean = lambda t: F.round(F.avg(F.when(F.col("event_type") == t, F.col("value"))), 6)
    p = e.groupBy("user_id").agg(mean("click").alias("a"), mean("view").alias("b")).where("a is not null and b is not null")
    return stats.signed_ranks(p.withColumn("grp", F.col("user_id") % 4), ["grp"]).select("grp", "n", "n_nonzero", F.col("w").cast("double").alias("w"))


@query(
    """with s as (select 'T' || (user_id % 4) as task_id, event_type as model_id, user_id as sample_id, round(avg(value), 6) as v from events where event_type <> 'error' group by all
 union all select 'small', event_type, user_id, round(avg(value), 6) from events where event_type <> 'error' and user_id < 40 group by all
 union all select 'whole', event_type, user_id, round(avg(value)) from events where event_type <> 'error' group by all),
h as (select task_id, model_id, count(*) as k from s group by all),
c as (select a.task_id, a.model_id as a, b.model_id as b, a.k + b.k as k from h a join h b on a.task_id = b.task_id and a.model_id < b.model_id),
d as (select a.task_id, a.model_id as a, b.model_id as b, a.v - b.v as d from s a join s b on a.task_id = b.task_id and a.sample_id = b.sample_id and a.model_id < b.model_id),
r as (select task_id, a, b, d, rank() over (partition by task_id, a, b order by abs(d)) + (count(*) over (partition by task_id, a, b, abs(d)) - 1) / 2.0 as rk from d where d <> 0),
t as (select task_id, a, b, sum(t * t * t - t) as ties from (select task_id, a, b, count(*) as t from d where d <> 0 group by task_id, a, b, abs(d)) group by all),
w as (select task_id, a, b, count(*) as nz, least(coalesce(sum(rk) filter (d > 0), 0), coalesce(sum(rk) filter (d < 0), 0))::double as w from r group by all),
x as (select c.task_id, c.a, c.b, c.k, coalesce(n, 0) as n, coalesce(nz, 0) as nz, w, coalesce(ties, 0) as ties from c left join (select task_id, a, b, count(*) as n from d group by all) using (task_id, a, b) left join w using (task_id, a, b) left join t using (task_id, a, b)),
recursive_ways as (with recursive ways(n, c) as (select 0, [1::double] union all select n + 1, list_transform(range(0, (n + 1) * (n + 2) // 2 + 1), lambda i: coalesce(c[i + 1], 0) + case when i > n then coalesce(c[i - n], 0) else 0 end) from ways where n < 50) select * from ways),
z as (select *, abs(w - nz * (nz + 1) / 4::double) / sqrt(nz * (nz + 1) * (2 * nz + 1) / 24::double - ties / 48::double) as z from x),
p as (select *, case when k <> 2 * n or n < 2 or nz < 2 then null when ties = 0 and nz = n and n <= 50 then least(1, 2 * (select list_sum(c[1 : z.w::bigint + 1]) from recursive_ways v where v.n = z.nz) / pow(2, nz))
 else 1 - 2 / sqrt(2 * pi()) * z / 6000 * (1 + exp(-z * z / 2) + list_sum(list_transform(range(1, 2000), lambda i: (case when i % 2 = 1 then 4 else 2 end) * exp(-pow(z * i / 2000, 2) / 2)))) end as pval from z)
select task_id, a as model_a, b as model_b, n::bigint as n, w, round(pval, 8) as pval, coalesce(pval < 0.05, false) as significant, (k - 2 * n)::bigint as unpaired from p"""
)
def wilcoxon_pairs(spark, sf_dir):
    """Every two kinds of events compared by the users' mean values: by a quarter of the users, for few users where p is exact, and with ties."""
    e = read(spark, sf_dir, "events").where("event_type <> 'error'").withColumnRenamed("event_type", "model_id")
    score = lambda rows, task, digits: rows.groupBy(task.alias("task_id"), "model_id", F.col("user_id").alias("sample_id")).agg(F.round(F.avg("value"), digits).alias("score"))
    s = score(e, F.concat(F.lit("T"), (F.col("user_id") % 4).cast("string")), 6).unionAll(score(e.where("user_id < 40"), F.lit("small"), 6)).unionAll(score(e, F.lit("whole"), 0))
    out = stats.wilcoxon_pairs(s, ["task_id"])
    return out.select("task_id", "model_a", "model_b", "n", "w", F.round("pval", 8).alias("pval"), "significant", "unpaired")


# ---- answers derived from conversations ----------------------------------------------------------------------


def turns(spark, sf_dir):
    """Turn t as the reference, turn t + 1 as the answer."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return c.withColumnRenamed("text", "gold").join(nxt, ["conv_id", "turn"])


TURNS = "with pairs as (select a.conv_id, a.turn, a.text as gold, b.text as pred from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"
SPLIT = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"
MULTI = """, u as (select conv_id, turn, 0 as s, unnest(p) as t from tok union all select conv_id, turn, 1, unnest(g) from tok),
c as (select conv_id, turn, t, count(*) filter (s = 0) as p, count(*) filter (s = 1) as g from u group by all),
o as (select conv_id, turn, sum(least(p, g)) as o from c group by all)
"""


SYLLABLES = "regexp_extract_all({c}, '[가-힣]|[a-zA-Z0-9]+')"
F1 = "case when len(p) = 0 and len(g) = 0 then {both}::double when len(p) = 0 or len(g) = 0 then 0.0::double else 2.0::double * coalesce(o, 0)::double / (len(p) + len(g))::double end"


@query(TURNS + f", tok as (select conv_id, turn, {SPLIT('pred')} as p, {SPLIT('gold')} as g from pairs)" + MULTI + f"select conv_id, turn, {F1.format(both=1.0)} as token_f1 from tok left join o using (conv_id, turn)")
def token_f1_turns(spark, sf_dir):
    return text.token_f1_table(turns(spark, sf_dir), ["conv_id", "turn"])


@query(TURNS + f", tok as (select conv_id, turn, case when turn % 2 = 0 then {SYLLABLES.format(c='pred')} else {SPLIT('pred')} end as p, case when turn % 2 = 0 then {SYLLABLES.format(c='gold')} else {SPLIT('gold')} end as g from pairs)" + MULTI + f"select conv_id, turn, {F1.format(both=1.0)} as token_f1 from tok left join o using (conv_id, turn)")
def token_f1_by_counting(spark, sf_dir):
    """Tokens by the row's language: even turns as Korean, by syllables and ASCII words."""
    lang = F.when(F.col("turn") % 2 == 0, "ko").otherwise("en")
    return text.token_f1_table(turns(spark, sf_dir), ["conv_id", "turn"], lang=lang)


@query(
    """with r as (select conv_id, list(text order by turn) as golds from conversations group by conv_id), p as (select c.conv_id, c.turn, c.text as pred, list_filter(golds, lambda x: true)[1:turn - (select min(turn) from conversations d where d.conv_id = c.conv_id)] as golds from conversations c join r using (conv_id))
select conv_id, turn, coalesce(list_max(list_transform(golds, lambda g: (lower(trim(g, ' \n')) = lower(trim(pred, ' \n')))::int)), 0)::double as exact_match,
 coalesce(list_max(list_transform(golds, lambda g: (regexp_replace(lower(trim(g, ' \n')), '\\s+', ' ', 'g') = regexp_replace(lower(trim(pred, ' \n')), '\\s+', ' ', 'g'))::int)), 0)::double as accuracy from p"""
)
def exact_match_any_ref(spark, sf_dir):
    """The references of a turn are the turns before it: it matches one if its text, as either rule takes it, has come before."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", text.py_strip(F.lower("text")).alias("e"), text.normalize(F.col("text")).alias("a"))
    seen = text.seen_before(text.seen_before(c, ["conv_id", "e"], "turn", "exact_match"), ["conv_id", "a"], "turn", "accuracy")
    return seen.select("conv_id", "turn", F.col("exact_match").cast("double").alias("exact_match"), F.col("accuracy").cast("double").alias("accuracy"))


ROUGE_TOKENS = "regexp_extract_all(lower({c}), '[a-z0-9]+')"


def rouge_pairs(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", text.rouge_tokens(F.col("pred")).alias("p"), text.rouge_tokens(F.col("gold")).alias("g"))


ROUGE = """both_n as (select conv_id, turn, 1 as n, p, g from one union all select conv_id, turn, 2, list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]), list_transform(range(1, len(g)), lambda i: g[i] || ' ' || g[i + 1]) from one),
u as (select conv_id, turn, n, 0 as s, unnest(p) as t from both_n union all select conv_id, turn, n, 1, unnest(g) from both_n),
c as (select conv_id, turn, n, t, least(count(*) filter (s = 0), count(*) filter (s = 1)) as o from u group by all),
o as (select conv_id, turn, n, sum(o) as o from c group by all),
f as (select conv_id, turn, n, """ + F1.format(both=0.0) + """ as f from both_n left join o using (conv_id, turn, n)),
rouge as (select conv_id, turn, max(f) filter (n = 1) as rouge1, max(f) filter (n = 2) as rouge2 from f group by all) """


@query(TURNS + f", one as (select conv_id, turn, {ROUGE_TOKENS.format(c='pred')} as p, {ROUGE_TOKENS.format(c='gold')} as g from pairs), {ROUGE} select * from rouge")
def rouge_n_turns(spark, sf_dir):
    return text.rouge_table(rouge_pairs(spark, sf_dir), ["conv_id", "turn"], F.col("p"), F.col("g"))


# Common subsequence by match points: places in g of equal tokens, in the order of p and falling within one of its places; the longest rising chain of them.
CHAIN = """pi as (select conv_id, turn, unnest(p) as t, generate_subscripts(p, 1) as i from one), gi as (select conv_id, turn, unnest(g) as t, generate_subscripts(g, 1) as j from one),
mp as (select conv_id, turn, list(j order by i, j desc) as js from pi join gi using (conv_id, turn, t) group by all),
chain as (select conv_id, turn, len(list_reduce(js, lambda t, j: list_concat(list_concat(list_filter(t, lambda x: x < j), [j]), t[len(list_filter(t, lambda x: x < j)) + 2:]), []::bigint[])) as l from mp),
rouge_l as (select conv_id, turn, case when len(p) = 0 or len(g) = 0 then 0 else 2.0::double * coalesce(l, 0)::double / (len(p) + len(g))::double end as rougel from one left join chain using (conv_id, turn)) """


@query(TURNS + f", one as (select conv_id, turn, {ROUGE_TOKENS.format(c='pred')} as p, {ROUGE_TOKENS.format(c='gold')} as g from pairs), {CHAIN} select conv_id, turn, rougel as \"rougeL\" from rouge_l")
def rouge_l_turns(spark, sf_dir):
    return text.rouge_l_table(rouge_pairs(spark, sf_dir), ["conv_id", "turn"], F.col("p"), F.col("g"))


# Common subsequence of characters, bit-parallel in words of 60 bits with a carry: src has keys and the lists of characters p and g.
SUBSEQUENCE = """w as (select {keys}, p, g, (len(g) + 59) // 60 as k from {src}),
masks as (select {keys}, ch, list_transform(range(0, any_value(k)), lambda x: coalesce(list_sum(list_transform(list_filter(list(j), lambda j: j // 60 = x), lambda j: 1::hugeint << (j % 60)::int)), 0)::bigint) as m
  from (select {keys}, k, unnest(g) as ch, generate_subscripts(g, 1) - 1 as j from w) group by {keys}, ch),
by_char as (select {keys}, map(list(ch), list(m)) as mm from masks group by {keys}),
bits as (select {keys}, list_reduce(list_transform(p, lambda c: mm[c]),
   lambda row, m: case when m is null then row else list_reduce(range(1, len(row) + 1), lambda s, x: {{'c': (row[x] + (row[x] & m[x]) + s.c) >> 60, 'r': list_append(s.r, ((row[x] + (row[x] & m[x]) + s.c) & 1152921504606846975) | (row[x] - (row[x] & m[x])))}}, {{'c': 0::bigint, 'r': []::bigint[]}}).r end,
   list_transform(range(0, k), lambda x: 1152921504606846975::bigint)) as row from w join by_char using ({keys})),
lcs as (select {keys}, (60 * len(row) - list_sum(list_transform(row, lambda x: bit_count(x))))::bigint as l from bits) """


@query(
    TURNS
    + ", one as (select conv_id, turn, string_split(lower(pred), '') as p, string_split(lower(gold), '') as g from pairs where pred <> '' and gold <> ''), "
    + SUBSEQUENCE.format(keys="conv_id, turn", src="one")
    + "select conv_id, turn, (case when pred = '' or gold = '' then case when pred = gold then 100 else 0 end else round_even(200 * l::double / (length(pred) + length(gold))::double, 0) end)::int as ratio from pairs left join lcs using (conv_id, turn)"
)
def fuzzy_ratio_turns(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", text.fuzzy_ratio(F.lower("pred"), F.lower("gold")).alias("ratio"))


#: Ways of answering that the turns' texts are put into, by number.
ANSWERS = ["{t}", "  POSITIVE. ", "Negative", "it is not toxic", "clean\n", "1", "0", "yes, a weapon", "safe", "NSFW", "people", "none of these", "true", " ", "Rating is 3", "unclear"]


def answers(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    i = (F.col("conv_id") * 3 + F.col("turn")) % len(ANSWERS)
    out = F.col("text")
    for k, a in enumerate(ANSWERS[1:], 1):
        out = F.when(i == k, F.lit(a)).otherwise(out)
    return c.select("conv_id", "turn", out.alias("answer"))


ANSWERS_SQL = "with a as (select conv_id, turn, case (conv_id * 3 + turn) % 16 " + " ".join(f"when {k} then {a!r}".replace("\\n", "\n") for k, a in enumerate(ANSWERS) if k) + " else text end as answer from conversations), s as (select conv_id, turn, lower(trim(answer, ' \n')) as t, answer from a) "


def _case(rules: list[tuple[str, int]]) -> str:
    return ANSWERS_SQL + "select conv_id, turn, case when t = '' then null " + " ".join(f"when {c} then {v}" for c, v in rules) + " end::int as label from s"


def _any(*words: str) -> str:
    return "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")"


ONE, ZERO = "regexp_matches(t, '\\b1\\b')", "regexp_matches(t, '\\b0\\b')"


def _labels(spark, sf_dir, parse):
    return answers(spark, sf_dir).select("conv_id", "turn", parse(F.col("answer")).alias("label"))


@query(_case([(_any("positive"), 1), (_any("negative"), 0), (f"{ONE} or {_any('yes', 'true')}", 1), (f"{ZERO} or {_any('no', 'false')}", 0)]))
def parse_sentiment(spark, sf_dir):
    return _labels(spark, sf_dir, parsers.sentiment)


@query(_case([(_any("toxic"), 1), (_any("clean"), 0), (ONE, 1), (ZERO, 0)]))
def parse_toxicity(spark, sf_dir):
    return _labels(spark, sf_dir, parsers.toxicity)


@query(_case([(_any("no"), 0), (_any("yes", "threat", "weapon"), 1), (ONE, 1), (ZERO, 0)]))
def parse_weapon(spark, sf_dir):
    return _labels(spark, sf_dir, parsers.weapon)


@query(_case([(_any("nsfw"), 1), (_any("safe"), 0), (ONE, 1), (ZERO, 0)]))
def parse_nsfw(spark, sf_dir):
    return _labels(spark, sf_dir, parsers.nsfw)


@query(_case([(_any("no"), 0), (_any("yes", "person", "people"), 1), (ONE, 1), (ZERO, 0)]))
def parse_person(spark, sf_dir):
    return _labels(spark, sf_dir, parsers.person)


NORM = "trim(regexp_replace(lower(trim({x}, ' \n')), '\\s+', ' ', 'g'), ' ')"
PHRASES = "list_sort(list_distinct(list_filter(list_transform(string_split(translate({c}, chr(10) || ';', ',,'), ','), lambda x: " + NORM.format(x="x") + "), lambda x: x <> '')))"


@query(f"select conv_id, turn, array_to_string({PHRASES.format(c='text')}, '|') as phrases from conversations")
def parse_keyphrases(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(F.array_sort(parsers.keyphrases(F.col("text"))), "|").alias("phrases"))


@query(
    """with l as (select conv_id, turn, string_split('Found: ' || turn || chr(10) || text, chr(10)) as lines from conversations),
i as (select conv_id, turn, flatten(list_transform(lines[coalesce(nullif(list_position(list_transform(lines, lambda x: contains(x, ':')), true), 0), 1):], lambda x: list_transform(string_split(x, ','), lambda y: lower(trim(y, ' '))))) as items from l)
select conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(items, lambda x: length(x) >= 2 and len(list_filter(string_split(x, ' '), lambda w: w <> '')) <= 3), lambda x: trim(regexp_replace(x, '[.!?;:()]', '', 'g'), ' ')), lambda x: x <> ''))), '|') as tags from i"""
)
def parse_tags(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(F.array_sort(parsers.tags(F.concat(F.lit("Found: "), F.col("turn").cast("string"), F.lit("\n"), F.col("text")))), "|").alias("tags"))


def judge_texts(spark, sf_dir):
    """Judge answers of all three tiers."""
    c = read(spark, sf_dir, "conversations")
    i, n = (F.col("conv_id") + F.col("turn")) % 6, (F.col("conv_id") % 11).cast("string")
    t = F.when(i == 0, F.concat(F.lit("Score: "), n)).when(i == 1, F.concat(F.lit("the rating is "), n, F.lit(".5"))).when(i == 2, F.concat(F.lit("3 of them, so "), n, F.lit("/5")))
    t = t.when(i == 3, F.concat(F.lit("I give "), n, n)).when(i == 4, F.lit("no verdict")).otherwise(F.concat(F.lit("Score: **"), n, F.lit("**")))
    return c.select("conv_id", "turn", "role", t.alias("judge_text"))


JUDGE = """with j as (select conv_id, turn, role, case (conv_id + turn) % 6 when 0 then 'Score: ' || (conv_id % 11) when 1 then 'the rating is ' || (conv_id % 11) || '.5' when 2 then '3 of them, so ' || (conv_id % 11) || '/5'
 when 3 then 'I give ' || (conv_id % 11) || (conv_id % 11) when 4 then 'no verdict' else 'Score: **' || (conv_id % 11) || '**' end as t from conversations),
x as (select *, nullif(regexp_extract(t, '(?i)(?:score|rating)(?:\\s+is)?[\\s:]+(\\d+(?:\\.\\d+)?)', 1), '')::double as named, regexp_extract_all(t, '\\b([1-5])\\b', 1)[-1]::int as lone, regexp_extract_all(t, '\\d+')[-1]::int as num from j),
s as (select *, coalesce(case when named is not null then least(5, greatest(1, floor(named)::int)) end, lone, case when num <> 0 then least(5, greatest(1, num)) end)::int as score from x) """


@query(JUDGE + "select conv_id, turn, score from s")
def judge_score(spark, sf_dir):
    return judge_texts(spark, sf_dir).select("conv_id", "turn", parsers.judge_score(F.col("judge_text")).alias("score"))


@query(JUDGE + "select role, (sum(coalesce(score, 3))::double / count(*)::double) as mean_three, (sum(score)::double / count(score)::double) as mean_skip, count(score)::bigint as n_parsed, count(*)::bigint as n from s group by role")
def judge_mean(spark, sf_dir):
    j = judge_texts(spark, sf_dir)
    three = judge.judge_means(j, ["role"], "three").select("role", F.col("judge_mean").alias("mean_three"), "n_parsed", "n")
    return three.join(judge.judge_means(j, ["role"], "skip").select("role", F.col("judge_mean").alias("mean_skip")), "role")


@query(
    """select conv_id, turn, 'You are an expert evaluator for the following task:\n\n**Task:** ' || role || '\n**Description:** turns\n\n**Question/Context:**\n' || conv_id || '\n\n**Reference (ground truth):**\nr\n\n**Candidate output to evaluate:**\n' || text
 || '\n\n**Scoring rubric (1–5):**\n  1: bad\n  5: good\n\nPlease evaluate the candidate output against the reference and provide a score from 1 to 5.\nInclude brief reasoning, then state your final score clearly (e.g., "Score: 4").\n' as prompt from conversations"""
)
def judge_prompts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    anchors = F.create_map(F.lit(5), F.lit("good"), F.lit(1), F.lit("bad"))
    return c.select("conv_id", "turn", judge.judge_prompt(F.col("role"), F.lit("turns"), F.col("conv_id").cast("string"), F.lit("r"), F.col("text"), anchors).alias("prompt"))


def phrase_sets(spark, sf_dir):
    t = turns(spark, sf_dir)
    return t.select("conv_id", "turn", parsers.keyphrases(F.col("pred")).alias("pred"), parsers.keyphrases(F.col("gold")).alias("gold"))


@query(
    TURNS
    + f""", s as (select conv_id % 3 as grp, {PHRASES.format(c="pred")} as p, {PHRASES.format(c="gold")} as g from pairs),
c as (select grp, len(list_intersect(p, g)) as tp, len(p) as np, len(g) as ng from s),
r as (select *, case when np > 0 then tp / np::double else 0 end as p, case when ng > 0 then tp / ng::double else 0 end as r from c),
m as (select grp, sum(tp)::double as tp, sum(np)::double as np, sum(ng)::double as ng, round(avg(p), 9) as macro_precision, round(avg(r), 9) as macro_recall, round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0 end), 9) as macro_f1, count(*) as n from r group by grouping sets ((), (grp)))
select grp, round(coalesce(tp / nullif(np, 0), 0), 9) as micro_precision, round(coalesce(tp / nullif(ng, 0), 0), 9) as micro_recall, round(coalesce(2 * tp / nullif(np + ng, 0), 0), 9) as micro_f1, macro_precision, macro_recall, macro_f1, n::bigint as n from m"""
)
def multilabel_prf(spark, sf_dir):
    s = phrase_sets(spark, sf_dir).withColumn("grp", F.col("conv_id") % 3)
    out = metrics.by_language(s, [], metrics.multilabel_columns(F.col("pred"), F.col("gold")), "grp")
    return out.select("grp", *[F.round(c, 9).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1")], "n")


# ---- labels --------------------------------------------------------------------------------------------------


def labelled(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text").join(read(spark, sf_dir, "labels"), "doc_id")
    said = F.when(F.col("doc_id") % 7 == 0, "I cannot say").when(F.col("n_chars") % 3 == 0, "Toxic!").when(F.col("doc_id") % 5 == 0, "1").otherwise("clean")
    return d.withColumn("pred", parsers.toxicity(said)).withColumn("gold", F.col("toxic").cast("int"))


LABELLED = "with d as (select doc_id, lang, toxic::int as gold, case when doc_id % 7 = 0 then null when n_chars % 3 = 0 or doc_id % 5 = 0 then 1 else 0 end as pred from documents join labels using (doc_id)) "
BINARY = """coalesce(count(*) filter (pred = gold)::double / nullif(count(pred), 0)::double, 0.0::double) as accuracy,
 coalesce(2 * count(*) filter (pred = 1 and gold = 1)::double / nullif(2 * count(*) filter (pred = 1 and gold = 1) + count(*) filter (pred <> gold), 0)::double, 0.0::double) as f1,
 count(*) filter (pred = 0 and gold = 0)::bigint as tn, count(*) filter (pred = 1 and gold = 0)::bigint as fp, count(*) filter (pred = 0 and gold = 1)::bigint as fn, count(*) filter (pred = 1 and gold = 1)::bigint as tp,
 count(pred)::bigint as n_evaluated, count(*) filter (pred is null)::bigint as n_unparsed"""


@query(LABELLED + f"select {BINARY}, count(*) filter (pred is not null and gold = 0)::bigint as negative, count(*) filter (pred is not null and gold = 1)::bigint as positive from d")
def binary_metrics(spark, sf_dir):
    p, g = F.col("pred"), F.col("gold")
    return labelled(spark, sf_dir).agg(*metrics.binary_columns(p, g), *metrics.balance_columns(p, g))


@query(LABELLED + f", r as (select lang, {BINARY} from d group by grouping sets ((), (lang))), w as (select unnest([null, 'en', 'fr', 'ko']) as lang) select w.lang, r.* exclude (lang) from w left join r on w.lang is not distinct from r.lang")
def binary_metrics_by_lang(spark, sf_dir):
    cols = metrics.binary_columns(F.col("pred"), F.col("gold"))
    return metrics.by_language(labelled(spark, sf_dir), [], cols, languages=["en", "fr", "ko"])


@query(
    """with d as (select source, lang as gold, case when contains(text, ' the ') then 'en' when contains(text, ' der ') then 'de' when contains(text, ' le ') then 'fr' when contains(text, ' los ') then 'es' when doc_id % 2 = 0 then 'xx' end as pred from documents),
c as (select source, pred as p, gold as g, count(*) as n from d where pred is not null group by all),
k as (select source, p as cls from c union select source, g from c),
f as (select k.source, cls, coalesce((select sum(n) from c where c.source = k.source and p = cls and g = cls), 0) as tp, coalesce((select sum(n) from c where c.source = k.source and p = cls), 0) as np, coalesce((select sum(n) from c where c.source = k.source and g = cls), 0) as ng from k)
select source, round(sum(tp)::double / sum(np)::double, 9) as accuracy, round(avg(2 * tp::double / (np + ng)::double), 9) as macro_f1, sum(np)::bigint as n from f group by source"""
)
def macro_f1_lang(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    has = lambda w: F.col("text").contains(f" {w} ")
    pred = F.when(has("the"), "en").when(has("der"), "de").when(has("le"), "fr").when(has("los"), "es").when(F.col("doc_id") % 2 == 0, "xx")
    out = metrics.macro_f1(d.select("source", pred.alias("pred"), F.col("lang").alias("gold")), ["source"])
    return out.select("source", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"), "n")


@query(
    TURNS
    + f", tok as (select conv_id, turn, {SPLIT('pred')} as p, {SPLIT('gold')} as g, pred, gold from pairs)"
    + MULTI
    + """, f as (select conv_id, turn, case when len(p) = 0 and len(g) = 0 then 1.0::double when len(p) = 0 or len(g) = 0 then 0.0::double else 2.0::double * coalesce(o, 0)::double / (len(p) + len(g))::double end as f,
 (lower(trim(pred, ' \n')) = lower(trim(gold, ' \n')))::int::double as e, trim(pred, ' \n') <> '' as filled from tok left join o using (conv_id, turn))
select (conv_id % 3) as grp, round(avg(f), 9) as token_f1, round(avg(e), 9) as exact_match, round(avg(f) filter (filled), 9) as token_f1_filled, count(*) filter (filled)::bigint as n_filled, count(*)::bigint as n from f group by grp"""
)
def mean_scores(spark, sf_dir):
    """Means over all rows, where an empty answer counts 0, and over answers that aren't empty."""
    pairs = turns(spark, sf_dir)
    t = pairs.join(text.token_f1_table(pairs, ["conv_id", "turn"]), ["conv_id", "turn"]).select((F.col("conv_id") % 3).alias("grp"), F.col("token_f1").alias("f"), text.exact_match(F.col("pred"), F.col("gold")).alias("e"), (~text.is_blank(F.col("pred"))).alias("filled"))
    every = metrics.mean_columns({"token_f1": F.col("f"), "exact_match": F.col("e")})
    some = metrics.mean_columns({"token_f1_filled": F.col("f")}, keep=F.col("filled"))
    out = t.groupBy("grp").agg(*every, some[0], some[1].alias("n_filled"))
    return out.select("grp", *[F.round(c, 9).alias(c) for c in ("token_f1", "exact_match", "token_f1_filled")], "n_filled", "n")


# ---- tables and artifacts ------------------------------------------------------------------------------------


def html_tables(spark, sf_dir):
    """A table of the nations of each region, and the same with a name cut, a cell emptied and a header row."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    k = F.col("n_nationkey")
    gold = F.concat(F.lit("<tr>"), cell(k.cast("string")), cell(F.col("n_name")), F.lit("</tr>"))
    pred = F.concat(F.lit("<TR>"), cell(F.when(k % 5 == 0, "").otherwise(k.cast("string"))), cell(F.when(k % 3 == 0, F.substring("n_name", 1, 4)).otherwise(F.concat(F.lit(" <b>"), F.lower("n_name"), F.lit("</b> ")))), F.lit("</TR>"))
    rows = n.groupBy("r_regionkey").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), x.alias("x")))), lambda s: s["x"]), "").alias(name) for name, x in (("gold", gold), ("pred", pred))])
    return rows.select("r_regionkey", F.concat(F.lit("<table><tr><th>key</th></tr>"), F.col("gold"), F.lit("</table>")).alias("gold"), F.concat(F.lit("Here: <table border=1><tr><th>key</th></tr>"), F.col("pred"), F.lit("</table> done")).alias("pred"))


@query(
    """with t as (select n_regionkey as r_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) as r, n_nationkey as k, n_name from nation),
c as (select r_regionkey, r, 0 as c, case when k % 5 = 0 then '' else k::varchar end as txt from t union all select r_regionkey, r, 1, case when k % 3 = 0 then substring(n_name, 1, 4) else lower(n_name) end from t)
select r_regionkey, r::int as r, c::int as c, trim(regexp_replace(txt, '\\s+', ' ', 'g')) as txt from c where txt <> ''"""
)
def cell_extract(spark, sf_dir):
    t = html_tables(spark, sf_dir).select("r_regionkey", F.explode(parsers.table_cells(parsers.table_or_text(F.col("pred")))).alias("x"))
    return t.select("r_regionkey", "x.r", "x.c", "x.txt")


@query(
    """with t as (select n_regionkey as a, row_number() over (partition by n_regionkey order by n_nationkey) as r, n_nationkey as k, n_name from nation),
gc as (select a, r, 0 as c, k::varchar as txt from t union all select a, r, 1, n_name from t),
pc as (select a, r, 0 as c, case when k % 5 = 0 then '' else k::varchar end as txt from t union all select a, r, 1, case when k % 3 = 0 then substring(n_name, 1, 4) else lower(n_name) end from t),
g as (select a, row_number() over (partition by a order by r, c) as gi, r, c, lower(txt) as txt from gc), p as (select a, row_number() over (partition by a order by r, c) as pi, r, c, lower(txt) as txt from pc where txt <> ''),
one as (select a, gi, pi, string_split(p.txt, '') as p, string_split(g.txt, '') as g, p.txt as pt, g.txt as gt, case when p.r = g.r and p.c = g.c then 1.0::double else 0.5::double end as pos from g join p using (a)), """
    + SUBSEQUENCE.format(keys="a, gi, pi", src="one")
    + """, v as (select a, gi, pi, pos, round_even(200 * l::double / (length(pt) + length(gt))::double, 0)::double / 100.0::double as alike from one join lcs using (a, gi, pi)),
best as (select a, gi, list(pi order by 0.7::double * alike + 0.3::double * pos desc, pi) as pis from v where alike >= 0.8::double group by a, gi),
x as (select a, len(list_reduce(list(pis order by gi), lambda used, pis: case when len(list_filter(pis, lambda x: not list_contains(used, x))) = 0 then used else list_append(used, list_filter(pis, lambda x: not list_contains(used, x))[1]) end, []::bigint[])) as hits from best group by a),
f as (select a, hits::double / (select count(*) from p where p.a = x.a)::double as pr, hits::double / (select count(*) from g where g.a = x.a)::double as re from x)
select a as r_regionkey, 2 * (pr * re) / (pr + re) as cell_f1 from f"""
)
def cell_f1(spark, sf_dir):
    t = html_tables(spark, sf_dir).select("r_regionkey", parsers.table_cells(parsers.table_or_text(F.col("pred"))).alias("p"), parsers.table_cells(F.col("gold")).alias("g"))
    # the exchange keeps the optimizer from merging the Python function into the aggregation, which it cannot run there
    return t.repartition("r_regionkey").select("r_regionkey", text.cell_f1("p", "g").alias("cell_f1"))


@query("with t as (select n_regionkey as k, string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) order by n_nationkey) as body from nation group by n_regionkey) select k as r_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || body as table_md from t")
def table_markdown(spark, sf_dir):
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    rows = F.transform("rows", lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"], F.lit("beyond the header")))
    return n.select(F.col("n_regionkey").alias("r_regionkey"), tasks.table_markdown(F.array(F.lit("key"), F.lit("name")), rows).alias("table_md"))


@query(
    """with t as (select n_regionkey as k, row_number() over (partition by n_regionkey order by n_nationkey) as r, n_nationkey as n, n_name from nation),
l as (select k, 0 as r, '[] []' as line from t group by k union all select k, r, '[' || n || '] [' || n_name || ']' from t),
g as (select k, string_agg(line, chr(10) order by r) as g from l group by k)
select k as r_regionkey, 'Given the following table cell contents in row-major order, generate a valid HTML table with proper <table>, <tr>, and <td> tags.' || chr(10) || chr(10) || 'Table cells:' || chr(10) || g || chr(10) || chr(10) || 'Generate the HTML table structure. Respond with ONLY the HTML code, no explanation:' as prompt from g"""
)
def table_prompts(spark, sf_dir):
    rows = html_tables(spark, sf_dir).select(F.col("r_regionkey").alias("sample_id"), F.col("gold").alias("html"))
    s = tasks.samples_table(rows)
    return s.select(F.col("sample_id").alias("r_regionkey"), tasks.REGISTRY["TXT-3"].prompt({"table_text": F.col("table_text")}).alias("prompt"))


PAGE_TOPICS = {"first": ["the", "der"], "second": ["zzzz", "nav"], "third": ["qqqq"]}


def graded(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 50 == 7, "").otherwise(F.col("html")).alias("html"))
    return artifacts.validate(pages, PAGE_TOPICS, 2, 10, element="p", cls="menu")


STRIP = r"""regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[/!a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>', ' ', 'g')"""
GRADED = rf"""with p as (select page_id, case when page_id % 50 = 7 then '' else html end as html from pages),
v as (select page_id, html <> '' as there, lower({STRIP}) as t, starts_with(lower(ltrim(html, ' ' || chr(10) || chr(9) || chr(13))), '<!doctype') as has_doctype,
 len(regexp_extract_all(html, '(?i)<p[\s/>]')) as n_p,
 len(list_filter(regexp_extract_all(html, '(?is)<[a-z][a-z0-9-]*\s[^>]*>'), lambda x: regexp_matches(x, '(?is)\sclass\s*=\s*("([^"]*[^\w"-])?menu([^\w"-][^"]*)?"|''([^''\w-]*[^\w''-])?menu([^\w''-][^'']*)?'')'))) as n_c,
 len(list_filter(regexp_extract_all(html, '(?is)<link[\s/][^>]*>'), lambda x: regexp_matches(x, '(?is)\srel\s*=\s*["'']?stylesheet["''\s/>]') and regexp_matches(x, '(?is)\shref\s*=\s*["'']?https?://'))) + len(regexp_extract_all(html, '(?is)<script\s[^>]*src\s*=\s*["'']?https?://')) as refs from p),
g as (select page_id, there as parse_ok, has_doctype, case when there then greatest(n_p, n_c) else 0 end as slide_count, case when there then refs else 0 end as external_refs,
 contains(t, 'the') or contains(t, 'der') as k1, contains(t, 'zzzz') or contains(t, 'nav') as k2, contains(t, 'qqqq') as k3 from v),
h as (select *, parse_ok and slide_count between 2 and 10 as slide_count_ok, case when parse_ok then k1::int + k2::int + k3::int else 0 end as keywords_found, case when parse_ok then 3 else 0 end as keywords_total,
 case when parse_ok then array_to_string(list_filter([case when not k1 then 'first' end, case when not k2 then 'second' end, case when not k3 then 'third' end], lambda x: x is not null), ', ') else '' end as missing from g) """


@query(GRADED + "select page_id, parse_ok, has_doctype, slide_count::int as slide_count, slide_count_ok, external_refs::int as external_refs from h")
def html_validate(spark, sf_dir):
    return graded(spark, sf_dir).select("page_id", "parse_ok", "has_doctype", "slide_count", "slide_count_ok", "external_refs")


@query(GRADED + "select page_id, keywords_found::int as keywords_found, keywords_total::int as keywords_total, missing from h")
def keyword_coverage(spark, sf_dir):
    return graded(spark, sf_dir).select("page_id", "keywords_found", "keywords_total", F.array_join("keywords_missing", ", ").alias("missing"))


SCORED = GRADED + """, s as (select page_id, round(0.4::double * case when keywords_total > 0 then keywords_found::double / keywords_total::double else 0 end + 0.3::double * slide_count_ok::int::double, 3) as auto_score,
 parse_ok and slide_count_ok as valid, keywords_found || '/' || keywords_total as keywords,
 array_to_string(list_filter([case when missing <> '' then 'missing topics: ' || missing end, case when external_refs > 0 then external_refs || ' external http ref(s) (not self-contained)' end, 'skipped'], lambda x: x is not null), '; ') as note from h) """


@query(SCORED + "select page_id, auto_score, valid, keywords, note from s")
def auto_score(spark, sf_dir):
    return artifacts.grade(graded(spark, sf_dir)).select("page_id", "auto_score", "valid", "keywords", "note")


@query(SCORED + "select page_id, auto_score, case when page_id % 3 = 0 then (1 + page_id % 5)::int end as human_score, case when page_id % 3 = 0 then 'n' || page_id else '' end as human_note from s")
def human_merge(spark, sf_dir):
    g = artifacts.grade(graded(spark, sf_dir)).select("page_id", "auto_score")
    human = read(spark, sf_dir, "pages").where("page_id % 3 = 0").select("page_id", (1 + F.col("page_id") % 5).cast("int").alias("human_score"), F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("human_note"))
    return artifacts.merge_human(g, human, "page_id")


@query("select page_id, html || '</html>' as found from pages")
def html_of_completion(spark, sf_dir):
    """Pages wrapped in prose or in a fence come out as they went in."""
    p = read(spark, sf_dir, "pages").withColumn("html", F.concat("html", F.lit("</html>")))
    said = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Here is the page:\n```html\n"), F.col("html"), F.lit("\n```\nBye"))).otherwise(F.concat(F.lit("Sure. "), F.col("html"), F.lit(" ok")))
    return p.select("page_id", parsers.html_of_completion(said).alias("found"))


# ---- sampling and plan ---------------------------------------------------------------------------------------


@query("select doc_id, lang from documents order by md5('42-' || doc_id), doc_id limit 50")
def seeded_sample(spark, sf_dir):
    return sampling.seeded_sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


@query("select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by md5('42-' || doc_id), doc_id) as r from documents) where r <= case lang when 'en' then 13 when 'fr' then 12 when 'de' then 12 when 'es' then 12 end")
def lang_quota_sample(spark, sf_dir):
    return sampling.language_quota_sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 49, ["en", "fr", "de", "es"])


@query(
    """with l as (select doc_id, toxic from labels), p as (select doc_id, 1 as label from l where toxic = 1 order by md5('42-' || doc_id), doc_id limit 10), n as (select doc_id, 0 as label from l where toxic = 0 order by md5('42-' || doc_id), doc_id limit 11)
select doc_id, label::int as label from p union all select doc_id, label::int from n"""
)
def balanced_pair_sample(spark, sf_dir):
    lab = read(spark, sf_dir, "labels")
    return sampling.balanced_pair(lab.where("toxic = 1").select("doc_id"), lab.where("toxic = 0").select("doc_id"), "doc_id", 21)


MODELS = {"models": [{"id": "m0", "endpoint": "ep0", "family": "a", "capabilities": ["text", "vision"], "reasoning": {"minimal": {"effort": "none"}}}, {"id": "m1", "endpoint": "ep1", "family": "b", "capabilities": ["text", "vision"]}, {"id": "m2", "endpoint": "ep2", "family": "b", "capabilities": ["text"]}]}
TASKS = {"image_tasks": [{"id": "IMG-1", "kind": "generation", "datasets": {"en": "a"}}, {"id": "IMG-3", "kind": "binary", "datasets": {"en": "b"}, "sensitive": True}], "text_tasks": [{"id": "TXT-1", "kind": "qa", "datasets": {"en": "c"}}, {"id": "TXT-5", "kind": "generation", "datasets": {"en": "c", "ko": "d"}}]}
CELLS = """with m(model_id, endpoint, vision, o) as (values ('m0', 'ep0', true, 0), ('m1', 'ep1', true, 1), ('m2', 'ep2', false, 2)), t(task_id, o) as (values ('IMG-1', 0), ('IMG-3', 1), ('TXT-1', 2), ('TXT-5', 3)), r(reasoning_mode) as (values ('minimal'), ('full')),
cells as (select model_id, endpoint, task_id, reasoning_mode from m, t, r where vision or not starts_with(task_id, 'IMG-')) """


def dims(spark):
    return config.models_table(spark, MODELS), config.tasks_table(spark, TASKS), config.modes_table(spark, MODELS)


def fleet(spark, sf_dir):
    """A configuration of tables: suppliers as models, of which every third knows no images, regions as tasks, two modes."""
    k = F.col("s_suppkey")
    models = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("model_id"), F.concat(F.lit("ep"), F.col("s_nationkey").cast("string")).alias("endpoint"), F.when(k % 3 == 0, F.array(F.lit("text"))).otherwise(F.array(F.lit("text"), F.lit("vision"))).alias("capabilities"), k.alias("ordinal"))
    r = F.col("r_regionkey")
    tasks_ = read(spark, sf_dir, "region").select(F.concat(F.when(r % 2 == 0, "IMG-").otherwise("TXT-"), r.cast("string")).alias("task_id"), r.alias("ordinal"))
    return models, tasks_, config.modes_table(spark, MODELS)


FLEET = """with t as (select case when r_regionkey % 2 = 0 then 'IMG-' else 'TXT-' end || r_regionkey as task_id from region), every as (select s_suppkey as k, s_nationkey as nation, s_name as model_id, 'ep' || s_nationkey as endpoint, task_id, reasoning_mode from supplier, t, (values ('minimal'), ('full')) r(reasoning_mode)),
fleet as (select * from every where k % 3 <> 0 or not starts_with(task_id, 'IMG-')) """


@query(FLEET + "select model_id, endpoint, task_id, reasoning_mode from fleet")
def execution_matrix(spark, sf_dir):
    return matrix.execution_matrix(*fleet(spark, sf_dir)).select("model_id", "endpoint", "task_id", "reasoning_mode")


@query(FLEET + "select model_id, endpoint, task_id, reasoning_mode from fleet where model_id in ('Supplier#000000001', 'Supplier#000000003') and reasoning_mode = 'full'")
def cells_of_some(spark, sf_dir):
    """The matrix cut to some models and one mode."""
    return matrix.execution_matrix(*fleet(spark, sf_dir), only_models=["Supplier#000000001", "Supplier#000000003"], only_modes=["full"]).select("model_id", "endpoint", "task_id", "reasoning_mode")


@query(FLEET + "select model_id, count(*)::bigint as n_cells from fleet group by model_id")
def cells_per_model(spark, sf_dir):
    return matrix.cells_per_model(matrix.execution_matrix(*fleet(spark, sf_dir)))


@query(FLEET + "select ((select count(*) from every) - (select count(*) from fleet))::bigint as n_na")
def cells_not_applicable(spark, sf_dir):
    return matrix.not_applicable(*fleet(spark, sf_dir))


@query("select distinct source || '/' || lang as dataset_key, case when lang <> 'fr' then 'x/' || source end as hf_id, case when lang <> 'fr' then 'test' end as split, case when lang <> 'fr' then lang end as config from documents where source is not null and lang is not null")
def reproducibility(spark, sf_dir):
    """The data sets that tasks name, with what the registry tells of them: each source is a task with a set for each language, and those in French aren't registered."""
    d = read(spark, sf_dir, "documents").where("source is not null and lang is not null").select("source", "lang").distinct()
    key = F.concat("source", F.lit("/"), "lang")
    named = d.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", key.alias("key")))).alias("datasets"))
    known = d.where("lang <> 'fr'").select(key.alias("key"), F.concat(F.lit("x/"), "source").alias("hf_id"), F.lit("test").alias("split"), F.col("lang").alias("config"))
    return matrix.reproducibility(named, known)


@query(
    CELLS
    + """, s as (select doc_id, text from documents), j as (select model_id, task_id, reasoning_mode, s.doc_id as sample_id, text, case when s.doc_id % 300 = 0 then null else 'positive' end as said from cells, s where task_id = 'TXT-1')
select model_id, reasoning_mode, sample_id, case when said is null then '__ERROR__: no response' else said end as model_output, case when said is null then 'error' else 'stop' end as finish_reason,
 case when length(p) > 2000 then substring(p, 1, 2000) || '…' else p end as prompt from (select *, 'Answer the following question:' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer:' as p from j)"""
)
def replayed_run(spark, sf_dir):
    """Samples of one task in every cell, their prompts, and replayed answers of which some are missing."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("sample_id"), F.col("text").alias("question"), F.array(F.lit("x")).alias("answers"))
    planned = matrix.planned_samples(matrix.execution_matrix(*dims(spark)), tasks.samples_qa(rows, "TXT-1"))
    planned = planned.withColumn("prompt", text.prompt_text(F.array(tasks.REGISTRY["TXT-1"].prompt({c: F.col(c) for c in ("question", "context")}))))
    said = planned.where("sample_id % 300 <> 0").select(*provider.KEYS, F.lit("positive").alias("text"), F.lit("stop").alias("finish_reason"))
    return provider.replay(planned, said).select("model_id", "reasoning_mode", "sample_id", "model_output", "finish_reason", "prompt")


@query("select conv_id, turn, case when conv_id % 3 = 0 then trim(text, ' \n') when conv_id % 3 = 1 then trim(text || role, ' \n') else 'thought' end as answer from conversations")
def response_text(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    i = F.col("conv_id") % 3
    content = F.when(i == 0, F.concat(F.lit("  "), F.col("text"))).when(i == 2, F.lit(" \n"))
    parts = F.when(i == 1, F.array(part("reasoning", F.lit("hidden")), part("text", F.col("text")), part("text", F.col("role"))))
    return c.select("conv_id", "turn", parsers.response_text(content, parts, F.lit(" thought ")).alias("answer"))


@query("select doc_id, case when lang = 'fr' then '다음 문서에 대한 간결한 요약을 생성하세요. 요약은 원문의 핵심 내용을 2-3문장으로 정리해야 합니다.\n\n문서:\n' || substring(text, 1, 6000) || '\n\n요약:' else 'Generate a concise summary of the following document. The summary should capture the key points in 2-3 sentences.\n\nDocument:\n' || substring(text, 1, 6000) || '\n\nSummary:' end as prompt from documents")
def summary_prompts(spark, sf_dir):
    """French stands in for the language with a template of its own."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.when(F.col("lang") == "fr", "ko").otherwise(F.col("lang")).alias("lang"), "text", F.lit("s").alias("summary"))
    s = tasks.samples_summary(d)
    return s.select(F.col("sample_id").alias("doc_id"), tasks.REGISTRY["TXT-5"].prompt({"document": F.col("document"), "lang": F.col("lang")}).alias("prompt"))


# ---- ranking -------------------------------------------------------------------------------------------------


def task_scores(spark, sf_dir):
    """Scores of models m0-m2 on tasks by language: m0 and m1 tie on some; one task has no metric that can stand for it."""
    d = read(spark, sf_dir, "documents").where("lang is not null")
    s = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("doc_id") % 7).alias("x"))
    out = None
    for o, (m, value) in enumerate((("m0", F.col("x") / (F.col("n") * 7)), ("m1", F.col("x") / (F.col("n") * 7) + F.lit(0.00001)), ("m2", (F.col("n") % 10) / 10.0))):
        part = s.select(F.lit(m).alias("model_id"), F.lit(o).alias("ordinal"), F.concat(F.lit("T-"), "lang").alias("task_id"), F.lit("full").alias("reasoning_mode"), F.when(F.col("lang") == "es", "cell_f1").when(F.col("lang") == "de", "token_f1").otherwise("accuracy").alias("metric"), value.alias("value"), F.lit(0).alias("position"))
        out = part if out is None else out.unionAll(part)
    return out


SCORES = """with s as (select lang, count(*) as n, sum(doc_id % 7) as x from documents where lang is not null group by lang), v as (select 'm0' as model_id, 0 as o, lang, x::double / (n * 7)::double as v from s union all select 'm1', 1, lang, x::double / (n * 7)::double + 0.00001::double from s union all select 'm2', 2, lang, (n % 10)::double / 10.0::double from s),
r as (select model_id, o, 'T-' || lang as task_id, round_even(v, 4) as v from v where lang <> 'es'), w as (select task_id, model_id as winner, v, row_number() over (partition by task_id order by v desc, o) as k from r) """


@query(SCORES + "select task_id, 'full' as reasoning_mode, winner, v as score_4 from w where k = 1")
def winners(spark, sf_dir):
    return rank.winners(rank.representative(task_scores(spark, sf_dir)))


@query(SCORES + "select winner as model_id, count(*)::bigint as wins from w where k = 1 group by winner")
def win_counts(spark, sf_dir):
    return rank.win_counts(rank.winners(rank.representative(task_scores(spark, sf_dir))))


@query(SCORES + "select model_id || '::T-' || lang || '::full' as key, case lang when 'es' then 'cell_f1' when 'de' then 'token_f1' else 'accuracy' end || '=' || printf('%.3f', v) as cell from v")
def quant_table(spark, sf_dir):
    return rank.quant_rows(task_scores(spark, sf_dir))


@query(
    CALLS
    + """, p as (select model_id, coalesce(sum(0.07::double * (billable_in * dbu_in + billable_out * dbu_out + cached * dbu_cr + cache_write * dbu_cw) / 1000000::double * promo) filter (not is_error), 0) as cost, median(latency_ms) filter (not is_error) as med from priced group by model_id)
select 'cheapest' as kind, (select model_id from p order by cost, model_id limit 1) as model_id union all select 'fastest', (select model_id from p where med is not null order by med, model_id limit 1)"""
)
def cheapest_fastest(spark, sf_dir):
    p = perf.perf_by_model(perf_input(spark, sf_dir)).withColumn("ordinal", F.substring("model_id", 2, 9).cast("int"))
    return rank.cheapest_fastest(p)


@query("with r as (select o_orderkey % 20 as k, min(o_orderdate::timestamp) as t from orders group by 1) select k, strftime(t, '%Y-%m-%dT%H-%M') || '_x' as run_id from r order by run_id desc")
def run_ids(spark, sf_dir):
    r = read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 20).alias("k")).agg(F.min(F.col("o_orderdate").cast("timestamp")).alias("t"))
    return r.select("k", matrix.run_id(F.col("t"), "x").alias("run_id")).orderBy(F.desc("run_id"))


@query(
    CALLS
    + """select date_trunc('hour', ts) as start, model_id, count(*)::bigint as n_calls, count(*) filter (is_error)::bigint as errors, sum(k) filter (not is_error)::bigint as in_tokens from calls group by all"""
)
def perf_by_hour(spark, sf_dir):
    """The windowed aggregates of the streaming extension, over the whole table at once."""
    from .streaming.perf import windowed_perf

    out = windowed_perf(calls(spark, sf_dir))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "model_id", "n_calls", "errors", "in_tokens")


LABELLED_TASKS = ("TXT-6", "TXT-8", "IMG-3", "IMG-4", "IMG-5")


def run_results(spark, sf_dir):
    """Answers of two models to every task, from adjacent turns."""
    t = turns(spark, sf_dir)
    cell = lambda c: F.concat(F.lit("<table><tr><td>"), F.col(c), F.lit("</td><td>x</td></tr></table>"))
    out = t.select(
        F.concat(F.lit("m"), (F.col("turn") % 2).cast("string")).alias("model_id"),
        F.explode(F.array(*[F.lit(x) for x in tasks.REGISTRY])).alias("task_id"),
        F.lit("full").alias("reasoning_mode"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"),
        F.when(F.col("conv_id") % 2 == 0, "en").otherwise("ko").alias("lang"),
        F.when(F.col("conv_id") % 9 == 0, "").otherwise(F.col("pred")).alias("said"),
        F.array("gold").alias("ref_text"),
        (F.col("conv_id") % 2).cast("int").alias("ref_label"),
        parsers.keyphrases(F.col("gold")).alias("ref_set"),
        cell("gold").alias("ref_html"),
        cell("pred").alias("html"),
    )
    s = F.col("sample_id")
    label = F.when(s % 7 == 0, "?").when(s % 5 == 0, "negative, clean, no, safe").otherwise(F.when(s % 3 == 0, "positive, toxic, yes").otherwise("0"))
    answer = F.when(F.col("task_id").isin(*LABELLED_TASKS), label).when(F.col("task_id") == "TXT-3", F.col("html")).otherwise(F.col("said"))
    return out.withColumn("model_output", answer).drop("said", "html")


SAID = TURNS + """, r as (select 'm' || (turn % 2) as model_id, conv_id, turn, gold, case when conv_id % 2 = 0 then 'en' else 'ko' end as lang, case when conv_id % 9 = 0 then '' else trim(pred, ' \n') end as pred from pairs) """


def _metrics(scores, metric: str | None = None):
    out = scores.where(metric) if metric else scores
    return out.select("model_id", "task_id", "lang", "n", "metric", F.round("value", 9).alias("value"))


@query(
    SAID
    + f""", tok as (select conv_id, turn, case when lang = 'ko' then {SYLLABLES.format(c="pred")} else {SPLIT("pred")} end as p, case when lang = 'ko' then {SYLLABLES.format(c="gold")} else {SPLIT("gold")} end as g from r) """
    + MULTI
    + f""", f as (select model_id, pred <> '' as filled, case when pred <> '' then {F1.format(both=1.0)} else 0 end as f, (pred <> '' and lower(pred) = lower(trim(gold, ' \n')))::int::double as e,
 (pred <> '' and regexp_replace(lower(pred), '\\s+', ' ', 'g') = regexp_replace(lower(trim(gold, ' \n')), '\\s+', ' ', 'g'))::int::double as a from r join tok using (conv_id, turn) left join o using (conv_id, turn)),
g as (select model_id, avg(f) as f, avg(e) as e, avg(a) as a, count(*) as n, coalesce(avg(f) filter (filled), 0) as cf, count(*) filter (filled) as cn from f group by model_id)
select model_id, task_id, null::varchar as lang, (case when task_id = 'IMG-1' then cn else n end)::bigint as n, metric, round(case metric when 'accuracy' then a when 'exact_match' then e when 'token_f1' then f when 'caption_token_f1' then cf else 1 end, 9) as value
from g, (values ('TXT-1', 'token_f1'), ('TXT-1', 'exact_match'), ('TXT-2', 'accuracy'), ('TXT-2', 'token_f1'), ('TXT-4', 'token_f1'), ('TXT-4', 'exact_match'), ('TXT-4', 'tokenizer_syllable'), ('IMG-1', 'caption_token_f1')) t(task_id, metric)"""
)
def scored_qa(spark, sf_dir):
    return _metrics(scoring.qa_scores(run_results(spark, sf_dir)))


@query(
    SAID
    + f", one as (select conv_id, turn, {ROUGE_TOKENS.format(c='pred')} as p, {ROUGE_TOKENS.format(c='gold')} as g from r), {ROUGE}, {CHAIN}"
    + """, m as (select model_id, lang, count(*) as n, avg(rouge1) as r1, avg(rouge2) as r2, avg(rougel) as rl from r join rouge using (conv_id, turn) join rouge_l using (conv_id, turn) group by grouping sets ((model_id), (model_id, lang)))
select model_id, 'TXT-5' as task_id, lang, n::bigint as n, metric, round(case metric when 'rouge1' then r1 when 'rouge2' then r2 else rl end, 9) as value from m, (values ('rouge1'), ('rouge2'), ('rougeL')) t(metric)"""
)
def scored_summaries(spark, sf_dir):
    return _metrics(scoring.summary_scores(run_results(spark, sf_dir), scoring.LANGUAGES))


@query(
    SAID
    + """, a as (select model_id, lang, (conv_id % 2)::int as gold, case when (conv_id * 100 + turn) % 7 = 0 then null when (conv_id * 100 + turn) % 5 = 0 then 0 when (conv_id * 100 + turn) % 3 = 0 then 1 else 0 end as yes from r),
b as (select task_id, model_id, lang, gold, case when task_id = 'IMG-4' and yes = 1 then null else yes end as pred from a, (values ('TXT-6'), ('TXT-8'), ('IMG-3'), ('IMG-4'), ('IMG-5')) t(task_id)),
g as (select task_id, model_id, lang, count(pred) as n, count(*) filter (pred = gold) as hit, count(*) filter (pred = 0 and gold = 0) as tn, count(*) filter (pred = 1 and gold = 0) as fp, count(*) filter (pred = 0 and gold = 1) as fn, count(*) filter (pred = 1 and gold = 1) as tp,
  count(*) filter (pred is null) as un, count(*) filter (pred is not null and gold = 0) as c0, count(*) filter (pred is not null and gold = 1) as c1 from b group by grouping sets ((task_id, model_id), (task_id, model_id, lang))),
v as (select *, case when n > 0 then hit::double / n::double when lang is null then 0 end as accuracy, case when n > 0 then coalesce(2 * tp::double / nullif(2 * tp + fp + fn, 0)::double, 0) when lang is null then 0 end as f1,
  (coalesce(2 * tp::double / nullif(2 * tp + fp + fn, 0)::double, 0) + coalesce(2 * tn::double / nullif(2 * tn + fp + fn, 0)::double, 0)) / 2 as macro from g)
select model_id, task_id, lang, n::bigint as n, metric, round(case metric when 'accuracy' then accuracy when 'f1' then f1 when 'tn' then tn when 'fp' then fp when 'fn' then fn when 'tp' then tp when 'n_unparsed' then un when 'macro_f1' then macro when 'sfw' then c0 when 'class_0' then c0 else c1 end, 9) as value
from v, (values ('accuracy'), ('f1'), ('tn'), ('fp'), ('fn'), ('tp'), ('n_unparsed'), ('class_0'), ('class_1'), ('sfw'), ('nsfw'), ('macro_f1')) t(metric)
where (lang is null or starts_with(task_id, 'TXT-')) and case task_id when 'TXT-6' then metric in ('accuracy', 'n_unparsed') or metric = 'macro_f1' and lang is null when 'IMG-4' then metric not in ('class_0', 'class_1', 'macro_f1') else metric not in ('sfw', 'nsfw', 'macro_f1') end"""
)
def scored_labels(spark, sf_dir):
    return _metrics(scoring.label_scores(run_results(spark, sf_dir), scoring.LANGUAGES))


TAGS = """list_distinct(list_filter(list_transform(list_filter(flatten(list_transform(string_split({c}, chr(10))[coalesce(nullif(list_position(list_transform(string_split({c}, chr(10)), lambda x: contains(x, ':')), true), 0), 1):], lambda x: list_transform(string_split(x, ','), lambda y: lower(trim(y, ' '))))),
 lambda x: length(x) >= 2 and len(list_filter(string_split(x, ' '), lambda w: w <> '')) <= 3), lambda x: trim(regexp_replace(x, '[.!?;:()]', '', 'g'), ' ')), lambda x: x <> ''))"""


@query(
    SAID
    + f""", s as (select 'TXT-7' as task_id, model_id, lang, {PHRASES.format(c="pred")} as p, {PHRASES.format(c="gold")} as g from r union all select 'IMG-2', model_id, lang, {TAGS.format(c="pred")}, {PHRASES.format(c="gold")} from r),
c as (select task_id, model_id, lang, len(list_intersect(p, g)) as tp, len(p) as np, len(g) as ng from s where task_id = 'TXT-7' or len(g) > 0),
x as (select *, case when np > 0 then tp / np::double else 0 end as p, case when ng > 0 then tp / ng::double else 0 end as r from c),
m as (select task_id, model_id, lang, sum(tp)::double as tp, sum(np)::double as np, sum(ng)::double as ng, avg(p) as ap, avg(r) as ar, avg(case when p + r > 0 then 2 * p * r / (p + r) else 0 end) as af, count(*) as n from x group by grouping sets ((task_id, model_id), (task_id, model_id, lang)))
select model_id, task_id, lang, n::bigint as n, metric, round(case replace(metric, 'micro_', '') when 'precision' then coalesce(tp / nullif(np, 0), 0) when 'recall' then coalesce(tp / nullif(ng, 0), 0) when 'f1' then coalesce(2 * tp / nullif(np + ng, 0), 0) when 'macro_precision' then ap when 'macro_recall' then ar else af end, 9) as value
from m, (values ('precision'), ('recall'), ('f1'), ('micro_precision'), ('micro_recall'), ('micro_f1'), ('macro_precision'), ('macro_recall'), ('macro_f1')) t(metric)
where case when task_id = 'IMG-2' then lang is null and metric not in ('precision', 'recall', 'f1') when lang is null then not starts_with(metric, 'micro_') else metric in ('precision', 'recall', 'f1') end"""
)
def scored_sets(spark, sf_dir):
    return _metrics(scoring.set_scores(run_results(spark, sf_dir), scoring.LANGUAGES))


@query("with t as (select 'm' || (turn % 2) as model_id, count(*) as n from (" + TURNS + " select * from pairs) group by 1) select model_id, 'X-9' as task_id, n::bigint as n, 'no scorer for X-9' as error from t union all select model_id, 'TXT-6', n::bigint, n || ' of ' || n || ' samples without a reference' from t")
def scored_errors(spark, sf_dir):
    """Groups that cannot be scored: an unknown task, and labels without references."""
    r = run_results(spark, sf_dir).where("task_id in ('IMG-1', 'TXT-6')")
    r = r.withColumns({"task_id": F.when(F.col("task_id") == "IMG-1", "X-9").otherwise("TXT-6"), "ref_label": F.lit(None).cast("int")})
    return scoring.score_groups(r).where("metric = 'error'").select("model_id", "task_id", "n", "error")


# Tables of two cells, of which the second is always x.
CELLS_OF_RUN = (
    SAID
    + """, c as (select model_id, conv_id, turn, trim(regexp_replace(regexp_replace(b.pred, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) as pt, trim(regexp_replace(regexp_replace(r.gold, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) as gt from r join pairs b using (conv_id, turn)),
one as (select conv_id, turn, string_split(lower(pt), '') as p, string_split(lower(gt), '') as g from c where pt <> '' and gt <> ''), """
    + SUBSEQUENCE.format(keys="conv_id, turn", src="one")
    + """, h as (select model_id, 1 + (coalesce(round_even(200 * l::double / (length(pt) + length(gt))::double, 0), 0) >= 80)::int as hits, 1 + (pt <> '')::int as np, 1 + (gt <> '')::int as ng from c left join lcs using (conv_id, turn))
select model_id, 'TXT-3' as task_id, null::varchar as lang, count(*)::bigint as n, 'cell_f1' as metric, round(avg(2 * ((hits / np::double) * (hits / ng::double)) / ((hits / np::double) + (hits / ng::double))), 9) as value from h group by model_id"""
)


@query(" union all ".join(f"select model_id, task_id, lang, n, metric, value from ({q})" for q in (CELLS_OF_RUN, *[ORACLE[n] for n in ("scored_qa", "scored_summaries", "scored_labels", "scored_sets")])))
def scored_run(spark, sf_dir):
    """All scores of a run over all tasks in long form."""
    return _metrics(scoring.score_groups(run_results(spark, sf_dir)))


@query(
    JUDGE
    + """, r as (select 'g' || (conv_id % 3) as grp, case when turn % 2 = 0 then 'en' else 'ko' end as lang, score, conv_id % 3 = 2 as failed from s),
m as (select grp, lang, avg(coalesce(score, 3)) as m, count(*) as n, bool_or(failed) as failed from r group by grouping sets ((grp), (grp, lang)))
select grp, lang, n::bigint as n, round(case when not failed then m end, 9) as judge_mean, case when failed then 'status 500' end as error from m
union all select distinct grp, 'fr', 0::bigint, case when not failed then 3.0::double end, case when failed then 'status 500' end from r"""
)
def judge_by_language(spark, sf_dir):
    """Judge means by language; a language without rows has 3.0, and a failed call fails its group."""
    third = F.col("conv_id") % 3
    j = judge_texts(spark, sf_dir).withColumns({"grp": F.concat(F.lit("g"), third.cast("string")), "lang": F.when(F.col("turn") % 2 == 0, "en").otherwise("ko"), "judge_error": F.when((third == 2), "status 500")})
    return judge.judge_by_language(j, ["grp"], ["en", "ko", "fr"]).select("grp", "lang", "n", F.round("judge_mean", 9).alias("judge_mean"), "error")


@query(
    f"""with m as (select model_id, task_id, metric, value, list_position(['accuracy', 'f1', 'macro_f1', 'tn', 'fp', 'fn', 'tp', 'n_unparsed', 'class_0', 'sfw', 'class_1', 'nsfw'], metric) as place from ({ORACLE["scored_labels"]}) where lang is null),
r as (select *, row_number() over (partition by model_id, task_id order by place) as k from m)
select model_id || '::' || task_id || '::full' as key, string_agg(metric || '=' || printf('%.3f', value), ', ' order by k) as cell from r where k <= 4 group by all"""
)
def quant_of_run(spark, sf_dir):
    """The first four metrics of each cell of a run, of up to nine."""
    s = scoring.label_scores(run_results(spark, sf_dir), scoring.LANGUAGES).where("lang is null")
    return rank.quant_rows(s)


# What the judge says about the answers of run_results: texts of judge_texts by (conv_id, turn); every fourth conversation's calls fail, those of TXT-5 for m1 only.
JUDGED = "with " + TURNS[len("with ") :] + ", " + JUDGE[len("with ") :] + """, r as (select 'm' || (turn % 2) as model_id, conv_id, turn, conv_id * 100 + turn as sample_id, gold, case when conv_id % 2 = 0 then 'en' else 'ko' end as lang, case when conv_id % 9 = 0 then '' else trim(pred, ' \n') end as pred, score, conv_id % 4 = 0 as down
 from pairs join s using (conv_id, turn)),
st as (select model_id, sum(coalesce(case when not down then score end, 3))::double / count(*)::double as three, count(*) as n, sum(score) filter (not down and pred <> '')::double / nullif(count(score) filter (not down and pred <> ''), 0)::double as skip, count(score) filter (not down and pred <> '') as n_skip from r group by model_id),
five as (select model_id, lang, sum(coalesce(score, 3))::double / count(*)::double as v, count(*) as n, model_id = 'm1' and (select bool_or(down) from r d where d.model_id = 'm1') as broken from r group by grouping sets ((model_id), (model_id, lang))),
stage as (select model_id, task_id, null::varchar as lang, n, 'judge_mean' as metric, three as value, null::varchar as error from st, (values ('TXT-1'), ('TXT-2'), ('TXT-4')) t(task_id)
 union all select model_id, 'IMG-1', null, n_skip, 'judge_score_mean', coalesce(skip, 0), null from st
 union all select model_id, 'TXT-5', lang, n, case when broken then 'error' else 'judge_score_mean' end, case when not broken then v end, case when broken then 'judge: __ERROR__: status 500' end from five where not broken or lang is null) """


def judge_inputs(spark, sf_dir):
    """A run's answers with what they were asked, the judge's requests, and its answers to them."""
    r = run_results(spark, sf_dir).where(F.col("task_id").isin(*judge.STAGE)).withColumns({"question": F.concat(F.lit("q"), F.col("sample_id").cast("string")), "context": F.when(F.col("sample_id") % 2 == 0, F.col("lang")), "table": F.lit("| a |")})
    requests = judge.judge_requests(r, "judge", {"TXT-1": RUBRICS["X"], "TXT-2": RUBRICS["IMG-1"], "TXT-5": RUBRICS["TXT-5"]})
    said = judge_texts(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"), "judge_text", (F.col("conv_id") % 4 == 0).alias("down"))
    said = requests.select(*provider.KEYS).join(said, "sample_id")
    down = F.col("down") & ((F.col("task_id") != "TXT-5") | (F.col("model_id") == "m1"))
    responses = said.select(*provider.KEYS, F.when(~down, F.col("judge_text")).alias("text"), F.when(down, F.lit("status 500")).alias("error"))
    return r, requests, provider.replay(requests, responses)


RUBRIC_LINES = {"TXT-1": "", "TXT-2": "  3: fair", "TXT-4": "\n".join(f"  {k}: {v}" for k, v in judge.FALLBACK["TXT-4"]["anchors"].items()), "TXT-5": "", "IMG-1": "\n".join(f"  {k}: {v}" for k, v in judge.FALLBACK["IMG-1"]["anchors"].items())}
ABOUT = {"TXT-1": ("TXT-1", ""), "TXT-2": ("Captions", ""), "TXT-4": ("한국어 독해 QA", "주어진 지문에서 정확한 정답을 추출하는 능력 평가"), "TXT-5": ("TXT-5", "d"), "IMG-1": ("Image Captioning", "Evaluate image captions for accuracy, completeness, and clarity.")}
ASKED = ", about(task_id, name, description, anchors) as (values " + ", ".join(f"('{t}', '{ABOUT[t][0]}', '{ABOUT[t][1]}', '{RUBRIC_LINES[t]}')" for t in ABOUT) + ") "


@query(
    JUDGED
    + ASKED
    + """select model_id, task_id, sample_id, 'You are an expert evaluator for the following task:\n\n**Task:** ' || name || '\n**Description:** ' || description || '\n\n**Question/Context:**\n'
 || case task_id when 'TXT-1' then case when sample_id % 2 = 0 then 'Document text: ' || lang || '\n\n' else '' end || 'Question: q' || sample_id when 'TXT-2' then 'Table:\n| a |\n\nQuestion: q' || sample_id
   when 'TXT-4' then '지문: ' || case when sample_id % 2 = 0 then lang else '' end || '\n\n질문: q' || sample_id when 'TXT-5' then 'Summarize the following document (language: ' || lang || '):' else 'Describe this image in one sentence.' end
 || '\n\n**Reference (ground truth):**\n' || gold || '\n\n**Candidate output to evaluate:**\n' || pred || '\n\n**Scoring rubric (1–5):**\n' || anchors
 || '\n\nPlease evaluate the candidate output against the reference and provide a score from 1 to 5.\nInclude brief reasoning, then state your final score clearly (e.g., "Score: 4").\n' as prompt
from r, about where task_id <> 'IMG-1' or pred <> ''"""
)
def judge_stage_requests(spark, sf_dir):
    """What the judge is asked about a run: an entry of the rubric file, one that the file names otherwise, and fallbacks."""
    return judge_inputs(spark, sf_dir)[1].select("model_id", "task_id", "sample_id", "prompt")


@query(JUDGED + "select model_id, task_id, lang, n::bigint as n, metric, round(value, 9) as value, error from stage")
def judged_run(spark, sf_dir):
    """The judge stage of a run under each task's policy on answers without a score and calls that fail."""
    r, _, said = judge_inputs(spark, sf_dir)
    out = judge.stage_scores(r, said, scoring.LANGUAGES)
    return out.select("model_id", "task_id", "lang", "n", "metric", F.round("value", 9).alias("value"), "error")


@query(
    JUDGED
    + """, v as (select model_id, task_id, round_even(value, 4) as v from stage where lang is null and value is not null and task_id = 'IMG-1'
 union all select model_id, 'TXT-2', round_even(avg((pred <> '' and regexp_replace(lower(pred), '\\s+', ' ', 'g') = regexp_replace(lower(trim(gold, ' \n')), '\\s+', ' ', 'g'))::int), 4) from r group by model_id)
select task_id, model_id as winner, v as score_4 from (select *, row_number() over (partition by task_id order by v desc, model_id) as k from v) where k = 1"""
)
def judged_winners(spark, sf_dir):
    """Winners by the scores of a run and its judge together: captions have no other metric that can stand for them, table questions have their accuracy."""
    r, _, said = judge_inputs(spark, sf_dir)
    scores = scoring.score_groups(r.where("task_id in ('IMG-1', 'TXT-2')"), judged=judge.stage_scores(r, said, scoring.LANGUAGES))
    whole = scores.where("lang is null and task_id in ('IMG-1', 'TXT-2')").withColumn("ordinal", F.substring("model_id", 2, 9).cast("int"))
    return rank.winners(rank.representative(whole)).select("task_id", "winner", "score_4")


# ---- sample builders -----------------------------------------------------------------------------------------


@query("select doc_id, 'ko' as lang, text as context, source as question, array_to_string([lang, source], '|') as refs from documents")
def passage_samples(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("question"), F.col("text").alias("context"), F.array("lang", "source").alias("answers"))
    return tasks.samples_qa(d, "TXT-4").select(F.col("sample_id").alias("doc_id"), "lang", "context", "question", F.array_join("ref_text", "|").alias("refs"))


@query("select doc_id, 'TXT-6' as task_id, text, quality::int as label from documents join labels using (doc_id) where text <> '' and quality is not null union all select doc_id, 'TXT-8', case when doc_id % 2 = 0 then lang else text end, toxic::int from documents join labels using (doc_id) where text <> '' and toxic is not null")
def labelled_samples(spark, sf_dir):
    """The first column that is there and filled is the text; rows without a text or a label are left out."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").where("text <> ''").withColumn("sample_id", F.col("doc_id"))
    eight = d.withColumn("comment", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""))
    both = tasks.samples_labelled(d, "TXT-6", ["sentence", "text"], ["label", "quality"]).unionByName(tasks.samples_labelled(eight, "TXT-8", ["comment", "text"], ["toxic"]))
    return both.select(F.col("sample_id").alias("doc_id"), "task_id", "text", F.col("ref_label").alias("label"))


@query("select doc_id, trim(source || chr(10) || chr(10) || lang, ' ' || chr(10)) as document, array_to_string(list_sort(list_distinct(list_filter([lower(lang), lower(source), 'two words'], lambda x: x <> ''))), '|') as phrases from documents")
def keyphrase_samples(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("title"), F.col("lang").alias("abstract"), F.concat("lang", F.lit("; "), F.upper("source"), F.lit(";;  two   words ;"), "lang").alias("keywords"))
    return tasks.samples_keyphrase(d).select(F.col("sample_id").alias("doc_id"), "document", F.array_join(F.array_sort("ref_set"), "|").alias("phrases"))


@query("select page_id, url, array_to_string([url, 'a page'], '|') as refs from pages")
def caption_samples(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("sample_id"), "url", F.array("url", F.lit("a page")).alias("sentences"))
    return tasks.samples_caption(p).select(F.col("sample_id").alias("page_id"), "url", F.array_join("ref_text", "|").alias("refs"))


def pictures(spark, sf_dir):
    """Object ids by order: two or three of each, some beyond the known ones."""
    k = F.col("o_orderkey")
    ids = F.array((k % 90).cast("int"), ((k * 7) % 90).cast("int"), (k % 3).cast("int"))
    return read(spark, sf_dir, "orders").select(k.alias("sample_id"), F.struct(ids.alias("category")).alias("objects"))


PICTURES = "with o as (select o_orderkey as k, [(o_orderkey % 90)::int, ((o_orderkey * 7) % 90)::int, (o_orderkey % 3)::int] as ids from orders), names(id, name) as (values " + ", ".join(f"({i}, '{n}')" for i, n in tasks.CATEGORIES.items()) + ") "


@query(PICTURES + f"select k as o_orderkey, list_has_any(ids, {tasks.WEAPON_IDS})::int as weapon, list_contains(ids, 0)::int as person from o")
def object_labels(spark, sf_dir):
    p = pictures(spark, sf_dir)
    weapon = tasks.samples_objects(p, "IMG-3").select("sample_id", F.col("ref_label").alias("weapon"))
    return weapon.join(tasks.samples_objects(p, "IMG-5").select("sample_id", F.col("ref_label").alias("person")), "sample_id").withColumnRenamed("sample_id", "o_orderkey")


@query(PICTURES + "select k as o_orderkey, string_agg(distinct name, '|' order by name) as tags from (select k, unnest(ids) as id from o) join names using (id) group by k")
def object_tags(spark, sf_dir):
    s = tasks.samples_objects(pictures(spark, sf_dir), "IMG-2")
    return s.select(F.col("sample_id").alias("o_orderkey"), F.array_join(F.array_sort("ref_set"), "|").alias("tags"))


@query(PICTURES + "select k as o_orderkey from (select k, ids from o order by md5('42-' || k), k limit 150) where exists (select 1 from names where list_contains(ids, id) and name > 's') order by md5('42-' || k), k limit 40")
def first_after_filter(spark, sf_dir):
    """40 pictures in seeded order among the 150 read ahead that show something whose name comes after 's'."""
    keep = lambda p: p.where(F.exists(tasks.category_tags(F.col("objects.category")), lambda x: x > "s"))
    return sampling.filtered_sample(pictures(spark, sf_dir), "sample_id", 40, keep).select(F.col("sample_id").alias("o_orderkey"))


FEATURES = {"objects": {"feature": {"category": {"feature": {"names": [f"kind {i}" for i in range(80)]}}}}}


@query("with o as (select o_orderkey, [(o_orderkey % 90)::int, ((o_orderkey * 7) % 90)::int, (o_orderkey % 3)::int] as ids from orders) select o_orderkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(ids, lambda i: i < 80), lambda i: 'kind ' || i))), '|') as names from o")
def named_objects(spark, sf_dir):
    """Objects by the class names of a features description, whose ids start at 0."""
    names = F.array(*[F.lit(n) for n in config.label_names(FEATURES, "objects.category")])
    p = pictures(spark, sf_dir)
    return p.select(F.col("sample_id").alias("o_orderkey"), F.array_join(F.array_sort(tasks.category_tags(F.col("objects.category"), names)), "|").alias("names"))


@query("select n_regionkey as r_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) order by n_nationkey) as table_md, 'How many?' as question, count(*)::varchar as refs from nation group by n_regionkey")
def table_question_samples(spark, sf_dir):
    """Tables of even regions come rendered, those of odd ones as header and rows."""
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    rows = F.transform("x", lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"]))
    header = F.array(F.lit("key"), F.lit("name"))
    table = F.struct(header.alias("header"), rows.alias("rows"))
    ready = F.when(F.col("n_regionkey") % 2 == 0, tasks.table_markdown(header, rows)).otherwise("")
    t = n.select(F.col("n_regionkey").alias("sample_id"), table.alias("table"), ready.alias("table_md"), F.lit("How many?").alias("question"), F.array(F.size("x").cast("string")).alias("answers"))
    return tasks.samples_table_qa(t).select(F.col("sample_id").alias("r_regionkey"), F.col("table").alias("table_md"), "question", F.array_join("ref_text", "|").alias("refs"))


@query("select doc_id, 'user' as role, 'image_url,text' as kinds, 'data:image/png;base64,' || to_base64(encode(coalesce(text, ''))) as url, 'What is ' || coalesce(lang, '') || '?' as said from documents")
def chat_messages(spark, sf_dir):
    """Messages of a picture and a prompt; the texts stand for pictures."""
    d = read(spark, sf_dir, "documents")
    url = tasks.data_url(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "image/png")
    m = tasks.messages(tasks.fill("What is {lang}?", lang=F.col("lang")), url)[0]
    parts = m["content"]
    return d.select("doc_id", m["role"].alias("role"), F.array_join(parts["type"], ",").alias("kinds"), parts[0]["url"].alias("url"), parts[1]["text"].alias("said"))


# ---- configuration -------------------------------------------------------------------------------------------

RUBRICS = {"TXT-5": {"task": "Summaries", "description": "d", "scale": {1: "bad", 5: "good"}}, "IMG-1": {"name": "Captions", "anchors": {3: "fair"}}, "X": {}}


@query(JUDGE + "select task_id, name, description, anchor, text, count(score)::bigint as n from (values ('TXT-5', 'Summaries', 'd', 1::int, 'bad'), ('TXT-5', 'Summaries', 'd', 5, 'good'), ('IMG-1', 'Captions', '', 3, 'fair')) t(task_id, name, description, anchor, text) left join s on score = anchor group by all")
def rubrics(spark, sf_dir):
    """The anchors of the rubrics, with how many of the judge's scores stand at each."""
    s = judge_texts(spark, sf_dir).groupBy(parsers.judge_score(F.col("judge_text")).alias("anchor")).agg(F.count(F.lit(1)).alias("n"))
    return config.rubrics_table(spark, RUBRICS).join(s, "anchor", "left").withColumn("n", F.coalesce("n", F.lit(0)))


SOURCES = {"src0": {"commercial_ok": True}, "src1": {"sensitive": True, "commercial_ok": "unknown"}, "src2": {"commercial_ok": False}}


@query("select coalesce(commercial_ok, 'not registered') as commercial_ok, coalesce(sensitive, false) as sensitive, count(*)::bigint as n from documents left join (values ('src0', 'true', false), ('src1', 'unknown', true), ('src2', 'false', false)) t(source, commercial_ok, sensitive) using (source) group by 1, 2")
def registry(spark, sf_dir):
    """Documents by what the registry says of their source."""
    known = config.registry_table(spark, SOURCES).select(F.col("key").alias("source"), "commercial_ok", "sensitive")
    d = read(spark, sf_dir, "documents").join(known, "source", "left")
    return d.groupBy(F.coalesce("commercial_ok", F.lit("not registered")).alias("commercial_ok"), F.coalesce("sensitive", F.lit(False)).alias("sensitive")).agg(F.count(F.lit(1)).alias("n"))


@query("select lang as run_id, substring(strftime(timestamp '2024-01-01' + interval (length(lang)) day, '%Y-%m-%dT%H:%M:%S.000Z'), 1, 19) as created, case when lang = 'en' then '?' else 'a,b' end as models, '?' as modes, case when lang = 'en' then '?' else '2' end as n_tasks, count(*)::varchar as samples, '?' as git from documents where lang is not null group by lang")
def run_index(spark, sf_dir):
    """Rows of the index of runs, from manifests that lack some fields."""
    d = read(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).cast("int").alias("samples_per_task"))
    m = F.from_json(F.to_json(F.struct(F.lit("2024-01-03T00:00:00.000Z").alias("created_at"), F.when(F.col("lang") != "en", F.array(F.struct(F.lit("a").alias("id")), F.struct(F.lit("b").alias("id")))).alias("models"), F.when(F.col("lang") != "en", F.array(F.lit("t"), F.lit("u"))).alias("task_ids"), "samples_per_task")), artifact_source.MANIFEST)
    return artifact_source.index_rows(d.select(F.col("lang").alias("run_id"), m.alias("m")))


@query("select conv_id, case when conv_id % 2 = 0 then 'missing' else 'extra' end as side from (select distinct conv_id from conversations) where conv_id % 2 = 0 and conv_id % 3 <> 0 or conv_id % 2 = 1 and conv_id % 3 = 0")
def id_difference(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return scoring.id_difference(c.where("conv_id % 2 = 0"), c.where("conv_id % 3 = 0"), "conv_id")
