"""URL filter: explicit rules, then a path-template tree judged by smoothed labelled purity.

DataFrame functions only. Rules come first: the longest rule whose host equals
the url's host or is a parent domain of it, and whose path starts the url's
path. For all other urls a template tree per host decides:

1. *Generalise.* A path becomes its segments, all of them. A segment that holds
   an id (digits, hex, very long) becomes ``*`` at once; level by level, the
   children of a node that are mostly seen once become ``*`` too, down to the
   level below which too few templates are left for a node to be variable.
2. *Merge.* Urls that a rule decides are the labelled examples. Level by level,
   branches whose block rate does not differ from that of the rest of their node
   (two-proportion z below ``Z``) become ``*`` and share their counts, down to the
   level below which there are no examples.
3. *Reject.* A template is blocked when its smoothed share of blocked examples
   reaches ``PURITY``. Each node of its path is smoothed by the one above, (blocked + PRIOR * share above) / (labelled + PRIOR), the
   host's root by the share of blocked among all urls, decided or not: a template with few examples, or none, is judged by its parent's and its host's,
   and a host that no rule knows is as good as the urls at large.

The tree is built on templates with counts, never on rows, and written level by level, so a host with a
third of all pages costs no more than its number of templates; the last join
is of two plain exchanges, which adaptive execution splits where one template has very many rows. Null or malformed urls have empty host and path
and are allowed; rows without an id and repeated rows get the same verdict as any other; an empty table gives
an empty result; extra columns are kept out by selecting by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, ascii_lower

#: A node with at least so many children of which this share of its urls are distinct is variable.
WIDE, SPREAD = 20, 0.5
Z = 1.96
PRIOR, PURITY = 4.0, 0.8
VARIABLE = r"^([0-9]+(\.[a-z0-9]+)?|.*[0-9]{4}.*|[0-9a-fA-F-]{8,}|.{25,})$"

#: (verdict, host, path) of the contract.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null. rules: a short fixed list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.when(x.rlike(VARIABLE), "*").otherwise(x))


def depths(tree: DataFrame) -> tuple[int, int]:
    """Levels at which a node can be variable, and levels at which branches have examples."""
    rows = tree.groupBy(F.size("segs").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum("labelled").alias("m")).collect()
    below = lambda i: sum(r["n"] for r in rows if r["d"] > i)
    longest = max([r["d"] for r in rows], default=0)
    return sum(below(i) >= WIDE for i in range(longest)), max([r["d"] for r in rows if r["m"]], default=0)


def generalised(tree: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """tree with t: its segments with those of variable nodes as ``*``."""
    tree = tree.withColumn("t", F.array().cast("array<string>"))
    for i in range(levels):
        seg = F.get("segs", F.lit(i))
        node = tree.where(F.size("segs") > i).groupBy("host", "t").agg(F.countDistinct(seg).alias("kids"), F.sum("n").alias("of"))
        node = node.where((F.col("kids") >= WIDE) & (F.col("kids") >= SPREAD * F.col("of"))).select("host", "t", F.lit(True).alias("wide"))
        longer = F.concat("t", F.array(F.when(F.col("wide"), F.lit("*")).otherwise(seg)))
        tree = scratch.keep(tree.join(node, ["host", "t"], "left").withColumn("t", F.when(F.size("segs") > i, longer).otherwise(F.col("t"))).drop("wide"))
    return tree.withColumn("t", F.concat("t", F.slice("segs", F.size("t") + 1, F.greatest(F.size("segs") - F.size("t"), F.lit(0)))))


def merged(tree: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """tree with branch: its segments with those of branches that examples don't set apart as ``*``."""
    tree = tree.withColumn("branch", F.array().cast("array<string>"))
    for i in range(levels):
        kid = F.get("t", F.lit(i))
        node = tree.groupBy("host", "branch").agg(F.sum("blocked").alias("hb"), F.sum("labelled").alias("hn"))
        rows = tree.where((F.size("t") > i) & (F.col("labelled") > 0)).groupBy("host", "branch", kid.alias("kid")).agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("m")).join(node, ["host", "branch"])
        b, m, rb, rm = F.col("b"), F.col("m"), F.col("hb") - F.col("b"), F.col("hn") - F.col("m")
        p = F.col("hb") / F.col("hn")
        z = F.abs(b / m - rb / rm) / F.sqrt(p * (1 - p) * (1 / m + 1 / rm))
        # with one outcome only, nothing sets the branch apart; without examples on either side, nothing tells that it is alike
        same = rows.where((rm > 0) & ((p == 0) | (p == 1) | (z < Z))).select("host", "branch", "kid", F.lit(True).alias("same"))
        step = tree.withColumn("kid", kid).join(same, ["host", "branch", "kid"], "left")
        longer = F.concat("branch", F.array(F.when(F.col("same"), F.lit("*")).otherwise(kid)))
        tree = scratch.keep(step.withColumn("branch", F.when(F.size("t") > i, longer).otherwise(F.col("branch"))).drop("kid", "same"))
    return tree.withColumn("branch", F.concat("branch", F.slice("t", F.size("branch") + 1, F.greatest(F.size("t") - F.size("branch"), F.lit(0)))))


def judged(tree: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """host, segs, template, reject: the verdict on each template. levels: those that have examples; nodes below are judged by their parents."""
    rate = tree.agg(F.coalesce(F.try_divide(F.sum("blocked"), F.sum("n")), F.lit(0.0)).alias("rate"))
    steps = F.explode(F.sequence(F.lit(0), F.least(F.size("branch"), F.lit(levels)))).alias("d")
    above = F.slice("branch", F.lit(1), F.col("d")).alias("above")
    node = tree.where("labelled > 0").select("host", "blocked", "labelled", "branch", steps).groupBy("host", above).agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("m"))
    # tables of their own, so that the join is of two plain exchanges and a host of very many templates can be split
    node = scratch.keep(node)
    path = scratch.keep(tree.select("host", "branch").distinct().select("host", "branch", steps).select("host", "branch", "d", above))
    path = path.join(node, ["host", "above"]).groupBy("host", "branch").agg(F.array_sort(F.collect_list(F.struct("d", "b", "m"))).alias("path"))
    share = F.aggregate(F.coalesce("path", F.array().cast(path.schema["path"].dataType)), F.col("rate"), lambda up, x: (x["b"] + PRIOR * up) / (x["m"] + PRIOR))
    total = tree.select("host", "branch").distinct().join(path, ["host", "branch"], "left").join(F.broadcast(rate)).select("host", "branch", (share >= PURITY).alias("reject"))
    return tree.join(total, ["host", "branch"]).select("host", "segs", F.array_join("branch", "/").alias("template"), "reject")


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every row."""
    scratch = Scratch(pages.sparkSession, "urls")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path")))
    counts = [F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("found.verdict") == "block", 1)).alias("blocked"), F.count("found.verdict").alias("labelled")]
    tree = scratch.keep(urls.groupBy("host", "segs").agg(*counts))
    wide, deep = depths(tree)
    known = scratch.keep(judged(merged(generalised(tree, wide, scratch), deep, scratch), deep, scratch))
    return urls.join(known, ["host", "segs"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("reject"), "block").otherwise("allow")).alias("verdict"),
        "template",
    )


def oracle(rules=RULES, levels: int = 8) -> str:
    """The same as DuckDB SQL, for tables whose nodes below so many levels are not variable and have no examples."""
    case = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then {{'rule': '{h}{p}', 'verdict': '{v}'}}"
        for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    )
    sql = f"""
with a as (select page_id,
  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') as host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
r as materialized (select page_id, host, path, case {case} else null end as found, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: case when regexp_matches(x, '{VARIABLE}') then '*' else x end) as segs from a),
g0 as (select host, segs, count(*) as n, (count(*) filter (found.verdict = 'block'))::double as blocked, count(found.verdict)::double as labelled, []::varchar[] as t from r group by host, segs)"""
    for i in range(levels):
        sql += f""",
k{i} as (select host, t, count(distinct segs[{i + 1}]) as kids, sum(n) as tot from g{i} where len(segs) > {i} group by host, t),
g{i + 1} as materialized (select host, segs, n, blocked, labelled, case when len(segs) <= {i} then t else list_append(t, case when kids >= {WIDE} and kids >= {SPREAD}::double * tot then '*' else segs[{i + 1}] end) end as t from g{i} left join k{i} using (host, t))"""
    sql += f""",
c0 as (select host, segs, list_concat(t, segs[{levels + 1}:]) as t, blocked, labelled, []::varchar[] as branch from g{levels})"""
    for i in range(levels):
        sql += f""",
h{i} as (select host, branch, sum(blocked) as hb, sum(labelled) as hn from c{i} group by host, branch),
m{i} as (select host, branch, t[{i + 1}] as kid, sum(blocked) as b, sum(labelled) as m from c{i} where len(t) > {i} and labelled > 0 group by all),
s{i} as (select host, branch, kid, true as same from m{i} join h{i} using (host, branch) where hn - m > 0 and (hb = 0 or hb = hn or
  abs(b / m - (hb - b) / (hn - m)) / sqrt(hb / hn * (1 - hb / hn) * (1 / m + 1 / (hn - m))) < {Z}::double)),
c{i + 1} as materialized (select x.host, segs, t, blocked, labelled, case when len(t) <= {i} then x.branch else list_append(x.branch, case when same then '*' else t[{i + 1}] end) end as branch
  from c{i} x left join s{i} y on x.host = y.host and x.branch = y.branch and t[{i + 1}] = y.kid)"""
    return sql + f""",
c as (select host, segs, blocked, labelled, list_concat(branch, t[{levels + 1}:]) as branch from c{levels}),
rate as (select coalesce((count(*) filter (found.verdict = 'block'))::double / nullif(count(*), 0)::double, 0)::double as rate from r),
e as (select host, branch[1:d] as above, sum(blocked) as b, sum(labelled) as m from c, range(0, {levels + 1}) t(d) where d <= len(branch) and labelled > 0 group by all),
q as (select host, branch, list({{'b': b, 'm': m}} order by d) as path from (select distinct host, branch, d, branch[1:d] as above from c, range(0, {levels + 1}) t(d) where d <= len(branch)) join e using (host, above) group by all),
v as (select host, segs, array_to_string(branch, '/') as template, coalesce(list_reduce(path, lambda up, x: (x.b + {PRIOR}::double * up) / (x.m + {PRIOR}::double), rate), rate) >= {PURITY}::double as reject from c left join q using (host, branch), rate)
select page_id, host, path, found.rule as rule, coalesce(found.verdict, case when reject then 'block' else 'allow' end) as verdict, template from r join v using (host, segs)"""
