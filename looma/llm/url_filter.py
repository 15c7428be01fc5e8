"""URL filter: rules first, else the reputation of the host by empirical Bayes.

Labelled page outcomes (bad or not) are counted for each host. The bad rate of a suffix is shrunk to that of all pages,
a registered domain's to its suffix's, a host's to its domain's, each by a beta-binomial prior whose strength comes from
the spread of the children's rates (method of moments). A host is blocked when the lower quantile of its posterior, a beta
distribution, reaches the bad rate of all labelled pages: it is worse than the whole with a probability of 1 - `Q`.
Everything is DataFrame expressions; counts are aggregated before they are joined and each level is written once; the join
of pages and hosts is an equi-join that adaptive execution splits where one host holds very many pages.

Registered domains are the label before the suffix; suffixes are the last label, or two for those of `SUFFIXES`. An IPv4
address is a domain of its own. Defined results: a null url or one without `://` has empty host and path, no rule, and counts
as host ''. Ports and user names stay in `host` and are ignored for domain and suffix. Without labelled pages nothing is
blocked. Repeated rows stay. An empty table gives an empty result. Other columns of the input are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: (verdict, host, path); the longest that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Least and largest strength (pseudo-pages) of a prior; quantile of the posterior; points at which the posterior is taken.
STRENGTH, Q, POINTS = (1.0, 1000.0), 0.1, 400
# Public suffixes of two labels.
SUFFIXES = tuple(
    "ac.in ac.jp ac.nz ac.uk ac.za co.id co.il co.in co.jp co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.co com.hk com.mx com.my com.ph com.sg com.tr com.tw com.ua com.vn "
    "edu.au edu.cn go.jp gov.au gov.br gov.cn gov.in gov.uk ltd.uk me.uk ne.jp net.au net.br net.cn net.in net.nz nhs.uk or.jp or.kr org.au org.br org.cn org.in org.nz org.uk org.za plc.uk".split()
)


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.regexp_extract(bare, r"[^.]+\.[^.]+$", 0)
    suffix = F.when(two.isin(*SUFFIXES), two).otherwise(F.regexp_extract(bare, r"[^.]*$", 0))
    domain = F.when(two.isin(*SUFFIXES), F.regexp_extract(bare, r"([^.]+\.)?[^.]+\.[^.]+$", 0)).otherwise(F.regexp_extract(bare, r"[^.]+\.[^.]+$|[^.]+$", 0))
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    return F.when(address, bare).otherwise(domain), F.when(address, "ip").otherwise(suffix)


def _strength(p: Column, tau: Column) -> Column:
    return F.greatest(F.least(p * (1 - p) / F.coalesce(tau, F.lit(1e-4)) - 1, F.lit(STRENGTH[1])), F.lit(STRENGTH[0]))


def _tau(parent_rate: Column) -> Column:
    """Variance of the children's true rates about the parent's: what the spread of their rates has beyond chance."""
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - parent_rate, 2)) / F.sum("n")
    rate = F.first(parent_rate)
    return F.greatest(spread - rate * (1 - rate) * F.count(F.lit(1)) / F.sum("n"), F.lit(1e-4))


def _posterior(child: DataFrame, p: Column, tau: Column) -> DataFrame:
    p = F.greatest(F.least(p, F.lit(0.999)), F.lit(0.001))
    strength = _strength(p, tau)
    return child.withColumn("strength", F.col("n") + strength).withColumn("rate", (F.col("bad") + strength * p) / (F.col("n") + strength))


def _shrunk(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """child (bad, n, its own key, key of the parent) with rate and strength of the posterior; parent: key, parent_rate."""
    both = child.join(parent, key)
    tau = both.where("n > 0").groupBy(key).agg(_tau(F.col("parent_rate")).alias("tau"))
    return _posterior(both.join(tau, key, "left"), F.col("parent_rate"), F.col("tau")).drop("parent_rate", "tau")


def reputation(outcomes: DataFrame) -> tuple[DataFrame, float]:
    """outcomes (host, bad: 1, 0 or null for pages without a label) -> (host, n, bad, rate, strength) and the rate of all."""
    domain, suffix = _levels(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"), F.count("bad").cast("double").alias("n")).withColumns({"domain": domain, "suffix": suffix})
    hosts = written(hosts, "hosts")
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    domains = written(total(hosts, "domain", "suffix"), "domains")
    suffixes = written(total(domains, "suffix"), "suffixes")
    bad, n = suffixes.agg(F.sum("bad"), F.sum("n")).first()
    world = ((bad or 0) + 1) / ((n or 0) + 2)
    tau = suffixes.where("n > 0").agg(_tau(F.lit(world)).alias("tau")).first()["tau"]
    suffixes = _posterior(suffixes, F.lit(world), F.lit(tau).cast("double")).select("suffix", F.col("rate").alias("parent_rate"))
    domains = written(_shrunk(domains, suffixes, "suffix").select("domain", F.col("rate").alias("parent_rate")), "rates")
    return _shrunk(hosts, domains, "domain").select("host", "n", "bad", "rate", "strength"), world


def _let(value: Column, f) -> Column:
    """f(value), where the value is computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def lower_bound(rate: Column, strength: Column, q: float = Q, points: int = POINTS) -> Column:
    """The q-quantile of the beta distribution with this mean and strength, to 1 / points: its density is summed over a grid."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: (i + 0.5) / points)
    log = F.transform(grid, lambda x: (rate * strength - 1) * F.log(x) + ((1 - rate) * strength - 1) * F.log(1 - x))
    weight = _let(log, lambda v: _let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below"))

    def count(w: Column, goal: Column) -> Column:
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["below"] + (s["sum"] + x < goal).cast("int")).alias("below"))
        return F.aggregate(w, start, step)["below"]

    return _let(weight, lambda w: _let(F.aggregate(w, F.lit(0.0), lambda s, x: s + x) * q, lambda goal: count(w, goal))) / F.lit(float(points))


def filter_urls(pages: DataFrame, rules=RULES, q: float = Q, limit: float | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bad_rate_low of every page; the labels are the rules' verdicts. limit: the
    lower bound from which a host is blocked, if not the rate of all labelled pages."""
    host, path = split_url(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "by_rule": verdict})
    rep, world = reputation(judged.select("host", (F.col("by_rule") == "block").cast("int").alias("bad")))
    rep = written(rep, "reputation")
    rep = rep.select("host", F.round("rate", 6).alias("bad_rate"), lower_bound(F.col("rate"), F.col("strength"), q).alias("bad_rate_low"))
    by_host = F.when(F.col("bad_rate_low") >= (world if limit is None else limit), "block").otherwise("allow")
    return judged.join(rep, "host").select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "bad_rate", "bad_rate_low")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def oracle() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, v)[i]}'" for v, h, p in by_length) + " END"
    listed = ", ".join(f"'{x}'" for x in SUFFIXES)

    def shrunk(name: str, child: str, parent: str, key: str) -> str:
        return f"""
{name}_tau AS (SELECT c.{key}, greatest(sum(n * pow(bad / n - parent_rate, 2)) / sum(n) - any_value(parent_rate) * (1 - any_value(parent_rate)) * count(*) / sum(n), 1e-4) AS tau
  FROM {child} c JOIN (SELECT {key}, parent_rate FROM {parent}) p ON c.{key} = p.{key} WHERE n > 0 GROUP BY c.{key}),
{name}_prior AS (SELECT c.*, greatest(least(parent_rate, 0.999), 0.001) AS p, coalesce(tau, 1e-4) AS tau
  FROM {child} c LEFT JOIN (SELECT {key}, parent_rate FROM {parent}) q ON c.{key} = q.{key} LEFT JOIN {name}_tau t ON c.{key} = t.{key}),
{name} AS (SELECT *, (bad + s * p) / (n + s) AS parent_rate, n + s AS strength FROM (SELECT *, greatest(least(p * (1 - p) / tau - 1, {STRENGTH[1]}), {STRENGTH[0]}) AS s FROM {name}_prior))"""

    return rf"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT *, {case(0)} AS rule, {case(1)} AS by_rule FROM parts),
counted AS (SELECT host, sum(CASE WHEN by_rule = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS bad, count(by_rule)::DOUBLE AS n,
  regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM judged GROUP BY host),
halved AS (SELECT *, regexp_extract(bare, '[^.]+\.[^.]+$', 0) AS two, regexp_matches(bare, '^[0-9]+(\.[0-9]+){{3}}$') AS address FROM counted),
hosts AS (SELECT host, bad, n,
  CASE WHEN address THEN bare WHEN two IN ({listed}) THEN regexp_extract(bare, '([^.]+\.)?[^.]+\.[^.]+$', 0) ELSE regexp_extract(bare, '[^.]+\.[^.]+$|[^.]+$', 0) END AS domain,
  CASE WHEN address THEN 'ip' WHEN two IN ({listed}) THEN two ELSE regexp_extract(bare, '[^.]*$', 0) END AS suffix FROM halved),
domains0 AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY ALL),
suffixes0 AS (SELECT suffix, 1 AS "all", sum(bad) AS bad, sum(n) AS n FROM domains0 GROUP BY suffix),
world AS (SELECT 1 AS "all", (sum(bad) + 1) / (sum(n) + 2) AS parent_rate FROM suffixes0),
{shrunk("suffixes", "suffixes0", "world", '"all"')},
{shrunk("domains", "domains0", "suffixes", "suffix")},
{shrunk("rep", "hosts", "domains", "domain")},
logs AS (SELECT host, parent_rate AS rate, list_transform(range({POINTS}), lambda i: (parent_rate * strength - 1) * ln((i + 0.5) / {POINTS}) + ((1 - parent_rate) * strength - 1) * ln(1 - (i + 0.5) / {POINTS})) AS v FROM rep),
cells AS (SELECT host, rate, unnest(range({POINTS})) AS i, unnest(list_transform(v, lambda x: exp(x - list_max(v)))) AS w FROM logs),
sums AS (SELECT host, rate, sum(w) OVER (PARTITION BY host ORDER BY i ROWS UNBOUNDED PRECEDING) AS below, sum(w) OVER (PARTITION BY host) AS whole FROM cells),
low AS (SELECT host, round(any_value(rate), 6) AS bad_rate, count(*) FILTER (below < whole * {Q}) / {float(POINTS)} AS bad_rate_low FROM sums GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN bad_rate_low >= (SELECT parent_rate FROM world) THEN 'block' ELSE 'allow' END) AS verdict, bad_rate, bad_rate_low
FROM judged j JOIN low l ON j.host = l.host"""
