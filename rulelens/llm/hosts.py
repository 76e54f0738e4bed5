"""URL filters: rules first, then the reputation of the host from labelled outcomes.

A host's share of bad pages is shrunk to its registered domain's, that to its suffix's, that to the overall share: each
level is a beta prior for the next, as strong as the shares of its children agree (method of moments). A host is blocked
if the lower bound of its posterior is above a threshold.
"""

from pyspark.sql import functions as F

from rulelens.plans.storage import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_BROADCAST_ROWS = 200_000
# Prior strengths stay between these many pages.
WEAKEST, STRONGEST = 1.0, 1000.0
# Blocked if the share of bad pages is above the threshold by so many standard deviations.
BOUND_SDS, THRESHOLD = 1.645, 0.5


def split_url(url):
    """`(host, path)`: both empty for a null or one without `://`."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + F.lit(3))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(rules, host, path):
    """The longest rule (action, `host/path`) that fits, or null: its host and all below it, paths that start with its."""
    arms = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        arms = F.when(fits, F.lit(rule)).otherwise(arms)
    return arms


def _action(rules):
    pairs = [x for action, rule in rules for x in (F.lit(rule), F.lit(action))]
    return F.create_map(*pairs)[F.col("rule")]


def _strength(groups, bad, n):
    """Strength of the beta prior that shares of `groups` have in common, as one row: from their spread beyond chance."""
    sums = groups.agg(F.sum(n).alias("n"), F.sum(bad).alias("bad"), F.count(F.when(n > 0, 1)).alias("groups"),
                      F.sum(bad * bad / F.when(n > 0, n)).alias("squares"))
    mean = F.col("bad") / F.nullif(F.col("n"), F.lit(0))
    noise = mean * (1 - mean)
    spread = (F.col("squares") - noise * F.col("groups")) / F.nullif(F.col("n"), F.lit(0)) - mean * mean
    bounded = F.least(F.greatest(noise / F.nullif(spread, F.lit(0.0)) - 1, F.lit(WEAKEST)), F.lit(STRONGEST))
    return sums.select(F.when(spread > 0, bounded).otherwise(STRONGEST).alias("strength"), F.coalesce(mean, F.lit(0.0)).alias("mean"))


def host_reputation(outcomes):
    """Posterior of every host: `(host, n, bad, alpha, beta, bound)`.

    `outcomes` has one row per page: host, and bad (boolean, null where the page has no label). Hosts without labels get
    their domain's prior. The registered domain is the last two labels of a host, the suffix the last.
    """
    labelled = F.count("bad").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad")
    hosts = outcomes.groupBy("host").agg(*labelled)
    hosts = hosts.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})
    hosts = materialize(hosts, "hosts")
    sums = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(*sums), "suffixes")
    # Three single rows of moments, read as numbers.
    (k_host, _), (k_domain, _), (k_suffix, mean) = (
        _strength(level, F.col("bad"), F.col("n")).first() for level in (hosts, domains, suffixes)
    )

    def shrunk(k, prior):
        return (F.col("bad") + k * prior) / (F.col("n") + k)

    suffixes = suffixes.select("suffix", shrunk(k_suffix, F.lit(mean)).alias("suffix_share"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(k_domain, F.col("suffix_share")).alias("domain_share"))
    rated = hosts.join(domains, "domain")
    rated = rated.withColumns({
        "alpha": F.col("bad") + k_host * F.col("domain_share"),
        "beta": F.col("n") - F.col("bad") + k_host * (1 - F.col("domain_share")),
    })
    total = F.col("alpha") + F.col("beta")
    share = F.col("alpha") / total
    bound = share - BOUND_SDS * F.sqrt(share * (1 - share) / (total + 1))
    return rated.select("host", "n", "bad", "alpha", "beta", bound.alias("bound"))


def url_filter(pages, labels, rules, id_col="page_id", url_col="url", key=None, threshold=THRESHOLD):
    """`(id, host, path, rule, verdict)` of every page.

    `rules` are (action, `host/path`) with action allow or block. `labels` has (key, bad); `key` is the expression over the
    url that names a page's label. Without a fitting rule a page is blocked if its host's bound is above the
    threshold, else allowed; so are pages without a host unless their common reputation is bad. A key labelled more than
    once is bad if any label says so. Rows map one to one, repeated ones and null ids included; other columns
    are not looked at.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = split_url(F.col("_url"))
    rows = rows.select("_id", host.alias("host"), path.alias("path"), key(F.col("_url")).alias("_key"))
    marks = labels.groupBy("key").agg(F.max("bad").alias("bad"))
    outcomes = rows.select("host", "_key").join(marks, F.col("_key") == F.col("key"), "left").select("host", "bad")
    blocked = host_reputation(outcomes).filter(F.col("bound") > threshold).select("host", F.lit(True).alias("_bad"))
    blocked = materialize(blocked, "blocked")
    if blocked.count() <= MAX_BROADCAST_ROWS:
        blocked = F.broadcast(blocked)
    judged = rows.join(blocked, "host", "left").withColumn("rule", matching_rule(rules, F.col("host"), F.col("path")))
    verdict = F.coalesce(_action(rules), F.when(F.col("_bad"), "block").otherwise("allow"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))


# ---- the same in DuckDB SQL ----


def _strength_sql(source):
    mean, noise = "sum(bad) / sum(n)", "(sum(bad) / sum(n)) * (1 - sum(bad) / sum(n))"
    spread = (f"(sum(bad * bad / CASE WHEN n > 0 THEN n END) - {noise} * count(CASE WHEN n > 0 THEN 1 END)) / sum(n) "
              f"- ({mean}) * ({mean})")  # fmt: skip
    return (f"(SELECT CASE WHEN {spread} > 0 THEN least(greatest({noise} / ({spread}) - 1, {WEAKEST}), {STRONGEST}) "
            f"ELSE {STRONGEST} END FROM {source})")  # fmt: skip


def url_filter_sql(pages, labels, rules, key):
    """CTEs ending in `judged`: page_id, host, path, rule, verdict. `labels` has (key, bad), `key` is SQL over url."""
    arms = "\n".join(
        f"    WHEN (host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) "
        f"AND starts_with(path, '/{rule.partition('/')[2]}') THEN '{rule}'"
        for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    )
    actions = " ".join(f"WHEN '{rule}' THEN '{action}'" for action, rule in rules)
    rest = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    return f"""cut AS (SELECT page_id, {rest} AS rest, {key} AS key FROM {pages}),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, key FROM cut),
ruled AS (SELECT *, CASE
{arms} END AS rule FROM parts),
marks AS (SELECT key, bool_or(bad) AS bad FROM {labels} GROUP BY key),
hosts AS (
  SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
         string_split(host, '.')[-1] AS suffix, CAST(count(bad) AS DOUBLE) AS n,
         CAST(count(CASE WHEN bad THEN 1 END) AS DOUBLE) AS bad
  FROM parts LEFT JOIN marks USING (key) GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
strengths AS (
  SELECT {_strength_sql('hosts')} AS k_host, {_strength_sql('domains')} AS k_domain,
         {_strength_sql('suffixes')} AS k_suffix, (SELECT sum(bad) / sum(n) FROM suffixes) AS mean),
rated AS (
  SELECT host, h.bad + k_host * d_share AS alpha, h.n - h.bad + k_host * (1 - d_share) AS beta
  FROM hosts h JOIN (
    SELECT domain, (d.bad + k_domain * s_share) / (d.n + k_domain) AS d_share FROM domains d JOIN (
      SELECT suffix, (s.bad + k_suffix * mean) / (s.n + k_suffix) AS s_share FROM suffixes s, strengths
    ) USING (suffix), strengths) USING (domain), strengths),
bounds AS (
  SELECT host, alpha / (alpha + beta) - {BOUND_SDS} * sqrt(
    alpha / (alpha + beta) * (1 - alpha / (alpha + beta)) / (alpha + beta + 1)) AS bound FROM rated),
judged AS (
  SELECT page_id, host, path, rule, CASE rule {actions} ELSE
    CASE WHEN bound > {THRESHOLD} THEN 'block' ELSE 'allow' END END AS verdict
  FROM ruled JOIN bounds USING (host))"""
