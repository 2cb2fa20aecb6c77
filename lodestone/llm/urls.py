"""URL filters: fixed rules by host and path, and association rules that FP-growth mines from what those decide.

The fixed rules are the labels. A URL becomes a set of tokens (scheme, labels and domain of its host, segments of its
path with digits as #, keys of its query); FP-growth finds the token combinations that are frequent among labelled
URLs together with a verdict. A combination whose verdict holds in enough of its URLs is a rule; one that a
part of it decides as surely is dropped. Rules are filed under their rarest token: a URL is compared only with
rules filed under its own tokens, and the surest one that it contains whole decides. Without any, it is allowed.

The mining is bounded: it learns from distinct labelled URLs, about LABELLED of them at most (chosen by their hash),
and of a URL's frequent tokens it takes the ITEMS that tell most about the verdict. Judging has no bounds: every
token of every URL counts. All of it is DataFrame code and Spark's own FPGrowth; nothing is collected but counts.

Defined results: a null URL or one without :// has an empty host and path, no tokens and no rule, and is allowed; only A-Z is
lower-cased; repeated rows are judged alike, each with a row of its own; a null page_id stays null; without labelled
URLs nothing is mined; an empty table gives an empty result; other columns are ignored. A very long URL costs one
row for each of its tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_BYTES, LOWER, UPPER, ascii_lower, fits, stage

# The rules that are given, as (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"

#: Distinct labelled URLs that are mined, about; tokens of one of them; the least share and number of URLs that a
#: combination needs, and the least share of them with its verdict.
LABELLED, ITEMS, SUPPORT, LEAST, CONFIDENCE = 2_000_000, 10, 0.002, 5, 0.9
HOST_PATH, QUERY, DOMAIN, SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)", r"(?s)^[^?#]*\?([^#]*)", r"([^.]*\.)?[^.]*\z", r"^([A-Za-z]+)://"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, HOST_PATH, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path together, and its verdict; null if none does."""
    fits = lambda h, p: ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    return F.coalesce(*[F.when(fits(h, p), h + p) for h, p, _ in longest]), F.coalesce(*[F.when(fits(h, p), verdict) for h, p, verdict in longest])


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL; none without a host and path."""
    kind = lambda letter, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(letter + ":"), x))
    found = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    segments = F.transform(F.split(ascii_lower(path), "/"), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    keys = F.transform(F.split(ascii_lower(found(QUERY)), "&"), lambda x: F.regexp_extract(x, "(?s)^([^=]*)", 1))
    every = F.concat(kind("s", F.array(ascii_lower(found(SCHEME)))), kind("h", F.split(host, r"\.")), kind("d", F.array(F.regexp_extract(host, DOMAIN, 0))), kind("p", segments), kind("q", keys))
    return F.when((host == "") & (path == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits(df, BROADCAST_BYTES) else df


def _items(labelled: DataFrame, least: int, n: int, blocked: int) -> DataFrame:
    """tokens of labelled URLs that are frequent: token, n_urls and weight, n² times how far the share of URLs that
    have the token and are blocked is from what chance would make of it."""
    big = lambda c: c.cast("decimal(19,0)")
    counts = labelled.select(F.explode("tokens").alias("token"), "verdict").groupBy("token").agg(F.count("*").alias("n_urls"), F.count_if(F.col("verdict") == "block").alias("n_block"))
    return counts.where(F.col("n_urls") >= least).select("token", "n_urls", F.abs(big(F.col("n_block")) * big(F.lit(n)) - big(F.lit(blocked)) * big(F.col("n_urls"))).alias("weight"))


def mine(urls: DataFrame) -> DataFrame:
    """Rules from labelled distinct urls (url, tokens, verdict): token (the one it is filed under), antecedent, verdict,
    confidence and n_urls (those that have the antecedent and the verdict)."""
    share = F.pmod(F.xxhash64("url"), F.lit(max(1, -(-urls.count() // LABELLED)))) == 0
    labelled = stage(urls.where(share), "urls-labelled")
    n, blocked = labelled.agg(F.count("*"), F.count_if(F.col("verdict") == "block")).first()
    if not n:
        return urls.sparkSession.createDataFrame([], "token string, antecedent array<string>, verdict string, confidence double, n_urls long")
    least = max(LEAST, -(-int(n * SUPPORT * 1000) // 1000))
    items = stage(_items(labelled, least, n, blocked), "urls-items")
    told = labelled.select("url", "verdict", F.explode("tokens").alias("token")).join(_small(items), "token")
    telling = F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "token"))), 1, ITEMS), lambda x: x["token"])
    baskets = told.groupBy("url").agg(telling.alias("items"), F.first("verdict").alias("verdict")).select(F.concat("items", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=CONFIDENCE).fit(baskets)
    sets = stage(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "urls-sets")
    verdict = F.get(F.filter("items", lambda x: F.startswith(x, F.lit("verdict:"))), 0)
    plain = sets.where(verdict.isNull()).select(F.col("items").alias("antecedent"), F.col("freq").alias("of"))
    both = sets.where(verdict.isNotNull() & (F.size("items") > 1)).select(F.filter("items", lambda x: ~F.startswith(x, F.lit("verdict:"))).alias("antecedent"), F.substring_index(verdict, ":", -1).alias("verdict"), F.col("freq").alias("n_urls"))
    sure = stage(both.join(plain, "antecedent").withColumn("confidence", F.col("n_urls") / F.col("of")).where(F.col("confidence") >= CONFIDENCE).drop("of"), "urls-sure")
    # a rule that is no surer than one of its own parts never decides
    parts = sure.where(F.size("antecedent") > 1).select(F.col("antecedent").alias("whole"), F.col("confidence").alias("whole_confidence"), F.explode("antecedent").alias("without"))
    parts = parts.select("whole", "whole_confidence", F.array_remove("whole", F.col("without")).alias("part"))
    surer = sure.select(F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    needless = parts.join(surer, "part").where("part_confidence >= whole_confidence").select(F.col("whole").alias("antecedent")).distinct()
    kept = sure.join(needless, "antecedent", "left_anti")
    filed = kept.select("*", F.explode("antecedent").alias("token")).join(_small(items.select("token", F.col("n_urls").alias("with_token"))), "token")
    return filed.groupBy("antecedent", "verdict", "confidence", "n_urls").agg(F.min_by("token", F.struct("with_token", "token")).alias("token")).select("token", "antecedent", "verdict", "confidence", "n_urls")


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, verdict and because (the antecedent, joined by spaces) of every one of urls (url, tokens) that has a rule."""
    asked = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(_small(rules), "token")
    whole = asked.where(F.forall("antecedent", lambda x: F.array_contains(F.col("tokens"), x)))
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("n_urls")).alias("n"), F.size("antecedent").alias("k"), "antecedent", "verdict"))
    return whole.groupBy("url").agg(best.alias("best")).select("url", F.col("best.verdict").alias("found"), F.array_join("best.antecedent", " ").alias("because"))


def filter_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and because (the tokens that decided, null where a given rule or none did)."""
    url = F.col("url")
    host, path = host_and_path(url)
    own = pages.select(F.col("page_id").cast("long"), url.cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = given_rule(F.col("host"), F.col("path"))
    own = own.withColumns({"rule": rule, "verdict": verdict})
    distinct = stage(own.groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("verdict").alias("verdict")).withColumn("tokens", url_tokens(url, F.col("host"), F.col("path"))).drop("host", "path"), "urls")
    rules = stage(mine(distinct.where("verdict IS NOT NULL")), "urls-rules")
    found = judged(distinct.where("verdict IS NULL").drop("verdict"), rules)
    return own.join(found, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "found", F.lit(DEFAULT)).alias("verdict"), "because")


# The same by brute force: every combination of a labelled URL's items is counted.
def _fits(host: str, path: str, value: str) -> str:
    return f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{value}'"


_LONGEST = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
_KIND = "list_transform(list_filter({1}, lambda x: x <> ''), lambda x: '{0}:' || x)"
_LOWER = "translate({0}, '" + UPPER + "', '" + LOWER + "')"
ORACLE_SQL = f"""
WITH a AS (SELECT page_id, url, {_LOWER.format(f"coalesce(regexp_extract(url, '{HOST_PATH}', 1), '')")} AS host, coalesce(regexp_extract(url, '{HOST_PATH}', 2), '') AS path FROM pages),
own AS (SELECT *, CASE {" ".join(_fits(h, p, h + p) for h, p, _ in _LONGEST)} END AS rule, CASE {" ".join(_fits(h, p, v) for h, p, v in _LONGEST)} END AS verdict FROM a),
u AS (SELECT DISTINCT url, host, path, verdict FROM own WHERE host <> '' OR path <> ''),
t AS (SELECT url, verdict, list_distinct(list_concat(
    {_KIND.format("s", f"[{_LOWER.format(f"regexp_extract(url, '{SCHEME}', 1)")}]")},
    {_KIND.format("h", "string_split(host, '.')")},
    {_KIND.format("d", f"[regexp_extract(host, '{DOMAIN}', 0)]")},
    {_KIND.format("p", f"list_transform(string_split({_LOWER.format('path')}, '/'), lambda x: regexp_replace(x, '[0-9]+', '#', 'g'))")},
    {_KIND.format("q", f"list_transform(string_split({_LOWER.format(f"coalesce(regexp_extract(url, '{QUERY}', 1), '')")}, '&'), lambda x: regexp_extract(x, '(?s)^([^=]*)', 1))")})) AS tokens FROM u),
size AS (SELECT count(*) AS n, count_if(verdict = 'block') AS blocked, greatest({LEAST}, CAST(ceil(count(*) * {SUPPORT}) AS BIGINT)) AS least FROM t WHERE verdict IS NOT NULL),
e AS (SELECT url, verdict, unnest(tokens) AS token FROM t WHERE verdict IS NOT NULL),
f AS (SELECT token, count(*) AS n_urls, count_if(verdict = 'block') AS n_block FROM e GROUP BY token),
w AS (SELECT token, n_urls, abs(n_block::HUGEINT * n - blocked::HUGEINT * n_urls) AS weight FROM f, size WHERE n_urls >= least),
r AS (SELECT url, verdict, token, row_number() OVER (PARTITION BY url ORDER BY weight DESC, token) AS place FROM e JOIN w USING (token)),
b AS (SELECT url, verdict, list(token ORDER BY token) AS items FROM r WHERE place <= {ITEMS} GROUP BY url, verdict),
m AS (SELECT verdict, items, unnest(range(1, CAST(2 ** len(items) AS BIGINT))) AS mask FROM b),
s AS (SELECT verdict, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS antecedent FROM m),
g AS (SELECT antecedent, count(*) AS of, count_if(verdict = 'allow') AS n_allow, count_if(verdict = 'block') AS n_block FROM s GROUP BY antecedent),
k AS (SELECT antecedent, 'allow' AS verdict, n_allow AS n_urls, n_allow / of AS confidence FROM g UNION ALL SELECT antecedent, 'block', n_block, n_block / of FROM g),
rules AS (SELECT k.* FROM k, size WHERE n_urls >= least AND confidence >= {CONFIDENCE}),
best AS (SELECT url, rules.verdict AS found, array_to_string(antecedent, ' ') AS because,
    row_number() OVER (PARTITION BY url ORDER BY confidence DESC, n_urls DESC, len(antecedent), antecedent) AS place
    FROM t JOIN rules ON list_has_all(t.tokens, rules.antecedent) WHERE t.verdict IS NULL)
SELECT page_id, host, path, rule, coalesce(verdict, found, '{DEFAULT}') AS verdict, because
FROM own LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (url)
"""
