"""URL rules found through their rarest literal token. DataFrame functions only.

A rule is a regular expression with the literal tokens (runs of a-z and 0-9) that every
URL it fits must hold as whole tokens. The corpus says how often each of those tokens
occurs; a rule is filed under its rarest one. A URL looks up its own tokens, and only
the rules filed there run. Up to ``LITERAL_RULES`` rules the index is a literal array of
buckets inside the plan: a lookup costs the same however many rules there are, no URL is
shuffled and no host can be skewed. More rules are a table, and the lookup is a join of
the URLs' tokens with the rules' rarest ones; both ways give the same rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, numbered, quoted, table, unused

BUCKETS = 1024
#: So many rules travel inside the plan; larger sets are joined.
LITERAL_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """name and verdict of a rule, its pattern over ``host`` + newline + ``path`` (see ``_subject``), and its literal tokens.

    Of several that fit, the one with the greatest weight decides, then the first by name.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int


def _tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text)


def host_path_rule(rule: str, verdict: str) -> Rule:
    """A rule ``host/path``: the host and its subdomains, paths that start with /path.

    The last token of the path counts as whole only if a separator follows it.
    """
    host, _, path = rule.partition("/")
    host, path = host.lower(), f"/{path}"
    whole = path if re.search(r"[^a-z0-9]$", path) else re.sub(r"[a-z0-9]+$", "", path)
    pattern = rf"^(?:[^\n]*\.)?{_quote(host)}\n{_quote(path)}"
    lower_only = _tokens(whole) if whole == whole.lower() else []
    return Rule(rule, verdict, pattern, tuple(dict.fromkeys(_tokens(host) + lower_only)), 1_000_000 + len(rule))


def path_pattern(name: str, verdict: str, regex: str, tokens: tuple[str, ...]) -> Rule:
    """A rule without a name in the result: a general pattern that says what the method thinks of a URL."""
    return Rule(name, verdict, regex, tokens, 0)


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_ -])", r"\\\1", text)


#: The list of the contract.
CONTRACT_RULES = (
    host_path_rule("com/en/", "block"),
    host_path_rule("example.com/en/7", "allow"),
    host_path_rule("net/de/", "allow"),
    host_path_rule("example.net/de/8", "block"),
    host_path_rule("org/es/", "block"),
)

#: What is blocked where no listed rule fits; everything else is allowed.
DEFAULT_PATTERNS = (
    path_pattern("adserver", "block", r"^(?:[^\n]*\.)?adserver\.", ("adserver",)),
    path_pattern("casino", "block", r"(?:^|[^a-z0-9])casino(?:[^a-z0-9]|$)", ("casino",)),
    path_pattern("porn", "block", r"(?:^|[^a-z0-9])porn(?:[^a-z0-9]|$)", ("porn",)),
    path_pattern("cgi-bin", "block", r"\n(?:[^\n]*/)?cgi-bin/", ("cgi", "bin")),
    path_pattern("login page", "block", r"/wp-login\.php$", ("wp", "login", "php")),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, whole, 1)), F.regexp_extract(url, whole, 2)


def _subject(host: Column, path: Column) -> Column:
    """What patterns run over: host, newline, path. A line feed within a host becomes U+0001, so that the first newline ends the host."""
    return F.concat_ws("\n", F.translate(host, "\n", "\u0001"), path)


def _url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_subject(host, path), F.lit("([a-z0-9]+)"), 1))


def token_counts(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URLs hold each literal token of the rules: as many rows as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    host, path = split_url(F.col("url"))
    held = F.array_intersect(_url_tokens(host, path), F.array(*map(F.lit, wanted)))
    found = urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in found}


def _index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[list[list[tuple]], list[tuple]]:
    buckets: list[list[tuple]] = [[] for _ in range(BUCKETS)]
    anywhere = []
    for r in rules:
        if not r.tokens:
            anywhere.append(("", r))
        else:
            rarest = min(r.tokens, key=lambda t: (counts[t], t))
            buckets[_bucket_of(rarest)].append((rarest, r))
    return buckets, anywhere


def _bucket_of(token: str) -> int:
    """The bucket that filter_urls computes with its columns."""
    return zlib.crc32(token.encode()) % BUCKETS


def _entry(token: str, rule: Rule) -> Column:
    return F.struct(
        F.lit(token).alias("token"), F.lit(rule.pattern).alias("pattern"), F.lit(rule.weight).alias("weight"),
        F.lit(rule.name if rule.weight else None).cast("string").alias("rule"), F.lit(rule.verdict).alias("verdict"),
    )


def filter_urls(urls: DataFrame, rules: tuple[Rule, ...], otherwise: str = "allow", counts: dict[str, int] | None = None) -> DataFrame:
    """urls with host, path, rule and verdict (columns of those names are replaced).

    The rule with the greatest weight decides; rule is null where only a pattern or none
    fitted. Null URLs and such without ``://`` have an empty host and path, fit no listed
    rule and get ``otherwise``. Rows keep their number; repeated rows get equal verdicts.
    """
    if len(rules) > LITERAL_RULES:
        return _filter_by_join(urls, rules, otherwise)
    counts = token_counts(urls, rules) if counts is None else counts
    buckets, anywhere = _index(rules, counts)
    entry_type = "array<struct<token:string,pattern:string,weight:int,rule:string,verdict:string>>"
    host, path = split_url(F.col("url"))
    out = urls.withColumns({"host": host, "path": path})
    used = [b for b in range(BUCKETS) if buckets[b]]
    # Empty buckets share entry 1, which holds nothing.
    place = {b: i + 2 for i, b in enumerate(used)}
    directory = F.array(*[F.lit(place.get(b, 1)) for b in range(BUCKETS)])
    lists = F.array(F.array().cast(entry_type), *[F.array(*[_entry(t, r) for t, r in buckets[b]]).cast(entry_type) for b in used])
    subject = _subject(F.col("host"), F.col("path"))

    def fetched(token: Column) -> Column:
        bucket = F.crc32(F.encode(token, "UTF-8")) % F.lit(BUCKETS) + F.lit(1)
        return F.filter(F.element_at(lists, F.element_at(directory, bucket.cast("int"))), lambda e: e["token"] == token)

    candidates = F.flatten(F.transform(_url_tokens(F.col("host"), F.col("path")), fetched))
    if anywhere:
        candidates = F.concat(candidates, F.array(*[_entry(t, r) for t, r in anywhere]).cast(entry_type))
    fitting = F.filter(candidates, lambda e: F.rlike(subject, e["pattern"]))
    ranked = F.transform(fitting, lambda e: F.struct((-e["weight"]).alias("less"), e["rule"].alias("rule"), e["verdict"].alias("verdict")))
    best = unused("best", urls.columns)
    out = out.withColumn(best, F.array_min(ranked))
    return out.withColumns({"rule": F.col(best)["rule"], "verdict": F.coalesce(F.col(best)["verdict"], F.lit(otherwise))}).drop(best)


def _filter_by_join(urls: DataFrame, rules: tuple[Rule, ...], otherwise: str) -> DataFrame:
    """filter_urls for any number of rules; urls are written once, with row numbers."""
    host, path = split_url(F.col("url"))
    rows, row = numbered(urls, "url-rows")
    rows = rows.withColumns({"host": host, "path": path})
    tokens = rows.select(F.col(row).alias("row"), _subject(F.col("host"), F.col("path")).alias("subject"), F.explode(_url_tokens(F.col("host"), F.col("path"))).alias("token"))
    listed = [(i, list(r.tokens), r.pattern, r.weight, r.name if r.weight else None, r.verdict) for i, r in enumerate(rules)]
    table_ = materialize(urls.sparkSession.createDataFrame(listed, "id long, tokens array<string>, pattern string, weight int, rule string, verdict string"), "url-rules")
    own = table_.select("id", F.explode("tokens").alias("token"))
    counts = tokens.join(own.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = own.join(counts, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    # Rules without a literal token have nothing to be found by: every URL runs them, and they travel in the plan.
    anywhere = F.array(*[_entry("", r) for r in rules if not r.tokens])
    everywhere = rows.select(F.col(row).alias("row"), _subject(F.col("host"), F.col("path")).alias("subject"), F.explode(anywhere).alias("e")).select("row", "subject", "e.pattern", "e.weight", "e.rule", "e.verdict") if any(not r.tokens for r in rules) else None
    found = tokens.join(table_.join(rarest, "id"), "token").select("row", "subject", "pattern", "weight", "rule", "verdict")
    found = found if everywhere is None else found.unionByName(everywhere)
    best = found.where(F.rlike(F.col("subject"), F.col("pattern"))).groupBy("row").agg(F.min(F.struct((-F.col("weight")).alias("less"), "rule", "verdict")).alias("best"))
    out = rows.join(best.withColumnsRenamed({"row": row, "best": unused("best", rows.columns)}), row, "left")
    chosen = F.col(unused("best", rows.columns))
    return out.withColumns({"rule": chosen["rule"], "verdict": F.coalesce(chosen["verdict"], F.lit(otherwise))}).select(*quoted([*[c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")], "host", "path", "rule", "verdict"]))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, CONTRACT_RULES + DEFAULT_PATTERNS).select("page_id", "host", "path", "rule", "verdict")


def _sql_pattern(pattern: str) -> str:
    return pattern.replace("'", "''")


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw_host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'),
  ('example.net/de/8', 'block'), ('org/es/', 'block')),
fit AS (
  SELECT p.*, (SELECT max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) FROM r
               WHERE (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
                 AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/')))) AS best
  FROM p)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN """ + " OR ".join(
    f"regexp_matches(host || chr(10) || path, '{_sql_pattern(r.pattern)}')" for r in DEFAULT_PATTERNS
) + """ THEN 'block' ELSE 'allow' END) AS verdict
FROM fit
"""
