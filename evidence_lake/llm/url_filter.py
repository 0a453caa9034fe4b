"""Verdicts on URLs from pattern rules of several kinds.

Each rule becomes a regular expression and a set of literal tokens, alphanumeric runs that any URL it matches
has as a whole; both are taken from the pattern.  Rules are indexed by their rarest literal among the URLs at
hand.  A URL's tokens fetch the rules that could match, and only those run their regular expressions.  Rules
without a literal are fetched by every URL.

Rules are a table, of any length; it is prepared by DataFrame functions like the URLs, and joined with them by tokens.
URLs are made distinct first, so that a page repeated any number of times is judged once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm.columns import UPPER, others

#: What a pattern stands for, by kind:
#:   site       example.com/en/   that host and its subdomains (from any label on), paths that start with /en/
#:   host_glob  *.ads.*           the whole host; * is any run of characters, ? any one
#:   path_glob  */login           the whole path; * may cross /
#:   query_key  utm_source        a parameter of the query
#:   word       casino            a whole alphanumeric token of host or path
#:   ip         (empty)           a host that is an IPv4 or a bracketed IPv6 address
#:   punycode   (empty)           a host with a label in punycode
#:   regex      \.exe$            searched in the whole URL as it is written
KINDS = ("site", "host_glob", "path_glob", "query_key", "word", "ip", "punycode", "regex")
_SCHEMA = "kind string, pattern string, verdict string, priority int"


@dataclass(frozen=True)
class Rule:
    """Of several rules that match a URL the highest ``priority`` wins, then the longest pattern, then the last in
    the alphabet; so an exception is a rule of higher priority."""

    kind: str
    pattern: str
    verdict: str
    priority: int = 0

    @property
    def name(self) -> str:
        """What the rule is listed as: its pattern, or its kind, if that is all there is."""
        return self.pattern or self.kind


def site_rule(verdict: str, pattern: str, priority: int = 1) -> Rule:
    return Rule("site", pattern, verdict, priority)


#: What the method itself blocks where no listed rule fits: words of unwanted sites, parameters that make copies of
#: a page, machine addresses, hosts of advertisements, pages to sign in or buy, and far pages of lists.
WORDS = ("casino", "gambling", "malware", "phishing", "poker", "porn", "torrent", "viagra", "warez", "xxx")
QUERY_KEYS = ("fbclid", "gclid", "jsessionid", "phpsessid", "replytocom", "sessionid", "utm_campaign", "utm_medium", "utm_source")
HOST_GLOBS = ("ads.*", "*.ads.*", "tracking.*")
PATH_GLOBS = ("/cgi-bin/*", "/wp-admin/*", "*/login", "*/checkout")
DEFAULT_RULES = (
    *[Rule("word", x, "block") for x in WORDS],
    *[Rule("query_key", x, "block") for x in QUERY_KEYS],
    Rule("ip", "", "block"),
    *[Rule("host_glob", x, "block") for x in HOST_GLOBS],
    *[Rule("path_glob", x, "block") for x in PATH_GLOBS],
    Rule("regex", r"[?&]page=[0-9]{3,}", "block"),
)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z in lower case), path and query (with its ?); all empty for NULL and for URLs without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, UPPER.lower()), part(2), part(3)


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """A list of rules as a table (kind, pattern, verdict, priority)."""
    unknown = {r.kind for r in rules} - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds of rules: {sorted(unknown)}")
    written = json.dumps([asdict(r) for r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(written), f"array<struct<{_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")))


def _compiled(rules: DataFrame) -> DataFrame:
    """(rule_no, rule, rule_verdict, priority, whole, regex, literals): ``whole`` rules search the URL as written."""
    pattern, kind = F.col("pattern"), F.col("kind")
    quoted = F.regexp_replace(pattern, "([^A-Za-z0-9])", r"\\$1")

    def glob(any_run: str, any_one: str) -> Column:
        escaped = F.regexp_replace(pattern, "([^A-Za-z0-9*?])", r"\\$1")
        return F.replace(F.replace(escaped, F.lit("?"), F.lit(any_one)), F.lit("*"), F.lit(any_run))

    def tokens(expression: str) -> Column:
        return F.regexp_extract_all(pattern, F.lit(expression), F.lit(1))

    host_end = F.lit("(?=[/?]|$)")
    regex = (
        F.when(kind == "site", F.concat(F.lit(r"^(?:[^/?]*\.)?"), quoted))
        .when(kind == "host_glob", F.concat(F.lit("^"), glob("[^/?]*", "[^/?]"), host_end))
        .when(kind == "path_glob", F.concat(F.lit("^[^/?]*"), glob(r"[^?]*", "[^?]"), F.lit(r"(?=\?|$)")))
        .when(kind == "query_key", F.concat(F.lit("[?&]"), quoted, F.lit("(?=[=&]|$)")))
        .when(kind == "word", F.concat(F.lit("^(?:[^?]*[^A-Za-z0-9?])?"), quoted, F.lit("(?![A-Za-z0-9])")))
        .when(kind == "ip", F.concat(F.lit(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]*)?|\[[0-9a-f:.]*\](?::[0-9]*)?)"), host_end))
        .when(kind == "punycode", F.lit(r"^(?:[^/?]*\.)?xn--"))
        .when(kind == "regex", pattern)
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind of rule: "), kind)))
    )
    none = F.array().cast("array<string>")
    # a run next to a wildcard may go on in the URL; so may the last of a site, and whatever a regex leaves open
    literals = (
        F.when(kind == "site", tokens("([A-Za-z0-9]+)(?=[^A-Za-z0-9])"))
        .when(kind.isin("host_glob", "path_glob"), tokens("(?<![A-Za-z0-9*?])([A-Za-z0-9]+)(?![A-Za-z0-9*?])"))
        .when(kind.isin("query_key", "word"), tokens("([A-Za-z0-9]+)"))
        .when(kind == "punycode", F.array(F.lit("xn")))
        # between separators that are not optional, in expressions without alternatives, groups or classes
        .when((kind == "regex") & ~pattern.rlike(r"[|()\[]|\\[^./?&=_-]"), tokens(r"(?<=[/&=_-]|\\[.?])([A-Za-z0-9]+)(?=(?:[/&=_-]|\\[.?])(?![*?+{]))"))
        .otherwise(none)
    )
    whole = rules.where(F.col("kind").isNotNull() & F.col("pattern").isNotNull() & F.col("verdict").isNotNull())
    numbered = whole.select(
        F.xxhash64("kind", "pattern", "verdict", "priority").alias("rule_no"),
        F.when(pattern == "", kind).otherwise(pattern).alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.coalesce("priority", F.lit(0)).alias("priority"),
        (kind == "regex").alias("whole"),
        F.concat(F.lit("(?s)"), regex).alias("regex"),
        F.array_distinct(literals).alias("literals"),
    )
    return numbered.dropDuplicates(["rule_no"])


def judge_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; rule is NULL where none matched.

    ``rules`` is a list, or a table with kind, pattern, verdict and priority (NULL: 0); rows without kind, pattern or
    verdict do not count, an unknown kind fails the query, and repeated rules count once.

    NULL URLs and such without ``://`` have empty host and path; only rules of kind regex can match them.
    Repeated pages each get a row.  Columns of ``pages`` with those four names (in any letter case) are replaced.
    No rules or no pages: every verdict is ``otherwise``, or no rows.
    """
    spark = pages.sparkSession
    compiled = _compiled(rules if isinstance(rules, DataFrame) else rule_table(spark, rules))
    written = F.coalesce(F.col(url).cast("string"), F.lit(""))
    given = pages.select(F.struct(*others(pages, ("host", "path", "rule", "verdict"))).alias("row"), written.alias("url"))
    host, path, query = url_parts(F.col("url"))
    texts = given.select("url").distinct().select("url", F.concat(host, path, query).alias("text"))

    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.split("url", "[^A-Za-z0-9]+"), F.split("text", "[^A-Za-z0-9]+")))
    fetched = texts.select("url", "text", F.explode(tokens).alias("token"))
    literals = compiled.select("rule_no", F.explode(F.expr("if(size(literals) = 0, array(''), literals)")).alias("token"))
    counts = fetched.join(literals.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")
    index = literals.join(counts, "token", "left").groupBy("rule_no").agg(rarest).join(compiled.drop("literals"), "rule_no")
    matches = F.when(F.col("whole"), F.rlike("url", F.col("regex"))).otherwise(F.rlike("text", F.col("regex")))
    order = F.struct("priority", F.length("rule"), "rule", "rule_verdict")
    best = (
        fetched.join(index, "token")
        .where(matches)
        .groupBy("url")
        .agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("best"))
        .withColumnRenamed("url", "judged")
    )
    found = given.join(best, F.col("url") == F.col("judged"), "left")
    return found.select(
        "row.*",
        host.alias("host"),
        path.alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(otherwise)).alias("verdict"),
    )
