"""URL filters: fixed host and path rules, then empirical-Bayes reputations of hosts.

A page with a label is good or bad. Bad pages of a host are taken as draws with a rate of its own,
hosts of a registered domain as draws from a beta law around the domain's rate, domains likewise
around their suffix, suffixes around the rate of all pages. Each level's estimate is

    (bad + strength * rate of the level above) / (pages + strength)

where the strength, one number per level, is fitted by moments: it makes the spread of the observed
rates around their parents what the beta law and the sample sizes imply. A host with few labels is
thus judged by its domain, and one without any by domain or suffix. A host's rate then has a beta
posterior; a page is blocked if the rate is above ``limit`` with a probability of at least
``confidence``, that is, if the posterior's lower bound at that confidence is above the limit. The
probability is exact, a series of positive terms for the incomplete beta integral.

DataFrame functions only. Pages are summed per host before anything else, in the tasks, so that a
host with a third of all pages is a row per task. The labels' join spreads by page.

Defined results
* null url or no ``://``: host and path empty, no rule. All such pages are one host without a name.
* no labels at all: every rate is the fixed prior, and only rules decide.
* an address, such as ``10.0.0.1`` or ``[::1]``, is a domain of its own; all addresses have one suffix.
  User names, ports and a closing dot are no part of domain and suffix.
* null labels say nothing; several labels of a page count each. A page without an id has no label.
* repeated pages are judged each; other columns are never looked at, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.frames import value_of
from marquee.session import stored


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host and a path, ``example.com/en/``."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


RULES = [
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
]


@dataclass(frozen=True)
class Options:
    """``prior``: bad and good pages that stand for the rate of all pages before any is seen.
    ``long_suffixes``: suffixes of two names, under which a registered domain has three; a table of
    suffixes takes their place where one is given."""

    confidence: float = 0.95
    limit: float = 0.5
    prior: tuple[float, float] = (1.0, 4.0)
    least_strength: float = 1.0
    most_strength: float = 1000.0
    rules: list[Rule] = field(default_factory=lambda: list(RULES))
    long_suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "ne.jp", "com.br", "co.nz", "co.in", "com.cn")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as ``pattern, verdict``; null if none does."""
    out = F.lit(None).cast("struct<pattern:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host), len(r.path))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


ADDRESS = "(address)"


def with_owner(frame: DataFrame, options: Options, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds the registered domain and the suffix of ``host`` to rows of different hosts.

    The suffix is the longest one of the table ``suffixes``, column ``suffix``, that the host has below
    a name of its own, or else its last name.
    """
    bare = F.regexp_replace("host", r"(?s)^.*@|:[0-9]*$|\.(:[0-9]*)?$", "")
    names = F.split(bare, r"\.")

    def last(n: Column | int) -> Column:
        return F.concat_ws(".", F.slice(names, -n, n))

    if suffixes is None:
        length = F.when((F.size(names) > 2) & last(2).isin(*options.long_suffixes), 2).otherwise(1)
    else:
        # A row per host and ending; the longest that is a suffix stays.
        endings = frame.select("host", F.explode(F.sequence(F.lit(1), F.greatest(F.size(names) - 1, F.lit(1)))).alias("length"))
        endings = endings.withColumn("suffix", last(F.col("length")))
        known = suffixes.select("suffix").where("suffix is not null").distinct()
        found = endings.join(known, "suffix", "left_semi").groupBy("host").agg(F.max("length").alias("_length"))
        frame = frame.join(found, "host", "left")
        length = F.coalesce("_length", F.lit(1))
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$") | bare.startswith("[")
    domain = F.when(address, bare).when(F.size(names) < 2, bare).otherwise(last(length + 1))
    suffix = F.when(address, ADDRESS).otherwise(last(length))
    return frame.withColumn("domain", domain).withColumn("suffix", suffix).drop("_length")


def log_gamma(x: Column) -> Column:
    """For positive numbers: Stirling's series eight further on, less the factors in between."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    factors = x
    for i in range(1, 8):
        factors = factors * (x + i)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(factors)


def share_above(rate: Column, weight: Column, limit: float) -> Column:
    """Probability that a beta law with that mean and weight (both parameters added) gives more than ``limit``.

    On the side where the limit lies below the mean the integral is a power of the limit times a
    series whose terms fall from the first on, as a bell of width sqrt(a) and then by (1 + x) / 2 or
    faster; the other side is its mirror image.
    """
    yes, no = weight * rate, weight * (1 - rate)
    below = limit < (yes + 1) / (weight + 2)
    a, b = F.when(below, yes).otherwise(no), F.when(below, no).otherwise(yes)
    x = F.when(below, F.lit(limit)).otherwise(F.lit(1 - limit))
    terms = F.ceil(9 * F.sqrt((a + 1) / (1 - x)) + 80 / (1 - x)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(done: Column, i: Column) -> Column:
        term = done["term"] * x * (a + b + i - 1) / (a + i)
        return F.struct(term.alias("term"), (done["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), terms), start, add, lambda done: done["total"])
    front = F.exp(log_gamma(a + b) - log_gamma(a + 1) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    tail = F.least(front * series, F.lit(1.0))
    return F.when(below, 1 - tail).otherwise(tail)


def _strength(rows: DataFrame, options: Options) -> Column:
    """Fitted by moments from ``bad, n, above`` rows: one value for a level.

    With p the parent's rate, a group's squared deviation (bad - n p)^2 is expected to be
    n p (1 - p) (1 + (n - 1) / (strength + 1)). Summed over groups this gives the strength.
    """
    rate = F.col("above")
    apart = F.sum(F.pow(F.col("bad") - F.col("n") * rate, 2) - F.col("n") * rate * (1 - rate))
    most = F.sum(F.col("n") * rate * (1 - rate) * (F.col("n") - 1))
    fitted = F.when(apart <= 0, options.most_strength).otherwise(most / apart - 1)
    bound = F.greatest(F.least(fitted, F.lit(options.most_strength)), F.lit(options.least_strength))
    return value_of(rows.agg(F.coalesce(bound, F.lit(options.most_strength)).alias("s")), "s")["s"]


def reputations(pages: DataFrame, labels: DataFrame, options: Options = Options(), suffixes: DataFrame | None = None) -> DataFrame:
    """``host, pages, bad, rate, weight, sure`` of every host of ``page_id, host`` rows.

    ``labels`` has ``page_id`` and ``bad``, 0 or 1. ``weight`` is what the posterior counts in pages, and
    ``sure`` the probability that the host's rate is above the limit.
    """
    outcome = labels.where("page_id is not null and bad is not null").groupBy("page_id")
    outcome = outcome.agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    seen = pages.join(outcome, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    hosts = stored(with_owner(hosts, options, suffixes), "hosts")
    domains = stored(hosts.groupBy("suffix", "domain").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), "suffixes")
    yes, no = options.prior
    overall = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + yes) / (F.coalesce(F.sum("n"), F.lit(0)) + yes + no)).alias("p"))

    def shrunk(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("strength", _strength(rows, options))
        return rows.withColumn("rate", (F.col("bad") + F.col("strength") * F.col("above")) / (F.col("n") + F.col("strength")))

    top = shrunk(suffixes.withColumn("above", value_of(overall, "p")["p"]))
    middle = shrunk(domains.join(top.select("suffix", F.col("rate").alias("above")), "suffix"))
    middle = stored(middle.select("suffix", "domain", F.col("rate").alias("above")), "domain-rates")
    low = shrunk(hosts.join(middle, ["suffix", "domain"]))
    low = stored(low.select("host", F.col("n").alias("pages"), "bad", "rate", (F.col("n") + F.col("strength")).alias("weight")), "rates")
    return low.withColumn("sure", share_above(F.col("rate"), F.col("weight"), options.limit))


def judge(pages: DataFrame, labels: DataFrame, options: Options = Options(), suffixes: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, rate, sure`` of every page."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = reputations(rows.select("page_id", "host"), labels, options, suffixes).select("host", "rate", "sure")
    rule = ruled(F.col("host"), F.col("path"), options.rules)
    own = F.when(F.col("sure") >= options.confidence, "block").otherwise("allow")
    return rows.join(known, "host").select(
        "page_id",
        "host",
        "path",
        rule["pattern"].alias("rule"),
        F.coalesce(rule["verdict"], own).alias("verdict"),
        F.round("rate", 6).alias("rate"),
        F.round("sure", 6).alias("sure"),
    )


def page_labels(labels: DataFrame) -> DataFrame:
    """Outcomes from a table of ``doc_id, quality, toxic``: bad where of no quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
