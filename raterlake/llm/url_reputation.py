"""URL filter by empirical-Bayes host reputation, in SQL functions only.

Outcomes of labelled pages (1 good, 0 bad) are shrunk through beta-binomial priors: the
corpus rate is the prior of every suffix, the suffix posterior that of its registered
domains, the domain posterior that of its hosts. The strength of each level's prior is
estimated by moments from the spread of that level's own rates. A page is blocked where
even the upper bound of its host's posterior is more than `MARGIN` below the share of good
pages in the corpus, unless a rule speaks.

Outcomes are those of the texts that pages hold (`linked_outcomes`): a page is linked to the
labelled documents whose first `OPENING` words open one of its paragraphs; fewer words would
be shared by texts that have only a phrase in common. Ids say nothing: page_id and doc_id
number different things. Documents of one opening, such as copies, speak once, by their
majority, for good in a tie; of labels that repeat for an id, a good one counts.

Only counts per host are joined to pages, on the host; outcomes are summed per task
before they are shuffled. The suffix is the last label, or the last two where the last
has two letters and the one before is a common second level.

Defined results: a null url, or one without `://`, has an empty host and path and is
judged as one host of its own; a host nobody labelled has the prior that its registered
domain gives, which is that of the suffix where the domain has no label either, and the
corpus rate where the suffix has none; strengths are estimated from labelled rows alone;
pages without a label count nowhere; null labels are ignored; without any label everything
is allowed; repeated rows are judged alike; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: How far below the share of good pages in the corpus the upper bound of a blocked host is.
MARGIN = 0.05
#: Standard deviations between the posterior mean and its bound.
WIDTH = 1.645
#: Limits of a prior's strength, in pages.
STRENGTH = (2.0, 200.0)
#: Second levels under which names are registered.
SECOND_LEVELS = ["ac", "co", "com", "edu", "gov", "net", "org"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that link a page to a text.
OPENING = 12
SALTS = 16
_OPENING = rf"^[\x20\x09-\x0D]*+((?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{OPENING - 1}}}[^\x20\x09-\x0D]++)"
_PARAGRAPH = r"(?i)<(?:p|h[1-6]|article|div|br)(?:[ \t\r\n/][^>]*)?>"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


def opening(text: Column) -> Column:
    """The first words of a text joined by blanks; null where it has fewer."""
    first = F.regexp_extract(text, _OPENING, 1)
    return F.when(first != "", F.regexp_replace(first, common.BLANK_PATTERN, " "))


def linked_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id and good of the pages that hold the text of a labelled document. pages: page_id,
    html; docs: doc_id, text; labels: doc_id, quality. Pages without a known opening and
    documents of fewer than `OPENING` words are linked with nothing.

    An opening travels as its hash. Labelled openings are one row each, repeated for a few
    salts, so that an opening which many pages share is not one task's."""
    good = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    known = docs.select("doc_id", F.xxhash64(opening(F.col("text"))).alias("key"), opening(F.col("text")).isNotNull().alias("long")).filter("long").drop("long")
    known = known.join(good, "doc_id").groupBy("key").agg((F.avg("good") >= 0.5).cast("int").alias("good"))
    paragraphs = F.transform(F.split("html", _PARAGRAPH), lambda p: opening(F.regexp_replace(p, "<[^>]*>", " ")))
    held = pages.select("page_id", F.explode(F.array_distinct(F.transform(F.filter(paragraphs, lambda p: p.isNotNull()), lambda p: F.xxhash64(p)))).alias("key"))
    held = held.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return held.join(salted, ["key", "salt"]).groupBy("page_id").agg(F.max("good").alias("good"))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(h: Column, p: Column, rules: list[Rule] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((h == r.host) | h.endswith("." + r.host)) & p.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def levels(h: Column) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host; port and user name are left out."""
    bare = F.regexp_replace(F.regexp_replace(h, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    two = (n >= 3) & (F.char_length(F.get(labels, n - 1)) == 2) & F.get(labels, n - 2).isin(SECOND_LEVELS)
    tail = F.when(two, 2).otherwise(1)
    take = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return take(tail + 1), take(tail)


def _shrunk(level: DataFrame) -> DataFrame:
    """Posterior a and b of rows with good, n and the prior's mean m."""
    s = F.lit(strength(level))
    return level.withColumn("a", F.col("good") + s * F.col("m")).withColumn("b", F.col("n") - F.col("good") + s * (1 - F.col("m"))).drop("m")


def strength(level: DataFrame) -> float:
    """The prior strength that the spread of good/n around m speaks for."""
    v = F.col("m") * (1 - F.col("m"))
    excess = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("m"), 2))
    got = level.filter("n > 0").agg(excess.alias("excess"), F.sum(v).alias("noise"), F.sum(F.col("n") * v).alias("room")).first()
    if not got.room or got.room <= got.noise or got.excess <= got.noise:
        return STRENGTH[1]
    return min(STRENGTH[1], max(STRENGTH[0], (got.room - got.noise) / (got.excess - got.noise) - 1))


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, n, good, a and b of its posterior and the corpus rate, for every host of pages
    (n is 0 where nobody labelled it). outcomes: page_id, good (0 or 1)."""
    judged = outcomes.filter("good in (0, 1) and page_id is not null").groupBy("page_id").agg(F.max("good").alias("good"))
    named = pages.select("page_id", host(F.col("url")).alias("host"))
    counts = named.join(judged, "page_id").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("good"))
    hosts = named.select("host").distinct().join(counts, "host", "left").fillna(0.0, ["n", "good"])
    domain, suffix = levels(F.col("host"))
    hosts = common.checkpoint(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    rate = hosts.filter("n > 0").agg(F.sum("good") / F.sum("n")).first()[0]
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    suffixes = _shrunk(suffixes.withColumn("m", F.lit(1.0 if rate is None else rate)))
    domains = _shrunk(domains.join(suffixes.select("suffix", mean.alias("m")), "suffix"))
    hosts = _shrunk(hosts.join(domains.select("domain", mean.alias("m")), "domain"))
    return hosts.select("host", "n", "good", "a", "b", F.lit(rate).cast("double").alias("rate"))


def upper_bound(a: Column, b: Column) -> Column:
    n = a + b
    return a / n + WIDTH * F.sqrt(a * b / (n * n * (n + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the bound of each page's host."""
    named = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    named = named.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    known = reputation(pages, outcomes).select("host", upper_bound(F.col("a"), F.col("b")).alias("bound"), "rate")
    out = named.join(known, "host", "left")
    own = F.when(F.col("bound") < F.col("rate") - MARGIN, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "bound")
