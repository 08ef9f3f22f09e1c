"""URL filter: rules first, then empirical-Bayes host reputation, in DataFrame functions only.

Levels.  A host without user info, port and final dot is its name.  Its suffix is the longest one known: the last label, a country's own second level
(``co.uk``, ``com.br``), or an entry of a table of suffixes under which strangers register; the registered domain is the suffix with one label more.  A
numeric address is its own domain, under the suffix ``ip``; a bare suffix is its own domain.

Labelled pages are Bernoulli outcomes (1 = bad).  Rates are shrunk from the top down: all pages, suffix, registered domain, host.
At each level a group's bad pages follow a beta-binomial whose mean is the posterior mean of its parent and whose
concentration ``m`` is estimated by moments over the labelled groups of that level.  A host's pages are blocked when the lower
posterior bound of its bad rate, ``mean - z * sd`` (the normal approximation of the beta quantile, which is loose for few labels), is above ``limit``; a host without labels keeps its parent's prior.

Scale.  Only pages with a document number meet the labels, counted by host and document before they do.  Outcomes are summed per host before any level is
joined, so a host with a third of all pages is one row from the first partial aggregate on.  Higher levels are made from lower ones.  Pages join the verdicts of hosts; Spark splits a hot host.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule, and is judged as the host
``""``; a path that has no whole number where documents stand has none; ids are of any type and meet as text; a very long url is read whole; null labels and pages without labels count nowhere; repeated rows come back once each; where a document has several
labels the worst counts; an empty table gives an empty result.  Other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: host, path, verdict
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for other urls."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


# Labels that registries of countries use as a second level, and suffixes under which strangers register names.
SECOND_LEVEL = "ac co com edu gob gov gouv go ltd me mil ne net nhs nom or org plc sch".split()
SHARED = (
    "appspot.com azurewebsites.net blogspot.com cloudfront.net firebaseapp.com fly.dev github.io gitlab.io glitch.me herokuapp.com medium.com myshopify.com neocities.org "
    "netlify.app onrender.com pages.dev substack.com tumblr.com vercel.app web.app weebly.com wixsite.com wordpress.com workers.dev"
).split()


def name_of(host: Column) -> Column:
    """The host's name without user info, port and final dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")


def suffix_of(name: Column, shared: Sequence[str] = SHARED) -> Column:
    """The longest suffix that is known."""
    one, two = F.substring_index(name, ".", -1), F.substring_index(name, ".", -2)
    own = F.when(two.rlike(rf"^({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$"), two).otherwise(one)
    for entry in sorted(shared, key=lambda e: (e.count("."), e)):
        own = F.when((name == entry) | name.endswith("." + entry), F.lit(entry)).otherwise(own)
    return F.when(name.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\["), F.lit("ip")).otherwise(own)


def domain_of(name: Column, suffix: Column) -> Column:
    """The suffix and the label before it."""
    labels = F.size(F.split(suffix, r"\.")) + 1
    last = F.slice(F.split(name, r"\."), -F.least(labels, F.size(F.split(name, r"\."))), labels)
    return F.when(suffix == "ip", name).otherwise(F.array_join(last, "."))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def concentration(groups: DataFrame) -> float:
    """``m`` of a level from rows ``n, k, mu``: the observed spread around the parents' means against the binomial one."""
    mu, n = F.col("mu"), F.col("n")
    spread = mu * (1 - mu)
    rho = F.try_divide(F.sum(n * (F.try_divide(F.col("k"), n) - mu) ** 2) - F.sum(spread), F.sum((n - 1) * spread))
    found = groups.filter("n > 0").agg(rho.alias("rho")).first()[0]
    found = min(max(0.0 if found is None else found, 1e-4), 0.999)
    return 1 / found - 1


def posteriors(outcomes: DataFrame) -> DataFrame:
    """``host, mean, sd`` from rows ``host, domain, suffix, n, k``, one a host."""
    hosts = written(outcomes, "outcomes")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    level = suffixes.withColumn("mu", F.lit(((k or 0) + 0.5) / ((n or 0) + 1)))
    for children, key in ((domains, "suffix"), (hosts, "domain")):
        m = concentration(level)
        means = level.select(key, ((F.col("mu") * m + F.col("k")) / (F.col("n") + m)).alias("mu"))
        level = written(children.join(means, key), "level")
    m = concentration(level)
    a, b = F.col("mu") * m + F.col("k"), (1 - F.col("mu")) * m + F.col("n") - F.col("k")
    return level.select("host", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))).alias("sd"))


def outcomes_of(named: DataFrame, labels: DataFrame, doc_id_in_path: str) -> DataFrame:
    """``host, n, k``: labelled pages of each host that has some, and the bad ones among them."""
    doc = F.nullif(F.regexp_replace(F.regexp_extract("path", doc_id_in_path, 1), "^0+(?=.)", ""), F.lit(""))
    pages = named.select("host", doc.alias("doc")).filter("doc is not null").groupBy("host", "doc").agg(F.count("*").alias("pages"))
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    outcomes = labels.groupBy(F.col("doc_id").cast("string").alias("label_doc")).agg(F.max(bad).cast("bigint").alias("bad")).filter("bad is not null")
    joined = pages.join(outcomes, F.col("doc") == F.col("label_doc"))
    return joined.groupBy("host").agg(F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("bad")).alias("k"))


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], z: float = 1.64, limit: float = 0.5, doc_id_in_path: str = r"^/[^/]+/([0-9]+)(?:/|$)", shared: Sequence[str] = SHARED
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id, url``).

    ``labels`` has ``doc_id, quality, toxic``; a page's document is the number that ``doc_id_in_path`` finds in its path.
    A page is bad when its document is of quality 0 or toxic.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = outcomes_of(named, labels, doc_id_in_path).withColumnRenamed("host", "seen")
    hosts = named.select("host").distinct().join(seen, F.col("host") == F.col("seen"), "left").withColumn("name", name_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("name"), shared))
    zero = F.lit(0).cast("bigint")
    by_host = hosts.select("host", domain_of(F.col("name"), F.col("suffix")).alias("domain"), "suffix", F.coalesce("n", zero).alias("n"), F.coalesce("k", zero).alias("k"))
    verdicts = posteriors(by_host).select(F.col("host").alias("known"), F.when(F.col("mean") - z * F.col("sd") > limit, "block").otherwise("allow").alias("judged"))
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    joined = named.join(verdicts, F.col("host") == F.col("known"), "left")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.col("judged")).alias("verdict"))
