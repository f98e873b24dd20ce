"""URL filters with empirical-Bayes host reputation.

Explicit rules (host and path prefix; the longest wins) decide first. Elsewhere, labelled page outcomes are shrunk
through beta-binomial priors from host to registered domain to public suffix to the whole table: each level's prior
mean is its parent's posterior mean and its strength is estimated from the data by moments. A host is blocked when
the lower posterior bound of its share of bad pages is above `max_bad`.

All of it is DataFrame aggregation: outcomes are counted per host with partial aggregates (a host with a third of all
pages is one row after the map side), levels are counts over hosts, and pages meet their host's verdict in a join that
Spark may broadcast by measured size or split where it is skewed.

Defined cases: a null url or one without `://` has empty host and path; pages without an outcome still get their
host's posterior, hosts without one their parent's; a null id matches no outcome; of repeated outcomes of a page the
worst counts; without any outcome nothing is blocked beyond the rules; repeated rows are judged each; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written

#: (action, host, path prefix)
Rule = tuple[str, str, str]
#: Suffixes of two labels under which names are registered: a short default; unlisted ones pool their sites as one domain.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_name(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "(:[0-9]*)?\\.?$", "")


def suffix_pattern(suffixes: Sequence[str]) -> str:
    return "|".join([*(re.escape(s) for s in suffixes), "[^.]+"])


def suffix_of(name: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    return F.when(name.rlike("^[0-9.]+$"), name).otherwise(F.regexp_extract(name, f"(?:^|\\.)({suffix_pattern(suffixes)})$", 1))


def domain_of(name: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain; the name itself for addresses and bare suffixes."""
    found = F.regexp_extract(name, f"([^.]+\\.(?:{suffix_pattern(suffixes)}))$", 1)
    return F.when(name.rlike("^[0-9.]+$") | (found == ""), name).otherwise(found)


def site_levels(hosts: DataFrame, suffixes: Sequence[str] | DataFrame) -> DataFrame:
    """hosts with the registered domain and the suffix of every host.

    suffixes: those of more than one label, as a short list or as a table with the column `suffix` (of a public list, say),
    which the hosts' trailing labels join; the longest that fits counts, and the last label where none does.
    """
    name = site_name(F.col("host"))
    if not isinstance(suffixes, DataFrame):
        return hosts.withColumns({"domain": domain_of(name, suffixes), "suffix": suffix_of(name, suffixes)})
    known = suffixes.select(F.lower("suffix").alias("tail")).where("tail is not null").distinct()
    labels = F.split("name", "\\.")
    tails = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.slice("labels", k, F.size("labels")), "."))
    rows = hosts.select("host", name.alias("name")).where(~name.rlike("^[0-9.]+$")).withColumn("labels", labels)
    found = rows.select("host", F.explode(tails).alias("tail")).join(known, "tail").groupBy("host").agg(F.max_by("tail", F.length("tail")).alias("tail"))
    both = hosts.join(found, "host", "left").withColumn("name", name).withColumn("labels", labels)
    last = F.element_at("labels", -1)
    suffix = F.when(F.col("name").rlike("^[0-9.]+$"), F.col("name")).otherwise(F.coalesce("tail", last))
    own = F.size("labels") - F.size(F.split(suffix, "\\."))  # labels before the suffix
    domain = F.when(F.col("name").rlike("^[0-9.]+$") | (own < 1), F.col("name")).otherwise(F.concat_ws(".", F.element_at("labels", F.greatest(own, F.lit(1))), suffix))
    return both.withColumns({"suffix": suffix, "domain": domain}).drop("tail", "name", "labels")


def rule_fit(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule string, action) of the longest rule that fits, null without one."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def _strength(groups: DataFrame) -> float:
    """Prior strength of groups (n, k, p: the parent's mean) from the beta-binomial's second moment."""
    p = F.col("p")
    row = groups.agg(
        F.sum((F.col("k") - F.col("n") * p) ** 2 - F.col("n") * p * (1 - p)).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p)).alias("most"),
    ).first()
    rho = (row["over"] or 0.0) / row["most"] if row["most"] else 1e-4
    return round(1 / min(max(rho, 1e-4), 0.999) - 1, 6)


def _shrunk(groups: DataFrame, strength: float) -> Column:
    s = F.lit(strength)
    return (s * F.col("p") + F.col("k")) / (s + F.col("n"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: Sequence[str] | DataFrame = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n, k, bad, bad_low) for every host of pages (id, host): labelled and bad pages, posterior mean and lower bound.

    outcomes: (id, bad boolean).
    """
    worst = outcomes.where("id is not null and bad is not null").groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    hosts = pages.join(worst, "id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    # a row a host: every level and the verdicts come from it, pages and outcomes are read once
    hosts = written(site_levels(hosts, suffixes).select("host", "domain", "suffix", "n", "k"), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    p0 = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)
    count = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    level = count(hosts, "suffix").withColumn("p", F.lit(p0))
    level = level.select("suffix", _shrunk(level, _strength(level)).alias("p"))
    domains = count(hosts, "domain", "suffix").join(level, "suffix")
    level = domains.select("domain", "suffix", _shrunk(domains, _strength(domains)).alias("p"))
    hosts = hosts.join(level, ["domain", "suffix"])
    s = F.lit(_strength(hosts))
    a, b = s * F.col("p") + F.col("k"), s * (1 - F.col("p")) + F.col("n") - F.col("k")
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", "k", F.round(a / (a + b), 6).alias("bad"), F.round(a / (a + b) - F.lit(z) * sd, 6).alias("bad_low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], max_bad: float = 0.3, z: float = 1.645, id_col: str = "page_id", url_col: str = "url", suffixes: Sequence[str] | DataFrame = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_bad, host_bad_low) of every page; suffixes: see site_levels."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = host_reputation(rows.select("id", "host"), outcomes, z, suffixes)
    text, action = rule_fit(rules, F.col("host"), F.col("path"))
    method = F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")
    rows = rows.join(known, "host")
    return rows.select(F.col("id").alias("page_id"), "host", "path", text.alias("rule"), F.coalesce(action, method).alias("verdict"), F.col("bad").alias("host_bad"), F.col("bad_low").alias("host_bad_low"))
