"""Registered domain and subdomain of a host, by public suffix rules.

Rules are a table ``suffixes(suffix, kind)`` with kind ``plain`` (``co.uk``),
``wildcard`` (``ck`` stands for ``*.ck``) or ``exception`` (``www.ck``). A host
without a known suffix, an IP address included, has registered domain ''.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions.text import let
from pagemill.functions.urls import clean_url, netloc

# Up to this many rules are turned into hash-set tests inside the expression;
# a larger table is joined instead. The public list has about 10,000 rules.
MAX_RULES_IN_PLAN = 50_000
IP_ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$"


@dataclass(frozen=True)
class SuffixRules:
    plain: tuple[str, ...]
    wildcard: tuple[str, ...]
    exception: tuple[str, ...]


def load_rules(suffixes: DataFrame) -> SuffixRules | None:
    """Bring the rules to the plan if they are few enough, else None."""
    rows = suffixes.select("suffix", "kind").distinct().limit(MAX_RULES_IN_PLAN + 1).collect()
    if len(rows) > MAX_RULES_IN_PLAN:
        return None
    of = lambda kind: tuple(sorted(r.suffix for r in rows if r.kind == kind))
    return SuffixRules(of("plain"), of("wildcard"), of("exception"))


def host_name(url: Column) -> Column:
    """Host without user part, port and closing dot, lower-cased."""
    host = F.regexp_replace(netloc(clean_url(url)), r"(?s)^.*@", "")
    host = F.regexp_replace(host, r":\d*$", "")
    return F.rtrim(F.lower(host), F.lit("."))


def _split_host(labels: Column, suffix_at: Column, is_ip: Column) -> Column:
    """struct(domain, subdomain) given the position where the suffix starts."""
    size = F.size(labels)
    join = lambda first, count: F.array_join(
        F.slice(labels, first, F.greatest(count, F.lit(0))), "."
    )
    registered = F.when(
        ~is_ip & (suffix_at > 0) & (suffix_at < size), join(suffix_at, size - suffix_at + 1)
    ).otherwise(F.lit(""))
    subdomain = F.when(is_ip | (suffix_at == 0), F.lit("")).otherwise(
        join(F.lit(1), suffix_at - 1)
    )
    return F.struct(registered.alias("domain"), subdomain.alias("subdomain"))


def domain_of_host(host: Column, rules: SuffixRules) -> Column:
    """struct(domain, subdomain); no join, for any number of hosts."""
    def among(name, some):
        return name.isin(*some) if some else F.lit(False)

    def located(labels):
        size = F.size(labels)
        tail = lambda i: F.array_join(F.slice(labels, i + 1, size), ".")

        def starts(i):
            here, below = tail(i), tail(i + 1)
            return (
                F.when(among(here, rules.exception), i + 1)
                .when(among(here, rules.plain) | among(below, rules.wildcard), i)
            )

        found = F.filter(
            F.transform(F.sequence(F.lit(0), size - 1), starts), lambda x: x.isNotNull()
        )
        return _split_host(
            labels, F.coalesce(F.get(found, F.lit(0)), size), host.rlike(IP_ADDRESS)
        )

    return let(F.split(host, r"\."), located)


def domains_by_join(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``hosts(host)`` -> ``(host, domain, subdomain)`` for a suffix table of any size."""
    labels = F.split("host", r"\.")
    tails = hosts.select("host").distinct().select(
        "host", labels.alias("labels"), F.posexplode(labels).alias("i", "label")
    )
    tail = lambda first: F.array_join(F.slice("labels", first, F.size("labels")), ".")
    tails = tails.select(
        "host", "i",
        F.explode(F.array(
            F.struct(F.lit("plain").alias("kind"), tail(F.col("i") + 1).alias("suffix")),
            F.struct(F.lit("wildcard").alias("kind"), tail(F.col("i") + 2).alias("suffix")),
            F.struct(F.lit("exception").alias("kind"), tail(F.col("i") + 1).alias("suffix")),
        )).alias("key"),
    ).select("host", "i", "key.*")
    best = (
        tails.join(suffixes.select("suffix", "kind").distinct(), ["suffix", "kind"])
        .groupBy("host")
        .agg(F.min(F.struct(
            "i", (F.col("kind") != "exception").alias("later")
        )).alias("best"))
    )
    labels = F.split("host", r"\.")
    starts = F.coalesce(
        F.when(F.col("best.later"), F.col("best.i")).otherwise(F.col("best.i") + 1),
        F.size(labels),
    )
    return (
        hosts.select("host").distinct().join(best, "host", "left")
        .select("host", _split_host(labels, starts, F.col("host").rlike(IP_ADDRESS)).alias("d"))
        .select("host", "d.*")
    )


def with_domains(df: DataFrame, url: str, suffixes: DataFrame) -> DataFrame:
    """Add ``domain`` and ``subdomain`` of a URL column."""
    rules = load_rules(suffixes)
    if rules is not None:
        return df.withColumn("d", domain_of_host(host_name(F.col(url)), rules)).select(
            *df.columns, "d.domain", "d.subdomain"
        )
    hosted = df.withColumn("host", host_name(F.col(url)))
    return hosted.join(domains_by_join(hosted, suffixes), "host").drop("host")
