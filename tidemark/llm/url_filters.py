"""URL verdicts: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The listed URLs are made canonical and hashed into a split-block Bloom filter: each URL falls into one
512-bit block of eight 64-bit words and sets one bit in each word. Pages look their block up and those
whose eight bits are all set go on to an exact hash join with the list, which removes the false
positives; all others skip that join. Everything is built of DataFrame functions.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule and no
listed URL, and is allowed. Repeated pages each get their row. An empty page table gives no rows and an
empty list blocks nothing. Other columns of the page table are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import blocks_for, with_possible
from .common import lower_ascii

#: Query parameters that never tell pages apart, as a pattern over `name=value`.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|\z)"


@dataclass(frozen=True)
class Rule:
    """`verdict` for a host with all its subdomains, where the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(rest(url), r"^([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without `www.` and default port, path without its end slashes and `.html`, and the sorted
    parameters other than tracking ones; scheme and fragment don't count. Empty without a host."""
    name = F.regexp_replace(F.regexp_replace(host(url), r":(80|443)\z", ""), r"^www\.", "")
    place = F.regexp_replace(F.regexp_replace(path(url), r"/+\z", ""), r"\.html\z", "")
    query = F.regexp_extract(rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(name == "", F.lit("")).otherwise(
        F.concat(name, place, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    )


def rule_of(host_: Column, path_: Column, rules: list[Rule], value: str) -> Column:
    """`value` (name or verdict) of the longest rule that fits, else null. The rules are a bounded list
    that becomes one expression."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, bits_per_key: int = 16) -> DataFrame:
    """(page_id, host, path, rule, verdict, possible_hit, listed) of every page.

    pages: (page_id, url). listed: (url), blocked wherever no rule fits. possible_hit tells that the
    Bloom filter let the URL pass, listed that the exact join confirmed it.
    """
    listed = listed.select(canonical(F.col("url")).alias("key")).where("key <> ''").distinct()
    blocks = blocks_for(listed.count(), bits_per_key)
    url = F.col("url")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), F.nullif(canonical(url), F.lit("")).alias("key"))
    probed = with_possible(rows, "key", listed, blocks).withColumnRenamed("possible", "possible_hit")
    sure = probed.where(~F.col("possible_hit")).withColumn("listed", F.lit(False))
    exact = listed.withColumn("listed", F.lit(True)).hint("shuffle_hash")
    hits = probed.where("possible_hit").join(exact, "key", "left")
    both = sure.select("page_id", "host", "path", "possible_hit", "listed").unionByName(
        hits.select("page_id", "host", "path", "possible_hit", F.coalesce("listed", F.lit(False)).alias("listed"))
    )
    h, p = F.col("host"), F.col("path")
    return both.select(
        "page_id",
        "host",
        "path",
        rule_of(h, p, rules, "name").alias("rule"),
        F.coalesce(rule_of(h, p, rules, "verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "possible_hit",
        "listed",
    )
