"""URL filter: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

A URL's host stands after the first `://` up to `/`, `?`, `#` or the end, with A-Z
lower-cased; its path goes from there up to `?`, `#` or the end. Without `://` (or
null) both are empty. A rule `host/path` fits its host and all subdomains if the path
starts with the rule's path; the longest rule wins (a tie of lengths: the smaller by
code points). Without a rule the list decides: a URL is blocked if its canonical form is listed.

Method, all in Spark's own functions. Listed URLs are hashed to 64 bits: the high
part picks a block of eight 32-bit words, eight products of the low part set one bit in
each word. The filter is a table of blocks made by bit_or, which Spark combines
before the shuffle. It is sized from the counted list at about 16 bits an entry,
broadcast if within a bound and otherwise joined by block. URLs whose bits are all
set are possible hits; only those go on to the exact hash join with the list, which
removes false positives. No part is dropped for skew: the filter and the distinct
list have one row a key, so a frequent URL is only ever frequent on the probing side.

Defined cases: null URLs are allowed unless a rule fits the empty host (none does);
repeated rows each get their row; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, light, private, small

#: Blocks (of eight words) that may be broadcast: 100,000 rows of 40 bytes.
BLOCKS_BROADCAST = 100_000
# Odd multipliers that choose a bit in each of a block's words.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query: verdict and rule.
RULES = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: (-len(x[1]), x[1]), reverse=True):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def canonical(url: Column) -> Column:
    """Host without `www.` and port 80 or 443, path without a last slash, query without tracking parameters, no fragment; null without `://`."""
    host, path = host_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.regexp_replace(path, r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(h, 32), F.lit(blocks))


def _bits(h: Column) -> list[Column]:
    """One bit in each of eight words, as integers of one set bit."""
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))
    return [_bit(low, s) for s in SALTS]


def _bit(low: Column, salt: int) -> Column:
    place = ((low * F.lit(salt)) % F.lit(4294967291) % F.lit(32)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def bloom(listed: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The filter of listed(url): (block, w0..w7), and its number of blocks."""
    blocks = max(1, (rows * 16 + 255) // 256)
    h = F.xxhash64("url")
    words = [F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col("h")))]
    return listed.select(h.alias("h")).groupBy(_block(F.col("h"), blocks).alias("block")).agg(*words), blocks


def listed_urls(rows: DataFrame, listed: DataFrame, scratch: Scratch) -> DataFrame:
    """The distinct canonical URLs of rows(url) that are in listed(url)."""
    listed = scratch.save(listed.where("url is not null").distinct())
    n = listed.count()
    table, blocks = bloom(listed, n)
    table = scratch.save(table)
    probe = rows.where("url is not null").withColumn("h", F.xxhash64("url")).withColumn("at", _block(F.col("h"), blocks))
    hit = probe.join(small(table, blocks, BLOCKS_BROADCAST), F.col("at") == F.col("block"))
    for i, b in enumerate(_bits(F.col("h"))):
        hit = hit.where(F.col(f"w{i}").bitwiseAND(b) != 0)
    return hit.select("url").distinct().join(listed.hint("shuffle_hash"), "url", "left_semi")


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict and canonical, which replace columns of these names; all others pass through. listed(url) holds canonical URLs to block."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.withColumns({"host": host, "path": path, "canonical": canonical(F.col("url"))}).withColumns({"rule": rule, "verdict": verdict})
    open_ = rows.where("verdict is null").select(F.col("canonical").alias("url"))
    hits = scratch.save(listed_urls(open_, listed, scratch))
    hit = private(rows, "hit")[0]
    hits = light(hits.select(F.col("url").alias(hit)))
    out = rows.join(hits, (F.col("canonical") == F.col(hit)) & F.col("verdict").isNull(), "left")
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col(hit).isNotNull(), "block").otherwise("allow"))).drop(hit)


def tracked(pages: DataFrame) -> DataFrame:
    """The list of the registered query: canonical forms of the URLs that were crawled with a tracking parameter."""
    return pages.where(F.col("url").rlike(r"[?&]utm_[a-z]+=")).select(canonical(F.col("url")).alias("url"))
