"""URL filter: host and path rules first, then a list of canonical URLs.

A blocked Bloom filter of the listed URLs lets most pages pass without a join. Pages that may be listed go to an
exact hash join, which removes the false positives. The filter never exceeds ``max_blocks`` blocks of 32 bytes,
whatever the list's length; a longer list only sends more pages to the join.

Null urls and urls without ``://`` have an empty host, an empty path and no canonical URL: no rule fits them and
they are never listed. Every row of ``pages`` gives one row, repeated rows too; other columns are ignored.
"""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators.common import col
from .common import ascii_lower, stored

# Odd multipliers that choose one bit in each of a block's eight 32-bit words.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
BITS_PER_URL = 16
LOW_BITS = 0x7FFFFFFF  # products with a multiplier stay below 2^63


def host_and_path(url):
    """(host, path): the host follows the first ``://``, with A-Z in lower case; the path ends at ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def canonical_url(url):
    """Host without ``www.`` or ``m.``, path without closing slashes, and the query without tracking
    parameters (``utm_*``, ``ref``) and fragment; null where there is no host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, r"(^|&)(utm_[a-z]+|ref)=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    name = F.concat(
        F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"/+$", ""),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", name)


def rule_that_fits(host, path, rules):
    """(rule, verdict) of the longest rule for this host or a parent domain whose path starts the url's path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for outcome, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, outcome).otherwise(verdict)
    return rule, verdict


def mirror_urls(pages, url="url", payload="html", least_bytes=100):
    """Canonical URLs that serve a payload which another, smaller canonical URL serves, too."""
    seen = pages.select(canonical_url(col(url)).alias("canonical"), F.sha2(col(payload).cast("binary"), 256).alias("digest"),
                        F.octet_length(col(payload)).alias("size"))
    seen = seen.filter((F.col("size") >= least_bytes) & F.col("canonical").isNotNull()).select("canonical", "digest").distinct()
    first = seen.groupBy("digest").agg(F.min("canonical").alias("first"), F.max("canonical").alias("last"))
    return seen.join(first.filter("first < last"), "digest").filter("canonical > first").select("canonical").distinct()


def poor_urls(pages, url="url", payload="html", junk=10, paragraphs=2):
    """Canonical URLs that serve a payload with at least ``junk`` runs of three equal signs ``#``, ``*`` or ``%``, or with
    fewer than ``paragraphs`` paragraphs. A null payload is not judged."""
    runs = F.regexp_count(col(payload).cast("string"), F.lit(r"###|\*\*\*|%%%"))
    marks = F.regexp_count(col(payload).cast("string"), F.lit("<p>"))
    found = pages.filter((runs >= junk) | (marks < paragraphs)).select(canonical_url(col(url)).alias("canonical"))
    return found.filter("canonical is not null").distinct()


def listed_urls(pages, url="url", payload="html"):
    """The production list, made from the pages themselves: URLs of poor payloads and of copied payloads."""
    return poor_urls(pages, url, payload).unionByName(mirror_urls(pages, url, payload))


def _hashes(name):
    return F.xxhash64(name), F.xxhash64(name, F.lit("bit"))


def blocked_bloom(listed, max_blocks=1 << 18):
    """Eight 32-bit words per block as one array; Spark merges the bits, so the driver sees finished blocks only."""
    wanted = listed.count() * BITS_PER_URL // 256
    blocks = min(max_blocks, 1 << max(4, int(wanted).bit_length()))
    block, bits = _hashes(F.col("canonical"))
    low = bits.bitwiseAND(F.lit(LOW_BITS))
    marks = [
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright((low * salt).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int"))).alias(f"w{i}")
        for i, salt in enumerate(SALTS)]
    rows = listed.groupBy(block.bitwiseAND(F.lit(blocks - 1)).alias("block")).agg(*marks).toPandas()
    words = np.zeros((blocks, len(SALTS)), dtype=np.uint32)
    words[rows["block"].to_numpy(np.int64)] = rows[[f"w{i}" for i in range(len(SALTS))]].to_numpy(np.int64).astype(np.uint32)
    return words


def may_hold(words, block_hash, bit_hash):
    """Whether each key may be in the filter; no key that is in it is ever denied."""
    rows = words[block_hash & np.int64(len(words) - 1)]
    low = bit_hash.astype(np.uint64) & np.uint64(LOW_BITS)
    shifts = ((low[:, None] * np.array(SALTS, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
    return ((rows >> shifts.astype(np.uint32)) & np.uint32(1)).all(axis=1)


def filter_urls(pages, listed, rules, key="page_id", url="url", max_blocks=1 << 18):
    """(key, host, path, canonical, rule, verdict). ``listed`` is a table with a column ``canonical``; a page that no
    rule judges is blocked if its canonical URL is listed and allowed otherwise."""
    listed = stored(listed.select("canonical").filter("canonical is not null").distinct(), "listed-urls")
    shared = pages.sparkSession.sparkContext.broadcast(blocked_bloom(listed, max_blocks))

    @F.pandas_udf("boolean")
    def possible(block_hash: pd.Series, bit_hash: pd.Series) -> pd.Series:
        return pd.Series(may_hold(shared.value, block_hash.to_numpy(np.int64), bit_hash.to_numpy(np.int64)))

    host, path = host_and_path(col(url))
    rule, ruled = rule_that_fits(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select(col(key).alias(key), col(url).cast("string").alias("url_"))
        .select(key, host_and_path(F.col("url_"))[0].alias("host"), host_and_path(F.col("url_"))[1].alias("path"), canonical_url(F.col("url_")).alias("canonical"))
        .select("*", rule.alias("rule"), ruled.alias("ruled")))
    open_ = F.col("ruled").isNull() & F.col("canonical").isNotNull()
    maybe = judged.filter(open_).withColumn("possible", possible(*_hashes(F.col("canonical"))))
    hits = maybe.filter("possible").drop("possible").join(
        listed.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "canonical", "left")
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    passed = judged.filter(~open_).unionByName(maybe.filter("not possible").drop("possible"))
    columns = [key, "host", "path", "canonical", "rule"]
    return passed.select(*columns, F.coalesce("ruled", F.lit("allow")).alias("verdict")).unionByName(
        hits.select(*columns, verdict.alias("verdict")))
