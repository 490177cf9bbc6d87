"""URL filters: a blocked Bloom filter before an exact join, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumloom.llm.common import stage
from forumloom.operators.skew import join_lookup

LEAST_BLOCKS, MOST_BLOCKS = 1 << 10, 1 << 20
"""Words of the Bloom filter, 64 bits each: one for ``PER_BLOCK`` listed URLs, but never so many that the broadcast
table passes 16 MB. Longer lists let more URLs through to the exact join."""

PER_BLOCK = 4

BITS = 4


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One spelling of a page: host and path, without scheme, query, fragment and slashes at the end."""
    return F.concat(host, F.regexp_replace(path, "/+$", ""))


def _mask(key: Column) -> Column:
    """``BITS`` bits of a 64-bit word, chosen by a hash of the key."""
    h = F.xxhash64(key, F.lit("bits"))
    bits = []
    for i in range(BITS):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bits.append(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``(block, word)``: the blocked Bloom filter of the non-null keys, at most ``blocks`` rows."""
    return (
        keys.where(F.col(key).isNotNull())
        .groupBy(F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).alias("block"))
        .agg(F.bit_or(_mask(F.col(key))).alias("word"))
    )


def may_contain(df: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """``df`` with ``_maybe``: false only for keys that are certainly not in the filter.

    The filter is broadcast: its rows are at most ``blocks``, 16 bytes each.
    """
    probe = df.withColumn("_block", F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)))
    small = F.broadcast(bloom.select(F.col("block").alias("_block"), F.col("word").alias("_word")))
    mask = _mask(F.col(key))
    return (
        probe.join(small, "_block", "left")
        .withColumn("_maybe", F.coalesce(F.col("_word").bitwiseAND(mask) == mask, F.lit(False)))
        .drop("_block", "_word")
    )


def listed(df: DataFrame, key: str, urls: DataFrame, blocks: int | None = None) -> DataFrame:
    """``df`` with ``_listed``: whether the key is in ``urls`` (column ``url``).

    Keys that the filter rules out never reach the join; the distinct possible hits are joined exactly
    with the list, and hits return to their rows over a join that spreads keys with very many rows.
    """
    wanted = stage(urls.where(F.col("url").isNotNull()).select(F.col("url").alias(key)).distinct())
    blocks = blocks or min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << (-(-wanted.count() // PER_BLOCK)).bit_length()))
    probed = may_contain(df, key, bloom_filter(wanted, key, blocks), blocks)
    possible = probed.where("_maybe")
    hits = possible.select(key).distinct().join(wanted, key).withColumn("_listed", F.lit(True))
    exact = join_lookup(possible, stage(hits), [key], "left")
    rest = probed.where("NOT _maybe").withColumn("_listed", F.lit(False))
    return exact.withColumn("_listed", F.coalesce("_listed", F.lit(False))).unionByName(rest).drop("_maybe")


def _rule_fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], block_list: DataFrame, url: str = "url", blocks: int | None = None
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (text of the longest fitting rule, else null) and ``verdict``.

    ``rules`` are (verdict, host, path) written by hand, a short list that becomes one expression: a rule
    fits its host and all subdomains if the path starts with the rule's; the longest host and path wins, the
    first of equally long ones. Pages without a rule are blocked if their canonical URL is in
    ``block_list`` (column ``url``), which may be of any size, else allowed.

    A null URL or one without ``://`` has empty host and path, fits no rule and is allowed unless the empty
    URL is listed. Repeated rows are judged alike. Columns of ``pages`` named like new ones are replaced.
    """
    new = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c not in new]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")  # own columns keep out of the way of inner names
    df = pages.select(row, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, judged = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones override
        fits = _rule_fits(F.col("host"), F.col("path"), host, path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        judged = F.when(fits, F.lit(verdict)).otherwise(judged)
    df = df.withColumn("rule", rule).withColumn("verdict", judged).withColumn("_url", canonical(F.col("host"), F.col("path")))
    found = listed(df, "_url", block_list, blocks)
    method = F.when(F.col("_listed"), "block").otherwise("allow")
    return found.withColumn("verdict", F.coalesce("verdict", method)).select("_row.*", *new)
