"""URL filter: host and path rules, then a list of URLs behind a blocked Bloom filter.

The list is matched on canonical URLs. A Bloom filter made of 64-byte blocks passes
possible hits; an exact join with the list removes its false positives. The filter has a
fixed largest size (``MAX_BLOCKS`` blocks), so it can always be broadcast: a list too long for it
only sends more rows to the join, and never changes a verdict.

Edge cases: a NULL URL, or one without ``://``, has an empty host and path, fits no rule and
is allowed. Repeated rows are judged each on its own. An empty list allows everything that no rule
blocks. Columns besides the id and the URL are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.stages import materialize

MAX_BLOCKS = 1 << 20
BITS_PER_KEY = 16
WORDS = 8
# odd multipliers below 2**31, one per word of a block
SALTS = [(0x47B6137B + 2 * 0x1EDA1F3F * i) % (1 << 31) | 1 for i in range(WORDS)]
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid)="


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def canonical_url(url: Column) -> Column:
    """Scheme, fragment, ``www.``/``m.``, default port, closing slashes and tracking
    parameters do not count; other parameters are sorted. Empty without a host."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    kept = F.filter(F.split(url_query(url), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host == "", "").otherwise(whole)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; NULL if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


@dataclass(frozen=True)
class BlockedBloom:
    """``words`` holds 8 unsigned 64-bit words per block; a key sets one bit in each."""

    words: np.ndarray

    @classmethod
    def build(cls, keys: DataFrame, key: str) -> BlockedBloom:
        """From the distinct values of a BIGINT hash column; bits are OR-ed in Spark."""
        n = keys.count()
        blocks = 1
        while blocks < MAX_BLOCKS and blocks * 64 * 8 < n * BITS_PER_KEY:
            blocks *= 2
        h = F.col(key)
        low = h.bitwiseAND(F.lit((1 << 31) - 1))
        bits = [
            F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(low * F.lit(s), 25).bitwiseAND(F.lit(63)).cast("int"))
            for s in SALTS
        ]
        block = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(blocks - 1)).alias("block")
        set_bits = keys.select(block, *[b.alias(f"w{i}") for i, b in enumerate(bits)])
        rows = set_bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
        words = np.zeros((blocks, WORDS), np.int64)
        found = rows.toPandas()  # at most MAX_BLOCKS rows of 64 bytes
        words[found["block"].to_numpy()] = found[[f"w{i}" for i in range(WORDS)]].to_numpy()
        return cls(words.view(np.uint64))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.int64).view(np.uint64)
        low = h & np.uint64((1 << 31) - 1)
        rows = self.words[((h >> np.uint64(32)) & np.uint64(len(self.words) - 1)).astype(np.int64)]
        bits = (low[:, None] * np.array(SALTS, np.uint64) >> np.uint64(25)) & np.uint64(63)
        return ((rows >> bits) & np.uint64(1)).all(axis=1)


def judge_urls(spark: SparkSession, pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Host, path, fitting rule, canonical URL and verdict of every row of ``pages``.

    ``listed`` has the column ``canonical``: the blocked URLs, in canonical form.
    """
    names = materialize(listed.select("canonical").where("canonical <> ''").distinct(), "listed_urls")
    bloom = spark.sparkContext.broadcast(BlockedBloom.build(names.select(F.xxhash64("canonical").alias("h")), "h"))

    @F.pandas_udf("boolean")
    def may_hold(hashes: pd.Series) -> pd.Series:
        return pd.Series(bloom.value.may_hold(hashes.to_numpy()))

    parts = pages.select(
        F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"),
        canonical_url(F.coalesce(F.col(url), F.lit(""))).alias("canonical"),
    )
    parts = parts.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    ruled = parts.withColumn("_r", longest_rule(F.col("host"), F.col("path"), rules))
    probed = ruled.withColumn("maybe", may_hold(F.xxhash64("canonical")))
    # stored, so that the filter is asked once for both branches
    probed = materialize(probed, "probed_urls")
    hits = probed.where("maybe").join(names.withColumn("_listed", F.lit(True)), "canonical", "left")
    sure = probed.where("NOT maybe").withColumn("_listed", F.lit(None).cast("boolean"))
    both = hits.unionByName(sure)
    verdict = F.coalesce("_r.verdict", F.when(F.col("_listed"), "block").otherwise("allow"))
    return both.select(
        "page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "canonical",
        F.coalesce("_listed", F.lit(False)).alias("listed"),
    )
