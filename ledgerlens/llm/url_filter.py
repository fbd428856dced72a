"""URL verdicts: host and path rules, then a list behind a blocked Bloom filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import fold, two_hashes

WORDS_PER_BLOCK = 4  # a block of the filter: four words of 64 bits, one bit set in each
BITS_PER_URL = 16
BLOCK_BYTES = 36
BROADCAST_BYTES = 64 << 20  # of the filter: some thirty million URLs


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` a host with all its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z folded."""
    return fold(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


# Query parameters that say where a visitor came from, not what page is shown.
TRACKING = ("utm_", "ref=")


def canonical_url(url: Column) -> Column:
    """Host, path without closing slashes, and the query's other parameters in order.

    Scheme, fragment, ``utm_`` and ``ref`` parameters go. Without a host it is ''.
    """
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    tracked = lambda p: p.startswith(TRACKING[0]) | p.startswith(TRACKING[1]) | (p == "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&", -1), lambda p: ~tracked(p))), "&")
    page = F.concat(url_host(url), F.rtrim(url_path(url), F.lit("/")))
    return F.when(url_host(url) == "", "").otherwise(F.concat(page, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; missing if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _bits(h1: str, h2: str, n_blocks: int) -> list[Column]:
    """The block a URL falls into, and a word with one bit set for each of the block's words."""
    block = F.pmod(h1, F.lit(n_blocks)).cast("int").alias("_block")
    place = [F.shiftrightunsigned(h2, 6 * i).bitwiseAND(63).cast("int") for i in range(WORDS_PER_BLOCK)]
    one = F.lit(1).cast("bigint")
    return [block, *(F.call_function("shiftleft", one, p).alias(f"_w{i}") for i, p in enumerate(place))]


def bloom_filter(hashes: DataFrame, max_blocks: int | None = None) -> tuple[DataFrame, int]:
    """(block, words) of a blocked Bloom filter over the columns ``_h1`` and ``_h2``, and its number of blocks.

    At least sixteen bits per URL, however long the list is, unless a caller
    sets ``max_blocks``: then more URLs pass to the exact join, which stays right.
    """
    wanted = hashes.count() * BITS_PER_URL // (64 * WORDS_PER_BLOCK) + 1
    n_blocks = 1 << (wanted - 1).bit_length()
    if max_blocks is not None:
        n_blocks = min(max_blocks, n_blocks)
    words = [f"_w{i}" for i in range(WORDS_PER_BLOCK)]
    rows = hashes.select(*_bits("_h1", "_h2", n_blocks))
    return rows.groupBy("_block").agg(*(F.bit_or(w).alias(f"_set{w}") for w in words)), n_blocks


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every row.

    The longest rule that fits decides. Other rows are blocked if their
    canonical URL is among those of ``listed`` (column ``url``), else allowed.

    The list enters a blocked Bloom filter: a URL's bits lie in one block, so
    the filter is a table that joins by block number. While its blocks, whose
    number follows from the list's, are within ``BROADCAST_BYTES`` they are
    broadcast; beyond that they meet the rows by a shuffle. Only rows whose bits are all set go on to the
    exact join with the list, so hardly any row without a match is shuffled;
    that join compares canonical URLs and removes the false positives.

    A missing URL, or one without ``://``, has an empty host and path, fits no
    rule and is allowed. Repeated rows are each returned; repeated list
    entries count once. Empty tables are fine on either side. Other columns
    are ignored.
    """
    exact = (
        listed.select(canonical_url(F.col("url")).alias("_listed_url")).where("_listed_url != ''").distinct()
    )
    blocks, n_blocks = bloom_filter(exact.select(*two_hashes("_listed_url")))
    small = F.broadcast(blocks) if n_blocks * BLOCK_BYTES <= BROADCAST_BYTES else blocks
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), F.coalesce(host, F.lit("")).alias("host"),
                        F.coalesce(path, F.lit("")).alias("path"), F.coalesce(canonical_url(F.col(url_col)), F.lit("")).alias("_canonical"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("_ruled", verdict)
    words = [f"_w{i}" for i in range(WORDS_PER_BLOCK)]
    hashed = rows.select("*", *two_hashes("_canonical"))
    tested = hashed.select(*rows.columns, *_bits("_h1", "_h2", n_blocks)).join(small, "_block", "left")
    all_set = F.lit(True)
    for w in words:
        all_set = all_set & F.coalesce(F.col(w).bitwiseAND(F.col(f"_set{w}")) != 0, F.lit(False))
    # Rows that a rule decides need no list; the others need it if the filter lets them pass.
    tested = tested.select(*rows.columns, (F.col("_ruled").isNull() & all_set).alias("_possible"))
    # Two branches of one cheap scan: only possible hits have a key, so only they are shuffled.
    sure = tested.where(~F.col("_possible")).withColumn("listed", F.lit(False))
    hits = tested.where("_possible").join(
        exact.withColumn("_is", F.lit(True)), F.col("_canonical") == F.col("_listed_url"), "left"
    )
    hits = hits.withColumn("listed", F.coalesce("_is", F.lit(False))).select(*sure.columns)
    return sure.unionByName(hits).select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce("_ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed",
    )
