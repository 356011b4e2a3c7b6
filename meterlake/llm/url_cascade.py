"""URL filter by a Bloom filter cascade, in DataFrame operations only.

The listed keys go into a first Bloom filter; the unlisted keys of the corpus that it lets through go into a second one, the listed keys that this one lets through
into a third, and so on until none is left. As the levels are built over the complete universe of the corpus's keys, a key's
first miss tells exactly whether it is listed: the rows of the corpus are judged by an expression over bitmaps, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

#: host, path prefix, verdict; a rule fits its host and all subdomains, and the longest fitting rule wins.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Host labels (parted by dots and hyphens) whose hosts are listed where no rule speaks.
LISTED_LABELS = ("adult", "bets", "casino", "pills", "porn")
#: Bits of a cascade's bitmaps that one plan carries (2 MB); larger lists are judged in several passes over disjoint key ranges.
MAX_BITS = 1 << 24
#: Hash functions of the levels after the first: each lets a 16th of the other side through.
NEXT_HASHES = 4
BUCKET = 32_768  # bits of one bitmap of Spark's bitmap functions
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ``://``."""
    url = url.cast("string")
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path in one string) and its verdict, else null. Rules of one length go by their text."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _v in order]
    pick = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)), F.lit(None).cast("string"))
    return pick([h + p for h, p, _v in order]), pick([v for _h, _p, v in order])


def has_label(host: Column, labels=LISTED_LABELS) -> Column:
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*(F.lit(x) for x in labels)))


@dataclass
class Level:
    bits: int
    hashes: int
    bitmap: bytes


def _place(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits))


def _let_through(key: Column, number: int, level: Level) -> Column:
    """Whether a level's Bloom filter holds the key."""
    bitmap = F.lit(bytearray(level.bitmap))
    found = F.lit(True)
    for i in range(level.hashes):
        at = _place(key, number, i, level.bits)
        byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found & (F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1)
    return found


def _level(keys: DataFrame, number: int, n: int, hashes: int) -> Level:
    """One Bloom filter over ``n`` keys; its bitmaps are made by partial aggregation in the cluster."""
    bits = -(-math.ceil(n * hashes / math.log(2)) // BUCKET) * BUCKET
    places = keys.select(F.explode(F.array(*(_place(F.col("key"), number, i, bits) for i in range(hashes)))).alias("at"))
    rows = places.groupBy(F.floor(F.col("at") / BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(BUCKET))).alias("bitmap")).collect()  # bits / 8 bytes, bounded by the shard
    whole = bytearray(bits // 8)
    for r in rows:
        whole[r["bucket"] * BUCKET // 8 : (r["bucket"] + 1) * BUCKET // 8] = r["bitmap"]
    return Level(bits, hashes, bytes(whole))


def build(universe: DataFrame) -> list[Level]:
    """The cascade over distinct ``key, listed`` rows; empty if no key is listed."""
    counts = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    n, other = counts.get(True, 0), counts.get(False, 0)
    levels: list[Level] = []
    inside, outside = universe.where("listed"), universe.where("not listed")
    hashes = max(1, math.ceil(math.log2(max(2.0, math.sqrt(2) * other / max(n, 1)))))
    while n:
        number = len(levels)
        level = _level(inside, number, n, hashes)
        levels.append(level)
        through = stored(outside.where(_let_through(F.col("key"), number, level)), f"cascade-{number}")
        n, hashes = through.count(), NEXT_HASHES
        inside, outside = through, inside
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Exact for every key of the universe: the first level that misses decides, an odd one (from 1) against."""
    answer = F.lit(len(levels) % 2 == 1)
    for number in reversed(range(len(levels))):
        answer = F.when(_let_through(key, number, levels[number]), answer).otherwise(F.lit(number % 2 == 1))
    return answer


def keys_with_labels(pages: DataFrame, *, url_col: str = "url", rules=RULES, labels=LISTED_LABELS) -> DataFrame:
    """A list as ``judge_urls`` takes it: the pages' keys whose host has one of the labels."""
    host, path = host_and_path(F.col(url_col))
    own = pages.select(host.alias("host"), F.substring(path, 1, _seen(rules)).alias("prefix"))
    return own.where(has_label(F.col("host"), labels)).distinct()


def _seen(rules) -> int:
    """Characters of a path that the longest rule sees."""
    return max((len(p) for _h, p, _v in rules), default=0)


def judge_urls(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """``page_id, host, path, rule, verdict``, one row per row of ``pages``.

    A key is the host with as much of the path as the longest rule can see, so it decides every rule. ``listed`` is a table of any size with the listed
    keys (``host``, and ``prefix``: that much of the path); it may repeat rows and name keys that the corpus has not. It is joined to the corpus's distinct keys
    while the cascade is built; the rows themselves meet no join. A key is blocked if a rule blocks it or, where no rule fits, if it is listed. Null urls and urls without ``://`` have an empty
    host and path, no rule, and are allowed; repeated rows are judged alike; other columns are not read."""
    spark = pages.sparkSession
    prepare(spark)
    host, path = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    seen = _seen(rules)
    key = F.concat("host", F.lit(" "), F.substring("path", 1, seen))
    rule = fitting_rule(F.col("host"), F.col("path"), rules)[0]
    seen_verdict = fitting_rule(F.col("host"), F.col("prefix"), rules)[1]
    keys = own.select("host", F.substring("path", 1, seen).alias("prefix")).distinct()
    block = listed.select(F.col("host").cast("string").alias("host"), F.col("prefix").cast("string").alias("prefix")).dropna().distinct().withColumn("on_list", F.lit(True))
    marked = keys.join(block, ["host", "prefix"], "left")
    universe = stored(marked.select(F.concat("host", F.lit(" "), "prefix").alias("key"), F.coalesce(seen_verdict == "block", "on_list", F.lit(False)).alias("listed")), "universe")
    count = universe.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("listed").cast("int")), F.lit(0)).alias("listed")).first()
    first = max(1, math.ceil(math.log2(max(2.0, math.sqrt(2) * (count["n"] - count["listed"]) / max(count["listed"], 1)))))
    shards = max(1, math.ceil(count["listed"] * (first + 2 * NEXT_HASHES) / math.log(2) / max_bits))
    out = None
    for shard in range(shards):  # one, unless the list outgrows a plan
        mine = F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards)) == shard
        levels = build(universe if shards == 1 else universe.where(F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)) == shard))
        rows = own if shards == 1 else own.where(mine)
        part = rows.select("page_id", "host", "path", rule.alias("rule"), F.when(is_listed(key, levels), "block").otherwise("allow").alias("verdict"))
        out = part if out is None else out.unionByName(part)
    return out
