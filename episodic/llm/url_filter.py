"""URL filter: a blocked Bloom filter of listed canonical URL keys before an exact join.

A rule is a host and a path prefix.  A URL asks for the keys (each domain
suffix of its host, each prefix of its path as long as some listed path); the
filter passes the keys that may be listed, and an exact hash join on host and
path removes the false positives.  The longest rule decides; a URL without a
rule is not listed and gets the default verdict.

The filter is one 64-bit word per block: a key's hash chooses the block and
four bits in it; words are joined by ``bit_or``.  It holds 16 bits a rule and
2**20 blocks (16 MB) at most, whatever the list's length, so the block table
is the only side that is broadcast.  Distinct (host, path) pairs are judged
once, so a URL's copies meet before any join.  All of it is DataFrame
functions.

Defined cases: null URLs and URLs without ``://`` have empty host and path and
the default verdict; repeated rows and null ids are kept; a rule with a null
or empty host or a null path is left out; of equal rules that disagree,
``block`` wins; an empty rule list gives every URL the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_BLOCKS = 1 << 20
BITS_PER_KEY = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The production list: host, path prefix, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Canonical host (ASCII lower case) and path of a URL, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, _UPPER, _LOWER), path


def _block(n_blocks: int) -> Column:
    return F.pmod(F.xxhash64("host", "prefix"), F.lit(n_blocks))


def _mask() -> Column:
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(prefix, host, 7), {6 * k}) & 63 as int))") for k in range(4)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def bloom_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter's blocks: ``block, word``, at most ``n_blocks`` rows."""
    return keys.groupBy(_block(n_blocks).alias("block")).agg(F.bit_or(_mask()).alias("word"))


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page; ``rules`` has ``host, path, verdict``."""
    host, path = host_and_path(F.col("_url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path"))

    listed = (rules.where("host != '' and path is not null")
              .groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), F.col("path").alias("prefix"))
              .agg(F.max("verdict").alias("listed")))  # block after allow
    # one row: the number of rules and the distinct lengths of their paths, at most the longest URL
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("prefix")).alias("lengths")).first()
    n_blocks = max(1, min(MAX_BLOCKS, -(-size["n"] * BITS_PER_KEY // 64)))
    lengths = F.array(*[F.lit(n) for n in sorted(size["lengths"])]) if size["lengths"] else F.expr("cast(array() as array<int>)")

    asked = urls.select("host", "path").distinct()
    keys = (asked.withColumn("_labels", F.split("host", r"\."))
            .withColumn("_suffix", F.explode(F.expr("transform(sequence(1, size(_labels)), i -> array_join(slice(_labels, i, size(_labels)), '.'))")))
            .withColumn("_length", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))))
            .select(F.col("host").alias("url_host"), "path", F.col("_suffix").alias("host"),
                    F.expr("substring(path, 1, _length)").alias("prefix"))
            .where("host != ''"))
    blocks = bloom_filter(listed, n_blocks)
    possible = (keys.withColumn("block", _block(n_blocks)).withColumn("mask", _mask())
                .join(F.broadcast(blocks), "block")
                .where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"))
                .select("url_host", "path", "host", "prefix"))
    exact = possible.join(listed, ["host", "prefix"])
    best = exact.groupBy("url_host", "path").agg(F.max(F.struct(
        (F.length("host") + F.length("prefix")).alias("size"), F.length("host").alias("host_size"),
        F.concat("host", "prefix").alias("rule"), F.col("listed").alias("verdict"))).alias("best"))
    best = best.select(F.col("url_host").alias("host"), "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by the production rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES = {"op8_url_filter": r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                               ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
urls AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts)
SELECT page_id, host, path,
       (SELECT arg_max(h || p, length(h || p)) FROM rules
        WHERE (urls.host = h OR ends_with(urls.host, '.' || h)) AND starts_with(urls.path, p)) AS rule,
       coalesce((SELECT arg_max(v, length(h || p)) FROM rules
                 WHERE (urls.host = h OR ends_with(urls.host, '.' || h)) AND starts_with(urls.path, p)), 'allow') AS verdict
FROM urls
"""}
