"""URL filter: given rules, then mined association rules (operator 3).

Spark's FP-growth mines combinations of URL tokens from labelled pages.  A rule ``tokens -> bad`` is
kept at ``min_confidence`` and ``min_support`` pages, and if no kept rule with fewer of its
tokens is as confident.  Kept rules match through an inverted index: each is filed under its
rarest token, so a page only meets rules whose rarest token it has and a token that every URL
carries is nobody's posting list.  DataFrame functions and Spark ML only.

Cases: a null url, or one without ``://``, has empty host and path and no tokens, so no rule fits
and it is allowed; a null label or label id is no label; repeated rows are judged each; with no labels or
no page labelled bad, no rule is mined; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import ascii_lower, written

BAD = "=bad"
#: The stated rules: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits; null fields if none does."""
    found = [(v, h, p) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    none = F.struct(F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rule"))
    out = none
    for v, h, p in reversed(found):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: ``h:`` host labels and their hyphened parts, ``p:`` path words; digits fold to 0."""
    def words(col: Column, mark: str, pattern: str) -> Column:
        folded = F.regexp_replace(ascii_lower(col), "[0-9]+", "0")
        return F.transform(F.filter(F.split(folded, pattern), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    return F.array_distinct(F.concat(words(host, "h:", r"\."), words(host, "h:", r"[.-]"), words(path, "p:", "[^a-z0-9]+")))


def mine_rules(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", label_id: str = "doc_id",
               min_support: int = 20, min_confidence: float = 0.8) -> DataFrame:
    """Pruned rules ``(rule_id, tokens, support, confidence)`` from pages whose id has a label.

    A page is bad when its label says low quality or toxic.
    """
    marked = labels.where(F.col(label_id).isNotNull() & F.coalesce("quality", "toxic").isNotNull()).groupBy(label_id).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad"))
    known = pages.select(F.col(id_col).alias(label_id), tokens_of(host_of(F.col("url")), path_of(F.col("url"))).alias("t")) \
        .join(marked, label_id).select(F.when(F.col("bad"), F.concat("t", F.array(F.lit(BAD)))).otherwise(F.col("t")).alias("items"))
    known = written(known.where(F.size("items") > 0), "url-items")
    spark, n = pages.sparkSession, known.count()
    empty = spark.createDataFrame([], "rule_id long, tokens array<string>, support long, confidence double")
    if not n:
        return empty
    # Spark takes ceil(minSupport * n) pages: half a page less, so that rounding never asks for one more.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_support - 0.5) / n), minConfidence=min_confidence).fit(known)
    rules = model.associationRules.where(F.element_at("consequent", 1) == BAD).select(
        F.array_sort("antecedent").alias("tokens"), F.round(F.col("support") * n).cast("long").alias("support"), "confidence")
    rules = written(rules, "url-rules")
    # A rule goes if a rule with a part of its tokens is as confident: join on each token of the longer one.
    short = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("c"), F.element_at("tokens", 1).alias("at"))
    long = rules.select("tokens", "confidence", F.explode("tokens").alias("at"))
    beaten = long.join(short, "at").where((F.size("part") < F.size("tokens")) & (F.col("c") >= F.col("confidence"))
                                          & (F.size(F.array_except("part", "tokens")) == 0)).select("tokens").distinct()
    kept = rules.join(beaten, "tokens", "left_anti")
    return kept.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "support", "confidence")


def match_rules(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """The most confident rule (then most supported, then smallest id) for each ``key`` that any rule fits.

    ``urls`` has ``key`` and ``tokens``; the inverted index is built over the tokens that rules use.
    """
    used = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")) \
        .join(used, "token")
    index = (rules.select("rule_id", "tokens", "confidence", "support", F.explode("tokens").alias("token"))
             .join(counts, "token", "left")
             .groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).getField("token").alias("token"),
                                     F.first("tokens").alias("need"), F.first("confidence").alias("confidence"),
                                     F.first("support").alias("support")))
    hits = urls.select(key, "tokens", F.explode("tokens").alias("token")).join(written(index, "url-index"), "token") \
        .where(F.size(F.array_except("need", "tokens")) == 0)
    return hits.groupBy(key).agg(F.max(F.struct("confidence", "support", F.negate("rule_id").alias("r"))).alias("best")) \
        .select(key, F.negate(F.col("best.r")).alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", rules=RULES,
               min_support: int = 20, min_confidence: float = 0.8) -> DataFrame:
    """``page_id, host, path, rule, verdict`` with the mined rule's id and confidence beside them."""
    url = F.col("url")
    parsed = pages.select(F.col(id_col), url, host_of(url).alias("host"), path_of(url).alias("path"))
    mined = mine_rules(pages, labels, id_col, min_support=min_support, min_confidence=min_confidence)
    sets = parsed.select(tokens_of(F.col("host"), F.col("path")).alias("tokens")).where(F.size("tokens") > 0).distinct() \
        .withColumn("set_id", F.xxhash64("tokens"))
    matched = match_rules(sets, mined, "set_id")
    g = given_rule(F.col("host"), F.col("path"), rules)
    return (parsed.withColumn("set_id", F.xxhash64(tokens_of(F.col("host"), F.col("path"))))
            .join(matched, "set_id", "left").withColumn("g", g)
            .select(id_col, "host", "path", F.col("g.rule").alias("rule"),
                    F.coalesce("g.verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"),
                    "mined_rule", "mined_confidence"))
