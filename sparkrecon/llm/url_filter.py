"""URL filters: explicit rules first, mined association rules for the rest.

Spark's FP-growth mines combinations of URL tokens that go with blocked pages.
Rules below the wanted confidence or support are pruned, and so is a rule that
only adds tokens to a shorter one. URLs meet rules over an inverted index: each
rule is filed under its rarest token, only URLs with that token look at it, and
then all its tokens are checked. DataFrame operations throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecon.llm.common import lower_ascii, staged

#: Least share of labelled pages that a mined combination holds, and least share
#: of blocked pages among those.
SUPPORT, CONFIDENCE = 0.005, 0.8
BLOCK_LABEL = "label:block"
#: Rows up to which the index is broadcast; beyond, the join shuffles.
INDEX_ROWS = 10_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
    case; empty for null or without ``://``."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule ``(verdict, host, path)`` that fits, as a struct, or null. A
    rule fits its host and all subdomains if the path starts with its path. Of two
    of one length the longer host wins, then blocking. The list is part of the
    plan, so it should hold thousands of rules at most."""
    order = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    if not order:
        return none
    literal = F.array(
        *[
            F.struct(
                F.lit(h).alias("host"), F.lit(p).alias("path"),
                F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"),
            )
            for v, h, p in order
        ]
    )

    def fits(rule: Column) -> Column:
        of_host = (host == rule["host"]) | F.endswith(host, F.concat(F.lit("."), rule["host"]))
        return of_host & F.startswith(path, rule["path"])

    first = F.get(F.filter(literal, fits), F.lit(0))
    return F.when(
        first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict"))
    ).otherwise(none)


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: words of host labels, the last label, path segments
    (numbers as ``<n>``), file endings, names of parameters."""
    host, path = host_of(url), lower_ascii(path_of(url))
    words = F.filter(F.split(host, "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    names = F.regexp_extract_all(_rest(url), F.lit(r"[?&]([^=&#?]+)"), F.lit(1))

    def tag(prefix: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(prefix), v))

    segments = F.transform(parts, lambda s: F.regexp_replace(s, "[0-9]+", "<n>"))
    endings = F.filter(
        F.transform(parts, lambda s: F.regexp_extract(s, r"\.([a-z]+)$", 1)), lambda e: e != ""
    )
    last = F.regexp_extract(host, r"\.([^.]+)$", 1)
    return F.array_distinct(
        F.concat(
            tag("host:", words),
            F.when(last != "", F.array(F.concat(F.lit("top:"), last))).otherwise(
                F.array().cast("array<string>")
            ),
            tag("path:", segments),
            tag("ending:", endings),
            tag("name:", names),
        )
    )


def mine_rules(
    labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE
) -> DataFrame:
    """Mined rules ``(rule_id, tokens, confidence, support)`` of ``(url, blocked)`` rows.

    Tokens of every labelled URL, or of none, tell nothing and are left out. Rows of
    null ``blocked`` are not labelled; with no labelled row there is no rule."""
    spark = labelled.sparkSession
    empty = "rule_id bigint, tokens array<string>, confidence double, support double"
    rows = staged(
        labelled.where("blocked is not null").select(url_tokens(F.col("url")).alias("t"), "blocked")
    )
    total = rows.count()
    if not total:
        return spark.createDataFrame([], empty)
    constant = (
        rows.select(F.explode("t").alias("token")).groupBy("token").count()
        .where(F.col("count") == total).select("token").limit(1000)
    )
    # At most as many as one URL has tokens, since each is in all URLs.
    same = [row.token for row in constant.collect()]
    label = F.when(F.col("blocked"), F.array(F.lit(BLOCK_LABEL))).otherwise(
        F.array().cast("array<string>")
    )
    items = rows.select(
        F.concat(
            F.filter("t", lambda x: ~x.isin(same)) if same else F.col("t"), label
        ).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    mined = model.associationRules.where(
        F.get(F.col("consequent"), F.lit(0)) == BLOCK_LABEL
    ).select(F.sort_array("antecedent").alias("tokens"), "confidence", "support")
    return _pruned(staged(mined))


def _pruned(mined: DataFrame) -> DataFrame:
    """Drop rules that contain all tokens of a shorter rule. A shorter rule is filed
    under its first token, so only rules that share that token meet."""
    longer = mined.select("tokens", F.explode("tokens").alias("first"))
    shorter = mined.select(
        F.col("tokens").alias("inner"), F.get("tokens", F.lit(0)).alias("first")
    )
    contained = (F.size("inner") < F.size("tokens")) & (
        F.size(F.array_except("inner", "tokens")) == 0
    )
    over = longer.join(shorter, "first").where(contained).select("tokens").distinct()
    kept = mined.join(over, "tokens", "left_anti")
    return kept.withColumn("rule_id", F.xxhash64("tokens")).select(
        "rule_id", "tokens", "confidence", "support"
    )


def mined_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Of ``(page_id, url)`` rows those that a mined rule fits:
    ``(url, confidence, rule_tokens)``, a row per distinct URL with its best rule."""
    seen = urls.select("url").where("url is not null").distinct()
    tokens = seen.select("url", url_tokens(F.col("url")).alias("url_tokens"))
    # The rarest token among the rules themselves: least shared, so shortest lists.
    uses = rules.select(F.explode("tokens").alias("token")).groupBy("token").count()
    filed = (
        rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token"))
        .join(uses, "token")
        .groupBy("rule_id", "tokens", "confidence")
        .agg(F.min(F.struct("count", "token"))["token"].alias("token"))
    )
    index = staged(filed)
    if index.count() <= INDEX_ROWS:
        index = F.broadcast(index)
    posted = tokens.select("url", "url_tokens", F.explode("url_tokens").alias("token"))
    hits = posted.join(index, "token").where(F.size(F.array_except("tokens", "url_tokens")) == 0)
    return hits.groupBy("url").agg(
        F.max(F.struct("confidence", "tokens")).alias("best")
    ).select("url", "best.confidence", F.col("best.tokens").alias("rule_tokens"))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    mined: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, mined_tokens)`` of every page.

    The longest listed rule decides; else a mined rule blocks; else the page is
    allowed, as is one without a URL. Repeated pages are judged alike."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        host.alias("host"), path.alias("path"),
        listed_rule(host, path, rules).alias("listed"),
    )
    open_urls = rows.where("listed is null")
    found = mined_matches(open_urls, mined)
    open_rows = open_urls.join(found, "url", "left")
    done = rows.where("listed is not null").withColumn(
        "rule_tokens", F.lit(None).cast("array<string>")
    )
    both = done.unionByName(open_rows.drop("confidence"))
    verdict = F.coalesce(
        F.col("listed.verdict"), F.when(F.col("rule_tokens").isNotNull(), "block"), F.lit("allow")
    )
    return both.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"),
        F.array_join("rule_tokens", " ").alias("mined_tokens"),
    )


def empty_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [], "rule_id bigint, tokens array<string>, confidence double, support double"
    )
