"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

The model is trained from a small labelled table of urls and scores the host
and the path by the n-grams they hold; scoring is one projection over the
pages, with no shuffle.

Defined cases: a null url, or one without ``://``, has an empty host and path and
is judged by the model; of rules of equal length the last by code point is asked first; a long url is
judged whole; repeated rows each give theirs; columns of any other name are left out; every row
gives one row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, pick

#: (verdict, rule): a rule is a host and the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

# Labelled urls (1: block).
LABELLED = [(0, u) for u in """
https://www.riverside-herald.example/news/2021/spring-flood-report
https://blog.stonebridge.example/en/how-bridges-are-built
https://en.knowledge.example/wiki/History_of_glass
https://docs.toolkit.example/manual/install.html
https://www.university.example/research/physics/papers/112
https://museum.example/collection/item/5531
https://www.recipes.example/bread/rye-loaf
https://m.weather.example/de/berlin/heute
https://library.example/catalog/book/88231
https://forum.gardeners.example/topic/tomato-blight
https://www.court.example/judgments/2019/44
https://journal.example/articles/14/notes-on-soil
https://www.travel-notes.example/fr/bretagne/cotes
https://school.example/lessons/math/fractions
https://www.cityhall.example/services/parking
https://science.example/es/noticias/2020/agua
https://blog.example/en/58.html
http://www.story.example/en/1203?page=2
https://health.example/guide/sleep
https://www.observatory.example/sky/november
https://kernel.example/doc/scheduler
https://code.example/project/readme
https://www.parliament.example/debates/2018-03-02
https://poems.example/collection/autumn
http://m.history.example/de/771/
https://news.example/en/825
https://www.farming.example/soil/compost
https://archive.example/letters/1890/12
https://the-reader.example/essays/on-walking
https://www.chess.example/openings/spanish
""".split()] + [(1, u) for u in """
https://ads.network.example/serve?id=55
http://m.adnet.example/en/9921
https://clicks.adnet.example/click/3311
https://adserver.example/banner/728x90.gif
https://tracker.example/pixel.gif
https://track.mailer.example/open/8812
http://click.promo.example/redirect/to/offer
https://casino-bonus.example/free-spins
https://www.best-casino.example/slots/win
https://poker-online.example/bonus/today
https://cheap-pills.example/buy-viagra
https://pharma-discount.example/order/pills
https://xxx-videos.example/hot/live
https://adult-cams.example/live/girls
https://free-porn.example/video/3312
https://loans-fast.example/payday/apply-now
https://win-prize.example/claim/iphone
https://popup.ads.example/pop/under
https://affiliate.example/aff/click?ref=7
https://spam-links.example/seo/backlinks
https://doubleclick-ad.example/ad/frame
https://analytics-track.example/collect/beacon
https://www.example/login/signin
https://shop.example/cart/checkout
https://malware-download.example/crack/keygen.exe
https://torrent-warez.example/download/full-crack
https://betting-tips.example/odds/bet-now
https://adclick.example/adclick/landing
https://tracking-pixel.example/px/1
https://sponsored-ads.example/native/ad/unit
""".split()]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: str) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(verdict, rule) of the longest fitting rule, else nulls. rules is a short fixed list."""
    verdict, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is asked first
        verdict, name = F.when(_fits(host, path, r), v).otherwise(verdict), F.when(_fits(host, path, r), r).otherwise(name)
    return verdict, name


def _grams(text: Column, mark: str, n: int) -> Column:
    last = F.length(text) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def features(df: DataFrame, sizes=(3, 4), buckets: int = 4096) -> DataFrame:
    """df(host, path) with the vector of its hashed n-grams; digits count as one character."""
    host = F.concat(F.lit("^"), F.regexp_replace("host", "[0-9]", "0"), F.lit("$"))
    path = F.regexp_replace("path", "[0-9]+", "0")
    df = df.withColumn("_grams", F.concat(*[_grams(host, "h", n) for n in sizes], *[_grams(path, "p", n) for n in sizes]))
    return HashingTF(numFeatures=buckets, binary=True, inputCol="_grams", outputCol="_features").transform(df).drop("_grams")


def train(spark: SparkSession, labelled=LABELLED, reg: float = 0.005):
    table = spark.createDataFrame(labelled, "label int, url string").repartition(1)
    table = table.select(F.col("label").cast("double").alias("label"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred", regParam=reg, maxIter=25).fit(features(table))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=LABELLED) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict (allow or block), score (the model's, higher: block)."""
    df = pick(pages, id_col, url_col).toDF("_id", "_url")
    df = df.select("_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    scored = train(pages.sparkSession, labelled).transform(features(df)).withColumn("score", vector_to_array("_p")[1])
    verdict, rule = matched(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
