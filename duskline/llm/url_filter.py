"""URL filtering: rules of host suffix and path prefix, else logistic regression on hashed character n-grams.

The classifier is trained from a small labelled table of URLs (``LABELLED``, or one the caller gives) with Spark's own
``HashingTF`` and ``LogisticRegression``; everything is DataFrame expressions and JVM-side ML stages.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES, SIZES = 1 << 13, (3, 4, 5)
#: Rules of the query: host suffix, path prefix, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Small labelled table: unwanted (1) and wanted (0) hosts and paths. The hosts are invented, but their words (pills, casino,
#: farm, adult and the like) and the form of the paths are those of the pages that the filter is meant for.
LABELLED = [
    ("cheap-meds.shop.test", "/buy/now", 1), ("cheap-pills-online.test", "/order/12", 1), ("best-pills.pharma.test", "/discount", 1), ("pills4you.test", "/en/55", 1),
    ("www.cheap-watches.test", "/sale/9", 1), ("spam-site.test", "/en/1", 1), ("spam-links.farm.test", "/de/20", 1), ("link-farm.test", "/fr/300", 1), ("content-farm.test", "/es/41", 1),
    ("free-casino-bonus.test", "/play", 1), ("casino-win.test", "/en/77", 1), ("online-casino.test", "/slots/3", 1), ("win-prizes-free.test", "/claim", 1), ("hot-singles.test", "/meet/8", 1),
    ("xxx-videos.test", "/watch/81", 1), ("adult-cams.test", "/live/2", 1), ("porn-tube.test", "/v/901", 1), ("free-porn.test", "/en/11", 1), ("crypto-doubler.test", "/invest", 1), ("get-rich-quick.test", "/join/4", 1),
    ("payday-loans-fast.test", "/apply", 1), ("cheap-loans.test", "/en/640", 1), ("click-here-win.test", "/go?id=7", 1), ("clickbait-news.test", "/shock/5", 1), ("seo-backlinks.test", "/pack/3", 1), ("malware-download.test", "/setup.exe", 1),
    ("warez-crack.test", "/keygen/66", 1), ("torrent-crack.test", "/get/5", 1), ("replica-bags.test", "/cheap/2", 1), ("miracle-diet-pills.test", "/lose-weight", 1),
    ("www.library.test", "/catalogue/12", 0), ("blog.gardening.test", "/en/2021/roses", 0), ("news.city.test", "/local/55", 0), ("m.weather.test", "/de/berlin", 0), ("docs.software.test", "/en/guide/intro", 0), ("www.university.test", "/courses/physics", 0),
    ("museum.test", "/fr/collection/9", 0), ("blog.travels.test", "/es/madrid", 0), ("recipes.kitchen.test", "/soup/33.html", 0), ("en.encyclopedia.test", "/wiki/River", 0), ("www.hospital.test", "/departments/3", 0), ("m.railway.test", "/timetable/8", 0),
    ("history.archive.test", "/en/1848", 0), ("blog.astronomy.test", "/en/410.html", 0), ("theatre.test", "/programme/", 0), ("www.bakery.test", "/about", 0), ("science.journal.test", "/article/771", 0), ("blog.thought.test", "/en/88/", 0),
    ("www.therapy.test", "/en/19", 0), ("there.test", "/en/360", 0), ("thing.nation.test", "/fr/640", 0), ("m.motion.test", "/en/733", 0), ("the.station.test", "/es/505", 0), ("blog.then.test", "/de/92", 0),
    ("www.thanks.test", "/en/251/", 0), ("other.ration.test", "/en/118.html", 0), ("m.theory.test", "/en/14", 0), ("thistle.test", "/fr/900", 0), ("blog.option.test", "/en/677", 0), ("father.mention.test", "/en/45", 0),
]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of the bracketed host and, marked apart, of the path."""

    def grams(text: Column, mark: str) -> list[Column]:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        size = F.length(whole)
        cut = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.concat(F.lit(mark), whole.substr(i, F.lit(n))))
        return [F.when(size >= n, cut(n)).otherwise(F.array().cast("array<string>")) for n in SIZES]

    return F.concat(*grams(host, "h"), *grams(path, "p"))


def _vectors(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams_", outputCol="_features_").transform(df.withColumn("_grams_", _ngrams(F.col("host"), F.col("path"))))


def fit(spark: SparkSession, labelled: list[tuple[str, str, int]] | None = None) -> LogisticRegressionModel:
    """Fit on labelled (host, path, label) rows, 1 being unwanted."""
    rows = spark.createDataFrame(labelled or LABELLED, "host string, path string, label int").coalesce(1)
    return LogisticRegression(featuresCol="_features_", labelCol="label", regParam=0.01, maxIter=40).fit(_vectors(rows))


def _rule(host: Column, path: Column, rules: list[tuple[str, str, str]], pick: int) -> Column:
    """Of the fitting rule with the longest host, then path: its text (pick 0) or its verdict (pick 2)."""
    chosen = F.lit(None).cast("string")
    for suffix, prefix, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):  # later ones win
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        chosen = F.when(fits, F.lit(suffix + prefix if pick == 0 else verdict)).otherwise(chosen)
    return chosen


def judge_urls(pages: DataFrame, model: LogisticRegressionModel, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, threshold: float = 0.6) -> DataFrame:
    """``(page_id, host, path, rule, verdict, p_block)``; ``rule`` is null where the classifier decides.

    A rule fits its host and the subdomains if the path starts with the rule's; the longest rule wins (equally long: the
    longer host). Null URLs and URLs without ``://``: empty host and path, judged by the classifier. Any path of any
    length is read whole. Repeated rows are judged each. An empty table gives an empty result. Other columns are ignored.
    """
    rules = RULES if rules is None else rules
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    scored = model.setProbabilityCol("_p_").setRawPredictionCol("_raw_").setPredictionCol("_said_").transform(_vectors(parts))
    p = vector_to_array(F.col("_p_"))[1]
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(_rule(host, path, rules, 2), F.when(p >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", _rule(host, path, rules, 0).alias("rule"), verdict.alias("verdict"), p.alias("p_block"))
