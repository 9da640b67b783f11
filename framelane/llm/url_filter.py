"""URL filter: list rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame, SQL and Spark ML expressions only; the model is fitted on a small labelled table of URLs, a parameter.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The list rules: verdict, host, start of the path. Fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Site names of the labelled table. Fixed values; each makes one URL per pattern of PLACES.
UNWANTED = (
    "best-bets bets-online free-slots casino-royal win-jackpot online-casino poker-win slots-free lucky-casino winbig "
    "adult-video adults-only x-adult xxx-videos hot-adult porn-free sex-chat live-sex escort-girls nude-cams cheap-viagra "
    "pills-online buy-pills viagra-cheap cheap-meds diet-pills spam-links bulk-spam link-farm farm-seo content-farm "
    "ad-tracker track-ads ads-click popads ads-server tracking-pixel free-money quick-loans payday-loans crypto-doubler "
    "cracked-keys warez-free torrent-crack malware-drop phish-login"
).split()
WANTED = (
    "city-library open-science daily-news world-history garden-notes river-museum music-school university physics-lab "
    "weather-report cooking-recipes travel-stories local-council health-advice childrens-books bird-watching math-forum "
    "film-review art-gallery railway-club chess-games astronomy language-course hiking-trails charity-fund parliament "
    "court-records energy-data farming-today photo-archive theatre dental-clinic bakery carpentry cycling-routes "
    "whitman thornton easton hestia orange ingram entire oneida atlanta thanet nation sherton wharton houston norther "
    "reading edington anderson tenor thisted lyndon estate heather brethren stanton"
).split()
PLACES = ("http://www.{}.example.net/en/4021", "https://{}.example.com/de/118?page=2", "https://blog.{}.example.org/fr/7756.html", "http://m.{}.example.net/es/93#top")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without ``://``."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(url, pattern, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(url, pattern, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does; of equally long ones the first listed."""
    text = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        text, verdict = F.when(fits, name + start).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table: ``url`` and ``label`` (1.0 unwanted)."""
    rows = [
        f"('{place.format(name)}', {label})"
        for label, names in ((1.0, UNWANTED), (0.0, WANTED))
        for name in names
        for place in PLACES
    ]
    return spark.sql(f"SELECT url, CAST(label AS DOUBLE) AS label FROM VALUES {', '.join(rows)} AS t(url, label)")


def ngrams(host: Column, path: Column) -> Column:
    """Character 3-, 4- and 5-grams, apart for host and path, with marked ends. Empty text has none."""

    def of(text: Column, mark: str, n: int) -> Column:
        edged = F.concat(F.lit("^"), text, F.lit("$"))
        last = F.length(text) + 3 - n
        grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substring(edged, i, F.lit(n))))
        return F.when((text != "") & (last >= 1), grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(host, "h", n) for n in (3, 4, 5)], *[of(path, "p", n) for n in (3, 4)])


def fit(labelled: DataFrame, features: int = 1 << 14, reg: float = 0.002, threshold: float = 0.6) -> tuple[HashingTF, LogisticRegressionModel]:
    """Logistic regression on a labelled table (``url``, ``label``), meant to be small; null labels are left out.

    ``threshold`` over one half: blocking a wanted page is the dearer mistake.
    """
    host, path = host_and_path(F.col("url"))
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=features, binary=True)
    rows = hashing.transform(labelled.filter("label IS NOT NULL").select("label", ngrams(host, path).alias("_grams")))
    model = LogisticRegression(featuresCol="_features", labelCol="label", regParam=reg, maxIter=60, standardization=False, threshold=threshold)
    return hashing, model.setPredictionCol("_unwanted").setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(rows)


def judge_urls(df: DataFrame, labelled: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict``: the longest fitting rule's verdict, else the model's.

    A url without host is allowed unless a rule says otherwise: there is nothing to judge. Repeated rows are judged alike; other columns are not
    read. One pass over the urls, no shuffle.
    """
    hashing, model = fit(labelled_urls(df.sparkSession) if labelled is None else labelled)
    host, path = host_and_path(F.col(url_col))
    parts = df.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    scored = model.transform(hashing.transform(parts.withColumn("_grams", ngrams(F.col("host"), F.col("path")))))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("_unwanted") == 1.0) & (F.col("host") != ""), "block").otherwise("allow")
    return scored.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def judge_pages(pages: DataFrame) -> DataFrame:
    return judge_urls(pages)
