"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for all other URLs.

DataFrame and Spark ML operations only. Each URL is judged by itself, so there is no shuffle; the model has a fixed number
of weights and is trained on a small labelled table.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A small labelled table to start with: made-up addresses of common unwanted and ordinary kinds. ``filter_urls`` takes a model
#: trained on any other table.
BLOCKED_URLS = [
    "http://discount-pills.example.org/en/12", "https://www.pills-without-prescription.example.edu/fr/8.html", "http://cheap-meds.example.info/de/4",
    "http://spam-offers.example.org/en/1", "https://www.mail-spam.example.info/de/77", "http://link-farm.example.info/en/links/33",
    "http://best-casino.example.org/play", "https://casino-bonus.example.info/de/win/5", "http://poker-casino.example.edu/en/free-spins",
    "http://free-viagra.example.info/en/3", "http://win-prize-now.example.org/claim", "https://lottery-winner.example.edu/claim/prize",
    "http://xxx-video.example.org/adult/5", "http://adult-cams.example.info/live", "http://porn-tube.example.org/watch/7",
    "http://crack-keygen.example.org/download/serial", "http://free-torrent.example.info/download/9", "http://verify-login-account.example.org/bank/secure",
    "http://payday-loans.example.edu/apply/fast-cash", "http://replica-watches.example.org/cheap/3", "http://seo-links.example.info/es/links/2",
    "http://clickbait-ads.example.org/popup/2", "http://fake-news.example.info/en/44", "http://weight-loss-pills.example.edu/buy",
    "http://free-bets.example.org/odds/2", "https://m.bets-win.example.info/bet/now", "http://ads-popunder.example.org/click",
    "https://tracking-ads.example.info/pixel/3", "http://article-farm-spam.example.org/en/7", "https://cheap-replica.example.org/de/18",
]
ALLOWED_URLS = [
    "http://daily-journal.example.org/en/770", "https://blog.orchard.example.org/de/853/", "http://news.example.org/en/2021/05/story.html",
    "https://www.library.example.org/catalogue/12", "http://docs.example.info/en/guide", "https://m.weather-today.example.info/en/25",
    "http://observatory.example.info/de/236", "https://blog.kitchen-notes.example.org/en/533/", "http://wiki.example.org/fr/article",
    "https://www.university.example.org/research/paper.html", "http://history-archive.example.org/es/575", "https://forum.example.info/en/topic/9",
    "http://museum.example.org/en/visit", "https://recipes.example.info/de/soup/4", "http://village-council.example.org/en/453",
    "https://www.science.example.org/en/148.html", "http://weather.example.info/en/today", "https://blog.travel.example.org/fr/65.html",
    "http://botany-handbook.example.info/en/785.html", "https://city.example.org/en/map", "http://books.example.info/en/31/", "https://school.example.org/de/4",
    "http://gardening.example.org/en/roses", "https://health.example.info/en/sleep/2",
    "http://www.chess-club.example.edu/en/40", "https://m.railway-times.example.edu/fr/24", "http://blog.mountain-hut.example.edu/es/320.html",
    "https://dictionary.example.info/de/34", "http://m.theatre.example.edu/en/39", "https://www.southern-harbour.example.edu/de/17/",
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path of a URL; both empty for null and for a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of a short list of rules (rule, verdict) that fits, and its verdict; null where none does.

    A rule is a host, with its subdomains, and what the path starts with, written together.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def character_ngrams(host: str, path: str, sizes: tuple[int, ...]) -> Column:
    """All character n-grams of host and path, marked by where they come from; texts have a mark at either end."""
    parts = [
        F.expr(f"transform(sequence(1, greatest(length({c}) + 3 - {n}, 1)), i -> concat('{c}{n}', substring(concat('^', {c}, '$'), i, {n})))")
        for c in (host, path) for n in sizes
    ]
    return F.concat(*parts)


class UrlModel:
    """Logistic regression on hashed character n-grams of host and path."""

    def __init__(self, fitted: PipelineModel, sizes: tuple[int, ...]):
        self.fitted, self.sizes = fitted, sizes

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_blocked``, the probability that the URL of its columns ``host`` and ``path`` is unwanted."""
        from pyspark.ml.functions import vector_to_array

        kept = df.columns
        scored = self.fitted.transform(df.withColumn("_ngrams", character_ngrams("host", "path", self.sizes)))
        return scored.select(*kept, vector_to_array("_probability")[1].alias("_blocked"))


def train(labelled: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), features: int = 1 << 14, penalty: float = 0.01) -> UrlModel:
    """Fit on a small table of ``url`` and ``label`` (1: unwanted)."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label"))
    rows = rows.withColumn("_ngrams", character_ngrams("host", "path", sizes)).coalesce(1)
    tf = HashingTF(inputCol="_ngrams", outputCol="_features", numFeatures=features, binary=True)
    lr = LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw",
                            predictionCol="_prediction", regParam=penalty, maxIter=100)
    return UrlModel(Pipeline(stages=[tf, lr]).fit(rows), sizes)


def default_labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, 1) for u in BLOCKED_URLS] + [(u, 0) for u in ALLOWED_URLS], "url string, label int")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and ``blocked_score`` of every row.

    The longest rule that fits decides; all other URLs are blocked if the model gives them at least ``threshold``. Null
    URLs and those without ``://`` have an empty host and path and are judged by the model as such. Repeated rows are
    judged each; columns other than page_id and url are not read.
    """
    model = model or train(default_labelled(pages.sparkSession))
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    scored = model.score(rows)
    own = F.when(F.col("_blocked") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
                         F.col("_blocked").alias("blocked_score"))
