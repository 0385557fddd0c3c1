"""URL filters: allow and block rules first, then logistic regression on hashed character n-grams.

Everything on the main path is a DataFrame or SQL function. The model is trained from a small labelled
URL table (at most MAX_LABELLED rows) by one SQL expression: stochastic gradient descent as an aggregate over
(epoch, example) steps whose state is the weight array. Scoring is one projection without a shuffle; what
it carries is the weight array, DIMENSIONS doubles at any input size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import ascii_lower

DIMENSIONS = 1024
GRAMS = (3, 4)
EPOCHS = 30
RATE = 0.15
SHRINK = 1e-4
MAX_LABELLED = 2000

#: (verdict, host, path). Fixed values of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: The small labelled URL table: 1 is unwanted. Fixed values.
UNWANTED = """
http://casino-win.test.com/en/4033.html http://www.casino-royal.test.net/play/12 https://m.online-casino.test.com/de/77#top
https://free-bets.test.com/en/5462 http://sport-bets.test.org/odds/3 https://bets-today.test.net/es/910?ref=x
https://www.cheap-pills.test.com/de/6652.html http://pills-shop.test.net/buy/1 https://m.cheap-meds.test.com/order/22
http://ads-track.test.com/en/9823 https://track-ads.test.net/click?id=9 http://banner-ads.test.com/c/1
http://win-big.test.com/slots/8 https://free-spins.test.net/bonus/2 http://jackpot-win.test.com/fr/11
http://cheap-loans.test.com/apply/1 https://payday-loans.test.net/now/4 http://fast-cash.test.com/en/6
http://poker-bonus.test.com/table/5 https://slot-games.test.net/win/9 http://bet-bonus.test.com/en/17
http://replica-watch.test.net/sale/3 https://cheap-bags.test.com/sale/6 http://click-track.test.com/r/8
http://free-prize.test.com/claim/1 http://adult-cams.test.net/live/2 https://hot-singles.test.com/meet/3
""".split()
WANTED = """
http://www.thering.test.com/en/1291/ https://blog.tionsh.test.com/en/7617/ http://m.theron.test.net/en/6648/
https://theran.test.com/en/8824 https://ththan.test.net/es/7944?page=2 http://tiontion.test.net/en/7817
https://news.daily.test.com/world/2 http://wiki.garden.test.net/plants/71 https://www.library.test.com/catalogue/9
https://school.lessons.test.net/math/4 http://museum.city.test.com/en/12 https://weather.north.test.net/today/
http://m.ththth.test.net/es/2547/ https://www.therer.test.com/en/2337.html http://blog.thernt.test.com/en/6248
https://recipes.kitchen.test.net/soup/8 http://science.notes.test.com/article/31 https://travel.coast.test.net/guide/6
http://www.ththst.test.com/en/1837/ https://m.ththes.test.net/en/873 https://blog.theror.test.com/en/1373#top
http://history.archive.test.com/letters/1900 https://music.review.test.net/album/15 http://code.manual.test.com/api/2
https://health.clinic.test.net/advice/3 http://www.ththing.test.net/en/7442 https://therwh.test.com/en/7855.html
""".split()


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ://."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits, else nulls. Of equally long rules block wins, then the smaller string."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def features(host: Column, path: Column) -> Column:
    """Distinct feature numbers of the n-grams of host and path, 1 to DIMENSIONS - 1; 0 is the bias."""

    def grams(text: Column, n: int, tag: str) -> Column:
        # Characters as an array, in which a place is found at once however long the url is.
        chars = F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit("(?s)."), F.lit(0))
        starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1)))
        cut = F.transform(F.array(chars), lambda c: F.transform(starts, lambda i: F.concat(F.lit(tag), *(F.try_element_at(c, i + k) for k in range(n)))))
        return F.when(F.size(chars) >= n, F.element_at(cut, 1)).otherwise(F.array().cast("array<string>"))

    every = F.concat(*(grams(part, n, tag) for part, tag in ((host, "h"), (path, "p")) for n in GRAMS))
    numbers = F.transform(every, lambda g: (F.pmod(F.xxhash64(g), F.lit(DIMENSIONS - 1)) + 1).cast("int"))
    return F.array_distinct(F.concat(F.array(F.lit(0)), numbers))


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [(u, 1) for u in UNWANTED] + [(u, 0) for u in WANTED]
    return spark.createDataFrame(rows, "url string, label int")


def train(labelled: DataFrame) -> list[float]:
    """Weights by stochastic gradient descent over (url, label), at most MAX_LABELLED rows; null labels are left out.

    Examples go in the order of a hash of the url, so that reruns agree. An empty table gives zero weights.
    """
    if (n := labelled.limit(MAX_LABELLED + 1).count()) > MAX_LABELLED:
        raise ValueError(f"the labelled table may have {MAX_LABELLED} rows; it has more")
    if not n:
        return [0.0] * DIMENSIONS
    host, path = split_url(F.col("url"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.when(F.array_contains("x", i), 1.0).otherwise(0.0))
    examples = (
        labelled.where("label is not null").select("url", F.col("label").cast("double").alias("y"), features(host, path).alias("x")).select("url", "y", dense.alias("x"))
        .agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("url").alias("at"), "url", "y", "x"))).alias("rows"))
    )
    steps = F.sequence(F.lit(0), F.lit(n * EPOCHS - 1))
    zero = F.array_repeat(F.lit(0.0), DIMENSIONS)

    def dot(w: Column, x: Column) -> Column:
        return F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def step(w: Column, t: Column) -> Column:
        row = F.element_at("rows", (t % F.size("rows") + 1).cast("int"))
        miss = F.lit(1.0) / (F.lit(1.0) + F.exp(-dot(w, row["x"]))) - row["y"]
        # The miss is bound once, as a one-element array, else it would be computed for every weight.
        return F.element_at(F.transform(F.array(miss), lambda g: F.zip_with(w, row["x"], lambda a, b: a * (1 - SHRINK) - RATE * g * b)), 1)

    return list(examples.select(F.aggregate(steps, zero, step).alias("w")).first()["w"])


def url_filter(pages: DataFrame, weights: Sequence[float], url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add host, path, rule, verdict and p_unwanted to every row.

    Null url, or one without ://, has empty host and path, and fits no rule; the model still judges it (by the
    bias and the edge grams). Columns of these five names that the input has already are replaced; repeated rows stay.
    """
    host, path = split_url(F.col(url))
    base = pages.drop(*(c for c in ("host", "path", "rule", "verdict", "p_unwanted") if c != url))
    w = F.lit(list(weights)).cast("array<double>")
    margin = F.aggregate(features(host, path), F.lit(0.0), lambda s, i: s + F.element_at(w, i + 1))
    name, verdict = best_rule(host, path, rules)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    return base.select(
        "*", host.alias("host"), path.alias("path"), name.alias("rule"),
        F.coalesce(verdict, F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("p_unwanted"),
    )
