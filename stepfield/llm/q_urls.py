"""op2: every page's url judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfield.llm import urls
from stepfield.llm.common import table

RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]
#: Host words of unwanted sites, which label the training URLs.
UNWANTED = ("spam", "pills", "casino", "viagra", "porn", "warez", "malware", "phish", "betting", "cheap", "adult", "ads-")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled URLs: those of hosts with an unwanted word are 1, all others 0. No feature reads words, so trees carry the label over to
    hosts of like form; see the test on sites not seen in training."""
    host, path = urls.split_url(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumns({"host": host, "path": path})
    model = urls.fit(pages.select("url", F.col("host").rlike("|".join(UNWANTED)).cast("int").alias("label")))
    rule, action = urls.decide(F.col("host"), F.col("path"), RULES)
    scored = urls.add_probability(pages, model)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_probability")


QUERIES = {"op2_url_filters": op2_url_filters}
ORACLE: dict[str, str] = {}
