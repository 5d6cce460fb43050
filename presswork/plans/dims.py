"""Curated dimensions. Order is meaningful and becomes column ord."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the domain: topics, sources and the feed of each (topic, source).
TOPICS = (
    "Tech/AI", "US Politics", "Morocco Politics", "French Politics", "Geopolitics", "Morocco", "Morocco Finance",
    "US Finance", "World Finance", "European Football", "Basketball", "Tennis", "American Football",
)
SOURCES = (
    "NYT", "BBC", "TechCrunch", "The Verge", "Ars Technica", "Engadget", "Wired", "ZDNet", "The Hill", "Politico",
    "Axios", "Hespress (EN)", "Hespress (FR)", "Le360", "Le Monde", "Le Figaro", "France24", "RFI (EN)", "RFI (FR)",
    "The Guardian", "Al Jazeera", "DW", "The North Africa Post", "Medias24", "Challenge.ma", "Le Boursier", "CNBC",
    "MarketWatch", "Yahoo Finance", "Bloomberg", "Financial Times", "The Economist", "Sky Sports", "ESPN",
    "Football Italia", "Marca", "RMC Sport", "Kicker", "Transfermarkt", "The Athletic", "Yahoo Sports", "CBS Sports",
    "RotoWire", "Hoops Rumors", "Tennis365", "Tennis Majors", "UbiTennis", "Pro Football Talk",
)
FEEDS = (
    ("Tech/AI", "NYT", "https://rss.nytimes.com/services/xml/rss/nyt/Technology.xml"),
    ("Tech/AI", "BBC", "http://feeds.bbci.co.uk/news/technology/rss.xml"),
    ("Tech/AI", "TechCrunch", "https://techcrunch.com/feed/"),
    ("Tech/AI", "The Verge", "https://www.theverge.com/rss/index.xml"),
    ("Tech/AI", "Ars Technica", "https://feeds.arstechnica.com/arstechnica/index"),
    ("Tech/AI", "Engadget", "https://www.engadget.com/rss.xml"),
    ("Tech/AI", "Wired", "https://www.wired.com/feed/rss"),
    ("Tech/AI", "ZDNet", "https://www.zdnet.com/news/rss.xml"),
    ("US Politics", "NYT", "https://rss.nytimes.com/services/xml/rss/nyt/Politics.xml"),
    ("US Politics", "The Hill", "https://thehill.com/feed/"),
    ("US Politics", "Politico", "https://rss.politico.com/politics-news.xml"),
    ("US Politics", "Axios", "https://www.axios.com/feeds/feed.rss"),
    ("Morocco Politics", "Hespress (EN)", "https://en.hespress.com/politics/feed"),
    ("Morocco Politics", "Hespress (FR)", "https://fr.hespress.com/politique/feed"),
    ("Morocco Politics", "Le360", "https://fr.le360.ma/arc/outboundfeeds/rss/category/politique/?outputType=xml"),
    ("French Politics", "Le Monde", "https://www.lemonde.fr/politique/rss_full.xml"),
    ("French Politics", "Le Figaro", "https://www.lefigaro.fr/rss/figaro_politique.xml"),
    ("French Politics", "France24", "https://www.france24.com/en/rss"),
    ("French Politics", "RFI (EN)", "https://www.rfi.fr/en/rss"),
    ("French Politics", "RFI (FR)", "https://www.rfi.fr/fr/france/rss"),
    ("Geopolitics", "BBC", "http://feeds.bbci.co.uk/news/world/rss.xml"),
    ("Geopolitics", "NYT", "https://rss.nytimes.com/services/xml/rss/nyt/World.xml"),
    ("Geopolitics", "The Guardian", "https://www.theguardian.com/world/rss"),
    ("Geopolitics", "Al Jazeera", "https://www.aljazeera.com/xml/rss/all.xml"),
    ("Geopolitics", "DW", "https://rss.dw.com/xml/rss-en-world"),
    ("Morocco", "Hespress (EN)", "https://en.hespress.com/feed"),
    ("Morocco", "Hespress (FR)", "https://fr.hespress.com/feed"),
    ("Morocco", "The North Africa Post", "https://northafricapost.com/feed"),
    ("Morocco", "Le360", "https://fr.le360.ma/arc/outboundfeeds/rss/?outputType=xml"),
    ("Morocco", "Medias24", "https://medias24.com/feed"),
    ("Morocco", "Challenge.ma", "https://www.challenge.ma/feed"),
    ("Morocco Finance", "Medias24", "https://medias24.com/?feed=rss2&cat=12575"),
    ("Morocco Finance", "Le Boursier", "https://medias24.com/?feed=rss2&cat=14390"),
    ("Morocco Finance", "Challenge.ma", "https://www.challenge.ma/bourse/feed"),
    ("Morocco Finance", "Le360", "https://fr.le360.ma/arc/outboundfeeds/rss/category/economie/?outputType=xml"),
    ("US Finance", "CNBC", "https://www.cnbc.com/id/10000664/device/rss/rss.html"),
    ("US Finance", "MarketWatch", "https://feeds.content.dowjones.io/public/rss/mw_topstories"),
    ("US Finance", "Yahoo Finance", "https://finance.yahoo.com/news/rssindex"),
    ("US Finance", "Bloomberg", "https://feeds.bloomberg.com/markets/news.rss"),
    ("World Finance", "Financial Times", "https://www.ft.com/rss/home"),
    ("World Finance", "The Economist", "https://www.economist.com/finance-and-economics/rss.xml"),
    ("World Finance", "Bloomberg", "https://feeds.bloomberg.com/markets/news.rss"),
    ("World Finance", "Al Jazeera", "https://www.aljazeera.com/xml/rss/all.xml"),
    ("European Football", "BBC", "http://feeds.bbci.co.uk/sport/football/rss.xml"),
    ("European Football", "Sky Sports", "https://www.skysports.com/rss/11095"),
    ("European Football", "ESPN", "https://www.espn.com/espn/rss/soccer/news"),
    ("European Football", "The Guardian", "https://www.theguardian.com/football/rss"),
    ("European Football", "Football Italia", "https://www.football-italia.net/feed"),
    ("European Football", "Marca", "https://e00-marca.uecdn.es/rss/en/football.xml"),
    ("European Football", "RMC Sport", "https://rmcsport.bfmtv.com/rss/football/"),
    ("European Football", "Kicker", "https://newsfeed.kicker.de/news/bundesliga"),
    ("European Football", "Transfermarkt", "https://www.transfermarkt.com/rss/news"),
    ("European Football", "The Athletic", "https://www.nytimes.com/athletic/rss/football/"),
    ("Basketball", "ESPN", "https://www.espn.com/espn/rss/nba/news"),
    ("Basketball", "Yahoo Sports", "https://sports.yahoo.com/nba/rss/"),
    ("Basketball", "CBS Sports", "https://www.cbssports.com/rss/headlines/nba/"),
    ("Basketball", "RotoWire", "https://www.rotowire.com/rss/news.php?sport=nba"),
    ("Basketball", "Hoops Rumors", "https://www.hoopsrumors.com/feed"),
    ("Tennis", "ESPN", "https://www.espn.com/espn/rss/tennis/news"),
    ("Tennis", "BBC", "http://feeds.bbci.co.uk/sport/tennis/rss.xml"),
    ("Tennis", "Tennis365", "https://www.tennis365.com/feed/"),
    ("Tennis", "Tennis Majors", "https://www.tennismajors.com/feed/"),
    ("Tennis", "UbiTennis", "https://www.ubitennis.com/feed/"),
    ("American Football", "ESPN", "https://www.espn.com/espn/rss/nfl/news"),
    ("American Football", "CBS Sports", "https://www.cbssports.com/rss/headlines/nfl/"),
    ("American Football", "Yahoo Sports", "https://sports.yahoo.com/nfl/rss/"),
    ("American Football", "Pro Football Talk", "https://profootballtalk.nbcsports.com/feed/"),
    ("American Football", "Sky Sports", "https://www.skysports.com/rss/12118"),
)
# USD per million tokens, cache multipliers, and the promotion with its first and last UTC day.
PRICES = (("large", 3.0, 15.0, 0.1, 1.25), ("small", 1.0, 5.0, 0.1, 1.25))
PROMOS = (("large", "2026-01-01", "2026-08-31", 2.0, 10.0),)


def slug(topic: str) -> str:
    return topic.lower().replace("/", "-").replace(" ", "-")


def dim_topic(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i, slug(t)) for i, t in enumerate(TOPICS)], "topic string, ord int, slug string")


def dim_source(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(SOURCES)], "source string, ord int")


def feed_rows() -> list[tuple[str, str, str, int]]:
    return [(*feed, i) for i, feed in enumerate(FEEDS)]


def dim_feed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(feed_rows(), "topic string, source string, url string, feed_ord int")


def dim_price(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model string, input double, output double, cache_read double, cache_write double")


def dim_promo(spark: SparkSession) -> DataFrame:
    out = spark.createDataFrame(list(PROMOS), "model string, from_day string, through_day string, promo_input double, promo_output double")
    return out.withColumn("from_day", F.to_date("from_day")).withColumn("through_day", F.to_date("through_day"))


def values_sql(rows: list[tuple], names: str) -> str:
    """The dimension as a VALUES list, for the SQL oracles."""
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS v({names})"
