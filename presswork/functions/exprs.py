"""Column expressions of the model. All are built-in functions, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the model's trim removes, and the constants of the 32-bit FNV-1a hash.
SPACES = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
FNV_BASIS, FNV_PRIME, PALETTE = 0x811C9DC5, 16777619, 6
# Fixed values of mail headers: the months, and the hours of zone names from UTC; none is UTC.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {"": 0, "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
COLUMNS, BANDS = 6, {"hero": (1, 6, 2), "medium": (2, 3, 2), "small": (3, 2, 1)}


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def strip_html(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, "<[^>]*>", ""))


def _written_date(raw: Column) -> Column:
    """Epoch seconds of a date as mail headers or English text write it: weekday, seconds, time and zone may be absent, the
    hour may have one digit and the year two; null where a part is out of range or the zone unknown."""
    weekday = r"^\s*(?:[A-Za-z]{3,9}\.?,?\s+)?"
    clock = r"(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?\s*([A-Za-z]*|[+-]\d{2}:?\d{2})\s*(?:\([^)]*\))?\s*$"
    mail = weekday + r"(\d{1,2})[\s-]+([A-Za-z]{3})[a-z]*\.?[\s-]+(\d{4}|\d{2})" + clock
    english = weekday + r"([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})" + clock
    told = F.when(raw.rlike(mail), F.regexp_replace(raw, mail, "$3|$2|$1|$4|$5|$6|$7")).when(raw.rlike(english), F.regexp_replace(raw, english, "$3|$1|$2|$4|$5|$6|$7"))
    hours = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))

    def seconds(p: Column) -> Column:
        part = lambda k: F.get(p, F.lit(k))
        year = F.when(F.length(part(0)) == 4, part(0)).otherwise(F.concat(F.when(part(0) < "50", "20").otherwise("19"), part(0)))
        at = F.instr(F.lit("".join(MONTHS)), F.lower(part(1)))
        time = F.concat_ws(":", *(F.when(part(k) == "", "0").otherwise(part(k)) for k in (3, 4, 5)))
        day = F.concat_ws("-", year, ((at + 2) / 3).cast("int").cast("string"), part(2))
        zone = F.upper(part(6))
        minutes = F.substring(zone, 2, 2).cast("int") * 60 + F.right(zone, F.lit(2)).cast("int")
        offset = F.when(zone.startswith("-"), minutes * -60).when(zone.startswith("+"), minutes * 60).otherwise(F.try_element_at(hours, zone) * 3600)
        return F.when(at % 3 == 1, F.unix_timestamp(F.try_to_timestamp(F.concat(day, F.lit(" "), time, F.lit("Z")))) - offset)

    # Bound as the element of an array, so the parts are found once and the generated code stays small.
    return F.get(F.transform(F.array(F.split(told, r"\|")), seconds), F.lit(0))


def published_or_now(raw: Column, now_s: Column) -> Column:
    """Epoch seconds of an ISO, RFC 822 or English date; now where it is missing or cannot be read."""
    colon = F.regexp_replace(F.trim(raw), r"([+-]\d{2})(\d{2})$", "$1:$2")
    colon = F.regexp_replace(colon, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?![\d:])", "$1:00")
    iso = F.when(colon.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]|$)"), F.try_to_timestamp(F.translate(colon, "T", " ")))
    return F.coalesce(F.unix_timestamp(iso), _written_date(raw), now_s)


def article_text(title: Column, snippet: Column) -> Column:
    return F.concat(title, F.lit(". "), snippet)


def clip(c: Column, points: int) -> Column:
    return F.substring(c, 1, points)


def cluster_text(articles: Column) -> Column:
    """articles: ordered array of structs with title and snippet."""
    return F.array_join(F.transform(articles, lambda a: F.concat(a["title"], F.lit(". "), clip(a["snippet"], 200))), " ")


def cluster_context(articles: Column) -> Column:
    return F.array_join(F.transform(articles, lambda a: F.concat(F.lit("- "), a["title"], F.lit("\n  "), clip(a["snippet"], 200))), "\n")


def source_text(articles: Column, most: int | None = 1200) -> Column:
    """most=None is the uncapped form for expanded reports."""

    def one(a: Column) -> Column:
        snippet = a["snippet"] if most is None else clip(a["snippet"], most)
        return F.concat(F.lit("Source: "), a["source"], F.lit("\nTitle: "), a["title"], F.lit("\n"), snippet)

    return F.array_join(F.transform(articles, one), "\n\n")


def candidate_line(index: Column, topic: Column, severity: Column, text: Column) -> Column:
    return F.concat(index.cast("string"), F.lit(". ["), topic, F.lit(", severity "), severity.cast("string"), F.lit("] "), clip(text, 300))


def flatten_text(c: Column, points: int) -> Column:
    flat = trim_ws(F.translate(F.regexp_replace(c, f"[{SPACES}]+", " "), '"', "'"))
    return F.when(F.length(flat) > points, F.concat(clip(flat, points), F.lit("…"))).otherwise(flat)


def cosine(a: Column, b: Column) -> Column:
    """The dot product in double: inputs are unit vectors, or a centroid that is left as it is."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def looks_complete(c: Column) -> Column:
    return trim_ws(c).rlike(r"[.!?][\"')\]]?\z")


def generation_disposition(text1: Column, stop1: Column, text2: Column) -> Column:
    """What becomes of a generation from its first attempt and, where there is one, its retry."""
    empty = lambda c: trim_ws(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(empty(text1), "failed_empty")
        .when(looks_complete(text1), "first")
        .when(~stop1.eqNullSafe(F.lit("end_turn")), "failed_truncated")
        .when(text2.isNull(), "to_retry")
        .when(~empty(text2) & looks_complete(text2), "retry")
        .otherwise("failed_retry")
    )


def writer_route(n_articles: Column) -> Column:
    return F.when(n_articles == 1, "small").otherwise("large")


def clean_labels(labels: Column) -> Column:
    return F.filter(F.transform(labels, trim_ws), lambda x: x != "")


def normalize_usage(given_in: Column, given_out: Column, cache_read: Column, cache_write: Column) -> Column:
    """A tokens struct, or null if the record is unmeasured. Absent cache counts are 0; bad ones spoil the record."""

    def good(c: Column) -> Column:
        d = c.cast("double")
        return (d >= 0) & ~F.isnan(d) & (d < F.lit(float("inf")))

    fine = good(given_in) & good(given_out) & F.coalesce(good(cache_read), F.lit(True)) & F.coalesce(good(cache_write), F.lit(True))
    zero = F.lit(0).cast("bigint")
    tokens = F.struct(
        given_in.cast("bigint").alias("input"),
        given_out.cast("bigint").alias("output"),
        F.coalesce(cache_read.cast("bigint"), zero).alias("cache_read"),
        F.coalesce(cache_write.cast("bigint"), zero).alias("cache_write"),
    )
    return F.when(fine, tokens)


def token_cost(tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column, rate_in: Column, rate_out: Column, read_factor: Column, write_factor: Column) -> Column:
    spent = tokens_in * rate_in + cache_write * rate_in * write_factor + cache_read * rate_in * read_factor
    return (spent + tokens_out * rate_out) / 1000000.0


def utc_date(epoch_s: Column) -> Column:
    return F.to_date(F.timestamp_seconds(epoch_s))


def plausible_cursor(cursor_s: Column, now_s: Column) -> Column:
    return cursor_s <= now_s + 300


def label_bucket(label: Column) -> Column:
    """1..6: FNV-1a over the UTF-16 units of the trimmed lower-case label."""
    units = F.regexp_extract_all(F.hex(F.encode(F.lower(trim_ws(label)), "UTF-16BE")), F.lit("([0-9A-F]{4})"))
    step = lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("bigint")) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF))
    return (F.aggregate(units, F.lit(FNV_BASIS).cast("bigint"), step) % PALETTE + 1).cast("int")


def _rounded(c: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(c + 0.5)))


def tier_for_severity(severity: Column) -> Column:
    s = _rounded(severity, 1, 5)
    return F.when(s == 5, "hero").when(s >= 3, "medium").otherwise("small")


def tier_for_rank(rank: Column) -> Column:
    r = _rounded(rank, 1, 6)
    return F.when(r == 1, "hero").when(r <= 5, "medium").otherwise("small")


def recency_bucket(at_s: Column, now_s: Column) -> Column:
    minutes = F.floor((now_s - at_s) / 60 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, say(minutes, "m")).when(hours < 24, say(hours, "h")).otherwise(say(days, "d"))


def valid_date(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{2}-\d{2}$")


def valid_uuid(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$|^0{8}-0{4}-0{4}-0{4}-0{12}$|^f{8}-f{4}-f{4}-f{4}-f{12}$")
