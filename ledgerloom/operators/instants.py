"""Problem 1: timestamps of many formats, precisions and zones as one instant in UTC microseconds.

One regular expression, an alternation of every supported format, is matched once per value on the JVM.  Its groups are
written into one delimited text, split once, range-checked, and assembled by integer day arithmetic.  No Python runs on
the rows.  A local time is resolved by trying the two offsets its zone has around it: none fitting means the clocks
skipped it, two fitting means they passed it twice.
"""

from __future__ import annotations

import re
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.skew import broadcast_if_small

_SEP = "\u0001"
_DAY = 86_400_000_000
BLANKS = " \u00a0\u202f\u2007\u2009\u200a\u200b\ufeff\t\r\n"
DASHES = "\u2212\u2010\u2011"

# Month names of the supported languages, without accents, by month number.
MONTHS = {
    1: "january jan enero ene janvier janv januar janner",
    2: "february feb febrero fevrier fevr februar",
    3: "march mar marzo mars marz maerz mrz",
    4: "april apr abril abr avril avr",
    5: "may mayo mai",
    6: "june jun junio juin juni",
    7: "july jul julio juillet juil juli",
    8: "august aug agosto ago aout",
    9: "september sept sep septiembre set septembre",
    10: "october oct octubre octobre oktober okt",
    11: "november nov noviembre novembre",
    12: "december dec diciembre dic decembre dezember dez",
}

# Zone abbreviations as used in a country, as offset seconds or, for loose ones, the zone they follow.
_H = 3600
ABBREVIATIONS = {
    "us": {"est": -5 * _H, "edt": -4 * _H, "cst": -6 * _H, "cdt": -5 * _H, "mst": -7 * _H, "mdt": -6 * _H, "pst": -8 * _H, "pdt": -7 * _H, "akst": -9 * _H, "akdt": -8 * _H, "hst": -10 * _H, "et": "America/New_York", "ct": "America/Chicago", "mt": "America/Denver", "pt": "America/Los_Angeles"},
    "ca": {"nst": -12600, "ndt": -9000, "ast": -4 * _H, "adt": -3 * _H, "est": -5 * _H, "edt": -4 * _H, "cst": -6 * _H, "cdt": -5 * _H, "mst": -7 * _H, "mdt": -6 * _H, "pst": -8 * _H, "pdt": -7 * _H, "nt": "America/St_Johns", "at": "America/Halifax", "et": "America/Toronto", "ct": "America/Winnipeg", "mt": "America/Edmonton", "pt": "America/Vancouver"},
    "gb": {"bst": _H, "wet": 0, "west": _H, "cet": _H, "cest": 2 * _H},
    "ie": {"ist": _H, "bst": _H, "wet": 0, "west": _H},
    "eu": {"cet": _H, "cest": 2 * _H, "mez": _H, "mesz": 2 * _H, "eet": 2 * _H, "eest": 3 * _H, "wet": 0, "west": _H, "msk": 3 * _H, "bst": _H},
    "in": {"ist": 19800},
    "np": {"npt": 20700},
    "au": {"aest": 10 * _H, "aedt": 11 * _H, "est": 10 * _H, "edt": 11 * _H, "acst": 34200, "acdt": 37800, "cst": 34200, "cdt": 37800, "awst": 8 * _H, "wst": 8 * _H, "aet": "Australia/Sydney", "et": "Australia/Sydney", "act": "Australia/Adelaide", "ct": "Australia/Adelaide"},
    "nz": {"nzst": 12 * _H, "nzdt": 13 * _H, "nzt": "Pacific/Auckland"},
    "jp": {"jst": 9 * _H},
    "kr": {"kst": 9 * _H},
    "cn": {"cst": 8 * _H, "hkt": 8 * _H},
    "sg": {"sgt": 8 * _H},
    "ph": {"pst": 8 * _H, "pht": 8 * _H},
    "pk": {"pkt": 5 * _H},
    "il": {"ist": 2 * _H, "idt": 3 * _H},
    "za": {"sast": 2 * _H},
    "br": {"brt": -3 * _H, "brst": -2 * _H},
    "ar": {"art": -3 * _H},
}
# The country of a zone, by the first pattern that fits.
COUNTRY_OF_ZONE = [
    ("ca", "America/(St_Johns|Halifax|Moncton|Glace_Bay|Goose_Bay|Toronto|Montreal|Nipigon|Thunder_Bay|Iqaluit|Winnipeg|Rainy_River|Regina|Swift_Current|Edmonton|Calgary|Yellowknife|Inuvik|Vancouver|Whitehorse|Dawson|Dawson_Creek|Creston|Fort_Nelson|Atikokan|Rankin_Inlet|Resolute|Cambridge_Bay)|Canada/.*"),
    ("br", "America/(Sao_Paulo|Bahia|Fortaleza|Recife|Manaus|Belem|Cuiaba)"),
    ("ar", "America/(Argentina/.*|Buenos_Aires)"),
    ("us", "America/(New_York|Chicago|Denver|Los_Angeles|Phoenix|Anchorage|Juneau|Sitka|Nome|Adak|Boise|Detroit|Menominee|Indiana/.*|Indianapolis|Kentucky/.*|Louisville|North_Dakota/.*|Puerto_Rico)|Pacific/Honolulu|US/.*"),
    ("gb", "Europe/(London|Belfast|Jersey|Guernsey|Isle_of_Man)|GB"),
    ("ie", "Europe/Dublin|Eire"),
    ("eu", "Europe/.*"),
    ("in", "Asia/(Kolkata|Calcutta)"),
    ("np", "Asia/(Kathmandu|Katmandu)"),
    ("au", "Australia/.*"),
    ("nz", "Pacific/(Auckland|Chatham)|NZ"),
    ("jp", "Asia/Tokyo"),
    ("kr", "Asia/Seoul"),
    ("cn", "Asia/(Shanghai|Chongqing|Urumqi|Hong_Kong|Macau|Taipei)"),
    ("sg", "Asia/Singapore"),
    ("ph", "Asia/Manila"),
    ("pk", "Asia/Karachi"),
    ("il", "Asia/(Jerusalem|Tel_Aviv)"),
    ("za", "Africa/Johannesburg"),
]


def pattern() -> tuple[str, str]:
    """The alternation and the replacement that writes its groups, in a fixed order, as delimited text."""
    zone = r"(?:z|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?(?: ?\[[a-z0-9_+/-]+\])?|[a-z_]+(?:/[a-z0-9_+-]+)+|[a-z]{1,5})"
    lead = r"(?:(?:[a-z][a-z ]*?)?(?:posted|updated|published|release|released|issued|date|publie|publicado|veroffentlicht|aktualisiert|actualizado|mis a jour)(?: on| le| el| am)?\s?[:—–-]?\s?)?(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[.,]? )?"
    found: dict[str, list[str]] = {}

    def g(name: str, k: int, body: str) -> str:
        found.setdefault(name, []).append(f"{name}{k}")
        return f"(?<{name}{k}>{body})"

    def clock(k: int) -> str:
        return (
            rf"(?:{g('noon', k, '(?:12 ?)?noon')}|{g('h', k, r'\d{1,2}')}(?::| ?h ?){g('mi', k, r'\d{2}')}(?::{g('s', k, r'\d{2}')}(?:[.,]{g('f', k, r'\d{1,9}')})?)?"
            rf"(?: ?uhr| ?hrs?)?(?: ?{g('ap', k, '[ap]')}[.]?m[.]?(?![a-z]))?)(?: ?{g('z', k, zone)})?"
        )

    def iso_clock(k: int) -> str:
        return rf"{g('h', k, r'\d{2}')}:{g('mi', k, r'\d{2}')}(?::{g('s', k, r'\d{2}')}(?:[.,]{g('f', k, r'\d{1,9}')})?)?(?: ?{g('z', k, zone)})?"

    joiner = r"(?:,? (?:at |a las? |a |um |- |– |— )?|, ?| ?- )"
    forms = [
        f"{g('y', 1, r'\d{4}')}-{g('mo', 1, r'\d{2}')}-{g('d', 1, r'\d{2}')}(?:t|,? ){clock(1)}",
        f"{g('y', 2, r'\d{4}')}-{g('doy', 2, r'\d{3}')}[t ]{iso_clock(2)}",
        f"{g('y', 3, r'\d{4}')}-?w{g('wk', 3, r'\d{2}')}-?{g('wd', 3, r'\d')}[t ]{iso_clock(3)}",
        f"{g('y', 4, r'\d{4}')}{g('mo', 4, r'\d{2}')}{g('d', 4, r'\d{2}')}(?:t| )?{g('h', 4, r'\d{2}')}:?{g('mi', 4, r'\d{2}')}(?::?{g('s', 4, r'\d{2}')}(?:[.,]{g('f', 4, r'\d{1,9}')})?)?(?: ?{g('z', 4, zone)})?",
        f"{lead}{g('d', 5, r'\d{1,2}')}(?:er|st|nd|rd|th|[.])? (?:de )?{g('mon', 5, r'[a-z]{3,10}')}[.]?,? (?:de |del )?{g('y', 5, r'\d{4}|\d{2}')}{joiner}{clock(5)}",
        f"{lead}{g('mon', 6, r'[a-z]{3,10}')}[.]? {g('d', 6, r'\d{1,2}')}(?:st|nd|rd|th)?,? {g('y', 6, r'\d{4}')}{joiner}{clock(6)}",
        f"{lead}{g('n', 7, r'\d{1,2}')}(?:/{g('m', 7, r'\d{1,2}')}/|-{g('m', 8, r'\d{1,2}')}-|[.]{g('m', 9, r'\d{1,2}')}[.]){g('y', 7, r'\d{4}|\d{2}')}{joiner}{clock(7)}",
        f"{g('ep', 8, r'[+-]?\d{9,11}|[+-]?\d{13}|[+-]?\d{16}|[+-]?\d{19}')}(?:[.]{g('epf', 8, r'\d{1,9}')})?",
    ]
    order = ["y", "mo", "d", "doy", "wk", "wd", "mon", "n", "m", "h", "mi", "s", "f", "ap", "noon", "z", "ep", "epf"]
    text = _SEP.join("".join(f"${{{x}}}" for x in found[name]) for name in order)
    return "^(?:" + "|".join(forms) + ")$", "ok" + _SEP + text


_FIELDS = ["ok", "y", "mo", "d", "doy", "wk", "wd", "mon", "n", "m", "h", "mi", "s", "f", "ap", "noon", "z", "ep", "epf"]


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers only (years 1 and later)."""
    y2 = F.when(m <= 2, y - 1).otherwise(y)
    m2 = F.pmod(m + 9, F.lit(12))
    return y2 * 365 + F.floor(y2 / 4) - F.floor(y2 / 100) + F.floor(y2 / 400) + F.floor((m2 * 153 + 2) / 5) + d - 719469


def country_of(zone: str) -> str:
    return next((c for c, rx in COUNTRY_OF_ZONE if re.fullmatch(rx, zone)), "")


def _lookup(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A table of constants, broadcast: at most a few hundred rows that do not depend on any data."""
    line = lambda r: "(" + ", ".join("CAST(NULL AS BIGINT)" if x is None else repr(x) for x in r) + ")"
    return F.broadcast(spark.sql("SELECT * FROM VALUES " + ", ".join(map(line, rows)) + f" AS t({', '.join(names)})"))


def zone_offset(utc_micros: Column, zone: Column) -> Column:
    """Offset in microseconds that ``zone`` has at an instant (rules of the JVM's zone data)."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_micros), zone)) - utc_micros


def normalise_instants(df: DataFrame, text: str = "pub_date", zone: str = "zone_name", day_first: str = "day_first") -> DataFrame:
    """Add ``utc_micros`` (bigint, null unless exactly one instant is named) and ``instant_status``.

    ``df`` carries the value, the zone that applies where the value names none, and the order of all-numeric dates.
    Statuses: ok, unparsed (no supported format with date and time, also null and empty text), bad_date, bad_time,
    no_zone, unknown_zone, skipped, ambiguous, day_order (all-numeric date, order unknown, both readings valid).
    Sub-microsecond digits are cut off; 24:00:00 is midnight at the end of that day; second 60 is rejected.  All other
    columns pass through, whatever their names.  Repeated rows stay repeated.

    Month names, zones and abbreviations are looked up in constant tables; the joins also keep the generated code of each
    step small.
    """
    spark = df.sparkSession
    regex, replacement = pattern()
    zones = [(z.lower(), z, country_of(z)) for z in sorted(available_timezones()) if re.fullmatch(r"[A-Za-z0-9_+/-]+", z)]
    months = [(name, number) for number, names in MONTHS.items() for name in names.split()]
    # Where the country is unknown, only abbreviations with one meaning everywhere are taken.
    meanings: dict[str, set] = {}
    for names in ABBREVIATIONS.values():
        for k, v in names.items():
            meanings.setdefault(k, set()).add(v)
    known = [(c, k, v) for c, names in ABBREVIATIONS.items() for k, v in names.items()] + [("", k, next(iter(v))) for k, v in meanings.items() if len(v) == 1]
    short = [(f"{c}:{k}", v if isinstance(v, int) else None, v if isinstance(v, str) else "") for c, k, v in known]

    clean = F.translate(F.col(f"`{text}`").cast("string"), BLANKS + DASHES + _SEP, " " * len(BLANKS) + "-" * len(DASHES))
    clean = F.translate(F.lower(F.trim(F.regexp_replace(clean, " {2,}", " "))), "áàâäéèêëíïîóôöúùûüçñ", "aaaaeeeeiiiooouuuucn")
    parts = F.split(F.regexp_replace(clean, regex, replacement), _SEP)
    out = df.select(F.struct("*").alias("row"), F.col(f"`{zone}`").alias("local"), F.col(f"`{day_first}`").alias("first"), parts.alias("p"))
    part = {name: F.nullif(F.get("p", F.lit(i)), F.lit("")) for i, name in enumerate(_FIELDS)}
    number = lambda name: part[name].cast("int")
    out = out.select(
        "row", "local", "first", (F.get("p", F.lit(0)) == "ok").alias("ok"), (number("y") + F.when(F.length(part["y"]) == 2, 2000).otherwise(0)).cast("bigint").alias("y"),
        number("mo").alias("mo"), number("d").alias("d"), number("doy").alias("doy"), number("wk").alias("wk"), number("wd").alias("wd"), part["mon"].alias("mon"),
        number("n").alias("n"), number("m").alias("m"), F.when(part["noon"].isNotNull(), 12).otherwise(number("h")).alias("h"),
        F.when(part["noon"].isNotNull(), 0).otherwise(number("mi")).alias("mi"), F.coalesce(number("s"), F.lit(0)).alias("s"),
        F.coalesce(F.substring(F.rpad(part["f"], 9, "0"), 1, 6).cast("bigint"), F.lit(0)).alias("f"), part["ap"].alias("ap"), part["z"].alias("z"), part["ep"].alias("ep"), part["epf"].alias("epf"),
    )
    out = out.join(_lookup(spark, months, "mon", "named_month"), "mon", "left").join(_lookup(spark, zones, "local_low", "local_zone", "country").drop("local_low"), F.col("local") == F.col("local_zone"), "left")

    # Order of day and month in all-numeric dates.
    order = F.coalesce("first", F.when(F.col("n") > 12, True).when((F.col("m") > 12) | (F.col("n") == F.col("m")), False))
    out = out.withColumns(
        {
            "mo": F.coalesce("mo", "named_month", F.when(order, F.col("m")).when(~order, F.col("n"))),
            "d": F.coalesce("d", F.when(order, F.col("n")).when(~order, F.col("m"))),
            "unordered": F.col("n").isNotNull() & order.isNull(),
            "leap": ((F.col("y") % 4 == 0) & (F.col("y") % 100 != 0)) | (F.col("y") % 400 == 0),
            "shortened": F.concat(F.coalesce("country", F.lit("")), F.lit(":"), "z"),
            "offset": F.regexp_extract("z", r"^(?:utc|gmt)?([+-]\d{1,2}(?::?\d{2})?)(?: ?\[.*)?$", 1),
        }
    )
    out = out.join(_lookup(spark, short, "shortened", "short_s", "short_zone"), "shortened", "left").join(_lookup(spark, zones, "z_low", "written_zone", "c2").drop("c2"), F.col("z") == F.col("z_low"), "left")

    # Calendar ranges, then the day: the date itself, or the first of January and an offset from it.
    yearly = F.col("doy").isNotNull() | F.col("wk").isNotNull()
    base = days_from_civil(F.col("y"), F.when(yearly, 1).otherwise(F.col("mo")), F.when(yearly, 1).otherwise(F.col("d")))
    out = out.withColumns({"base": F.when(F.col("y") > 0, base), "digits": F.replace(F.substring("offset", 2, 9), F.lit(":"), F.lit(""))})
    weekday = F.pmod(F.col("base") + 3, F.lit(7))  # of the first of January; Monday is 0
    weeks = F.when((weekday == 3) | (F.col("leap") & (weekday == 2)), 53).otherwise(52)
    length = F.get(F.array(*map(F.lit, (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31))), F.col("mo") - 1) + F.when((F.col("mo") == 2) & F.col("leap"), 1).otherwise(0)
    day = (
        F.when(F.col("doy").isNotNull(), F.when(F.col("doy").between(1, F.when(F.col("leap"), 366).otherwise(365)), F.col("base") + F.col("doy") - 1))
        .when(F.col("wk").isNotNull(), F.when(F.col("wk").between(1, weeks) & F.col("wd").between(1, 7), F.col("base") - weekday + F.when(weekday > 3, 7).otherwise(0) + F.col("wk") * 7 + F.col("wd") - 8))
        .when(F.col("mo").between(1, 12) & F.col("d").between(1, length), F.col("base"))
    )
    half = F.col("ap").isNotNull()
    hour = F.when(half, F.when(F.col("h").between(1, 12), F.col("h") % 12 + F.when(F.col("ap") == "p", 12).otherwise(0))).otherwise(F.when(F.col("h") <= 24, F.col("h")))
    seconds = (hour.cast("bigint") * 60 + F.col("mi")) * 60 + F.col("s")
    clock = F.when(F.col("mi").between(0, 59) & F.col("s").between(0, 59) & (seconds * 1_000_000 + F.col("f") <= F.lit(_DAY)), seconds * 1_000_000 + F.col("f"))
    hours = F.when(F.length("digits") > 2, F.expr("left(digits, length(digits) - 2)")).otherwise(F.col("digits")).try_cast("int")
    minutes = F.when(F.length("digits") > 2, F.expr("right(digits, 2)")).otherwise(F.lit("0")).try_cast("int")
    written = F.when((hours <= 18) & (minutes <= 59), (hours * 60 + minutes) * F.when(F.substring("offset", 1, 1) == "-", -60).otherwise(60))
    loose = F.when((F.col("z") == "mt") & (F.col("local") == "America/Phoenix"), F.col("local")).otherwise(F.nullif("short_zone", F.lit("")))
    out = out.select(
        "row", "ok", "ep", "epf", "z", "unordered", day.alias("day"), clock.alias("clock"),
        F.when(F.col("z").isin("z", "utc", "gmt", "ut"), F.lit(0)).when(F.col("offset") != "", written).otherwise(F.col("short_s")).cast("bigint").alias("fixed"),
        F.when(F.col("z").isNull(), F.col("local_zone")).when(F.col("offset") != "", F.lit(None)).otherwise(F.coalesce("written_zone", loose)).alias("zone"),
    ).withColumn("wall", F.col("day") * F.lit(_DAY) + F.col("clock"))

    # A local time fits an instant if the zone's offset at that instant leads back to it.
    wall, at = F.col("wall"), F.when(F.col("fixed").isNull(), F.col("zone"))
    out = out.withColumns({"u1": wall - zone_offset(wall - F.lit(_DAY), at), "u2": wall - zone_offset(wall + F.lit(_DAY), at)})
    out = out.withColumns({"v1": F.col("u1") + zone_offset(F.col("u1"), at) == wall, "v2": F.col("u2") + zone_offset(F.col("u2"), at) == wall})
    unlike = F.col("u1") != F.col("u2")
    size = F.length(F.regexp_replace("ep", "[+-]", ""))
    scale = F.when(size == 19, F.lit(-3)).when(size == 16, F.lit(0)).when(size == 13, F.lit(3)).otherwise(F.lit(6))
    finer = F.when(scale > 0, F.expr("substring(rpad(coalesce(epf, ''), 6, '0'), 1, CASE WHEN length(regexp_replace(ep, '[+-]', '')) = 13 THEN 3 ELSE 6 END)").cast("bigint")).otherwise(F.lit(0))
    epoch = F.when(scale < 0, F.floor(F.col("ep").cast("decimal(20,0)") / 1000).cast("bigint")).otherwise(F.col("ep").cast("bigint") * F.when(scale == 3, 1000).when(scale == 6, 1_000_000).otherwise(1) + finer)
    status = (
        F.when(~F.coalesce("ok", F.lit(False)), "unparsed").when(F.col("ep").isNotNull(), "ok").when(F.col("unordered"), "day_order")
        .when(F.col("day").isNull(), "bad_date").when(F.col("clock").isNull(), "bad_time").when(F.col("fixed").isNotNull(), "ok")
        .when(F.col("zone").isNull(), F.when(F.col("z").isNull(), "no_zone").otherwise("unknown_zone"))
        .when(F.col("v1") & F.col("v2") & unlike, "ambiguous").when(F.col("v1") | F.col("v2"), "ok").otherwise("skipped")
    )
    out = out.withColumn("status", status)
    value = F.when(F.col("ep").isNotNull(), epoch).when(F.col("fixed").isNotNull(), wall - F.col("fixed") * 1_000_000).when(F.col("v1"), F.col("u1")).otherwise(F.col("u2"))
    return out.select("row.*", F.when(F.col("status") == "ok", value).alias("utc_micros"), F.col("status").alias("instant_status"))


def release_instants(releases: DataFrame, feeds: DataFrame) -> DataFrame:
    """Releases with their feed's zone and day order, and the normalised instant; feeds are joined by ``feed_id``.

    Only the three columns needed are read.  A release whose feed is unknown has neither zone nor day order.
    """
    feeds = feeds.select("feed_id", "zone_name", "day_first").dropDuplicates(["feed_id"])
    rows = releases.select("release_id", "feed_id", "pub_date").join(broadcast_if_small(feeds), "feed_id", "left")
    return normalise_instants(rows)


def found_instants(releases: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row per release that names exactly one instant; rows of one release that disagree name none."""
    # Filtering after the aggregation only: a filter on the instant ahead of it would be pushed down to the scan with the
    # whole normalisation written out in it, and computed twice.
    rows = release_instants(releases, feeds).where("release_id IS NOT NULL")
    one = rows.groupBy("release_id").agg(F.min("utc_micros").alias("utc_micros"), F.max("utc_micros").alias("_m"))
    return one.where("utc_micros = _m").drop("_m")
