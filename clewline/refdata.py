"""Reference tables as local relations.

Tables here are fixed in size, so Spark sees their exact byte size and decides itself
whether a join broadcasts them (``spark.sql.autoBroadcastJoinThreshold``). Larger lists
are read by path and get the same treatment from their file size; no operator forces a
broadcast.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .session import materialise

# --- Fixed values: TLDs with a high phishing score, list version tld_black-2026Q2 ---
HIGH_PHISHING_TLDS = (
    "bond", "cam", "cc", "cfd", "click", "cyou", "fit", "fyi", "garden", "help", "homes", "icu", "ink",
    "lat", "life", "mom", "one", "pics", "pro", "rest", "sbs", "shop", "top", "vip", "xin", "xyz",
)
TLD_LIST_VERSION = "tld_black-2026Q2"

# --- Fixed values: free hosting providers by service type ---
FREE_HOSTING = {
    "SERVERLESS": ("deno.dev", "netlify.app", "pages.dev", "run.app", "vercel.app", "workers.dev"),
    "HOSTING": ("appspot.com", "azurewebsites.net", "blogspot.com", "firebaseapp.com", "github.io", "gitlab.io",
                "glitch.me", "herokuapp.com", "onrender.com", "surge.sh", "web.app", "wordpress.com"),
    "DDNS": ("ddns.net", "duckdns.org", "dynu.net", "hopto.org", "myftp.org", "no-ip.biz", "no-ip.info",
             "no-ip.org", "sytes.net", "zapto.org"),
    "TUNNEL": ("loca.lt", "ngrok-free.app", "ngrok.io", "trycloudflare.com"),
}

# --- Fixed values: link shortener domains used for redirect journeys ---
JOURNEY_SHORTENERS = (
    "bit.ly", "buff.ly", "cutt.ly", "goo.gl", "han.gl", "is.gd", "ow.ly", "rb.gy", "rebrand.ly",
    "shorturl.at", "t.co", "tinyurl.com", "url.kr", "vo.la",
)

# --- Fixed values: file extensions by role in a double extension ---
DECEPTIVE_EXTENSIONS = (
    "7z", "avi", "bmp", "cell", "csv", "doc", "docx", "gif", "gz", "hwp", "hwpx", "hwt", "ico", "jpeg", "jpg",
    "mkv", "mov", "mp3", "mp4", "pdf", "png", "ppt", "pptx", "rar", "rtf", "show", "svg", "tar", "txt", "wav",
    "webp", "wmv", "xls", "xlsx", "zip",
)
DANGEROUS_EXTENSIONS = (
    "apk", "arc", "arm", "arm5", "arm6", "arm7", "bash", "bat", "cmd", "cpl", "dex", "dll", "dmg", "exe", "hta",
    "i586", "i686", "img", "iso", "jar", "js", "jse", "lnk", "m68k", "mips", "mpsl", "msi", "pif", "pkg", "ppc",
    "ps1", "psm1", "reg", "scr", "sh", "sh4", "spc", "sys", "vbe", "vbs", "vhd", "wsf", "wsh", "x86",
)

# --- Fixed values: download extensions and MIME types treated as executable ---
DOWNLOAD_EXTENSIONS = (
    "apk", "bat", "cmd", "com", "dll", "exe", "hta", "iso", "jar", "js", "jse", "lnk", "msi", "pif", "ps1",
    "scr", "vbs", "wsf",
)
EXECUTABLE_MIMES = ("application/x-dosexec", "application/x-executable", "application/x-msdownload")
MIME_ALIASES = (
    ("application/javascript", "text/plain"), ("application/json", "text/plain"),
    ("text/css", "text/plain"), ("text/html", "text/xml"),
)

# --- Fixed values: look-alike letters and the Latin letter each is compared as ---
CONFUSABLES = {
    # Cyrillic
    "а": "a", "в": "b", "г": "r", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ь": "b", "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "һ": "h",
    "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Greek
    "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x",
    # Armenian
    "գ": "g", "հ": "h", "ո": "n", "ս": "u", "ր": "r", "օ": "o",
    # Cherokee
    "Ꭰ": "a", "Ꮞ": "s", "Ꮢ": "l",
}

# --- Fixed values: policy tables for fields and script APIs ---
FIELD_TYPES = {"email": "email", "password": "password"}
FIELD_AUTOCOMPLETE = {"current-password": "password", "email": "email", "new-password": "password", "username": "username"}
FIELD_TOKENS = {
    "email": ("e-mail", "email"),
    "password": ("passcode", "passwd", "password"),
    "username": ("login", "user-id", "user_name", "userid", "username"),
}
SCRIPT_APIS = {
    "dynamic_execution": ("Function", "eval"),
    "decode": ("atob", "decodeURIComponent", "unescape"),
    "network": ("XMLHttpRequest.open", "fetch", "navigator.sendBeacon"),
    "redirect": ("location.assign", "location.href", "location.replace", "window.location"),
    "environment": ("navigator.languages", "navigator.plugins", "navigator.webdriver", "window.chrome"),
}

# --- Fixed values: IPv4 blocks that are not globally reachable (first address, prefix length) ---
NON_GLOBAL_BLOCKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Small local relation from Python rows; ``names`` is a DDL-like list of columns."""
    cols = names.split()
    data = {c: [r[i] for r in rows] for i, c in enumerate(cols)}
    return spark.createDataFrame(pa.table(data))


def tlds(spark: SparkSession) -> DataFrame:
    return table(spark, [(t, TLD_LIST_VERSION) for t in HIGH_PHISHING_TLDS], "tld list_version")


def free_hosting(spark: SparkSession) -> DataFrame:
    return table(spark, [(d, c) for c, ds in FREE_HOSTING.items() for d in ds], "provider category")


def shorteners(spark: SparkSession, domains=JOURNEY_SHORTENERS) -> DataFrame:
    return table(spark, [(d,) for d in domains], "domain") if domains else spark.sql("SELECT '' AS domain WHERE false")


def extension_roles(spark: SparkSession) -> DataFrame:
    rows = [(e, "DECEPTIVE") for e in DECEPTIVE_EXTENSIONS] + [(e, "DANGEROUS") for e in DANGEROUS_EXTENSIONS]
    return table(spark, rows, "extension role")


def script_apis(spark: SparkSession) -> DataFrame:
    return table(spark, [(k, a) for k, apis in SCRIPT_APIS.items() for a in apis], "kind api")


#: Sections of a suffix list, in the order of their bits.
SUFFIX_SECTIONS = ("icann", "private", "supplement")


@dataclass(frozen=True)
class SuffixIndex:
    """One row per suffix name; ``flags`` has three bits a section (1 plain, 2 wildcard below it, 4 exception)."""

    frame: DataFrame
    depth: int
    sections: tuple[str, ...] = ("icann",)

    @staticmethod
    def bits(flag: int, sections: tuple[str, ...]) -> int:
        return sum(flag << 3 * SUFFIX_SECTIONS.index(s) for s in sections)


def suffix_index(rules: DataFrame | SuffixIndex, sections: tuple[str, ...] = ("icann",)) -> SuffixIndex:
    """Fold a rule table (rule, section) for label-tail lookups under ``sections``; an index is taken as it is.

    The folded list holds all sections and is written once, so Spark knows its size: a small one joins map-side, a larger
    one by shuffle, on the same plan. Only the greatest number of labels comes to the driver. Rules without text or of
    other sections say nothing.
    """
    if isinstance(rules, SuffixIndex):
        return replace(rules, sections=sections)
    flag = F.when(F.col("rule").startswith("*."), 2).when(F.col("rule").startswith("!"), 4).otherwise(1)
    place = F.coalesce(*[F.when(F.col("section") == s, SuffixIndex.bits(1, (s,))) for s in SUFFIX_SECTIONS])
    name = F.regexp_replace(F.lower("rule"), r"^(\*\.|!)", "")
    folded = rules.where(F.col("rule").isNotNull() & place.isNotNull()).groupBy(name.alias("suffix_key")).agg(
        F.bit_or(flag * place).cast("int").alias("flags"))
    frame = materialise(folded, "suffixes")
    return SuffixIndex(frame, frame.agg(F.max(F.size(F.split("suffix_key", r"\.")))).first()[0] or 1, sections)


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Full public-suffix list by path (the published text format, sections marked in comments)."""
    part = F.posexplode(F.split("value", "BEGIN PRIVATE DOMAINS")).alias("part", "body")
    lines = spark.read.option("wholetext", True).text(path).select(part).select(
        "part", F.explode(F.split("body", r"\r?\n")).alias("line"))
    return lines.where(~F.col("line").startswith("//") & ~F.col("line").startswith("=") & (F.trim("line") != "")).select(
        F.regexp_extract("line", r"^(\S+)", 1).alias("rule"),
        F.when(F.col("part") > 0, "private").otherwise("icann").alias("section"))
