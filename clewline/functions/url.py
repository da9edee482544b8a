"""URL text functions as Spark column expressions.

Generic syntax is split with one regular expression, then host rules are applied:
lower-casing, percent-decoding, IPv4 spellings (decimal, hexadecimal, octal, one to four
parts), IPv6 in its shortest spelling, letters beyond ASCII as ``xn--`` labels, port range. A
host whose last label is numeric must be a valid IPv4 or the URL does not parse. Limit, stated
once: of the tables for international names only case, wide forms and full stops are mapped.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .logic import let

# Schemes that must have an authority, and their default ports.
SPECIAL_SCHEMES = ("http", "https", "ws", "wss", "ftp")
DEFAULT_PORTS = {"http": 80, "ws": 80, "https": 443, "wss": 443, "ftp": 21}

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#\\]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"
_IPV6 = r"^\[[0-9a-fA-F:.]*:[0-9a-fA-F:.]*\]$"
_BAD_HOST = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]"


def standard_form(url: Column) -> Column:
    """A URL as the parser of the standard reads it: without outer control signs and blanks, and tabs and line breaks
    anywhere; for schemes with an authority, backslashes before the query are slashes and any number of them opens it."""
    t = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")
    special = r"(?i)^(?:https?|wss?|ftp):"
    head = F.regexp_extract(t, r"^[^?#]*", 0)
    opened = F.regexp_replace(F.translate(head, "\\", "/"), r"(?i)^((?:https?|wss?|ftp):)/*", "$1//")
    odd = t.rlike(special) & (t.contains("\\") | ~t.rlike(special + r"//(?:[^/]|$)"))
    return F.when(odd, F.concat(opened, F.substr(t, F.length(head) + 1))).otherwise(t)


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(F.trim(url), 1))


def authority(url: Column) -> Column:
    return _part(F.trim(url), 2)


def path(url: Column) -> Column:
    return _part(F.trim(url), 3)


def query(url: Column) -> Column:
    return _part(F.trim(url), 4)


def fragment(url: Column) -> Column:
    return _part(F.trim(url), 5)


def userinfo(url: Column) -> Column:
    return F.regexp_extract(authority(url), r"^(.*)@", 1)


def host_port(url: Column) -> Column:
    return F.regexp_replace(authority(url), r"^.*@", "")


def raw_host(url: Column) -> Column:
    """Host as written (lower case, no port, IPv6 in brackets)."""
    return F.lower(F.regexp_replace(host_port(url), r":[^:\]]*$", ""))


def port_text(url: Column) -> Column:
    return F.regexp_extract(host_port(url), r":([^:\]]*)$", 1)


def _hex_part(digits: Column) -> Column:
    """Value without leading zeros; over eight digits it is too large for any address."""
    return F.when(F.length(digits) <= 8, F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("bigint")).otherwise(F.lit(1 << 40))


def _ipv4_part(p: Column) -> Column:
    return (
        F.when(p.rlike(r"^0[xX][0-9a-fA-F]*$"), _hex_part(F.regexp_replace(p, "^0[xX]0*", "")))
        .when(p.rlike(r"^0[0-7]+$"), F.conv(p, 8, 10).cast("bigint"))
        .when(p.rlike(r"^(?:0|[1-9][0-9]{0,11})$"), p.cast("bigint"))
    )


def numeric_tail(host: Column) -> Column:
    """Last label is a number, so only an IPv4 reading is allowed."""
    return host.rlike(r"(^|\.)([0-9]+|0[xX][0-9a-fA-F]*)\.?$")


def _ipv4_value(n: Column, v: list[Column]) -> Column:
    byte = lambda i: (v[i] >= 0) & (v[i] <= 255)
    return (
        F.when((n == 1) & (v[0] < 2**32), v[0])
        .when((n == 2) & byte(0) & (v[1] < 2**24), v[0] * 2**24 + v[1])
        .when((n == 3) & byte(0) & byte(1) & (v[2] < 2**16), v[0] * 2**24 + v[1] * 2**16 + v[2])
        .when((n == 4) & byte(0) & byte(1) & byte(2) & byte(3), v[0] * 2**24 + v[1] * 2**16 + v[2] * 256 + v[3])
    )


def ipv4_number(host: Column) -> Column:
    """Numeric value of a dotted-decimal IPv4, NULL if it is not one."""
    octet = lambda i: F.split_part(host, F.lit("."), F.lit(i)).try_cast("bigint")
    o = [octet(i) for i in (1, 2, 3, 4)]
    value = o[0] * 2**24 + o[1] * 2**16 + o[2] * 256 + o[3]
    return F.when(host.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}(?<!\.)$"), value)


def ipv4_text(number: Column) -> Column:
    octet = lambda shift: F.shiftright(number, shift).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))


def is_ipv6(host: Column) -> Column:
    return host.rlike(_IPV6) & ~host.rlike(r":::|::.*::")


def ipv6_hex(text: Column) -> Column:
    """The 32 hex digits of an IPv6 address in any spelling, with or without brackets or zone; NULL if it is not one."""
    def as_groups(t):
        quad = F.regexp_extract(t, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
        tail = F.lpad(F.lower(F.hex(ipv4_number(quad))), 8, "0")
        return F.when(quad == "", t).otherwise(F.concat(F.regexp_replace(t, r"[0-9.]+$", ""), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4)))

    def sides(whole):
        side = lambda i: F.filter(F.split(F.split_part(whole, F.lit("::"), F.lit(i)), ":"), lambda g: g != "")
        shape = whole.rlike(r"^[0-9a-f:]*:[0-9a-f:]*$") & ~whole.rlike(r":::|::.*::|^:[^:]|[^:]:$")
        return F.when(shape, F.struct(side(1).alias("left"), F.when(whole.contains("::"), side(2)).alias("right")))

    def digits(s):
        n = F.size(s["left"]) + F.coalesce(F.size(s["right"]), F.lit(0))
        none = F.array().cast("array<string>")
        fill = F.when(s["right"].isNotNull() & (n < 8), F.array_repeat(F.lit("0"), (8 - n).cast("int"))).otherwise(none)
        whole = let(F.concat(s["left"], fill, F.coalesce(s["right"], none)), lambda g: F.when(
            (F.size(g) == 8) & F.forall(g, lambda x: F.length(x) <= 4), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")))
        return F.when(s.isNotNull(), whole)

    plain = F.regexp_replace(F.lower(F.trim(text)), r"^\[|\]$|%[^\]]*", "")
    return let(plain, lambda t: let(as_groups(t), lambda w: let(sides(w), digits)))


def address_hex(text: Column) -> Column:
    """An address of either family as hex digits: 8 for IPv4, 32 for IPv6 in any spelling; NULL if it is neither."""
    return F.when(text.contains(":"), ipv6_hex(text)).otherwise(F.lpad(F.lower(F.hex(ipv4_number(text))), 8, "0"))


def hex_prefix(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of hex digits, as hex digits whose last one is masked."""
    whole, part = F.floor(bits / 4).cast("int"), F.pmod(bits, F.lit(4)).cast("int")
    last = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    masked = F.lower(F.hex(last - F.pmod(last, F.pow(F.lit(2), 4 - part).cast("int"))))
    return F.concat(F.substring(digits, F.lit(1), whole), F.when(part > 0, masked).otherwise(""))


def ip_kind(host: Column) -> Column:
    """IPV4 / IPV6 for a canonical literal, NULL for a name."""
    dotted = host.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$") & ipv4_number(host).isNotNull()
    return F.when(is_ipv6(host), "IPV6").when(dotted, "IPV4")


def ipv6_text(digits: Column) -> Column:
    """32 hex digits as the shortest spelling in brackets: no leading zeros, the first longest run of zero groups left out."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(digits, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))
    whole = F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":"))
    # Of runs of the same length the first is taken; a run of one group stays.
    cut = F.coalesce(*[F.when(whole.contains(":" + "0:" * n), F.regexp_replace(whole, r"^((?:(?!:" + "0:" * n + r").)*):" + "(?:0:){" + str(n) + "}", "$1::")) for n in range(8, 1, -1)], whole)
    plain = F.regexp_replace(F.regexp_replace(cut, "^:(?!:)", ""), "(?<!:):$", "")
    return F.concat(F.lit("["), plain, F.lit("]"))


# Fixed values of the bootstring encoding of host labels.
_BASE, _TMIN, _TMAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Wide forms of ASCII signs, and the full stops of other scripts.
_WIDE = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)) + "\u3002\uff61"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + ".."


def _variable_length(delta: Column, bias: Column) -> Column:
    """Digits of a number in the variable-length form of the encoding."""
    def step(s, k):
        t = F.least(F.greatest(k * _BASE - bias, F.lit(_TMIN)), F.lit(_TMAX)).cast("bigint")
        last = s["q"] < t
        digit = F.when(last, s["q"]).otherwise(t + F.pmod(s["q"] - t, _BASE - t))
        sign = F.substring(F.lit(_DIGITS), digit.cast("int") + 1, F.lit(1))
        return F.when(s["done"], s).otherwise(F.struct(
            F.when(last, s["q"]).otherwise(F.floor((s["q"] - t) / (_BASE - t))).cast("bigint").alias("q"), F.concat(s["out"], sign).alias("out"), last.alias("done")))

    start = F.struct(delta.cast("bigint").alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, lambda s: s["out"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    half = F.floor(delta / F.when(first, _DAMP).otherwise(2))
    d = half + F.floor(half / points)

    def step(s, _):
        return F.when(s["d"] > (_BASE - _TMIN) * _TMAX // 2, F.struct(F.floor(s["d"] / (_BASE - _TMIN)).cast("bigint").alias("d"), (s["k"] + _BASE).alias("k"))).otherwise(s)

    start = F.struct(d.cast("bigint").alias("d"), F.lit(0).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step, lambda s: s["k"] + F.floor((_BASE - _TMIN + 1) * s["d"] / (s["d"] + _SKEW)).cast("int"))


def _label_to_ascii(label: Column) -> Column:
    """``xn--`` and the bootstring encoding of a label; a label of ASCII letters as it is."""
    signs = F.filter(F.split(label, ""), lambda c: c != "")
    point = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint")

    def encode(points):
        basic = F.filter(points, lambda p: p < _FIRST)
        later = F.array_sort(F.array_distinct(F.filter(points, lambda p: p >= _FIRST)))
        # Every code point is met once for each distinct one beyond ASCII, in ascending order of these.
        visits = F.flatten(F.transform(later, lambda m: F.concat(F.array(F.struct(m.alias("m"), F.lit(-1).cast("bigint").alias("c"))), F.transform(points, lambda c: F.struct(m.alias("m"), c.alias("c"))))))
        start = F.struct(F.lit(_FIRST).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("delta"), F.lit(_BIAS).alias("bias"), F.size(basic).alias("h"), F.lit("").alias("out"))

        def step(s, v):
            opens = F.struct(v["m"].alias("n"), (s["delta"] + (v["m"] - s["n"]) * (s["h"] + 1)).alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), s["out"].alias("out"))
            less = F.struct(s["n"].alias("n"), (s["delta"] + 1).alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), s["out"].alias("out"))
            here = F.struct(s["n"].alias("n"), F.lit(0).cast("bigint").alias("delta"), _adapted(s["delta"], s["h"] + 1, s["h"] == F.size(basic)).alias("bias"),
                            (s["h"] + 1).alias("h"), F.concat(s["out"], _variable_length(s["delta"], s["bias"])).alias("out"))
            # A new round starts one beyond the code point of the last.
            first = F.when(s["n"] == _FIRST, opens).otherwise(F.struct(v["m"].alias("n"), (s["delta"] + 1 + (v["m"] - s["n"] - 1) * (s["h"] + 1)).alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), s["out"].alias("out")))
            return F.when(v["c"] == -1, F.when(s["h"] == F.size(basic), opens).otherwise(first)).when(v["c"] < v["m"], less).when(v["c"] == v["m"], here).otherwise(s)

        tail = F.aggregate(visits, start, step, lambda s: s["out"])
        head = F.array_join(F.transform(basic, lambda p: F.chr(p)), "")
        return F.concat(F.lit("xn--"), head, F.when(F.size(basic) > 0, "-").otherwise(""), tail)

    return F.when(label.rlike(r"[^\x00-\x7f]"), let(F.transform(signs, point), encode)).otherwise(label)


def ascii_host(host: Column) -> Column:
    """Host labels in lower case and ASCII. Only a host with other letters is encoded."""
    mapped = F.lower(F.translate(F.regexp_replace(host, "[\u00ad\u200b\u2060\ufeff]", ""), _WIDE, _NARROW))
    return F.when(host.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(mapped, r"\."), _label_to_ascii), ".")).otherwise(host)


def settle(df: DataFrame, *cols: str) -> DataFrame:
    """Fix computed columns behind a one-row generator.

    Catalyst pushes a filter below a projection by copying the projected expression into it.
    For long chains of regular expressions that repeats the whole chain per reference; after
    this step filters and later columns read the computed value instead.
    """
    others = [c for c in df.columns if c not in cols]
    held = F.explode_outer(F.array(F.struct(*cols))).alias("_held")
    return df.select(*others, held).select(*others, "_held.*")


def with_host(df: DataFrame, url: str, out: str, kind: str | None = None) -> DataFrame:
    """Add the canonical lookup host of a URL column (numeric IPv4 spellings folded) and its kind.

    The host as written is settled first: it is read a dozen times, each of which would take the URL apart anew.
    """
    df = settle(df.withColumn("_h0", raw_host(standard_form(F.col(url)))), "_h0")
    return canonical_host(df, "_h0", out, kind).drop("_h0")


def canonical_host(df: DataFrame, host: str, out: str, kind: str | None = None, spelled: bool = False) -> DataFrame:
    """The host of a lookup. ``spelled`` also puts letters beyond ASCII and IPv6 addresses into their one spelling, as parsing
    a URL does; the expressions for that are long, so plans that split hosts many times leave them out."""
    h = F.col(host)
    plain = F.when(h.contains("%") & ~h.startswith("["), F.lower(percent_decode(h))).otherwise(h)
    if spelled:
        named = let(plain, lambda p: F.when(is_ipv6(p), F.coalesce(ipv6_text(ipv6_hex(p)), p)).otherwise(ascii_host(p)))
        df = settle(df.withColumn("_h1", named), "_h1")
    else:
        df = df.withColumn("_h1", plain)
    df = settle(df.withColumn("_parts", F.when(numeric_tail(F.col("_h1")), F.split(F.regexp_replace("_h1", r"\.$", ""), r"\."))), "_parts")
    df = df.withColumns({f"_v{i}": _ipv4_part(F.get("_parts", F.lit(i))) for i in range(4)})
    df = df.withColumn("_ip", _ipv4_value(F.size("_parts"), [F.col(f"_v{i}") for i in range(4)]))
    df = df.withColumn(out, F.when(F.col("_ip").isNotNull(), ipv4_text(F.col("_ip"))).otherwise(F.col("_h1")))
    made = [out]
    if kind:
        h1 = F.col("_h1")
        df = df.withColumn(kind, F.when(is_ipv6(h1), "IPV6").when(F.col("_ip").isNotNull(), "IPV4")
                           .when(F.col("_parts").isNotNull() | h1.rlike(_BAD_HOST), F.lit(None).cast("string")).otherwise("DEFAULT"))
        made.append(kind)
    return settle(df.drop("_parts", "_v0", "_v1", "_v2", "_v3", "_ip", "_h1"), *made)


def with_parts(df: DataFrame, col: str = "url") -> DataFrame:
    """Add parse_status and URL components, without a shuffle. A table that has them is returned as is."""
    if "parse_status" in df.columns:
        return df
    u = F.col("_url")
    out = settle(df.withColumn("_url", standard_form(F.col(col))), "_url").withColumns({"_sch": scheme(u), "_auth": authority(u), "_path": path(u), "_query": query(u), "_frag": fragment(u)})
    out = out.withColumns({
        "_user": F.regexp_extract("_auth", r"^(.*)@", 1), "_hp": F.regexp_replace("_auth", r"^.*@", "")}).withColumns({
        "_h0": F.lower(F.regexp_replace("_hp", r":[^:\]]*$", "")), "_port": F.regexp_extract("_hp", r":([^:\]]*)$", 1)})
    out = canonical_host(out, "_h0", "_host", "_kind", spelled=True)
    special = F.col("_sch").isin(*SPECIAL_SCHEMES)
    port_ok = (F.col("_port") == "") | (F.col("_port").rlike(r"^[0-9]{1,5}$") & (F.col("_port").try_cast("int") <= 65535))
    bad = (
        (F.col("_sch") == "")
        | (special & (F.coalesce(F.col("_host"), F.lit("")) == ""))
        | ((F.col("_host") != "") & F.col("_kind").isNull())
        | ~port_ok
    )
    default_port = F.coalesce(*[F.when((F.col("_sch") == s) & (F.col("_port") == str(p)), F.lit("")) for s, p in DEFAULT_PORTS.items()], F.col("_port"))
    status = F.when(F.coalesce(F.trim(u), F.lit("")) == "", "EMPTY_INPUT").when(F.coalesce(bad, F.lit(True)), "FAILURE").otherwise("SUCCESS")
    keep = lambda c: F.when(F.col("parse_status") == "SUCCESS", c)
    named = {
        "protocol": keep(F.concat("_sch", F.lit(":"))),
        "username": keep(F.regexp_extract("_user", r"^([^:]*)", 1)),
        "hostname": keep(F.col("_host")),
        "port": keep(default_port),
        "pathname": keep(F.when((F.col("_path") == "") & special, "/").otherwise(F.col("_path"))),
        "search": keep(F.when(F.col("_query") != "", F.concat(F.lit("?"), F.col("_query"))).otherwise("")),
        "fragment": keep(F.when(F.col("_frag") != "", F.concat(F.lit("#"), F.col("_frag"))).otherwise("")),
        "host_type": keep(F.when(F.col("_host") == "", "DEFAULT").otherwise(F.col("_kind"))),
    }
    out = out.withColumn("parse_status", status).withColumns(named)
    out = out.drop("_url", "_sch", "_auth", "_path", "_query", "_frag", "_user", "_hp", "_h0", "_port", "_host", "_kind")
    return settle(out, "parse_status", *named)


def percent_decode(text: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone; NULL when the bytes are not valid."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def is_http(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https") & (raw_host(url) != ""), F.lit(False))


def origin(url: Column) -> Column:
    s = scheme(url)
    p = port_text(url)
    port = F.when(p != "", p).otherwise(F.when(s == "https", "443").otherwise("80"))
    return F.concat_ws("|", s, F.regexp_replace(raw_host(url), r"\.$", ""), port)


def _fold_dots(p: Column) -> Column:
    """Remove ``.`` and ``..`` segments from an absolute path."""
    segs = F.slice(F.split(p, "/"), F.lit(2), F.size(F.split(p, "/")))
    last_dot = p.rlike(r"(^|/)\.\.?$")
    kept = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(~p.rlike(r"(^|/)\.\.?(/|$)"), p).otherwise(
        F.when(last_dot & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)
    )


def with_resolved(df: DataFrame, ref: str, base: str, out: str) -> DataFrame:
    """Add the reference resolved against a base URL; NULL unless the result is http(s) with a host."""
    r, b = F.trim(F.col(ref)), F.col(base)
    df = df.withColumns({
        "_r": r, "_bs": scheme(b), "_ba": authority(b), "_bp": path(b), "_bq": query(b),
        "_rs": scheme(r), "_ra": authority(r), "_rp": path(r), "_rq": query(r), "_rf": fragment(r),
        "_slashes": r.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"), "_hasq": r.rlike(r"^[^#]*\?"),
    })
    own_path = F.col("_slashes") | (F.col("_rp") != "")
    merged = F.when(F.col("_bp") == "", F.concat(F.lit("/"), "_rp")).otherwise(F.concat(F.regexp_replace("_bp", r"[^/]*$", ""), "_rp"))
    df = df.withColumn("_p", F.when(~own_path, F.col("_bp")).when(F.col("_slashes") | F.col("_rp").startswith("/"), F.col("_rp")).otherwise(merged))
    df = settle(df, "_p").withColumn("_p", F.when(own_path & (F.col("_p") != ""), _fold_dots(F.col("_p"))).otherwise(F.col("_p")))
    q = F.when(own_path | F.col("_hasq"), F.col("_rq")).otherwise(F.col("_bq"))
    mark = lambda ch, c: F.when(c != "", F.concat(F.lit(ch), c)).otherwise("")
    whole = F.concat(
        F.when(F.col("_rs") != "", F.col("_rs")).otherwise(F.col("_bs")), F.lit("://"),
        F.when(F.col("_slashes"), F.col("_ra")).otherwise(F.col("_ba")), "_p", mark("?", q), mark("#", F.col("_rf")))
    opaque = (F.col("_rs") != "") & ~F.col("_slashes") & (F.col("_rs") != F.col("_bs"))
    df = df.withColumn("_w", F.when(F.col("_r") == "", b).when(~opaque, whole))
    df = df.withColumn(out, F.when(is_http(F.col("_w")), F.col("_w")))
    df = df.drop("_r", "_bs", "_ba", "_bp", "_bq", "_rs", "_ra", "_rp", "_rq", "_rf", "_slashes", "_hasq", "_p", "_w")
    return settle(df, out)
