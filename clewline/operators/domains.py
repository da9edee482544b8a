"""Host names split by suffix rules: registered domain, site scope, responsibility boundary.

The suffix lookup is a chain of left joins, one per label depth, against one written rule
relation that holds all sections. Each is a map-side hash join of the same broadcast, so a
URL table of any size is split without a shuffle; one chain answers for several lists.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import url as U
from ..refdata import SuffixIndex, suffix_index


def _tail(host: Column, k) -> Column:
    """Last k labels; k is a number or a column."""
    return F.call_function("substring_index", host, F.lit("."), -(F.lit(k) if isinstance(k, int) else k))


def _suffix_lengths(df: DataFrame, host: str, index: SuffixIndex, outs: dict[str, tuple[str, ...]], unknown_is_suffix: bool) -> DataFrame:
    """Labels in the suffix of a host, a column per set of sections; one chain of joins serves them all."""
    h = F.col(host)
    n = F.size(F.split(h, r"\."))
    depths = range(1, index.depth + 1)
    for k in depths:
        side = index.frame.select(F.col("suffix_key").alias(f"_k{k}"), F.col("flags").alias(f"_f{k}"))
        df = df.join(side, F.when(n >= k, _tail(h, k)) == F.col(f"_k{k}"), "left")
    lengths = {}
    for out, sections in outs.items():
        bit = lambda b, k: F.col(f"_f{k}").bitwiseAND(F.lit(SuffixIndex.bits(b, sections))) > 0  # noqa: B023
        plain = [c for k in depths for c in (F.when(bit(1, k), F.lit(k)), F.when(bit(2, k) & (n > k), F.lit(k + 1)))]
        exact = [F.when(bit(4, k), F.lit(k - 1)) for k in reversed(depths)]
        lengths[out] = F.coalesce(*exact, F.greatest(*plain), F.lit(1 if unknown_is_suffix else 0))
    return df.withColumns(lengths).drop(*[f"_{c}{k}" for k in depths for c in "kf"])


def _split(h: Column, s: Column) -> dict[str, Column]:
    """Parts of host ``h`` whose suffix has ``s`` labels."""
    n = F.size(F.split(h, r"\."))
    ip = U.ip_kind(h).isNotNull()
    cut = F.length(h) - F.length(_tail(h, s + 1)) - 1
    return {
        "subdomain": F.when(~ip & (n > s + 1), F.substring(h, F.lit(1), cut)).otherwise(""),
        "domain": F.when(ip, h).when(n > s, F.substring_index(_tail(h, s + 1), ".", 1)).otherwise(""),
        "suffix": F.when(ip | (s == 0), "").otherwise(_tail(h, s)),
        "registered_domain": F.when(~ip & (s > 0) & (n > s), _tail(h, s + 1)).otherwise(""),
    }


def domain_split(hosts: DataFrame, index: SuffixIndex, host: str = "hostname", prefix: str = "") -> DataFrame:
    """Add subdomain, domain, suffix, registered_domain. An IP host has no registered domain."""
    df = _suffix_lengths(hosts, host, index, {"_len": index.sections}, unknown_is_suffix=False)
    return df.withColumns({prefix + k: v for k, v in _split(F.col(host), F.col("_len")).items()}).drop("_len")


def etld1(df: DataFrame, index: SuffixIndex, url: str, out: str) -> DataFrame:
    """Registered domain of an http(s) URL; NULL for other URLs, IP hosts and bare suffixes."""
    d = U.with_host(df.withColumn("_u", F.when(U.is_http(F.col(url)), F.col(url))), "_u", "_h").drop("_u")
    d = domain_split(d, index, "_h", "_d_")
    return d.withColumn(out, F.when(F.col("_d_registered_domain") != "", F.col("_d_registered_domain"))).drop(
        "_h", "_d_subdomain", "_d_domain", "_d_suffix", "_d_registered_domain")


def etld1_or_host(df: DataFrame, index: SuffixIndex, url: str, out: str, host: str | None = None) -> DataFrame:
    """Journey variant: suffix-less and IP hosts keep the bare name, so every URL has a value. ``host`` names a column for its host."""
    h = host or "_h"
    d = domain_split(U.with_host(df, url, h), index, h, "_d_")
    return d.withColumn(
        out, F.when(F.col("_d_suffix") == "", F.col("_d_domain")).otherwise(F.concat_ws(".", "_d_domain", "_d_suffix"))
    ).drop("_h", "_d_subdomain", "_d_domain", "_d_suffix", "_d_registered_domain")


def site_scope(df: DataFrame, rules: DataFrame | SuffixIndex, host: str = "hostname", out: str = "site_scope") -> DataFrame:
    """Tenant unit: registered domain under ICANN and private rules, else the host (or IP) itself."""
    index = suffix_index(rules, ("icann", "private"))
    bare = df.withColumn("_sh", F.regexp_replace(F.col(host), r"\.$", ""))
    d = domain_split(bare, index, "_sh", "_s_")
    return d.withColumn(out, F.when(F.col("_s_registered_domain") != "", F.col("_s_registered_domain")).otherwise(F.col("_sh"))).drop(
        "_sh", "_s_subdomain", "_s_domain", "_s_suffix", "_s_registered_domain")


def responsibility_boundary(hosts: DataFrame, rules: DataFrame | SuffixIndex, host: str = "hostname") -> DataFrame:
    """Registrable unit, boundary under all lists, and the list that moved the boundary."""
    lists = {"_icann": ("icann",), "_full": ("icann", "private"), "_merged": ("icann", "private", "supplement")}
    df = _suffix_lengths(hosts, host, suffix_index(rules), lists, unknown_is_suffix=True)
    h = F.col(host)
    n = F.size(F.split(h, r"\."))
    kind = U.ip_kind(h)
    ip = kind.isNotNull()
    unit = lambda c: F.when(ip, "").when(n > F.col(c), _tail(h, F.col(c) + 1)).otherwise(h)
    match = (
        F.when(ip, "not_applicable")
        .when(F.col("_merged") != F.col("_full"), "supplement")
        .when(F.col("_full") != F.col("_icann"), "private")
        .otherwise("none")
    )
    return df.withColumns({
        "host_kind": F.when(ip, kind).otherwise("DOMAIN"),
        "registrable_unit": unit("_icann"),
        "responsibility_boundary": unit("_merged"),
        "platform_match": match,
    }).drop(*lists)


def url_relations(pairs: DataFrame, rules: DataFrame | SuffixIndex, source: str, destination: str) -> DataFrame:
    """same_origin, same_host, same_icann_domain, same_site_scope; NULL if either side is not http(s)."""
    s, d = F.col(source), F.col(destination)
    both = U.is_http(s) & U.is_http(d)
    index = suffix_index(rules)
    df = U.with_host(U.with_host(pairs, source, "_sh0"), destination, "_dh0")
    for h, p in (("_sh0", "_a"), ("_dh0", "_b")):
        df = df.withColumn(f"{p}_host", F.regexp_replace(h, r"\.$", ""))
        df = _suffix_lengths(df, f"{p}_host", index, {f"{p}_i": ("icann",), f"{p}_s": ("icann", "private")}, unknown_is_suffix=False)
        # A host with a dot at its end has no registered domain, but a scope.
        named = F.when(F.col(h).endswith("."), "").otherwise(_split(F.col(h), F.col(f"{p}_i"))["registered_domain"])
        unit = _split(F.col(f"{p}_host"), F.col(f"{p}_s"))["registered_domain"]
        df = df.withColumns({f"{p}_registered": named, f"{p}_scope": F.when(unit != "", unit).otherwise(F.col(f"{p}_host"))})
    known = (F.col("_a_registered") != "") & (F.col("_b_registered") != "")
    when_both = lambda c: F.when(both, c)
    out = df.withColumns({
        "same_origin": when_both(U.origin(s) == U.origin(d)),
        "same_host": when_both(F.col("_a_host") == F.col("_b_host")),
        "same_icann_domain": when_both(F.when(known, F.col("_a_registered") == F.col("_b_registered"))),
        "same_site_scope": when_both(F.col("_a_scope") == F.col("_b_scope")),
    })
    return out.drop("_sh0", "_dh0", *[f"{p}_{c}" for p in ("_a", "_b") for c in ("host", "i", "s", "registered", "scope")])
