"""URLs, hosts and addresses: native expressions, and small vectorised helpers for what Spark has no function for."""

from __future__ import annotations

import functools
import ipaddress
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urls import parse_url

#: Fixed ranges of IPv4 addresses that are not safe to connect to, first and last.
UNSAFE_V4 = (
    ("0.0.0.0", "0.0.0.0"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"), ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255"),
)
URL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("href", "scheme", "host", "host_original", "host_kind")]
)


def v4_number(text: str) -> int:
    a, b, c, d = (int(x) for x in text.split("."))
    return a << 24 | b << 16 | c << 8 | d


def ip_number(address: Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else."""
    p = F.transform(F.split(address, r"\."), lambda x: x.cast("long"))
    good = address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.forall(p, lambda x: x <= 255)
    return F.when(good, p[0] * (1 << 24) + p[1] * (1 << 16) + p[2] * (1 << 8) + p[3])


def is_safe_v4(number: Column) -> Column:
    bad = F.lit(False)
    for low, high in UNSAFE_V4:
        bad = bad | number.between(v4_number(low), v4_number(high))
    return ~bad


def _safe(text: str) -> bool | None:
    try:
        ip = ipaddress.ip_address(text.strip("[]"))
    except ValueError:
        return None
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    if ip.version == 4:
        return not any(v4_number(a) <= int(ip) <= v4_number(b) for a, b in UNSAFE_V4)
    top = int(ip) >> 118
    return not (ip.is_loopback or ip.is_unspecified or ip.is_multicast or top >> 3 == 0xFC >> 1 or top == 0xFE80 >> 6)


@F.pandas_udf(T.BooleanType())
def is_safe_ip(address: pd.Series) -> pd.Series:
    """Whether an IPv4 or IPv6 address is safe to connect to; null if it is no address."""
    return address.map(lambda x: None if x is None else _safe(x), na_action="ignore").astype(object)


def host_suffixes(host: Column) -> Column:
    """a.b.c, b.c, c: what a host list may hold for the host to match."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_matches(host: Column, target: Column) -> Column:
    """Whether host is target or one of its subdomains. As a join condition this compares all pairs: see listed_hosts."""
    return (host == target) | host.endswith(F.concat(F.lit("."), target))


def matches_any(host: Column, targets: tuple[str, ...]) -> Column:
    """Whether host is one of the policy's hosts or under one; null hosts match none."""
    if not targets:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(host_suffixes(host), F.array(*(F.lit(t) for t in targets))), F.lit(False))


def listed_hosts(rows: DataFrame, host: str, listed: DataFrame, target: str, how: str = "left_semi") -> DataFrame:
    """The rows whose host is listed or under a listed host (left_semi), or the others (left_anti), by an equality join.

    The host's suffixes are exploded, so that a list of any length is joined by a key.
    """
    marked = rows.withColumn("_row", F.monotonically_increasing_id()) if how == "left_anti" else rows
    if how == "left_semi":
        keyed = marked.withColumn("_suffixes", host_suffixes(F.col(host)))
        hits = keyed.select(F.col(host).alias("_h"), F.explode("_suffixes").alias("_s")).distinct().join(listed, F.col("_s") == listed[target], "left_semi").select("_h").distinct()
        return rows.join(hits, rows[host] == hits["_h"], "left_semi")
    distinct = rows.select(F.col(host).alias("_h")).distinct()
    hits = distinct.select("_h", F.explode(host_suffixes(F.col("_h"))).alias("_s")).join(listed, F.col("_s") == listed[target], "left_semi").select("_h").distinct()
    return rows.join(hits, rows[host] == hits["_h"], "left_anti")


@F.pandas_udf(URL)
def resolve_url(value: pd.Series, base: pd.Series) -> pd.DataFrame:
    """href, scheme, host, host_original, host_kind of value joined to base; all null if it cannot be joined."""
    rows = [(None,) * 5 if v is None or b is None else parse_url(v, b) or (None,) * 5 for v, b in zip(value, base, strict=True)]
    return pd.DataFrame(rows, columns=URL.names, dtype=object)


def is_idn(url: Column) -> Column:
    return F.coalesce((url["host_kind"] == "domain") & (url["host"] != url["host_original"]), F.lit(False))


def _rounds(v: list[np.ndarray], n: int) -> None:
    rot = lambda x, b: (x << np.uint64(b)) | (x >> np.uint64(64 - b))
    for _ in range(n):
        v[0] = v[0] + v[1]
        v[1] = rot(v[1], 13) ^ v[0]
        v[0] = rot(v[0], 32)
        v[2] = v[2] + v[3]
        v[3] = rot(v[3], 16) ^ v[2]
        v[0] = v[0] + v[3]
        v[3] = rot(v[3], 21) ^ v[0]
        v[2] = v[2] + v[1]
        v[1] = rot(v[1], 17) ^ v[2]
        v[2] = rot(v[2], 32)


def siphash13(rows: list[bytes]) -> np.ndarray:
    """SipHash-1-3 with a zero key (Aumasson and Bernstein, 2012) of each row; rows of as many words are hashed together."""
    out, words = np.zeros(len(rows), np.uint64), np.array([len(r) // 8 for r in rows], np.int64)
    for n in np.unique(words):
        at = np.flatnonzero(words == n)
        padded = b"".join(rows[i].ljust(8 * (n + 1) - 1, b"\0") + bytes([len(rows[i]) & 255]) for i in at)
        blocks = np.frombuffer(padded, "<u8").reshape(len(at), n + 1).T
        v = [np.full(len(at), x, np.uint64) for x in (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)]
        for m in blocks:
            v[3] = v[3] ^ m
            _rounds(v, 1)
            v[0] = v[0] ^ m
        v[2] = v[2] ^ np.uint64(255)
        _rounds(v, 3)
        out[at] = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out


def url_names(hrefs: list[str]) -> dict[str, str]:
    """Sixteen hexadecimal digits that name each URL."""
    distinct = list(set(hrefs))
    return dict(zip(distinct, (f"{h:016x}" for h in siphash13([h.encode() + b"\xff" for h in distinct]).tolist()), strict=True))


@functools.lru_cache(maxsize=1 << 16)
def url_name(href: str) -> str:
    return url_names([href])[href]


@functools.lru_cache(maxsize=1 << 16)
def file_extension(href: str, default: str) -> str:
    """The letters and digits after the last dot of the last path segment, or default."""
    last = re.sub(r"[?#].*$", "", href, flags=re.S).split("://", 1)[-1].partition("/")[2].rpartition("/")[2]
    return "".join(c for c in last.rpartition(".")[2] if c.isalnum()) if "." in last else ""


def local_files(hrefs: list[str], defaults: list[str]) -> list[str]:
    """The local name of each URL; its default is the extension of one without any."""
    names = url_names(hrefs)
    return [f"sub_{names[h]}.{file_extension(h, d) or d}" for h, d in zip(hrefs, defaults, strict=True)]


@F.pandas_udf(T.StringType())
def url_hash(href: pd.Series) -> pd.Series:
    """Sixteen hexadecimal digits that name a URL."""
    return href.map(url_names(href.dropna().tolist()), na_action="ignore").astype(object)


def extension(href: Column, default: Column) -> Column:
    """What follows the last dot of the last path segment, letters and digits only, or default."""
    path = F.regexp_extract(F.regexp_replace(href, r"[?#].*$", ""), r"^[a-z]+://[^/]*(?:/.*)?/([^/]*)$", 1)
    found = F.regexp_replace(F.regexp_extract(path, r"\.([^.]*)$", 1), r"[^\p{L}\p{N}]", "")
    return F.when(found == "", default).otherwise(found)


def local_name(href: Column, default: Column) -> Column:
    return F.concat(F.lit("sub_"), url_hash(href), F.lit("."), extension(href, default))
