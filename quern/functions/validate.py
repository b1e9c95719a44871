"""Validators: Column to a boolean Column; a NULL value is not checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Validator = Callable[[Column], Column]


def max_strlen(n: int) -> Validator:
    return lambda c: F.octet_length(c) <= n


def min_strlen(n: int) -> Validator:
    return lambda c: F.octet_length(c) >= n


def range_strlen(low: int, high: int) -> Validator:
    return lambda c: F.octet_length(c).between(low, high)


# What the formats accept.
EMAIL = r"^[A-Za-z0-9]{1}[A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
PHONE = r"^\+?[0-9\s().-]{7,20}$"
MIME = r"^[A-Za-z0-9+.-]+/[A-Za-z0-9+.-]+$"
RGB = r"^#[0-9A-Fa-f]{6}$"


def matches(pattern: str) -> Validator:
    return lambda c: c.rlike(pattern)


email, phone, mime_type, rgb_color = map(matches, (EMAIL, PHONE, MIME, RGB))
camel_case, snake_case, kebab_case = map(matches, (r"^\p{Lu}[\p{L}\p{N}]*$", r"^[\p{Ll}_][\p{Ll}\p{N}_]*$", r"^\p{Ll}[\p{Ll}\p{N}-]*$"))


# The schemes with a host of their own, and what a host cannot hold.
HOSTED = ("ftp", "http", "https", "ws", "wss")
NOT_IN_HOST = r"[\x00\t\n\r #/:<>?@\[\\\]^|]"
NOT_IN_DOMAIN = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F\uFFFD]"


def _number(part: Column) -> Column:
    """A part of a dotted address: decimal, octal after 0, hexadecimal after 0x; else NULL."""
    hexadecimal = F.when(F.length(part) == 2, F.lit("0")).otherwise(F.conv(F.substring(part, 3, 99), 16, 10))
    text = F.when(part.rlike(r"^0[xX][0-9A-Fa-f]*$"), hexadecimal).when(part.rlike(r"^0[0-7]+$"), F.conv(part, 8, 10)).when(part.rlike(r"^(0|[1-9][0-9]*)$"), F.right(F.concat(F.lit("0" * 20), part), F.lit(20)))
    return F.when(F.length(part) <= 20, text).try_cast("decimal(20,0)")


def _domain(host: Column) -> Column:
    """A name or a dotted address. Rules of international names beyond the forbidden characters are not checked."""
    name = F.when(host.contains("%"), F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))).otherwise(host)
    parts = F.split(F.regexp_replace(name, r"\.$", ""), r"\.")
    numbers = F.transform(parts, _number)
    last, rest = F.element_at(numbers, -1), F.slice(numbers, 1, F.size(numbers) - 1)
    address = (F.size(parts) <= 4) & F.forall(rest, lambda x: F.coalesce(x <= 255, F.lit(False))) & (last < F.pow(F.lit(256.0), 5 - F.size(parts)))
    numeric = F.element_at(parts, -1).rlike(r"^([0-9]+|0[xX][0-9A-Fa-f]*)$")
    return (name != "") & ~name.rlike(NOT_IN_DOMAIN) & F.when(numeric, F.coalesce(address, F.lit(False))).otherwise(True)


def _ipv6(host: Column) -> Column:
    byte = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    inner = F.regexp_replace(F.substring(host, 2, 1 << 30), r"\]$", "")
    inner = F.regexp_replace(inner, rf"(?<=:){byte}(\.{byte}){{3}}$", "0:0")
    group = r"[0-9A-Fa-f]{1,4}"
    short = inner.rlike(rf"^({group}(:{group})*)?::({group}(:{group})*)?$") & (F.size(F.filter(F.split(inner, ":"), lambda x: x != "")) <= 7)
    return host.rlike(r"^\[.*\]$") & (inner.rlike(rf"^({group}:){{7}}{group}$") | short)


def url(c: Column) -> Column:
    """An absolute URL as browsers read one: surrounding blanks, line ends and backslashes are forgiven, hosts and ports are checked."""
    s = F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(s, r"^[^:]*:", "")
    hosted, local = scheme.isin(*HOSTED), scheme == "file"
    authority = F.when(hosted, F.regexp_extract(rest, r"^[/\\]*([^/\\?#]*)", 1)).when(local, F.regexp_extract(rest, r"^[/\\]{2}([^/\\?#]*)", 1)).otherwise(F.regexp_extract(rest, r"^//([^/?#]*)", 1))
    place = F.regexp_replace(authority, r"^.*@", "")
    host, port = F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1), F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:]*)(.*)$", 1)
    digits = F.regexp_replace(port, r"^:0*", "")
    port_fits = (port == "") | (port.rlike(r"^:[0-9]*$") & (F.length(digits) <= 5) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 65535))
    bracket = host.startswith("[")
    drive = authority.rlike(r"^[A-Za-z][:|]$")
    good = (scheme != "") & (
        F.when(local, (authority == "") | drive | F.when(authority.startswith("["), _ipv6(authority)).otherwise(_domain(authority)))
        .when(hosted, port_fits & F.when(bracket, _ipv6(host)).otherwise(_domain(host)))
        .otherwise((authority == "") | ((host != "") & port_fits & F.when(bracket, _ipv6(host)).otherwise(~host.rlike(NOT_IN_HOST))))
    )
    return F.when(c.isNotNull(), F.coalesce(good, F.lit(False)))


def _codes(method: str) -> list[str]:
    """The platform's tables of the public ISO standards."""
    return list(getattr(SparkSession.active()._jvm.java.util.Locale, method)())


def country_iso3166(c: Column) -> Column:
    return c.isin(_codes("getISOCountries"))


# Withdrawn codes that the platform still lists.
WITHDRAWN = ("in", "iw", "ji", "mo")


def country_iso639(c: Column) -> Column:
    return c.isin([x for x in _codes("getISOLanguages") if x not in WITHDRAWN])
