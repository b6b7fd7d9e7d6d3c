"""Hosts and addresses of URL literals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reposieve import fixed
from reposieve.functions.text import bind

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_QUAD = rf"\A{_OCTET}(\.{_OCTET}){{3}}\z"


def url_host(url: Column) -> Column:
    """Host of the first http(s) URL in the text; NULL if there is none."""
    return F.nullif(F.regexp_extract(url, fixed.URL_HOST, 1), F.lit(""))


def ipv4_number(host: Column) -> Column:
    """Dotted quad to BIGINT; NULL for names, octets over 255 and leading zeros."""
    start = F.lit(0).cast("bigint")
    step = lambda a, o: a * 256 + o.cast("bigint")
    return F.when(host.rlike(_QUAD), F.aggregate(F.split(host, r"\."), start, step))


def as_number(quad: str) -> int:
    return reduce(lambda a, b: a * 256 + int(b), quad.split("."), 0)


def is_private_number(ip: Column) -> Column:
    """True for a private, loopback, link-local or reserved IPv4 number; false for NULL."""
    ranges = F.array(*(
        F.struct(
            F.lit(as_number(net)).cast("bigint").alias("lo"),
            F.lit(as_number(net) + 2 ** (32 - bits) - 1).cast("bigint").alias("hi"),
        )
        for net, bits in fixed.PRIVATE_NETWORKS
    ))
    public = [as_number(a) for a in fixed.PUBLIC_EXCEPTIONS]
    return bind(
        ip,
        lambda n: F.coalesce(
            F.exists(ranges, lambda r: (n >= r["lo"]) & (n <= r["hi"])) & ~n.isin(*public), F.lit(False)
        ),
    )


def is_private_host(host: Column) -> Column:
    return is_private_number(ipv4_number(host))
