"""Taint rules: parameters flow through ``x = y`` copies into dangerous calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposieve import fixed
from reposieve.functions import hosts
from reposieve.operators import finding as f
from reposieve.operators.static import is_call_of
from reposieve.policy import Policy

SCANNER = "taint_risk"


def taint_times(facts: Column) -> Column:
    """Map of each tainted name to the position at which it first became tainted."""
    first = F.filter(facts, lambda x: F.coalesce(x["taints"], F.lit(False)))
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x["name"], x["seq"])))


def _target(c: Column) -> Column:
    """``module.function`` or the bare name."""
    return F.concat_ws(".", c["mod"], c["fn"])


def resolved_calls(facts: Column) -> Column:
    """Calls with what the rules ask for: target, taint of the arguments, literal host."""

    def one(c: Column) -> Column:
        return F.struct(
            c["fn"].alias("fn"), c["attr"].alias("attr"), c["seq"].alias("seq"), c["shell"].alias("shell"),
            # An attribute of something that is not a plain name has no module.
            F.when(~c["attr"] | c["mod"].isNotNull(), _target(c)).alias("target"),
            F.get(c["since"], F.lit(0)).isNotNull().alias("first"),
            F.exists(c["since"], lambda t: t.isNotNull()).alias("any"),
            hosts.url_host(c["lit"]).alias("host"),
        )

    return F.transform(F.filter(facts, lambda x: x["kind"] == "call"), one)


def call_rules(calls: Column, policy: Policy) -> Column:
    """Findings of all taint rules on resolved calls."""
    r = fixed.REASONS
    rules = {
        "py_eval": ("high", r["taint.py_eval"]),
        "py_exec": ("high", r["taint.py_exec"]),
        "py_subprocess_shell_tainted": ("critical", r["taint.shell"]),
        "py_subprocess_tainted": ("high", r["taint.subprocess"]),
        "py_file_op_tainted": ("high", r["taint.file"] % policy.safe_root.replace("%", "%%")),
        "py_http_url_tainted": ("high", r["taint.url"]),
        "py_http_private_target": ("high", r["taint.private"]),
        "py_http_off_allowlist": ("medium", r["taint.domain"]),
    }
    files = [".".join(p) for p in fixed.FILE_CALLS]

    def of(c: Column) -> Column:
        known = c["target"].isNotNull()
        shell = known & c["attr"] & c["target"].isin(*(f"subprocess.{n}" for n in fixed.SHELL_CALLS)) & c["any"]
        http = known & c["attr"] & c["target"].isin(*(f"requests.{n}" for n in fixed.HTTP_CALLS))
        file = is_call_of(c, "open") | (known & c["attr"] & c["target"].isin(*files))
        hits = [(f"py_{n}", is_call_of(c, n)) for n in fixed.CODE_RUNNERS]
        hits += [
            ("py_subprocess_shell_tainted", shell & (c["shell"] > 0)),
            ("py_subprocess_tainted", shell & (c["shell"] == 0)),
            ("py_file_op_tainted", file & c["first"]),
            ("py_http_url_tainted", http & c["first"]),
        ]
        if policy.block_private:
            hits.append(("py_http_private_target", http & hosts.is_private_host(c["host"])))
        if policy.allowed_domains:
            domains = F.array(*map(F.lit, policy.allowed_domains))
            hits.append((
                "py_http_off_allowlist",
                http & c["host"].isNotNull() & ~F.exists(domains, lambda d: F.contains(c["host"], d)),
            ))
        return f.by_rule(SCANNER, rules, hits, c["seq"], c["host"])

    return F.flatten(F.transform(calls, of))


# --- the same tests against tables, for lists too long for a plan -------------


def off_allowlist(hosts_df: DataFrame, domains: DataFrame) -> DataFrame:
    """Rows of ``hosts_df(host)`` that contain no ``domains(domain)``.

    "Contains" becomes an equi-join: each distinct host yields its substrings of the
    lengths the domains have. No side is broadcast by force and no pairs are formed.
    """
    # At most one length per possible host length: bounded by 253.
    sizes = domains.agg(F.collect_set(F.length("domain")).alias("_sizes"))
    distinct = hosts_df.select("host").distinct()
    pieces = (
        distinct.select("host", F.lit(sizes.scalar()).alias("_sizes"))
        .select("host", F.explode("_sizes").alias("_n"))
        .filter(F.length("host") >= F.col("_n"))
        .select(
            "host",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.length("host") - F.col("_n") + 1),
                    lambda i: F.substr(F.col("host"), i, F.col("_n")),
                )
            ).alias("domain"),
        )
    )
    allowed = pieces.join(domains.select("domain"), "domain", "left_semi").select("host").distinct()
    return hosts_df.join(allowed, "host", "left_anti")


def in_networks(hosts_df: DataFrame, networks: DataFrame) -> DataFrame:
    """Rows of ``hosts_df(host)`` inside any of ``networks(network, bits)``.

    The range join becomes an equi-join on (prefix length, prefix): one row per
    distinct address and prefix length in use, at most 33.
    """
    prefix = lambda ip, bits: F.floor(ip / F.pow(F.lit(2), 32 - bits)).cast("bigint")
    nets = networks.select(
        F.col("bits").cast("int").alias("_bits"),
        prefix(hosts.ipv4_number(F.col("network")), F.col("bits")).alias("_prefix"),
    ).distinct()
    sizes = nets.agg(F.collect_set("_bits").alias("_sizes"))
    numbers = (
        hosts_df.select("host").distinct()
        .select("host", hosts.ipv4_number(F.col("host")).alias("_ip"))
        .filter(F.col("_ip").isNotNull())
        .select("host", "_ip", F.explode(sizes.scalar()).alias("_bits"))
        .select("host", "_bits", prefix(F.col("_ip"), F.col("_bits")).alias("_prefix"))
    )
    hit = numbers.join(nets, ["_bits", "_prefix"], "left_semi").select("host").distinct()
    return hosts_df.join(hit, "host", "left_semi")
