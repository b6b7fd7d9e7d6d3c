"""Repository lists: search and paging, seen repositories, stars, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposieve.operators.ranking import number_rows, skip_first
from reposieve.operators.select import REPO

LIST_ORDER = ["full_name"]
DEFAULT_BRANCH = "main"
URL_PREFIX = "https://github.com/"


def with_defaults(repos: DataFrame) -> DataFrame:
    """Fill what a repository list may leave out."""
    full = F.concat(F.col("owner"), F.lit("/"), F.col("name"))
    return repos.withColumns({
        "full_name": F.coalesce(F.col("full_name"), full),
        "html_url": F.coalesce(F.col("html_url"), F.concat(F.lit(URL_PREFIX), full)),
        "stargazers_count": F.coalesce(F.col("stargazers_count"), F.lit(0)),
        "default_branch": F.coalesce(F.col("default_branch"), F.lit(DEFAULT_BRANCH)),
    })


def split_full_name(full_name: Column, owner: Column, name: Column) -> list[Column]:
    """Owner and name from ``owner/name``, else from their own fields."""
    slash = F.contains(full_name, F.lit("/"))
    rest = F.substr(full_name, F.locate("/", full_name) + 1)
    return [
        F.when(slash, F.substring_index(full_name, "/", 1)).otherwise(owner).alias("owner"),
        F.when(slash, rest).otherwise(name).alias("name"),
    ]


def search_repos(
    found: DataFrame,
    per_page: int = 10,
    pages: int = 1,
    page_start: int = 1,
    min_stars: int | None = None,
    max_results: int | None = None,
) -> DataFrame:
    """Pages of a listing by stars; the star filter and the result limit apply within them."""
    size = max(1, min(per_page, 100))
    first = max(1, page_start)
    count = max(0, page_start + max(1, pages) - first)
    order = [F.col("stargazers_count").desc(), F.col("full_name")]
    if first == 1:
        page = found.orderBy(*order).limit(count * size)
    else:  # a deep page is taken from a distributed rank: the rows before it do not meet in one task
        before, rank = (first - 1) * size, F.col("_rank")
        page = number_rows(found, order, "_rank").filter((rank > before) & (rank <= before + count * size)).drop("_rank")
    owner, name = split_full_name(F.col("full_name"), F.col("owner"), F.col("name"))
    out = page.select(
        owner, name,
        F.coalesce(F.nullif(F.col("full_name"), F.lit("")), F.concat("owner", F.lit("/"), "name"))
        .alias("full_name"),
        F.coalesce("html_url", F.lit("")).alias("html_url"),
        "stargazers_count",
        F.coalesce("default_branch", F.lit(DEFAULT_BRANCH)).alias("default_branch"),
    )
    if min_stars is not None:
        out = out.filter(F.col("stargazers_count") >= min_stars)
    return out if max_results is None else out.orderBy(*order).limit(max_results)


def seen_keys(runs: DataFrame) -> DataFrame:
    """Keys of repositories in earlier output: ``results[].repo``, ``repos[]`` or bare rows.

    ``runs`` has the columns ``owner``, ``name``, ``results`` and ``repos``.
    """
    bare = runs.select(*REPO)
    in_results = runs.select(F.col("results.repo").alias("u"))
    results = in_results.select(F.explode_outer("u").alias("r")).select("r.owner", "r.name")
    listed = runs.select(F.explode_outer("repos").alias("r")).select("r.owner", "r.name")
    keys = bare.unionByName(results).unionByName(listed)
    return keys.filter((F.col("owner") != "") & (F.col("name") != "")).distinct()


def skip_seen(repos: DataFrame, seen: DataFrame) -> DataFrame:
    return repos.join(seen.select(*REPO), REPO, "left_anti")


def resume(repos: DataFrame, n: int) -> DataFrame:
    """Leave out the first ``n`` repositories of the list order."""
    return skip_first(repos, [F.col(c) for c in LIST_ORDER], n)


def with_stars(reports: DataFrame, repos: DataFrame) -> DataFrame:
    """Add ``stars``; unknown repositories get 0, of repeated names the last one counts.

    "Last" is the order of ``pos`` where the list has it, else the greater star count.
    """
    last = F.max_by("stargazers_count", "pos") if "pos" in repos.columns else F.max("stargazers_count")
    stars = repos.groupBy(F.col("full_name").alias("_full")).agg(last.alias("_stars"))
    full = F.concat(F.col("owner"), F.lit("/"), F.col("name"))
    return (
        reports.withColumn("_full", full)
        .join(stars, "_full", "left")
        .withColumn("stars", F.coalesce("_stars", F.lit(0)))
        .drop("_full", "_stars")
    )


def assign_batches(repos: DataFrame, size: int = 10) -> DataFrame:
    """Number consecutive groups of ``size`` repositories in list order."""
    numbered = number_rows(repos, [F.col(c) for c in LIST_ORDER], "_rank")
    batch = F.floor((F.col("_rank") - 1) / F.lit(max(1, size))) + 1
    return numbered.withColumn("batch", batch.cast("bigint")).drop("_rank")


def repo_list(repos: DataFrame) -> DataFrame:
    """Numbered list of repositories."""
    return number_rows(repos, [F.col(c) for c in LIST_ORDER], "pos").select(
        "pos", F.col("full_name").alias("repository"), F.col("stargazers_count").alias("stars"),
        F.col("html_url").alias("url"),
    )
