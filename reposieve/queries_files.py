"""Source, selection and routing queries over the planted corpus and the given tables."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposieve import corpus, fixed
from reposieve import oracle as o
from reposieve.catalog import query
from reposieve.functions import globs, paths, text
from reposieve.operators import select
from reposieve.plans.scan import ScanConfig, repo_stats, scan, selected_files
from reposieve.policy import Policy
from reposieve.session import shared_folder
from reposieve.sources import documents, files as file_sources

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["owner", "name", "path"]


def _zipped(folder: str):
    """Write each batch of files as a zip archive, and one that is cut off (helper to build test input)."""
    def run(batches):
        import io
        import uuid
        import zipfile

        import pyarrow as pa
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
                zf.writestr("root/empty/", b"")
                for member, content in zip(batch.column("path"), batch.column("content")):
                    zf.writestr(f"root/{member.as_py()}", content.as_py().encode("utf-8"))
            name = uuid.uuid4().hex
            for kind, body in (("whole", out.getvalue()), ("cut", out.getvalue()[:-9])):
                with store.open_output_stream(f"{path}/{kind}__{name}.zip") as f:
                    f.write(body)
            yield pa.RecordBatch.from_pylist([{"archive": name}], pa.schema([("archive", pa.string())]))

    return run


@query("src1_read_archives", o.with_(o.FILES) + """
SELECT concat(owner, '/', name, '/', path) AS path, length AS n, md5(content) AS body FROM files""")
def src1(spark, sf):
    """Zip the corpus into the shared folder and read the archives; those cut off become error rows."""
    files = corpus.files(spark, sf).select(F.concat_ws("/", *KEY).alias("path"), "content")
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex[:12]}"
    folder = folder if ":" in folder else f"file://{folder}"
    made = files.mapInArrow(_zipped(folder), "archive string")
    made.write.format("noop").mode("overwrite").save()
    rows, _ = file_sources.read_archives(spark, folder, None)
    return rows.select("path", F.col("length").alias("n"), F.md5(F.col("content").cast("binary")).alias("body"))


def listing(spark, sf) -> DataFrame:
    """Tree listing of the corpus: its files and the folders they are in."""
    blobs = corpus.files(spark, sf).select(*KEY, F.lit("blob").alias("type"), "length")
    folder = F.regexp_extract("path", r"^(.*)/", 1)
    trees = blobs.select("owner", "name", folder.alias("path"), F.lit("tree").alias("type"),
                         F.lit(0).cast("bigint").alias("length")).distinct()
    return blobs.unionByName(trees)


@query("src2_select_blobs", o.with_(o.FILES) + f"""
SELECT owner, name, path, length AS n FROM files WHERE {o.SPLITEXT} IN ({o.CODE_EXTS}) AND length <= 4000
AND NOT path GLOB '*/fixtures/*'""")
def src2(spark, sf):
    chosen = file_sources.select_blobs(listing(spark, sf), 4000, exclude=("*/fixtures/*",))
    return chosen.select(*KEY, F.col("length").alias("n"))


@query("src3_decode_blob", """SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN '' ELSE text END AS body FROM documents""")
def src3(spark, sf):
    """Texts sent as base64 in lines of 60, as plain text, or in an unknown encoding."""
    docs = corpus.table(spark, sf, "documents")
    kind = F.col("doc_id") % 3
    enc = F.when(kind == 0, "base64").when(kind == 2, "utf-16")
    b64 = F.regexp_replace(F.base64(F.col("text").cast("binary")), "(.{60})", "$1\n")
    body = text.decode_blob(enc, F.when(kind == 0, b64).otherwise(F.col("text")))
    return docs.select("doc_id", body.alias("body"))


@query("src4_read_repos", o.with_(o.REPOS) + """
SELECT owner, name, full_name, html_url, CASE WHEN contains(name, 'lib') THEN 0 ELSE stargazers_count END AS stars,
       CASE WHEN contains(name, 'lib') THEN 'main' ELSE default_branch END AS default_branch FROM repos""")
def src4(spark, sf):
    """Repository list from JSON; the library repositories leave everything optional out."""
    lib = F.contains("name", F.lit("lib"))
    repos = corpus.repos(spark, sf)
    slim = [F.when(~lib, F.col(c)).alias(c) for c in ("full_name", "html_url", "stargazers_count", "default_branch")]
    items = repos.select(F.to_json(F.struct("owner", "name", *slim)).alias("item"), F.lit(0).alias("pos"))
    return documents.parse_repos(items).select(
        "owner", "name", "full_name", "html_url", F.col("stargazers_count").alias("stars"), "default_branch"
    )


@query("src5_read_reports", """
SELECT concat('doc-', CAST(doc_id AS VARCHAR)) AS session_id, source AS repo_name, n_chars AS files_scanned,
       CASE WHEN doc_id % 4 = 3 THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS findings, md5(text) AS reason
FROM documents""")
def src5(spark, sf):
    """Every document as a report line - object, array, Python literal or one with broken
    findings - among as many comments, half lines and blank lines, which are skipped."""
    d = corpus.table(spark, sf, "documents")
    kind = F.col("doc_id") % 4
    finding = F.struct(F.lit("a.py").alias("path"), F.lit("r").alias("rule_id"), F.col("text").alias("evidence"))
    report = lambda fs: F.to_json(F.struct(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("session_id"),
        F.struct(F.col("source").alias("name")).alias("repo"),
        F.struct(F.col("n_chars").alias("files_scanned")).alias("stats"),
        fs.alias("findings"), F.col("text").alias("summary"),
    ))
    d = d.select("*", report(F.array(finding)).alias("obj"))  # a column, so that five lines share one text
    obj = F.col("obj")
    literal = F.replace(obj, F.lit('"stats":'), F.lit('"status":None,"part":None,"stats":'))
    line = (
        F.when(kind == 0, obj).when(kind == 1, F.concat(F.lit("[1, "), obj, F.lit(", null]")))
        .when(kind == 2, literal).otherwise(report(F.lit("none")))
    )
    noise = [F.concat(F.lit("# "), obj), F.concat(F.lit(" // "), obj), F.left(obj, F.length(obj) - 1), F.lit("  ")]
    lines = d.select(F.lit(0).alias("pos"), F.explode(F.array(line, *noise)).alias("text"))
    r = documents.parse_reports(documents.items_of_lines(lines))
    return r.select(
        "session_id", F.col("repo.name").alias("repo_name"), "stats.files_scanned",
        F.coalesce(F.array_size("findings"), F.lit(0)).cast("bigint").alias("findings"),
        F.md5(F.col("summary").cast("binary")).alias("reason"),
    )


GLOBS = ("**/docs/**", "src/*.py", "*.y?ml", "[a-t]*/[!0-9]*1.??", "**/fixtures/**")


@query("flt1_glob_match", o.with_(o.FILES) + "SELECT path, "
       + ", ".join(f"path GLOB {o.lit(g)} AS g{i}" for i, g in enumerate(GLOBS))
       + f", {o.any_glob(GLOBS)} AS any_glob FROM files")
def flt1(spark, sf):
    each = [globs.glob_match("path", [g]).alias(f"g{i}") for i, g in enumerate(GLOBS)]
    return corpus.files(spark, sf).select("path", *each, globs.glob_match("path", GLOBS).alias("any_glob"))


@query("jn3_glob_list", o.with_(o.FILES) + f"SELECT owner, name, path FROM files WHERE {o.any_glob(fixed.DEFAULT_IGNORES)}")
def jn3(spark, sf):
    return corpus.files(spark, sf).filter(globs.glob_match("path", fixed.DEFAULT_IGNORES)).select(*KEY)


@query("flt2_select_paths", o.with_(o.FILES) + f"""
SELECT owner, name, path FROM files WHERE NOT {o.EXCLUDED} AND {o.SPLITEXT} IN ({o.CODE_EXTS})""")
def flt2(spark, sf):
    return select.select_paths(corpus.files(spark, sf)).select(*KEY)


@query("flt2_include_globs", o.with_(o.FILES) + """
SELECT owner, name, path FROM files WHERE NOT path GLOB '*/cfg*' AND (path GLOB 'docs/*' OR path GLOB 'src/*.py')""")
def flt2b(spark, sf):
    return select.select_paths(corpus.files(spark, sf), ("docs/*", "src/*.py"), ("*/cfg*",)).select(*KEY)


@query("flt3_not_ignored", o.with_(o.FILES) + """
SELECT path, path GLOB 'src/*' OR NOT (path GLOB '*.py' OR path GLOB '*.js') AS kept FROM files""")
def flt3(spark, sf):
    kept = select.not_ignored(F.col("path"), ("src/*",), ("*.py", "*.js"))
    return corpus.files(spark, sf).select("path", kept.alias("kept"))


@query("flt4_runner_ext", o.with_(o.FILES, f"""p AS (
  SELECT path FROM files UNION ALL SELECT concat('a.b/', {o.BASE}, '_x') FROM files
  UNION ALL SELECT concat(owner, '/.env') FROM files UNION ALL SELECT concat(name, '/Makefile') FROM files)""") + f"""
SELECT path, {o.LAST_DOT} AS ext, ({o.LAST_DOT}) IN ('', {o.CODE_EXTS}) OR {o.BASE} IN ({o.MANIFESTS}) AS ok FROM p""")
def flt4(spark, sf):
    f = corpus.files(spark, sf)
    p = F.col("path")
    odd = f.select("path").unionAll(f.select(F.concat(F.lit("a.b/"), paths.basename(p), F.lit("_x"))))
    odd = odd.unionAll(f.select(F.concat("owner", F.lit("/.env")))).unionAll(f.select(F.concat("name", F.lit("/Makefile"))))
    return odd.select("path", paths.last_dot_ext(p).alias("ext"), paths.runner_ext_ok(p).alias("ok"))


@query("flt5_size_ok", o.with_(o.FILES) + "SELECT owner, name, path, length AS n FROM files WHERE length <= 3000")
def flt5(spark, sf):
    return select.size_ok(corpus.files(spark, sf), 3000).select(*KEY, F.col("length").alias("n"))


@query("flt5_skipped_files", o.with_(o.FILES) + f"""
SELECT owner, name, path, length AS n, reason FROM (
  SELECT *, CASE WHEN length > 4000 THEN 'size' WHEN {o.EXCLUDED} THEN 'excluded'
                 WHEN {o.SPLITEXT} NOT IN ({o.CODE_EXTS}) THEN 'extension' END AS reason FROM files) WHERE reason IS NOT NULL""")
def flt5_skipped(spark, sf):
    """What selection leaves out, and why."""
    return select.skipped_files(corpus.files(spark, sf), max_bytes=4000).select(*KEY, F.col("length").alias("n"), "reason")


def landed(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("src2_read_tree", o.with_(o.FILES) + f"""
SELECT owner, name, path, length AS n, md5(content) AS body FROM files WHERE {o.SPLITEXT} IN ({o.CODE_EXTS})
AND length <= 4000 AND NOT path GLOB '*/api*'""")
def src2_read_tree(spark, sf):
    """The corpus as a tree of files in the shared folder; only selected ones are opened."""
    root = landed(spark, "tree")
    root = root if ":" in root else f"file://{root}"
    corpus.files(spark, sf).select(*KEY, "content").mapInArrow(_planted(root), "path string").write.format("noop").mode("overwrite").save()
    found = file_sources.read_tree(spark, root, 4000, exclude=("*/api*",))
    return found.select(*KEY, F.col("length").alias("n"), F.md5(F.col("content").cast("binary")).alias("body"))


def _planted(root: str):
    """Write files as a tree (helper to build test input)."""
    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for owner, name, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                at = f"{base}/{owner}/{name}/{path}"
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at) as f:
                    f.write(content.encode())
            yield batch.select(["path"])

    return run


@query("src6_ignore_file", o.with_(o.FILES) + """
SELECT owner, name, path FROM files WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT split_part(path, '/', 1) AS top
  FROM files WHERE path LIKE '%/%/%') t WHERE path GLOB concat(t.top, '/*'))""")
def src6(spark, sf):
    """An ignore file with the top folders that hold folders, written with blanks and comments, and its selection."""
    files, path = corpus.files(spark, sf), landed(spark, "ignore")
    tops = files.filter(F.size(F.split("path", "/")) > 2).select(F.substring_index("path", "/", 1).alias("top")).distinct()
    lines = F.explode(F.array(F.concat(F.lit("  "), "top", F.lit("/* ")), F.lit(""), F.concat(F.lit("# "), "top"), F.lit("\t")))
    tops.select(lines.alias("value")).write.text(path)
    globs_read = file_sources.read_ignore(spark, path)
    return files.filter(~globs.glob_match(F.col("path"), globs_read)).select(*KEY)


@query("src7_policy", o.with_(o.FILES) + f"""
SELECT rule_id, count(*) AS n FROM (
  SELECT unnest(['py_http_off_allowlist', 'py_http_off_allowlist']) AS rule_id FROM files WHERE k = 11 AND {o.SPLITEXT} IN ({o.CODE_EXTS})
  UNION ALL SELECT 'gha_uses_not_sha' FROM (SELECT unnest([1, 2]) FROM files WHERE k = 13)) GROUP BY ALL""")
def src7(spark, sf):
    """A policy document with the domains of all repositories' hosts, read back and applied."""
    path = landed(spark, "policy")
    hosts = corpus.repos(spark, sf).select(F.concat(F.lit("api."), F.regexp_extract("html_url", "//([^/]+)", 1)).alias("host")).distinct()
    doc = hosts.agg(F.to_json(F.struct(
        F.struct(F.lit(False).alias("block_private"), F.array_sort(F.collect_set("host")).alias("allowed_domains")).alias("network"),
        F.struct(F.lit(True).alias("require_sha_pin")).alias("ci"))).alias("value"))
    doc.write.text(path)
    found = scan(corpus.files(spark, sf), ScanConfig(exclude=(), policy=Policy.read(spark, path)))
    rules = ("py_http_private_target", "py_http_off_allowlist", "gha_uses_not_sha")
    return found.filter(F.col("rule_id").isin(*rules)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


_JUNK = """junk AS (SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN concat(text, chr(0)) WHEN 1 THEN concat(text, repeat(chr(1), CAST(length(text) AS INT)))
    WHEN 2 THEN concat(text, repeat(chr(1), CAST(length(text) // 4 AS INT))) WHEN 3 THEN ''
    WHEN 4 THEN concat(text, repeat(chr(160), CAST(length(text) AS INT))) ELSE text END AS content FROM documents)"""


@query("flt6_is_binary", o.with_(_JUNK) + f"""
SELECT doc_id, content <> '' AND {o.BINARY} AS is_bin FROM junk""")
def flt6(spark, sf):
    d = corpus.table(spark, sf, "documents")
    t, k, n = F.col("text"), F.col("doc_id") % 6, F.length("text")
    pad = lambda ch, m: F.concat(t, F.repeat(F.lit(ch), m))
    content = (
        F.when(k == 0, F.concat(t, F.lit("\0"))).when(k == 1, pad("\x01", n))
        .when(k == 2, pad("\x01", F.floor(n / 4).cast("int"))).when(k == 3, "")
        .when(k == 4, pad("\xa0", n)).otherwise(t)
    )
    return d.select("doc_id", content.alias("content")).select("doc_id", text.is_binary(F.col("content")).alias("is_bin"))


@query("flt7_non_empty", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' ELSE text END <> '' AS kept FROM documents")
def flt7(spark, sf):
    t = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text"))
    files = corpus.table(spark, sf, "documents").select(
        "doc_id", t.alias("content"), F.lit("a.py").alias("path"), F.octet_length("text").cast("bigint").alias("length"))
    return select.route(files).select("doc_id", F.array_contains("scanners", "secrets").alias("kept"))


_ROUTE = f"""CASE WHEN {o.WORKFLOW} THEN 'github_actions' WHEN {{skip}} THEN ''
  WHEN {o.BASE} IN ({o.LOCKFILES}) THEN 'deps_audit'
  WHEN {o.BASE} IN ({o.MANIFESTS}) THEN 'secrets,entropy_secrets,static_risk,taint_risk,deps_audit,yara'
  ELSE 'secrets,entropy_secrets,static_risk,taint_risk,yara' END"""


@query("flt8_route", o.with_(o.FILES) + "SELECT path, " + _ROUTE.format(skip=o.BINARY) + " AS scanners FROM files")
def flt8(spark, sf):
    routed = select.route(corpus.files(spark, sf), include=("*",), ignore=())
    return routed.select("path", F.array_join("scanners", ",").alias("scanners"))


@query("flt8_route_default", o.with_(o.FILES) + "SELECT path, " + _ROUTE.format(
    skip=f"{o.EXCLUDED} OR {o.BINARY} OR NOT (({o.LAST_DOT}) IN ('', {o.CODE_EXTS}) OR {o.BASE} IN ({o.MANIFESTS}))"
) + " AS scanners FROM files")
def flt8b(spark, sf):
    return select.route(corpus.files(spark, sf)).select("path", F.array_join("scanners", ",").alias("scanners"))


@query("flt9_manifest_files", o.with_(o.FILES, f"""p AS (SELECT owner, name, path FROM files
  UNION ALL SELECT owner, name, concat('svc', CAST(doc_id AS VARCHAR), '/pyproject.toml') FROM files)""") + f"""
SELECT owner, name, path, {o.BASE} AS basename, {o.BASE} IN ({o.LOCKFILES}) AS lockfile FROM p WHERE {o.BASE} IN ({o.MANIFESTS})""")
def flt9(spark, sf):
    f = corpus.files(spark, sf).select("doc_id", *KEY)
    more = f.withColumn("path", F.concat(F.lit("svc"), F.col("doc_id").cast("string"), F.lit("/pyproject.toml")))
    return select.manifest_files(f.unionByName(more))


@query("flt10_parse_globs", """
SELECT doc_id, array_to_string(list_filter(list_distinct_ordered, lambda x: x <> ''), '|') AS globs FROM (
  SELECT doc_id, list_reduce(list_transform(string_split(concat(' a,', lang, ',, ', source, ' ,', lang, ',a'), ','),
     lambda x: [trim(x)]), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_concat(acc, x) END)
     AS list_distinct_ordered FROM documents)""")
def flt10(spark, sf):
    spec = F.concat(F.lit(" a,"), "lang", F.lit(",, "), "source", F.lit(" ,"), "lang", F.lit(",a"))
    d = corpus.table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(globs.parse_globs(spec), "|").alias("globs"))


@query("flt11_effective_ignores", o.with_(o.FILES) + f"""
SELECT path, {o.any_glob((*fixed.DEFAULT_IGNORES, "conf/*", "web/*"))} AS by_default, path GLOB 'src/*' AS configured FROM files""")
def flt11(spark, sf):
    merged = globs.effective_ignores(extend=["conf/*"], env_extra=" web/* ,,conf/*")
    only = globs.effective_ignores(["src/*", " src/* ", ""], ["conf/*"])
    return corpus.files(spark, sf).select(
        "path", globs.glob_match("path", merged).alias("by_default"), globs.glob_match("path", only).alias("configured"))


@query("flt13_doc_like", o.with_(o.FILES) + f"SELECT path, {o.DOC_LIKE} AS doc_like FROM files")
def flt13(spark, sf):
    return corpus.files(spark, sf).select("path", paths.is_doc_like(F.col("path")).alias("doc_like"))


@query("flt14_noisy_path", o.with_(o.FILES) + f"SELECT path, {o.NOISY} AS noisy FROM files")
def flt14(spark, sf):
    return corpus.files(spark, sf).select("path", paths.is_noisy_path(F.col("path")).alias("noisy"))


@query("scf1_extensions", o.with_(o.FILES) + f"SELECT path, {o.SPLITEXT} AS ext, {o.LAST_DOT} AS last_dot, {o.BASE} AS base FROM files")
def scf1(spark, sf):
    p = F.col("path")
    return corpus.files(spark, sf).select(
        "path", paths.splitext(p).alias("ext"), paths.last_dot_ext(p).alias("last_dot"), paths.basename(p).alias("base"))


@query("wn2_cap_files", o.with_(o.FILES) + """
SELECT owner, name, path FROM files QUALIFY row_number() OVER (PARTITION BY owner, name ORDER BY path) <= 15""")
def wn2(spark, sf):
    return select.cap_files(corpus.files(spark, sf).drop("content"), 15).select(*KEY)


@query("ag1_repo_stats", o.with_(o.FILES, o.SELECTED) + f"""
SELECT owner, name, count(*) AS files_scanned, CAST(sum(length) AS BIGINT) AS bytes_scanned, {o.SCANNERS} AS scanners
FROM sel GROUP BY ALL""")
def ag1(spark, sf):
    stats = repo_stats(corpus.files(spark, sf))
    return stats.withColumn("scanners", F.array_join("scanners_used", ", ")).drop("scanners_used")


@query("flt2_root_aware", o.with_(o.FILES) + f"""
SELECT owner, name, path FROM files WHERE NOT {o.any_glob([*fixed.CONFIGURED_IGNORES, *(g[3:] for g in fixed.CONFIGURED_IGNORES)])}
AND {o.SPLITEXT} IN ({o.CODE_EXTS}) AND length <= 500000""")
def root_aware(spark, sf):
    return selected_files(corpus.files(spark, sf), ScanConfig(root_aware=True)).select(*KEY)
