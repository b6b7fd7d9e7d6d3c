"""Building blocks of the oracle SQL: the corpus, file selection and planted findings."""

from __future__ import annotations

from reposieve import corpus, fixed


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FILES = "files AS (" + corpus.FILES.format(**corpus.DUCKDB) + ")"
REPOS = "repos AS (" + corpus.REPOS.format(**corpus.DUCKDB) + ")"
MESSAGES = "messages AS (" + corpus.MESSAGES.format(**corpus.DUCKDB) + ")"

BASE = "list_extract(string_split(path, '/'), -1)"
SPLITEXT = (
    f"CASE WHEN contains(ltrim({BASE}, '.'), '.') "
    f"THEN '.' || list_extract(string_split(lower({BASE}), '.'), -1) ELSE '' END"
)
LAST_DOT = "CASE WHEN contains(path, '.') THEN '.' || list_extract(string_split(lower(path), '.'), -1) ELSE '' END"
WORKFLOW = "(starts_with(path, '.github/workflows/') AND (ends_with(path, '.yml') OR ends_with(path, '.yaml')))"
CODE_EXTS = _list(fixed.CODE_EXTS)
LOCKFILES = _list(fixed.LOCKFILES)
MANIFESTS = _list(fixed.MANIFESTS)


def any_glob(globs) -> str:
    return "(" + " OR ".join(f"path GLOB {lit(g)}" for g in globs) + ")"


def any_of(fn: str, col: str, values) -> str:
    return "(" + " OR ".join(f"{fn}({col}, {lit(v)})" for v in values) + ")"


EXCLUDED = any_glob(fixed.CONFIGURED_IGNORES)
# Default selection, and one that lets everything in.
SELECTED = f"sel AS (SELECT * FROM files WHERE NOT {EXCLUDED} AND {SPLITEXT} IN ({CODE_EXTS}) AND length <= 500000)"
OPEN = "sel AS (SELECT * FROM files WHERE length <= 500000)"
DOC_LIKE = (
    "(" + any_of("ends_with", "lower(path)", fixed.DOC_EXTS) + " OR "
    + any_of("contains", "lower(path)", fixed.DOC_DIRS) + ")"
)
NOISY = (
    f"(list_extract(string_split(lower(path), '/'), -1) IN ({_list(fixed.NOISY_BASENAMES)}) OR "
    + any_of("contains", "lower(path)", fixed.NOISY_SNIPPETS) + ")"
)
LIGHT = r"regexp_matches(path, '(?i)(\.md$|\.txt$|LICENSE$|CHANGELOG)')"
PRINTABLE = r"length(regexp_replace(content, '[^\p{C}\p{Z} \r\n\t]|[ \r\n\t]', '', 'g'))"
BINARY = f"(contains(content, chr(0)) OR (length(content) - {PRINTABLE}) / greatest(length(content), 1) < 0.7)"
# Files that the full set of scanners looks at (corpus content is never empty).
CODE = f"(NOT {WORKFLOW} AND NOT {BINARY} AND {BASE} NOT IN ({LOCKFILES}))"

# (rule, severity, reason, pattern) in the dialect of the oracle.
SECRETS = (
    ("aws_access_key", "high", "Looks like an AWS Access Key ID", r"\bAKIA[0-9A-Z]{16}\b"),
    ("aws_secret_key", "critical", "Looks like an AWS Secret Key",
     r"""(?i)\baws(.{0,20})?(secret|access)\b.{0,3}[:=]\s*['"]([A-Za-z0-9/+=]{40})['"]"""),
    ("gh_token", "high", "Possible GitHub token", r"\bgh[pousr]_[A-Za-z0-9_]{30,}\b"),
    ("generic_api_key", "medium", "Generic API Key pattern",
     r"""(?i)\b(api[_-]?key|token|bearer)\b[^:<=\n]{0,20}[:=]\s*(['"][A-Za-z0-9_\-]{24,}['"])"""),
    ("password_inline", "high", "Hardcoded password",
     r"""(?i)\bpassword\b\s*[:=]\s*(['"][^'"\s]{8,}['"])"""),
)


def spans(rx: str, source: str = "sel", keep: str = "TRUE") -> str:
    """Rows ``(..., i, tok, s)``: every match with its offset, from match and gap lengths."""
    return f"""
      SELECT owner, name, path, content, i, toks[i] AS tok,
             CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) AS BIGINT)
             + COALESCE(CAST(list_sum(list_transform(toks[1:i-1], lambda g: length(g))) AS BIGINT), 0) AS s
      FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM (
              SELECT owner, name, path, content, regexp_extract_all(content, {lit(rx)}) AS toks,
                     regexp_split_to_array(content, {lit(rx)}) AS gaps
              FROM {source} WHERE {keep} AND regexp_matches(content, {lit(rx)})))"""


EVIDENCE = (
    "substr(content, greatest(s - 6, 0) + 1, s - greatest(s - 6, 0)) || '****redacted****' "
    "|| substr(content, s + length(tok) + 1, 6)"
)
COLUMNS = "owner, name, path, scanner, rule_id, severity, reason, evidence"


def secret_rule(rule: str, code: str = CODE) -> str:
    rule_id, sev, reason, rx = next(r for r in SECRETS if r[0] == rule)
    keep = code if rule in fixed.LIGHT_RULES else f"{code} AND NOT {LIGHT}"
    return (
        f"SELECT owner, name, path, 'secrets' AS scanner, {lit(rule_id)} AS rule_id, {lit(sev)} AS severity, "
        f"{lit(reason)} AS reason, {EVIDENCE} AS evidence FROM ({spans(rx, keep=keep)})"
    )


RUN40 = r"[A-Za-z0-9+/=_-]{40,}"
TOKENS = r"[A-Za-z0-9+/=_-]{24,}"
ENTROPY_BITS = "(SELECT entropy(ch) FROM (SELECT unnest(string_split(tok, '')) AS ch))"
CLASSES = (
    "(CAST(regexp_matches(tok, '[A-Z]') AS INT) + CAST(regexp_matches(tok, '[a-z]') AS INT)"
    " + CAST(regexp_matches(tok, '[0-9]') AS INT) + CAST(regexp_matches(tok, '[+/=_-]') AS INT))"
)
GUARDED = (
    "length(tok) <= 2000 AND NOT " + any_of("starts_with", "lower(tok)", fixed.SAFE_PREFIXES)
    + " AND NOT regexp_matches(tok, '(?i)^[0-9a-f]{32,64}$')"
    + " AND NOT regexp_matches(tok, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$')"
)
WORDS = r"(?i)(secret|secrets?|token|api[_-]?key|access[_-]?key|bearer|auth|password|pwd|credential)"
HINTS = r"(?i)(secret|token|api[_-]?key|bearer|auth(entication|orization)?|private|password|sign(ature)?|access[_-]?key)"
ASSIGN = r"""[:=]\s*["']?[A-Za-z0-9+/=_-]{10,}["']?"""


def entropy_tokens(code: str = CODE, exts=fixed.ENTROPY_EXTS, skip: str = NOISY, min_len: int = 40) -> str:
    """Tokens that pass every test but the context."""
    keep = f"{code} AND {any_of('ends_with', 'path', exts)} AND NOT {skip}"
    return f"""SELECT *, {ENTROPY_BITS} AS bits FROM (
       SELECT * FROM ({spans(TOKENS, keep=keep)}) WHERE length(tok) >= {min_len} AND {GUARDED} AND {CLASSES} >= 3
    ) WHERE {ENTROPY_BITS} >= 4.3"""


def entropy_rule(code: str = CODE) -> str:
    window = "substr(content, greatest(s - 80, 0) + 1, s + length(tok) + 80 - greatest(s - 80, 0))"
    return f"""SELECT owner, name, path, 'entropy_secrets' AS scanner, 'high_entropy_candidate' AS rule_id,
       'medium' AS severity,
       printf('High-entropy token-like string near secret-ish context (entropy=%.2f, len=%d).',
              bits, length(tok)) AS reason, '****redacted****' AS evidence
     FROM (SELECT *, {window} AS near FROM ({entropy_tokens(code)}))
     WHERE regexp_matches(near, {lit(WORDS)}) OR regexp_matches(near, {lit(ASSIGN)})"""


def entropy_line_rule(code: str = CODE) -> str:
    skip = (
        r"regexp_matches(path, '(?i)(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|Pipfile\.lock|poetry\.lock|"
        r"poetry\.toml|Cargo\.lock|composer\.lock|Podfile\.lock|package-lock\.json5?)$')"
    )
    before = "list_extract(string_split(substr(content, greatest(s - 60, 0) + 1, s - greatest(s - 60, 0)), chr(10)), -1)"
    after = "list_extract(string_split(substr(content, s + length(tok) + 1, 60), chr(10)), 1)"
    return f"""SELECT owner, name, path, 'entropy_secrets' AS scanner, 'high_entropy_candidate' AS rule_id,
       'medium' AS severity,
       printf('High-entropy token-like string with assignment + secret context (entropy=%.2f, len=%d).',
              bits, length(tok)) AS reason, '****redacted****' AS evidence
     FROM (SELECT *, {before} || tok || {after} AS near FROM ({entropy_tokens(code, fixed.ENTROPY_LINE_EXTS, skip)}))
     WHERE regexp_matches(near, {lit(HINTS)}) AND regexp_matches(near, {lit(ASSIGN)})"""


def _flat(scanner: str, rule: str, sev: str, reason: str, where: str, reason_sql: str | None = None) -> str:
    return (
        f"SELECT owner, name, path, '{scanner}' AS scanner, '{rule}' AS rule_id, '{sev}' AS severity, "
        f"{reason_sql or lit(reason)} AS reason, CAST(NULL AS VARCHAR) AS evidence FROM sel WHERE {where}"
    )


SCRIPT = "(ends_with(path, '.js') OR ends_with(path, '.ts') OR ends_with(path, '.sh') OR ends_with(path, '.bash'))"
BYTE_PATHS = any_of("ends_with", "path", fixed.BYTE_RULE_EXTS)


def rule(name: str, code: str = CODE) -> str:
    """Findings of one rule; Python and workflow rules are known from the template."""
    r = fixed.REASONS
    host = "concat('10.0.0.', CAST(doc_id % 250 AS VARCHAR))"
    outside = "concat('h', CAST(doc_id AS VARCHAR), '.example.com')"
    off = lambda h: f"concat('Domain ', {h}, ' not in allowed_domains policy.')"
    table = {
        "text_eval_call": lambda: _flat("static_risk", name, "medium", r["static.text_eval"],
                                        f"{code} AND {SCRIPT} AND contains(content, 'eval(')"),
        "node_exec_call": lambda: _flat(
            "static_risk", name, "medium", r["static.node_exec"],
            f"{code} AND {SCRIPT} AND (contains(lower(content), 'child_process.exec(') "
            "OR contains(lower(content), 'child_process.execsync('))"),
        "static.py_eval": lambda: _flat("static_risk", "py_eval", "medium", r["static.py_eval"], "k = 7"),
        "static.shell": lambda: _flat("static_risk", "py_subprocess_shell_true", "high", r["static.shell"], "k = 8"),
        "taint.py_eval": lambda: _flat("taint_risk", "py_eval", "high", r["taint.py_eval"], "k = 7"),
        "taint.shell": lambda: _flat("taint_risk", "py_subprocess_shell_tainted", "critical", r["taint.shell"], "k = 8"),
        "taint.subprocess": lambda: _flat("taint_risk", "py_subprocess_tainted", "high", r["taint.subprocess"], "k = 9"),
        "taint.file": lambda: _flat("taint_risk", "py_file_op_tainted", "high", r["taint.file"] % "/workspace", "k = 10"),
        "taint.url": lambda: _flat("taint_risk", "py_http_url_tainted", "high", r["taint.url"], "k = 11"),
        "taint.private": lambda: _flat(
            "taint_risk", "py_http_private_target", "high", "", "k = 11",
            f"concat('HTTP call to private/loopback address (', {host}, ') blocked by policy.')"),
        "taint.domain": lambda: " UNION ALL ".join(
            _flat("taint_risk", "py_http_off_allowlist", "medium", "", "k = 11", off(h)) for h in (host, outside)),
        "ci.floating": lambda: _flat("github_actions", "gha_uses_floating", "medium",
                                     r["ci.floating"] % ("actions/checkout@main", "main"), "k = 13"),
        "ci.unpinned": lambda: _flat("github_actions", "gha_uses_unpinned", "medium", r["ci.unpinned"] % "./local", "k = 13"),
        "ci.sha": lambda: " UNION ALL ".join(
            _flat("github_actions", "gha_uses_not_sha", "medium", r["ci.sha"] % u, "k = 13")
            for u in ("actions/checkout@main", "actions/setup@v4")),
        "ci.exfil": lambda: _flat("github_actions", "gha_secrets_exfil", "high", r["ci.exfil"], "k = 13"),
        "yara.token": lambda: _flat("yara", "HighEntropyTokenLike", "medium", r["bytes"] % "HighEntropyTokenLike",
                                    f"{code} AND {BYTE_PATHS} AND regexp_matches(content, {lit(RUN40)})"),
        "yara.exec": lambda: _flat(
            "yara", "Suspicious_Python_Exec", "medium", r["bytes"] % "Suspicious_Python_Exec",
            f"{code} AND {BYTE_PATHS} AND regexp_matches(content, "
            + lit(r"os\.system\s*\(|subprocess\.(Popen|call|run)\s*\(") + ")"),
        "entropy": lambda: entropy_rule(code),
    }
    return table[name]() if name in table else secret_rule(name, code)


ALL_RULES = (
    *(r[0] for r in SECRETS), "entropy", "text_eval_call", "node_exec_call", "static.py_eval", "static.shell",
    "taint.py_eval", "taint.shell", "taint.subprocess", "taint.file", "taint.url", "taint.private", "taint.domain",
    "ci.floating", "ci.unpinned", "ci.exfil", "yara.token", "yara.exec",
)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


FINDINGS = "fnd AS (" + "\nUNION ALL\n".join(rule(r) for r in ALL_RULES) + ")"
SCAN = with_(FILES, SELECTED, FINDINGS)
SUMMARY = f"""
stats AS (SELECT owner, name, count(*) AS files_scanned, CAST(sum(length) AS BIGINT) AS bytes_scanned
          FROM sel GROUP BY ALL),
verdict AS (SELECT owner, name, count(*) AS n,
                   bool_and(scanner = 'entropy_secrets' AND {DOC_LIKE}) AS relaxed,
                   bool_or(severity IN ('high', 'critical')) AS severe, bool_or(severity = 'medium') AS medium
            FROM fnd GROUP BY ALL),
keys AS (SELECT DISTINCT owner, name FROM repos),
summary AS (SELECT owner, name, COALESCE(files_scanned, 0) AS files_scanned, COALESCE(bytes_scanned, 0) AS bytes_scanned,
   COALESCE(n, 0) AS findings,
   CASE WHEN COALESCE(n, 0) = 0 OR relaxed THEN 'Safe' WHEN severe THEN 'Threat' ELSE 'Potential Threat' END AS classification,
   CASE WHEN COALESCE(n, 0) = 0 THEN 'No findings detected.'
        WHEN relaxed THEN 'Only high-entropy strings found in docs/config; likely non-secrets.'
        WHEN severe THEN 'High-risk secrets or dangerous patterns detected.'
        WHEN medium THEN 'Potentially sensitive tokens or patterns found.'
        ELSE 'Low-risk indicators found.' END AS summary
   FROM keys LEFT JOIN stats USING (owner, name) LEFT JOIN verdict USING (owner, name))"""
REPORTS = with_(FILES, SELECTED, FINDINGS, REPOS, SUMMARY.strip())
SCANNERS = "'secrets, entropy_secrets, static_risk, taint_risk, deps_audit, github_actions, yara'"
