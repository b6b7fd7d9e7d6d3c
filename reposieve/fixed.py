"""Fixed values. Results depend on these exact words, patterns and texts."""

import string

# --- file selection -------------------------------------------------------

CODE_EXTS = (
    ".py", ".ts", ".tsx", ".js", ".jsx",
    ".go", ".rs", ".java", ".kt", ".swift", ".scala",
    ".c", ".cpp", ".h", ".hpp", ".cs",
    ".rb", ".php",
    ".sh", ".bash", ".zsh", ".ps1",
    ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf",
)

LOCKFILES = (
    "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock",
    "Pipfile.lock", "Cargo.lock", "composer.lock", "go.sum",
)

MANIFESTS = LOCKFILES + (
    "package.json", "pyproject.toml", "requirements.txt", "Pipfile",
    "setup.cfg", "setup.py", "go.mod", "Cargo.toml", "composer.json",
    "Gemfile", "Gemfile.lock",
)

MAX_BYTES = 500_000
MAX_FILES_PER_REPO = 150
MIN_PRINTABLE_SHARE = 0.7

# Ignore globs used when nothing is configured.
DEFAULT_IGNORES = (
    "**/.git/**", "**/.github/**", "**/.gitlab/**", "**/.circleci/**",
    "**/__pycache__/**", "**/.mypy_cache/**", "**/.pytest_cache/**",
    "**/.cache/**", "**/.ruff_cache/**",
    "**/.venv/**", "**/venv/**", "**/.tox/**",
    "**/node_modules/**", "**/vendor/**",
    "**/dist/**", "**/build/**", "**/.next/**", "**/.vite/**", "**/out/**", "**/target/**",
    "**/package-lock.json", "**/pnpm-lock.yaml", "**/yarn.lock", "**/*.lock",
    "**/*.min.js", "**/*.min.css",
    "**/*.png", "**/*.jpg", "**/*.jpeg", "**/*.gif", "**/*.webp", "**/*.svg", "**/*.svgz",
    "**/*.ico", "**/*.icns",
    "**/*.pdf", "**/*.zip", "**/*.tar", "**/*.tgz", "**/*.gz", "**/*.xz", "**/*.7z",
    "**/*.bin", "**/*.exe", "**/*.dll", "**/*.so", "**/*.dylib",
    "**/*.mp4", "**/*.mov", "**/*.mp3", "**/*.wav",
    "**/*.ipynb",
    "**/fixtures/**", "**/fixture/**", "**/testdata/**", "**/tests/data/**",
    "**/samples/**", "**/sample_data/**",
    "**/docs/**", "**/website/**",
    "**/coverage/**", "**/.coverage*", "**/htmlcov/**", "**/reports/**",
    "**/report/**", "**/artifacts/**",
)

# Ignore globs of the shipped configuration; they replace DEFAULT_IGNORES.
CONFIGURED_IGNORES = (
    "**/.git/**", "**/.github/**", "**/.vscode/**", "**/.idea/**",
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/.venv/**",
    "**/*.min.js", "**/*.min.css", "**/*.lock",
    "**/*.png", "**/*.jpg", "**/*.jpeg", "**/*.gif", "**/*.webp",
    "**/*.pdf", "**/*.zip", "**/*.tar", "**/*.tgz", "**/*.gz",
    "**/package-lock.json", "**/pnpm-lock.yaml", "**/yarn.lock",
    "**/.next/**", "**/.vite/**",
    "**/docs/**", "**/website/**", "**/example/**", "**/demo/**",
    "**/*mock*/**", "**/*fixtures*/**", "**/fixtures/**", "**/mocks/**",
    "**/*.spec.ts", "**/*.test.ts", "**/*.stories.ts*",
)

WORKFLOW_DIR = ".github/workflows/"
WORKFLOW_EXTS = (".yml", ".yaml")

# --- secrets --------------------------------------------------------------

MASK = "****redacted****"
MASK_RADIUS = 6

# White space as Python's str patterns see it (Java's \s is ASCII only).
WS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# (rule_id, severity, reason, pattern); (?d) makes "." exclude only \n.
SECRET_RULES = (
    ("aws_access_key", "high", "Looks like an AWS Access Key ID",
     r"\bAKIA[0-9A-Z]{16}\b"),
    ("aws_secret_key", "critical", "Looks like an AWS Secret Key",
     rf"(?id)\baws(.{{0,20}})?(secret|access)\b.{{0,3}}[:=][{WS}]*['\"]([A-Za-z0-9/+=]{{40}})['\"]"),
    ("gh_token", "high", "Possible GitHub token",
     r"\bgh[pousr]_[A-Za-z0-9_]{30,}\b"),
    ("generic_api_key", "medium", "Generic API Key pattern",
     rf"(?i)\b(api[_-]?key|token|bearer)\b[^:<=\n]{{0,20}}[:=][{WS}]*(['\"][A-Za-z0-9_\-]{{24,}}['\"])"),
    ("password_inline", "high", "Hardcoded password",
     rf"(?i)\bpassword\b[{WS}]*[:=][{WS}]*(['\"][^'\"{WS}]{{8,}}['\"])"),
)
# A file without any of these lower-cased words cannot match the rule.
SECRET_WORDS = {
    "aws_access_key": ("akia",),
    "aws_secret_key": ("aws",),
    "gh_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "generic_api_key": ("api", "token", "bearer"),
    "password_inline": ("password",),
}
LIGHT_PATHS = r"(?i)(\.md$|\.txt$|LICENSE$|CHANGELOG)"
LIGHT_RULES = ("gh_token", "aws_secret_key")

# --- entropy --------------------------------------------------------------

# The class [A-Za-z0-9+/=_-], letter by letter: java.util.regex tests single characters
# by one bit lookup, but ranges one after the other.
TOKEN_CLASS = f"[{string.ascii_letters}{string.digits}+/=_-]"
TOKEN_MIN_RUN = 24
TOKEN_MIN_LEN = 40
TOKEN_MAX_LEN = 2000
TOKEN_MIN_BITS = 4.3
TOKEN_MIN_CLASSES = 3
CONTEXT_RADIUS = 80
LINE_RADIUS = 60
ENTROPY_EXTS = (
    ".py", ".js", ".ts", ".json", ".yaml", ".yml", ".env", ".ini", ".cfg", ".toml",
    ".sh", ".bash", ".zsh", ".ps1",
)
ENTROPY_LINE_EXTS = (
    ".py", ".js", ".ts", ".env", ".ini", ".cfg", ".toml", ".sh", ".bash", ".zsh", ".ps1",
)
ENTROPY_LINE_LOCKFILES = (
    r"(?i)(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|Pipfile\.lock|poetry\.lock|poetry\.toml|"
    r"Cargo\.lock|composer\.lock|Podfile\.lock|package-lock\.json5?)$"
)
SAFE_PREFIXES = ("http", "https", "ssh-", "rsa-", "ecdsa-", "-----begin", "data:")
UUID_SHAPE = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
HEX_SHAPE = r"(?i)^[0-9a-f]{32,64}$"
NOISY_BASENAMES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "repo_db_mapping.json")
NOISY_SNIPPETS = (
    "/docs/", "/website/", "/fixtures/", "/fixture/", "/testdata/", "/tests/data/",
    "/samples/", "/sample_data/", "/webchat/", "/dashboard/", "/frontend_", "/client/",
)
CONTEXT_WORDS = (
    r"(?i)(secret|secrets?|token|api[_-]?key|access[_-]?key|bearer|auth|password|pwd|credential)"
)
CONTEXT_HINTS = (
    r"(?i)(secret|token|api[_-]?key|bearer|auth(entication|orization)?|private|password|"
    r"sign(ature)?|access[_-]?key)"
)
ASSIGNMENT = rf"[:=][{WS}]*[\"']?[A-Za-z0-9+/=_-]{{10,}}[\"']?"
ENTROPY_REASON = "High-entropy token-like string near secret-ish context (entropy=%.2f, len=%d)."
ENTROPY_LINE_REASON = (
    "High-entropy token-like string with assignment + secret context (entropy=%.2f, len=%d)."
)

# --- static and taint rules -------------------------------------------------

STATIC_TEXT_EXTS = (".js", ".ts", ".sh", ".bash")
CODE_RUNNERS = ("eval", "exec")
SHELL_CALLS = ("run", "call", "Popen")
FILE_CALLS = (("os", "remove"), ("os", "unlink"), ("shutil", "rmtree"), ("builtins", "open"))
HTTP_CALLS = ("get", "post", "put", "delete")
URL_HOST = rf"https?://([^/{WS}:]+)"

REASONS = {
    "static.py_eval": "Use of eval can enable code injection.",
    "static.py_exec": "Use of exec can enable code injection.",
    "static.shell": "subprocess with shell=True increases risk of command injection.",
    "static.text_eval": "Use of eval() can enable code injection.",
    "static.node_exec": "Node.js exec/execSync used; review input validation.",
    "taint.py_eval": "Use of eval with potential user-controlled input.",
    "taint.py_exec": "Use of exec with potential user-controlled input.",
    "taint.shell": "subprocess with shell=True using tainted input (command injection risk).",
    "taint.subprocess": "subprocess invoked with tainted input. Validate/allowlist args.",
    "taint.file": "File operation uses tainted path; enforce safe-root %s and normalize.",
    "taint.url": "HTTP request with tainted URL; enforce allowlist.",
    "taint.private": "HTTP call to private/loopback address (%s) blocked by policy.",
    "taint.domain": "Domain %s not in allowed_domains policy.",
    "ci.sha": "Action '%s' not pinned to a full-length commit SHA.",
    "ci.floating": "Action '%s' pinned to floating ref '%s'.",
    "ci.unpinned": "Action '%s' not pinned (missing @ref).",
    "ci.exfil": "Step runs network command and references secrets/GITHUB_TOKEN.",
    "bytes": "Matched YARA rule '%s'.",
}

# Networks that count as private: (network, prefix length).
PRIVATE_NETWORKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
)
PUBLIC_EXCEPTIONS = ("192.0.0.9", "192.0.0.10")

# --- workflow rules -----------------------------------------------------------

FLOATING_REFS = ("master", "main", "latest", "edge")
RISKY_RUN = rf"(?i)(curl|wget|nc|powershell|Invoke-WebRequest|bash[{WS}]+-c|sh[{WS}]+-c)"
SECRET_IN_RUN = r"(?i)(GITHUB_TOKEN|secrets\.[A-Z0-9_]+)"
SHA_PIN = r"\A[0-9a-fA-F]{40}\z"

# --- byte-pattern rules ---------------------------------------------------------

BYTE_RULE_EXTS = (
    ".py", ".js", ".ts", ".json", ".yml", ".yaml", ".toml", ".sh", ".env", ".cfg", ".ini", ".txt",
)
EXEC_BYTES = r"os\.system\s*\(|subprocess\.(Popen|call|run)\s*\("

# --- classification and reports ---------------------------------------------------

SCANNERS = (
    "secrets", "entropy_secrets", "static_risk", "taint_risk", "deps_audit", "github_actions", "yara",
)
DOC_DIRS = (".github/", ".vscode/", "docs/", "doc/", "documentation/", "examples/")
DOC_EXTS = (".md", ".rst", ".adoc", ".txt")
SUMMARY_NONE = "No findings detected."
SUMMARY_DOCS = "Only high-entropy strings found in docs/config; likely non-secrets."
SUMMARY_THREAT = "High-risk secrets or dangerous patterns detected."
SUMMARY_TOKENS = "Potentially sensitive tokens or patterns found."
SUMMARY_LOW = "Low-risk indicators found."
CLASS_RANK = {"Threat": 3, "Potential Threat": 2, "Safe": 1, "Unscanned": 0, "Error": 0}
EXIT_CODES = {"Safe": 0, "Potential Threat": 1, "Threat": 2}
SEVERITIES = ("low", "medium", "high", "critical")
CLASSES = ("Safe", "Potential Threat", "Threat")
