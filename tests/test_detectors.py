import ast
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from reposieve import fixed
from reposieve.functions import hosts, text
from reposieve.operators import pyfacts, secrets, taint
from reposieve.plans.scan import ScanConfig, errors_of, findings_of, scan, scan_files
from reposieve.policy import Policy

B40 = "".join(map(chr, [*range(65, 91), *range(97, 107), *range(48, 52)]))


def rules(df):
    return sorted((r["path"], r["scanner"], r["rule_id"], r["severity"]) for r in df.collect())


def hits(make_files, *pairs, **conf):
    conf.setdefault("exclude", ())
    return scan(make_files(*pairs), ScanConfig(**conf)).collect()


def test_secrets_are_masked(make_files):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    body = f"one {key} two\n{key}\npassword = 'hunter2hunter2'\n"
    got = hits(make_files, ("a.py", body), enabled=("secrets",))
    ev = sorted((r["rule_id"], r["ord"], r["evidence"]) for r in got)
    assert ev == [
        ("aws_access_key", 0, f"one {fixed.MASK} two\nA"), ("aws_access_key", 1, f"8 two\n{fixed.MASK}\npassw"),
        ("password_inline", 0, f"6G7H8\n{fixed.MASK}\n"),
    ]
    assert not any(key in r["evidence"] or "hunter2" in r["evidence"] for r in got)


@pytest.mark.parametrize("path,expected", [("a.py", 5), ("README.md", 2), ("LICENSE", 2), ("CHANGELOG.yml", 2)])
def test_light_paths(make_files, path, expected):
    body = "\n".join([
        "AKIA" + "Z" * 16, f'aws_secret = "{B40}"', "ghp_" + "a" * 36, 'api_key: "' + "k" * 30 + '"', 'password: "longenough"',
    ])
    got = hits(make_files, (path, body), include=("*",), enabled=("secrets",))
    assert len({r["rule_id"] for r in got}) == expected


def test_secret_patterns_equal_python(spark, make_files):
    """Random text from pattern pieces: same matches and evidence as a plain loop."""
    rng = random.Random(3)
    bits = ["AKIA", "A" * 16, "aws", "secret", "access", " = ", ": ", '"', "'", B40, "ghp_", "x" * 30, "token", "bearer",
            "api_key", "password", "\n", " ", "é", " ", "_", "-", "longpassword", "="]
    docs = [(f"d{i}.py", "".join(rng.choice(bits) for _ in range(rng.randint(5, 40)))) for i in range(300)]
    plain = {
        r: rx.replace(fixed.WS, r"\s").replace("(?id)", "(?i)") for r, _s, _d, rx in fixed.SECRET_RULES
    }
    want = []
    for path, t in docs:
        for rule, rx in plain.items():
            for m in re.finditer(rx, t):
                a, b = m.span()
                want.append((path, rule, t[max(0, a - 6):a] + fixed.MASK + t[b:b + 6]))
    found = scan(make_files(*docs), ScanConfig(exclude=(), enabled=("secrets",))).collect()
    assert sorted((r["path"], r["rule_id"], r["evidence"]) for r in found) == sorted(want)
    spans = secrets.secret_spans(make_files(*docs)).collect()
    starts = sorted((r["path"], r["rule_id"], r["start"], r["end"]) for r in spans)
    assert starts == sorted(
        (p, rule, *m.span()) for p, t in docs for rule, rx in plain.items() for m in re.finditer(rx, t))


def python_entropy(s):
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s)) if s else 0.0


def test_entropy_functions(spark):
    cases = ["", "a", "ab", "aabbccdd", B40, "éé漢字x"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    for r in df.select("s", text.shannon_entropy(F.col("s")), text.char_classes(F.lit("aA1_"))).collect():
        assert r[1] == pytest.approx(python_entropy(r[0])) and r[2] == 4


def test_entropy_context_and_gates(make_files):
    tok = B40 + "+/x9"
    far = "~ " * 60
    got = hits(
        make_files, ("a.py", f"token {tok}"), ("b.py", f"{far}{tok}{far}"), ("c.py", f"x = {tok}"), ("d.md", f"token {tok}"),
        ("x/docs/e.py", f"token {tok}"), ("f.py", "token " + "ab" * 30), ("g.py", f"token https{tok}"),
        ("h.py", f"secret{far[:70]} {tok}"), ("i.py", f"secret{far[:90]} {tok}"), enabled=("entropy_secrets",),
    )
    assert sorted(r["path"] for r in got) == ["a.py", "c.py", "h.py"]
    a = next(r for r in got if r["path"] == "a.py")
    assert a["evidence"] == fixed.MASK and a["severity"] == "medium"
    assert a["reason"] == fixed.ENTROPY_REASON % (python_entropy(tok), len(tok))


def test_entropy_line_window(make_files):
    tok = B40 + "+/x9"
    got = hits(
        make_files, ("a.py", f"token = {tok}"), ("b.py", f"token = 1\nx = {tok}"), ("c.py", f"token {tok}"),
        ("d.json", f"token = {tok}"), enabled=("entropy_secrets",), entropy={"window": "line", "radius": 60},
    )
    assert [r["path"] for r in got] == ["a.py"]


def test_entropy_rounding_is_half_even(make_files):
    # 64 characters in dyadic shares: exactly 4.625 bits, a tie for two decimals.
    tok = "ABCDEFGH" * 4 + "abcdefghijkl" * 2 + "01234567"
    assert len(tok) == 64 and python_entropy(tok) == 4.625
    got = hits(make_files, ("a.py", f"token = {tok}"), enabled=("entropy_secrets",))
    assert [r["reason"] for r in got] == [fixed.ENTROPY_REASON % (4.625, 64)]
    assert "4.62," in got[0]["reason"]


def test_script_and_byte_rules(make_files):
    got = hits(
        make_files, ("a.js", "eval('1'); Child_Process.ExecSync('x')"), ("b.sh", "EVAL(1)"), ("c.py", "#eval( child_process.exec("),
        ("d.py", "os.system ('x')"), ("e.json", "a" * 40), ("f.go", "a" * 40), ("g.txt", "subprocess.call\t("),
        enabled=("static_risk", "yara"), include=("*",),
    )
    assert sorted((r["path"], r["rule_id"]) for r in got) == [
        ("a.js", "node_exec_call"), ("a.js", "text_eval_call"), ("d.py", "Suspicious_Python_Exec"),
        ("e.json", "HighEntropyTokenLike"), ("g.txt", "Suspicious_Python_Exec"),
    ]


PROGRAM = '''
import os, shutil, subprocess, requests, builtins
def f(a, *rest, k=1):
    b = a
    c = rest
    eval(b); exec("1"); x.eval(b)
    subprocess.run(b, shell=True)
    subprocess.call(["x"], b)
    subprocess.Popen(c, shell=True)
    x.y.run(1, shell=True)
    os.remove(b); shutil.rmtree(k); builtins.open(b); open(b); open("x", b)
    requests.get(b); requests.head(b)
requests.put("http://192.168.1.1:80/x"); requests.delete("https://api.github.com.evil/x"); requests.get("nope")
z = a
subprocess.run(z)
'''


def test_static_and_taint_rules(make_files):
    got = hits(make_files, ("a.py", PROGRAM), enabled=("static_risk", "taint_risk"))
    count = lambda s, r: sum(x["scanner"] == s and x["rule_id"] == r for x in got)
    assert {r: count("static_risk", r) for r in ("py_eval", "py_exec", "py_subprocess_shell_true")} == {
        "py_eval": 1, "py_exec": 1, "py_subprocess_shell_true": 3}
    assert {r: count("taint_risk", r) for r in (
        "py_eval", "py_exec", "py_subprocess_shell_tainted", "py_subprocess_tainted", "py_file_op_tainted",
        "py_http_url_tainted", "py_http_private_target", "py_http_off_allowlist")} == {
        "py_eval": 1, "py_exec": 1, "py_subprocess_shell_tainted": 1, "py_subprocess_tainted": 2,
        "py_file_op_tainted": 3, "py_http_url_tainted": 1, "py_http_private_target": 1, "py_http_off_allowlist": 1}
    reasons = {r["rule_id"]: r["reason"] for r in got if r["scanner"] == "taint_risk"}
    assert "192.168.1.1" in reasons["py_http_private_target"] and "/workspace" in reasons["py_file_op_tainted"]


def test_policy_switches(make_files):
    off = Policy(block_private=False, allowed_domains=(), safe_root="/100%")
    got = hits(make_files, ("a.py", PROGRAM), enabled=("taint_risk",), policy=off)
    assert not {"py_http_private_target", "py_http_off_allowlist"} & {r["rule_id"] for r in got}
    assert any("/100%" in r["reason"] for r in got)
    assert Policy.from_dict({"network": {"block_private": False}}) == Policy(block_private=False, allowed_domains=())


def ordered_taint(source):
    """Names in order of a parent-first walk, in one pass."""
    seen = set()

    def visit(node):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            seen.update(a.arg for a in node.args.args)
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Name) and node.value.id in seen:
            seen.update(t.id for t in node.targets if isinstance(t, ast.Name))
        for child in ast.iter_child_nodes(node):
            visit(child)

    visit(ast.parse(source))
    return seen


def test_taint_flow_equals_ordered_pass(spark):
    rng = random.Random(5)
    names = "abcdefg"
    programs = []
    for _ in range(80):
        lines = ["open(q)"]
        for _ in range(rng.randint(2, 14)):
            x, y, z = (rng.choice(names) for _ in range(3))
            lines.append(rng.choice([f"{x} = {y}", f"{x} = {z} = {y}", f"{x} = 1", f"def f({x}):\n    {y} = {x}\n    {z} = {y}"]))
        programs.append("\n".join(lines))
    df = spark.createDataFrame([(p,) for p in programs], "src string")
    flow = F.map_keys(taint.taint_times(pyfacts.py_facts("src")["facts"]))
    for r in df.select("src", flow.alias("t")).collect():
        assert set(r["t"]) == ordered_taint(r["src"]), r["src"]


def test_broken_sources_become_errors(make_files):
    deep = "x = " + "(" * 400 + "1" + ")" * 400 + "\nopen(x)"
    files = make_files(
        ("ok.py", "def f(a): eval(a)"), ("bad.py", "def (: eval"), ("deep.py", deep),
        (".github/workflows/a.yml", "jobs: {b: {steps: [x]}}"), (".github/workflows/b.yml", "jobs: ["),
        (".github/workflows/c.yml", "- 1\n---\njobs: {b: {steps: [{uses: ./x}]}}"),
    )
    scanned = scan_files(files, ScanConfig(exclude=()))
    bad = sorted({r["path"] for r in errors_of(scanned).collect()})
    assert bad == [".github/workflows/a.yml", ".github/workflows/b.yml", "bad.py", "deep.py"]
    assert sorted({r["path"] for r in findings_of(scanned).collect()}) == [".github/workflows/c.yml", "ok.py"]


def test_deeply_nested_workflow_loses_only_itself(make_files):
    files = make_files(
        (".github/workflows/deep.yml", "[" * 200_000), (".github/workflows/maps.yml", "\n".join(" " * i + "a:" for i in range(600))),
        (".github/workflows/good.yml", "jobs: {b: {steps: [{uses: ./x}]}}"), ("ok.py", "def f(a): eval(a)"),
    )
    scanned = scan_files(files, ScanConfig(exclude=()))
    assert sorted(r["path"] for r in errors_of(scanned).collect()) == [".github/workflows/deep.yml", ".github/workflows/maps.yml"]
    assert {r["path"] for r in findings_of(scanned).collect()} == {".github/workflows/good.yml", "ok.py"}


def test_many_tokens_take_linear_time(make_files):
    import random
    import time

    r = random.Random(1)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    body = "\n".join(f"token = {''.join(r.choices(chars, k=44))}" for _ in range(9000))
    t0 = time.time()
    found = hits(make_files, ("a.py", body), enabled=("entropy_secrets",))
    assert len(found) > 8000 and time.time() - t0 < 20


def test_many_parameters_take_linear_time(make_files):
    import time

    names = ", ".join(f"parameter_name_{i:08}" for i in range(16000))
    t0 = time.time()
    found = hits(make_files, ("a.py", f"def f({names}):\n  x = parameter_name_00000007\n  eval(x)\n"), enabled=("taint_risk",))
    assert len(found) == 1 and time.time() - t0 < 20


def test_chains_of_copies_take_linear_time(make_files):
    import time

    chain = "\n".join(f"  n{i + 1} = n{i}" for i in range(24000))
    files = [("a.py", f"def f(n0):\n{chain}\n  eval(n24000)\n  open(other)\n  open(n24000)\n"), ("b.py", "def g(p):\n  x = x = p\n  open(x)")]
    t0 = time.time()
    found = hits(make_files, *files, enabled=("taint_risk",))
    assert [(r["path"], r["rule_id"]) for r in found] == [
        ("a.py", "py_eval"), ("a.py", "py_file_op_tainted"), ("b.py", "py_file_op_tainted")]
    assert time.time() - t0 < 5


def test_char_classes_of_any_script(spark):
    from pyspark.sql import functions as F

    from reposieve.functions.text import char_classes

    cases = ["aÉ9", "ÉÉ", "é²", "٣x", "+", "", "aA1=", "ß"]
    want = [any(c.isupper() for c in s) + any(c.islower() for c in s) + any(c.isdigit() for c in s) + any(c in "+/=_-" for c in s) for s in cases]
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert [x[0] for x in df.select(char_classes(F.col("s"))).collect()] == want


def test_lone_surrogate_literal_loses_only_its_file(make_files):
    got = hits(make_files, ("a.py", 'open("\\ud800")'), ("b.py", "def f(p): open(p)"), enabled=("taint_risk",))
    assert [r["path"] for r in got] == ["b.py"]


WORKFLOW = """
jobs:
  a:
    steps:
      - uses: x/y@main
      - uses: x/y@v1
      - uses: x/y@0123456789abcdef0123456789abcdef01234567
      - uses: ./z
      - run: sync; echo ${{ secrets.KEY }}
      - run: curl x
      - {run: 5, uses: [1]}
  b: null
---
jobs: {c: {steps: [{uses: 'q@latest'}]}}
"""


def test_workflow_rules(make_files):
    path = ".github/workflows/ci.yaml"
    count = lambda **p: sorted(r["rule_id"] for r in hits(make_files, (path, WORKFLOW), policy=Policy(**p)))
    assert count() == ["gha_secrets_exfil", "gha_uses_floating", "gha_uses_floating", "gha_uses_unpinned"]
    assert count(require_sha_pin=True) == ["gha_secrets_exfil", *["gha_uses_not_sha"] * 3, "gha_uses_unpinned"]
    assert count(require_pinned=False) == ["gha_secrets_exfil"]


def test_private_hosts(spark):
    import ipaddress

    rng = random.Random(9)
    first = [0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 255, 8]
    cases = [f"{rng.choice(first)}.{rng.choice([0, 2, 16, 18, 31, 32, 51, 168, 254])}.{rng.choice([0, 2, 100, 113])}.{rng.randint(0, 12)}"
             for _ in range(400)]
    cases += ["10.0.0.256", "010.0.0.1", "localhost", "10.0.0", "a10.0.0.1", "255.255.255.255"]

    def want(h):
        try:
            ip = ipaddress.ip_address(h)
            return ip.is_private or ip.is_loopback or ip.is_link_local
        except ValueError:
            return False

    df = spark.createDataFrame([(c,) for c in cases], "h string")
    for r in df.select("h", hosts.is_private_host(F.col("h"))).collect():
        assert r[1] == want(r[0]), r


def test_partition_count_does_not_matter(spark, make_files):
    files = make_files(*((f"s{i}.py", PROGRAM + f"# {i}\ntoken = '{B40}{i}'") for i in range(12)))
    results = [sorted(map(tuple, scan(files.repartition(n)).collect())) for n in (1, 3, 16)]
    assert results[0] == results[1] == results[2] and len(results[0]) > 100
