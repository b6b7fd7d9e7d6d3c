import hashlib
import random
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from reposieve.llm import infill
from reposieve.llm.queries import QUERIES
from tests.llm.helpers import awkward, docs, prose, with_extra

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    """The contract, with lists of units and no skip list."""
    text = text or ""
    u = UNIT.findall(text)
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    a, b, c, d = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
        return doc_id, len(u), "plain", None, None, sha(text), sha(text)
    low, high = sorted((a % (len(u) + 1), b % (len(u) + 1)))
    p, m, s = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    form = "spm" if d % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(u), form, len(p), len(m), sha(out), sha(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\n\x0b é漢\U0001F600<P>SM", max_size=60), st.integers(0, 1000))
def test_round_trip(text, doc_id):
    _, form, _, _, out = infill.infill(doc_id, text.encode())
    assert infill.restore(out.decode(), form) == text


def test_skip_list_reaches_every_rank():
    r = random.Random(3)
    for n in (1, 2, 9, 70, 700, 5000):
        text = "".join(r.choice("aé漢 \n\U0001F600") for _ in range(n))
        u = UNIT.findall(text)
        widths = infill.code_points(text.encode(), infill.units(text.encode()))
        assert widths.tolist() == [len(x) for x in u]
        found, before = infill.SkipList(widths), 0
        assert all(int(lane[1].sum()) == len(u) and int(lane[2].sum()) == n for lane in found.lanes)
        for k, x in enumerate([*u, ""]):
            assert found.chars_before(k) == before
            before += len(x)
    assert len(found.lanes) > 2


def test_query_against_definition(spark):
    want = {r.doc_id: brute(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_infill"](spark, SF)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert {r.doc_id: tuple(r) for r in got.collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert {r[0]: r for r in con.sql(infill.INFILL_SQL).fetchall()} == want


def test_awkward_rows(spark, tmp_path):
    table = with_extra(awkward(spark))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_infill"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(r.doc_id, r.text) for r in table.collect()), key=repr)
    assert infill.transform(docs(spark, [])).collect() == []


def test_parameters(spark):
    df = docs(spark, [prose(k, 30) for k in range(40)])
    marks = ("(a|", "(b|", "(c|")
    out = infill.transform(df, ["doc_id", "source"], seed=7, rate=100, spm_rate=0, sentinels=marks)
    assert {r.form for r in out.collect()} == {"psm"}
    back = out.select("doc_id", "source", infill.restored(out.output, out.form, marks).alias("text"))
    assert sorted(back.collect()) == sorted(df.select("doc_id", "source", "text").collect())
