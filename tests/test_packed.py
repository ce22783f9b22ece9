import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from protospan.operators import packed

FIELDS = ["Protein.Group", "Genes"]
SCHEMA = "report_row long, `Run.Index` long, `Protein.Group` string, Genes string, position string, item string"


def brute(text):
    """Places by hand: every separator character outside quotes, or blanks alone between values."""
    if text is None or text.strip().lower() in ("", "-", "na", "n/a", "null", "unknown"):
        return []
    toks = re.findall(r'"[^"]*"|\'[^\']*\'|[A-Za-z0-9\-]+|\S', text)
    pos, out, was = 1, [], False
    for t in toks:
        value = bool(re.fullmatch(r'"[^"]*"|\'[^\']*\'|[A-Za-z0-9\-]+', t))
        if not value or was:
            pos += 1
        if value:
            v = t.strip("\"'").strip() if t[0] in "\"'" else t
            if v:
                out.append((pos, v))
        was = value
    return out if len(out) >= 2 else []


def run(spark, texts):
    rows = [(i, i % 3, t, None, "p", "q") for i, t in enumerate(texts)]
    got: dict = {}
    for r in packed.unpack(spark.createDataFrame(rows, SCHEMA), "report_row", "Run.Index", FIELDS).collect():
        got.setdefault(r.report_row, []).append((r.position, r.item))
    return {i: sorted(got.get(i, [])) for i in range(len(texts))}


CASES = ["A;B", "A,B;C", "A;;B", ";A;B", "A;B;", "'A'\t;'B'", '"a; late";B', "A / B", "A；B", "  A ; B ", "A|, B", "A B", "n/a", "-", None, "", "A", '"x, y"', "A;;", "  ", "A-1;B-2", '"orf1|b"|C', "A;\t;B"]


def test_cases(spark):
    got = run(spark, CASES)
    assert got == {i: brute(t) for i, t in enumerate(CASES)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="AB1-;,|/ \t", max_size=14), min_size=1, max_size=40))
def test_like_brute_force(spark, texts):
    got = run(spark, texts)
    for i, t in enumerate(texts):
        if t.strip() not in ("", "-", "--", "---"):
            assert got[i] == brute(t), t


def test_very_long_and_empty(spark):
    long = ";".join(f"P{i}" for i in range(30000))
    quoted = '"' + "x" * 200000 + '";B'
    got = run(spark, [long, quoted, '"' * 5000])
    assert len(got[0]) == 30000 and got[0][-1] == (30000, "P29999") and got[1][1] == (2, "B")
    assert packed.unpack(spark.createDataFrame([], SCHEMA), "report_row", "Run.Index", FIELDS).count() == 0


def test_delimiter_is_inferred_per_source(spark):
    rows = [(i, 1, "A|B|C", None, "", "") for i in range(9)] + [(20, 1, "A;B", None, "", "")] + [(30 + i, 2, "A; B", None, "", "") for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("`Run.Index` as s", "`Protein.Group` as t")
    assert {r.s: r.delimiter for r in packed.infer_delimiters(df, ["s"], "t").collect()} == {1: "|", 2: ";"}
