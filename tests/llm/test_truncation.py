import random

from protospan.llm import truncation as X

SCHEMA = "doc_id long, text string, source string, src string, n int"
SUBJECTS, VERBS, ENDS = ["The plate", "The camera", "A droplet", "The nozzle", "This channel"], ["showed", "reached", "kept", "missed"], ["steady signal in the blanks", "the upper limit of detection", "its usual brightness during the night", "several neighbouring wells"]


def sentence(r):
    return f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(ENDS)}."


def corpus(n=400, seed=5):
    r = random.Random(seed)
    rows = [(i, " ".join(sentence(r) for _ in range(r.randint(3, 12))), "notes") for i in range(n)]
    rows += [(n + i, "Start run\n" + "\n".join(f"step {k} done" for k in range(r.randint(2, 9))) + "\nRun finished", "logs") for i in range(60)]
    rows += [(n + 100 + i, "empty well", "notes") for i in range(12)]
    return rows


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    return {r.doc_id: r.reason for r in X.truncated(df, "doc_id", "text", "source").collect()}


def test_cuts_are_found_and_complete_texts_are_not(spark):
    whole = corpus()
    base = "The camera showed steady signal in the blanks. The nozzle reached the upper limit of detection. "
    extra = [
        (1000, base + "A droplet kept its usual brigh", "notes"), (1001, base + "A droplet kept its usual", "notes"), (1002, base + "The plate showed steady sig...", "Notes "), (1003, base + "The plate showed several\n[saved]", "notes"),
        (1004, base + "The plate showed stea   ", "notes"), (1005, base + "The plate showed stea\x00\x00", "NOTES"), (1006, "Start run\nstep 1 done\nstep 2", "logs"), (1007, base + "A droplet kept its usual brigh", "notes"),
        (1010, base.strip() + "\n[saved]", "notes"), (1011, base + "The plate showed several neighbouring wells", "notes"), (1012, "", "notes"), (1013, None, "notes"), (1014, " \n\x00", "notes"), (1015, "empty well", None), (1016, base.strip() + " 👍", "notes"), (1017, base, None),
        (1018, base + "The plate showed stea", None),
    ]
    got = found(spark, whole + extra)
    assert {1000, 1001, 1002, 1003, 1004, 1005, 1006, 1007, 1018} <= set(got), got
    assert set(got) == {1000, 1001, 1002, 1003, 1004, 1005, 1006, 1007, 1018}


def test_copies_of_a_cut_phrase_are_cases_and_of_a_whole_one_are_not(spark):
    rows = corpus() + [(2000 + i, "The camera showed steady sig", "notes") for i in range(4)]
    rows += [(2100 + i, "A droplet kept its usual brigh", "notes") for i in range(5)] + [(2200 + i, "This channel reached the upper limit", "notes") for i in range(40)]
    rows += [(2300 + i, "same as the neighbour", "notes") for i in range(9)] + [(2400 + i, "all of the upper", "notes") for i in range(9)]
    assert set(found(spark, rows)) == {*range(2000, 2004), *range(2100, 2105), *range(2200, 2240)}


def test_length_limit(spark):
    r = random.Random(9)
    rows = []
    for i in range(300):
        t = " ".join(sentence(r) for _ in range(r.randint(2, 14)))
        rows.append((i, t[:300], "memo"))
    cut = {i for i, t, _ in rows if len(t) == 300 and not t.endswith(".")}
    got = set(found(spark, rows))
    assert cut - got == set() or len(cut - got) <= 0.03 * len(cut)
    assert got - cut == set()


def test_a_common_form_that_whole_texts_may_lack_is_no_closing(spark):
    r = random.Random(21)
    rows = [(i, "# Help\n\n" + sentence(r) + ("\n```\n" if r.random() < 0.8 else " ") + sentence(r), "pages") for i in range(400)]
    rows += [(900 + i, f"# Help\n\n{sentence(r)}\nThe camera showed stea", "pages") for i in range(3)]
    assert set(found(spark, rows)) == {900, 901, 902}


def test_long_footers_are_no_text(spark):
    refs = " Refs: " + ", ".join(f"[{i}]" for i in range(300)) + " (see page 3) [saved] :)"
    rows = corpus() + [(3000, sentence(random.Random(4)) + refs, "notes"), (3001, "The camera showed steady signal in the blanks. The nozzle reached the upp" + refs, "notes")]
    assert set(found(spark, rows)) == {3001}


def test_empty_table_and_very_long_text(spark):
    assert found(spark, []) == {}
    long = "The camera showed steady signal in the blanks. " * 20000
    got = found(spark, corpus(60) + [(5000, long + "The nozz", "notes"), (5001, long, "notes"), (5002, " " * 300000, "notes"), (5003, "a" * 200000, "notes")])
    assert 5000 in got and 5001 not in got and 5002 not in got


def test_report(spark):
    df = spark.createDataFrame([(*r, "c", 1) for r in corpus() + [(9001, "The camera showed steady sig", "notes"), (9002, "The camera showed steady sig", "notes")]], SCHEMA)
    rep = {r.src: r for r in X.report(df, "text", "source").collect()}
    assert rep["notes"].cut == 2 and rep["logs"].cut == 0 and rep["notes"].texts == 414
