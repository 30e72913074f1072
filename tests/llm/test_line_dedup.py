"""Recurring lines whose documents are told apart without the operator's own sketches."""
import random

from driftmark.llm import decontaminate, line_templates

from . import brute
from .test_documents import frame


def prose(rng, lines):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) + " " + " ".join(str(rng.choice(["red", "green", "blue", "old"])) + rng.choice("stuvwxyz") for _ in range(8))
            for _ in range(lines)]


def left(spark, documents):
    rows = list(enumerate(["\n".join(d) for d in documents], 1))
    return {r.doc_id: r.text.split("\n") for r in line_templates.drop_recurring_lines(frame(spark, rows)).collect()}


def test_boilerplate_goes_whichever_line_hashes_lowest(spark):
    rng = random.Random(1)
    frames = [[f"{name} words of the frame number {name} of all pages" for name in [rng.choice("klmnop") * 4 + str.lower(chr(97 + k)) for k in range(3)]] for _ in range(12)]
    for boilerplate in frames[:4]:
        documents = [[*boilerplate[:2], *prose(rng, 4), boilerplate[2]] for _ in range(10)]
        got = left(spark, documents)
        assert [got[i] for i in range(1, 11)] == [d[2:6] for d in documents]


def test_copies_hide_no_boilerplate_and_are_none(spark):
    rng = random.Random(2)
    notice = "Subscribe to our letter for more stories like this"
    original = [*prose(rng, 12), notice]
    near = [[*original[:k % 12], *prose(rng, 1), *original[k % 12 + 1:]] for k in range(40)]
    independent = [[*prose(rng, 5), notice] for _ in range(6)]
    got = left(spark, [original] * 60 + near + independent)
    assert not any(notice in lines for lines in got.values())
    # the copies' own lines stay
    assert got[1] == original[:-1] and all(got[61 + k] == near[k][:-1] for k in range(40))
    assert all(got[101 + k] == independent[k][:-1] for k in range(6))


def test_lines_of_few_tokens_are_judged(spark):
    rng = random.Random(3)
    short = ["Home", "And ornd.", "All rights reserved.", "2024", "本サイトの内容を無断で転載することを禁じます"]
    documents = [[*short[:2], *prose(rng, 5), *short[2:], "", f"一意{chr(0x4E00 + k)}の文{chr(0x5E00 + k)}"] for k in range(6)]
    got = left(spark, documents)
    assert [got[k] for k in range(1, 7)] == [[*d[2:7], *d[10:]] for d in documents]


def test_fields_do_not_count_and_a_leaf_has_several_templates(spark):
    rng = random.Random(4)
    footer = ["Read more about our privacy terms", "Read more about their cookie policy"]
    documents = []
    for k in range(16):
        log = f"2024-05-{k + 10} 10:{k + 20} 10.0.0.{k} GET /index"
        documents.append([*prose(rng, 6), f"Page {k} of 12", log, footer[k % 5 < 2]])
    got = left(spark, documents)
    assert [got[k] for k in range(1, 17)] == [d[:6] for d in documents]


def test_lines_as_judged_one_by_one(spark):
    """Footers with fields and without, short and unspaced lines, copies and near copies, leaves of several templates."""
    rng = random.Random(5)
    footers = ["Read more about our privacy terms", "Read more about their cookie policy", "All rights reserved.", "無断で転載することを禁じます", "2024"]
    documents = []
    for k in range(40):
        lines = prose(rng, rng.randint(6, 12)) + [rng.choice(footers), f"Page {k} of {rng.randint(10, 99)}"][:rng.randint(0, 2)]
        if k % 4 == 0:
            lines.append(f"2024-05-{k + 10} 10:{k + 20} 10.0.0.{k} GET /index/{rng.choice('ab')} done in {k} ms")
        rng.shuffle(lines)
        documents.append(lines)
    documents += [list(documents[3]) for _ in range(15)] + [[*documents[5][:-1], *prose(rng, 1)] for _ in range(15)] + [["one"], ["one"], [""], ["Page 1"]]
    rows = list(enumerate(["\n".join(d) for d in documents], 1))
    rng.shuffle(rows)
    found = {r.id: sorted(r.lines) for r in line_templates.recurring_lines(frame(spark, rows)).collect()}
    want = {i: d for (i, _), d in zip(rows, brute.recurring_lines(rows)) if d}
    assert found == want and len(want) > 20


def test_lows_are_made_behind_the_join(spark, monkeypatch):
    """A sketch's lows are far larger than Spark sizes them: a side of a join that held them could be broadcast."""
    plans, write = [], line_templates.written

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(line_templates, "written", kept)
    rows = [(i, f"all rights reserved by us\n{'abcdefgh'[i]} writes this line") for i in range(8)]
    assert line_templates.recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 8
    made = [p for p in plans if " AS lows" in p]
    assert made and all(" Join " in p and p.index(" AS lows") < p.index(" Join ") for p in made)


def test_many_marks_are_shuffled(spark, monkeypatch):
    """Beyond the bound neither side is broadcast, though the exploded side is sized too low."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 3)
    prints = spark.range(20).selectExpr("explode(array(id, id + 1)) as print")
    few, many = (prints.join(decontaminate._bounded(spark.range(n).selectExpr("id as print")), "print") for n in (3, 4))
    assert few.count() == 5 and many.count() == 7
    few, many = (df._jdf.queryExecution().executedPlan().toString() for df in (few, many))
    assert "BroadcastHashJoin" in few and "SortMergeJoin" in many and "Broadcast" not in many
