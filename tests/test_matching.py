"""Matching blocks are difflib's, in far less time, and their work is spread over tasks."""

import difflib
import random
import time

import pytest

from glyphloom.operators import alignment, matching


def plainly(a, b):
    return [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


def changed(rnd, text, letters, rate):
    return "".join(rnd.choice(letters) if rnd.random() < rate else "" if rnd.random() < rate else c for c in text)


@pytest.mark.parametrize("pairs, cells, few", [(1 << 18, 400, 12), (200, 1, 0), (20, 1, 1000)])
def test_blocks(monkeypatch, pairs, cells, few):
    monkeypatch.setattr(matching, "PAIRS", pairs), monkeypatch.setattr(matching, "CELLS", cells), monkeypatch.setattr(matching, "FEW", few)
    rnd = random.Random(7)
    for n in range(300):
        letters = "abcdefghijklmnopq \U0001f600"[: (1, 2, 3, 6, 19)[n % 5]]
        a = "".join(rnd.choice(letters) for _ in range(rnd.choice((0, 1, 20, 120, 300))))
        a = a[:9] * 20 if n % 7 == 0 else a
        b = changed(rnd, a, letters, rnd.choice((0, 0.02, 0.2))) if n % 3 else "".join(rnd.choice(letters) for _ in range(80))
        assert matching.blocks(a, b) == plainly(a, b)
        assert matching.lists(a.split("a"), b.split("a")) == plainly(a.split("a"), b.split("a"))


def test_pieces_take_little_time():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    truth = [" ".join(rnd.choice(words) + (". " if rnd.random() < 0.1 else "") for _ in range(600))[:4000] for _ in range(60)]
    began = time.time()
    made = [alignment.matches(t.replace(". ", " "), t) for t in [*truth, ("La " * 1333).replace("La La La ", "La Lé La ")]]
    assert time.time() - began < 10  # difflib: 0.3 s and more a piece for its characters alone
    assert made[0] == (sum(n for *_, n in plainly(truth[0], truth[0].replace(". ", " "))), 0, sum(n for *_, n in plainly(truth[0].split(), truth[0].replace(". ", " ").split())))


def test_summary_spreads_pieces(spark):
    """Differing pieces are few bytes and much work, so the number of tasks isn't left to bytes."""
    docs = spark.createDataFrame([(d, "en", f"Câu {d}. " * 20) for d in range(400)], "document long, lang string, text string")
    both = docs.selectExpr("document", "replace(text, '. ', ' ') as got", "text as truth")
    scored = alignment.scores(both)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("MapInPandas") == 2  # split once, scored once
    row = alignment.summary(docs.select("document", "lang"), scored, "lang").first()
    assert (row["n_documents"], row["n_failures"], row["diacritic_accuracy"]) == (400, 0, 1.0)
