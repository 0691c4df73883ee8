"""Titles that questions name (TB9): the suffix automaton and the proposed pairs against comparing all."""

import random
import re

from cairnlake.operators import tables as tb


def longest(a, b):
    return max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)


def test_automaton_tells_the_longest_common_part():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 25))) for _ in range(2))
        assert tb.SuffixAutomaton(a).longest(b) == longest(b, a)
    for text in ("", "a", "abcbc", "aaaa"):
        parts = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
        assert all(tb.SuffixAutomaton(text).longest(p) == len(p) for p in parts)


def test_proposed_pairs_are_all_that_match(spark):
    rng = random.Random(4)
    words = ["annual", "report", "budget", "plan", "staff", "leave", "2024", "管理制度", "费用"]
    titles = [(i, " ".join(rng.sample(words, rng.randint(1, 5))) + rng.choice(["", ".pdf", ".DOCX"])) for i in range(200)] + [(900, None), (901, "abc"), (902, "x" * 161), (903, "abcd")]
    titles += [(1000 + i, "".join(rng.choice("ab") for _ in range(rng.randint(3, 40)))) for i in range(150)]
    questions = [(i, f"Show the {' '.join(rng.sample(words, 4)).upper()} please abcd") for i in range(20)] + [(50, None), (51, "")] + [(100 + i, "".join(rng.choice("ab") for _ in range(60))) for i in range(10)]
    got = {(r.query_id, r.title_id): r.common for r in tb.matched_titles(spark.createDataFrame(titles, "title_id long, name string"), spark.createDataFrame(questions, "query_id long, text string")).collect()}
    want = {}
    for t, name in titles:
        stem = re.sub(r"\.[a-z0-9]+$", "", name or "", flags=re.I).lower()
        for q, text in questions:
            n = longest(stem, (text or "").lower()) if 4 <= len(stem) <= 160 else 0
            if n >= 4 and n >= 0.6 * len(stem):
                want[q, t] = n
    assert got == want and len(want) > 100


def test_equal_names_and_texts_are_compared_once(spark):
    """As many pairs reach the automaton as there are different names and texts; each bearer has its row."""
    titles = spark.range(300).selectExpr("id AS title_id", "'annual report.pdf' AS name")
    questions = spark.range(40).selectExpr("id AS query_id", "'The ANNUAL report' AS text")
    found = tb.matched_titles(titles, questions)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "title_id" not in plan.split("MapInArrow", 1)[1].split("\n", 1)[0]
    assert {(r.query_id, r.title_id, r.common) for r in found.collect()} == {(q, t, 13) for q in range(40) for t in range(300)}
