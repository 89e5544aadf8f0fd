import re

from quadrille.llm import licenses
from quadrille.llm.queries import op4_licenses
from tests.llm import cases
from tests.llm.test_decontaminate import words

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute(text):
    w = words(text)
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def check(rows, texts):
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows))) == sorted(map(repr, ((i, *brute(t)) for i, t in texts)))
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def test_query_equals_brute_force(spark, sf_dir):
    rows = op4_licenses(spark, sf_dir).collect()
    assert any(r.n_base for r in rows)
    check(rows, cases.documents(spark, sf_dir))


def test_awkward_rows(spark):
    check(licenses.report(cases.frame(spark)).collect(), [r[:2] for r in cases.rows()])
    assert licenses.report(cases.frame(spark).limit(0)).count() == 0


def test_changed_templates_are_found_by_neighbouring_diagonals(spark):
    text = next(t for t in licenses.TEXTS if t.startswith("redistribution"))
    w = text.split()
    docs = [(1, "Intro. " + text), (2, " ".join([*w[:6], "so", *w[6:12], *w[13:]])), (3, " ".join(w[:4])), (4, " ".join(w[::-1])), (5, text.upper().replace(" ", ", "))]
    rows = {r.doc_id: r for r in licenses.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[i].labels for i in range(1, 6)] == ["bsd", "bsd", "", "", "bsd"]
    assert rows[1].score == 1 and 0.7 <= rows[2].score < 1 and rows[3].score == 0


def test_a_long_run_of_diagonals_keeps_its_label(spark):
    w = next(t for t in licenses.TEXTS if t.startswith("permission is")).split()
    changed = " ".join([*w[:6], "so", *w[6:12], *w[13:]])
    docs = [(1, changed), (2, changed + " documentation files" * 40), (3, "documentation files " * 40 + changed), (4, "documentation files " * 40)]
    rows = {r.doc_id: r for r in licenses.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[k].labels for k in range(1, 5)] == ["mit", "mit", "mit", ""]
    assert all(rows[k].score >= 0.7 for k in (1, 2, 3)) and rows[4].score == 0


def test_plan_has_no_python(spark):
    plan = licenses.report(cases.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
