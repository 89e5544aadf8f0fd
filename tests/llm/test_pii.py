import hashlib
import re

from quadrille.llm import pii
from quadrille.llm.queries import op1_pii
from tests.llm import cases

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(d := re.sub("[^0-9]", "", t)) <= 19 and sum((x := int(c) * (1 + k % 2)) // 10 + x % 10 for k, c in enumerate(d[::-1])) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15),
]


def brute(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m[0]))
    counts = tuple(sum(x[1] == k for x in found) for k in range(4))
    return (*counts, hashlib.sha256(",".join(f"{RULES[k][0]}:{s}:{e}" for s, k, e in found).encode()).hexdigest())


def got(rows):
    return sorted((repr(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows)


def test_query_equals_brute_force(spark, sf_dir):
    assert got(op1_pii(spark, sf_dir).collect()) == sorted((repr(i), *brute(t)) for i, t in cases.documents(spark, sf_dir))


def test_awkward_rows(spark):
    assert got(pii.pii_report(cases.frame(spark)).collect()) == sorted((repr(r[0]), *brute(r[1])) for r in cases.rows())


def test_empty_table(spark):
    assert pii.pii_report(cases.frame(spark).limit(0)).count() == 0


def test_added_kinds():
    t = "See https://a.example/x. IBAN DE89370400440532013000, account no 12345678 at 12 High Park Street."
    assert [t[s:e] for s, k, e in pii.spans_of(t) if k > 3] == ["https://a.example/x", "DE89370400440532013000", "12345678", "12 High Park Street"]


def test_accounts_end_where_the_iban_does():
    for number in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947"):
        for after in (" Please pay", " BIC COBADEFFXXX", " 12 items", " A", "", ", then", "\nNEXT", "X"):
            text = f"IBAN: {number}{after}"
            assert [text[s:e] for s, k, e in pii.spans_of(text) if k == 5] == [number]
    assert pii.redacted("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX") == "IBAN [ACCOUNT] BIC COBADEFFXXX"
    assert pii.redacted("IBAN DE88370400440532013000 Please pay") == "IBAN DE88370400440532013000 Please pay"


def test_redaction_keeps_clean_texts_and_columns(spark):
    docs = cases.frame(spark)
    out = pii.redact(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    assert pii.redacted("mail x@y.co now") == "mail [EMAIL] now" and pii.redacted("clean") == "clean"
