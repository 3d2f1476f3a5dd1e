import hashlib
import re

from quarry.llm import pii
from tests.llm.fixtures import AWKWARD, documents, empty

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
TEXTS = [
    *AWKWARD, "a@b.c.d@e.f a@b.c_d@e.f @x.y a@b a@b.c..d a@b-c.d-e", "1.2.3.4.5 256.1.1.1 0001.2.3.255 1.2.3 1.2.3.4 x999.1.1.1 00.0.0.0000 1.2.3.4444", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111 1111 11111111 5",
    "call +49 (0)30 1234567 or +1 2, +33.1.23.45.67.89- +1234567890123456 ++4912345678", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2", "1 " * 9000, "a." * 9000 + "@b.c", "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001",
    "漢字 x@y.zz 漢 4111111111111111 é +491234567890 1.1.1.1", "ssn 123-45-6789 nothing 123-45-6780", "\x01a@b.c\x01 1.1.1.1\x02", "a@b.c" * 300, "9" * 5000,
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    spans = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits) if digits else False, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(spans)]


def test_base_spans_match_brute_force(spark):
    rows = {r.doc_id: r for r in pii.find(documents(spark, TEXTS)).collect()}
    for k, text in enumerate(TEXTS):
        spans = brute(text)
        r = rows[k]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (k, spans, r.spans[:200])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(kind + ":") for s in spans) for kind, _ in BASE]
        shown = r.spans.split(",") if r.spans else []
        assert [s for s in shown if s.split(":")[0] in dict(BASE)] == spans


def test_added_spans_and_scores(spark):
    rows = {r.doc_id: r for r in pii.find(documents(spark, ["IBAN DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 01", "ssn 123-45-6789", "123-45-6789"])).collect()}
    assert rows[0].spans == "iban:5:32" and rows[0].scores == "0.95"
    assert "iban" not in rows[1].spans
    assert rows[2].spans == "ssn:4:15" and rows[3].spans == ""


def test_plan_has_no_python(spark):
    plan = pii.find(documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow") or "InArrow" not in plan


def test_redaction(spark):
    docs = documents(spark, ["mail a@b.c now", None, "none", "1.1.1.1 and +49 123 456 789"])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {0: ("mail [EMAIL] now", 16), 1: (None, None), 2: ("none", 4), 3: ("[IP] and [PHONE]", 16)}
    assert pii.redact(empty(spark)).collect() == [] and pii.find(empty(spark)).collect() == []


def test_secrets_need_context_and_many_spans_are_found(spark):
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    rows = {r.doc_id: r for r in pii.find(documents(spark, [f'a token = "{key}" b', f"commit {key}", "a@b.c " * 20_000])).collect()}
    assert (rows[0].spans, rows[0].n_spans, rows[0].scores) == ("secret:11:51", 1, "0.70") and rows[1].spans == ""
    assert rows[2].n_email == rows[2].n_spans == 20_000 and rows[2].spans.endswith("email:119994:119999")
