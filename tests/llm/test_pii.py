import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm.pii import base_spans, find_pii, iban_ok, luhn_ok

from .conftest import ODD

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(t):
    out = []
    for i, k in enumerate(KINDS):
        for m in re.finditer(PATTERNS[k], t):
            d = [int(c) for c in m.group() if c in "0123456789"]
            ok = k == "email" or k == "ip" and all(int(p) <= 255 for p in m.group().split(".")) \
                or k == "phone" and 10 <= len(d) <= 15
            if k == "card" and 14 <= len(d) <= 19:
                ok = sum(v if j % 2 == 0 else sum(divmod(2 * v, 10)) for j, v in enumerate(reversed(d))) % 10 == 0
            if ok:
                out.append((m.start(), i, m.end()))
    return [(s, e, KINDS[i]) for s, i, e in sorted(out)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1.@+-%_ ()25é\n", max_size=60))
def test_base_spans_follow_the_patterns(t):
    assert base_spans(t) == plain(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "a@b.co", "a@@b.c.d", "@x.y",
                                 "+1 (555) 010-9999", "+12", "٣.1.1.1.1", " ", "x", "0001.2.3.4", "+", "-", "5500-0000-0000-0004"]),
                max_size=8).map("".join))
def test_base_spans_on_pieces(t):
    assert base_spans(t) == plain(t)


def test_checksums():
    assert luhn_ok("4111111111111111") and not luhn_ok("4111111111111112")
    assert iban_ok("GB82 WEST 1234 5698 7654 32") and not iban_ok("GB82 WEST 1234 5698 7654 33")


def test_added_spans_need_confirmation_or_context(make_docs):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32 ok"), (2, "code GB82 WEST 1234 5698 7654 33 no"),
            (3, "my ssn is 123-45-6789"), (4, "part 123-45-6789 fits"), (5, "call 555-010-9999 now"), (6, "mail me at a@b.co")]
    got = {r.doc_id: [(s.kind, s.score) for s in r.pii] for r in find_pii(make_docs(rows)).collect()}
    assert [k for k, _ in got[1]] == ["iban"] and got[2] == [] and [k for k, _ in got[3]] == ["ssn"] and got[4] == []
    assert [k for k, _ in got[5]] == ["local_phone"] and got[6] == [("email", 1.0)]


def test_context_words_are_whole_words(make_docs):
    rows = [(1, "hotel 555-010-9999"), (2, "shipped locally 555-010-9999"), (3, "shipping 1.2.3.4"), (4, "ip 1.2.3.4"),
            (5, "Tel.: 555-010-9999"), (6, "555-010-9999 (fax)"), (7, "phones 555-010-9999"),
            # "call" begins 40 characters before the number, but inside a longer word
            (8, "recall " + "." * 35 + " 555-010-9999"), (9, "555-010-9999 " + "." * 35 + " teller"),
            (10, "call " + "." * 34 + " 555-010-9999"), (11, "555-010-9999 " + "." * 35 + " tel")]
    got = {r.doc_id: [(s.kind, s.score) for s in r.pii] for r in find_pii(make_docs(rows)).collect()}
    assert got[3] == [("ip", 0.7)] and got[4] == [("ip", 1.0)]
    assert [i for i in got if i not in (3, 4) and got[i]] == [5, 6, 7, 10, 11]


def test_query_equals_brute_force(spark, make_docs, small_docs):
    from scriptorium.llm.queries import QUERIES
    got = {r.doc_id: r for r in QUERIES["op2_pii"](spark, "/root/testdata/sf0.001").collect()}
    for i, t, *_ in small_docs:
        spans = plain(t)
        text = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in spans) for k in KINDS]
        assert not text or set(text.split(",")) <= set(r.spans.split(","))


def test_odd_rows(make_docs):
    rows = ODD + [(20, "9" * 200_000), (21, "a" * 200_000 + "@"), (22, "+" + "(" * 100_000)]
    got = find_pii(make_docs(rows)).select("doc_id", "n", "spans", "n_email").collect()
    assert len(got) == len(rows) and all(r.n == "x" and r.n_email == 0 for r in got)
    assert find_pii(make_docs([])).count() == 0


def test_iban_before_upper_case_text(make_docs):
    iban = "DE89 3704 0044 0532 0130 00"
    texts = [f"{iban} BIC COBADEFFXXX", f"{iban} 1234 5678 X", f"pay {iban.replace(' ', '')} BIC COBADEFFXXX", f"AB12 CDEF {iban} OK",
             f"{iban} {iban}", "DE89 3704 0044 0532 0130 01 BIC COBADEFFXXX"]
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.pii if s.kind == "iban"]
           for r in find_pii(make_docs(list(enumerate(texts)))).collect()}
    assert got == {0: [iban], 1: [iban], 2: [iban.replace(" ", "")], 3: [iban], 4: [iban, iban], 5: []}
