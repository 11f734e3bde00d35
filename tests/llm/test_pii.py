import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from staffmart.llm import pii as P
from tests.llm.helpers import awkward, documents, nothing

# fixed values: the patterns base spans are defined by
STRICT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(t - 9 if t > 9 else t for t in twice)) % 10 == 0


def expected(text):
    out = []
    for kind, pattern in STRICT.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                  "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def same_base(rows, texts):
    for r in rows:
        spans = expected(texts[r.doc_id - 1])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (texts[r.doc_id - 1], spans, r)
        assert [sum(s.startswith(k + ":") for s in spans) for k in P.KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert set(spans) <= set(r.spans.split(","))


TEXTS = [None, "", "a@b.c_d@e.f x@y.z@q.w é😀 me@host.org", "999.1.2.3.4 and 1.2.3.4 or 0001.02.3.255 10.0.0.1.5 1.2.3",
         "12 4111111111111111 and 4111-1111-1111-1111x +1 (961) 555-6946 +123 +49 30 1234567.", "a" * 300 + "@ .@x.y -@-.-",
         "+1+15551234567 5+4915112345678", "0" * 40 + " 000.000.000.000", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6\n7@8.9", "é+49 30 1234567é"]


def test_base_spans_of_chosen_texts(spark):
    same_base(P.report(documents(spark, TEXTS)).collect(), TEXTS)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="a.@1234567890+-() \n4é", max_size=60), min_size=30, max_size=60))
def test_base_spans_of_any_text(spark, texts):
    same_base(P.report(documents(spark, texts)).collect(), texts)


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 300_000, "a@" + "b." * 100_000 + "c", "a." * 100_000 + "@", "1 " * 50_000, "9" * 200_000,
             "." * 100_000 + "@" * 1000]
    rows = sorted(P.report(documents(spark, texts)).collect())
    assert [r.spans for r in rows] == ["", "email:0:200003", "", "", "", ""]


def test_trees_add_spans_like_the_base_ones(spark):
    card = "4111 1111 1111 1111"
    texts = [f"pay by card {card} now {k}x" for k in range(40)] + [
        f"pay by card 4111 1111 1111 111{k % 10} now {k}y" for k in range(20) if k % 10 != 1]
    texts.append("pay by card 4 " + card + " now")  # too many digits for the strict pattern
    rows = sorted(P.report(documents(spark, texts)).collect())
    assert rows[-1].n_card == 0 and rows[-1].spans == "card:14:33" and rows[-1].n_added == 1
    assert all(r.n_added == 0 for r in rows[:-1])


def test_boosting_separates_counted_rows():
    x = np.array([[a, b] for a in range(4) for b in range(4)])
    n = np.full(16, 50.0)
    positive = np.where((x[:, 0] > 1) & (x[:, 1] <= 2), 45.0, 2.0)
    base, trees = P.boost(x, positive, n)
    score = np.array([base + sum(P.value_of(t, row) for t in trees) for row in x])
    assert score[positive > 10].min() > 0 > score[positive < 10].max()


def test_redaction_masks_exactly_the_spans(spark):
    docs = documents(spark, TEXTS)
    spans = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in P.report(docs).collect()}
    out = P.redact(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        text, at, made = TEXTS[r.doc_id - 1], 0, ""
        if text is None:
            assert r.text is None
            continue
        for start, end, kind in sorted((int(a), int(b), P.KINDS.index(k)) for k, a, b in spans[r.doc_id]):
            if start >= at:
                made += text[at:start] + f"[{P.KINDS[kind].upper()}]"
            at = max(at, end)
        assert r.text == made + text[at:] and r.n_chars == len(r.text)


def test_no_python_in_the_plan(spark):
    plan = P.report(documents(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert P.report(docs).count() == docs.count() == P.redact(docs).count()
    assert P.redact(docs).columns == docs.columns
    assert P.report(nothing(spark)).count() == 0


@pytest.mark.parametrize("text, good", [("255.255.255.255", True), ("256.1.1.1", False), ("0255.1.1.1", True), ("1.1.1.1000", False)])
def test_address_parts(spark, text, good):
    assert P.report(documents(spark, [text])).first().n_ip == good


@pytest.mark.parametrize("base", [0, 40, 400])
def test_written_out_addresses_do_not_depend_on_their_number(spark, base):
    texts = [f"so it is m{k}@host.org here" for k in range(base)]
    texts += [f"so it is bob{k} (at) host (dot) org. Then on" for k in range(40)] + ["see amy [at] mail.example.com. Then", "we met (at) noon. Then left"]
    rows = sorted(P.report(documents(spark, texts)).collect())[base:]
    assert all(r.n_added == 1 for r in rows[:-1]) and rows[-1].n_added == 0
    assert rows[-2].spans == "email:4:29"


def test_card_numbers_that_fail_their_check_are_never_added(spark):
    texts = [f"pay by card 4111 1111 1111 1111 now {k}x" for k in range(400)] + ["pay by card 4111 1111 1111 1112 now"] * 3
    assert all(r.n_added == 0 for r in P.report(documents(spark, texts)).collect())


def test_scores_are_judged_one_by_one():
    cell = dict.fromkeys(P.FEATURES, 0) | {"kind": 3}
    counts = [cell | {"digits": d, "fit": fit, "positive": good, "n": 100} for d, good in ((9, 100), (12, 60)) for fit in (True, False)]
    counts += [cell | {"digits": 10, "fit": fit, "positive": 2000, "n": 2000} for fit in (True, False)]
    trees = P.Trees(counts)
    score = {d: trees.base + sum(P.value_of(t, [3, d] + [0] * 5) for t in trees.trees) for d in (9, 10, 12)}
    taken = {d: any(a <= s <= b for a, b in trees.ranges[3]) for d, s in score.items()}
    assert taken == {9: True, 10: True, 12: False}
