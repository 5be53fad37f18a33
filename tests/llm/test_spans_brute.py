"""Base spans of personal data over a whole table, by the patterns run directly."""

import hashlib
import os
import re

import pytest

from labelspring.llm import pii_spans
from labelspring.llm.common import documents

SMALL = "/root/testdata/sf0.001"
ODD = [
    (9001, "a@b.c. x@y z@w.q@r.s 1.2.3.4.5 256.1.1.1 1.1.1.1"), (9002, "4111 1111 1111 1111 and 4111-1111-1111-1112"), (9003, None), (9004, ""),
    (9005, "+1 (555) 123-4567, +12, +1234567890123456, ++49 30 1234567"), (9006, "é a@b.c 漢 10.0.0.1"), (9006, "é a@b.c 漢 10.0.0.1"), (None, "m@n.o"),
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = {"email": [], "ip": [], "card": [], "phone": []}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out["phone"].append(m.span())
    return out


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables missing")
def test_base_spans_of_a_whole_table(spark):
    docs = documents(spark, SMALL).select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    want = []
    for r in docs.collect():
        spans = base_spans(r.text)
        listed = ",".join(f"{k}:{a}:{b}" for k, found in spans.items() for a, b in found)
        want.append((r.doc_id, *(len(f) for f in spans.values()), hashlib.sha256(listed.encode()).hexdigest()))
    rows = pii_spans.personal_data(docs).collect()
    # counts hold added spans as well, the digest the base ones alone
    got = []
    for r in rows:
        own = [s for s in r.spans.split(",") if s]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in own) for k in ("email", "ip", "card", "phone")]
        got.append((r.doc_id, r.base_sha256))
    assert sorted(got, key=repr) == sorted(((w[0], w[-1]) for w in want), key=repr)
    for r in rows:
        base = next(w for w in want if w[0] == r.doc_id and w[-1] == r.base_sha256)
        assert all(n >= b for n, b in zip((r.n_email, r.n_ip, r.n_card, r.n_phone), base[1:5]))
