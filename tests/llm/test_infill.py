"""Fill-in-middle: the skip list against counting, outputs against a plain rewriting, awkward rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from test_operators import SCHEMA, awkward, rows

from deskstream.llm import infill as m

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, mid, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(units), form, len(p), len(mid), f"<S>{s}<P>{p}<M>{mid}" if form == "spm" else f"<P>{p}<S>{s}<M>{mid}"


def test_lanes_reach_every_rank():
    rng = random.Random(2)
    texts = ["", "a", "é", "abc def  gh\U0001f600", "", *("".join(rng.choice("ab é.\U0001f600\n") for _ in range(rng.randrange(2000))) for _ in range(30)), "x" * 500, ". " * 3000]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    lanes = m.Lanes(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert len(lanes.widths) > 2
    units = [UNIT.findall(t) for t in texts]
    assert lanes.units.tolist() == [len(u) for u in units]
    for share in (0.0, 0.1, 0.5, 0.97, 1.0):
        ranks = np.array([round(share * len(u)) for u in units])
        points, size = lanes.descend(ranks)
        before = ["".join(u[:r]) for u, r in zip(units, ranks)]
        assert points.tolist() == [len(x) for x in before] and size.tolist() == [len(x.encode()) for x in before]
    small = [t for t in range(len(texts)) if len(units[t]) < 40]
    for k in range(40):
        points, _ = lanes.descend(np.array([min(k, len(u)) for u in units]))
        assert [points[t] for t in small] == [len("".join(units[t][:k])) for t in small]


def test_equals_a_plain_rewriting(spark):
    more = [(100 + k, "Tail of <" if k % 3 else "S> <P" + " x" * k, "en", "s", None, "k", 1, 2, 3, 4, "d") for k in range(200)]
    more += [(400, "has <M> in it", *more[0][2:]), (401, "<P>", *more[0][2:])]
    given = awkward() + more
    frame = spark.createDataFrame(given, SCHEMA).repartition(3)
    want = sorted(((r[0] is None, r[0] or 0), *plain(r[0], r[1])) for r in [(x[0], x[1]) for x in given])
    got = m.fill_in_middle(frame).withColumn("again", m.restored(m.F.col("output"), m.F.col("form")))
    got = rows(got)
    key = lambda x: (x[0], x[1], x[2], x[3] or -1, x[4] or -1, x[5])
    assert sorted((((r["doc_id"] is None, r["doc_id"] or 0), *(r[x] for x in ("n", "form", "prefix_chars", "middle_chars", "output"))) for r in got), key=key) == sorted(want, key=key)
    texts = {}
    for r in given:
        texts.setdefault(r[0], set()).add(r[1] or "")
    assert all(r["again"] in texts[r["doc_id"]] for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_digests(spark):
    frame = spark.createDataFrame(awkward(), SCHEMA)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((r[0] or -1, sha(plain(r[0], r[1])[4]), sha(r[1] or "")) for r in awkward())
    assert sorted((r["doc_id"] or -1, r["output_sha256"], r["restored_sha256"]) for r in m.digests(frame).collect()) == want
    assert m.digests(spark.createDataFrame([], SCHEMA)).count() == 0
