"""Fill-in-middle, importance resampling and personal data, against plain versions and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from waybill.llm import fim, pii, resampling
from waybill.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def some_texts(seed, n, alphabet, sizes):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.choice(sizes))) for _ in range(n)]


def docs(spark, texts, parts=5):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


# ---------------------------------------------------------------- fill-in-middle


def plain_fim(doc_id, text):
    units = UNIT.findall(text)
    n, h = len(units), digest(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_plain_version(spark):
    texts = ["", None, " ", "\n\t ", "<P> a", "a <S>", "é 😀 x ", "one", " lead", "< P>", "a b", "<", "<S", *some_texts(1, 120, "ab é😀 \n\t<P>", [1, 7, 60]), "w é " * 3000, "x" * 50_000, " " * 5000]
    own = docs(spark, texts).unionByName(spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d")], "doc_id long, text string"))
    own = own.withColumns({"n": F.lit("own"), "output": F.lit(1), "extra": F.lit("kept")})
    made = fim.fill_in_middle(own)
    assert made.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = fim.restore(made).collect()
    assert len(rows) == len(texts) + 3 and {r.extra for r in rows} == {"kept"}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text or "")
        assert r.restored == (r.text or "")
    assert {r.form for r in rows} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(own.limit(0)).count() == 0


def test_rope_splits_anywhere():
    text = "".join(some_texts(2, 1, "a é\n", [9000]))
    units = UNIT.findall(text)
    whole = fim.rope(text)
    assert (whole.units, whole.points, str(whole)) == (len(units), len(text), text)
    for rank in [0, 1, 2, 255, 256, 257, 1000, len(units) - 1, len(units)]:
        a, b = fim.split(whole, rank)
        assert (str(a), str(b), a.units, b.units) == ("".join(units[:rank]), "".join(units[rank:]), rank, len(units) - rank)
    for at in [0, 1, 700, len(text)]:
        a, b = fim.split(whole, at, True)
        assert (str(a), str(b)) == (text[:at], text[at:])
    assert fim.EMPTY == fim.rope("")
    with pytest.raises(ValueError):
        fim.put_back("<P>a<S>b", "psm")


# ---------------------------------------------------------------- resampling


def plain_features(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(rows, target, least, percent):
    s, t = Counter(), Counter()
    for texts, out in (([x for _, x in rows], s), (target, t)):
        for x in texts:
            out.update(zlib.crc32(f.encode()) % 10_000 for f in plain_features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000))))
    out = []
    for i, text in rows:
        n, fs = plain_features(text)
        weight = sum(gain(zlib.crc32(f.encode()) % 10_000) for f in fs)
        h = int(digest(f"42:{'' if i is None else i}")[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    best = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(best[: len(best) * percent // 100])}
    return sorted((*r, rank.get(r[0])) for r in out)


def test_resampling_plain_version(spark):
    texts = ["", None, "!!", "A b C", "long" * 40 + " word", "é" * 90 + " x", *some_texts(3, 150, "ab É1 .", [3, 30, 200]), "a b " * 4000]
    target = ["a b a b 1", None, "", "é a"]
    own = docs(spark, texts).withColumns({"weight": F.lit("own"), "rank": F.lit(1)})
    gain = resampling.gains(own, spark.createDataFrame([(x,) for x in target], "text string"))
    scored = table(resampling.with_score(resampling.with_weight(own, gain)))
    got = resampling.drawn(scored, F.col("n_words") >= 3, 20)
    got = sorted((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect())
    want = plain_resample(list(enumerate(texts)), target, 3, 20)
    assert got == want
    assert sum(r[-1] is not None for r in got) > 10


@pytest.mark.parametrize("ranges", [1, 3, 4096])
def test_ranks_with_ties(spark, monkeypatch, ranges):
    monkeypatch.setattr(resampling, "RANGES", ranges)
    r = random.Random(4)
    rows = [(i, r.choice([-7, 0, 0, 0, 5, 10**9]), i % 3 > 0) for i in range(500)] + [(None, 0, True)]
    own = spark.createDataFrame(rows, "doc_id long, score long, fits boolean").repartition(4)
    got = {x.doc_id: x["rank"] for x in resampling.drawn(own, F.col("fits"), 50).collect()}
    order = sorted((x for x in rows if x[2]), key=lambda x: (-x[1], -1 if x[0] is None else x[0]))
    assert {k: v for k, v in got.items() if v} == {x[0]: k + 1 for k, x in enumerate(order[: len(order) // 2])}
    assert len(got) == 501


def test_resampling_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    gain = resampling.gains(none, none)
    assert set(gain.tolist()) == {0}
    assert resampling.drawn(table(resampling.with_score(resampling.with_weight(none, gain))), F.lit(True)).count() == 0
    same = spark.createDataFrame([(1, "a b")] * 6, "doc_id long, text string")
    ranks = [r["rank"] for r in resampling.drawn(table(resampling.with_score(resampling.with_weight(same, gain))), F.lit(True), 50).collect()]
    assert sorted(ranks, key=str) == [1, 2, 3, None, None, None]


# ---------------------------------------------------------------- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def plain_base(text):
    def counts(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        return kind == "email" or 9 <= len(digits) <= 15 if kind != "card" else 12 <= len(digits) <= 19 and luhn(digits)

    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if counts(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_spans_plain_version(spark):
    texts = ["", None, "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1 (743) 555-3824 4465758382889437", "0.0.0.256", "00000.0.0.0255", "é😀 x@y.zz", *some_texts(5, 1500, "aZ09._%+-@ ()x\n12345é😀", [5, 40, 200])]
    texts += ["1" * 20_000, "1 " * 20_000, "a" * 100_000, "1." * 20_000, "x 4465758382889437 " * 3000]
    found = table(pii.candidates(docs(spark, texts).withColumn("candidates", F.lit(1))))
    spans = pii.personal_data(found, pii.Model({}, {}))
    got = {r.doc_id: r.base for r in spans.select("doc_id", pii.written(F.filter("spans", lambda s: s["base"])).alias("base")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain_base(text), text[:80] if text else text


#: A text and whether the method adds a span to its base spans.
CASES = [
    ("write to john.doe [at] example [dot] com now", "email"), ("call 743-555-3824 today", "phone"), ("tel: 7435553824", "phone"), ("number (743) 555-3824 x", "phone"),
    ("+1 (743) 555-3824 4465758382889437 both", "card,phone"), ("card 4465.7583.8288.9437 exp", "card"), ("addr 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up", "ip"), ("ip 10[.]0[.]0[.]1 seen", "ip"),
    ("order 7435553824 shipped", ""), ("id 1234567890123456 x", ""), ("12.345.678 people", ""), ("time 12:34:56 ok", ""), ("meet me at home. Then go", ""), ("In 1999-2004 and 2010-2015", ""), ("card 4465 7583 8288 9437 exp", ""),
    ("mail jane@example.org", ""),
]


def test_added_spans(spark):
    folder = "/root/testdata/sf0.01"
    model = pii.train(table(pii.candidates(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")).drop("text")))
    for r in model.voters.values():
        assert all(r.on[v] > r.off[v] for v in pii.VOTERS)
    got = pii.personal_data(pii.candidates(docs(spark, [t for t, _ in CASES])), model).collect()
    for r in got:
        ends = [0]
        for s in r.spans:
            assert s.base or s.start >= max(ends)
            ends.append(s.end)
        assert ",".join(sorted(s.kind for s in r.spans if not s.base)) == CASES[r.doc_id][1], r.text


def test_personal_data_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    found = table(pii.candidates(none))
    assert pii.personal_data(found, pii.train(found)).count() == 0
    rows = pii.personal_data(pii.candidates(spark.createDataFrame([(None, "a@b.cc", 7), (None, "a@b.cc", 7), (1, None, 8)], "doc_id long, text string, spans int")), pii.Model({}, {})).collect()
    assert sorted(len(r.spans) for r in rows) == [0, 1, 1]


def test_label_model_recovers_rates(spark):
    """Simulated voters of known rates: the estimates come near them without any truth."""
    r = random.Random(6)
    rates = {"strict": (0.9, 0.2), "form": (0.8, 0.3), "rule": (0.95, 0.1), "listed": (0.7, 0.4), "context": (0.8, 0.2), "edges": (0.9, 0.5), "beside": (0.85, 0.5)}
    counts = Counter()
    for _ in range(8000):
        true = r.random() < 0.6
        counts[tuple(0 if r.random() < 0.2 else 1 if r.random() < rates[v][not true] else -1 for v in pii.VOTERS)] += 1
    patterns = spark.createDataFrame([(2, *k, n) for k, n in counts.items()], ", ".join(["kind int", *[f"{v} int" for v in pii.VOTERS], "n long"]))
    found = pii.reliabilities(patterns, 40)[2]
    assert abs(found.share - 0.6) < 0.05
    for v, (on, off) in rates.items():
        assert abs(found.on[v] - on) < 0.06 and abs(found.off[v] - off) < 0.06
