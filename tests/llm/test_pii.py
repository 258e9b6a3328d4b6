import hashlib
import math
import random
import re

from trellis.llm import pii

TEXTS = [
    None,
    "",
    "mail a.b+c@x.com, then d@e.f.g@h.i and x@y no",
    "a@b.c+x@d.e a@b.c@d.e ..@-.- @a.b",
    "ip 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256 99999999999999999999999.1.1.1",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 4111111111111111 5500005555555559",
    "tel +1 (555) 010-2030 and +44.20.7946.0958 +123 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6",
    "grüße 🙂 x@y.zz +49 151 2345 6789 ñ 10.0.0.1",
    "7" * 5000 + " " + "a" * 5000 + "@" + "b" * 3000 + ".c",
    "4111 1111 1111 1111" * 40,
    "+1 555 010 2030 4111 1111 1111 1111",
]
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(TEXTS + TEXTS[2:4])], "doc_id long, text string, base string")
    rows = pii.sanitise(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert [tuple(x) for x in r.base] == brute(r.text), r.text[:80] if r.text else r.text
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans}


def test_written_and_redacted(spark):
    df = spark.createDataFrame([(1, "to x@y.zz!")], "doc_id long, text string")
    row = pii.sanitise(df).select("sanitised", pii.written("spans").alias("w")).first()
    assert row.w == "email:3:9" and row.sanitised == "to [EMAIL]!"
    assert hashlib.sha256(row.w.encode()).hexdigest()


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"{a} zanzibar {b} x@y.zz common words here") for i, (a, b) in enumerate([("one", "two"), ("three", "four"), ("five", "six")])]
    rows += [(10 + i, f"common words here number {i}") for i in range(20)]
    rows += [(100 + i, "copied uniqueword text p@q.rr common words here") for i in range(5)]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = lambda r: {r.text[x.start : x.end] for x in r.spans if x.kind == "term"}
    assert all(terms(out[i]) == {"zanzibar"} for i in range(3))
    assert not terms(out[10]) and "zanzibar" not in out[0].sanitised and "[EMAIL]" in out[0].sanitised
    assert all(not terms(out[100 + i]) for i in range(5))  # copies of one text are no evidence


def test_terms_of_entities_in_one_or_two_documents(spark):
    rows = [(i, f"{a} zanzibar {b} x@y.zz common words here") for i, (a, b) in enumerate([("one", "two"), ("three", "four")])]
    rows += [(5 + i, f"{a} quagga {b} user{i}@host{i}.rare.org common words here") for i, (a, b) in enumerate([("five", "six"), ("seven", "eight"), ("nine", "ten")])]
    rows += [(10 + i, f"common words here number {i}") for i in range(40)]
    rows += [(100 + i, "some copied oddword text then other oddword here m@n.oo common words") for i in range(5)]
    rows += [(200, "left changed nearword same text 4111 1111 1111 1111"), (201, "left edited nearword same text 4111 1111 1111 1111")]
    rows += [(300, "lonely hapaxword +49 151 2345 6789")]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = lambda r: {r.text[x.start : x.end] for x in r.spans if x.kind == "term"}
    assert [terms(out[i]) for i in range(2)] == [{"zanzibar"}] * 2
    assert [terms(out[i]) for i in range(5, 8)] == [{"quagga"}] * 3  # by the domain they share
    assert not any(terms(out[i]) for i in (*range(10, 50), *range(100, 105), 200, 201, 300))


def test_empty_table(spark):
    assert pii.sanitise(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_terms(rows, disclosure=0.9, support=3, reach=80):
    """Disclosing terms by document id; rows: (id, text) with different ids."""
    word, found, has = re.compile(r"[^\W\d_]+"), [], {}
    for i, text in rows:
        has[i] = {w for w in word.findall((text or "").lower()) if len(w) >= 3}
        spans = brute(text)
        for start, k, end, kind in spans:
            same = [x for x in spans if x[1] == k]
            low = max([x[2] for x in same if x[2] <= start], default=0)
            high = min([x[0] for x in same if x[0] >= end], default=len(text))
            before, after = text[low:start], text[end:high]
            before = re.sub(r"^[^\W\d_]+", "", before[-reach:]) if len(before) > reach else before
            after = re.sub(r"[^\W\d_]+$", "", after[:reach]) if len(after) > reach else after
            v = text[start:end].lower()
            d = re.sub("[^0-9]", "", v)
            domain = v.split("@")[-1]
            told = {"email": [domain, ".".join(domain.split(".")[-2:])], "ip": [".".join(v.split(".")[:n]) for n in (3, 2, 1)], "card": [d[:6], d[:2]], "phone": [d[:-4], d[:4]]}[kind]
            es = {("own", kind, v if kind in ("email", "ip") else d), ("kind", kind), *(("part", kind, x) for x in told)}
            w = [*word.findall(before.lower()), "", *word.findall(after.lower())]
            found += [(i, e, x, w[j - 1] if j else None, w[j + 1] if j + 1 < len(w) else None) for e in es for j, x in enumerate(w) if len(x) >= 3] + [(i, e, None, None, None) for e in es]
    docs = dict(rows)
    n, holds, pairs = len(rows), {}, {}
    for i, e, t, left, right in found:
        holds.setdefault(e, set()).add(i)
        if t is not None:
            p = pairs.setdefault((e, t), (set(), set(), set()))
            p[0].add(i)
            p[1].add(left)
            p[2].add(right)
    out = {}
    for (e, t), (ids, left, right) in pairs.items():
        a, b = len(left - {None}) > 1, len(right - {None}) > 1
        if len(ids) < 2 or len({docs[i] for i in ids}) < 2 or not (a or b if len(ids) >= support else a and b):
            continue
        ic = math.log2(n / len(holds[e]))
        pmi = math.log2(n * len(ids) / (len(holds[e]) * sum(t in x for x in has.values())))
        if ic > 0 and pmi >= disclosure * ic - 1e-12:
            for i in holds[e]:
                if t in has[i]:
                    out.setdefault(i, set()).add(t)
    return out


def test_terms_equal_brute_force(spark):
    rng = random.Random(5)
    common, cues = ["alpha", "bravo", "delta", "echo", "golf", "hotel", "india", "kilo", "lima"], ["dial", "visit", "écrire", "pay"]
    say = lambda n: " ".join(rng.choice(common) + rng.choice(["", "", "s", "ing"]) for _ in range(n))
    rows = []
    for i in range(150):
        text = say(rng.randint(0, 30))
        for _ in range(rng.choice([0, 0, 1, 2])):
            v = rng.choice([f"u{rng.randint(1, 4)}@h{rng.randint(1, 3)}.example.com", f"10.{rng.randint(0, 2)}.0.{rng.randint(1, 3)}", "+49 151 2345 678" + str(rng.randint(1, 3)), "4111 1111 1111 1111"])
            text += f" {rng.choice(cues[:1] if v[0] == '+' else cues[1:])} {say(rng.randint(0, 2))} {v} " + say(rng.randint(0, 30))
        rows.append((i, text))
    want = brute_terms(rows)
    got = {r.doc_id: {r.text[x.start : x.end].lower() for x in r.spans if x.kind == "term"} for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(map(len, want.values())) > 10 and {i: t for i, t in got.items() if t} == want


def test_secrets(spark):
    texts = ["token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" end", "donaudampfschifffahrtsgesellschaftskapitän 12345678901234567890123", "abcdefghijklmnopqrst123456789@mail.com", "a1" * 40, "x 9fQ2-7Lk_0Zr=3Vb8Tn1Wc5 y"]
    out = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    got = {r.doc_id: [r.text[x.start : x.end] for x in r.spans if x.kind == "secret"] for r in out}
    assert got == {0: ["04dbebab91ab85687d33eeaaf9ac699e1188f962"], 1: [], 2: [], 3: ["a1" * 40], 4: ["9fQ2-7Lk_0Zr=3Vb8Tn1Wc5"]}


def test_many_hits_in_one_text(spark):
    text = " ".join(f"{i}, 10.0.{i % 256}.7" for i in range(100_000))
    row = pii.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("base", "text").first()
    assert len(row.base) == 100_000 and all(row.text[x.start : x.end].startswith("10.0.") for x in row.base[::997])


def test_base_spans_of_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for r in pii.sanitise(docs).select("text", "base").collect():
        assert [tuple(x) for x in r.base] == brute(r.text)
