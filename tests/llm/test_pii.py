import hashlib
import re

from pyspark.sql import functions as F

from claimscope.llm import pii
from tests.llm.helpers import documents, edge_texts

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for no, (kind, p) in enumerate(RAW.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), no, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


TEXTS = [
    "mail a.b+c@ex-1.example.com. and x@y.z_d@e.f or @no.no a@b",
    "1.2.3.4.5.6.7.8 and 300.1.1.1 and 001.002.003.255, 1.2.3",
    "card 4785 3805 9239 1139, 4785380592391139x 4111-1111-1111-1111 12345678901 1 2",
    "+1 (743) 555-3824 44657 and +49 30 1234567. +1 2 +1 (((((((",
    "漢字 é +1 (523) 555-1055 équeou a@b.co 227.5.221.1",
    "1" * 5000 + " " + "a" * 5000 + " a" + ".b" * 4000 + "@c" + ".d" * 4000,
    "+1 4111 1111 1111 1111",
]


def test_base_spans_equal_plain_patterns(spark):
    texts = list(enumerate(TEXTS)) + [(i + 100 if i is not None else None, t) for i, t in edge_texts()]
    got = sorted((tuple(r) for r in pii.find(documents(spark, texts)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()), key=str)
    want = []
    for i, t in texts:
        b = base(t)
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        want.append((i, *(sum(k == x for k, _, _ in b) for x in RAW), hashlib.sha256(text.encode()).hexdigest(), text))
    assert got == sorted(want, key=str)


def test_disclosing_terms_need_support_and_strength(spark):
    texts = [(i, f"please call Zaphod Beeblebrox at +1 (743) 555-3824 for number {i} of the list") for i in range(4)]
    texts += [(10 + i, f"please read the list of number {i} for the record") for i in range(60)]
    docs = documents(spark, texts)
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert "term:12:18" in spans[0] and "term:19:29" in spans[0] and "phone:33:50" in spans[0]
    assert "term:0:6" not in spans[0] and spans[10] == ""
    few = pii.find(documents(spark, texts[:2] + texts[4:])).filter("n_term > 0").count()
    assert few == 0  # two texts are no evidence


def test_copies_of_one_text_are_no_evidence(spark):
    texts = [(i, "please call Zaphod Beeblebrox at +1 (743) 555-3824 now") for i in range(9)]
    assert pii.find(documents(spark, texts)).filter("n_term > 0").count() == 0


def test_sanitise_replaces_spans_and_keeps_columns(spark):
    docs = documents(spark, [(1, "a@b.co and 227.5.221.1, no. 4111 1111 1111 1111."), (2, None), (3, "clean"), (3, "clean")])
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == [(1, "<EMAIL> and <IP>, no. <CARD>."), (2, None), (3, "clean"), (3, "clean")]


def test_empty_table(spark):
    assert pii.find(documents(spark, [])).count() == 0


def test_no_python_on_the_executors(spark):
    plan = pii.find(documents(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_redact_merges_overlaps(spark):
    s = F.expr("array(named_struct('start',0,'end',4,'kind_no',0,'kind','email','value','x'), named_struct('start',2,'end',3,'kind_no',1,'kind','ip','value','x'), named_struct('start',5,'end',6,'kind_no',4,'kind','term','value','remove'))")
    assert spark.range(1).select(pii.redact(F.lit("abcdefgh"), s).alias("t")).first().t == "<EMAIL>egh"


def test_terms_far_from_the_entity_and_all_their_places_are_found(spark):
    gap = "please read the list of number and the record " * 3
    texts = [(i, f"Zaphod {gap}{i} call +1 (743) 555-3824 {gap}then zaphod") for i in range(4)]
    texts += [(10 + i, f"{gap}{i} then call") for i in range(60)] + [(4, texts[0][1])]
    docs = documents(spark, texts)
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("zaphod" not in out[i].lower() and "<PHONE>" in out[i] and "please read" in out[i] for i in range(5))
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    last = len(texts[0][1])
    assert f"term:{last - 6}:{last}" in spans[0] and "term:0:6" in spans[4] and spans[10] == ""


def test_rows_without_an_id_lose_the_same_terms(spark):
    filler = ["one two three four", "five six seven", "eight nine", "ten eleven twelve", "some other prose", "more of it"]
    texts = [(i, f"{filler[i % 6]} n{i} of Zorblatt at +49 170 555 01 99 {'abc' * (i + 1)}") for i in range(6)] + [(None, f"Zorblatt again at +49 170 555 01 99 {x}") for x in filler[:2]]
    texts += [(100 + i, f"plain text {i} {x}") for i, x in enumerate(filler * 9)]
    kept = [r.text for r in pii.sanitise(documents(spark, texts)).collect() if r.text and "<PHONE>" in r.text]
    assert len(kept) == 8 and not any("Zorblatt" in t for t in kept)


def test_terms_inside_addresses_do_not_count(spark):
    """A name of texts with one phone stays found when other texts hold it in an e-mail address only."""
    texts = [(i, f"{'abc' * (i + 1)} of Zorblatt at +49 170 555 01 99") for i in range(6)] + [(100 + i, f"plain words number {i} and more") for i in range(60)]
    texts += [(200 + i, f"write to zorblatt@host{i}.org {i}") for i in range(30)]
    kept = {r.doc_id: r.text for r in pii.sanitise(documents(spark, texts)).collect()}
    assert not any("Zorblatt" in kept[i] for i in range(6))
