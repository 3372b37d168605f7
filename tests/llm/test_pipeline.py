import random

import corpus_pipeline
import pytest

from claimscope.llm import langid
from tests.llm.helpers import words

EN, DE = "the of and house running ship thing".split(), "der die und nicht haus schiff über".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    item = " ".join(words(rng, 40))
    say = lambda ws, n: " ".join(rng.choice(ws) + rng.choice("abcdefgh") * 2 for _ in range(n))
    rows = [(i, say(EN if i % 3 else DE, 60), "en" if i % 3 else "de", f"s{i % 4 if i % 2 else 0}") for i in range(80)]
    rows += [(100 + i, rows[5][1], "en", "s1") for i in range(5)]  # copies
    rows += [(200, "12345 !!", None, "s1"), (201, None, None, None), (202, "", "en", "s2")]  # no language
    rows += [(300, f"{say(EN, 30)} {item} {say(EN, 30)}", "en", "s2")]  # benchmark
    rows += [(400, f"{say(EN, 40)} write to me@mail.example.com {say(EN, 5)}", "en", "s3")]  # personal data
    docs = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_take_effect_and_keep_clean_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "mixing":
            assert docs.columns == columns
            ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    everything = set(range(80)) | {100, 101, 102, 103, 104, 200, 201, 202, 300, 400}
    assert everything - ids[0] == {200, 201, 202}
    assert ids[0] - ids[1] == {100, 101, 102, 103, 104}
    assert ids[1] - ids[2] == {300} and ids[2] == ids[3]
    redacted = spark.read.parquet(f"{tmp_path}/3").filter("doc_id = 400").first()
    assert "<EMAIL>" in redacted.text and "@" not in redacted.text and redacted.n_chars == len(redacted.text)
    mixed = {r.doc_id for r in docs.select("doc_id").collect()}
    assert mixed <= ids[3] and set(columns) <= set(docs.columns)


def test_run_equals_the_stages(spark, folder):
    a = corpus_pipeline.run(spark, folder).select("doc_id", "copy").collect()
    b = corpus_pipeline.run(spark, folder).select("doc_id", "copy").collect()
    assert sorted(a) == sorted(b) and a


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_scores_are_not_read_from_lang(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    m = langid.fit(docs)
    lie = docs.selectExpr("doc_id", "text", "'xx' AS lang")
    assert sorted(map(str, langid.predict(docs, m).collect())) == sorted(map(str, langid.predict(lie, m).collect()))


def test_every_stage_equals_its_plain_definition(spark, folder):
    from collections import Counter

    from claimscope.llm import decontaminate
    from tests.llm import test_decontaminate, test_mixing, test_neardup
    from tests.llm.test_pii import base

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}  # every text with letters here is clear
    classes = test_neardup.brute_force([(i, rows[i].text) for i in kept])
    kept = {i for i in kept if classes[i] == i}
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = {i for i in kept if not any(test_decontaminate.distance(s, decontaminate.normalise(rows[i].text)) <= int(decontaminate.ERROR_RATE * len(s)) for s in items)}

    def redacted(text):
        out, at = [], 0
        for kind, start, end in base(text):
            out += [text[at:start], f"<{kind.upper()}>"]
            at = end
        return "".join(out) + text[at:]

    sizes = Counter(rows[i].source for i in kept)
    share = {s: n**0.5 / sum(m**0.5 for m in sizes.values()) for s, n in sizes.items()}
    want = Counter({(i, redacted(rows[i].text)): test_mixing.count(i, share[rows[i].source] * len(kept) / sizes[rows[i].source]) for i in kept})
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == +want
