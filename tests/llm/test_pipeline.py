"""The corpus pipeline stage by stage on planted documents."""

import re

import numpy as np

import corpus_pipeline
from textloom.llm import queries


def planted(tmp_path, spark):
    rng = np.random.default_rng(4)
    fresh = lambda n: " ".join(f"t{x}q" for x in rng.integers(0, 100_000, n))
    docs, labels, kind = [], [], {}

    def add(text, what, toxic=None):
        i = len(docs)
        kind[i] = what
        docs.append((i, text, "en", "src0", len(text) if text is not None else 0))
        if toxic is not None:
            labels.append((i, 1, int(toxic)))

    for k in range(120):
        bad = k % 3 == 0
        add(fresh(40) + (" grmpf zounds blorg" if bad else ""), "toxic" if bad else "clean", bad)
    for k in range(15):
        add(fresh(30) + " zounds " + fresh(20) + " grmpf", "toxic")
    base = fresh(150)
    leak = " ".join(f"bench{k}" for k in range(14))
    for t in (base, base, base.replace(base.split()[70], "changed")):
        add(t, "copy")
    add(fresh(20) + " " + leak + " " + fresh(20), "leak")
    add(leak, "all leak")
    add(fresh(20) + " write to anna.b@corp.example.org now", "private")
    add(None, "null")
    add("", "empty")
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "Bench0 " + leak[7:])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, kind


def test_stages(spark, tmp_path):
    d, docs, kind = planted(tmp_path, spark)
    texts = {i: t for i, t, *_ in docs}
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns = now.columns
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, d)
        now.write.parquet(f"{d}/stage{k}")
        now = spark.read.parquet(f"{d}/stage{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns
        out[name] = {r.doc_id: r for r in now.collect()}
    of = lambda stage, what: [i for i in out[stage] if kind[i] == what]
    n = lambda what: sum(k == what for k in kind.values())
    assert of("toxicity", "toxic") == [] and len(of("toxicity", "clean")) == n("clean") and len(of("toxicity", "copy")) == 3
    assert len(of("simhash_near_dedup", "copy")) == 1 and len(of("simhash_near_dedup", "clean")) == n("clean")
    clean = out["benchmark_decontamination"]
    assert of("benchmark_decontamination", "all leak") == []
    (leak,) = of("benchmark_decontamination", "leak")
    assert "bench" not in clean[leak].text and clean[leak].n_chars == len(clean[leak].text)
    assert all(clean[i].text == texts[i] for i in clean if kind[i] != "leak")
    private = out["pii_surrogates"]
    (p,) = of("pii_surrogates", "private")
    assert "anna" not in private[p].text and re.search(r"\S+@\S+\.example\.org now$", private[p].text)
    assert all(private[i].text == clean[i].text for i in private if i != p)
    assert set(out["sentencepiece"]) == set(private) and all(r.n_tokens >= 1 for r in out["sentencepiece"].values())


def test_run_equals_its_stages(spark, tmp_path):
    d, _, kind = planted(tmp_path, spark)
    got = corpus_pipeline.run(spark, d).collect()
    assert len(got) == len({r.doc_id for r in got}) and all(kind[r.doc_id] not in ("toxic", "all leak") for r in got)


def test_registration():
    names = queries.queries()
    assert [sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names)] == [list(range(1, 11))]
    assert set(queries.oracle_sql()) <= set(names)
