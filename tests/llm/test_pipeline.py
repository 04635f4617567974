"""The pipeline's stages and the registered queries of the subpackage."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import catalogue, decontaminate, secrets, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_is_the_stages_in_turn(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # where toxic documents are enough to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], sf))
        if name != "tokens":
            assert steps[-1].columns == COLUMNS and steps[-1].schema == docs.schema
    n = [d.count() for d in steps]
    assert n == sorted(n, reverse=True) and n[0] > n[1] > n[2] and n[3] == n[4] == n[5]
    want = sorted(map(tuple, steps[-1].collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == want


def test_each_decision_takes_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bad = {r.doc_id for r in toxicity.op5_toxicity(spark, sf).where("predicted = 1").collect()}
    assert {r.doc_id for r in toxicity.stage(spark, docs, sf).collect()} == {r.doc_id for r in docs.collect()} - bad
    first = {r.component_id for r in simhash.near_copies(docs).collect()}
    assert sorted(r.doc_id for r in simhash.copies_stage(spark, docs, sf).collect()) == sorted(first)
    leaked = {r.doc_id for r in decontaminate.op3_decontaminate(spark, sf).collect()}
    assert {r.doc_id for r in decontaminate.stage(spark, docs, sf).collect()} == {r.doc_id for r in docs.collect()} - leaked
    masked = secrets.stage(spark, docs, sf)
    assert masked.count() == docs.count() and secrets.scan(masked).agg({"n_spans": "sum"}).first()[0] == 0


def test_rows_that_share_an_id_are_decided_on_each_by_itself(spark, sf):
    a, b, c = ("one two three four five six", "another text altogether here", "a third text that stands alone")
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (0, b, "y"), (2, c, "y"), (2, a, "z"), (None, c, "z"), (None, "no id at all", "z"), (None, "no id at all", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    want = [(1, a, "x"), (0, b, "y"), (2, c, "y"), (None, "no id at all", "z")]
    for send in (1000, 0):
        assert sorted(map(tuple, simhash.copies_stage(spark, docs, sf, send).collect()), key=str) == sorted(want, key=str)


def test_stages_take_odd_rows(spark, sf):
    rows = [(1, None, "en", "s", None), (1, None, "en", "s", None), (None, "text without id", None, None, 3), (2, "", "en", "s", 0), (3, "twin words here now", "en", "s", 5), (4, "twin words here now", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, sf), stage(spark, empty, sf)
        assert empty.count() == 0
        assert docs.count() == (6 if name == "toxicity" else 3), name


def _text(v):
    return "" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, rel = catalogue.QUERIES[name](spark, sf), con.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(tuple(map(_text, r)) for r in df.select(rel.columns).collect()) == sorted(tuple(map(_text, r)) for r in rel.fetchall())


@pytest.mark.parametrize("name,fold,label", [("op4_quality", 5, "quality"), ("op5_toxicity", 4, "toxic")])
def test_held_out_accuracy(spark, name, fold, label):
    big = "/root/testdata/sf0.1"
    got = catalogue.QUERIES[name](spark, big).join(spark.read.parquet(f"{big}/labels.parquet").select("doc_id", label), "doc_id")
    r = got.where("held_out").selectExpr(f"avg(cast(predicted = {label} AS double)) AS accuracy", "count(*) AS n").first()
    assert r.n > 500 and r.accuracy > 0.97


def _jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies_as_by_brute_force(spark, sf):
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = [f"w{i}" for i in range(200)]
    texts += [(10**6 + k, " ".join(f"x{k}" if i in (20 * k, 20 * k + 10) else w for i, w in enumerate(base))) for k in range(10)]
    texts += [(10**7, " ".join(base[:-50])), (10**7 + 1, "short text"), (10**7 + 2, "Short  text"), (10**7 + 3, "short texts")]
    least = {i: i for i, _ in texts}
    pairs = [(i, j) for k, (i, a) in enumerate(texts) for j, b in texts[:k] if _jaccard(a, b) >= 0.8]
    for _ in texts:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.id: r.component_id for r in simhash.near_copies(docs).collect()} == least
    sets = simhash.shingled(docs, whole_sets=True).dropDuplicates(["cls"])
    one_file = simhash.shingled(docs).dropDuplicates(["cls"]).select(F.lit(0).alias("key"), "cls", "n", F.col("cls").alias("root"))
    for sizes in ({}, {"members": 30}, {"shingles": 2000}):
        links = {frozenset(r) for r in simhash.connected(simhash.within_files(one_file, sets, 0.8, **sizes)).collect()}
        if not sizes:
            want = links
        assert links == want and len(links) > 10
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_near_copies_come_from_fingerprints(spark, sf, monkeypatch):
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = [f"w{i}" for i in range(400)]
    texts += [(10**6 + k, " ".join(f"x{k}" if i == 30 * k else w for i, w in enumerate(base))) for k in range(10)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = simhash.shingled(docs).where("n > 0").select("id", "fp").collect()
    text, first, files = dict(texts), {i: i for i, _ in texts}, {r.id: r.fp for r in one}

    def joined(of, pairs):
        for _ in texts:
            for i, j in pairs:
                of[i] = of[j] = min(of[i], of[j])

    joined(files, [(r.id, s.id) for k, r in enumerate(one) for s in one[:k] if ((r.fp ^ s.fp) & (2**64 - 1)).bit_count() <= 3])
    blank = [r for r in first if r not in files]
    pairs = [(i, j) for k, i in enumerate(files) for j in list(files)[:k] if files[i] == files[j] and _jaccard(text[i], text[j]) >= 0.8]
    joined(first, pairs + [(blank[0], i) for i in blank[1:]])
    assert {r.id: r.component_id for r in simhash.near_copies(docs, bands=0).collect()} == first  # by fingerprints alone
    assert len({i for i, j in pairs if text[i] != text[j]}) > 5
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, bits: asked.append(bits) or links(fps, bits))
    assert simhash.copies_stage(spark, docs, sf).count() <= len(set(first.values())) and asked == [3]


def test_near_duplicates_build_no_small_tables_in_the_driver(spark, sf):
    """Only the broadcast that is asked for: each that Spark chose by itself took some MB of the driver's heap."""
    docs, key = spark.read.parquet(f"{sf}/documents.parquet"), "spark.sql.autoBroadcastJoinThreshold"
    store, before = spark._jsparkSession.sharedState().statusStore(), spark.conf.get(key)
    seen = store.executionsCount()
    simhash.copies_stage(spark, docs, sf)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription() for i in range(seen, ran.size())]
    assert len(plans) > 10 and spark.conf.get(key) == before
    assert sum("BroadcastExchange" in p for p in plans) <= 1


def test_fitting_gives_the_drivers_memory_back(spark, sf, monkeypatch):
    calls = []
    monkeypatch.setattr(toxicity, "release", lambda: calls.append(1), raising=False)
    toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert calls
