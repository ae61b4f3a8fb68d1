"""Each stage of the pipeline against a brute-force version on the rows that it was given."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from test_decontaminate import plain
from test_neardup import plain_groups

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""")
PLANTED = 900_000


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The smallest tables and planted rows: a copy, a passage, a secret, odd texts and null columns."""
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = next(r for r in docs.where("lang = 'en'").orderBy("doc_id").collect() if len(r.text.split()) > 200)
    item = next(r for r in bench.orderBy("item_id").collect() if len(r.text.split()) >= 13)
    words = [f"{w}x{i}" for i, w in enumerate(clean.text.split()[:60])]
    texts = [clean.text, clean.text + " end", item.text, " ".join(clean.text.split()[::-1]) + ' api_key = "Zk3Qw9Lm2Xv7Bn5Tr8Yp"', " ".join(words), None, "", "12345 !!", "the"]
    rows = [(PLANTED + i, t, "en", "planted", len(t or "")) for i, t in enumerate(texts)] + [(None, " ".join(clean.text.split()[5:]), None, None, None)]
    more = spark.createDataFrame(rows, docs.schema)
    docs.unionByName(more).repartition(3).write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{k}")
        after = spark.read.parquet(f"{folder}/out{k}")
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def key(rows):
    return sorted((str(r.doc_id), str(r.text)) for r in rows)


def test_columns(steps):
    assert [s[0] for s in steps] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "mix"]
    assert all(s[3] == s[4] for s in steps[:-1]) and steps[-1][4][: len(steps[-1][3])] == steps[-1][3]


def test_language(steps):
    _, before, after, *_ = steps[0]
    kept = {r.doc_id for r in after}
    assert not kept & {PLANTED + 5, PLANTED + 6, PLANTED + 7}
    prose = [r for r in before if r.doc_id is not None and r.lang and len((r.text or "").split()) >= 30]
    assert sum(r.doc_id in kept for r in prose) >= 0.97 * len(prose)
    assert all(r.lang is not None for r in after)


def test_near_duplicates(steps):
    _, before, after, *_ = steps[1]
    # a null id counts beyond all others: with a linked id its row goes
    rows = [(r.doc_id if r.doc_id is not None else 1 << 62, r.text) for r in before]
    kept = {t[0] for t in map(tuple, plain_groups(rows)) if t[3]}
    assert key(after) == key([r for r in before if (r.doc_id if r.doc_id is not None else 1 << 62) in kept])
    assert not {PLANTED, PLANTED + 1} & {r.doc_id for r in after}


def test_decontamination(steps, spark, folder):
    _, before, after, *_ = steps[2]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {t[0] for t in plain([(r.doc_id, r.text) for r in before], items) if t[5]}
    assert key(after) == key([r for r in before if r.doc_id not in dirty])


def test_secrets(steps):
    _, before, after, *_ = steps[3]
    was, now = {r.doc_id: r for r in before}, {r.doc_id: r for r in after}
    assert was.keys() == now.keys()
    for i, r in now.items():
        for m in ASSIGN.finditer(was[i].text or ""):
            assert m[0] not in r.text
        assert (r.lang, r.source) == (was[i].lang, was[i].source) and (r.text == was[i].text or "[SECRET]" in r.text)
    assert "Zk3Qw9Lm2Xv7Bn5Tr8Yp" not in "".join(r.text for r in after)


def test_mix(steps):
    _, before, after, *_ = steps[4]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before}
    total, taken, target = defaultdict(int), defaultdict(int), {}
    for r in before:
        total[r.source] += size[r.doc_id]
    for r in after:
        assert (r.size, r.source_size) == (size[r.doc_id], total[r.source]) and 0 < r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, want = 1.5 * sum(total.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            want |= share
            break
        want |= {s: 2 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        open_ -= over
    for s, t in target.items():
        assert t == pytest.approx(want[s]) and abs(taken[s] - t) <= 1


def test_run_gives_the_stages_rows(spark, folder, steps):
    out = pipeline.run(spark, folder).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "taken").collect()
    want = spark.read.parquet(f"{folder}/out4").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "taken").collect()
    assert sorted(out, key=str) == sorted(want, key=str)


CLASHING = "size int, target int, source_size int, taken int, __key int, `a.b` int, row int, hash int, first int, lang_pred int"


@pytest.fixture(scope="module")
def odd(spark, folder):
    """Columns of the stages' own names, repeated rows, one doc_id of two texts, rows without doc_id."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").where("lang = 'en' AND doc_id < 900000").collect() if len((r.text or "").split()) > 100}
    a, b, c, d = [texts[k] for k in sorted(texts)[:4]]
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (1, b, "en", "s"), (None, c, None, "s"), (None, c, None, "s"), (None, d, None, None), (2, a + " more", "en", "t"), (3, None, None, None), (4, "", "en", "s")]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    return spark.createDataFrame([(*r, len(r[1] or ""), *range(10)) for r in rows], schema), (a, b, c, d)


@pytest.mark.parametrize("name", [s[0] for s in pipeline.STAGES])
def test_clashing_columns(spark, folder, odd, name):
    docs, _ = odd
    stage = dict(pipeline.STAGES)[name]
    out, none = stage(spark, docs, folder), stage(spark, docs.where("false"), folder)
    added = ["size", "source_size", "target", "taken"] if name == "mix" else []
    assert out.columns == none.columns == [c for c in docs.columns if c not in added] + added
    assert none.count() == 0
    for r in out.collect():
        assert (r["a.b"], r["__key"], r["row"], r["hash"], r["lang_pred"]) == (5, 4, 6, 7, 9)


def test_documents_of_one_doc_id(spark, folder, odd):
    docs, (a, b, c, d) = odd
    kept = sorted((str(r.doc_id), r.text) for r in pipeline.drop_near_duplicates(spark, docs, folder).collect())
    ones = [x for x in kept if x[1] in (a, a + " more")]
    assert len(ones) == 1 and sorted(x for x in kept if x not in ones) == sorted([("1", b), ("None", c), ("None", d), ("3", None), ("4", "")], key=str)


def test_mix_of_repeated_rows(spark, folder, odd):
    docs, _ = odd
    many = docs.unionByName(docs).unionByName(docs)
    out = pipeline.mix_sources(spark, many, folder).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(out) == 3 and all(abs(r.taken - r.target) <= 0.5 + 1e-6 for r in out)
