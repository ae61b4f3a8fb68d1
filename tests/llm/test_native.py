"""The operators made of DataFrame functions, against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from trendloom.llm import mixing, secrets, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATTERNS = {
    "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


def base_spans(text):
    found = []
    for place, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        found += [(m.start(), place, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.default_samples(spark, 3000))


def secret_texts():
    rng = random.Random(3)
    pieces = ["password=", "Token : '", "api_key=\"", "APIKEY=abc", "secret", " ", "é", "😀", "0123456789abcdef0", "AKIA", "ABCDEFGHIJKLMNOP12", "word ", "\n", "==", "'", "deadbeef" * 3, "x" * 12]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(150)]
    return [*texts, None, "", "\x00\x01 password=aaaaaaaaaaaa", "é password=abcdefghijkl " * 700, "f" * 100_000]


def test_secret_base_spans(spark, model):
    texts = secret_texts()
    rows = [(i, t, None, "s", None) for i, t in enumerate(texts)] + [(None, "token=abcdefabcdefabcdef", None, None, None)] * 2
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS row", "2 AS found", "3 AS spans0")
    found = secrets.find_secrets(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        got = ",".join(f"{x.kind}:{x.start}:{x.stop}" for x in r.found if x.kind != secrets.RANDOM)
        assert got == base_spans(r.row.text)


def test_secret_model(spark, model):
    tokens = [hashlib.sha256(b"k%d" % i).hexdigest()[:32] for i in range(100)] + ["".join(random.Random(i).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=32)) for i in range(100)]
    words = ["the_maximum_number_of_retries", "InternationalizationController", "getUserAccountBalanceHistory", "onthethingstioningthereandthe", "DEFAULT_CONNECTION_TIMEOUT_MS", "src/main/java/com/example/service", "----------------------------", "======================"]
    docs = spark.createDataFrame([(i, f"see {t} there", None, None, None) for i, t in enumerate(tokens + words)], DOCS)
    flagged = {r.row.doc_id for r in secrets.find_secrets(docs, model).collect() if any(x.kind == secrets.RANDOM for x in r.found)}
    assert len(flagged & set(range(200))) >= 195
    assert not flagged & set(range(200, 200 + len(words)))


def test_secret_ratio_and_spans(spark, model):
    """Ratios and added spans in plain Python, from counts of neighbouring characters."""
    import math

    samples = [tuple(r) for r in secrets.default_samples(spark, 3000).collect()]
    place = {c: i for i, c in enumerate(secrets.ALPHABET, 1)}
    width = len(secrets.ALPHABET) + 1
    counts = {0: defaultdict(int), 1: defaultdict(int)}
    for text, label in samples:
        for a, b in zip(text, text[1:], strict=False):
            counts[label][place.get(a, 0), place.get(b, 0)] += 1
    table = {}
    for a in range(width):
        n = {s: sum(counts[s][a, b] for b in range(width)) for s in (0, 1)}
        pool = [counts[0][a, b] + counts[1][a, b] + 1 for b in range(width)]
        for b in range(width):
            q = pool[b] / sum(pool)
            p = {s: (counts[s][a, b] + secrets.PRIOR * q) / (n[s] + secrets.PRIOR) for s in (0, 1)}
            table[a, b] = math.log(p[1] / p[0]) if pool[b] > 1 else 0.0
    assert model == pytest.approx([table[a, b] for a in range(width) for b in range(width)], abs=1e-6)

    def ratio(token):
        return sum(table[place.get(a, 0), place.get(b, 0)] for a, b in zip(token, token[1:], strict=False))

    rng = random.Random(17)
    texts = []
    for i in range(120):
        digest = hashlib.sha256(b"%d" % i).hexdigest()
        token = rng.choice([digest[: rng.randrange(18, 40)], digest.upper()[:24], "get" + "UserAccountBalance" * rng.randrange(1, 3), "".join(rng.choices(secrets.ALPHABET, k=rng.randrange(15, 40)))])
        texts.append(f"é {token} 😀 and_{token[:12]}({token})")
    found = secrets.find_secrets(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS), model).collect()
    added = 0
    for r in found:
        tokens = [(m.start(), m.end(), m[0]) for m in re.finditer(secrets.CANDIDATE, r.row.text)]
        want = [(a, b) for a, b, t in tokens if ratio(t) >= max(secrets.TOTAL, secrets.EACH * len(t))]
        close = [t for *_, t in tokens if abs(ratio(t) - max(secrets.TOTAL, secrets.EACH * len(t))) < 1e-3]
        assert close or [(x.start, x.stop) for x in r.found if x.kind == secrets.RANDOM] == want
        added += len(want)
    assert added > 100


def test_secret_query(spark, sf_dir):
    out = secrets.op1_secret_scan(spark, sf_dir)
    assert out.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in out.collect():
        base = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(f"{k}:") for k in PATTERNS)
        assert len(r.spans.split(",")) == r.n_assign + r.n_access + r.n_hex + r.n_random or r.spans == ""


def test_secret_empty_table(spark, model):
    assert secrets.find_secrets(spark.createDataFrame([], DOCS), model).count() == 0


def test_secret_redaction(spark, model):
    rows = [(1, "a password=abcdefabcdefabcdef01 b", "en", "s", 33), (2, "clean é text", "en", "s", 12), (3, None, None, None, None), (4, "", "en", "s", 0)]
    out = {r.doc_id: r for r in secrets.redact(spark.createDataFrame(rows, DOCS), model).collect()}
    assert out[1].text == "a [SECRET] b" and out[1].n_chars == len(out[1].text)
    assert tuple(out[2]) == rows[1] and out[3].text is None and out[4].text == ""
    assert secrets.redact(spark.createDataFrame([], DOCS), model).count() == 0


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mix(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, i, i]), rng.choice([None, "", "a b", " x\ty\x0bz\u00a0q ", "w " * rng.randrange(400)]), None, rng.choice(["b", "b", "b", "a", None, "é", "😀", ""]), None) for i in range(800)]
    rows += [(1, "one two three", None, "big", None)] * 40 + [(2, "w " * 60_000, None, "tail", None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS size", "'k' AS key", "0 AS target")
    out = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    as_rows = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert as_rows(out) == as_rows(again)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += size(text)
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(r[0]), size(r[1])) for r in rows)
    target = plain_targets(sizes)
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = duckdb.sql(mixing.SQL)
    out = mixing.op2_mix_sources(spark, sf_dir)
    assert want.columns == out.columns
    plain = lambda rows: sorted(str((*r[:3], round(r[3], 6), *r[4:])) for r in map(tuple, rows))
    assert plain(out.collect()) == plain(want.fetchall())


def test_mix_repeated_rows(spark, monkeypatch):
    """Rows without doc_id of one text, and one row many times: more than a range holds of one key."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    rows = [(None, "a b c", "s")] * 130 + [(5, "d e", "s")] * 90 + [(i, "w " * (i % 9), "s") for i in range(100)] + [(i, "x y", "t") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.col("doc_id"))
    runs = [mixing.mix_sources(docs.repartition(n), share=0.7, carry=carry) for n, carry in ((2, None), (5, None), (3, "row"))]
    assert runs[2].columns == [*runs[0].columns, "row"]
    out = [sorted(map(str, map(tuple, r.drop("row").collect()))) for r in runs]
    assert out[0] == out[1] == out[2] and len(out[0]) == len(rows)
    for r in runs[0].groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 0.5 + 1e-6


def test_mix_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('w ', int(id % 17)) AS text", "if(id % 3 = 0, 'a', 'b') AS source")
    out = mixing.mix_sources(docs, share=1.2).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in out:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.5 + 1e-6


def plain_verdict(url, rules):
    url = url or ""
    host, path = "", ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_urls(spark):
    rng = random.Random(1)
    hosts = ["example.org", "A.Example.ORG", "org", "com", "x.com", "notexample.org", "example.org.", ".org", "example.org:80", "", "é.com", "a..org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/1", "/de/", "/DE/", "?a=/de/", "/es/?q#f", "#/fr/", "/fr/é"]
    pages = [(i, rng.choice(["http://", "https://", "://", "a://b://", "http:/", ""]) + rng.choice(hosts) + rng.choice(paths)) for i in range(600)]
    pages += [(600, None), (601, ""), (None, "http://example.org/es/"), (602, "http://" + "a." * 24_000 + "org/" + "x" * 20000)] + [(603, "http://example.org/es/")] * 3
    table = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS short")
    out = urls.filter_urls(table, urls.rule_table(spark))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((i, *plain_verdict(u, urls.RULES))) for i, u in pages)
    assert urls.filter_urls(table.limit(0), urls.rule_table(spark)).count() == 0


def test_urls_many_rules(spark):
    rng = random.Random(2)
    rules = [(rng.choice(["allow", "block"]), rng.choice(["org", "b.org", "a.b.org", "com"]), "/" + "".join(rng.choices("ab/", k=rng.randrange(4)))) for _ in range(60)]
    pages = [(i, "http://" + rng.choice(["x.a.b.org", "b.org", "q.com"]) + "/" + "".join(rng.choices("ab/", k=5))) for i in range(300)]
    out = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), urls.rule_table(spark, rules)).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str((i, *plain_verdict(u, rules))) for i, u in pages)


def test_urls_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = duckdb.sql(urls.SQL).fetchall()
    assert sorted(map(str, map(tuple, urls.op6_url_filters(spark, sf_dir).collect()))) == sorted(map(str, want))
