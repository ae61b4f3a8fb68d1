"""Topic labels of every issue against a brute-force version over all posts."""

from collections import Counter, defaultdict

from trendloom.functions.text import normalize_title
from trendloom.model import posts
from trendloom.plans.issues import NEAR, label_topics, topic_labels, vectors


def components(nodes, near):
    """Each node's least node of its group."""
    of = {x: x for x in nodes}
    for a in nodes:
        for b in nodes:
            if a < b and of[a] != of[b] and near(a, b):
                old, new = max(of[a], of[b]), min(of[a], of[b])
                of = {k: new if v == old else v for k, v in of.items()}
    return of


def plain(titles):
    """By issue: titles, labels, largest share and cross pairs, of (issue, normalised title)."""
    by, out = defaultdict(set), {}
    for issue, norm in titles:
        by[issue].add(norm)
    for issue, norms in by.items():
        sets = {t: {w for w in t.split(" ") if len(w) >= 2} for t in norms}
        near = lambda a, b, s=sets: (len(s[a] & s[b]) / len(s[a] | s[b]) if s[a] | s[b] else 1.0) >= 0.4 - 1e-9
        sizes = Counter(components(norms, near).values()).values()
        n = len(norms)
        out[issue] = (n, len(sizes), round(max(sizes) / n, 6), (n * n - sum(x * x for x in sizes)) // 2)
    return out


def found(df):
    return {r.issue: (r.titles, r.labels, r.largest, r.cross_pairs) for r in df.collect()}


def test_every_post_counts(spark, sf_dir):
    import numpy as np

    rows = posts(spark, sf_dir).select("id", "title", normalize_title("title").alias("norm")).collect()
    ids = {r.id for r in rows}
    unit = {r.id: np.array(r.v) / np.linalg.norm(r.v) for r in vectors(spark, sf_dir).collect() if r.id in ids}
    issue = components(sorted(unit), lambda a, b: unit[a] @ unit[b] >= NEAR)
    want = plain((issue.get(r.id, r.id), r.norm) for r in rows if r.title)
    assert found(topic_labels(spark, sf_dir)) == want
    assert len(want) > 1


def test_issues_apart(spark):
    rows = [(1, 1, "flood hits old town", 1), (2, 1, "Flood hits the old town", 5), (3, 1, "town old hits flood", 0), (4, 1, "market opens", 9), (5, 1, "market opens", 8), (6, 1, "a !", 2), (7, 1, "b", 2),
            (8, 2, "flood hits old town", 0), (9, 3, None, 1), (10, 3, "", 1), (11, 2, "new bridge", 3)]
    df = spark.createDataFrame(rows, "id long, issue long, title string, view_count long")
    assert found(label_topics(df)) == {1: (6, 3, 0.5, 11), 2: (2, 2, 0.5, 1)}
    assert found(label_topics(df, most=1)) == {1: (1, 1, 1.0, 0), 2: (1, 1, 1.0, 0)}
