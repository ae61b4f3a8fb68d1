"""Separator scan: exact round trips through flat token files, and a plain loop over all boundaries."""

import numpy as np
import pytest

from trendloom.llm import common, tokens

SCHEMA = "doc_id long, text string, n_tokens int"


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.encoder(open(tokens.VOCABULARY, "rb").read())


def test_counts_match_the_tokenizer(spark, tokenizer):
    texts = ["", None, "one", "a b  c\n\n", "é" * 50, "<|endoftext|> x", " " * 20_000 + "y", "z " * 3000, "one"]
    rows = [(i if i != 4 else None, t, 9) for i, t in enumerate(texts)] + [(2, "one", 9)]
    out = tokens.count_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = sorted((str(i), len(tokenizer.encode_ordinary(t or ""))) for i, t, _ in rows if t is None or len(t) < 20_000)
    got = sorted((str(r.doc_id), r.n_tokens) for r in out)
    assert [x for x in got if x[0] != "6"] == want
    assert dict(got)["6"] == len(tokens.encode(tokenizer, texts[6]))
    assert tokens.count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files_of_few_records(spark, tokenizer):
    """Tasks that write several files each: a document's count stays its own."""
    rows = [(i, "word " * i, 9) for i in range(40)]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 10)
    try:
        out = tokens.count_tokens(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted((r.doc_id, r.n_tokens) for r in out) == [(i, len(tokenizer.encode_ordinary(t))) for i, t, _ in rows]
    assert len({r.part for r in out}) == 4


def test_long_spaces_are_encoded_alike(tokenizer):
    for text in ("a" + " " * 6000 + "b", " " * 5500, "\n" * 6000 + "x", "a" + " \n" * 3000):
        assert tokens.encode(tokenizer, text) == tokenizer.encode_ordinary(text)


@pytest.mark.parametrize("width", [2, 4])
def test_scan_of_foreign_files(spark, tmp_path, width):
    """Blocks of 4 tokens, runs of 2 blocks: separators at, before and beyond every boundary."""
    rng, want = np.random.default_rng(3), []
    for k in range(12):
        ids = rng.choice([7, 8, 9], rng.integers(0, 60), p=[0.3, 0.4, 0.3])
        if k == 0:
            ids = np.array([8] * 37)
        ids.astype(f"<u{width}").tofile(tmp_path / f"part-{k:05}.bin")
        start = ordinal = 0
        for i, x in enumerate([*ids, None]):
            if x == 7 or (x is None and i > start):
                want.append((f"part-{k:05}.bin", ordinal, start, i - start))
                start, ordinal = i + 1, ordinal + 1
    out = tokens.scan_token_files(spark, str(tmp_path), end=7, width=width, block=4, run=2)
    assert sorted((r.part, r.ordinal, r.start, r.n_tokens) for r in out.collect()) == sorted(want)


def test_broken_file_is_an_error(spark, tmp_path):
    (tmp_path / "part-00000.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        tokens.scan_token_files(spark, str(tmp_path)).count()


def test_scopes_of_threads_are_their_own(spark):
    """Two threads with open scopes: each removes its own tables, whatever order they end in."""
    import os
    import threading

    first, second = threading.Event(), threading.Event()
    paths, left = {}, {}

    def there(path):
        return os.path.exists(path.removeprefix("file://"))

    def early():
        with common.work_tables(spark):
            paths["early"] = common.work_path(spark, "scope")
            spark.range(3).write.parquet(paths["early"])
            first.set()
            second.wait(60)
        left["late"] = there(paths["late"])

    def late():
        first.wait(60)
        with common.work_tables(spark):
            paths["late"] = common.work_path(spark, "scope")
            spark.range(3).write.parquet(paths["late"])
            second.set()
            one.join(60)

    one, two = threading.Thread(target=early), threading.Thread(target=late)
    one.start()
    two.start()
    one.join(60)
    two.join(60)
    assert left == {"late": True}
    assert not there(paths["early"]) and not there(paths["late"])
