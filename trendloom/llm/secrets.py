"""Secret scans with DataFrame functions only.

Three fixed patterns give the base findings. The method adds tokens that a character Markov model
of random strings explains better than one of ordinary identifiers, by log-likelihood ratio.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, table_of

#: (kind, pattern, group that is measured, least length of that group)
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: The kind that the method adds.
RANDOM = "random"
#: Symbols of the model; all others count as one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Least length of a candidate token, and least ratio in nats in all and per character.
LEAST, TOTAL, EACH = 20, 12.0, 0.6
#: Samples' worth of the pooled shares in each label's shares.
PRIOR = 30
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Spans whose offsets are summed in one go; more are summed block by block, in linear time.
BLOCK = 256

#: Parts of ordinary identifiers for the default labelled samples.
PARTS = """account action active address agent array async average backup balance batch before block buffer builder cache
callback channel client cluster column command comment commit common config connection content context control counter country
create current customer database default delete detail device document domain download element email engine entity error event
example export factory feature fetch field filter format frame function gateway global group handler header height history image
import index input insert integer internal issue items kernel label language layout length library limit listener loader local
logger manager master memory message method metric model module monitor network notification number object offset option order
output package parameter parent parser password payment person pipeline player pointer policy position process product profile
project property provider query queue random record region remote render report request resource response result return route
sample schema scope screen search section select server service session setting shadow source stack status storage stream string
style summary support system table target template text thread ticket timeout title token transaction transform trigger update
upload user validate value vector version video view visible widget window worker writer the and with from that this have which
their there about would these other words could people water after under never information international administration""".split()


def default_samples(spark: SparkSession, count: int = 6000) -> DataFrame:
    """``count`` labelled samples of each label, made by rule: (sample, secret).

    Random strings are digests in hex, Base64 and capitals with digits; identifiers join two to
    four ordinary parts in the usual styles, some with a number, or are long words.
    """
    n = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample"), n.cast("string")).cast("binary"), 256)
    base64 = F.base64(F.unhex(digest))
    capitals = F.regexp_replace(F.upper(base64), "[^A-Z0-9]", "")
    size = F.lit(20) + (n % 21).cast("int")
    text = F.when(n % 3 == 0, digest).when(n % 3 == 1, base64).otherwise(capitals)
    secret = spark.range(count).select(F.substring(text, F.lit(1), size).alias("sample"), F.lit(1).alias("secret"))
    parts = F.split(F.lit(" ".join(PARTS)), " ")
    pick = lambda i: F.element_at(parts, (F.pmod(F.xxhash64(n, F.lit(i)), F.lit(len(PARTS))) + 1).cast("int"))
    chosen = F.slice(F.array(*[pick(i) for i in range(4)]), F.lit(1), (F.lit(2) + (n % 3)).cast("int"))
    titled = F.array_join(F.transform(chosen, F.initcap), "")
    style = (n / 3).cast("int") % 7
    text = (
        F.when(style == 0, F.array_join(chosen, "_")).when(style == 1, F.array_join(chosen, "-")).when(style == 2, titled)
        .when(style == 3, F.upper(F.array_join(chosen, "_"))).when(style == 4, F.array_join(chosen, ""))
        .when(style == 5, F.concat(F.array_join(chosen, "/"), F.lit("_"), (n % 100).cast("string"))).otherwise(F.upper(F.array_join(chosen, "")))
    )
    return secret.unionByName(spark.range(count).select(text.alias("sample"), F.lit(0).alias("secret")))


def _symbol(c: Column) -> Column:
    """0 for a character outside the alphabet, else its place."""
    return F.instr(F.lit(ALPHABET), c)


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of neighbouring characters, row by row.

    Transition shares of either label, drawn to the pooled shares as by ``PRIOR`` more samples, so
    that rare ones say little; those unseen in both say nothing. The alphabet bounds the result:
    ``(len(ALPHABET) + 1) ** 2`` numbers, whatever the number of samples. Null samples or labels
    don't count; without samples every ratio is 0.
    """
    width = len(ALPHABET) + 1
    chars = F.filter(F.split("sample", ""), lambda c: c != "")
    pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.size(chars)), lambda a, b: _symbol(a) * width + _symbol(b))
    rows = samples.where("sample IS NOT NULL AND secret IS NOT NULL").select((F.col("secret") == 1).alias("secret"), F.explode(pairs).alias("pair"))
    counts = {(r.secret, r.pair): r.n for r in rows.groupBy("secret", "pair").agg(F.count("*").alias("n")).collect()}
    table = []
    for a in range(width):
        own = {s: [counts.get((s, a * width + b), 0) for b in range(width)] for s in (True, False)}
        both = [x + y + 1 for x, y in zip(own[True], own[False], strict=True)]
        pooled = [x / sum(both) for x in both]
        p = {s: [(n + PRIOR * q) / (sum(own[s]) + PRIOR) for n, q in zip(own[s], pooled, strict=True)] for s in own}
        table += [round(math.log(x / y), 6) if m > 1 else 0.0 for x, y, m in zip(p[True], p[False], both, strict=True)]
    return table


def ratio(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a token under ``model``, in nats."""
    width = len(ALPHABET) + 1
    table = table_of(model)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    def step(acc: Column, c: Column) -> Column:
        s = _symbol(c)
        gain = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.element_at(table, acc["last"] * width + s + 1))
        return F.struct(s.alias("last"), (acc["sum"] + gain).alias("sum"))
    return F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), start, step, lambda acc: acc["sum"])



def _items(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as array<struct<gap, text>>.

    The pieces between matches and the matches alternate; ``gap`` is the length of the piece before.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    pairs = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("text"))
    return F.filter(pairs, lambda x: x["text"].isNotNull())


def _spans(items: Column) -> Column:
    """Offsets of the matches in ``items``, a column of its own: array<struct<text, start, stop>>.

    Running sums of gaps and lengths, within blocks of ``BLOCK`` and then over blocks, as each step
    copies what it has gathered.
    """
    empty = F.array().cast("array<struct<text:string,start:int,stop:int>>")
    whole = F.array().cast("array<array<struct<text:string,start:int,stop:int>>>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.length(x["text"])
        span = F.struct(x["text"].alias("text"), start.alias("start"), stop.alias("stop"))
        return F.struct(F.concat(acc["spans"], F.array(span)).alias("spans"), stop.alias("at"))

    def chain(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(empty.alias("spans"), acc["at"].alias("at")), place)
        # one struct in an array, so that what the block gives is made once
        return F.transform(F.array(done), lambda d: F.struct(F.concat(acc["blocks"], F.array(d["spans"])).alias("blocks"), d["at"].alias("at")))[0]

    spans = F.flatten(F.aggregate(blocks, F.struct(whole.alias("blocks"), F.lit(0).alias("at")), chain)["blocks"])
    return F.when(F.size(items) > 0, spans).otherwise(empty)


def _at_least(pattern: str, least: int) -> str:
    """The pattern with its last, measured repetition at ``least`` or more characters in all."""
    if pattern.startswith("AKIA"):
        return pattern[:-1] + f"{{{least - 4},}}"
    return pattern.removesuffix(")").removesuffix("+") + f"{{{least},}}" + ")" * pattern.endswith(")")


def _long_enough(pattern: str, group: int, least: int):
    return lambda x: F.length(F.regexp_extract(x["text"], pattern, group) if group else x["text"]) >= least


def _named(kind: str, place: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), x["stop"].alias("stop"))


def find_secrets(docs: DataFrame, model: list[float], total: float = TOTAL, each: float = EACH) -> DataFrame:
    """Adds ``found`` to ``docs`` (as a row in struct ``row``): array<struct<start, place, kind, stop>>, sorted.

    ``place`` is the kind's place: the base kinds as listed, then the method's. A base finding is a
    leftmost non-overlapping match whose measured group is long enough; offsets count code points.
    The method adds each token of ``LEAST`` or more characters whose ratio is at least ``total``
    and ``each`` per character; its span may lie within a base one.

    Nulls: a null text is empty and has no findings; other nulls stay. Texts are scanned whole,
    whatever their length. Every row gives one row, repeated rows too; an empty table gives none.
    Other columns don't matter, whatever their names.
    """
    kinds = [*KINDS, (RANDOM, CANDIDATE, 0, LEAST)]
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    no_items = F.array().cast("array<struct<gap:int,text:string>>")
    # most texts have no match that is long enough, and one pass tells
    items = [F.when(F.col("text").rlike(_at_least(p, n) if k != RANDOM else p), _items(F.col("text"), p)).otherwise(no_items).alias(f"items{i}") for i, (k, p, _, n) in enumerate(kinds)]
    out = out.select("row", "text", *items)
    out = out.select("row", "text", *[_spans(F.col(f"items{i}")).alias(f"spans{i}") for i in range(len(kinds))])
    found = []
    for i, (kind, pattern, group, least) in enumerate(kinds):
        if kind == RANDOM:
            kept = F.filter(f"spans{i}", lambda x: ratio(x["text"], model) >= F.greatest(F.lit(total), F.lit(each) * F.length(x["text"])))
        else:
            kept = F.filter(f"spans{i}", _long_enough(pattern, group, least))
        found.append(F.transform(kept, _named(kind, i)))
    return out.select("row", "text", F.array_sort(F.concat(*found)).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"), train(default_samples(spark)))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        *[count(k[0]).alias(f"n_{k[0]}") for k in KINDS],
        F.sha2(_joined(F.filter("found", lambda x: x["kind"] != RANDOM)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        count(RANDOM).alias(f"n_{RANDOM}"),
    )


def redact(docs: DataFrame, model: list[float], mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; ``n_chars``, if there, follows.

    Overlapping spans are masked together. Documents without secrets stay as they are, nulls too.
    """

    def merge(acc: Column, x: Column) -> Column:
        apart = x["start"] >= acc["stop"]
        piece = F.substring(F.col("text"), acc["stop"] + 1, x["start"] - acc["stop"])
        parts = F.when(apart, F.concat(acc["parts"], F.array(piece, F.lit(mask)))).otherwise(acc["parts"])
        return F.struct(parts.alias("parts"), F.greatest(acc["stop"], x["stop"]).alias("stop"))

    found = find_secrets(docs, model)
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("stop"))
    merged = F.aggregate("found", start, merge, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(F.col("text"), a["stop"] + 1, F.length("text"))))
    masked = found.select("row", F.when(F.size("found") > 0, merged).alias("masked"))
    changes = {"text": F.coalesce("masked", F.col("row.text").cast("string")).alias("text")}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.col("masked").isNotNull(), F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")).alias("n_chars")
    return masked.select(*[changes.get(c, F.col(f"row.`{c}`")) for c in docs.columns])
