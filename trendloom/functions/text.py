"""Text functions as Column expressions: normalisers, hashes, grams, tokenizers, dates and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Particles and stopwords of the tokenizer for duplicate titles.
TITLE_PARTICLES = (
    "에서는", "으로서", "으로는", "에서도", "으로도",
    "에서", "으로", "에게", "까지", "부터", "라는", "이라",
    "처럼", "만큼", "에는", "에도", "와는", "과는",
    "은", "는", "이", "가", "을", "를", "에", "의",
    "도", "와", "과", "로", "며", "면", "고", "한",
    "된", "할", "들",
)
TITLE_STOPWORDS = (
    "관련", "대한", "이번", "통해", "위해", "따르면", "대해",
    "오늘", "내일", "어제", "현재", "최근", "사실",
    "것으로", "것이", "하는", "있는", "없는", "되는",
    "그리고", "하지만", "그러나", "또한", "그래서",
)
# Particles and stopwords of the tokenizer for topics.
TOPIC_PARTICLES = (
    "으로", "에서", "에게", "한테", "까지", "부터", "마다", "조차", "마저",
    "이나", "이라", "이라도", "이라면", "이지만",
    "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "만",
    "도", "나", "랑", "하고", "이며", "며", "며는", "여", "요", "죠",
)
TOPIC_STOPWORDS = (
    "관련", "대한", "통해", "위해", "대해", "경우", "때문", "이번", "오늘",
    "최근", "지난", "있다", "없다", "하다", "되다", "및", "또는", "그리고",
    "하지만", "그러나", "따라서", "또한", "한편",
)
# Words of broadcasts that don't tell one event from another.
BROADCAST_STOPWORDS = (
    "속보", "뉴스", "단독", "영상", "라이브", "풀영상", "종합", "오늘", "내일", "어제",
    "현장", "인터뷰", "브리핑", "공식", "한국", "미국", "일본", "중국", "북한",
    "대통령", "정부", "국회", "지금", "직접", "발표", "기자", "특보", "아침", "저녁",
    "이슈", "집중", "취재", "리포트", "전체", "하이라이트", "풀버전", "클립", "뉴스룸",
    "정치", "사회", "경제", "국제", "문화", "연예", "스포츠", "날씨",
)


def normalize_title(title: Column) -> Column:
    """Without [...] parts; only Hangul, Latin letters, digits and single spaces; trimmed, lower case."""
    plain = F.regexp_replace(title, r"\[[^\]]*\]", "")
    plain = F.regexp_replace(plain, r"[^가-힣a-zA-Z0-9 \t\n\r]", "")
    return F.lower(F.trim(F.regexp_replace(plain, r"[ \t\n\r]+", " ")))


def title_hash(title: Column) -> Column:
    return F.md5(normalize_title(title).cast("binary"))


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring characters; none for texts of fewer than 2."""
    at = F.sequence(F.lit(1), F.length(text) - 1)
    pairs = F.transform(at, lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")


def suffix_pattern(particles: tuple, least: int) -> str:
    """Matches a word of a stem of ``least`` characters or more and the first of ``particles`` that it ends in.

    The stem is as short as can be, so of two particles that fit the longer is cut; one that comes after
    its own ending in the list is never reached.
    """
    reached = [p for i, p in enumerate(particles) if not any(p.endswith(q) for q in particles[:i])]
    return f"^({'.' * (least - 1)}.+?)(?:{'|'.join(reached)})$"


def title_tokens(title: Column) -> Column:
    """Distinct words of a normalised title for finding duplicates: one particle cut, unless one character
    would be left; no stopwords, numbers and single characters."""
    def cut(w: Column) -> Column:
        stem = F.regexp_replace(w, suffix_pattern(TITLE_PARTICLES, 1), "$1")
        return F.when(F.length(stem) <= 1, w).otherwise(stem)

    stop = F.array(*[F.lit(w) for w in TITLE_STOPWORDS])
    keep = lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w) & ~w.rlike("^[0-9]+$")
    return F.array_distinct(F.filter(F.transform(words(normalize_title(title)), cut), keep))


def topic_tokens(title: Column) -> Column:
    """Distinct words of a title for topics: other characters part words; a particle is cut where two
    characters are left; no stopwords and single characters, but numbers."""
    plain = F.regexp_replace(F.regexp_replace(title, r"\[[^\]]*\]", ""), r"[^가-힣ㄱ-ㅎㅏ-ㅣa-zA-Z0-9 \t\n\r]", " ")
    stems = F.transform(words(F.lower(plain)), lambda w: F.regexp_replace(w, suffix_pattern(TOPIC_PARTICLES, 2), "$1"))
    stop = F.array(*[F.lit(w) for w in TOPIC_STOPWORDS])
    return F.array_distinct(F.filter(stems, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w)))


def hangul_tokens(title: Column, stopwords: tuple = BROADCAST_STOPWORDS) -> Column:
    """Distinct Hangul words of two characters or more, whole, without stopwords."""
    plain = F.regexp_replace(F.regexp_replace(title, r"\[[^\]]*\]", ""), r"[^가-힣 \t\n\r]", " ")
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.array_distinct(F.filter(words(plain), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w)))


def probe_title(title: Column) -> Column:
    """Lower case, without [...] parts, spaces, punctuation and symbols."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"\[[^\]]*\]", ""), r"[\s\p{P}\p{S}]+", "")


def normalize_keyword(keyword: Column) -> Column:
    """Letters and digits of any script and single spaces, lower case."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(keyword, r"[^\p{L}\p{N}\s]", "")), r"\s+", " "))


def rank_key(title: Column, artist: Column | None = None) -> Column:
    """A key by which charts are merged: lower case, no (...) parts, letters and digits only."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\([^)]*\)", ""), r"[^\p{L}\p{N}]", "")
    return clean(title) if artist is None else F.concat(clean(title), F.lit("||"), clean(artist))


def strip_html(text: Column) -> Column:
    """Without tags and control characters; the five common entities decoded."""
    plain = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


def xml_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def video_id(url: Column) -> Column:
    """The id in watch, short and embed addresses; else null."""
    found = [F.regexp_extract(url, p, 1) for p in (r"[?&]v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r"/(?:embed|shorts)/([A-Za-z0-9_-]{11})")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def fingerprint(ids: Column) -> Column:
    """md5 of the five least distinct ids."""
    return F.md5(F.concat_ws(",", F.transform(F.slice(F.array_sort(F.array_distinct(ids)), 1, 5), lambda x: x.cast("string"))).cast("binary"))


def ip_hash(ip: Column) -> Column:
    return F.substring(F.sha2(ip.cast("binary"), 256), 1, 16)


def traffic(text: Column) -> Column:
    """"20K+" -> 20000, "1.5M" -> 1500000, "1,200+" -> 1200; else 0."""
    n = F.regexp_extract(F.regexp_replace(text, ",", ""), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, r"[0-9]\s*([KkMm])", 1))
    return F.coalesce(n * F.when(unit == "K", 1000).when(unit == "M", 1_000_000).otherwise(1), F.lit(0.0))


def short_count(n: Column) -> Column:
    """12345 -> 12.3K, 1200000 -> 1.2M."""
    return (
        F.when(n >= 1_000_000, F.concat(F.call_function("format_number", n / 1_000_000, F.lit("0.0")), F.lit("M")))
        .when(n >= 1000, F.concat(F.call_function("format_number", n / 1000, F.lit("0.0")), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def parse_korean_date(text: Column, as_of: Column) -> Column:
    """A UTC timestamp from relative ("5분 전"), full, month-day or time-only Korean time; else null."""
    n = F.regexp_extract(text, r"([0-9]+)\s*(?:초|분|시간|일)\s*전", 1).try_cast("int")
    unit = F.regexp_extract(text, r"[0-9]+\s*(초|분|시간|일)\s*전", 1)
    seconds = n * F.when(unit == "초", 1).when(unit == "분", 60).when(unit == "시간", 3600).when(unit == "일", 86400)
    relative = F.timestamp_micros(F.unix_micros(as_of.cast("timestamp")) - seconds.cast("long") * 1_000_000)
    here = F.from_utc_timestamp(as_of.cast("timestamp"), "Asia/Seoul")
    clean = F.trim(F.regexp_replace(text, r"[./]", "-"))
    full = F.regexp_extract(clean, r"([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[ T]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?)", 1)
    full = F.coalesce(*[F.try_to_timestamp(full, F.lit(p)) for p in ("yyyy-M-d H:mm:ss", "yyyy-M-d H:mm", "yyyy-M-d")])
    month = F.try_to_timestamp(F.concat(F.year(here).cast("string"), F.lit("-"), F.regexp_extract(clean, r"^([0-9]{1,2}-[0-9]{1,2})(?:-|$| )", 1)), F.lit("yyyy-M-d"))
    clock = F.try_to_timestamp(F.concat(F.date_format(here, "yyyy-MM-dd "), F.regexp_extract(clean, r"^([0-9]{1,2}:[0-9]{2})$", 1)), F.lit("yyyy-MM-dd H:mm"))
    return F.coalesce(relative, F.to_utc_timestamp(F.coalesce(full, month, clock), "Asia/Seoul"))


MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def parse_feed_date(text: Column) -> Column:
    """A UTC timestamp from the usual feed dates; without a zone, Korean time; else null.

    Months may be names or numbers ("Sat, 11 04 2026 10:00:00 +0900"), dates dotted ("2024.10.29") or Korean
    ("2024년 10월 29일 오후 3:05:00", without a time midnight).
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\b(?:GMT|UTC|Z)$", "+0000"))
    month = F.regexp_extract(clean, r"^\d{1,2}\s+(\d{2})\s+\d{4}\s", 1).try_cast("int")
    named = F.regexp_replace(clean, r"^(\d{1,2})\s+\d{2}\s+(\d{4}\s)", "$1 # $2")
    clean = F.when(month.between(1, 12), F.replace(named, F.lit("#"), F.get(F.array(*[F.lit(m) for m in MONTHS]), month - 1))).otherwise(clean)
    zoned = [F.try_to_timestamp(clean, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssZ")]
    bare = F.regexp_replace(F.regexp_replace(clean, r"[./]", "-"), r"^(\d{4}-\d{2}-\d{2})T", "$1 ")
    local = [F.try_to_timestamp(bare, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")]
    day = F.regexp_extract(clean, r"^(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일", 0)
    clock = F.regexp_extract(clean, r"(\d{1,2}):(\d{2}):(\d{2})", 0)
    hour = F.coalesce(F.regexp_extract(clock, r"^(\d{1,2}):", 1).try_cast("int"), F.lit(0))
    hour = F.when(F.contains(clean, F.lit("오후")) & (hour < 12), hour + 12).when(F.contains(clean, F.lit("오전")) & (hour == 12), 0).otherwise(hour)
    rest = F.when(clock == "", ":00:00").otherwise(F.regexp_extract(clock, r"^\d{1,2}(:\d{2}:\d{2})$", 1))
    korean = F.when(day != "", F.try_to_timestamp(F.concat(F.regexp_replace(F.regexp_replace(day, r"\s", ""), "[년월]", "-"), F.lit(" "), hour.cast("string"), rest), F.lit("yyyy-M-d일 H:mm:ss")))
    return F.coalesce(*zoned, F.to_utc_timestamp(F.coalesce(*local, korean), "Asia/Seoul"))


def not_future(at: Column, as_of: Column, hours: int = 1) -> Column:
    """Null for times more than ``hours`` after ``as_of``."""
    return F.when(at <= as_of + F.expr(f"INTERVAL {hours} HOUR"), at)


def host_matches(url: Column, host: str) -> Column:
    """Whether the url's host, without www., is ``host`` or below it."""
    own = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return (own == host) | own.endswith(f".{host}")


def json_answer(text: Column) -> Column:
    """The JSON in a language model's answer, without byte order mark, code fences and outer array."""
    plain = F.trim(F.regexp_replace(text, r"^\x{FEFF}", ""))
    plain = F.trim(F.regexp_replace(plain, r"^```(?:json)?\s*|\s*```$", ""))
    return F.when(plain.startswith("["), F.get_json_object(plain, "$[0]")).otherwise(plain)
