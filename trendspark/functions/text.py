"""Text expressions: cleaning, normalising, signals, sections, masks and audits of answers."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Site phrases that are removed from texts, and words that are masked on output.
BOILERPLATE = (
    "본문 바로가기", "메뉴 바로가기", "마이페이지",
    "이웃추가", "구독하기", "공유하기", "URL복사", "신고하기",
    "찬반대결", "책갈피", "최신순", "추천순",
    "dc official App",
    "카페정보", "카페 프로필 이미지", "카페 가입하기", "카페 전체 메뉴",
    "검색이 허용된 게시물입니다", "게시글 본문내용", "검색 옵션 선택상자",
    "댓글내용선택됨", "서비스 약관/정책", "권리침해신고", "카페 고객센터", "검색비공개 요청",
    "카페 게시글", "목록 이전글 다음글", "다음검색", "옵션 더 보기", "댓글 작성자", "최신목록",
)
PROFANITY = (
    "씨발", "씨팔", "시발", "씨빨", "씨불", "씨바",
    "좆같", "좆까", "좆되", "좆망", "좆밥", "좇같", "좇까", "좆", "좇",
    "개새끼", "개새키", "개색끼",
    "씹새끼", "씹치", "씹할",
    "병신", "븅신",
    "니미", "니애미", "느금마", "애미터진", "애미뒤진", "애비뒤진",
    "남충", "여혐충", "여충", "한녀", "김치녀", "된장녀", "맘충", "이년", "저년", "이지랄",
    "창녀", "매춘부",
)
MASK = "[욕설]"
# The slur's contexts, thresholds, markers and patterns.
SLUR = r"""한남(?=말투|충|들|남|녀|[\s~.,!?"'()·]|$)"""
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
REPEAT_LIMIT = 3
MIN_CHARS = 30
SPAM_LIMIT = 3
EARLY_CHARS = 200
TILDES = "~〜﹏∼"
SECTION = "[[SECTION]] "
COMMENTS = "\n\n[댓글]\n"
URL = r"https?://[^\s\p{Z}]+|www\.[^\s\p{Z}]+"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
PHONE = r"(?:\+?82[-\s]?)?0[0-9]{1,2}[-\s]?[0-9]{3,4}[-\s]?[0-9]{4}"
#: All but Latin-1 and Hangul syllables, which are composed already; lower case folds them but for two letters.
FOLDED_BY_PYTHON = r"[^\x00-\xff가-힣]"
SPAM = (r"(?:[가-힣][/\-.]){2,}", "[⭐★☆✩✪◆◇▶►♠♣]", "대출|급전|신불자|연체자|사채|카톡|텔레그램|여기로")


@pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All HTML entities; Spark has no such function."""
    return texts.map(html.unescape, na_action="ignore")


@pandas_udf(StringType())
def nfc_fold(texts: pd.Series) -> pd.Series:
    """Unicode NFC and case folding; Spark has neither."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t).casefold(), na_action="ignore")


def fold(c: Column) -> Column:
    """Unicode NFC and case folding; only texts with letters that need Python go through it."""
    wide = F.octet_length(c) > F.length(c)
    small = _changed(F.lower(c), lambda x: F.octet_length(x) > F.length(x), lambda x: F.replace(F.replace(x, F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ")))
    return F.coalesce(nfc_fold(F.when(wide & F.rlike(c, F.lit(FOLDED_BY_PYTHON)), c)), small)


def _changed(c: Column, may: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """change(c) where may(c), which is cheaper; else c. c is computed once."""
    return F.get(F.transform(F.array(c), lambda x: F.when(may(x), change(x)).otherwise(x)), F.lit(0))


def _any_of(*parts: str) -> Callable[[Column], Column]:
    return lambda x: reduce(or_, (F.contains(x, F.lit(p)) for p in parts))


def unescape_common(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def unescape_all(c: Column) -> Column:
    """All HTML entities; only texts with others than the common ones go through Python."""
    other = F.contains(c, F.lit("&")) & F.rlike(c, F.lit(r"&(?!(?:nbsp|lt|gt|quot|#39|amp);)[A-Za-z#]"))
    return F.coalesce(unescape(F.when(other, c)), _changed(c, _any_of("&"), unescape_common))


def clean_text(c: Column, all_entities: bool = True) -> Column:
    """Entities, tags, links, addresses, phone numbers, repeats, site phrases and blanks, in this order; null is ''.

    all_entities=False stays with built-in functions and decodes the common entities only.
    """
    c = F.coalesce(c, F.lit(""))
    c = unescape_all(c) if all_entities else unescape_common(c)
    # each pattern is tried only where the text has what all its matches have
    c = F.replace(_changed(c, _any_of("<"), lambda x: F.regexp_replace(x, "<[^>]+>", " ")), F.lit("\xa0"), F.lit(" "))
    c = _changed(c, _any_of("://", "www."), lambda x: F.regexp_replace(x, URL, ""))
    c = _changed(c, _any_of("@"), lambda x: F.regexp_replace(x, EMAIL, "[EMAIL]"))
    c = _changed(c, _any_of("0"), lambda x: F.regexp_replace(x, PHONE, "[PHONE]"))
    c = F.regexp_replace(c, r"(.)\1{%d,}" % REPEAT_LIMIT, "$1" * REPEAT_LIMIT)
    without = lambda x, phrases: reduce(lambda y, p: F.replace(y, F.lit(p), F.lit(" ")), phrases, x)
    latin = [p for p in BOILERPLATE if p.isascii()]
    c = _changed(c, _any_of(*latin), lambda x: F.when(F.octet_length(x) == F.length(x), without(x, latin)).otherwise(x))
    # the others have Hangul, of which an ASCII text has none
    c = _changed(c, lambda x: (F.octet_length(x) > F.length(x)) & F.rlike(x, F.lit("[가-힣]|" + "|".join(latin))), lambda x: without(x, BOILERPLATE))
    c = _changed(c, _any_of("  ", "\t"), lambda x: F.regexp_replace(x, "[ \t]{2,}", " "))
    c = _changed(c, _any_of("\n\n\n"), lambda x: F.regexp_replace(x, "\n{3,}", "\n\n"))
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c")))
    return F.trim(F.array_join(lines, "\n"), F.lit(" \t\r\n\x0b\x0c"))


def normalize(c: Column, nfc: bool = True) -> Column:
    """For matching: NFC and case folding, no spaces, no decorative tildes; null is ''.

    nfc=False stays with built-in functions, for texts that are known to be composed.
    """
    c = F.coalesce(c, F.lit(""))
    c = fold(c) if nfc else F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    return F.translate(F.regexp_replace(c, r"[\s\p{Z}]+", ""), TILDES, "")


def normalize_gate(c: Column) -> Column:
    """The collection gate's normaliser, which also drops punctuation."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"""[\s~!?.,'"…]+""", ""))


def match_keyword(keyword: Column, title: Column, body: Column, nfc: bool = True) -> Column:
    """Struct (matched, position, count) of a keyword: in the title, early or late in the body, or none."""
    texts = F.struct(*[normalize(c, nfc).alias(n) for n, c in (("k", keyword), ("t", title), ("b", body))])

    def match(x: Column) -> Column:
        k, t, b = x["k"], x["t"], x["b"]
        times = lambda y: ((F.length(y) - F.length(F.replace(y, k, F.lit("")))) / F.greatest(F.length(k), F.lit(1))).cast("int")
        none = (k == "") | ~(F.contains(t, k) | F.contains(b, k))
        position = F.when(none, "none").when(F.contains(t, k), "title").when(F.position(k, b) - 1 < EARLY_CHARS, "early").otherwise("late")
        return F.struct((~none).alias("matched"), position.alias("position"), F.when(none, 0).otherwise(times(t) + times(b)).alias("count"))

    # through an array of one element, so that the normal forms are made once and not wherever they are used
    return F.get(F.transform(F.array(texts), match), F.lit(0))


def hangul_ratio(c: Column) -> Column:
    solid = F.length(F.regexp_replace(c, r"[\s\p{Z}]+", ""))
    return F.coalesce(F.when(solid > 0, F.regexp_count(c, F.lit("[가-힣]")) / solid), F.lit(0.0))


def spam_hits(c: Column) -> Column:
    return F.coalesce(sum((F.regexp_count(c, F.lit(p)) for p in SPAM), F.lit(0)), F.lit(0))


def boilerplate_hits(c: Column) -> Column:
    return F.coalesce(sum((F.contains(c, F.lit(p)).cast("int") for p in BOILERPLATE), F.lit(0)), F.lit(0))


def signals(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    return {"char_count": F.length(t), "hangul_ratio": F.round(hangul_ratio(t), 3), "spam_hits": spam_hits(t), "boilerplate_hits": boilerplate_hits(t)}


def violations(domestic: Column, min_hangul: float = 0.3) -> Column:
    """Names of the rules that a row of signals breaks."""
    return F.array_compact(F.array(
        F.when(F.col("char_count") < MIN_CHARS, "short"), F.when(F.col("match_position") == "none", "no_keyword"), F.when(F.col("spam_hits") >= SPAM_LIMIT, "spam"),
        F.when(domestic & (F.col("hangul_ratio") < min_hangul), "low_hangul"), F.when(F.col("match_position") == "late", "late_match"), F.when(F.col("boilerplate_hits") > 0, "boilerplate"),
    ))


def split_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (section_index, section_title, section_text) for each non-empty part; the part before the first marker has no title."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), r"\n\[\[SECTION\]\] ")
    blank = F.lit(" \t\r\n\x0b\x0c")
    out = docs.select("*", F.posexplode(parts).alias("section_index", "__part"))
    title = F.when(F.col("section_index") > 0, F.trim(F.substring_index("__part", "\n", 1), blank))
    rest = F.when(F.col("section_index") > 0, F.when(F.contains("__part", F.lit("\n")), F.regexp_replace("__part", r"^[^\n]*\n", "")).otherwise("")).otherwise(F.col("__part"))
    out = out.select(*docs.columns, "section_index", title.alias("section_title"), F.trim(rest, blank).alias("section_text"))
    return out.where("section_text <> ''")


def split_comments(docs: DataFrame, text: str = "text", marker: str = COMMENTS) -> DataFrame:
    """Rows (content_type, part): the body, and what follows the first comment marker."""
    t = F.coalesce(F.col(text), F.lit(""))
    at = F.instr(t, marker)
    body = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t)
    comment = F.when(at > 0, F.substring(t, at + len(marker), F.length(t)))
    parts = F.array_compact(F.array(F.struct(F.lit("body").alias("content_type"), body.alias("part")), F.when(at > 0, F.struct(F.lit("comment").alias("content_type"), comment.alias("part")))))
    return docs.select("*", F.inline(parts))


def search_query(keyword: Column, question: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.concat_ws(" ", blank(keyword), blank(question))


def encoding_text(title: Column, section: Column, text: Column) -> Column:
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.coalesce(title, F.lit("")), F.lit(" - "), section, F.lit("\n"), text)).otherwise(text)


def soften_profanity(c: Column, lookahead: bool = True) -> Column:
    """Mask known roots, longest first; null stays null. The slur that place names share is masked only where it stands alone."""
    roots = "|".join(sorted(PROFANITY, key=len, reverse=True))
    out = F.regexp_replace(c, roots, MASK)
    return F.regexp_replace(out, SLUR, MASK) if lookahead else out


CITATION = r"\[자료\s*(\d+)\]"


def cited(c: Column, pattern: str = CITATION) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), 1), lambda x: x.cast("int"))


def citation_warning(c: Column, n: Column, pattern: str = CITATION) -> Column:
    """Nothing cited, or a number outside 1..n."""
    ids = cited(c, pattern)
    return (F.size(ids) == 0) | F.exists(ids, lambda i: (i < 1) | (i > n))


def link_citations(c: Column, n: Column) -> Column:
    """Valid numbers become anchors, others a notice; null stays null."""
    parts, ids = F.split(c, r"\[자료\s*\d+\]", -1), cited(c)
    links = F.transform(ids, lambda i: F.when((i >= 1) & (i <= n), F.concat(F.lit("[자료 "), i.cast("string"), F.lit("](#source-"), i.cast("string"), F.lit(")"))).otherwise("[출처 확인 필요]"))
    return F.array_join(F.transform(parts, lambda p, k: F.concat(p, F.coalesce(F.get(links, k), F.lit("")))), "")


# Headings of an answer and ends of its sentences.
TREND_HEAD = r"(?m)^(?:#{1,6}[ \t]*)?(?:\*\*)?5[.)][ \t]*(?:\*\*)?트렌드[ \t]*맥락(?:\*\*)?[ \t]*[:：]?[ \t]*(?:\n|$)?"
SECTION_HEAD = r"(?m)^(?:#{1,6}\s*)?(?:\*\*)?([1-4])[.)]\s*(?:\*\*)?(?:의미|유행\s*이유|사용법|확인된\s*사용\s*맥락)(?:\*\*)?\s*[:：]?[ \t]*\n?"
SENTENCE_END = r"""[.!?다요죠음함됨임][ \n\t*`"'’”)\]]*$"""
# Of the last characters of a part, one that neither may follow a sentence's end nor be left of a citation: what is before it doesn't matter.
DECIDES = r"""[^\s\d자료*`"'’”)\[\]\x{85}\x{2028}\x{2029}]"""
LAST = 256
SECTION_NAMES = ["의미", "유행 이유", "사용법", "확인된 사용 맥락"]
TREND_NAME = "트렌드 맥락"


def _answer_parts(c: Column) -> tuple[Column, Column, Column]:
    """Numbers of the headings, the texts below them, and the trend part (null without one)."""
    parts = F.split(F.coalesce(c, F.lit("")), TREND_HEAD, 2)
    body = F.trim(F.get(parts, F.lit(0)), F.lit(" \n\t"))
    return F.regexp_extract_all(body, F.lit(SECTION_HEAD), 1), F.slice(F.split(body, SECTION_HEAD, -1), 2, 4), F.get(parts, F.lit(1))


def whole_sentence(t: Column) -> Column:
    """Whether a text without its citations ends like a sentence; told from its last characters, where these decide it."""
    bare = lambda x: F.regexp_replace(x, CITATION, "")
    ends = lambda x: F.rlike(x, F.lit(SENTENCE_END))
    last = bare(F.right(t, F.lit(LAST)))
    return F.when(ends(last), True).when(F.rlike(last, F.lit(DECIDES)), False).otherwise(ends(bare(t)))


def audit_answer(c: Column) -> Column:
    """'ok', or why an answer is incomplete: its four headings in order, and each part's end."""
    heads, texts, extra = _answer_parts(c)
    return F.when(F.concat_ws(",", heads) != "1,2,3,4", "headings").when(~F.forall(texts, whole_sentence), "cut_off").when(extra.isNotNull() & ~whole_sentence(extra), "trend_cut_off").otherwise("ok")


def unify_headings(c: Column) -> Column:
    """An answer that passes the audit, with its parts trimmed under headings of one form; null for others."""
    _, texts, extra = _answer_parts(c)
    below = lambda number, name, t: F.concat(F.lit("### "), number.cast("string"), F.lit(". "), name, F.lit("\n\n"), F.trim(t, F.lit(" \t\r\n\x0b\x0c")))
    names = F.array(*map(F.lit, SECTION_NAMES))
    sections = F.transform(texts, lambda t, i: below(i + 1, F.get(names, i), t))
    trend = F.array_compact(F.array(below(F.lit(5), F.lit(TREND_NAME), extra)))
    return F.when(audit_answer(c) == "ok", F.array_join(F.concat(sections, trend), "\n\n"))


def audit_trend_claims(text: Column, date: Column, status: Column, scores: Column) -> Column:
    """'ok' or the mismatch: the trend part names the date and status, and its z values are scores to their printed decimals."""
    part = F.replace(F.get(F.split(F.coalesce(text, F.lit("")), TREND_HEAD, 2), F.lit(1)), F.lit("**"), F.lit(""))
    day = F.concat_ws("-", F.year(date).cast("string"), F.month(date).cast("string"), F.dayofmonth(date).cast("string"))
    found = F.transform(
        F.regexp_extract_all(part, F.lit(r"(\d{4}\s*(?:[-./]|년)\s*\d{1,2}\s*(?:[-./]|월)\s*\d{1,2})"), 1),
        lambda x: F.array_join(F.transform(F.split(x, r"\D+"), lambda n: n.cast("int").cast("string")), "-"),
    )
    values = F.regexp_extract_all(part, F.lit(r"(?i)(?<![A-Za-z])z(?:[-_ ]*score|값|점수)?\s*[:=]?\s*([+-]?\d+(?:\.\d+)?)"), 1)
    decimals = lambda v: F.when(F.contains(v, F.lit(".")), F.length(F.substring_index(v, ".", -1))).otherwise(0)
    near = F.forall(values, lambda v: F.exists(scores, lambda s: F.abs(v.cast("double") - s) <= 0.5 * F.pow(F.lit(10.0), -decimals(v)) + 1e-8))
    return (
        F.when(part.isNull() | (F.trim(part) == ""), "missing").when(~F.array_contains(found, day), "date").when(~F.contains(part, status), "status").when(~near, "score").otherwise("ok")
    )


def parse_grade(c: Column, labels: tuple[str, str, str] = ("점수", "인용", "이유")) -> Column:
    """Struct (score, quote, reason) of a judge's answer: its labelled lines, else the first digit 0 to 2, else null."""
    c = F.coalesce(c, F.lit(""))
    get = lambda label, what: F.regexp_extract(c, label + r"\s*:\s*" + what, 1)
    score, any_digit = get(labels[0], "([012])"), F.regexp_extract(c, "([012])", 1)
    told = score != ""
    text = lambda label: F.when(told, F.trim(get(label, "(.+)"))).otherwise("")
    out = F.struct(F.when(told, score).otherwise(any_digit).cast("int").alias("score"), text(labels[1]).alias("quote"), text(labels[2]).alias("reason"))
    return F.when(told | (any_digit != ""), out)
