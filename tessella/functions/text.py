"""Text as Column expressions: tokens, years, questions, excerpts, paragraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"

# What questions ask for, by words.
TEMPORAL = r"(?i)(哪一年|哪年|哪些年|几年|最早|首次|第一次|历年|变化|when did|what year|which year|first mention|earliest|latest|over\s+time)"
MENTION = r"(?i)(提到|提及|有没有说过|mention|mentioned|mentioning)"
COMPARE = r"(?i)(比较|对比|区别|vs\.?|versus|相比|compared?\s+to)"
METHOD = r"(?i)(怎么看|看法|认为|原则|方法|如何|怎么做|approach|philosophy|principle|framework|why)"
EARLIEST, LATEST, EVOLUTION = r"(?i)(最早|首次|第一次|earliest|first)", r"(?i)(最近|最新|latest|most recent)", r"(?i)(变化|演变|历年|evolution|over\s+time)"

CHAT_START, CHAT = r"(?i)^(你好|嗨|哈喽|在吗|谢谢|hello|hi)", r"(?i)(你好吗|讲个笑话|早上好|晚上好)"

# Topics and the keywords they stand for; tokens that are none.
TOPICS = (
    (("回购", "buyback", "repurchase"), ("share repurchases", "repurchase", "buyback", "回购")),
    (("护城河", "moat"), ("moat", "护城河")),
    (("浮存金", "float"), ("insurance float", "float", "浮存金")),
    (("盖可", "geico"), ("geico", "盖可", "insurance")),
)
NO_KEYWORDS = ("变化", "怎么", "怎么看")

# Starts of lines before a text's body.
HEADER_LINES = ("原文信息", "- 标题", "- 作者", "- 发表", "- 链接", "- 中文", "- 整理", "- 修订", "- 校译", "- 校对", "[^")

# Words that do not have to be in a hit.
STOP_WORDS = (
    "the", "and", "for", "with", "what", "when", "which", "who", "whom", "where", "why", "how", "did", "does", "have", "has", "about", "into", "from", "that", "this",
    "your", "you", "will", "were", "been", "over", "time", "first", "earliest", "latest", "mention", "mentioned",
)

# Names and topics that a question's words stand for.
GLOSSARY = ((r"前进保险|前进公司", "Progressive Corporation"), (r"伯克希尔", "Berkshire Hathaway"))
ANCHORS = (
    (r"(?i)能力圈|circle of competence", "circle of competence"),
    (r"(?i)护城河|moat", "economic moat"),
    (r"(?i)择时|market timing", "market timing"),
    (r"(?i)科技公司|technology company|tech company|tech stock", "technology companies investment"),
    (r"(?i)苹果|apple", "Apple AAPL"),
    (r"(?i)可口可乐|coca[\s-]?cola", "Coca-Cola"),
    (r"(?i)继任|接班|succession", "succession"),
    (r"(?i)浮存金|insurance float|float", "insurance float"),
)


def ascii_tokens(c: Column) -> Column:
    """Distinct Latin tokens of two characters at least, in order, without stop words."""
    raw = F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z0-9.&'-]*"), F.lit(0))
    trimmed = F.transform(raw, lambda w: F.regexp_replace(w, r"[^A-Za-z0-9]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*STOP_WORDS)))


def strict_tokens(keywords: Column, question: Column, most: int = 8) -> Column:
    """Tokens that a hit has to have: those of the first alternative, and the question's that are long or in capitals."""
    first = ascii_tokens(F.trim(F.split_part(keywords, F.lit("|"), F.lit(1))))
    own = F.filter(ascii_tokens(question), lambda w: (F.upper(w) == w) | (F.length(w) >= 4))
    return F.slice(F.array_distinct(F.concat(first, own)), 1, most)


def words(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits of three characters at least."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) >= 3)


def has_token(c: Column, token: str) -> Column:
    """Whether a token stands in a text, case aside: an ASCII one as a word, which Chinese characters beside it do not
    hide; any other anywhere."""
    if token.replace("-", "").replace("_", "").isalnum() and token.isascii():
        return c.rlike(rf"(?i)(?<![A-Za-z0-9_]){token}(?![A-Za-z0-9_])")
    return F.lower(c).contains(token.lower())


def has_all(c: Column, tokens: list[str]) -> Column:
    out = F.lit(True)
    for t in tokens:
        out = out & has_token(c, t)
    return out


def year_range(c: Column) -> Column:
    """struct<year_from, year_to>: the smallest and largest year 1900 to 2099 in a text, wherever its digits stand."""
    years = F.transform(F.regexp_extract_all(c, F.lit(r"(?:19|20)\d{2}"), F.lit(0)), lambda y: y.cast("int"))
    return F.struct(F.array_min(years).alias("year_from"), F.array_max(years).alias("year_to"))


def temporal_mode(c: Column, year_from: Column, year_to: Column) -> Column:
    both = year_from.isNotNull() & year_to.isNotNull()
    return F.when(c.rlike(EARLIEST), "earliest").when(c.rlike(LATEST), "latest").when(c.rlike(EVOLUTION), "evolution").when(both & (year_from != year_to), "range").when(both, "point").otherwise("none")


def glossary(c: Column) -> Column:
    for pattern, name in GLOSSARY:
        c = F.regexp_replace(c, pattern, name)
    return c


def anchored(keywords: Column, question: Column) -> Column:
    """Anchors that the question's words stand for and the keywords lack, before the keywords, as alternatives."""
    found = [F.when(question.rlike(p) & ~F.lower(keywords).contains(a.lower()), F.lit(a)) for p, a in ANCHORS]
    return F.concat_ws(" | ", *found, F.trim(keywords))


def clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.trim(F.substring(c, 1, n)), F.lit("…"))).otherwise(c)


def once(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it: it is an element that a transform sees."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def excerpt(query: str, c: Column) -> Column:
    """The sentence of more than 20 characters that shares most with the query for its length, the first of equal ones,
    cut to 220 characters; the text's start without such sentences."""
    own = sorted({w for w in "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in query.lower()).split() if len(w) >= 3})
    text = F.trim(c)
    start = F.concat(F.trim(F.substring(text, 1, 180)), F.when(F.length(text) > 180, "…").otherwise(""))
    if not own:
        return start
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda s: F.length(s) > 20)
    worded = F.transform(sentences, lambda s, i: F.struct(words(s).alias("w"), (-i).alias("i"), s.alias("s")))

    def scored(x: Column) -> Column:
        share = F.size(F.filter(x["w"], lambda w: w.isin(own))) / F.sqrt(F.size(x["w"]).cast("double"))
        return F.struct(F.when(F.size(x["w"]) > 0, F.round(share, 9)).otherwise(-1.0).alias("score"), x["i"].alias("i"), x["s"].alias("s"))

    best = F.array_max(F.transform(worded, scored))["s"]
    return F.coalesce(once(best, lambda b: clip(b, 220)), start)


def first_line(c: Column) -> Column:
    """The first line of more than eight characters, cut to 140; the whole without one."""
    text = F.trim(c)
    lines = F.filter(F.transform(F.split(text, r"\n+"), lambda x: F.trim(x)), lambda s: F.length(s) > 8)
    return clip(F.coalesce(F.get(lines, F.lit(0)), text), 140)


def is_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def heading_parts(c: Column) -> Column:
    """struct<en, zh>: a heading cut at its first Chinese character."""
    at = F.regexp_instr(c, F.lit(CJK))
    en = F.trim(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c))
    zh = F.when(at > 0, F.trim(F.substring(c, at, F.length(c))))
    return F.struct(F.nullif(en, F.lit("")).alias("en"), zh.alias("zh"))


def is_table(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n"), lambda line: line.contains("|"))) > 1


# Lines of letters that are no paragraphs.
_SKIPPED = (r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", r"^\d{4}年\d{1,2}月\d{1,2}日$", r"(?i)^Warren E\.? Buffett", r"^Chairman\b", r"^Cordially[,，]?$")


def is_skippable(c: Column) -> Column:
    """Dates, signatures and letterheads in capitals."""
    t = F.trim(c)
    capitals = ~is_cjk(t) & (t == F.upper(t)) & t.rlike("[A-Z]{2}") & ~t.contains("|")
    out = capitals
    for p in _SKIPPED:
        out = out | t.rlike(p)
    return out


def question_classes(c: Column) -> dict[str, Column]:
    """What a question asks for, by name: temporal, mention, compare, method, chat."""
    short = F.trim(c)
    chat = ((F.length(short) <= 12) & short.rlike(CHAT_START)) | short.rlike(CHAT)
    return {"temporal": c.rlike(TEMPORAL), "mention": c.rlike(MENTION), "compare": c.rlike(COMPARE), "method": c.rlike(METHOD), "chat": chat}


def intent(task: Column, timeline: Column, compare: Column) -> tuple[Column, Column]:
    """Intent and answer mode of a plan."""
    what = F.when(compare, "compare").when(timeline, "timeline").when(task == "method", "opinion").otherwise("fact")
    return what, F.when(compare, "compare").when(timeline, "timeline").otherwise("concise")


def question_keywords(c: Column, most: int = 8) -> Column:
    """The keywords of the topics that a question names, else its tokens of two characters at least that are no years."""
    low = F.lower(c)
    none = F.array().cast("array<string>")
    topics = F.array_distinct(F.concat(*(F.when(reduce(lambda x, y: x | y, (low.contains(w) for w in names)), F.array(*map(F.lit, kept))).otherwise(none) for names, kept in TOPICS)))
    tokens = F.transform(F.split(low, r"[\s，。！？、,.!?]+"), lambda x: F.trim(x))
    tokens = F.array_distinct(F.filter(tokens, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^(19|20)[0-9]{2}$") & ~w.isin(*NO_KEYWORDS)))
    return F.slice(F.when(F.size(topics) > 0, topics).otherwise(tokens), 1, most)


def primary_term(keywords: Column) -> Column:
    """What stands before the first alternative of keywords."""
    return F.trim(F.split_part(keywords, F.lit("|"), F.lit(1)))


def strip(c: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_header(c: Column, within: int = 30) -> Column:
    """A text after the last of its first lines that is blank or names where it comes from."""
    lines = F.split(c, "\n")

    def heads(line: Column, i: Column) -> Column:
        t = strip(line)
        found = (t == "") | ((t == "---") & (i < 20))
        for start in HEADER_LINES:
            found = found | t.startswith(start)
        return F.when(found & (i < within), i).otherwise(0)

    last = F.array_max(F.transform(lines, heads))
    return strip(F.array_join(F.slice(lines, last + 2, F.size(lines)), "\n"))


WIDE = r"[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]+"


def only_language(c: Column, chinese: bool) -> Column:
    """The lines of a text in one of two languages, told by Chinese characters: a table goes with its first line, a heading
    keeps its part in that language, blank lines stay. The text itself where nothing Chinese is found."""
    none = F.array().cast("array<string>")
    mine = (lambda x: is_cjk(x)) if chinese else (lambda x: ~is_cjk(x))

    def heading(t: Column) -> Column:
        if not chinese:
            return strip(F.regexp_replace(t, WIDE, ""))
        zh = F.regexp_extract(t, r"([\x{4e00}-\x{9fff}][\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}\s·\-—]+)", 1)
        return F.when(zh != "", F.concat_ws(" ", F.regexp_extract(t, "^#+", 0), strip(zh))).otherwise(t)

    def step(s: Column, line: Column) -> Column:
        t = strip(line)
        table = t.startswith("|") | t.rlike(r"^---[\s|:]+")
        target = F.when(s["inside"], s["target"]).otherwise(mine(t))
        kept = F.when(table, F.when(target, line)).when(t == "", line).when(t.startswith("#"), heading(t)).when(mine(t), line)
        lines = F.when(kept.isNull(), s["lines"]).otherwise(F.array_append(s["lines"], kept))
        return F.struct(table.alias("inside"), (table & target).alias("target"), lines.alias("lines"))

    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("target"), none.alias("lines"))
    joined = F.array_join(F.aggregate(F.split(c, "\n"), start, step)["lines"], "\n")
    out = strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))
    return once(out, lambda x: F.when(x == "", c).otherwise(x)) if chinese else out


def first_match(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first pattern, in the rules' order, that a text matches; null without any."""
    return F.coalesce(*(F.when(c.rlike(pattern), F.lit(value)) for pattern, value in rules))
