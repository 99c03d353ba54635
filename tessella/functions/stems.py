"""English stems by the published Snowball rules (the second Porter stemmer), as a Column expression.

The expression is meant for vocabularies: apply it to distinct words and join their stems. `sql_steps` states the same rules for
DuckDB, from the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import once

# Fixed values of the published rules.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
REGION = "^(?:gener|commun|arsen|.*?[aeiouy][^aeiouy])"
REGION_AGAIN = "^.*?[aeiouy][^aeiouy]"
SHORT_SYLLABLE = "(?:^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$)"
DOUBLE = "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

# The words that English full text search leaves out.
STOP = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
    "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both",
    "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just",
    "don", "should", "now",
)


def _ending(suffixes) -> str:
    return "(" + "|".join(sorted(suffixes, key=lambda s: (-len(s), s))) + ")$"


def _cut(w: Column, n) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _base(w: Column, suffix: Column) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - F.length(suffix))


def _mapped(suffix: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), suffix)


def _plurals(w: Column) -> Column:
    return (
        F.when(w.endswith("sses"), _cut(w, 2))
        .when(w.rlike("ie[ds]$"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
        .when(w.rlike("[us]s$"), w)
        .when(w.rlike("[aeiouy].+s$"), _cut(w, 1))
        .otherwise(w)
    )


def _participles(w: Column, r1: Column) -> Column:
    def ended(suffix: Column) -> Column:
        def rest(base: Column) -> Column:
            short = (F.length(base) <= r1) & base.rlike(SHORT_SYLLABLE)
            out = F.when(base.rlike("(?:at|bl|iz)$"), F.concat(base, F.lit("e"))).when(base.rlike(DOUBLE), _cut(base, 1)).when(short, F.concat(base, F.lit("e"))).otherwise(base)
            agreed = F.when(F.length(base) >= r1, F.concat(base, F.lit("ee"))).otherwise(w)
            return F.when(suffix == "", w).when(suffix.startswith("eed"), agreed).when(base.rlike("[aeiouy]"), out).otherwise(w)

        return once(_base(w, suffix), rest)

    return once(F.regexp_extract(w, _ending(("eed", "eedly", "ed", "edly", "ing", "ingly")), 1), ended)


def _replaced(w: Column, table: dict[str, str], allowed) -> Column:
    """w with its longest suffix in the table replaced where allowed(suffix, length of what is before it)."""

    def ended(suffix: Column) -> Column:
        base = _base(w, suffix)
        return F.when((suffix != "") & allowed(suffix, F.length(base)), F.concat(base, _mapped(suffix, table))).otherwise(w)

    return once(F.regexp_extract(w, _ending(table), 1), ended)


def _last(w: Column, r1: Column, r2: Column) -> Column:
    base = _cut(w, 1)
    e = w.endswith("e") & ((F.length(base) >= r2) | (F.length(base) >= r1) & ~base.rlike(SHORT_SYLLABLE))
    return F.when(e | w.endswith("ll") & (F.length(base) >= r2), base).otherwise(w)


def stem(c: Column) -> Column:
    """The stem of a word in lower case. Words of one or two letters are their own stems; null stays null."""

    def regions(w: Column) -> Column:
        r1 = F.when(w.rlike(REGION), F.length(F.regexp_extract(w, REGION, 0))).otherwise(F.length(w))

        def second(first: Column) -> Column:
            rest = F.substring(w, first + 1, F.length(w))
            return F.struct(w.alias("w"), first.alias("r1"), F.when(rest.rlike(REGION_AGAIN), first + F.length(F.regexp_extract(rest, REGION_AGAIN, 0))).otherwise(F.length(w)).alias("r2"))

        return once(r1, second)

    def steps(s: Column) -> Column:
        r1, r2 = s["r1"], s["r2"]

        def allowed_2(w: Column):
            return lambda suffix, n: (n >= r1) & F.when(suffix == "ogi", w.endswith("logi")).when(suffix == "li", w.rlike("[cdeghkmnrt]li$")).otherwise(True)

        def allowed_4(w: Column):
            return lambda suffix, n: (n >= r2) & ((suffix != "ion") | w.rlike("[st]ion$"))

        allowed_3 = lambda suffix, n: (n >= r1) & ((suffix != "ative") | (n >= r2))
        chain = [
            lambda w: _participles(w, r1),
            lambda w: F.when(w.rlike(".[^aeiouy][yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w),
            lambda w: _replaced(w, STEP_2, allowed_2(w)),
            lambda w: _replaced(w, STEP_3, allowed_3),
            lambda w: _replaced(w, dict.fromkeys(STEP_4, ""), allowed_4(w)),
            lambda w: _last(w, r1, r2),
        ]

        def rest(w: Column) -> Column:
            out = w
            for step in chain:
                out = once(out, step)
            return F.when(w.isin(*KEPT_AFTER_PLURALS), w).otherwise(out)

        return F.lower(once(_plurals(F.regexp_replace(s["w"], "('s'|'s|')$", "")), rest))

    def marked(w: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "^'", ""), "^y", "Y"), "([aeiouy])y", "$1Y")
        return F.when(F.length(w) <= 2, w).when(w.isin(*EXCEPTIONS), _mapped(w, EXCEPTIONS)).otherwise(once(once(plain, regions), steps))

    return once(c, marked)


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def sql_steps(words: str) -> str:
    """DuckDB's common table expressions that end in stems (word, stem) for the distinct words of a table with a column word."""

    def replaced(name: str, source: str, table: dict[str, str], allowed: str) -> str:
        return f"""{name} AS (SELECT word, r1, r2, kept, CASE WHEN x <> '' AND {allowed} THEN left(w, n) || {_case("x", table)} ELSE w END AS w
          FROM (SELECT *, length(w) - length(x) AS n FROM (SELECT *, regexp_extract(w, '{_ending(table)}', 1) AS x FROM {source})))"""

    def region(c: str, p: str) -> str:
        return f"CASE WHEN regexp_matches({c}, '{p}') THEN length(regexp_extract({c}, '{p}', 0)) ELSE length({c}) END"

    last = f"right(w, 1) = 'e' AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT regexp_matches(left(w, length(w) - 1), '{SHORT_SYLLABLE}')) OR right(w, 2) = 'll' AND length(w) - 1 >= r2"
    return f"""
    z0 AS (SELECT DISTINCT word, regexp_replace(regexp_replace(regexp_replace(word, '^''', ''), '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {words}),
    z1 AS (SELECT *, {region("w", REGION)} AS r1 FROM z0),
    z2 AS (SELECT *, r1 + {region("substr(w, r1 + 1)", REGION_AGAIN)} AS r2 FROM z1),
    z3 AS (SELECT word, r1, r2, regexp_replace(w, '(''s''|''s|'')$', '') AS w FROM z2),
    z4 AS (SELECT word, r1, r2, CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
      WHEN regexp_matches(w, '[us]s$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM z3),
    z5 AS (SELECT *, CASE WHEN w IN ({", ".join(f"'{k}'" for k in KEPT_AFTER_PLURALS)}) THEN w END AS kept, regexp_extract(w, '{_ending(("eed", "eedly", "ed", "edly", "ing", "ingly"))}', 1) AS x FROM z4),
    z6 AS (SELECT *, left(w, length(w) - length(x)) AS b FROM z5),
    z7 AS (SELECT word, r1, r2, kept, CASE WHEN x = '' THEN w WHEN starts_with(x, 'eed') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END WHEN NOT regexp_matches(b, '[aeiouy]') THEN w
      WHEN regexp_matches(b, '(?:at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '{DOUBLE}') THEN left(b, length(b) - 1) WHEN length(b) <= r1 AND regexp_matches(b, '{SHORT_SYLLABLE}') THEN b || 'e' ELSE b END AS w FROM z6),
    z8 AS (SELECT word, r1, r2, kept, CASE WHEN regexp_matches(w, '.[^aeiouy][yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM z7),
    {replaced("z9", "z8", STEP_2, "n >= r1 AND CASE x WHEN 'ogi' THEN w LIKE '%logi' WHEN 'li' THEN regexp_matches(w, '[cdeghkmnrt]li$') ELSE true END")},
    {replaced("z10", "z9", STEP_3, "n >= r1 AND (x <> 'ative' OR n >= r2)")},
    {replaced("z11", "z10", dict.fromkeys(STEP_4, ""), "n >= r2 AND (x <> 'ion' OR regexp_matches(w, '[st]ion$'))")},
    stems AS (SELECT word, CASE WHEN length(word) <= 2 THEN word WHEN word IN ({", ".join(f"'{k}'" for k in EXCEPTIONS)}) THEN {_case("word", EXCEPTIONS)}
      ELSE lower(coalesce(kept, CASE WHEN {last} THEN left(w, length(w) - 1) ELSE w END)) END AS stem FROM z11)"""
