"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markup rules, in the order in which they apply. Commands of the third rule go with their argument.
MARKUP = (
    (r"\\\$", " "),
    (r"(?s)\\begin\s*\{([^{}]*)\}.*?\\end\s*\{\1\}", " "),
    (r"(?i)\\(?:cite[a-zA-Z]*|ref|eqref|label|url|href|includegraphics|bibliography|footnote|autoref|pageref|nocite)\s*(?:\[[^\]]*\])?\s*\{[^{}]*\}", " "),
    (r"(?s)\$\$.*?\$\$|\$[^$]*?\$|\\\(.*?\\\)|\\\[.*?\\\]", " "),
)
# Any other command leaves its argument, three levels deep; then bare commands, braces and spaces.
UNWRAP, LEVELS = r"\\[a-zA-Z@]+\s*(?:\[[^\]]*\])?\s*\{([^{}]*)\}", 3
AFTER = ((r"\\[a-zA-Z@]+\*?|\\\\|\\[^a-zA-Z\s]", " "), (r"[{}]", " "), (r"(?U)\s+", " "))

# British endings of words and their American forms, in order.
SPELLINGS = (
    ("isation", "ization"), ("isating", "izating"), ("ised", "ized"), ("ising", "izing"), ("iser", "izer"), ("ise", "ize"), ("yse", "yze"), ("ysed", "yzed"), ("our", "or"), ("ours", "ors"),
    ("centre", "center"), ("metre", "meter"), ("modelling", "modeling"), ("modelled", "modeled"), ("labelling", "labeling"), ("labelled", "labeled"),
)

#: Function words; a parameter wherever they are used.
STOPWORDS = frozenset(
    """a about above after again against all almost also although always am among an and another any are as at back be became because been before being below between both but by can cannot
    could did do does doing done down during each either else ever every few for from further had has have having he her here hers him his how however i if in into is it its itself just
    last least less made make many may me might mine more most much must my myself neither never no nor not now of off often on once one only onto or other others our ours out over own per
    perhaps quite rather same several she should since so some still such than that the their them then there therefore these they this those though through thus to together too toward
    towards under unless until up upon us used using various very via was we well were what when where whether which while who whom whose why will with within without would yet you your""".split()
)


def squeeze(text: Column) -> Column:
    """Unicode white space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_markup(text: Column) -> Column:
    for pattern, to in MARKUP:
        text = F.regexp_replace(text, pattern, to)
    for _ in range(LEVELS):
        text = F.regexp_replace(text, UNWRAP, " $1 ")
    for pattern, to in AFTER:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def paper_text(title: Column, abstract: Column) -> Column:
    """Title without trailing dots and spaces, a full stop, and the abstract; either alone if the other is empty."""
    head, body = F.regexp_replace(F.coalesce(title, F.lit("")), r"[ .]+$", ""), F.coalesce(abstract, F.lit(""))
    return F.when(head == "", body).when(body == "", head).otherwise(F.concat(head, F.lit(". "), body))


def author_key(name: Column) -> Column:
    return F.lower(squeeze(name))


def first_date(created: Column) -> Column:
    """Day of an RFC-2822 date as written; null where there is none."""
    return F.try_to_date(F.regexp_extract(created, r"([0-9]{1,2} [A-Za-z]{3} [0-9]{4})", 1), "d MMM yyyy")


HYPHENS, JOINS = "‐‑‒–—−", 30


def tokens(text: Column) -> Column:
    """Lower-case words (with up to JOINS inner hyphens and apostrophes) and numbers, and each other sign as a token of its own.

    Repetitions of a group are bounded, as Java's engine recurses over them and would run out of stack on long junk.
    """
    part = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
    return F.regexp_extract_all(F.lower(F.translate(text, HYPHENS, "-" * len(HYPHENS))), F.lit(rf"{part}(?:[-'’]{part}){{0,{JOINS}}}|[^\p{{L}}\p{{N}}\p{{M}}\p{{Z}}\p{{C}}]"), F.lit(0))


def lemma(token: Column, stop: frozenset[str] = STOPWORDS) -> Column:
    """The token without the ending of a plural or a third person; function words and short words as they are."""
    size = F.length(token)
    return (
        F.when(token.isin(*sorted(stop)) | (size < 4) | ~token.endswith("s") | token.rlike("(ss|us|is|'s|’s)$"), token)
        .when((size > 4) & token.endswith("ies"), F.concat(F.left(token, size - 3), F.lit("y")))
        .when((size > 4) & token.rlike("(sses|xes|zes|ches|shes)$"), F.left(token, size - 2))
        .otherwise(F.left(token, size - 1))
    )


def barred(words: Column) -> Column:
    """The words with null in the place of what ends a segment: tokens without a letter or digit."""
    return F.transform(words, lambda w: F.when(w.rlike(r"[\p{L}\p{N}]"), w))


def grams(words: Column, n: int) -> Column:
    """All n-grams of an array, joined by a space; null for those that hold a null. None for shorter arrays."""
    if n == 1:
        return words
    at = lambda i: F.concat(*[x for k in range(n) for x in ([F.lit(" ")] if k else []) + [F.element_at(words, i + k)]])
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), at)).otherwise(F.array().cast("array<string>"))


def n_tokens(cand: Column) -> Column:
    return F.length(cand) - F.length(F.replace(cand, F.lit(" "))) + 1


def contains(a: Column, b: Column) -> Column:
    """One of the two names holds the other, whole tokens only."""
    wide = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return (F.instr(wide(a), wide(b)) > 0) | (F.instr(wide(b), wide(a)) > 0)


def normal_form(cand: Column) -> Column:
    """Without hyphens and spaces, American spelling."""
    out = F.regexp_replace(cand, r"[- ]", "")
    for british, american in SPELLINGS:
        out = F.regexp_replace(out, british + r"\b", american)
    return out


def singular(cand: Column) -> Column:
    """The last token without its plural ending; null where there is none."""
    last = F.regexp_extract(cand, r"([^ ]+)$", 1)
    head = F.substring(cand, F.lit(1), F.length(cand) - F.length(last))
    stem = (
        F.when(F.length(last) < 4, None)
        .when(last.endswith("ies"), F.concat(F.regexp_replace(last, "ies$", ""), F.lit("y")))
        .when(last.rlike("(ses|xes|zes|ches|shes)$"), F.regexp_replace(last, "es$", ""))
        .when(last.endswith("s") & ~last.rlike("(ss|us|is)$"), F.regexp_replace(last, "s$", ""))
    )
    return F.when(stem.isNotNull(), F.concat(head, stem))
