"""Text functions as column expressions: they run in the JVM and fuse with the scan.

Every function takes and returns columns; null in, null out unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------
#: What counts as white space beyond ASCII, for regex classes that RE2 and Java read alike.
SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD_CHAR = r"\p{L}\p{N}_"
#: The same for tokens, in Java's terms: one property lookup per character instead of a dozen ranges.
TOKEN = r"(?U)[^\s\x1C-\x1F]+"
#: A run of ASCII letters and apostrophes between word boundaries that don't count combining marks as word characters.
ASCII_WORD = rf"(?:(?<![{WORD_CHAR}])(?=[a-z])|(?<=[{WORD_CHAR}])(?='))[a-z']+(?:(?<=[a-z])(?![{WORD_CHAR}])|(?<=')(?=[{WORD_CHAR}]))"
INVISIBLE = "​‌‍⁠﻿­᠎"
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " "}
ENGLISH_STOPWORDS = ["the", "and", "of", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "this", "are", "from", "at", "or", "an", "have", "not"]
CONFUSABLE_FROM = "авсенкморѕтхуіјԁѡցАВСЕНКМОРЅТХУІЈԀѠГЬЯФαονρτυχικμεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
CONFUSABLE_TO = "abcehkmopstxyijdwgABCEHKMOPSTXYIJDWrbRO" + "aovptuxikueABEZHIKMNOPTYX"
LENGTH_BINS = [0, 150, 250, 350, 500, 750, 1100]
ASSISTANT_OPENING = r"(?i)^\s*(?:sure|certainly|of course|absolutely|here(?:'s| is)|below is|i'd be happy|as requested|great question|okay|ok)\b[^\n]{0,120}?[:\n]"
CLOSING_REMARK = r"(?is)\n\s*(?:let me know if|i hope this helps|feel free to|would you like me to)\b.*$"
HEADING = r"^\s*#{1,6}\s*\S"
PII = {
    "EMAIL": r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b",
    "PHONE": r"(?<!\d)(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "SSN": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "IBAN": r"(?U)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "CREDIT_CARD": r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)",
    "IP": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])",
}
GENRE_RULES = [
    ("research-style summary", ["we find", "this paper", "the results", "we show", "abstract"]),
    ("narrative piece", ["i remember", "my father", "she said", "he said"]),
    ("formal report", ["shall", "pursuant", "hereby", "the committee", "section"]),
]
CONVERSATIONAL = ["you'll", "let's", "we've", "i think", "you can"]
# -------------------------------------------------------------------------------------------------


def let(c: Column, body) -> Column:
    """``body(c)`` with ``c`` evaluated once per row: inside other lambdas an expression would run for every element."""
    return F.element_at(F.transform(F.array(c), body), 1)


def trim_all(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(F.trim(c), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def word_tokens(c: Column) -> Column:
    """Blank-separated tokens."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.size(word_tokens(c))


def word_runs(c: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(c, F.lit(rf"[{WORD_CHAR}]+"), F.lit(0))


def symbol_ratio(c: Column) -> Column:
    """Share of characters that are neither word characters nor white space; 1 for the empty text."""
    rest = F.length(F.regexp_replace(c, rf"[{WORD_CHAR}{SPACE}]+", ""))
    return F.when(F.length(c) == 0, 1.0).otherwise(F.try_divide(rest, F.length(c)))


def lines_of(c: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(c, "\n"), trim_all), lambda x: x != "")


def repeated_line_ratio(c: Column) -> Column:
    return let(lines_of(c), lambda lines: F.when(F.size(lines) < 2, 0.0).otherwise(1.0 - F.size(F.array_distinct(lines)) / F.size(lines)))


def mean_word_length(c: Column) -> Column:
    mean = let(word_runs(c), lambda words: F.try_divide(F.length(F.array_join(words, "")), F.size(words)))
    return F.coalesce(mean, F.when(c.isNotNull(), 0.0))


def unique_word_ratio(c: Column) -> Column:
    ratio = let(word_runs(F.lower(c)), lambda words: F.try_divide(F.size(F.array_distinct(words)), F.size(words)))
    return F.coalesce(ratio, F.when(c.isNotNull(), 0.0))


def strip_invisible(c: Column) -> Column:
    return F.translate(c, INVISIBLE, "")


def fold_confusables(c: Column) -> Column:
    """Cyrillic and Greek look-alikes to the Latin letters they imitate; opt-in, for English text."""
    return F.translate(c, CONFUSABLE_FROM, CONFUSABLE_TO)


def strip_markup(c: Column) -> Column:
    """Scripts and styles, links to their labels, tags, then entities one kind after the other (so ``&amp;lt;`` is decoded twice)."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, sign in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.regexp_replace(c, r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);", " ")


def collapse_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, r"[ \t\x{A0}\x{2000}-\x{200A}]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return trim_all(F.array_join(F.transform(F.split(c, "\n"), trim_all), "\n"))


def stopword_ratio(c: Column) -> Column:
    """Share of English stopwords among the words of ASCII letters and apostrophes; 0 without words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(ASCII_WORD), F.lit(0))
    return F.coalesce(let(words, lambda w: F.try_divide(F.size(F.filter(w, lambda x: x.isin(ENGLISH_STOPWORDS))), F.size(w))), F.lit(0.0))


def heuristic_language(c: Column) -> tuple[Column, Column]:
    """(language, score) from the stopword ratio; no words: unknown, 0."""
    score = F.least(stopword_ratio(c) / 0.25, F.lit(1.0))
    return F.when(score >= 0.5, "en").otherwise("unknown"), F.bround(score, 4)


def detect_language(c: Column, upstream: Column, upstream_score: Column) -> tuple[Column, Column, Column]:
    """(language, score, detector): the upstream label if there is one, else the heuristic."""
    language, score = heuristic_language(c)
    return F.coalesce(upstream, language), F.when(upstream.isNotNull(), upstream_score).otherwise(score), F.when(upstream.isNotNull(), "upstream").otherwise("heuristic")


def luhn_valid(digits: Column) -> Column:
    """Luhn check of a digit string of 13 to 19 digits."""
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def pii_kinds(c: Column) -> Column:
    """Sorted kinds of personal data found; a card number counts if one of its matches passes the Luhn check."""
    found = []
    for kind, pattern in sorted(PII.items()):
        if kind == "CREDIT_CARD":
            numbers = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, r"[^\d]", ""))
            hit = F.exists(numbers, luhn_valid)
        else:
            hit = c.rlike(pattern)
        found.append(F.when(hit, kind))
    return F.array_compact(F.array(*found))


def redact_except_cards(c: Column) -> Column:
    """Every kind but card numbers replaced by its placeholder, in the fixed order."""
    for kind in ("EMAIL", "PHONE", "SSN", "IBAN", "IP"):
        c = F.regexp_replace(c, PII[kind], f"[{kind}]")
    return c


def shingle_hashes(c: Column, k: int = 5) -> Column:
    """Distinct 32-bit hashes of the k-word shingles; fewer words give one hash of all, none an empty array."""

    def grams(words: Column) -> Column:
        n = F.size(words)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(n >= k, runs).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.transform(let(word_runs(F.lower(c)), grams), lambda g: F.conv(F.substring(F.sha1(g), 1, 8), 16, 10).cast("long")))


def structure_of(c: Column) -> Column:
    """listy, dialogue, sectioned or prose."""
    return let(lines_of(c), _structure)


def _structure(lines: Column) -> Column:
    n = F.size(lines)
    share = lambda cond: F.try_divide(F.size(F.filter(lines, cond)), n)
    bullets = share(lambda x: x.rlike(rf"^([-*•]|[0-9]+[.)])[{SPACE}]"))
    quotes = share(lambda x: x.rlike("^[\"'-]") & (F.length(x) < 120))
    short = share(lambda x: F.length(x) < 60)
    return F.when(n == 0, "prose").when(bullets > 0.3, "listy").when(quotes > 0.4, "dialogue").when((n > 4) & (short > 0.6), "sectioned").otherwise("prose")


def latin_words(c: Column) -> Column:
    """Lower-cased words of two or more ASCII letters, apostrophes and hyphens, not inside longer words."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(rf"[{WORD_CHAR}'-]+"), F.lit(0))
    trimmed = F.transform(runs, lambda w: F.regexp_replace(w, "^['-]+|['-]+$", ""))
    return F.filter(trimmed, lambda w: w.rlike("^[a-z][a-z'-]+$"))


def difficulty_of(c: Column) -> Column:
    """plain, moderate or demanding, by words per sentence and the share of long words."""
    words = latin_words(c)
    n = F.size(words)
    sentences = F.greatest(F.regexp_count(c, F.lit(rf"[.!?]+([{SPACE}]|$)")), F.lit(1))
    score = n / sentences / 20.0 + F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.length(w) >= 8)), n), F.lit(0.0)) / 0.15
    return F.when(n == 0, "moderate").when(score < 1.0, "plain").when(score < 1.8, "moderate").otherwise("demanding")


def _has_any(c: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out |= c.contains(p)
    return out


def genre_of(c: Column, structure: Column) -> Column:
    low = F.lower(c)
    out = F.when(structure == "listy", "list-based guide").when(structure == "dialogue", "dialogue")
    for genre, phrases in GENRE_RULES:
        out = out.when(_has_any(low, phrases), genre)
    return out.otherwise("explainer")


def register_of(c: Column, difficulty: Column) -> Column:
    return F.when(_has_any(F.lower(c), CONVERSATIONAL), "conversational").when(difficulty == "demanding", "formal").otherwise("informational")


def paragraphs_of(c: Column, least_chars: int = 80) -> Column:
    """Trimmed paragraphs between blank lines with at least ``least_chars`` characters."""
    return F.filter(F.transform(F.split(c, rf"\n[{SPACE}]*\n"), trim_all), lambda p: F.length(p) >= least_chars)


def length_bin(words: Column) -> Column:
    """Index of the last bin edge not above the word count."""
    out = F.lit(0)
    for i, edge in enumerate(LENGTH_BINS):
        out = F.when(words >= edge, i).otherwise(out)
    return out


def strip_wrapper(c: Column) -> Column:
    """Without trailing chat remarks and a leading markdown heading."""
    c = trim_all(F.regexp_replace(c, CLOSING_REMARK, ""))
    return F.when(c.rlike(HEADING), trim_all(F.regexp_replace(c, r"^[^\n]*\n?", ""))).otherwise(c)


def starts_as_assistant(c: Column) -> Column:
    return c.rlike(ASSISTANT_OPENING)


def render_template(template: str, fields: dict[str, Column]) -> Column:
    """The template with every ``{name}`` replaced; an unknown name is an error before anything runs."""
    import re

    unknown = [name for name in re.findall(r"\{(\w+)\}", template) if name not in fields]
    if unknown:
        raise KeyError(f"unknown fields: {unknown}")
    out = F.lit(template)
    for name, column in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), column)
    return out


def word_spans(words: Column, n: int) -> Column:
    """Runs of n words, joined."""
    return let(words, lambda words: _spans(words, n))


def _spans(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def copies_verbatim(anchors: Column, source: Column, most_words: int = 4, span: int = 8) -> Column:
    """Whether an anchor is over-long or repeats ``span`` consecutive words of the source."""
    hit = lambda a, spans: (F.size(latin_words(a)) > most_words) | F.coalesce(F.arrays_overlap(word_spans(latin_words(a), span), spans), F.lit(False))
    return let(word_spans(latin_words(source), span), lambda spans: F.exists(anchors, lambda a: hit(a, spans)))
