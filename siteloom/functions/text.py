"""Text functions as Catalyst expressions: words, chrome, chunks, normalised names, addresses and phones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ADDRESS_WORDS, CHROME_PHRASES, CHUNK_CHARS, LEGAL_SUFFIXES, PHONE, STOPWORDS, TIME

#: White space as Python's expressions understand it.
WHITE = r"(?U)\s+"


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(query: Column) -> Column:
    """Tokens without stopwords and single characters; all tokens where nothing else is left."""
    all_ = tokens(query)
    kept = F.filter(all_, lambda t: ~t.isin(*STOPWORDS) & (F.length(t) > 1))
    return F.when(F.size(kept) > 0, kept).otherwise(all_)


def has_time(text: Column) -> Column:
    return text.rlike("(?iU)" + TIME)


def is_chrome(text: Column) -> Column:
    """Navigation and the like: nothing, a boilerplate phrase, mostly capitalised words, or entries joined by ampersands."""
    words = F.filter(F.split(squeezed(text), " "), lambda w: w != "")
    capital = F.filter(words, lambda w: F.substring(w, 1, 1).rlike(r"(?U)\p{Lu}") & ~F.lower(w).isin("am", "pm"))
    no_digit = ~text.rlike(r"(?U)\d")
    ampersands = F.size(F.split(text, " & ", -1)) - 1
    return (
        (F.size(words) == 0)
        | text.rlike("(?i)" + CHROME_PHRASES)
        | ((F.size(words) >= 6) & (F.size(capital) / F.size(words) >= 0.7) & no_digit)
        | ((ampersands >= 2) & no_digit)
    )


def chunks(text: Column, width: int = CHUNK_CHARS) -> Column:
    """Paragraphs, and those beyond ``width`` wrapped at words; a longer word stays whole."""
    paragraphs = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), squeezed), lambda p: p != "")

    def step(acc: Column, word: Column) -> Column:
        joined = F.concat(acc["line"], F.lit(" "), word)
        fits = F.length(joined) <= width
        return (
            F.when(acc["line"] == "", F.struct(acc["done"].alias("done"), word.alias("line")))
            .when(fits, F.struct(acc["done"].alias("done"), joined.alias("line")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["line"])).alias("done"), word.alias("line")))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))
    wrap = lambda p: F.aggregate(F.split(p, " "), start, step, lambda acc: F.concat(acc["done"], F.array(acc["line"])))
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= width, F.array(p)).otherwise(wrap(p))))


def phone_matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + PHONE), F.lit(0))


def norm_phone(raw: Column) -> Column:
    """Digits, without the leading 1 of eleven."""
    digits = F.regexp_replace(raw, r"(?U)\D", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def norm_name(raw: Column) -> Column:
    """Lower case without marks, one legal suffix and a leading article."""
    plain = squeezed(F.regexp_replace(F.regexp_replace(F.lower(raw), "[®™©]", ""), r"(?U)[^a-z0-9\s]", " "))
    bare = F.trim(F.regexp_replace(plain, r"\b(?:" + "|".join(LEGAL_SUFFIXES) + r")\.?$", ""))
    return F.regexp_replace(bare, "^the ", "")


def norm_address(raw: Column) -> Column:
    """Lower case without dots, commas and number signs, words in their short form."""
    words = F.filter(F.split(F.regexp_replace(F.replace(F.lower(raw), F.lit("."), F.lit("")), "[,#]", " "), WHITE), lambda w: w != "")
    short = F.create_map(*(F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def norm_value(field: Column, raw: Column) -> Column:
    """The normal form of a value of a field; null where it counts for nothing."""
    value = F.when(field == "phone", F.when(F.length(norm_phone(raw)) >= 7, norm_phone(raw))).when(field == "business_name", norm_name(raw)).otherwise(norm_address(raw))
    return F.nullif(value, F.lit(""))
