"""Text column expressions: tokens, folding, cleaning.  All run inside the JVM."""

import unicodedata

from pyspark.sql import Column, functions as F

# Ranges of ideographs and hiragana, which are written without blanks.
IDEOGRAPHS = r"\u2E80-\u2FDF\u3005\u3007\u3021-\u3029\u3038-\u303B\u3041-\u309F\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
# Characters that join two letters, and those that join two digits.
BETWEEN_LETTERS, BETWEEN_DIGITS = ".'\u2019:\u00B7", ".'\u2019,;"


# Classes of characters: what a word begins with and what it goes on with.  ASCII is named first because it is the usual case.
WORD_START = rf"a-zA-Z0-9[\p{{L}}\p{{N}}&&[^{IDEOGRAPHS}]]"
WORD_INNER = rf"a-zA-Z0-9_[\p{{L}}\p{{N}}\p{{M}}&&[^{IDEOGRAPHS}]]"
ONE_WORD = rf"{IDEOGRAPHS}&&[\p{{L}}\p{{N}}]"


def _word_pattern() -> str:
    """A word: letters, digits, their combining marks and low lines, from a letter or digit on.

    One of BETWEEN_LETTERS between two letters and one of BETWEEN_DIGITS between two digits belongs to
    the word; an ideograph is a word of its own.  ``words.word_cutter`` cuts the same words in Python workers.
    """
    start, inner = f"[{WORD_START}]", f"[{WORD_INNER}]"
    joint = rf"(?:[{BETWEEN_LETTERS}](?<=[\p{{L}}\p{{M}}].)(?=\p{{L}})|[{BETWEEN_DIGITS}](?<=\p{{N}}.)(?=\p{{N}}))"
    # possessive: a long chain of joints must not nest
    return rf"{start}{inner}*+(?:{joint}{inner}++)*+|[{ONE_WORD}]\p{{M}}*+"


WORD = _word_pattern()

# The English stop words of the default "stop" filter.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such "
    "that the their then there these they this to was will with"
).split()


def tokens(text: Column) -> Column:
    """Lower-cased word tokens of ``text``; an empty array for null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _without_marks(char: str, form: str) -> str:
    return "".join(c for c in unicodedata.normalize(form, char) if unicodedata.category(c) != "Mn")


def _single_letter_map(form: str) -> dict:
    """Accented Latin letters that reduce to exactly one other character."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = _without_marks(chr(code), form)
        if len(plain) == 1 and plain != chr(code):
            out[chr(code)] = plain
    return out


# Latin letters that fold to something decomposition cannot give.
FOLD_TO_MANY = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH"}
FOLD_TO_ONE = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "ı": "i"}


def ascii_fold(text: Column) -> Column:
    """Replace accented Latin letters by their plain counterparts."""
    letters = {k: v for k, v in _single_letter_map("NFD").items() if v.isascii()} | FOLD_TO_ONE
    out = F.translate(text, "".join(letters), "".join(letters.values()))
    for letter, plain in FOLD_TO_MANY.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def _strip_marks_udf():
    @F.pandas_udf("string")
    def strip_marks(texts):
        import unicodedata as u

        def plain(text):
            if text is None:
                return None
            return "".join(c for c in u.normalize("NFKD", text) if u.category(c) != "Mn")

        return texts.map(plain)

    return strip_marks


def strip_marks(text: Column) -> Column:
    """Compatibility-decompose and drop non-spacing marks.

    Texts made of ASCII, one-letter Latin accents and typographic quotes are mapped
    in the JVM.  Only texts with other characters travel to the Arrow helper.
    """
    letters = _single_letter_map("NFKD")
    unchanged = "".join(
        chr(code) for code in (*range(0xC0, 0x250), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D)
        if _without_marks(chr(code), "NFKD") == chr(code)
    )
    marks = "".join(chr(code) for code in range(0x300, 0x370) if unicodedata.category(chr(code)) == "Mn")
    known = "".join(letters) + unchanged + marks
    mapped = F.translate(text, "".join(letters) + marks, "".join(letters.values()))
    rest = F.translate(text, known, "")
    rare = F.coalesce(rest.rlike(r"[^\x00-\x7F]"), F.lit(False))
    return F.when(rare, _strip_marks_udf()(F.when(rare, text))).otherwise(mapped)


def clean_text(text: Column) -> Column:
    """Strip marks, trim, flatten line breaks and tabs, then halve double spaces once."""
    blank = F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u2029")
    out = F.btrim(strip_marks(text), blank)
    out = F.replace(out, F.lit("\n"), F.lit(" "))
    out = F.replace(out, F.lit("\r"), F.lit(""))
    out = F.replace(out, F.lit("\t"), F.lit(" "))
    out = F.replace(out, F.lit("  "), F.lit(" "))
    return F.coalesce(out, F.lit(""))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A lambda argument is computed once per row, whereas an outer expression would be
    computed again for every element of a higher-order function.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def term_counts(terms: Column) -> Column:
    """Array of ``struct(term, tf)`` for an array of tokens, counted inside the row.

    Sorting puts equal tokens side by side, so each distinct token is a run whose
    length is its count.  No shuffle is needed to count the terms of a document.
    """
    def starts_of_runs(ordered):
        return F.filter(
            F.transform(
                ordered,
                lambda token, i: F.when((i == 0) | (token != F.get(ordered, i - 1)), i),
            ),
            lambda start: start.isNotNull(),
        )

    def counted(ordered):
        return bind(
            starts_of_runs(ordered),
            lambda runs: F.transform(
                runs,
                lambda start, n: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(runs, n + 1), F.size(ordered)) - start).cast("long").alias("tf"),
                ),
            ),
        )

    return bind(F.sort_array(terms), counted)
