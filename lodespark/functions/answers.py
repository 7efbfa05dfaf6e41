"""Answer parsing, validation and correctness. All functions take and give Columns and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = [chr(97 + i) for i in range(26)]
UPPER = [c.upper() for c in LETTERS]
UNKNOWN = "0"
LEVELS = ["high_school_and_easier", "undergraduate", "graduate", "postgraduate"]


def letters(upper: bool = False) -> Column:
    return F.array(*[F.lit(c) for c in (UPPER if upper else LETTERS)])


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim knows spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_valid_answer(c: Column) -> Column:
    """Exactly one lower-case letter, or 0 for "I don't know"; no case folding or trimming. NULL is not valid."""
    return F.coalesce(c.isin(*LETTERS, UNKNOWN), F.lit(False))


def is_known_answer(c: Column) -> Column:
    return F.coalesce(c.isin(*LETTERS), F.lit(False))


def is_unknown_answer(c: Column) -> Column:
    return F.coalesce(c == UNKNOWN, F.lit(False))


def answer_correct(answer_index: Column, answer: Column) -> Column:
    """Does the trimmed answer equal the letter at the 0-based index? An index from -26 to -1 counts from z backwards;
    any other, or one that is no integer, makes it false, as does a NULL."""
    i = answer_index.cast("string").try_cast("int")
    at = F.when(i < 0, i + 26).otherwise(i)
    return F.coalesce(F.when(at >= 0, F.get(letters(), at)) == strip(answer), F.lit(False))


def answer_equals(answer: Column, gold: Column, trim: bool = True) -> Column:
    """Case-insensitive equality, trimmed by default; false for NULLs."""
    f = strip if trim else (lambda c: c)
    return F.coalesce(F.lower(f(answer)) == F.lower(f(gold)), F.lit(False))


def marker_text(c: Column, left: str = "[[", right: str = "]]") -> Column:
    """What stands between the first left and the first right marker, untrimmed; empty if either is missing or they
    come in the wrong order."""
    a, b = F.locate(left, c), F.locate(right, c)
    size = b - a - len(left)
    return F.when((a > 0) & (b > 0) & (size > 0), F.substring(c, a + len(left), size)).otherwise(F.lit(""))


def marker_last_letter(c: Column, allowed: Column | None = None) -> Column:
    """First character, in upper case, of the trimmed text between the last [[ and the next ]]; NULL if there is none or
    it is not allowed (A to Z by default). Give it completions only: prompts hold example markers."""
    tail = F.substring_index(c, "[[", -1)
    inside = F.when(c.contains("[[") & tail.contains("]]"), F.substring_index(tail, "]]", 1))
    letter = F.substring(F.upper(strip(inside)), 1, 1)
    return F.when(F.array_contains(allowed if allowed is not None else letters(True), letter), letter)


def marker_last_number(c: Column) -> Column:
    """The number in the last [[ n ]], or NULL."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"\[\[\s*(\d+)\s*\]\]"), F.lit(1)), F.lit(-1)).try_cast("long")


def marker_first_letter(c: Column) -> Column:
    """The letter that the first marker starting with a letter begins with, in lower case, or NULL."""
    return F.nullif(F.lower(F.regexp_extract(c, r"(?s)\[\[\s*([A-Za-z]).*?\]\]", 1)), F.lit(""))


def judge_level(c: Column) -> Column:
    """The education level in the first marker; NULL unless it is one of the four."""
    v = F.regexp_extract(c, r"\[\[(.+?)\]\]", 1)
    return F.when(v.isin(*LEVELS), v)


def judge_rating(c: Column) -> Column:
    """The rating in the first [[n]]; NULL unless it is 1 to 10."""
    v = F.regexp_extract(c, r"\[\[(\d+?)\]\]", 1).try_cast("int")
    return F.when(v.between(1, 10), v)


def letters_for(n: Column) -> Column:
    """The first n capital letters, n clipped to 0..26."""
    return F.slice(letters(True), F.lit(1), F.least(F.greatest(n.cast("int"), F.lit(0)), F.lit(26)))


def parse_options(c: Column) -> Column:
    """A list written as Python or JSON text, each element as text; an empty array if it can't be parsed."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def letter_of(c: Column, allowed: Column) -> Column:
    """An answer as one of the allowed capital letters: a letter; a number from 0 if it is below their count, else from
    1; empty if neither fits."""
    s = F.upper(strip(F.coalesce(c.cast("string"), F.lit(""))))
    i = F.when(s.rlike(r"^[0-9]+\z"), s).try_cast("int")
    digit = F.coalesce(F.get(allowed, i), F.when(i >= 1, F.get(allowed, i - 1)))
    return F.when(F.array_contains(allowed, s), s).otherwise(F.coalesce(digit, F.lit("")))


def gold_letter(answer: Column, answer_index: Column, allowed: Column) -> Column:
    """The letter of answer, or else of answer_index, or else empty."""
    return F.coalesce(F.nullif(letter_of(answer, allowed), F.lit("")), letter_of(answer_index, allowed))


def letter_in_text(c: Column, n: Column) -> Column:
    """An answer letter in free text with n options: code fences go, then the first character that is an allowed letter
    in either case, else a lone number of one or two digits; empty if there is none."""
    allowed = letters_for(n)
    t = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?s)^```(?:[a-zA-Z]+)?\s*|\s*```$", "")
    size = F.size(allowed)
    pattern = F.concat(F.lit("([A-"), F.char(64 + size), F.lit("a-"), F.char(96 + size), F.lit("])"))
    ch = F.when(size > 0, F.nullif(F.upper(F.get(F.regexp_extract_all(t, pattern, F.lit(1)), F.lit(0))), F.lit("")))
    number = F.regexp_extract(t, r"(?<!\d)(\d{1,2})(?!\d)", 1)
    return F.coalesce(ch, F.when(number != "", letter_of(number, allowed)), F.lit(""))


def level_score(c: Column) -> Column:
    """0.2, 0.4, 0.6, 0.8 for the four education levels in order, else 0."""
    out = F.lit(0.0)
    for k, name in enumerate(LEVELS, 1):
        out = F.when(c == name, F.lit(k / 5)).otherwise(out)
    return out


def steps_score(c: Column) -> Column:
    """0.25, 0.5, 0.75 for low, medium, high numbers of reasoning steps, else 0."""
    return F.when(c == "low", 0.25).when(c == "medium", 0.5).when(c == "high", 0.75).otherwise(0.0)


def first_subject(*cols: Column) -> Column:
    """The first of cols that is neither NULL nor empty, trimmed; NULL if that leaves nothing."""
    return F.nullif(strip(F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])), F.lit(""))


def slug(c: Column) -> Column:
    """A model id as a file name: lower case, / : - . as underscores."""
    return F.translate(F.lower(c), "/:-.", "____")
