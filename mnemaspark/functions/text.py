"""Column expressions on text: tokenizers, language, names, times, places, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L

WORD = r"[\p{L}\p{N}_]+"


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _word_runs(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(WORD), F.lit(0))


def recall_tokens(x: Column) -> Column:
    """lower-case word runs of over two characters, less stopwords, distinct."""
    return F.array_distinct(F.filter(_word_runs(F.lower(x)), lambda t: (F.length(t) > 2) & ~t.isin(*L.STOPWORDS)))


def validator_tokens(x: Column) -> Column:
    """lower-case word runs of over one character, distinct."""
    return F.array_distinct(F.filter(_word_runs(F.lower(x)), lambda t: F.length(t) > 1))


def space_tokens(x: Column) -> Column:
    """lower-case stretches between white space, punctuation kept, distinct."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda t: t != ""))


def has_negation(x: Column) -> Column:
    """F7."""
    return F.arrays_overlap(space_tokens(x), words(L.NEGATIONS))


def detect_lang(x: Column) -> Column:
    """en or es need a strict majority over both others, else pt if any of its words is there."""
    own = space_tokens(F.translate(F.lower(F.coalesce(x, F.lit(""))), "¿¡!?.,;:", "        "))
    pt, en, es = (F.size(F.array_intersect(own, words(L.LANGUAGE_WORDS[k]))) for k in ("pt", "en", "es"))
    return F.when((en > pt) & (en > es), "en").when((es > pt) & (es > en), "es").when(pt > 0, "pt").otherwise("unknown")


def extract_who(x: Column) -> Column:
    """capitalised words of three letters or more, sorted."""
    names = F.filter(_word_runs(x), lambda t: t.rlike(L.NAME_PATTERN) & ~F.lower(t).isin(*L.NOT_NAMES))
    return F.array_sort(F.array_distinct(names))


def _first(x: Column, pattern: str) -> Column:
    """The first match that no word character precedes or follows, or null."""
    got = F.regexp_extract(F.coalesce(x, F.lit("")), rf"(?:^|[^\p{{L}}\p{{N}}_])({pattern})(?:[^\p{{L}}\p{{N}}_]|$)", 1)
    return F.when(got != "", got)


def extract_when(x: Column) -> Column:
    """the first kind of time expression that is found, as written; else empty."""
    return F.coalesce(
        _first(x, "(?iu:" + "|".join(L.DAY_WORDS) + ")"),
        _first(x, "(?iu:" + "|".join(L.WEEKDAYS) + ")(?:(?i:-feira))?"),
        _first(x, r"\d{1,2}/\d{1,2}(?:/\d{2,4})?"),
        _first(x, r"\d{4}-\d{2}-\d{2}"),
        F.lit(""),
    )


def extract_where(x: Column) -> Column:
    """the first place word, or default."""
    return F.coalesce(F.get(F.filter(_word_runs(F.lower(x)), lambda t: t.isin(*L.PLACE_WORDS)), F.lit(0)), F.lit("default"))


def rough_tokens(x: Column) -> Column:
    """F17."""
    return (F.length(x) / 4).cast("int")


def stripped(x: Column) -> Column:
    """White space of any kind cut from both ends."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")


def listed(x: Column) -> Column:
    """Arrays as sorted text, for results."""
    return F.array_join(F.array_sort(x), " ")
