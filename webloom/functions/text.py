"""Text functions as columns: tokens, keywords, n-grams, whole-word hits, snippets and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that neither begin nor end a keyword, English then Polish.
STOP_WORDS = tuple(
    "the a an and or but if then else to in on at by for with about of is are was were be been have has had this that "
    "these those from our your their my its i you we they he she it "
    "i w na z do o u dla ze za po oraz jest sa są wraz pod nad przed miedzy między przez od takze także lub albo czy bo "
    "poniewaz ponieważ gdyz gdyż ale lecz jednak a ze że to sie się go mu ich je ją jej jego nimi nim by być byc o".split()
)
_WORD = r"\p{IsAlphabetic}\p{N}"
SNIPPET = 35


def clean(text: Column) -> Column:
    """Lower case with everything but letters and numbers as spaces; replaced first, so that marks of a lower case stay."""
    return F.lower(F.regexp_replace(text, f"[^{_WORD}]", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(clean(text), F.lit("")), r"\s+"), lambda t: t != "")


def is_stop(token: Column) -> Column:
    return token.isin(*dict.fromkeys(STOP_WORDS))


def positions(df: DataFrame, token_column: str) -> DataFrame:
    """One row per token of each row, with its 0-based position `at`; tokens are computed once, below the explode."""
    last = F.size(token_column) - 1
    return df.where(F.size(token_column) > 0).withColumn("at", F.explode(F.sequence(F.lit(0), last)))


def gram(token_column: str, length: int) -> Column:
    """The tokens from `at` on, joined by spaces; null where there are too few."""
    fits = F.col("at") + length <= F.size(token_column)
    return F.when(fits, F.array_join(F.slice(token_column, F.col("at") + 1, F.lit(length)), " "))


def keyword_like(token_column: str, length: int, least_bytes: int, whole_unigram: bool) -> Column:
    """Whether the gram at `at` may stand as a keyword: no stop word at its ends, no one-byte token, long enough."""
    first, last = F.get(F.col(token_column), F.col("at")), F.get(F.col(token_column), F.col("at") + length - 1)
    ok = ~is_stop(first) & (F.octet_length(gram(token_column, length)) >= least_bytes)
    if length > 1:
        ok &= ~is_stop(last)
    if length > 1 or not whole_unigram:
        for k in range(length):
            ok &= F.octet_length(F.get(F.col(token_column), F.col("at") + k)) >= 2
    if length == 1 and whole_unigram:
        ok &= F.size(token_column) == 1
    return ok


def strip_markdown(text: Column) -> Column:
    """Links as their text (to the end where unclosed), without the characters * _ ` # outside of link texts."""
    return F.regexp_replace(text, r"\[([^\]]*)(?:\]|\z)(?:\([^)]*(?:\)|\z))?|[*_`#]", "$1")


def marked(text: Column) -> Column:
    """The text in lower case with \x02 at its ends and around each of its other characters than letters and numbers, of which
    all but the space are \x01: so a whole word stands between two \x02, whatever its neighbours are."""
    plain = F.regexp_replace(F.lower(text), f"[^{_WORD} ]", "\x01")
    return F.concat(F.lit("\x02"), F.regexp_replace(plain, "[ \x01]", "\x02$0\x02"), F.lit("\x02"))


def _bordered(keyword: Column) -> Column:
    return F.concat(F.lit("\x02"), F.replace(keyword, F.lit(" "), F.lit("\x02 \x02")), F.lit("\x02"))


def has_whole_word(marked: Column, keyword: Column) -> Column:
    """Whether a keyword of letters, numbers and spaces is in a marked text and no part of a longer word: one plain search."""
    return marked.contains(_bordered(keyword))


def marked_place(marked: Column, keyword: Column) -> Column:
    """Where the first such hit's border is in a marked text; 0 if there is none."""
    return F.instr(marked, _bordered(keyword))


def unmarked_place(marked: Column, place: Column) -> Column:
    """The 1-based place in the text of a hit whose border is at this place of the marked text."""
    before = F.substring(marked, F.lit(1), place)
    return F.when(place > 0, place + 1 - (F.char_length(before) - F.char_length(F.replace(before, F.lit("\x02"), F.lit(""))))).otherwise(0)


def whole_word_at(text: Column, keyword: Column) -> Column:
    """The 1-based place of the first whole-word hit of a keyword in a text; 0 if none."""
    return unmarked_place(marked(text), marked_place(marked(text), keyword))


def pieces(text: Column) -> Column:
    """The text cut before each run of letters and numbers: what comes before the first, then each run with what follows it."""
    return F.concat(F.array(F.regexp_extract(text, f"^[^{_WORD}]*", 0)), F.regexp_extract_all(text, F.lit(f"[{_WORD}]+[^{_WORD}]*"), F.lit(0)))


def runs(text: Column) -> Column:
    """The runs of letters and numbers of a text."""
    return F.regexp_extract_all(text, F.lit(f"[{_WORD}]+"), F.lit(0))


def escape_markup(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def snippet(text: Column, at: Column, length: Column) -> Column:
    """The text around a hit, the hit in <b>; parts are markup-escaped."""
    begin = F.greatest(at - SNIPPET, F.lit(1))
    return _shown(F.substring(text, begin, at - begin), F.substring(text, at, length), F.substring(text, at + length, F.lit(SNIPPET)))


def _shown(before: Column, hit: Column, after: Column) -> Column:
    return F.concat(F.lit("..."), escape_markup(before), F.lit("<b>"), escape_markup(hit), F.lit("</b>"), escape_markup(after), F.lit("..."))


def around(pieces: Column, run: Column, size: Column) -> tuple[Column, Column]:
    """What of a text's pieces is enough for a snippet: before its 1-based run, and from there on, `size` runs being the hit.

    A piece has two characters at least but for the first and the last, so few are, however long the text is.
    """
    few = F.lit(SNIPPET // 2 + 1)
    begin = F.greatest(run - few + 1, F.lit(1))
    return F.array_join(F.slice(pieces, begin, run - begin + 1), ""), F.array_join(F.slice(pieces, run + 1, size + few), "")


def snippet_around(before: Column, rest: Column, length: Column) -> Column:
    """The same as snippet, of what `around` gives."""
    return _shown(F.substring(before, -SNIPPET, SNIPPET), F.substring(rest, F.lit(1), length), F.substring(rest, length + 1, F.lit(SNIPPET)))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"\r?\n", " ")


def _one_decimal(value: Column, places: int = 1) -> Column:
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def bytes_label(size: Column) -> Column:
    small = F.concat(size.cast("string"), F.lit(" B"))
    kilo = F.concat(_one_decimal(size / 1024), F.lit(" KB"))
    mega = F.concat(_one_decimal(size / (1024 * 1024)), F.lit(" MB"))
    return F.when(size < 1024, small).when(size < 1024 * 1024, kilo).otherwise(mega)


def kilobytes(size: Column) -> Column:
    return F.concat(_one_decimal(size / 1024, 2), F.lit(" KB"))


def length_label(text: Column) -> Column:
    return F.concat(F.lit("("), F.char_length(text).cast("string"), F.lit(" chars)"))


def multiple_label(count: Column) -> Column:
    return F.when(count > 1, F.concat(F.lit("(Multiple tags: "), count.cast("string"), F.lit(" found)"))).otherwise("")


def status_label(status: Column, missing: str = "Err") -> Column:
    return F.coalesce(status.cast("string"), F.lit(missing))


def tail_label(text: Column) -> Column:
    """A long path from its end: its last 28 bytes, or the characters that are whole in them."""
    raw = F.encode(text, "UTF-8")
    ends = [F.try_validate_utf8(F.substring(raw, F.octet_length(text) - n + 1, F.lit(n)).cast("string")) for n in (28, 27, 26, 25)]
    return F.when(F.octet_length(text) > 30, F.concat(F.lit("..."), F.coalesce(*ends))).otherwise(text)
