"""Legal text to tokens, as one Column expression: citations, Latin phrases, tokens, stop words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexdrift.functions.wordlists import CITATIONS, LATIN_PHRASES, STOP_WORDS

MARK = "\x01"
PLACEHOLDERS = ["__CASEREF__", "__ECRREF__", "__OJREF__", "__PARAREF__", "__NUM__"]


def collapse_space(text: Column) -> Column:
    """Runs of white space, Unicode's included, to one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def by_letter(words: Iterable[str]) -> str:
    """A pattern of the words, longest first, grouped by first letter: those of other letters never match at the same place."""
    letters: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        letters.setdefault(w[0], []).append(re.escape(w[1:]).replace(r"\ ", " "))
    return "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in letters.items())


def normalize_citations(text: Column) -> Column:
    """Each kind of citation to its placeholder; articles to article_<number>_<treaty>."""

    def replaced(x: Column) -> Column:
        out = x
        for pattern, into in CITATIONS:
            # Case and classes follow Unicode, as (?iu)(?U) asks of Java.
            out = F.regexp_replace(out, "(?iu)(?U)" + pattern, into)
        # Every kind has a digit: a text without any is passed over at once.
        return F.when(F.regexp_like(x, F.lit(r"(?U)\d")), out).otherwise(x)

    return let(text, replaced)


SECOND_WORDS = by_letter({p.split(" ")[1] for p in LATIN_PHRASES})


def protect_latin(text: Column) -> Column:
    """Latin phrases in lower case, joined by underscores: leftmost first, longest first at one place, in a single pass."""
    phrases = rf"(?iu)(?U)\b({by_letter(LATIN_PHRASES)})\b"
    # Every phrase has a space and its second word: a text without any such pair is passed over.
    second = f"(?iu) (?:{SECOND_WORDS})"

    def replaced(x: Column) -> Column:
        marked = F.regexp_replace(x, phrases, f"{MARK}$1{MARK}")
        parts = F.transform(F.split(marked, MARK), lambda p, k: F.when(k % 2 == 1, F.replace(F.lower(p), F.lit(" "), F.lit("_"))).otherwise(p))
        # A text that holds the mark itself is left as it stands.
        return F.when(~F.regexp_like(x, F.lit(second)) | F.contains(x, F.lit(MARK)), x).otherwise(F.array_join(parts, ""))

    return let(text, replaced)


def tokens_of(text: Column) -> Column:
    """[a-z_][a-z0-9_]* of the lower-cased text, without stop words, single letters and what begins with an underscore."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.startswith("_") & ~t.isin(STOP_WORDS))


def preprocess(text: Column) -> Column:
    """The whole chain for one paragraph; a null text has null tokens."""
    return tokens_of(protect_latin(normalize_citations(text)))


#: What only the patterns can judge: digits, second words of Latin phrases, and the letters beyond ASCII that fold to ASCII ones.
PATTERNED = rf"\p{{N}}|[\x{{130}}\x{{131}}\x{{17F}}\x{{212A}}]| (?i:{SECOND_WORDS})(?:[^A-Za-z0-9_]|$)"
#: Bytes of tokens in lower case; the others, those of letters beyond ASCII too, end a token.
LOWER = np.array([ord(c.lower()) if (c := chr(b)).isascii() and (c.isalpha() or c == "_") else 0 for b in range(256)], "uint8")

#: Bytes of texts that are cut at once.
STRIP = 1 << 20


def plain_tokens(texts: pa.Array) -> pa.Array:
    """``preprocess`` of the texts in which no pattern can match, byte by byte for all of them at once; null for the others."""
    plain = pc.invert(pc.fill_null(pc.match_substring_regex(texts, PATTERNED), True))
    kept = texts.filter(plain).cast(pa.large_string())
    places = np.frombuffer(kept.buffers()[1], "int64")[kept.offset : kept.offset + len(kept) + 1] if len(kept) else np.zeros(1, "int64")
    data = LOWER[np.frombuffer(kept.buffers()[2] or b"", "uint8")[places[0] : places[-1]]]
    places = places - places[0]
    # Tokens begin and end where letters do, and at the ends of texts.
    letter = data > 0
    begins, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begins[:-1], ends[1:] = letter, letter
    begins[1:-1] &= ~letter[:-1]
    ends[:-1] &= ~letter
    inner = places[(places > 0) & (places < len(data))]
    begins[inner], ends[inner] = letter[inner], letter[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    lengths = stops - starts
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype("int64")), pa.py_buffer(data[letter]))
    fit = (lengths >= 2) & (data[starts] != ord("_")) & ~pc.is_in(words, pa.array(STOP_WORDS, pa.large_string())).to_numpy(zero_copy_only=False)
    upto = np.searchsorted(starts[fit], places)
    # A list for each text: those of patterned ones are empty and null.
    rows = plain.to_numpy(zero_copy_only=False)
    at = upto[np.concatenate([[0], np.cumsum(rows)])]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), words.filter(pa.array(fit)).cast(pa.string()), mask=pa.array(~rows))


@F.arrow_udf(ArrayType(StringType()))
def tokens_of_plain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = max(1, len(texts) * STRIP // max(1, texts.nbytes))
        yield pa.concat_arrays([plain_tokens(texts[k : k + rows]) for k in range(0, max(1, len(texts)), rows)])


def paragraphs_of(docs: DataFrame, paragraphs: str = "paragraphs", status: str | None = "status") -> DataFrame:
    """A row for each paragraph with its ordinal ``para_idx``, of records whose status is ok."""
    ok = docs.where(F.col(status) == "ok") if status else docs
    return ok.select(*[c for c in ok.columns if c not in (paragraphs, status)], F.posexplode(paragraphs).alias("para_idx", "text"))


def build_sentences(docs: DataFrame, paragraphs: str = "paragraphs", status: str | None = "status") -> DataFrame:
    """Paragraphs with ``tokens``; those without any token are left out."""
    return with_tokens(paragraphs_of(docs, paragraphs, status))


def with_tokens(rows: DataFrame) -> DataFrame:
    """``tokens`` in place of ``text``, of rows that have any."""
    # A generated column is computed once; a filter on a plain one would be pushed below it with all patterns, which then run twice.
    others = [c for c in rows.columns if c != "text"]
    # Patterns run only on the texts that they may change.
    tokens = F.coalesce("__plain", preprocess(F.col("text")))
    return rows.withColumn("__plain", tokens_of_plain("text")).select(*others, F.explode(F.array(tokens)).alias("tokens")).where(F.size("tokens") > 0)


def as_lines(sentences: DataFrame) -> DataFrame:
    """One line a sentence, tokens joined by spaces: the text form of a corpus."""
    return sentences.withColumn("line", F.array_join("tokens", " ")).drop("tokens")
