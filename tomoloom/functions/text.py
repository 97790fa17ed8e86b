"""Scalar text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as concepts.
STOPWORDS = """
a an the and or but if of in on at to
for with about as by from that this these
those is are was were be been being it its
they them their what which who whom i me my
we us our you your he him his she her
look tell give use uses used using all any
other others do does did have has had not
so than then there here such into out up
down over under how when where why can will
would should could may might must also each
more most some no yes one two three new
like below above different same type types
understand shows show several example examples
often much many very well just still even
way ways make made making take taken taking
see seen let us these those instead rather
usually typically generally simply particular
particularly certain either both quickly easily
""".split()
# What counts as a word, and which characters of a word on a page are kept.
TOKEN_PATTERN = "[A-Za-z]+"
NON_WORD_PATTERN = "[^A-Za-z-]"
#: The characters of one byte among the others.
NON_WORD_BYTES = "".join(c for c in map(chr, range(128)) if not (c.isalpha() or c == "-"))


def tokens(text: Column) -> Column:
    """All runs of ASCII letters, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def clean_word(word: Column) -> Column:
    """Letters and hyphens only, lower-cased. A pattern, far slower, is matched only where more than single bytes remain."""
    rest = F.translate(word, NON_WORD_BYTES, "")
    single = F.octet_length(rest) == F.length(rest)
    return F.lower(F.when(single, rest).otherwise(F.regexp_replace(word, NON_WORD_PATTERN, "")))


def is_stopword(lowered: Column) -> Column:
    return lowered.isin(*dict.fromkeys(STOPWORDS))


def is_concept_token(token: Column) -> Column:
    """Not a stopword, and three letters or more unless written as an acronym of two or more capitals."""
    acronym = (F.length(token) >= 2) & (F.upper(token) == token)
    return ~is_stopword(F.lower(token)) & (acronym | (F.length(token) >= 3))


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace of every kind (SQL `trim` drops blanks only)."""
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")


def is_sealed_blob(text: Column) -> Column:
    """Encrypted or base64-like payloads: a known prefix, or a long unbroken run of base64-url characters."""
    foreign = F.length(F.regexp_replace(text, "[A-Za-z0-9_=-]", ""))
    long_run = (F.length(text) > 120) & (F.instr(text, " ") == 0)
    return text.startswith("gAAAAA") | (long_run & (foreign * 20 < F.length(text)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    """Lower-cased last suffix with its dot; names that only start with dots have none."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(base_name(path), r"^(\.*[^.].*?)\.[^.]*$", "$1")


def slug(path: Column) -> Column:
    """File stem as a safe folder name: other characters to `_`, outer `_` stripped, then cut to 60."""
    safe = F.regexp_replace(stem(path), r"[^\p{L}\p{N}_-]", "_")
    cut = F.substring(F.regexp_replace(safe, "^_+|_+$", ""), 1, 60)
    return F.when(cut == "", "paper").otherwise(cut)
