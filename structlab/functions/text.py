"""String, bit and codec functions."""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter frequencies of English in percent, a to z.
ENGLISH = (
    8.167, 1.492, 2.782, 4.253, 12.702, 2.228, 2.015, 6.094, 6.966, 0.153, 0.772, 4.025, 2.406,
    6.749, 7.507, 1.929, 0.095, 5.987, 6.327, 9.056, 2.758, 0.978, 2.360, 0.150, 1.974, 0.074,
)


def letters_only(s: Column) -> Column:
    return F.upper(F.regexp_replace(s, "[^A-Za-z]", ""))


def caesar_shift(s: Column, k: int) -> Column:
    """Rotate A-Z and a-z by ``k``; other characters stay."""
    k %= 26
    up, low = string.ascii_uppercase, string.ascii_lowercase
    return F.translate(s, up + low, up[k:] + up[:k] + low[k:] + low[:k])


def printable_ratio(s: Column, line_ends: bool = False) -> Column:
    """Share of characters in 32 to 126, with ``line_ends`` also tab and line feed; null for an empty text."""
    keep = r"[^\x20-\x7E\n\t]" if line_ends else r"[^\x20-\x7E]"
    return F.length(F.regexp_replace(s, keep, "")) / F.nullif(F.length(s), F.lit(0))


def is_pure_ascii(s: Column) -> Column:
    return s.rlike(r"^[\x00-\x7F]*$")


def letter_counts(s: Column) -> Column:
    """Array of 26 counts of A-Z in a text, case folded."""
    only = letters_only(s)
    return F.array(*[F.length(only) - F.length(F.replace(only, F.lit(c), F.lit(""))) for c in string.ascii_uppercase])


def chi2_english(s: Column) -> Column:
    """Chi-square of the letters against English frequencies; null without letters."""
    only = F.length(letters_only(s)).cast("double")
    counts = letter_counts(s)
    terms = [
        F.pow(F.element_at(counts, k + 1) - F.lit(p / 100) * only, F.lit(2.0)) / F.nullif(F.lit(p / 100) * only, F.lit(0.0)) for k, p in enumerate(ENGLISH)
    ]
    return sum(terms[1:], terms[0])


def index_of_coincidence_letters(s: Column) -> Column:
    """Share of pairs of letters that are alike, case folded; null with fewer than two letters.  A text is counted in one pass."""

    def share(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            # Case differs in one bit; what isn't ASCII has bytes from 128 on.
            c = np.bincount(np.frombuffer((t or "").encode(), np.uint8), minlength=256)
            c = (c[65:91] + c[97:123]).astype(object)
            n = sum(c)
            out.append(float(sum(k * (k - 1) for k in c)) / float(n * (n - 1)) if n > 1 else None)
        return pd.Series(out, dtype="float64")

    found = F.pandas_udf(share, "double")(s)
    return F.when(s.isNotNull() & ~F.isnan(found), found)


def english_like(s: Column, max_chi2: float = 80.0, min_ic: float = 0.055, least: int = 40) -> Column:
    return F.coalesce(
        (F.length(letters_only(s)) >= least) & (chi2_english(s) <= max_chi2) & (index_of_coincidence_letters(s) >= min_ic), F.lit(False)
    )


def text_to_bits(s: Column, nbits: int = 8, msb_first: bool = True) -> Column:
    """Each character's code in ``nbits`` bits."""
    code = lambda c: F.right(F.lpad(F.bin(F.ascii(c)), 32, "0"), F.lit(nbits))
    one = (lambda c: code(c)) if msb_first else (lambda c: F.reverse(code(c)))
    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), "")


def bits_to_text(bits: Column, nbits: int = 8, msb_first: bool = True) -> Column:
    """Inverse of ``text_to_bits``; a partial tail is dropped."""
    n = F.floor(F.length(bits) / nbits).cast("int")
    part = lambda i: F.substring(bits, i * nbits + 1, F.lit(nbits))
    code = lambda i: F.conv(part(i) if msb_first else F.reverse(part(i)), 2, 10).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.char(code(i))), "")).otherwise("")


def codec_roundtrip_ok(s: Column, nbits: int = 8, msb_first: bool = True) -> Column:
    return bits_to_text(text_to_bits(s, nbits, msb_first), nbits, msb_first) == s


def parse_bits(s: Column) -> Column:
    """Bits of a text with white space and a 0b prefix taken out; null where anything else is left."""
    bare = F.regexp_replace(F.regexp_replace(s, r"\s+", ""), "^0[bB]", "")
    return F.when(bare.rlike("^[01]+$"), bare)


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def bit_error_rate(a: Column, b: Column) -> Column:
    return hamming(a, b) / F.nullif(F.least(F.length(a), F.length(b)), F.lit(0))


def binary_entropy(p: Column) -> Column:
    """Entropy in bits of a coin with probability ``p``; 0 at the ends."""
    q = 1.0 - p
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p) + q * F.log2(q)))


def one_share(bits: Column) -> Column:
    return F.length(F.replace(bits, F.lit("0"), F.lit(""))) / F.nullif(F.length(bits), F.lit(0))


def bit_balance(bits: Column) -> Column:
    return F.abs(one_share(bits) - 0.5)


def run_density(bits: Column) -> Column:
    """Share of neighbouring bits that differ."""
    steps = F.filter(F.sequence(F.lit(2), F.length(bits)), lambda i: F.substring(bits, i, F.lit(1)) != F.substring(bits, i - 1, F.lit(1)))
    return F.when(F.length(bits) > 1, F.size(steps) / (F.length(bits) - 1))


def genome_bits(s: Column) -> Column:
    """Two bits for A C G T/U, three for the modified bases M H 6; others are dropped."""
    codes = F.create_map(*[F.lit(x) for kv in {"A": "00", "C": "01", "G": "10", "T": "11", "U": "11", "M": "100", "H": "101", "6": "110"}.items() for x in kv])
    return F.array_join(F.filter(F.transform(F.split(F.upper(s), ""), lambda c: F.element_at(codes, c)), lambda x: x.isNotNull()), "")


def gc_content(s: Column) -> Column:
    """Share of G and C among A C G T U; null without any."""
    known = F.length(F.regexp_replace(F.upper(s), "[^ACGTU]", ""))
    return F.length(F.regexp_replace(F.upper(s), "[^GC]", "")) / F.nullif(known, F.lit(0))


def longest_match_tokens(s: Column, lexicon: list[str]) -> Column:
    """Greedy lexer: at each place the longest entry that fits, else one character."""
    entries = sorted((e for e in lexicon if len(e) > 1), key=lambda e: (-len(e), e))
    quoted = ["\\Q" + e + "\\E" for e in entries]
    return F.regexp_extract_all(s, F.lit("|".join([*quoted, "."])), F.lit(0))


def html_to_text(html: Column) -> Column:
    """Scripts and styles out, <br> a line end, </p> a blank line, other tags a space, runs of space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</p\s*>", "\n\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.replace(F.replace(out, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def snippets(s: Column, pattern: str, n: int = 3, around: int = 40) -> Column:
    """The first ``n`` matches of a pattern with up to ``around`` characters on either side."""
    return F.slice(F.regexp_extract_all(s, F.lit(f"(?s).{{0,{around}}}(?:{pattern}).{{0,{around}}}"), F.lit(0)), 1, n)


def clean_token(t: Column, drop: str = "{}[]()<>#?!*") -> Column:
    """A sign without determiner and damage marks."""
    return F.trim(F.translate(t, drop, ""))


def normalize_tokens(tokens: Column, aliases: dict[str, str], stop: list[str]) -> Column:
    """Trailing underscores off, aliases resolved, stop signs out."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    bare = F.transform(tokens, lambda t: F.rtrim(t, F.lit("_")))
    named = F.transform(bare, lambda t: F.coalesce(F.element_at(table, t), t)) if aliases else bare
    return F.filter(named, lambda t: ~t.isin(stop)) if stop else named


def is_numeral_sign(t: Column) -> Column:
    """Signs such as 3(N14): a count, then a numeral sign in brackets."""
    return t.rlike(r"^\d+\(N\d+[A-Za-z]?\)$")


def parse_j2000(name: Column) -> Column:
    """struct(ra_deg, dec_deg) of a JHHMMSS+DDMMSS designation; null where there is none."""
    part = lambda i: F.regexp_extract(name, r"J(\d{2})(\d{2})(\d{2}(?:\.\d+)?)([+-])(\d{2})(\d{2})(\d{2}(?:\.\d+)?)", i)
    number = lambda i: F.expr("0D") + part(i).try_cast("double")
    ra = 15.0 * (number(1) + number(2) / 60.0 + number(3) / 3600.0)
    dec = (number(5) + number(6) / 60.0 + number(7) / 3600.0) * F.when(part(4) == "-", -1.0).otherwise(1.0)
    return F.when(part(1) != "", F.struct(ra.alias("ra_deg"), dec.alias("dec_deg")))


def to_number(s: Column) -> Column:
    """Double of a cell; a decimal comma is a point, anything else is null."""
    return F.regexp_replace(F.trim(s), ",", ".").try_cast("double")
