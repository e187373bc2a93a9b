"""Text expressions: words, normal form, n-grams, templates (Column to Column)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def normalize(text: Column) -> Column:
    """Words joined by one space, in lower case: the key of exact dedup."""
    return F.lower(F.array_join(words(text), " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: named columns are put back into lambdas by the optimizer, and computed anew for each element there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(ws: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by spaces; none where there are fewer words."""

    def runs(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, found).otherwise(F.array().cast("array<string>"))

    return let(ws, runs)


def shingles(ws: Column, n: int = 5) -> Column:
    """Runs of ``n`` words; a shorter text that has words is one shingle."""
    return let(ws, lambda w: F.when(F.size(w) > n, grams(w, n)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))


def run_hashes(ws: Column, n: int, short: bool = False) -> Column:
    """64-bit hashes of all runs of ``n`` words, from hashes of the words: no string is made per run. With ``short`` a text of at most ``n`` words is one run."""

    def runs(h: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(F.slice(h, i, F.lit(n))))
        none = F.array().cast("array<bigint>")
        if not short:
            return F.when(F.size(h) >= n, found).otherwise(none)
        return F.when(F.size(h) > n, found).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(none)

    return let(F.transform(ws, lambda w: F.xxhash64(w)), runs)


def md5_int(text: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of the MD5 as a number; the same in every SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def word_ids(text: Column, vocabulary: int = 49151) -> Column:
    """A word-hash tokenizer: one id in 1..vocabulary per word."""
    return F.transform(words(text), lambda w: (md5_int(w) % vocabulary + 1).cast("int"))


def token_ids(text: Column, vocabulary: int = 49151, end_id: int = 0) -> Column:
    """Word ids, then the end id."""
    return F.concat(word_ids(text, vocabulary), F.array(F.lit(end_id)))


def bracket_cleanup(text: Column) -> Column:
    """Trim, turn ' [title]' into '. ', delete bracketed parts within a line, halve double spaces."""
    return F.replace(F.regexp_replace(F.replace(F.trim(text), F.lit(" [title]"), F.lit(". ")), r"\[[^\n]*?\]", ""), F.lit("  "), F.lit(" "))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


_SMALL, _LARGE, _NEWER = (
    "".join(chr(c) for r in runs for c in r)
    for runs in (
        ([0xDF, 0x1FB3, 0x1FC3, 0x1FF3], range(0x1F80, 0x1F88), range(0x1F90, 0x1F98), range(0x1FA0, 0x1FA8)),
        ([0x1E9E, 0x1FBC, 0x1FCC, 0x1FFC], range(0x1F88, 0x1F90), range(0x1F98, 0x1FA0), range(0x1FA8, 0x1FB0)),
        ([0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB], range(0x10D70, 0x10D86)),  # of Unicode 16, which DuckDB leaves alone
    )
)


def simple_upper(text: Column) -> Column:
    """Upper case letter by letter, as DuckDB has it: Spark's own gives two letters for some, such as SS for \u00df, where this gives \u1e9e."""
    one = lambda c: (F.length(F.upper(c)) == 1) & ~F.contains(F.lit(_NEWER), c)
    each = F.transform(F.split(text, ""), lambda c: F.when(one(c), F.upper(c)).otherwise(c))
    return F.translate(F.array_join(each, ""), _SMALL, _LARGE)


def reverse_clusters(text: Column) -> Column:
    """Reversed as DuckDB does it: marks stay behind their letter, except that a text of ASCII alone is reversed by character."""
    clusters = F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))
    return F.when(F.octet_length(text) == F.length(text), F.reverse(text)).otherwise(F.array_join(F.reverse(clusters), ""))


def final_estimate(said: Column) -> Column:
    """The number after the tool's fixed words, or null."""
    return F.nullif(F.regexp_extract(said, r"Final estimate: PPL = ([0-9.]+)", 1), F.lit("")).cast("double")


def run_name(path: Column) -> Column:
    """The second part of a path, or a default."""
    second = F.split_part(path, F.lit("/"), F.lit(2))
    return F.when(second == "", "run").otherwise(second)


def plain_key(key: Column) -> Column:
    """A weight's name without a compiler's prefix and a parametrisation's suffix."""
    return F.regexp_replace(F.regexp_replace(key, r"^_orig_mod\.", ""), r"\.original$", "")


def parse_pairs(line: Column) -> Column:
    """KEY=VALUE pairs between commas, as a map."""
    return F.str_to_map(line, F.lit(","), F.lit("="))


def hub_uri(uri: Column) -> Column:
    """repo, path and rev (main by default) of hub://owner/name/path?rev=...; null with fewer than three parts."""
    pattern = r"^hub://([^/]+/[^/]+)/([^?]+)(?:\?rev=(.+))?$"
    rev = F.regexp_extract(uri, pattern, 3)
    return F.when(F.regexp_like(uri, F.lit(pattern)), F.struct(F.regexp_extract(uri, pattern, 1).alias("repo"), F.regexp_extract(uri, pattern, 2).alias("path"), F.when(rev == "", "main").otherwise(rev).alias("rev")))

