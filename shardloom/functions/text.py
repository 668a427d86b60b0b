"""Text expressions: tokens, caption rules, labels and hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that mark a caption as a file name (case counts).
IMAGE_SUFFIXES = (".jpg", ".png", ".jpeg", ".gif", ".webp")


def tokens(text: Column) -> Column:
    """Words apart by white space; none for null and blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def caption_valid(text: Column, min_words: int = 5, strip: bool = True) -> Column:
    """True for a caption of enough words that is neither an address nor a file name; null is not valid.

    ``strip`` looks at the end without trailing blanks, as one of the two rule
    variants does.
    """
    body = F.trim(F.coalesce(text, F.lit("")))
    end = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", "") if strip else F.coalesce(text, F.lit(""))
    named = F.lit(False)
    for suffix in IMAGE_SUFFIXES:
        named = named | end.endswith(suffix)
    low = F.lower(body)
    return (word_count(text) >= min_words) & ~low.startswith("http") & ~low.startswith("www") & ~named


def caption_quality(text: Column) -> Column:
    """Quality of a caption from 0 to 1.

    Length and share of distinct words count 0.4 each; repeated word triples
    and marks of artefacts (addresses, file names, many bars or underscores)
    are taken off. Blank and null give 0, fewer than five words 0.1.
    """
    body = F.coalesce(text, F.lit(""))
    return let(body, lambda b: let(F.transform(tokens(b), lambda w: F.lower(w)), lambda words: _quality(b, words)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _quality(body: Column, words: Column) -> Column:
    n = F.size(words)
    length = F.when(n < 20, n / 20.0).when(n <= 80, F.lit(1.0)).otherwise(F.greatest(F.lit(0.3), 1.0 - (n - 80) / 200.0))
    lexical = F.size(F.array_distinct(words)) / n
    triples = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.concat_ws(" ", F.slice(words, i, 3)))
    penalty = F.when(n >= 3, let(triples, lambda t: (1.0 - F.size(F.array_distinct(t)) / F.size(t)) / 2.0)).otherwise(F.lit(0.0))
    low = F.lower(body)
    marks = lambda c: F.length(body) - F.length(F.translate(body, c, ""))
    artefact = (
        F.when(low.startswith("http") | low.contains("www."), 0.4).otherwise(0.0)
        + F.when(low.rlike(r"\.(jpg|jpeg|png|gif|webp|bmp|tiff?)(\s|$)"), 0.3).otherwise(0.0)
        + F.when((marks("|") > 3) | (marks("_") > 5), 0.2).otherwise(0.0)
    )
    score = 0.4 * length + 0.4 * lexical - penalty - artefact
    return F.when(n == 0, F.lit(0.0)).when(n < 5, F.lit(0.1)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def label_from_path(path: Column, order: list[tuple[str, str]], default: str = "unknown") -> Column:
    """The label of the first fragment, in order, that the lower-case path holds."""
    out = F.lit(default)
    for fragment, label in reversed(order):
        out = F.when(F.lower(path).contains(fragment), F.lit(label)).otherwise(out)
    return out


#: The orders in which three rules look for a source in a path, a file name, or a path before its provenance.
BUILD_ORDER = [("journeydb", "jdb"), ("jdb", "jdb"), ("wikiart", "wikiart"), ("laion", "laion"), ("coyo", "coyo")]
NAME_ORDER = [("laion", "laion"), ("coyo", "coyo"), ("wikiart", "wikiart"), ("jdb", "jdb"), ("journey", "jdb"), ("anchor", "anchor")]
SCORE_ORDER = [("journeydb", "journeydb"), ("jdb", "journeydb"), ("wikiart", "wikiart"), ("laion", "laion"), ("coyo", "coyo")]


def source_when_built(path: Column) -> Column:
    return label_from_path(path, BUILD_ORDER)


def source_by_name(path: Column) -> Column:
    """By the last part of the path alone."""
    return label_from_path(F.element_at(F.split(path, "/"), -1), NAME_ORDER)


def source_when_scored(path: Column, kinds: Column) -> Column:
    """By the path, else the one kind of source its provenance knows; several kinds are unknown."""
    own = F.array_distinct(F.filter(F.transform(kinds, lambda k: F.when(k == "jdb", F.lit("journeydb")).otherwise(k)), lambda k: k.isNotNull() & (k != "unknown")))
    by_path = label_from_path(path, SCORE_ORDER)
    return F.when(by_path != "unknown", by_path).when(F.size(own) == 1, F.element_at(own, 1)).otherwise(F.lit("unknown"))


def source_by_number(shard: Column, below: int = 400_000) -> Column:
    """The last guess: by the range of a numeric shard id."""
    n = F.trim(shard).try_cast("bigint")
    return F.when(n.isNull(), "unknown").when(n < below, "journeydb").otherwise("laion_coyo")


def joined_label(names: Column, unknown: str = "unknown") -> Column:
    """Distinct known names in order, joined by ``+``; null if there is none."""
    known = F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "") & (x != unknown))))
    return F.when(F.size(known) > 0, F.array_join(known, "+"))


def record_shard(rec_id: Column) -> Column:
    """What precedes the last underscore of a record id."""
    return F.regexp_extract(rec_id, r"^(.*)_[^_]*$", 1)


def config_hash(config: Column, digits: int = 16, prefix: str = "") -> Column:
    """First hex digits of the SHA-256 of a map's entries in order of key."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(config)))
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(ordered), 256), 1, digits))


def checkpoint_mark(path: Column, digits: int = 12) -> Column:
    """The first characters of a file's name without its ending."""
    return F.substring(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(.*?)(\.[^.]*)?$", 1), 1, digits)
