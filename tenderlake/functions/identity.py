"""Identity of notices: reference numbers, canonical keys, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import or_empty


def reference_base(c: Column) -> Column:
    """Upper case, one leading kind word off, letters and digits only."""
    t = F.regexp_replace(F.trim(F.upper(or_empty(c))), r"^(RFQ|RFP|ITB|IFB|SOL|NO\.?|#)[\s:#-]*", "")
    return F.regexp_replace(t, "[^A-Z0-9]", "")


def canonical_key(sol: Column, link: Column, post: Column, country: Column, platform: Column) -> Column:
    """A distinctive reference stands for itself; a short or numeric one is qualified by who
    issued it and by its kind; without a reference the link is the key."""
    base = reference_base(sol)
    kind = F.upper(F.regexp_extract(F.trim(or_empty(sol)), r"(?i)^(RFQ|RFP|ITB|IFB|SOL)\b", 1))
    filled = [F.nullif(reference_base(c), F.lit("")) for c in (post, country, platform)]
    weak = F.concat_ws(":", F.coalesce(*filled), F.nullif(kind, F.lit("")), base)
    return F.when(base == "", or_empty(link)).when((F.length(base) >= 7) & ~base.rlike(r"^\d{1,6}$"), base).otherwise(weak)


def previous_key(prev: Column) -> Column:
    """The key that a row had before, comparable with canonical keys. A link stays as it is, so
    that rows keyed by their link are found too."""
    p = or_empty(prev)
    base = reference_base(p)
    return F.when(p.rlike("(?i)^https?://"), p).when(base != "", base).otherwise(p)


def clean_reference(c: Column) -> Column:
    """The reference, or empty if it is a sentence, malformed or without a digit."""
    sol = F.trim(or_empty(c))
    tight = F.replace(sol, F.lit(" "), F.lit(""))
    bad = (F.length(sol) > 30) | ~tight.rlike(r"(?i)^[A-Z0-9][A-Z0-9\-/_.#]{4,}$") | ~tight.rlike("[0-9]")
    return F.when(bad, "").otherwise(sol)


def unit_hash(text: Column) -> Column:
    """16 hex digits of the first 4000 characters, white space collapsed."""
    flat = F.trim(F.regexp_replace(or_empty(text), "[ \t\n\r]+", " "))
    return F.substring(F.sha2(F.substring(flat, 1, 4000), 256), 1, 16)


def fingerprint(*fields: Column) -> Column:
    """16 hex digits over the fields that make a record what it is; missing ones are empty."""
    joined = F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    return F.substring(F.sha2(joined, 256), 1, 16)
