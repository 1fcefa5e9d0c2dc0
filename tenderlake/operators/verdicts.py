"""Readers' answers as an untrusted table: typed, grounded in the source, gated
(P24, P25, P37, D10-D14, F4-F8, F13, K1, K2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import proof
from ..functions.text import json_body, let, or_empty, strip_chrome

TIERS = ("BID", "MID", "NO", "REVIEW")
SECTORS = ("COTS", "SERVICES", "CONSTRUCTION", "MIXED")
NO_CLOSING = "[no-closing]"
BODY, EVIDENCE, SHOWN, LEAST_READABLE = 18000, 1500, 600, 180
# Clauses on registration, which never hold a notice back.
REGISTRATION = (
    r"(?i)\b(sam\.gov|system for award management|far\s*52\.204-7|unique entity (id|identifier)"
    r"|uei\b|cage code|ncage|duns|vendor (portal )?registration|register(ed)? in sam)\b"
)
#: Text fields of an answer and the most characters kept of each.
TEXT_FIELDS = {
    "brief": 300, "submit_how": 240, "submit_to": 160, "award_basis": 120, "title": 200, "sol": 60, "posted": 10, "closing": 10,
    "qa_due": 10, "closing_quote": 400, "posted_quote": 400, "qa_quote": 400, "classification": 80, "scope": 160, "est_value": 60,
    "shipping": 80, "payment": 80, "ship_after": 60, "setaside": 60, "license": 80, "route": 600, "challenge_draft": 900,
}
#: List fields: most characters of an element, most elements.
LIST_FIELDS = {"line_items": (120, 20), "submit_forms": (90, 12), "gotchas": (180, 8), "docs": (80, 12)}
# --------------------------------------------------------------------------------------------------


def reader_texts(text: Column) -> Column:
    """(body, evidence, shown, readable) of a notice: what a reader is given, what is kept of it as
    evidence and shown in the register, and whether there is enough to judge."""
    whole = F.regexp_replace(strip_chrome(text), r"[ \t\n\x0B\f\r]+", " ")
    cut = lambda w, n: F.substring(w, 1, n)
    return let(whole, lambda w: F.struct(cut(w, BODY).alias("body"), cut(w, EVIDENCE).alias("evidence"), cut(w, SHOWN).alias("shown"), (F.length(w) >= LEAST_READABLE).alias("readable")))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def coerce(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Df with a typed column per field of an answer, cut to length, unknown values replaced;
    `malformed` where the answer is no JSON object. Nothing in an answer can fail the query."""
    v = F.try_parse_json(json_body(F.col(raw)))
    df = df.withColumn("__v", v)
    v = F.col("__v")
    out = {k: F.substring(or_empty(_get(v, k, "string")), 1, n) for k, n in TEXT_FIELDS.items()}
    for k, (n, most) in LIST_FIELDS.items():
        items = F.coalesce(_get(v, k, "array<string>"), F.array().cast("array<string>"))
        out[k] = F.slice(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x, n=n: F.substring(x, 1, n)), 1, most)
    sector, tier = F.upper(F.trim(or_empty(_get(v, "sector", "string")))), F.upper(or_empty(_get(v, "tier", "string")))
    restrictions = F.coalesce(_get(v, "restrictions", "array<struct<text:string,kind:string,note:string>>"), F.array().cast("array<struct<text:string,kind:string,note:string>>"))
    kind = lambda x: F.when(F.lower(x["kind"]).isin("real", "boiler", "fix"), F.lower(x["kind"])).otherwise("real")
    quote = _get(v, "citation.quote", "string")
    out |= {
        "sol": F.upper(out["sol"]),
        "sector": F.when(sector.isin(*SECTORS), sector).otherwise(""),
        "tier": F.when(tier.isin(*TIERS), tier).otherwise("REVIEW"),
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_get(v, "confidence", "double"), F.lit(0.0)))),
        "restrictions": F.slice(F.transform(restrictions, lambda x: F.struct(F.substring(or_empty(x["text"]), 1, 200).alias("t"), kind(x).alias("k"), F.substring(or_empty(x["note"]), 1, 300).alias("note"))), 1, 6),
        "citation": F.when(or_empty(quote) != "", F.struct(F.substring(or_empty(_get(v, "citation.doc", "string")), 1, 160).alias("doc"), F.substring(quote, 1, 400).alias("quote"))),
        "malformed": v.isNull(),
    }
    return df.withColumns(out).drop("__v")


def strip_registration(df: DataFrame) -> DataFrame:
    """Registration clauses go from restrictions, gotchas and texts; what only they held back is
    released: MID becomes BID, and NO without another reason REVIEW."""
    hit = lambda c: c.rlike(REGISTRATION)
    sentences = lambda c: F.array_join(F.filter(F.transform(F.split(c, r"(?<=[.;])\s+"), F.trim), lambda s: (s != "") & ~hit(s)), " ")
    kept = F.filter("restrictions", lambda r: ~hit(r["t"]))
    removed = (F.size("restrictions") > F.size(kept)) | hit(F.col("license")) | hit(F.col("route")) | hit(F.col("challenge_draft"))
    out = df.withColumn("__removed", removed).withColumn("restrictions", kept).withColumn("gotchas", F.filter("gotchas", lambda g: ~hit(g)))
    out = out.withColumns({c: F.when(hit(F.col(c)), sentences(F.col(c))).otherwise(F.col(c)) for c in ("license", "route", "challenge_draft")})
    free = F.col("__removed") & (F.col("tier") == "MID") & ~F.exists("restrictions", lambda r: r["k"] == "real") & (F.trim("route") == "")
    only = (F.col("tier") == "NO") & F.coalesce(hit(F.col("citation.quote")), F.lit(False))
    return out.withColumns({
        "tier": F.when(free, "BID").when(only, "REVIEW").otherwise(F.col("tier")),
        "citation": F.when(~only, F.col("citation")),
        "review_reason": F.when(only, "no-bid rested only on a registration clause").otherwise(""),
        "promoted": free,
    }).drop("__removed")


def ground_dates(df: DataFrame, text: str = "text", compat_autojunk: bool = False, hits: str | None = None) -> DataFrame:
    """Closing, posted and qa_due only as far as the source proves them.

    A date stands if the quote given for it stands in the text and holds the date; or, lower, if the
    text anchors it: the closing date by a deadline cue, the others by being printed. A closing date
    is never filled in; the other two may be, by the nearest date after a cue. Added columns:
    date_proof and date_evidence (maps), dropped (list), date_warnings (list).

    hits: the column with the text's dates (D.scan_dates), where they have been scanned already."""
    fields = {"closing": ("closing_quote", D.DEADLINE_CUES), "posted": ("posted_quote", D.POSTED_CUES), "qa_due": ("qa_quote", D.QUESTION_CUES)}
    df = proof.with_citation_proofs(df, {f"__real_{field}": quote for field, (quote, _) in fields.items()}, text, compat_autojunk)

    def facts(hits: Column) -> Column:
        out = {"hits": hits}
        for field, (quote, cues) in fields.items():
            beside = D.anchored_evidence if field == "closing" else D.date_evidence
            places = (cues,) if field == "closing" else ()
            printed = F.transform(hits, lambda h: h["iso"])
            out[f"why_{field}"] = proof.quoted_date(F.col(field), F.col(quote), F.col(f"__real_{field}"), F.when(F.col(quote) == F.col(text), printed).otherwise(D.find_dates(F.col(quote))), printed)
            out[f"beside_{field}"] = beside(F.col(field), F.col(text), hits, *places)
            out[f"near_{field}"] = F.lit(None).cast("string") if field == "closing" else D.nearest_after_cue(F.col(text), hits, cues)
        return F.struct(*[c.alias(k) for k, c in out.items()])

    # Computed once: as fields of one struct that is built inside a lambda.
    df = df.withColumn("__f", let(F.col(hits) if hits else D.scan_dates(F.col(text)), facts))
    added, proofs, evidence, dropped, warnings = {}, [], [], [], []
    for field, (quote, _) in fields.items():
        claim = F.col(field)
        why, beside, near = (F.col("__f")[f"{k}_{field}"] for k in ("why", "beside", "near"))
        given = or_empty(claim) != ""
        quoted = given & (why == "")
        phrase = given & ~quoted & beside.isNotNull()
        lost = given & ~quoted & ~phrase
        filled = F.when(~given | lost, near)
        added[f"__{field}"] = F.when(quoted | phrase, claim).otherwise(or_empty(filled))
        how = F.when(quoted, "quoted").when(phrase | filled.isNotNull(), "phrase")
        words = F.when(quoted, F.substring(F.trim(F.regexp_replace(F.col(quote), r"\s+", " ")), 1, 300)).when(phrase, beside).otherwise(D.date_evidence(filled, F.col(text), F.col("__f")["hits"]))
        proofs.append(F.struct(F.lit(field).alias("key"), how.alias("value")))
        evidence.append(F.struct(F.lit(field).alias("key"), words.alias("value")))
        dropped.append(F.when(lost, F.lit(field)))
        altered = phrase & (F.trim(or_empty(F.col(quote))) != "")
        warnings += [F.when(altered, F.concat(F.lit(f"{field} "), claim, F.lit(" kept on phrase-matching alone: "), why)), F.when(lost, F.concat(F.lit(f"{field} "), claim, F.lit(" was discarded: "), why))]
    as_map = lambda pairs: F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
    df = df.withColumns(added | {"date_proof": as_map(proofs), "date_evidence": as_map(evidence), "dropped": F.array_compact(F.array(*dropped)), "date_warnings": F.array_compact(F.array(*warnings))})
    late = (F.col("__closing") != "") & (F.col("__posted") != "") & (F.col("__closing") < F.col("__posted"))
    clash = F.when(late, F.array(F.concat(F.lit("the closing date "), F.col("__closing"), F.lit(" is before the posted date "), F.col("__posted"))))
    df = df.withColumn("date_warnings", F.concat("date_warnings", F.coalesce(clash, F.array().cast("array<string>"))))
    return df.withColumns({f: F.col(f"__{f}") for f in fields}).drop(*[c for c in df.columns if c.startswith("__")])


def title_deadline(title: Column, text: Column) -> Column:
    """A deadline from a title that says so: its first date that the text prints too."""
    low = F.lower(or_empty(title))
    says = F.exists(F.array(*[F.lit(w) for w in D.TITLE_DEADLINE_WORDS]), lambda w: F.contains(low, w))
    printed = D.find_dates(text)
    return F.when(says, F.get(F.filter(D.find_dates(title), lambda d: F.array_contains(printed, d)), 0))


def mark_no_closing(df: DataFrame, as_of: str, text: str = "text") -> DataFrame:
    """Rows without a closing date say so, with the dates that were seen."""
    seen = F.array_sort(F.array_distinct(D.find_dates(F.col(text))))
    future = F.filter(seen, lambda d: d >= as_of)
    missing = or_empty(F.col("closing")) == ""
    note = F.concat(
        F.lit(f"{NO_CLOSING}: no line states a closing date"),
        F.when(F.size(future) > 0, F.concat(F.lit("; dates that belong to something else: "), F.array_join(F.slice(future, 1, 4), ", "))).otherwise("; no future date appears"),
    )
    return df.withColumns({
        "dates_seen": F.when(missing, F.slice(seen, 1, 12)),
        "no_closing": missing,
        "date_warnings": F.when(missing, F.concat("date_warnings", F.array(note))).otherwise(F.col("date_warnings")),
        "needs": F.when(missing, "a deadline"),
    })


def retract_no_closing(df: DataFrame, gate: str = "gate_closing") -> DataFrame:
    """A date that the gate proved outranks the adjudicator's, and takes back the finding
    that there is none."""
    proven = or_empty(F.col(gate)) != ""
    differs = proven & (or_empty(F.col("closing")) != "") & (F.col("closing") != F.col(gate))
    kept = F.filter("date_warnings", lambda w: ~w.startswith(NO_CLOSING))
    note = F.concat(F.lit("the adjudicator read "), F.col("closing"), F.lit("; the proven date "), F.col(gate), F.lit(" stands"))
    return df.withColumns({
        "date_warnings": F.when(differs, F.concat(kept, F.array(note))).when(proven, kept).otherwise(F.col("date_warnings")),
        "closing": F.when(proven, F.col(gate)).otherwise(F.col("closing")),
        "no_closing": F.col("no_closing") & ~proven,
        "dates_seen": F.when(~proven, F.col("dates_seen")),
        "needs": F.when(~proven, F.col("needs")),
    })


def closed_by_words(df: DataFrame, text: str = "text") -> DataFrame:
    """closed only if the words quoted for it really stand in the text."""
    df = proof.with_citation_proof(df, "status_quote", text, "__real")
    claimed = F.lower(or_empty(F.col("status"))).startswith("clos")
    real = claimed & (F.trim(or_empty(F.col("status_quote"))) != "") & F.col("__real")
    return df.withColumns({"status": F.when(real, "closed").otherwise("open"), "status_doubt": claimed & ~real}).drop("__real")


def tier_gates(df: DataFrame, quote_real: str = "quote_real", least_confidence: float = 0.5) -> DataFrame:
    """a NO needs a real quote that excludes someone, else it is MID where a local partner can
    help and REVIEW where not; below the least confidence every decision is REVIEW."""
    quote = F.col("citation.quote")
    test = proof.citation_excludes(quote)
    no = F.col("tier") == "NO"
    fake, weak = no & ~F.coalesce(F.col(quote_real), F.lit(False)), no & F.coalesce(F.col(quote_real), F.lit(False)) & ~test["ok"]
    local = weak & ((test["why"] == "local firm") | quote.rlike(proof.LOCALITY))
    tier = F.when(fake, "REVIEW").when(local, "MID").when(weak, "REVIEW").otherwise(F.col("tier"))
    reason = F.when(fake, "no-bid rejected: cited clause not found").when(weak, F.concat(F.lit("no-bid rejected: "), test["why"])).otherwise(or_empty(F.col("review_reason")))
    df = df.withColumns({
        "__tier": tier, "review_reason": reason, "overturned": F.when(weak, test["why"]), "citation": F.when(~(fake | weak), F.col("citation")),
        "route": F.when(local & (F.trim(or_empty(F.col("route"))) == ""), "Engage a locally licensed partner").otherwise(F.col("route")),
    })
    low = F.col("__tier").isin("BID", "MID", "NO") & (F.col("confidence") < least_confidence)
    return df.withColumns({
        "review_reason": F.when(low & (F.col("review_reason") == ""), F.concat(F.lit("low confidence ("), F.format_string("%.2f", "confidence"), F.lit(")"))).otherwise(F.col("review_reason")),
        "tier": F.when(low, "REVIEW").otherwise(F.col("__tier")),
    }).drop("__tier")


def second_opinion(df: DataFrame, review: DataFrame, key: str = "unit_hash") -> DataFrame:
    """a second reader's answer (upheld, review_tier, review_why, review_route) on refusals: one
    that isn't upheld is lifted."""
    joined = df.join(review.select(key, "upheld", "review_tier", "review_why", "review_route"), key, "left")
    lifted = (F.col("tier") == "NO") & (F.col("upheld") == F.lit(False))
    lifted = F.coalesce(lifted, F.lit(False))
    new = F.when(F.upper("review_tier").isin("BID", "MID", "REVIEW"), F.upper("review_tier")).otherwise("MID")
    return joined.withColumns({
        "overturned": F.when(lifted, F.coalesce(F.nullif("review_why", F.lit("")), F.lit("a second check found no clause that excludes"))).otherwise(F.col("overturned")),
        "citation": F.when(~lifted, F.col("citation")),
        "route": F.when(lifted & (or_empty(F.col("review_route")) != ""), F.substring("review_route", 1, 600)).otherwise(F.col("route")),
        "review_reason": F.when(lifted, "").otherwise(F.col("review_reason")),
        "tier": F.when(lifted, new).otherwise(F.col("tier")),
    }).drop("upheld", "review_tier", "review_why", "review_route")


def verification(read_fail: Column, closing: Column, evidence: Column, warnings: Column, title: Column, tier: Column, cited: Column) -> Column:
    """F8: (verified, reasons): VERIFIED only if there is nothing to object to."""
    has = or_empty(closing) != ""
    reasons = F.concat(
        F.array_compact(F.array(
            F.when(read_fail > 0, F.concat(read_fail.cast("string"), F.lit(" document(s) unreadable"))),
            F.when(~has, F.lit("no closing date stated in the notice")).when(or_empty(evidence) == "", F.lit("the closing date could not be traced")),
        )),
        F.coalesce(warnings, F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(or_empty(title) == "", F.lit("no title")), F.when(tier == "REVIEW", F.lit("not adjudicated")), F.when((tier == "NO") & ~cited, F.lit("no cited clause")),
        )),
    )
    return F.struct(F.when(F.size(reasons) == 0, "VERIFIED").otherwise("UNVERIFIED").alias("verified"), reasons.alias("reasons"))


def outcome(df: DataFrame, as_of: str, text: str = "text") -> DataFrame:
    """K1, K2: the stage at which each unit's way ends, cheapest test first, and what becomes of it:
    a row that is kept, an entry of the done-ledger, neither. Needs text, known (reference already
    verified), is_solicitation, status (after F4), closing (after D11), adjudicated."""
    stage = (
        F.when(F.length(F.trim(or_empty(F.col(text)))) < 180, "thin")
        .when(F.col("known"), "duplicate")
        .when(~F.col("is_solicitation"), "not_solicitation")
        .when(F.col("status") == "closed", "expired")
        .when(D.expired(F.nullif("closing", F.lit("")), F.lit(as_of)), "expired")
        .when(or_empty(F.col("closing")) == "", "no_date")
        .when(~F.col("adjudicated"), "abandoned")
        .otherwise("complete")
    )
    return df.withColumn("outcome", stage).withColumns({"makes_row": F.col("outcome").isin("expired", "no_date", "complete"), "settled": ~F.col("outcome").isin("abandoned", "no_date")})
