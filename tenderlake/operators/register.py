"""The register: rows, the merge of copies from several workers, archiving, operators' decisions
(P35, P36, K3-K7, J3-J8, U1-U8, U13, W7, A1, A2, F9, X1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import canonical_key, previous_key
from ..functions.text import any_of, let, or_empty
from .fold import CARRIED, CHANGED, DECIDING, PACKED, fold

# Fixed values -------------------------------------------------------------------------------------
INDEX_PATHS = ("/business", "/procurement", "/jobs", "/tenders", "/opportunities", "/doing-business")
NAV_TITLES = (
    "jump into the main content", "skip to main content", "doing business in", "procurement seminar", "business ready",
    "home page", "search results", "privacy policy", "contact us",
)
KNOWN_SITES = ("usembassy.gov", "sam.gov", "ungm.org", "undp.org", "iom.int", "ilo.org", "unicef.org")
DEAD_STATUS = ("cancelled", "canceled", "removed", "expired", "closed", "withdrawn", "awarded", "superseded", "dead")
# --------------------------------------------------------------------------------------------------

#: Columns of a register row that the operators below read; rows may hold more.
REGISTER = (
    "sol string, link string, title string, tier string, sector string, platform string, agency string, domestic boolean, post string, "
    "country string, source string, posted string, deadline string, qa string, status string, archived boolean, archivedOn string, "
    "updated string, lastDeepScan string, firstSeen string, changed string, verified string, verifyNotes array<string>, files array<string>, "
    "fileCount int, datesVerified boolean, citation struct<doc:string,quote:string>, restrictions array<struct<t:string,k:string,note:string>>, "
    "dateEvidence map<string,string>, dateProof map<string,string>, dateWarnings array<string>, datesSeen array<string>, value string, "
    "setaside string, samId string, estimate double, secondOpinion boolean, repairTries int, prevKey string, needs string, noDate boolean, "
    "deleted boolean, deletedOn string, hidden boolean, hiddenOn string, switched boolean, switchedOn string, unhiddenBecause string, notes string, fp string"
)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _filled(c: Column, kind: str) -> Column:
    """Missing means NULL, empty, zero or false."""
    if kind == "string":
        return or_empty(c) != ""
    if kind == "boolean":
        return _true(c)
    if kind.startswith("array") or kind.startswith("map"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if kind.startswith("struct"):
        return c.isNotNull()
    return F.coalesce(c != 0, F.lit(False))


def with_key(df: DataFrame) -> DataFrame:
    """Rows with their canonical key."""
    return df.withColumn("key", canonical_key(*[F.col(c) for c in ("sol", "link", "post", "country", "platform")]))


def richness(r: Column | None = None) -> Column:
    """How much a row holds."""
    at = (lambda c: r[c]) if r is not None else F.col
    return (
        F.when(at("verified") == "VERIFIED", 100).otherwise(0)
        + F.when(or_empty(at("deadline")) != "", 20).otherwise(0)
        + F.when(at("tier").isin("BID", "MID", "NO"), 15).otherwise(0)
        + F.least(F.coalesce(F.size(at("files")), F.lit(0)), F.lit(10))
        + F.when(at("citation").isNotNull(), 5).otherwise(0)
        + F.coalesce(F.size(at("restrictions")), F.lit(0))
    )


def stamp(r: Column | None = None) -> Column:
    """U4: when a row was last worked on; the strings compare as they are written."""
    at = (lambda c: r[c]) if r is not None else F.col
    return F.greatest(or_empty(at("lastDeepScan")), or_empty(at("updated")))


def _as_json(kind: T.DataType) -> bool:
    """Whether JSON gives values of a type back as they were."""
    if isinstance(kind, T.StructType):
        return all(_as_json(f.dataType) for f in kind.fields)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, T.StringType) and _as_json(kind.valueType)
    return _as_json(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.StringType, T.BooleanType, T.IntegerType, T.LongType, T.DoubleType))


def merge_copies(rows: DataFrame, order: list[str], deal: str = "key", slices: int = 1) -> DataFrame:
    """One row per canonical key, the copies folded from left to right in the given order (prior
    rows first, then worker by worker).

    The fold isn't associative, so the copies of a key meet in one task, sorted by it: rows are dealt
    by key, sorted within their partition and folded as they stream by. A row without a twin passes
    through; a key of any number of copies takes the memory of one batch and one row. Columns
    travel as one text of JSON; those of a type that JSON wouldn't give back as it was travel as they are,
    unless the fold reads them, which takes them as REGISTER types them. Copies that
    agree in the whole order fold in no fixed order. deal may name a column that follows from the key,
    by which rows are dealt instead, each of its values in slices by hash of the key; it isn't returned."""
    columns = [f for f in rows.schema if f.name not in (*order, "key", deal)]
    fields = T.StructType([T.StructField(f.name, f.dataType) for f in columns if f.name in (*DECIDING, *CHANGED) or _as_json(f.dataType)])
    plain = [f.name for f in columns if f.name not in fields.names]
    keyed = (rows if "key" in rows.columns else with_key(rows)).where("key != ''")
    # Each column of each row costs Spark time on its way to Python, so they go as one.
    narrow = keyed.select(*dict.fromkeys(("key", deal, *order)), F.to_json(F.struct(*fields.names)).alias(PACKED), *plain)
    dealt = (F.col(deal), F.pmod(F.xxhash64("key", F.lit("slice")), F.lit(slices))) if slices > 1 else (F.col(deal),)
    in_order = narrow.repartition(*dealt).sortWithinPartitions("key", *order).select("key", PACKED, *plain)
    merged = in_order.mapInArrow(fold, in_order.schema)
    # As a generator, so that a text is read once, whatever conditions on its columns follow.
    return merged.select("key", *plain, F.inline(F.array(F.from_json(PACKED, fields, {"mode": "FAILFAST"})))).select("key", *[f.name for f in columns])


def carry_previous(rows: DataFrame) -> DataFrame:
    """A row that names its previous key takes the operator's fields from the row that bears that
    key, and replaces it."""
    fields = [c for c in CARRIED if c in rows.columns and c != "verifyNotes"]
    prev = rows.where(or_empty(F.col("prevKey")) != "").select("key", previous_key(F.col("prevKey")).alias("old_key")).where("key != old_key")
    old = rows.select(F.col("key").alias("old_key"), *[F.col(c).alias(f"__{c}") for c in fields])
    carried = prev.join(old, "old_key").drop("old_key").dropDuplicates(["key"])
    kept = rows.join(prev.select(F.col("old_key").alias("key")), "key", "left_anti").join(carried, "key", "left")
    kinds = dict(rows.dtypes)
    return kept.select(*[(F.when(_filled(F.col(c), kinds[c]), F.col(c)).otherwise(F.coalesce(f"__{c}", c)).alias(c) if c in fields else F.col(c)) for c in rows.columns])


def is_junk() -> Column:
    """a row that never was a notice. Rows kept on purpose are none."""
    link = F.rtrim(F.substring_index(F.lower(or_empty(F.col("link"))), "?", 1), F.lit("/"))
    title, sol = F.trim(or_empty(F.col("title"))), F.trim(or_empty(F.col("sol")))
    named = (sol != "") & ~F.lower(sol).isin("none", "n/a", "-")
    due = or_empty(F.col("deadline")) != ""
    kept = (or_empty(F.col("needs")) != "") | _true(F.col("noDate")) | F.coalesce(F.size("datesSeen") > 0, F.lit(False))
    index = F.exists(F.array(*[F.lit(p) for p in INDEX_PATHS]), lambda p: F.endswith(link, p)) & ~named
    stranger = (link != "") & ~any_of(link, KNOWN_SITES) & ~named
    nav = any_of(F.lower(title), NAV_TITLES) & ~due
    empty = ((title == "") | title.startswith("(untitled")) & ~named & ~due
    return ~kept & (index | stranger | nav | empty)


def backfill(df: DataFrame) -> DataFrame:
    """Defaults on rows written before a field existed."""
    notes = F.array_compact(F.array(F.when(or_empty(F.col("deadline")) == "", F.lit("no closing date found")), F.when(F.col("tier") == "REVIEW", F.lit("not adjudicated"))))
    fresh = or_empty(F.col("verified")) == ""
    none = F.array().cast("array<string>")
    return df.withColumns({
        "platform": F.coalesce("platform", F.lit("USGOV")), "agency": or_empty(F.col("agency")), "sector": or_empty(F.col("sector")), "domestic": _true(F.col("domestic")),
        "fileCount": F.coalesce("fileCount", F.size(F.coalesce("files", none))), "files": F.coalesce("files", none),
        "verifyNotes": F.when(fresh, notes).otherwise(F.coalesce("verifyNotes", none)),
        "verified": F.when(~fresh, F.col("verified")).when(F.size(notes) == 0, "VERIFIED").otherwise("UNVERIFIED"),
    })


def archive(df: DataFrame, as_of: str) -> DataFrame:
    """K4: rows that are over are archived; a row once archived stays so."""
    status = F.lower(F.trim(or_empty(F.col("status"))))
    past = (or_empty(F.col("deadline")) != "") & (F.col("deadline") < as_of)
    over = F.coalesce(past, F.lit(False)) | status.isin(*DEAD_STATUS) | _true(F.col("archived"))
    return df.withColumns({
        "archived": over,
        "status": F.when(F.coalesce(past, F.lit(False)) & status.isin("active", "check", ""), "Expired").otherwise(F.col("status")),
        "archivedOn": F.when(over, F.coalesce("archivedOn", F.lit(as_of))).otherwise(F.col("archivedOn")),
    })


def latest_decisions(log: DataFrame) -> DataFrame:
    """K7: what an operator's log of actions (key, action, tier, on) comes to: per key whether it is
    deleted, hidden or switched, and since when. The latest action of each kind counts, of one moment
    the last by name; so the log may come in any order, as a table or as a stream."""
    kinds = {"deleted": ("delete", "restore"), "hidden": ("hide", "unhide"), "switched": ("switch", "clear")}
    latest = [F.max(F.when(F.col("action").isin(*pair), F.struct("on", "action", "tier"))).alias(kind) for kind, pair in kinds.items()]
    last = log.where(F.col("action").isin(*[a for pair in kinds.values() for a in pair])).groupBy("key").agg(*latest)
    stands = lambda kind, value: F.when(F.col(kind)["action"] == kinds[kind][0], value)
    on = lambda kind: stands(kind, F.col(kind)["on"]).alias(f"{kind}On")
    return last.select("key", on("deleted"), on("hidden"), on("switched"), stands("switched", F.upper(F.col("switched")["tier"])).alias("tier"))


def apply_operator(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """The operator's decisions (key, deletedOn, hiddenOn, switchedOn, tier) outrank the
    machine's. A row is found by its reference, else by its link. Deleted rows are archived; hidden
    ones that are over come out of hiding."""
    d = decisions.select(F.col("key").alias("__k"), F.col("deletedOn").alias("__del"), F.col("hiddenOn").alias("__hid"), F.col("switchedOn").alias("__sw"), F.col("tier").alias("__tier"))
    joined = df.withColumn("__k", F.coalesce(F.nullif("sol", F.lit("")), "link")).join(d, "__k", "left")
    gone, hidden = F.col("__del").isNotNull(), F.col("__hid").isNotNull() | _true(F.col("hidden"))
    switch = F.col("__sw").isNotNull() & F.coalesce(F.col("__tier").isin("BID", "MID", "NO", "REVIEW"), F.lit(False))
    archived, deleted = _true(F.col("archived")) | gone, _true(F.col("deleted")) | gone
    out_again = hidden & archived & ~deleted
    return joined.withColumns({
        "deletedOn": F.coalesce("__del", "deletedOn"), "hiddenOn": F.coalesce("__hid", "hiddenOn"), "switchedOn": F.when(switch, F.col("__sw")).otherwise(F.col("switchedOn")),
        "tier": F.when(switch, F.col("__tier")).otherwise(F.col("tier")), "switched": _true(F.col("switched")) | switch,
        "archived": archived, "deleted": deleted, "hidden": hidden & ~out_again,
        "unhiddenBecause": F.when(out_again, "expired or cancelled while hidden").otherwise(F.col("unhiddenBecause")),
    }).drop("__k", "__del", "__hid", "__sw", "__tier")


def tally(df: DataFrame) -> DataFrame:
    """A1, A2: one row of counts; each row counts as deleted, else hidden, else archived, else active."""
    bucket = F.when(_true(F.col("deleted")), "deleted").when(_true(F.col("hidden")), "hidden").when(_true(F.col("archived")), "archived").otherwise("active")
    active = bucket == "active"
    tier = or_empty(F.col("tier"))
    return df.agg(
        *[F.count_if(bucket == b).alias(b) for b in ("active", "archived", "deleted", "hidden")],
        *[F.count_if(active & (tier == t)).alias(t.lower()) for t in ("BID", "MID", "NO")],
        F.count_if(active & ~tier.isin("BID", "MID", "NO")).alias("review"),
        F.count_if(active & (or_empty(F.col("verified")) == "VERIFIED")).alias("verified"),
        F.count_if(active & (or_empty(F.col("verified")) != "VERIFIED")).alias("unverified"),
    )


def detect_changes(prior: DataFrame, fresh: DataFrame, as_of: str, key: str = "key") -> DataFrame:
    """The register after fresh rows came in: each key once, the fresh row where there is
    one, with `state` new, changed, same or kept, and firstSeen carried."""
    old = prior.select(key, F.col("fp").alias("__fp"), F.col("firstSeen").alias("__seen"))
    came = fresh.join(old, key, "left")
    state = F.when(F.col("__fp").isNull() & F.col("__seen").isNull(), "new").when(~F.col("__fp").eqNullSafe(F.col("fp")), "changed").otherwise("same")
    came = came.withColumns({"state": state, "firstSeen": F.coalesce("__seen", F.lit(as_of)), "changed": F.when(state == "changed", F.lit(as_of))})
    kept = prior.join(fresh.select(key), key, "left_anti").withColumn("state", F.lit("kept"))
    columns = [*[c for c in prior.columns if c in came.columns], "state"]
    return came.select(*columns).unionByName(kept.select(*columns), allowMissingColumns=True)


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in the other table (done-ledger, recovered hosts)."""
    return df.join(other.select(key), key, "left_anti")


def with_finished(ledger: DataFrame, finished: DataFrame) -> DataFrame:
    """The done-ledger with the hashes that a run finished, each once."""
    return ledger.select("hash").unionByName(finished.select("hash")).distinct()


def known_live(units: DataFrame, register: DataFrame, hint: str = "sol_hint") -> DataFrame:
    """Units with `known`: whether their reference is that of a verified row that isn't over."""
    plain = lambda c: F.upper(F.trim(or_empty(F.col(c))))
    live = register.where((or_empty(F.col("verified")) == "VERIFIED") & ~_true(F.col("archived"))).select(plain("sol").alias("__live")).where("__live != ''").distinct()
    return units.join(live, plain(hint) == F.col("__live"), "left").withColumn("known", F.col("__live").isNotNull()).drop("__live")


def adopted_references(old: DataFrame, again: DataFrame) -> DataFrame:
    """(key, sol, note) of the rows read again: the number that each may bear. A row that has one
    keeps it. One without adopts what was read only if no other row bears that number; of several that
    read the same free number the first key does. The rest stay without, with a note."""
    plain = lambda c: F.upper(F.trim(or_empty(F.col(c))))
    owners = old.where(plain("sol") != "").groupBy(plain("sol").alias("found")).agg(F.min("key").alias("owner"))
    read = again.select("key", plain("sol").alias("found")).join(old.select("key", F.col("sol").alias("own")), "key")
    bare = (or_empty(F.col("own")) == "") & (F.col("found") != "")
    first = read.where(bare).groupBy("found").agg(F.min("key").alias("first"))
    out = read.join(owners, "found", "left").join(first, "found", "left")
    taken = bare & (F.coalesce("owner", "first") != F.col("key"))
    note = F.concat(F.lit("re-scan read number "), F.col("found"), F.lit(", which belongs to another record"))
    return out.select("key", F.when(~bare, or_empty(F.col("own"))).when(taken, "").otherwise(F.col("found")).alias("sol"), F.when(taken, note).alias("note"))


def target_rows(register: DataFrame, want: str) -> DataFrame:
    """The rows that a reference or a link names."""
    is_it = lambda c: F.upper(F.trim(or_empty(F.col(c)))) == F.upper(F.trim(F.lit(want)))
    return register.where(is_it("sol") | is_it("link"))


def with_country_code(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows with the code of their country, by its name without blanks at the ends; codes has
    country and code, some names more than once."""
    named = codes.groupBy(F.trim("country").alias("__name")).agg(F.min("code").alias("country_code"))
    return rows.join(named, F.trim("country") == F.col("__name"), "left").drop("__name")


def cap_ledger(ledger: DataFrame, most: int = 8000, newest: str | None = None) -> DataFrame:
    """The done-ledger cut to size: the newest entries if there is a time, else the largest hashes."""
    order = [F.col(newest).desc()] if newest else []
    return ledger.orderBy(*order, F.col("hash").desc()).limit(most)


def first_per(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    named = df.where(or_empty(F.col(key).cast("string")) != "").withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    return named.unionByName(df.where(or_empty(F.col(key).cast("string")) == ""))


def to_rows(df: DataFrame, as_of: str) -> DataFrame:
    """Answers and units as register rows (reads closing, qa_due and the fields of the answer)."""
    past = (or_empty(F.col("deadline")) != "") & (F.col("deadline") < as_of)
    return df.withColumnsRenamed({"closing": "deadline", "qa_due": "qa", "est_value": "value"}).withColumns({
        "status": F.when(F.coalesce(past, F.lit(False)), "Expired").otherwise("Active"), "archived": F.coalesce(past, F.lit(False)),
        "sol": F.when(or_empty(F.col("sol")) != "", F.col("sol")).otherwise(or_empty(F.col("sol_hint"))), "updated": F.lit(as_of),
    })


def repaired(old: DataFrame, again: DataFrame, as_of: str, most_tries: int = 3) -> DataFrame:
    """K3: rows after a repair pass. again has key, result (success, dead, fail) and deadline: success
    takes the new deadline, dead archives as NO, fail counts and at most_tries says that it gave up."""
    joined = old.join(again.select("key", F.col("result").alias("__r"), F.col("deadline").alias("__d")), "key", "left")
    r, tries = F.col("__r"), F.coalesce("repairTries", F.lit(0)) + 1
    note = F.array(F.lit(f"re-scan {as_of}: gave up after {most_tries} tries"))
    return joined.withColumns({
        "deadline": F.when(r.isin("success", "dead"), F.col("__d")).otherwise(F.col("deadline")),
        "tier": F.when(r == "dead", "NO").otherwise(F.col("tier")), "archived": _true(F.col("archived")) | F.coalesce(r == "dead", F.lit(False)),
        "repairTries": F.when(r == "fail", tries).when(r == "success", 0).otherwise(F.col("repairTries")),
        "lastDeepScan": F.when(r.isNotNull(), F.lit(as_of)).otherwise(F.col("lastDeepScan")),
        "verifyNotes": F.when((r == "fail") & (tries >= most_tries), F.concat(F.coalesce("verifyNotes", F.array().cast("array<string>")), note)).otherwise(F.col("verifyNotes")),
    }).drop("__r", "__d")
