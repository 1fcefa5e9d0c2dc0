"""From pages and files to units, one notice each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import step, written
from ..functions.text import any_of, file_words, host, is_document, is_offsite, let, or_empty, reference, reference_marks
from .queue import ranked

# Fixed values -------------------------------------------------------------------------------------
HINTS = ("tender", "procure", "solicit", "rfq", "rfp", "itb", "bid", "quotation", "notice", "opportunit")
NOTICE_HINTS = ("notice", "tender", "rfq", "rfp", "itb", "eoi", "procurement", "solicitation", "bid", "opportunit", "award", "requisition")
LISTING_SOCIAL = ("facebook", "twitter", "x.com", "linkedin", "youtube")
SMELLS = ("solicitation", "rfq", "rfp", "itb", "ifb", "tender", "attachment", "amendment", "sow", "scope", "bid", "download", "annex", "document")
CHASED = ("pdf", "doc", "docx", "xls", "xlsx", "xlsm", "rtf", "txt", "csv", "odt", "ods", "zip", "ppt", "pptx")
PORTAL_NOTICE = r"(?i)https?://(?:www\.)?sam\.gov/opp/([0-9a-fA-F]{8,})"
#: How many of a kind are looked at, stage by stage.
CAPS = {"pages": (8, 4), "html": (15, 8), "files": (25, 12), "units": (12,), "blocks": (8,), "notices": (25, 10), "attachments": (15, 12, 8, 6)}
MAX_PAGES, MAX_DOCUMENTS, MAX_HTML, MAX_HOPS = CAPS["pages"][0], CAPS["files"][0], CAPS["html"][0], 3
NOTICE_TYPES, SEARCH_HOURS, SEARCH_LIMIT = ("o", "k", "r"), (14,), 60
LEAST_FILE_TEXT, LEAST_BLOCK, LEAD_BACK, LEAD_SHORT = 120, 200, 220, 80
# --------------------------------------------------------------------------------------------------


def absolute(base: Column, href: Column) -> Column:
    """A link's target as an absolute URL: absolute ones stay; //host, /path, ?query and relative
    ones are completed from the base, dot segments resolved."""
    scheme, authority = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    root = F.concat(scheme, F.lit("://"), authority)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "[^/]*$", "")).otherwise("/")
    h = F.trim(href)
    joined = (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h == "", base)
        .when(h.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h))
        .when(h.startswith("?"), F.concat(root, path, h))
        .otherwise(F.concat(root, folder, h))
    )
    for _ in range(4):  # a/b/../c: one level at a time
        joined = F.regexp_replace(joined, r"/(?!\.\./)[^/]+/\.\./", "/")
    return F.regexp_replace(joined, r"/\./", "/")


def links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One row per link of a page: its page's columns without the html, pos, href, anchor."""
    tag = r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(tag), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(tag), F.lit(2)).alias("anchor"))
    out = pages.select(*[c for c in pages.columns if c != html], F.posexplode(both).alias("pos", "link"))
    words = F.trim(F.regexp_replace(F.regexp_replace(F.col("link.anchor"), "(?s)<[^>]+>", " "), r"\s+", " "))
    return out.select(*[c for c in out.columns if c != "link"], absolute(F.col(url), F.col("link.href")).alias("href"), words.alias("anchor"))


def procurement_pages(links_: DataFrame, hints: tuple[str, ...] = HINTS, most: int = MAX_PAGES) -> DataFrame:
    """The first links of each page that stay on its host, lead to no social site and mention a hint.
    Of pages that share a URL, links of one place are ordered by what they lead to."""
    hay = F.lower(F.concat_ws(" ", "href", "anchor"))
    good = (host(F.col("href")) == host(F.col("url"))) & ~is_offsite(F.col("href")) & any_of(hay, hints)
    first = links_.where(good).groupBy("url", "href").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("url").orderBy("pos", "href"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("url", "href", "rank")


def candidates(links_: DataFrame, hints: tuple[str, ...] = HINTS) -> DataFrame:
    """A page's links as documents or as pages worth reading, without repeats, in order, cut
    to the first of each kind."""
    kind = F.when(is_document(F.col("href"), F.lit("")), "document").when(any_of(F.lower(F.concat_ws(" ", "href", "anchor")), hints), "page")
    bare = F.regexp_replace("href", "#.*$", "")
    first = links_.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("url", "kind", bare.alias("href")).agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("url", "kind").orderBy("pos", "href"))
    most = F.when(F.col("kind") == "document", MAX_DOCUMENTS).otherwise(MAX_HTML)
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("url", "kind", "href", "rank")


def listed_notices(links_: DataFrame, hints: tuple[str, ...] = NOTICE_HINTS, most: int = CAPS["notices"][0]) -> DataFrame:
    """(url, href, title, rank): the first notices that a listing page leads to, each place once."""
    hay = F.lower(F.concat_ws(" ", "href", "anchor"))
    good = links_.where(any_of(hay, hints) & ~any_of(hay, LISTING_SOCIAL))
    first = good.groupBy("url", F.regexp_replace("href", "#.*$", "").alias("href")).agg(F.min(F.struct("pos", "anchor")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("url").orderBy("at.pos", "href"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("url", "href", F.substring(F.trim(or_empty(F.col("at.anchor"))), 1, 180).alias("title"), "rank")


def within_cap(items: DataFrame, group: str, order: str, kind: str, stage: int = 0) -> DataFrame:
    """The first items of each group, as many as a stage looks at, with their rank."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return items.withColumn("rank", rank).where(F.col("rank") <= CAPS[kind][stage])


def _walk(edges: DataFrame, hops: int) -> DataFrame:
    """(root, url, hop, document) along edges (from, to, document). Nothing leads on from a document.

    URLs are numbered once, the roots first and those of a host in a row, and leave the walk until its
    end. Which roots have come to a URL is a mask for each 64 of them; a hop moves masks along the
    links and joins them by OR, on the map side first, so what it shuffles are three numbers for each
    link and 64 roots at most, whatever is reached. Each hop is written, so the next starts from its
    rows; at the end only the rows that are asked for stay."""
    none = F.lit(0).cast("long")
    with step(edges.sparkSession) as keep:
        edges = written(edges, "walk-links")
        urls = edges.select(F.col("from").alias("url"), F.lit(True).alias("root")).unionByName(edges.select(F.col("to").alias("url"), F.lit(False).alias("root")))
        urls = ranked(urls.groupBy("url").agg(F.bool_or("root").alias("root")), [F.col("root").desc(), host(F.col("url")), F.col("url")], "id")
        urls = written(urls, "walk-urls")
        number = lambda url, id_: urls.select(F.col("url").alias(url), F.col("id").alias(id_))
        links_ = written(edges.join(number("from", "node"), "from").join(number("to", "next"), "to").select("node", "next", "document"), "walk-numbers")
        block, bit = F.shiftright("id", 6), F.col("id").bitwiseAND(F.lit(63)).cast("int")
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        front = urls.where("root").select(F.col("id").alias("node"), block.alias("block"), one.alias("new"), none.alias("papers"), F.lit(0).alias("hop"))
        seen, fronts = front.select("node", "block", "new"), [front]
        for hop in range(1, hops + 1):
            leads = F.col("new").bitwiseAND(F.bitwise_not("papers"))
            met = front.select("node", "block", leads.alias("go")).where("go != 0").join(links_, "node").groupBy(F.col("next").alias("node"), "block")
            met = met.agg(F.bit_or("go").alias("go"), F.coalesce(F.bit_or(F.when(F.col("document"), F.col("go"))), none).alias("papers"))
            before = seen.groupBy("node", "block").agg(F.bit_or("new").alias("before"))
            met = met.join(before, ["node", "block"], "left").withColumn("new", F.col("go").bitwiseAND(F.bitwise_not(F.coalesce("before", none))))
            front = written(met.where("new != 0").select("node", "block", "new", F.col("papers").bitwiseAND(F.col("new")).alias("papers"), F.lit(hop).alias("hop")), "walk-front")
            seen = seen.unionByName(front.select("node", "block", "new"))
            fronts.append(front)
        reached = reduce(DataFrame.unionByName, fronts)
        has = lambda mask, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1
        each = reached.select("node", "block", "papers", "hop", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: has(F.col("new"), i))).alias("bit"))
        each = each.select("node", (F.col("block") * 64 + F.col("bit")).alias("root_id"), "hop", has(F.col("papers"), F.col("bit")).alias("document"))
        return keep(each.join(number("url", "node"), "node").join(number("root", "root_id"), "root_id").select("root", "url", "hop", "document"), "walk")


def reach(links_: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(root, url, hop): what is reached from each page along links within its host in at most
    `hops` steps, each place once, at its fewest steps."""
    edges = links_.where(host(F.col("href")) == host(F.col("url"))).select(F.col("url").alias("from"), F.col("href").alias("to"), F.lit(False).alias("document")).distinct()
    return _walk(edges, hops).drop("document")


def chase(links_: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(root, url, hop, document): where the notice behind each page may be. Documents are always
    followed, wherever they lie but on social sites, pages within the host if the link speaks of one."""
    document = F.substring_index(F.lower("href"), "?", 1).rlike(rf"\.({'|'.join(CHASED)})$")
    speaks = any_of(F.lower(F.concat_ws(" ", "href", "anchor")), SMELLS)
    good = links_.withColumn("document", document).where(~is_offsite(F.col("href")) & (F.col("document") | ((host(F.col("href")) == host(F.col("url"))) & speaks)))
    to = F.when(F.col("document"), F.col("href")).otherwise(F.regexp_replace("href", "#.*$", ""))
    return _walk(good.select(F.col("url").alias("from"), to.alias("to"), "document").distinct(), hops)


def redirects(reached: DataFrame, pages: DataFrame, html: str = "html") -> DataFrame:
    """(root, notice_id): the notice of the portal that the first page reached (root, url, hop)
    which names one leads to."""
    named = pages.select("url", F.regexp_extract(or_empty(F.col(html)), PORTAL_NOTICE, 1).alias("notice_id")).where("notice_id != ''")
    first = reached.join(named, "url").groupBy("root").agg(F.min(F.struct("hop", "url", "notice_id")).alias("first"))
    return first.select("root", "first.notice_id")


def _lead(text: Column, pos: Column) -> Column:
    """Where the block of a reference at pos starts: at the heading lines above it, at most LEAD_BACK
    back. Only what stands so near is looked at."""
    look = F.least(pos, F.lit(LEAD_BACK + 1))
    near = F.substring(text, pos - look + 1, look)
    first = F.instr(text, "\n") - 1  # -1: no line feed at all
    above = lambda w, k: pos - F.length(F.substring_index(w, "\n", -k)) - 1  # noqa: E731  the k-th feed up

    def start(w: Column) -> Column:
        feeds = F.length(w) - F.length(F.replace(w, F.lit("\n"), F.lit("")))
        further = (first >= 0) & (first < pos - look)
        two, three = above(w, 2), above(w, 3)
        higher = (two > 0) & (pos - two < LEAD_SHORT) & (feeds >= 3) & (pos - three <= LEAD_BACK)
        line = F.when(feeds >= 2, F.when(higher, three).otherwise(two)).when(further, F.lit(0)).when(feeds == 1, above(w, 1)).otherwise(-1)
        return F.when(line < 0, 0).otherwise(F.greatest(line, pos - LEAD_BACK, F.lit(0)))

    return let(near, start)


def split_listing(pages: DataFrame, text: str = "text", least: int = LEAST_BLOCK) -> DataFrame:
    """One row per notice of a page that lists two or more: its columns, sol and block. A block
    runs from its heading, never reaching the reference before it, to the next reference."""
    body = F.col(text)

    def blocks(marks: Column) -> Column:
        def cut(m: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(marks, i - 1)["start"] + 1).otherwise(0)
            end = F.coalesce(F.get(marks, i + 1)["start"], F.length(body))
            block = let(F.greatest(_lead(body, m["start"]), before), lambda s: F.btrim(F.substring(body, s + 1, F.greatest(s + least, end) - s), F.lit(" \t\n\u000b\f\r")))
            return F.struct(m["value"].alias("sol"), block.alias("block"))

        return F.when(F.size(marks) >= 2, F.transform(marks, cut))

    # Blocks are cut before they are rows, so that no row but the result's holds the page.
    each = pages.select(*pages.columns, F.explode(let(reference_marks(body), blocks)).alias("__b"))
    return each.select(*pages.columns, "__b.sol", "__b.block").where(F.length("block") >= least)


def file_rows(files: DataFrame, url: str = "url", text: str = "text", note: str = "note", order: str = "pos") -> DataFrame:
    """(key, sol, pos, url, text, ok, why) of loose files. A file belongs to the reference in its
    text, else in its name, else to itself; one with hardly any text isn't ok."""
    words = or_empty(F.col(text))
    # The name is searched only where the text has none, and once.
    sol = F.nullif(let(reference(words), lambda told: F.when(told != "", told).otherwise(reference(file_words(F.col(url))))), F.lit(""))
    ok = F.length(words) >= LEAST_FILE_TEXT
    said = F.when(~ok, F.coalesce(F.nullif(F.col(note), F.lit("")), F.lit("no readable text in this file"))).otherwise(F.nullif(F.col(note), F.lit("")))
    return files.select(F.coalesce(sol, F.col(url)).alias("key"), sol.alias("sol"), F.col(order).alias("pos"), F.col(url).alias("url"), words.alias("text"), ok.alias("ok"), said.alias("why"))


def file_counts(rows: DataFrame) -> DataFrame:
    """A16 of file_rows without their texts: (key, sol, ok, fail, n_text), however many files a notice has."""
    length = F.length("url") + F.length("text") + 16
    return rows.groupBy("key").agg(F.first("sol").alias("sol"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail"), F.coalesce(F.sum(F.when(F.col("ok"), length + 2)) - 2, F.lit(0)).alias("n_text"))


def group_files(files: DataFrame, url: str = "url", text: str = "text", note: str = "note", order: str = "pos") -> DataFrame:
    """One row per notice of a set of loose files: sol, text, files, ok, fail, notes. The
    texts of a notice are joined in order, so its row is as large as they are; where that may be too
    much, file_rows and file_counts give the same as rows and numbers."""
    f = file_rows(files, url, text, note, order)
    listed = F.sort_array(F.collect_list(F.struct("pos", "url", "text", "ok", "why")))
    g = f.groupBy("key").agg(F.first("sol").alias("sol"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail"), listed.alias("all"))
    good = F.filter("all", lambda x: x["ok"])
    return g.select(
        "key", "sol", "ok", "fail",
        F.array_join(F.transform(good, lambda x: F.concat(F.lit("\n[ATTACHMENT: "), x["url"], F.lit("]\n"), x["text"])), "\n\n").alias("text"),
        F.transform(good, lambda x: x["url"]).alias("files"),
        F.transform(F.filter("all", lambda x: x["why"].isNotNull()), lambda x: F.struct(x["url"].alias("file"), x["why"].alias("why"))).alias("notes"),
    )


def with_attachments(units: DataFrame, documents: DataFrame, most: int) -> DataFrame:
    """Units (key, text, attachments) with the texts of their first attachments appended; an
    attachment without a document counts as unread."""
    each = units.select("key", F.posexplode(F.slice("attachments", 1, most)).alias("pos", "url"))
    read = each.join(documents.select("url", F.col("text").alias("doc")), "url", "left")
    parts = read.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "url", "doc"))).alias("parts"), F.count_if(or_empty(F.col("doc")) == "").alias("read_fail"))
    body = F.transform(F.filter("parts", lambda p: or_empty(p["doc"]) != ""), lambda p: F.concat(F.lit("[ATTACHMENT: "), p["url"], F.lit("]\n"), p["doc"]))
    joined = units.join(parts, "key", "left")
    return joined.withColumn("text", F.concat_ws("\n\n", "text", F.array_join(body, "\n\n"))).withColumn("read_fail", F.coalesce("read_fail", F.lit(0))).drop("parts")


def api_notices(notices: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Notices (JSON in `raw`) of the last days, one per id (rows without an id all stay),
    with country, code, state and ZIP read from whichever shape the place has."""
    v = F.col("__v")
    get = lambda path: F.try_variant_get(v, path, "string")
    is_object = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("OBJECT")
    place, country, state = "$.placeOfPerformance", "$.placeOfPerformance.country", "$.placeOfPerformance.state"
    named = lambda path, keys: F.when(F.coalesce(is_object(path), F.lit(False)), F.coalesce(*[get(f"{path}.{k}") for k in keys])).otherwise(get(path))
    df = notices.withColumn("__v", F.try_parse_json("raw")).select(
        "*", get("$.noticeId").alias("noticeId"), get("$.solicitationNumber").alias("sol"), get("$.title").alias("title"), get("$.postedDate").alias("posted"),
        F.when(F.coalesce(is_object(place), F.lit(False)), F.coalesce(named(country, ("name",)), get(f"{place}.countryName"))).otherwise(get(place)).alias("country"),
        F.coalesce(F.when(F.coalesce(is_object(country), F.lit(False)), get(f"{country}.code")).otherwise(get(country)), get(f"{place}.countryCode")).alias("country_code"),
        named(state, ("code", "name")).alias("state"), get(f"{place}.zip").alias("zip"),
    ).drop("__v")
    recent = df.where(F.col("posted").isNull() | F.try_to_date(F.substring("posted", 1, 10)).between(F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of).cast("date")))
    key = F.coalesce(F.nullif("noticeId", F.lit("")), F.nullif("sol", F.lit("")))
    keyed = recent.withColumn("__key", key)
    return keyed.where("__key IS NOT NULL").dropDuplicates(["__key"]).unionByName(keyed.where("__key IS NULL")).drop("__key")


def search_turn(notices: DataFrame, hour: int, shard: int, order: str = "pos", kinds: tuple[str, ...] = NOTICE_TYPES, hours: tuple[int, ...] = SEARCH_HOURS, limit: int = SEARCH_LIMIT) -> DataFrame:
    """What a run takes of the landed notices (ptype, country_code): only the first shard searches,
    only at some hours, a page of the wanted types and a page of the domestic ones; api_notices drops
    what stands on both."""
    wanted = notices.where(F.col("ptype").isin(*kinds) & F.lit(shard == 0 and (not hours or hour in hours)))
    page = lambda df: df.orderBy(order).limit(limit)
    return page(wanted).unionByName(page(wanted.where("country_code = 'US'")))


def notice_texts(ids: DataFrame, notices: DataFrame, pages: DataFrame, documents: DataFrame, most: int = 8) -> DataFrame:
    """Text and attachments of notices by id: title and description of the API's answer (id, title,
    description, attachments) with the texts of the first attachments, else the text of the public page
    (id, page). An id that neither knows has an empty text."""
    told = notices.select("id", F.concat_ws("\n\n", F.nullif("title", F.lit("")), F.nullif("description", F.lit(""))).alias("told"), "attachments")
    both = ids.select("id").distinct().join(told, "id", "left").join(pages.select("id", "page"), "id", "left")
    text = F.coalesce(F.nullif("told", F.lit("")), F.col("page"), F.lit(""))
    units = both.select(F.col("id").alias("key"), text.alias("text"), F.coalesce("attachments", F.array().cast("array<string>")).alias("attachments"))
    return with_attachments(units, documents, most).withColumnRenamed("key", "id")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items (url, href, ...) of a later snapshot that the earlier one lacks."""
    return after.join(before.select("url", "href").distinct(), ["url", "href"], "left_anti")
