"""What pages showed over many snapshots, as intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def presence(items: DataFrame, snapshots: DataFrame, page: str = "url", item: str = "href", at: str = "at") -> DataFrame:
    """A row for each stay of an item on a page: page, item, stay (1 when it was new, more when it came
    back), first_seen, last_seen, n_seen and gone_at, the first snapshot without it, NULL while it stays.

    items holds what each snapshot showed (repeats count once); snapshots all that were taken (page,
    at), also those that showed nothing: a page that wasn't looked at breaks no stay. Snapshots of a
    page are numbered, and an item's numbers that follow each other are a stay."""
    of_page, of_item = Window.partitionBy(page).orderBy(at), Window.partitionBy(page, item).orderBy("number")
    taken = snapshots.select(page, at).distinct().withColumns({"number": F.row_number().over(of_page), "next_at": F.lead(at).over(of_page)})
    shown = items.select(page, item, at).distinct().join(taken, [page, at])
    stays = shown.withColumn("island", F.col("number") - F.row_number().over(of_item)).groupBy(page, item, "island")
    stays = stays.agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("n_seen"), F.max_by("next_at", "number").alias("gone_at"))
    stay = F.row_number().over(Window.partitionBy(page, item).orderBy("first_seen"))
    return stays.select(page, item, stay.alias("stay"), "first_seen", "last_seen", "n_seen", "gone_at")


def versions(texts: DataFrame, page: str = "url", value: str = "text_hash", at: str = "at") -> DataFrame:
    """A row for each version of a page: page, version from 1, value, since, last_seen, n_seen and
    replaced_at, NULL for the last. Snapshots in a row that equal in value are one version; a value that
    comes back later is a version of its own. Of several values at one moment the least counts."""
    one = texts.groupBy(page, at).agg(F.min(value).alias(value))
    over = Window.partitionBy(page).orderBy(at)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(over)) | (F.row_number().over(over) == 1)
    runs = one.withColumn("new", changed.cast("int")).withColumn("version", F.sum("new").over(over)).groupBy(page, "version")
    runs = runs.agg(F.first(value).alias(value), F.min(at).alias("since"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("n_seen"))
    return runs.withColumn("replaced_at", F.lead("since").over(Window.partitionBy(page).orderBy("version")))
