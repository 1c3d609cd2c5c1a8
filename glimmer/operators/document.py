"""The nested result of a video, and previews of long lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.operators.series import KEY


def truncated(items: Column, most: int = 10) -> Column:
    """(truncated, total_length, first_items, last_items): the whole list first where it has at most `most` items.

    Of a longer one the first most // 2 and the last most - most // 2 items.
    """
    head, tail = most // 2, most - most // 2
    long = F.size(items) > most
    return F.struct(
        long.alias("truncated"),
        F.size(items).cast("long").alias("total_length"),
        F.when(long, F.slice(items, 1, head)).otherwise(items).alias("first_items"),
        F.when(long, F.slice(items, -tail, tail)).otherwise(F.slice(items, 1, 0)).alias("last_items"),
    )


def listed(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """(video_id, name): a video's rows as one array of structs, in order."""
    columns = [c for c in rows.columns if c != KEY]
    packed = F.struct(F.struct(*order).alias("k"), F.struct(*columns).alias("v"))
    return rows.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["v"]).alias(name))


def document(videos: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """(video_id, video_info, a column per section). A section is (video_id, one column) and null where it has no row.

    Videos and sections are one union, brought together by one aggregate, not joined one by one.
    """
    info = F.struct(F.coalesce("duration", F.lit(0.0)).alias("duration_seconds"), F.coalesce("fps", F.lit(0.0)).alias("fps"), F.coalesce("file_size_bytes", F.lit(0).cast("long")).alias("file_size_bytes"))
    parts = {"video_info": videos.select(KEY, info.alias("video_info"))}
    for name, rows in sections.items():
        (value,) = [c for c in rows.columns if c != KEY]
        parts[name] = rows.select(KEY, F.col(value).alias(name))
    kinds = {name: rows.schema[name].dataType for name, rows in parts.items()}
    together = None
    for name, rows in parts.items():
        own = rows.select(KEY, *[F.col(c).alias(c) if c == name else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])
        together = own if together is None else together.unionByName(own)
    return together.groupBy(KEY).agg(*[F.first(c, ignorenulls=True).alias(c) for c in kinds]).where(F.col("video_info").isNotNull())


def as_json(documents: DataFrame) -> DataFrame:
    """(video_id, json)."""
    return documents.select(KEY, F.to_json(F.struct(*[c for c in documents.columns if c != KEY])).alias("json"))
