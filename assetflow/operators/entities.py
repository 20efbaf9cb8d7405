"""Resources of a catalogue: which are processed, their assets, packs, files and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from assetflow.functions.expressions import IMAGE, extension, file_name, merged, sanitized, stripped
from assetflow.streaming.progress import stored

from .registration import in_order


def matching(entries: DataFrame, kind: str = "", source: str = "", limit: int | None = None, order: str = "seq") -> DataFrame:
    """The catalogue's entries of a type and a source (trimmed, in any case; empty for all), in their order, with their number before the limit as `matching`.

    Of entries that share an id the first by `order` counts, before anything is filtered.  One pass over the
    entries observes the number while it writes the rows that are kept (with a limit no more than these) to the shared folder.
    """
    first = F.row_number().over(Window.partitionBy("id").orderBy(order))
    own = entries.withColumn("__n", first).where("__n = 1").drop("__n")
    for column, wanted in (("resource_type", kind), ("source", source)):
        if wanted.strip():
            own = own.where(F.lower(stripped(F.col(column))) == wanted.strip().lower())
    seen = Observation("matching")
    own = own.observe(seen, F.count(F.lit(1)).alias("n"))
    kept = stored(own if limit is None else own.orderBy(order).limit(limit), "matching")
    return kept.withColumn("matching", F.lit(seen.get["n"]).cast("bigint"))


def resolve_assets(entries: DataFrame, assets: DataFrame) -> DataFrame:
    """The assets of each entry: id and assets (array of asset_id, fmt, style, theme).

    entries: id, asset_ids, source, pack_name, file_paths; assets: asset_id, source, pack_name, file_path, fmt,
    style, theme.  Assets go by asset_ids in their order; only where none is known by (source, pack_name, path),
    in the paths' order, each asset once and one for each path: the smallest id not yet taken by an earlier path.
    """
    item = F.struct("asset_id", "fmt", "style", "theme")
    listed = entries.select("id", F.posexplode("asset_ids").alias("place", "asset_id")).join(assets.dropDuplicates(["asset_id"]), "asset_id")
    by_id = listed.groupBy("id").agg(in_order("place", item).alias("by_id"))
    bare = entries.join(by_id.select("id"), "id", "left_anti").select("id", "source", "pack_name", F.posexplode("file_paths").alias("place", "file_path"))
    met = bare.join(assets, ["source", "pack_name", "file_path"])
    # equal paths of an entry meet equal assets, so the n-th of them takes the n-th asset
    nth = F.dense_rank().over(Window.partitionBy("id", "file_path").orderBy("place"))
    which = F.dense_rank().over(Window.partitionBy("id", "file_path").orderBy("asset_id"))
    once = met.withColumns({"nth": nth, "which": which}).where("nth = which")
    by_path = once.groupBy("id").agg(in_order("place", item).alias("by_path"))
    out = entries.select("id").join(by_id, "id", "left").join(by_path, "id", "left")
    return out.select("id", F.coalesce("by_id", "by_path", F.array().cast("array<struct<asset_id: string, fmt: string, style: string, theme: string>>")).alias("assets"))


def with_packs(entries: DataFrame, packs: DataFrame) -> DataFrame:
    """The entries with description and tags completed from their packs.

    entries: source, pack_name, description, tags and further columns; packs: source, pack (name as file systems
    take it), description, tags.  An empty description is the pack's; the pack's tags follow the entry's, each once.
    """
    p = packs.select(F.col("source").alias("__source"), F.col("pack").alias("__pack"), F.col("description").alias("__description"), F.col("tags").alias("__tags"))
    joined = entries.join(p, (F.col("source") == F.col("__source")) & (sanitized(F.col("pack_name")) == F.col("__pack")), "left")
    none = F.array().cast("array<string>")
    return joined.withColumns({
        "description": F.coalesce(F.nullif("description", F.lit("")), "__description", F.lit("")),
        "tags": merged(F.coalesce("tags", none), F.coalesce("__tags", none)),
    }).drop("__source", "__pack", "__description", "__tags")


def preferred_path(resource_path: Column, paths: Column) -> Column:
    """The resource's own path if it has an extension, else its first file, else empty."""
    named = resource_path.rlike(r"(^|/)[^/]*[^/.][^/]*\.[^/.]+/*$")
    return F.when(F.coalesce(named, F.lit(False)), resource_path).otherwise(F.coalesce(F.get(paths, F.lit(0)), F.lit("")))


def file_roles(kind: Column, resource_path: Column, paths: Column) -> Column:
    """path, role and is_primary of each of a resource's files.

    Roles follow the resource's type, else the extension.  Primary is a file of the preferred name; without
    one the first file.  A picture is primary only by name where some file has it.
    """
    # Roles by type of resource.
    fixed = F.when(kind == "audio_file", "audio").when(kind == "font_file", "font").when(kind == "tileset", "tile").when(kind == "animation_sequence", "frame")
    preferred = F.lower(file_name(preferred_path(resource_path, paths)))
    named = lambda p: (F.lower(file_name(p)) == preferred) & (preferred != "")
    picture = lambda p: fixed.isNull() & extension(p).isin(IMAGE)
    some = F.exists(paths, named)

    def one(p: Column) -> Column:
        first = p == F.get(paths, F.lit(0))
        primary = named(p) | (first & ~(picture(p) & some))
        return F.struct(p.alias("path"), F.coalesce(fixed, F.when(picture(p), "main").otherwise("attachment")).alias("role"), primary.alias("is_primary"))

    return F.transform(paths, one)


def source_directory(paths: Column, resource_path: Column, pack: Column) -> Column:
    """The longest folder that holds all files; without files the resource's path, else its pack."""
    folders = F.transform(paths, lambda p: F.split(F.regexp_replace(p, r"/?[^/]*$", ""), "/"))
    # what the least and the greatest share, all share
    least, greatest = F.array_min(folders), F.array_max(folders)
    apart = F.array_position(F.zip_with(least, greatest, lambda a, b: a.eqNullSafe(b)), F.lit(False))
    common = F.when(apart == 0, least).otherwise(F.slice(least, F.lit(1), F.greatest(apart - 1, F.lit(0)).cast("int")))
    return F.when(F.size(paths) > 0, F.array_join(common, "/")).otherwise(F.coalesce(F.nullif(resource_path, F.lit("")), pack))


def reusable_previews(held: DataFrame, now: DataFrame, stored: DataFrame) -> DataFrame:
    """Whether each resource's previews may be used again: id, reusable.

    held: id, previews (array of paths), fingerprint; now: id, fingerprint; stored: path.  There must be previews,
    all of them stored, and the fingerprint must be what it was.
    """
    each = held.select("id", F.explode("previews").alias("path")).join(stored.select("path").distinct().withColumn("__there", F.lit(True)), "path", "left")
    whole = each.groupBy("id").agg(F.bool_and(F.coalesce("__there", F.lit(False))).alias("__whole"))
    same = held.join(now.select(F.col("id").alias("__id"), F.col("fingerprint").alias("__now")), F.col("id") == F.col("__id"), "left")
    out = same.join(whole, "id", "left")
    return out.select("id", (F.coalesce("__whole", F.lit(False)) & F.coalesce(F.col("fingerprint") == F.col("__now"), F.lit(False))).alias("reusable"))


def counters(resources: DataFrame, assets: DataFrame, *keys: str) -> DataFrame:
    """For each resource (id, asset_id; a row for each asset) how often each value of the keys occurs: id and an array of (value, n) for each key, in the values' order; blank ones don't count."""
    both = resources.join(assets, "asset_id")
    out = resources.select("id").distinct()
    for key in keys:
        n = both.where(stripped(F.col(key)) != "").groupBy("id", stripped(F.col(key)).alias("value")).agg(F.count("*").alias("n"))
        own = n.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias(key))
        out = out.join(own, "id", "left").withColumn(key, F.coalesce(key, F.array().cast("array<struct<value: string, n: bigint>>")))
    return out
