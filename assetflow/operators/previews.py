"""What each resource's previews are made of: strategy, inputs, places in a grid and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.functions.expressions import RASTER, extension, file_name, natural_key

# Sampled pictures at most and the grid's greatest side by type, what pictures of vectors and fonts end in, endings of names.
SAMPLED = {"tileset": (16, 4), "animation_sequence": (12, 0), "pack": (9, 3)}
VECTOR, FONT = ["svg"], ["ttf", "otf"]
SHEET, SEQUENCE, PACK, TYPEFACE, TILE, DIRECT, CARD = "_tileset.webp", "_sequence.gif", "_pack.webp", "_font.webp", "_tile_preview.webp", "_preview.webp", "_metadata.webp"


def sampled_pictures(files: DataFrame, limits: Column) -> DataFrame:
    """id, n (pictures) and inputs of each resource with raster pictures: at most limits of them, evenly spread with both ends, in natural order of their names.

    files: id, ord, path and what limits reads.  Pictures are ranked within a resource, not gathered; only those chosen are.
    """
    own = files.where(extension(F.col("path")).isin(RASTER)).withColumn("__most", limits)
    order = Window.partitionBy("id").orderBy(natural_key(file_name(F.col("path"))), "ord", "path")
    ranked = own.withColumns({"__r": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("id"))})
    step = (F.col("n") - 1) / (F.col("__most") - 1)
    chosen = (F.col("n") <= F.col("__most")) | F.exists(F.sequence(F.lit(0), F.col("__most") - 1), lambda i: F.bround(i * step) == F.col("__r"))
    kept = ranked.where(chosen).groupBy("id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("__r", "path"))).alias("inputs"))
    return kept.withColumn("inputs", F.transform("inputs", lambda x: x["path"]))


def preview_rows(resources: DataFrame, files: DataFrame) -> DataFrame:
    """The previews of each resource: id, role, strategy, mode, confidence, output (name), inputs, grid (cells a side, 0 without one) and cells (path, row, col).

    resources: id, resource_type, content_md5; files: id, ord, is_primary, path.  A tileset is a sheet of up to 16
    pictures and, as its gallery, the first of them; an animation of two pictures or more is a sequence of up to 12;
    a pack is a collage of up to 9.  A single picture or font is made from its primary file alone (the flagged one, else
    the first): a raster or a vector picture, or a font; a single picture of another kind falls back to a card.  All else,
    and what lacks its inputs, is a card of metadata.  Resources without files have a card; null types too.
    """
    kind = F.col("resource_type")
    types = resources.select("id", "resource_type", "content_md5")
    limits = F.coalesce(*(F.when(kind == k, F.lit(most)) for k, (most, _) in SAMPLED.items()))
    pictures = sampled_pictures(files.select("id", "ord", "path").join(types.where(kind.isin(list(SAMPLED))).select("id", "resource_type"), "id"), limits)
    first = files.groupBy("id").agg(F.min_by("path", F.struct(~F.coalesce("is_primary", F.lit(False)), "ord", "path")).alias("primary"))
    both = types.join(pictures, "id", "left").join(first, "id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "inputs": F.coalesce("inputs", F.array().cast("array<string>"))})
    ends, alone = extension(F.col("primary")), F.array("primary")

    def made(strategy: str, mode: str, confidence: str, ending: str, inputs: Column, most: int = 0, role: str = "primary") -> Column:
        grid = F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(F.sqrt(F.size(inputs))).cast("int"))) if most else F.lit(0)
        return F.struct(
            F.lit(role).alias("role"), F.lit(strategy).alias("strategy"), F.lit(mode).alias("mode"), F.lit(confidence).alias("confidence"), F.concat("content_md5", F.lit(ending)).alias("output"), inputs.alias("inputs"), grid.alias("grid"))

    none = F.array().cast("array<string>")
    card = lambda mode: made("static", mode, "low", CARD, none)
    main = (
        F.when((kind == "tileset") & (F.col("n") > 0), made("contact_sheet", "composed", "high", SHEET, F.col("inputs"), 4))
        .when((kind == "animation_sequence") & (F.col("n") > 1), made("gif", "composed", "high", SEQUENCE, F.col("inputs")))
        .when((kind == "pack") & (F.col("n") > 0), made("contact_sheet", "composed", "medium", PACK, F.col("inputs"), 3))
        .when((kind == "single_image") & ends.isin(RASTER), made("static", "direct", "high", DIRECT, alone))
        .when((kind == "single_image") & ends.isin(VECTOR), made("static", "direct", "medium", DIRECT, alone))
        .when((kind == "single_image") & F.col("primary").isNotNull(), card("fallback"))
        .when((kind == "font_file") & ends.isin(FONT), made("static", "composed", "medium", TYPEFACE, alone)).otherwise(card("metadata_only"))
    )
    tile = made("static", "direct", "medium", TILE, F.slice("inputs", 1, 1), role="gallery")
    rows = both.select("id", F.explode(F.when((kind == "tileset") & (F.col("n") > 0), F.array(main, tile)).otherwise(F.array(main))).alias("p")).select("id", "p.*")
    cells = F.transform(F.col("inputs"), lambda x, i: F.struct(x.alias("path"), F.floor(i / F.col("grid")).cast("int").alias("row"), (i % F.col("grid")).alias("col")))
    return rows.withColumn("cells", F.when(F.col("grid") > 0, F.filter(cells, lambda c: c["row"] < F.col("grid"))).otherwise(F.array().cast("array<struct<path: string, row: int, col: int>>")))


def with_roles(previews: DataFrame) -> DataFrame:
    """previews (place from 0, roles: those given with their upload, or null) with role: the given one at its place, else primary for the first and gallery for the rest."""
    given = F.get("roles", F.col("place").cast("int"))
    return previews.withColumn("role", F.coalesce(given, F.when(F.col("place") == 0, "primary").otherwise("gallery")))
