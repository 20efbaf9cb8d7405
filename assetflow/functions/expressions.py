"""Scalar expressions: names, paths, formats, roles, keys and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetflow.states import STATES

# Extensions by kind, canonical types and keywords of descriptions.
TYPES = [
    "pack", "atlas", "tiled_map", "tiled_tileset", "spine_skeleton", "dragonbones_skeleton", "other", "font_file", "audio_file", "tileset", "animation_sequence", "single_image",
]
IMAGE = ["png", "jpg", "jpeg", "gif", "webp", "bmp", "tif", "tiff", "svg"]
RASTER = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff"]
MODEL = ["fbx", "obj", "stl", "gltf", "glb"]
MODEL_TYPES = ["fbx", "obj", "gltf", "glb", "blend"]
TEXTURE = ["png", "jpg", "jpeg", "webp", "tga"]
MAIN, DETAIL = "主体", "细节"
KEYWORDS = {
    "image": ["图片", "图像", "image", "照片", "插画"],
    "3d_model": ["模型", "3D", "3d", "model", "mesh"],
    "design_file": ["设计", "design", "源文件", "画板"],
    "audio": ["音频", "audio", "音乐", "声音", "sound"],
    "font": ["字体", "font", "笔刷", "brush"],
}


def blank(c: Column) -> Column:
    """The text without white space at its ends; null where nothing is left."""
    return F.nullif(stripped(c), F.lit(""))


def type_filter(value: Column) -> Column:
    """A canonical resource type, or empty (no filter) for any other value."""
    kind = F.lower(stripped(value))
    return F.when(kind.isin(TYPES), kind).otherwise("")


def format_filter(values: Column) -> Column:
    """Formats as they are compared: trimmed, in lower case, without leading dots; blank ones dropped, each once."""
    given = F.filter(values, lambda v: stripped(v) != "")
    return F.array_distinct(F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda v: F.regexp_replace(F.lower(stripped(v)), r"^\.+", "")))


def text_field(record: Column, name: str) -> Column:
    """A text of a JSON record; empty where it is absent."""
    return F.coalesce(F.get_json_object(record, f"$.{name}"), F.lit(""))


def list_field(record: Column, name: str) -> Column:
    """A list of a JSON record as texts; empty where it is absent or no list."""
    return F.coalesce(F.from_json(F.get_json_object(record, f"$.{name}"), "array<string>"), F.array().cast("array<string>"))


def json_list(raw: Column) -> Column:
    """A JSON list as texts; empty where the text is null, blank, no JSON or no list."""
    listed = F.startswith(F.ltrim(raw), F.lit("["))
    return F.coalesce(F.from_json(F.when(listed, raw), "array<string>"), F.array().cast("array<string>"))


def count_field(record: Column, name: str, items: Column) -> Column:
    """A count of a JSON record; the number of items where it is absent or no whole number."""
    return F.coalesce(F.get_json_object(record, f"$.{name}").try_cast("bigint"), F.size(items).cast("bigint"))


def relative(path: Column, root: Column) -> Column:
    """The path as seen from root, with .. for each folder that leads out of it; both are taken as they are written."""
    here, own = F.split(F.regexp_replace(root, "/+$", ""), "/"), F.split(path, "/")
    most = F.least(F.size(here), F.size(own) - 1)
    apart = F.array_position(F.transform(F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0))), lambda i: F.get(here, i) != F.get(own, i)), F.lit(True)).cast("int")
    same = F.when(apart > 0, apart - 1).otherwise(most)
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(here) - same), F.slice(own, same + 1, F.size(own))), "/")


def sanitized(name: Column) -> Column:
    """A pack name with the characters that file systems refuse as underscores."""
    return F.translate(name, '<>:"/\\|?*', "_" * 9)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def asset_format(fmt: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(fmt, F.lit("")), extension(path))


def merged(*lists: Column) -> Column:
    """Trimmed, non-empty values of the lists in order, each once."""
    return F.array_distinct(F.filter(F.transform(F.concat(*lists), lambda x: stripped(x)), lambda x: x != ""))


def normal_path(path: Column) -> Column:
    """A path without empty and . segments, and with .. resolved."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(p == "..", a).otherwise(F.array_append(a, p))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def storage_category(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin("jpg", "jpeg", "png", "gif"), "images").when(ext.isin("obj", "fbx", "stl"), "models").otherwise("others")


def directory_role(path: Column) -> Column:
    ext, stem = extension(path), F.lower(F.regexp_replace(file_name(path), r"\.[^.]*$", ""))
    return F.when(ext.isin(MODEL), "model").when(ext.isin(TEXTURE) & stem.rlike("tex|diffuse|normal"), "texture").when(ext.isin(RASTER), "main").otherwise("attachment")


def catalog_role(kind: Column, path: Column) -> Column:
    by = {"audio_file": "audio", "font_file": "font", "tileset": "tile", "animation_sequence": "frame"}
    fixed = F.try_element_at(F.create_map(*(F.lit(x) for kv in by.items() for x in kv)), kind)
    return F.coalesce(fixed, F.when(extension(path).isin(IMAGE), "main").otherwise("attachment"))


def type_of_formats(formats: Column) -> Column:
    has = lambda known: F.arrays_overlap(F.transform(formats, F.lower), F.array(*map(F.lit, known)))
    return F.when(has(MODEL_TYPES), "model").when(has(IMAGE), "image").otherwise("other")


def label(title: Column, path: Column, md5: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(path, F.lit("")), F.substring(md5, 1, 12))


def idempotency_key(source_id: Column, md5: Column, path: Column, title: Column) -> Column:
    key = lambda kind, x: F.concat(F.lit(f"crawler-register:{kind}:"), x)
    return F.coalesce(key("src", F.substring(F.sha2(blank(source_id), 256), 1, 24)), key("md5", blank(md5)), key("path", blank(path)), key("title", blank(title)), F.lit(""))


def resume_key(source_id: Column, md5: Column, path: Column, title: Column) -> Column:
    """The first of the four that isn't empty, behind its kind; white space counts."""
    return F.coalesce(*(F.concat(F.lit(f"{k}:"), F.nullif(x, F.lit(""))) for k, x in (("source", source_id), ("md5", md5), ("path", path), ("title", title))), F.lit(""))


def state_ordinal(state: Column) -> Column:
    """Place of a state in pipeline order; -1 for others."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATES)), state), F.lit(0)) - 1, F.lit(-1))


def even_sample(items: Column, limit: int) -> Column:
    """At most limit items evenly spread with both ends, half-even rounding."""
    step = (F.size(items) - 1) / (limit - 1)
    return F.when(F.size(items) <= limit, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.get(items, F.bround(i * step).cast("int"))))


def natural_key(name: Column) -> Column:
    """Sort key of file names: digit runs compare as numbers and before text."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    bare = lambda r: F.regexp_replace(r, r"^0+(?=\d)", "")
    return F.transform(runs, lambda r: F.struct(F.when(r.rlike(r"^\d"), 0).otherwise(1).alias("kind"), F.when(r.rlike(r"^\d"), F.length(bare(r))).otherwise(0).alias("n"), F.when(r.rlike(r"^\d"), bare(r)).otherwise(r).alias("text")))


def json_text(x: Column) -> Column:
    """A text in quotes as JSON has it, other characters than ASCII's as they are."""
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    plain = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    codes = F.array(*(F.struct(F.lit(chr(i)).alias("c"), F.lit("\\" + short.get(i, f"u{i:04x}")).alias("e")) for i in range(32)))
    escaped = F.aggregate(codes, plain, lambda a, k: F.replace(a, k["c"], k["e"]))
    return F.concat(F.lit('"'), F.when(x.rlike(r"[\x00-\x1F]"), escaped).otherwise(plain), F.lit('"'))


def fingerprint(id_: Column, source: Column, pack: Column, kind: Column, path: Column, count: Column, paths: Column) -> Column:
    """MD5 of the seven fields as JSON with sorted keys, a space behind : and ,."""
    esc = json_text
    text = F.concat(
        F.lit('{"file_paths": ['), F.array_join(F.transform(paths, esc), ", "), F.lit('], "id": '), esc(id_), F.lit(', "member_count": '), count.cast("string"),
        F.lit(', "pack_name": '), esc(pack), F.lit(', "resource_path": '), esc(path), F.lit(', "resource_type": '), esc(kind), F.lit(', "source": '), esc(source), F.lit("}"))
    return F.md5(text)


#: White space as Python's str.split and str.strip know it.
SPACE = r"[\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def stripped(text: Column) -> Column:
    """The text without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"(?<!{SPACE}){SPACE}+$", "")


def cleaned(text: Column) -> Column:
    """The text with one blank for each run of white space and none at the ends; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, f"{SPACE}+", " ")), F.lit(""))


def message_text(content: Column) -> Column:
    """The text of a model's message: of a JSON list its parts' texts in lines, else the content itself."""
    parts = F.from_json(content, "array<struct<text: string>>")
    lines = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda x: x.isNotNull()), "\n")
    return F.when(F.ltrim(content).startswith("[") & parts.isNotNull(), stripped(lines)).otherwise(content)


def parsed_output(text: Column) -> tuple[Column, Column]:
    """(main, detail) of a model's output: what stands behind each prefix in the last line with it.

    Without that, main is the first line and detail the second one as it is, or main where there is none.
    """
    lines = F.split(stripped(text), "\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]")

    def part(prefix: str) -> Column:
        own = F.filter(F.transform(lines, stripped), lambda x: x.rlike(f"^{prefix}[：:]"))
        return F.nullif(stripped(F.regexp_replace(F.try_element_at(own, F.lit(-1)), f"^{prefix}[：:]", "")), F.lit(""))

    main = F.coalesce(part(MAIN), F.get(lines, 0), F.lit(""))
    return main, F.coalesce(part(DETAIL), F.get(lines, 1), main)


def _error(code: str, *message: Column | str) -> Column:
    text = F.concat(*(F.lit(m) if isinstance(m, str) else m.cast("string") for m in message))
    return F.struct(F.lit(code).alias("code"), text.alias("message"))


# Fixed values in the next three: codes and messages of the checks.
def format_error(text: Column) -> Column:
    """code and message where the text isn't two lines with the two prefixes; null where it is."""
    lines = F.split(stripped(text), "\n")
    begins = lambda i, prefix: F.startswith(F.get(lines, i), F.lit(f"{prefix}："))
    return (
        F.when(F.size(lines) != 2, _error("FORMAT_ERROR", "期望2行，实际", F.size(lines), "行"))
        .when(~begins(0, MAIN), _error("FORMAT_ERROR", f"第一行必须以'{MAIN}：'开头")).when(~begins(1, DETAIL), _error("FORMAT_ERROR", f"第二行必须以'{DETAIL}：'开头"))
    )


def length_error(text: Column, least: int = 100, most: int = 220) -> Column:
    """code and message where the text without prefixes and line ends is too short or too long."""
    n = F.char_length(F.regexp_replace(text, f"{MAIN}：|{DETAIL}：|\n", ""))
    return F.when(n < least, _error("TOO_SHORT", "描述字数 ", n, f" 不足最低 {least}")).when(n > most, _error("TOO_LONG", "描述字数 ", n, f" 超过上限 {most}"))


def keyword_error(text: Column, kind: Column) -> Column:
    """code and message where the text holds no keyword of its kind; kinds without keywords have none."""
    error = F.lit(None)
    for k, words in KEYWORDS.items():
        lacking = ~F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
        error = F.when((kind == k) & lacking, _error("MISSING_KEYWORD", f"描述中缺少资源类型关键词，期望包含 {words} 之一")).otherwise(error)
    return error


def description_error(text: Column, kind: Column) -> Column:
    """code and message of the first of the checks of format, length and keywords that fails."""
    return F.coalesce(format_error(text), length_error(text), keyword_error(text, kind))


# Labels of the context's lines in their order; texts, lists, counts and the ratio are left out when empty.
CONTEXT = [
    ("resource_type", "资源类型"), ("llm_input_type", "LLM输入模态"), ("title", "资源标题"), ("pack_name", "资源包"), ("resource_path", "资源路径"), ("source", "来源站点"), ("category", "来源分类"),
    ("source_tags", "来源标签"), ("source_description", "来源描述"), ("member_count", "成员文件数"), ("asset_formats", "文件格式分布"), ("preview_strategy", "预览策略"), ("preview_mode", "预览模式"),
    ("preview_confidence", "预览置信度"), ("missing_file_ratio", "缺失文件比例"),
]


def prompt_context(fields: dict[str, Column], more: Column | None = None) -> Column:
    """Labelled lines of a resource's fields (by the names of CONTEXT) for a prompt, then those of the map more.

    resource_type and preview_strategy always have a line; the other texts, the lists (joined by ", "),
    member_count and missing_file_ratio (two decimals) only if they aren't empty or zero.
    """
    def line(name: str, label: str) -> Column:
        x = fields[name]
        if name in ("source_tags", "asset_formats"):
            x = F.nullif(F.array_join(F.filter(x, lambda v: v != ""), ", "), F.lit(""))
        elif name == "missing_file_ratio":
            x = F.when(x != 0, F.format_string("%.2f", x))
        elif name == "member_count":
            x = F.when(x != 0, x.cast("string"))
        elif name not in ("resource_type", "preview_strategy"):
            x = F.nullif(x, F.lit(""))
        return F.concat(F.lit(f"{label}: "), x)

    lines = [line(name, label) for name, label in CONTEXT if name in fields]
    if more is not None:
        given = F.filter(F.map_entries(more), lambda e: e["value"] != "")
        lines.append(F.nullif(F.array_join(F.transform(given, lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n"), F.lit("")))
    return F.concat_ws("\n", *lines)


def template_embedding(text: Column, dim: int) -> Column:
    """The deterministic vector of a text: element i is (h + i) mod 1000 / 1000, h from the text's MD5."""
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.pmod(h + i, F.lit(1000)) / 1000).cast("double"))


def template_description(name: Column, kind: Column, fmt: Column, strategy: Column) -> Column:
    """The fixed description in two lines of a resource, from its fields."""
    # The sentences around the fields.
    main = F.concat(F.lit(f"{MAIN}：这是一个"), name, F.lit("数字资源，类型为"), kind, F.lit("，适用于游戏开发和数字内容创作场景，可作为项目素材直接使用。"))
    detail = F.concat(F.lit(f"{DETAIL}：该资源为"), fmt, F.lit("格式，预览方式为"), strategy, F.lit("，具备标准化预览载体，可用于语义检索和资源管理。"))
    return F.concat(main, F.lit("\n"), detail)


def card_lines(pack: Column, kind: Column, path: Column, tags: Column, counts: dict[str, Column], contains: Column) -> Column:
    """Lines of a resource's card; those without a value are left out."""
    line = lambda name, x: F.concat(F.lit(f"{name}: "), x)
    some = lambda name, xs, most: F.when(F.size(xs) > 0, line(name, F.array_join(F.slice(xs, 1, most), ", ")))
    parts = [line("Pack", F.coalesce(F.nullif(pack, F.lit("")), F.lit("Unknown"))), line("Type", kind), F.when(path != "", line("Path", path)), some("Tags", tags, 6)]
    parts += [F.when(n > 0, line(name, n.cast("string"))) for name, n in counts.items()] + [some("Contains", contains, 4)]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())
