"""Path column builders: / and \\ both separate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import fixed


def parts(path: Column) -> Column:
    return F.split(path, r"[\\/]+")


def name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"[\\/][^\\/]*$", "")


def extension(file_name: Column) -> Column:
    """Lower case with its dot; '' if there is none."""
    return F.lower(F.regexp_extract(file_name, r"(\.[^.]*)$", 1))


def stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return F.when(path == root, F.lit(".")).otherwise(F.when(F.startswith(path, F.lit(f"{root}/")), F.substring(path, len(root) + 2, 1 << 20)).otherwise(path))


def parent_context(folder: Column, levels: int = 3) -> Column:
    """The last folder names, joined by spaces."""
    names = F.filter(parts(folder), lambda x: x != "")
    return F.array_join(F.slice(names, F.greatest(F.size(names) - (levels - 1), F.lit(1)), F.lit(levels)), " ")


def top_level(path: Column) -> Column:
    return F.regexp_extract(path, r"^((?:[A-Za-z]:)?[\\/]+[^\\/]*)", 1)


def in_root(path_key: Column, root: str) -> Column:
    """Of a lower-case path column: the root itself or below it. A prefix of the bare column is pushed down to the scan."""
    root = root.lower().rstrip("/")
    return (path_key == root) | F.startswith(path_key, F.lit(f"{root}/"))


def visible(path: Column) -> Column:
    """No segment starts with ~."""
    return F.forall(parts(path), lambda x: ~F.startswith(x, F.lit("~")))


def root_key(root: Column) -> Column:
    return F.substring(F.upper(F.sha2(F.upper(root), 256)), 1, 24)


def lookup(column: Column, values: dict, default: Column) -> Column:
    """A fixed table as one map literal."""
    literal = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v))))
    return F.coalesce(F.try_element_at(literal, column), default)


def category(ext: Column) -> Column:
    return lookup(ext, fixed.CATEGORIES, F.lit("Other"))


def concepts(ext: Column) -> Column:
    return lookup(ext, fixed.CONCEPTS, F.array().cast("array<string>"))


def category_label(kind: Column) -> Column:
    return lookup(kind, fixed.CATEGORY_LABELS, F.lit(fixed.CATEGORY_LABELS["Other"]))


def type_display(ext: Column, is_directory: Column) -> Column:
    """How a file's type is shown: by its extension, its category, or its extension in capitals."""
    bare = F.upper(F.substring(ext, 2, 255))
    kind = category(ext)
    other = F.when(kind.isin("ThreeDimensionalModel", "CadDrawing"), F.concat_ws(" ", bare, category_label(kind))).when(ext == "", F.lit(fixed.FILE_DISPLAY)).otherwise(F.concat_ws(" ", bare, F.lit(fixed.FILE_DISPLAY)))
    return F.when(is_directory, F.lit(fixed.FOLDER_DISPLAY)).otherwise(lookup(ext, fixed.EXTENSION_DISPLAYS, lookup(kind, fixed.TYPE_DISPLAYS, other)))


#: Version of the descriptor's wording, a part of it: stored vectors of other versions are stale.
DESCRIPTOR_VERSION = 2


def format_description(ext: Column) -> Column:
    """What an extension's format is for, or its category and name."""
    bare = F.substring(ext, 2, 255)
    return F.when(F.size(concepts(ext)) > 0, F.array_join(concepts(ext), ", ")).when(ext == "", category_label(category(ext))).otherwise(F.concat_ws(", ", category_label(category(ext)), bare))


def descriptor(file_name: Column, folder: Column, ext: Column, root: str, version: int = DESCRIPTOR_VERSION) -> Column:
    """The sentence that stands for a file without readable text."""
    from .text import split_identifier

    words, kind = split_identifier(stem(file_name)), category(ext)
    parts = [
        F.concat(F.lit(f"메타데이터 설명 버전 {version}. 파일명 "), stem(file_name), F.lit(".")),
        F.when(words != "", F.concat(F.lit(" 파일명 단어 "), words, F.lit("."))),
        F.concat(F.lit(" 폴더 "), relative(folder, root), F.lit(". 종류 "), category_label(kind), F.lit(".")),
        F.when(ext != "", F.concat(F.lit(" 확장자 "), F.substring(ext, 2, 255), F.lit("."))),
        F.when(F.size(concepts(ext)) > 0, F.concat(F.lit(" 형식 의미 "), F.array_join(concepts(ext), ", "), F.lit("."))).when(kind == "Other", F.lit(" 사용자 정의 또는 특수 파일 형식.")),
    ]
    return F.concat_ws("", *parts)


def path_priority(folder: Column, home: str | None) -> Column:
    """A user's folders first: desktop, documents and downloads, then the rest of their own folder."""
    if not home:
        return F.lit(0) + F.lit(0)  # a bare number would be a place in an ORDER BY
    key = F.lower(folder)
    inside = [F.when(in_root(key, f"{home.rstrip('/')}/{name}"), value).otherwise(0) for name, value in fixed.USER_FOLDERS]
    return F.greatest(F.lit(0), F.when(in_root(key, home), fixed.USER_FOLDER).otherwise(0), *inside)


def generated_image_priority(file_name: Column, folder: Column) -> Column:
    """How likely a file is a generated image: by its folders, then by its name."""
    names = F.transform(F.filter(parts(folder), lambda x: F.trim(x) != ""), lambda x: F.lower(F.trim(x)))
    made = F.exists(names, lambda x: x.isin(*fixed.GENERATED_FOLDERS) | F.contains(x, F.lit(fixed.GENERATED_PARTS[0])) | F.contains(x, F.lit(fixed.GENERATED_PARTS[1])))
    base = F.lower(stem(file_name))
    digits = F.length(F.regexp_replace(base, r"[^\p{Nd}]", ""))
    named = F.contains(base, F.lit("comfy")) | F.startswith(base, F.lit("nai_")) | F.contains(base, F.lit("generated"))
    opaque = (F.length(base) >= 5) & (digits >= F.floor(F.length(base) * 3 / 4))
    return F.when(made, 60_000.0).when(F.exists(names, lambda x: x.isin(*fixed.PICTURE_FOLDERS)), 18_000.0).otherwise(0.0) + F.when(named, 20_000.0).when(opaque, 2_000.0).otherwise(0.0)


def size_short(size: Column, largest: str = "TB") -> Column:
    """The shorter form: at most one decimal, none for bytes, up to terabytes (or a smaller largest unit)."""
    units = ("B", "KB", "MB", "GB", "TB")
    step = F.least(F.lit(units.index(largest)), F.when(size < 1024, 0).otherwise(F.floor(F.log(2.0, F.greatest(size, F.lit(1)).cast("double")) / 10))).cast("int")
    value = F.round(size / F.pow(F.lit(1024.0), step), 1)
    return F.concat_ws(" ", F.regexp_replace(F.format_string("%.1f", value), r"\.0$", ""), F.element_at(F.array(*map(F.lit, units)), step + 1))


def size_display(size: Column, is_directory: Column) -> Column:
    number = lambda c, d: F.format_number(c, d)
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return F.when(is_directory | size.isNull(), F.lit("—")).otherwise(
        F.when(size < kb, F.concat(number(size, 0), F.lit(" B"))).when(size < mb, F.concat(number(size / kb, 1), F.lit(" KB"))).when(size < gb, F.concat(number(size / mb, 1), F.lit(" MB"))).otherwise(F.concat(number(size / gb, 1), F.lit(" GB")))
    )
