"""Media names: kinds, normal forms, artifact stems, relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.functions.text import strip


def base_name(path: Column) -> Column:
    """Last path part. Trailing slashes do not count, and '.' parts are not names."""
    trimmed = F.regexp_replace(path, r"(?:/++\.?+)++\z", "")
    name = F.regexp_extract(trimmed, r"([^/]*)\z", 1)
    return F.when(name == ".", F.lit("")).otherwise(name)


def file_suffix(path: Column) -> Column:
    """'.ext' of the last path part; '' for dot files and for names ending in a dot."""
    return F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)\z", 1)


def file_stem(path: Column) -> Column:
    name = base_name(path)
    return F.left(name, F.length(name) - F.length(file_suffix(path)))


def guess_kind(file: Column) -> Column:
    ext = F.lower(F.ltrim(file_suffix(file), F.lit(".")))
    return (
        F.when(ext.isin(*fv.AUDIO_EXTENSIONS), "audio")
        .when(ext.isin(*fv.IMAGE_EXTENSIONS), "image")
        .when(ext.isin(*fv.VIDEO_EXTENSIONS), "video")
        .when(ext.isin(*fv.DOCUMENT_EXTENSIONS), "document")
        .otherwise("unknown")
    )


def normalize_media_ref(file: Column) -> Column:
    slashed = strip(F.translate(F.coalesce(file, F.lit("")), "\\", "/"))
    return F.regexp_replace(slashed, r"^\./", "")


def artifact_stem(file: Column) -> Column:
    """Readable base plus a digest of the normal name, so that equal bases do not collide."""
    key = normalize_media_ref(file)
    safe = F.regexp_replace(file_stem(key), fv.UNSAFE_STEM_CHARS, "_")
    safe = F.regexp_replace(safe, fv.STEM_EDGE_CHARS, "")
    safe = F.when(safe == "", F.lit(fv.DEFAULT_STEM)).otherwise(safe)
    digest = F.substring(F.sha1(F.encode(key, "UTF-8")), 1, fv.STEM_DIGEST_CHARS)
    return F.concat(safe, F.lit("__"), digest)


def legacy_stem(file: Column) -> Column:
    return file_stem(file)


def candidate_stems(file: Column) -> Column:
    """Stems to look an artifact up by, best first."""
    return F.array_distinct(F.array(artifact_stem(file), legacy_stem(file)))


def relative_path(path: Column, root: str | Column) -> Column:
    """Path below ``root`` with forward slashes."""
    root_col = F.lit(root) if isinstance(root, str) else root
    posix = F.translate(path, "\\", "/")
    prefix = F.concat(F.regexp_replace(F.translate(root_col, "\\", "/"), "/+$", ""), F.lit("/"))
    return F.when(
        F.startswith(posix, prefix), F.substring(posix, F.length(prefix) + 1, F.length(posix))
    ).otherwise(posix)
