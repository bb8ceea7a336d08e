"""The tables of an index, by explicit schema; times are microseconds since 1970, missing ones null."""

from __future__ import annotations

FILE_RECORD = "name string, full_path string, directory_path string, extension string, is_directory boolean, size_bytes long, created long, modified long"
CONTENT_DOCUMENT = FILE_RECORD + ", text string, was_truncated boolean, source string, analyzed_pages int"
SEMANTIC_VECTOR = "path_key string, modified long, size_bytes long, text_length long, text_hash string, model_id string, vector array<tinyint>"
VISUAL_VECTOR = "path_key string, modified long, size_bytes long, model_id string, regions array<array<tinyint>>, tags array<struct<name: string, category: string, confidence: double>>"
FAILED_ATTEMPT = "path_key string, version long, attempted long"
INDEX_HEADER = "root string, root_key string, format_version int, built long, root_modified long, is_complete boolean, cap long, rows long"
APPLICATION = "app_id long, name string, full_path string, source_label string, is_directory boolean, modified long"

#: Versions of the index formats: rows of others are discarded.
FORMATS = {"metadata": 5, "content": 7, "semantic": 6, "visual": 6}
