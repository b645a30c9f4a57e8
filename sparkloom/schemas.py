"""Schemas of the records that pass between operators."""

from __future__ import annotations

ITEM = "repo string, file_path string, kind string, name string, signature string, body string, doc_comment string, line_number int, visibility string, attributes array<string>"
CONSTANT = "repo string, file_path string, name string, value string, type_annotation string, doc_comment string, line_number int"
FILE = "repo string, path string, content string, sha256 string, mtime_ns bigint, length bigint"
CHUNK = "chunk_id string, content string, source_type string, source_file string, source_name string, line_number int, metadata map<string,string>"
RECORD = "chunk_id string, content string, source_type string, source_file string, source_name string, line_number int, metadata string, embedding array<float>"
FILE_ENTRY = "path string, sha256 string, mtime_ns bigint, chunk_ids array<string>"
CHANGE = "path string, change_type string, old_chunk_ids array<string>"
