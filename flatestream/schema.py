"""Explicit schemas of the result tables."""

CHECKPOINTS = "file_id string, ordinal long, compressed_offset_bits long, uncompressed_offset long, kind string, header_offset long, line_offset long"
WINDOWS = "file_id string, compressed_offset_bits long, payload binary, is_compressed boolean"
INDEX_META = "file_id string, kind string, compressed_size long, uncompressed_size long, spacing long, total_lines long"
RANGES = "range_ord int, size_kind string, size long, offset_kind string, offset long"
MEMBERS = (
    "file_id string, member long, format string, flags int, mtime long, xfl int, os int, file_name binary, comment binary, extra binary, bgzf_block_size int, "
    "header_offset long, deflate_offset long, footer_offset long, end_offset long, uncompressed_offset long, uncompressed_size long, crc32 long, isize long, adler32 long, newlines long, "
    "ok boolean, error_kind string, error_offset long, expected long, actual long"
)
CHUNKS = "file_id string, member long, chunk long, uncompressed_offset long, bytes binary"
BLOCKS = (
    "file_id string, stream_index long, index_in_stream long, is_final boolean, block_type string, compressed_offset_bits long, compressed_data_offset_bits long, compressed_size_bits long, uncompressed_offset long, uncompressed_size long, "
    "precode array<int>, literal array<int>, distance array<int>, literal_symbols long, backreference_symbols long, copied_bytes long, farthest_backreference long, window_backreference_count long, merged_window_backreference_count long, used_window_symbols long, omitted_backreference_count long, references array<struct<distance: int, length: int>>"
)
BENCH_RAW = (
    "timestamp_utc string, corpus string, mode string, tool string, backend string, threads int, repetition int, `order` int, wall_seconds double, user_seconds double, system_seconds double, max_rss_kib double, "
    "decoded_bytes long, decoded_mib_per_second double, exit_status int, status string, stdout_log string, stderr_log string"
)
MANIFEST = "corpus string, path string, format string, compressed_bytes long, decoded_bytes long, member_count long, seed long, parameters string, cross_tool int"
