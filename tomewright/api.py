"""Public surface: every composite operator under one import."""

from tomewright.functions.text import (cn_number, guess_range, normalize, progress_key,  # noqa: F401
                                       progress_label)
from tomewright.operators.anchors import anchors, digest_stats, nav_chapters, resolve_refs, slice_anchors, text_refs  # noqa: F401
from tomewright.operators.audit import (asof_state, asof_states, card_counts, duplicate_chapters,  # noqa: F401
                                        missing_cards, redo_batches, spoiler_leaks)
from tomewright.operators.catalog import (cards, continue_reading, group_pages, latest_progress,  # noqa: F401
                                          manifest_books, match_pages, page_metadata, parse_manifest,
                                          shelf_search, shelf_stats, shelf_total)
from tomewright.operators.coverage import (coverage, covered_chapters, extract_refs, missing_chapters,  # noqa: F401
                                           missing_runs)
from tomewright.operators.digest import (attach_slices, audit_order, block_entries, digest_blocks,  # noqa: F401
                                         digest_lines, document_title, entries, key_only, level_of_slices,
                                         lint_digest, lost_lines, reorder_digest, slices_per_entry, unit_parts, unit_stats, units)
from tomewright.operators.entities import (first_mentions, linkable, mentions, merge_aliases, people,  # noqa: F401
                                           people_index, people_warnings, table_aliases, unlinked_people)
from tomewright.operators.ordered import locate_in_spans, ordered_scan, runs  # noqa: F401
from tomewright.operators.parts import (blocks_of_parts, lines_of_parts, split_parts, text_of_parts,  # noqa: F401
                                        units_of_parts, whole_lines)
from tomewright.operators.passages import (find_passages, find_segments, flat_blocks, flat_spans,  # noqa: F401
                                           text_blocks)
from tomewright.operators.quotes import (extract_slices, quality_gate, slice_collection, slice_issues,  # noqa: F401
                                         slice_share, status_counts, verify_slices)
from tomewright.operators.segment import (book_summary, chapter_text, clean_books, file_labels, in_scope,  # noqa: F401
                                          lines, parse_scope, short_chapters, split_chapters, volumes)
from tomewright.plans.reading import (assign_batches, assign_segments, audit_plan, locate_sources,  # noqa: F401
                                      plan_batches, plan_segments, require_valid, resume_point, validate_index)
from tomewright.sources.files import (chapter_files, decode_books, encoding_census, index_files,  # noqa: F401
                                      raw_files, scan_pages, source_chunks)
from tomewright.sources.index import read_index, read_index_positional  # noqa: F401
from tomewright.sources.sinks import write_batches, write_index, write_segments, write_table  # noqa: F401
from tomewright.streaming.ingest import current_index, current_text, ingest_stream, refresh_text  # noqa: F401
from tomewright.streaming.progress import progress_stream, throttled_saves  # noqa: F401
