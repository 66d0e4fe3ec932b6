"""The tables of a corpus."""

from __future__ import annotations

DOCUMENTS = "path string, doc_id string, title string, frontmatter map<string,string>, tags array<string>, content_hash string, mtime timestamp, word_count int, token_count int, section_count int, link_count int, code_block_count int"
SECTIONS = "section_id string, doc_id string, path string, ordinal int, heading string, level int, parent_ordinal int, number string, start_line int, end_line int, content string, plain_text string, word_count int, token_count int, has_code boolean, has_list boolean, has_table boolean"
LINKS = "path string, line int, link_type string, href string, text string, section_id string, target string"
CODE_BLOCKS = "path string, section_id string, language string, content string, start_line int, end_line int"
VECTORS = "section_id string, path string, heading string, embedding array<float>, namespace string"
TABLES = {"documents": DOCUMENTS, "sections": SECTIONS, "links": LINKS, "code_blocks": CODE_BLOCKS}
#: What searches look up instead of the texts.
SEARCH_TABLES = {"postings": "term string, level int, section_id string, tf double, dl int", "impacts": "term string, level int, n bigint, max_tf double, min_dl int", "term_stats": "term string, df bigint", "stats": "n_docs bigint, avg_dl double", "words": "word string, section_id string", "vocabulary": "word string, stem string", "lookups": "key string, word string"}
