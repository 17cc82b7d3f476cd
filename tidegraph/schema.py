"""Schemas of the engine's tables. ``project`` and ``change_set_id`` let many projects and change sets share a job."""

FILES = "project string, path string, dir string, base string, ext string, content binary"
NODES = "project string, node_id string, has_tests boolean, has_dynamic boolean"
NODE_FILES = "project string, node_id string, path string, dir string"
EDGES = "project string, src string, dst string"  # src depends on dst
RULES = "analyzer string, rule string, match_kind string, value string"
CHANGES = "project string, change_set_id string, ord int, path string"
IMPACT = "project string, change_set_id string, full_run boolean, full_run_reasons array<string>, targets array<string>, changed_targets array<string>, uncertain_targets array<string>"
ALIAS_RULES = "project string, rule_ord int, pattern string, target_ord int, template string"
