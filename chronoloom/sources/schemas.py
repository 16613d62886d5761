"""Explicit schemas of the versioned tables; nothing is inferred."""

from __future__ import annotations

_VERSION = "id string, family_id string"
_TIMES = "event_time timestamp, processed_time timestamp"
_TAIL = "embedding array<float>, summary string, attributes string, confidence double, valid_at timestamp, invalid_at timestamp, content_format string"

ENTITIES = f"{_VERSION}, name string, content string, {_TIMES}, episode_id string, source_document string, {_TAIL}"
RELATIONS = f"{_VERSION}, entity1_id string, entity2_id string, content string, {_TIMES}, episode_id string, source_document string, {_TAIL}, provenance string"
EPISODES = f"{_VERSION}, content string, {_TIMES}, source_document string, activity_type string, episode_type string, doc_hash string, embedding array<float>"
MENTIONS = "episode_id string, target_id string, target_type string, mention_context string"
REDIRECTS = "source_family_id string, target_family_id string, updated_at timestamp"
PATCHES = "patch_id string, target_type string, target_id string, target_family_id string, section_key string, change_type string, old_hash string, new_hash string, diff_summary string, source_document string, event_time timestamp"
DREAM_LOGS = "cycle_id string, graph_id string, start_time timestamp, end_time timestamp, status string, narrative string, insights_json string, connections_json string, consolidations_json string, config_json string"
TABLES = {"entities": ENTITIES, "relations": RELATIONS, "episodes": EPISODES, "episode_mentions": MENTIONS, "entity_redirects": REDIRECTS, "content_patches": PATCHES, "dream_logs": DREAM_LOGS}
