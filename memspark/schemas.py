"""Table layouts and settings of the memory store."""

from __future__ import annotations

from dataclasses import dataclass

MEMORY_TYPES = ("episodic", "semantic", "procedural")
SCOPES = ("private", "team", "org", "session")

EPISODIC = (
    "id string, content string, memory_type string, agent_id string, scope string, team_id string, importance double, decay_score double, access_count bigint, "
    "created_at timestamp, accessed_at timestamp, embedding array<float>, metadata string"
)
TRIPLES = (
    "id string, subject string, predicate string, object string, agent_id string, confidence double, valid_from timestamp, valid_until timestamp, "
    "source_episodes array<string>, metadata string, write_seq bigint, written_at timestamp"
)
STEP = "struct<action:string,tool:string,parameters:string,expected_output:string,fallback_action:string>"
PROCEDURES = (
    "id string, name string, description string, agent_id string, success_rate double, execution_count bigint, created_at timestamp, updated_at timestamp, "
    f"steps array<{STEP}>, source_episodes array<string>, applicable_contexts array<string>"
)
FIELD = "struct<type:string,required:boolean,default:string,description:string>"
METADATA_SCHEMAS = f"agent_id string, name string, version int, created_at string, fields map<string,{FIELD}>"
#: The append-only log: every change of every store, in order; payload is the row as JSON.
MEMORY_LOG = "seq bigint, ts timestamp, op string, store string, id string, payload string"
STORES = {"episodic": EPISODIC, "triples": TRIPLES, "procedures": PROCEDURES}


@dataclass(frozen=True)
class Config:
    """Knobs of recall, context and maintenance."""

    embedding_dim: int = 384
    default_token_budget: int = 1000
    l1_token_budget: int = 200
    l2_token_budget: int = 500
    l3_least_left: int = 50
    l3_results: int = 50
    decay_half_life_hours: float = 168.0
    eviction_threshold: float = 0.05
    consolidation_threshold: int = 10
    blend_alpha: float = 0.2
    max_procedures_per_query: int = 1
    ann_threshold: int = 5000
    strict_schemas: bool = True
    contradiction_check: bool = True
