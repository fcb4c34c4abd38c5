"""Schemas of the data model, and its enumerations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODALITIES = "text", "image", "audio", "video", "table", "pdf", "document"
RESOLUTIONS = "fine", "mid", "coarse"
EDGE_TYPES = "PART_OF", "NEXT", "DERIVED_FROM", "SIMILAR_TO", "REFERENCES", "ENTITY_SHARED", "ALIGNED_WITH", "VISUAL_GROUNDED_IN", "SCENE_DESCRIBES"
FRAGMENT_TYPES = "knowledge", "solution", "preference", "entity"
RESEARCH_STATES = "idle", "planning", "researching", "synthesizing", "complete", "cancelled", "error"


ATOMS = "atom_id string, content string, modality string, resolution string, embeddings map<string,array<float>>, metadata map<string,string>, source string, ts double, entities array<string>"
EDGES = "src string, dst string, edge_type string, weight double, metadata map<string,string>"
CHATS = "chat_id string, title string, namespace string, created_at timestamp, updated_at timestamp"
MESSAGES = "chat_id string, turn bigint, role string, content string, metadata string, created_at timestamp"
TRACES = "trace_id string, session_id string, turn_index bigint, user_query string, retrieved_ids array<string>, sources array<string>, scores map<string,double>, answer string"
FRAGMENTS = "fragment_id string, session_id string, fragment_type string, content string, tags array<string>, namespace string, importance double, access_count bigint, created_at timestamp, last_accessed timestamp, is_deleted boolean, embedding array<float>"
SESSION_CONFIG = "session_id string, namespaces array<string>, source_filters array<string>, web_enabled boolean, memory_enabled boolean, updated_at timestamp"
WEB_LOG = "session_id string, provider string, url string, title string, snippet string, score double, logged_at timestamp"
PROGRESS = "session_id string, event_index bigint, event_type string, payload string, ts timestamp"
EVALUATIONS = "message_id string, overall_score double, verdict string, reasoning string, response string, updated_at timestamp"
SEARCH_RESULTS = "provider string, pos bigint, title string, url string, snippet string, date string"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A truncated table."""
    return spark.createDataFrame([], schema)


def evolve(df: DataFrame, schema: str) -> DataFrame:
    """``df`` in the columns of ``schema``: missing ones are null, others are cast, extra ones go."""
    have = {c.lower(): c for c in df.columns}
    target = empty(df.sparkSession, schema).schema
    return df.select(*[(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])


def one_of(column: str, allowed: tuple[str, ...]):
    """Column: the value if it is allowed, else null."""
    return F.when(F.col(column).isin(*allowed), F.col(column))
