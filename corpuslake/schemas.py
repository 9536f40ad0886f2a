"""Schemas of the persisted tables."""

CHUNKS = (
    "chunk_id string, document string, embedding array<float>, doc_id string, source string, file_name string, file_type string, "
    "file_size bigint, updated_at timestamp, status string, business_line string, chunk_index int, total_chunks int, chapter string, "
    "page_start int, page_end int, version int, is_active boolean"
)
VERSION_LOG = "doc_id string, file_name string, version int, chunk_count int, delta int, created_at timestamp, seq bigint"
POINTER_LOG = "doc_id string, version int, seq bigint"
JUDGE = (
    "claims array<struct<text:string,verdict:string,evidence:string,citation_check:struct<citations_found:array<string>,accuracy:string>>>, "
    "summary struct<total_claims:int,supported:int,contradicted:int,unsupported:int,partial:int,citation_correct:int,citation_wrong:int,citation_fabricated:int,faithfulness_score:double>"
)
SESSIONS = "name string, messages array<struct<role:string,content:string,sources:array<struct<index:int,file:string,path:string,score:double,snippet:string>>>>, created_at string"
EVAL = "question string, relevant_texts array<string>"
VECTORS = "text_hash string, embedder string, embedding array<float>"
FAILURES = "source string, doc_id string, stage string, error string, seq bigint"
BATCHES = "files bigint, refused bigint, finished_at timestamp, stream string, batch_id bigint"
REFUSED = "path string, length bigint, reason string, stream string, batch_id bigint"
FINGERPRINTS = "doc_id string, chunk_index int, simhash bigint"
