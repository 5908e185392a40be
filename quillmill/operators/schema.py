"""Schemas of the tables that outlive a run."""

CHUNK = (
    "id string, module string, source_file string, section_path array<string>, content string, metadata struct<tags:array<string>,version:string,heading_level:int,"
    "parent_section:string,doc_title:string,file_id:string,has_code:boolean,language:string,token_count:int,chunk_index:int,total_chunks:int,prev_chunk_id:string,"
    "next_chunk_id:string,source_hash:string,situating_context:string,contextualized:boolean>"
)
BUILD_META = "module string, source_hash string, built_at string, chunk_count long"
CONTEXT_CACHE = "key string, context string, model string"
