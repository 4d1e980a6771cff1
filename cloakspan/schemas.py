"""Table schemas of the engine."""

from __future__ import annotations

# One detected span inside an array.  The field order is the claim order:
# sorting an array of these structs puts equal (start, end) claims side by
# side with the winning layer and rule first.
SPAN_STRUCT = (
    "struct<start:int,end:int,layer:int,seq:int,text:string,pii_type:string,"
    "confidence:double,priority:int,rule:string,status:string>"
)
SPAN_ARRAY = f"array<{SPAN_STRUCT}>"
HIT_ARRAY = "array<struct<start:int,end:int,text:string>>"
TAKEN_ARRAY = "array<struct<kind:string,n:bigint>>"

# The mapping that a stream writes; ``hour`` and ``batch_id`` are folders.
STREAM_MAPPING = (
    "session_id string, scope_id string, mapping_id string, pii_type string, "
    "value_key string, original_enc binary, placeholder string, n long, "
    "created_at timestamp, doc_ord string, unit_no int, pos int, hour string, "
    "batch_id long"
)
LEARNED_FILE = (
    "version int, pii map<string,array<string>>, safe array<string>, "
    "custom_patterns map<string,struct<pattern:string,pii_type:string,"
    "created_at:string>>, metadata map<string,string>"
)
