"""Explicit schemas of the engine's tables."""

from pyspark.sql import types as T

POINT = "struct<chapter:int,block:int,offset:bigint>"
SPAN = "struct<text:string,bold:boolean,italic:boolean,superscript:boolean,debug_noteref_candidate:boolean,noteref_id:string,font_size:float>"
BLOCK_COLUMNS = f"block_index int, kind string, level int, font_size float, text string, spans array<{SPAN}>"
PANEL = "struct<id:string,weight:double,min_weight:double,collapsed:boolean,pre_collapse_weight:double>"
LIBRARY = T.StructType(
    [T.StructField(name, kind, name == "object_etag") for name, kind in (
        ("id", T.StringType()), ("title", T.StringType()), ("original_filename", T.StringType()), ("mime_type", T.StringType()), ("size_bytes", T.IntegerType()),
        ("storage_key", T.StringType()), ("storage_bucket", T.StringType()), ("object_etag", T.StringType()), ("created_at", T.TimestampType()),
    )]
)
