"""Types of the stored entities."""

from pyspark.sql import types as T

_S = T.StringType()
CONNECTION = T.StructType([T.StructField("chunk_id", _S), T.StructField("weight", T.DoubleType())])
META = T.StructType(
    [T.StructField(n, _S) for n in ("source", "title", "document_id", "source_hash", "document_hash", "page_hash", "book", "chapter", "verse", "section")]
    + [T.StructField("headers", T.ArrayType(_S)), T.StructField("page", T.IntegerType()), T.StructField("total_pages", T.IntegerType()), T.StructField("extraction_method", _S), T.StructField("chunk_index", T.IntegerType())]
    + [T.StructField("categories", T.ArrayType(_S)), T.StructField("unit_ids", T.ArrayType(_S)), T.StructField("graph_id", _S), T.StructField("connected_chunk_ids", T.ArrayType(CONNECTION)), T.StructField("extra", T.MapType(_S, _S))]
)
DOCUMENT = T.StructType([T.StructField(n, _S) for n in ("id", "source", "title", "content")] + [T.StructField("metadata", META)])
CHUNK = T.StructType(
    [T.StructField(n, _S) for n in ("id", "document_id", "content")]
    + [T.StructField("path", T.ArrayType(_S)), T.StructField("metadata", META), T.StructField("unit_ids", T.ArrayType(_S)), T.StructField("graph_id", _S), T.StructField("parent_chunk_id", _S)]
)
EMBEDDING = T.StructType([T.StructField("chunk_id", _S), T.StructField("embedding", T.ArrayType(T.FloatType(), False))])
UNIT = T.StructType([T.StructField("unit_id", _S), T.StructField("document_id", _S), T.StructField("text", _S), T.StructField("unit_type", _S), T.StructField("index", T.IntegerType())])
EDGE = T.StructType([T.StructField("document_id", _S), T.StructField("src", _S), T.StructField("dst", _S), T.StructField("edge_type", _S), T.StructField("weight", T.DoubleType())])
JOB = T.StructType([T.StructField(n, _S) for n in ("id", "type", "status", "message", "error", "result", "input")] + [T.StructField("progress", T.DoubleType())] + [T.StructField(n, T.TimestampType()) for n in ("created_at", "started_at", "updated_at")])
