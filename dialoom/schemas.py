"""Row shapes of the tables that the operators take and give."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_KINDS |= {f"{k}s": T.ArrayType(t) for k, t in _KINDS.items()}


def shape(fields: str, **more: T.DataType) -> T.StructType:
    """A struct from "name kind, name kind"; needs no session, as DDL would. A plural kind is an array."""
    pairs = [f.split() for f in fields.split(", ")]
    return T.StructType([*[T.StructField(n, _KINDS[k]) for n, k in pairs], *[T.StructField(n, t) for n, t in more.items()]])


SEGMENT = shape("clip_id string, seg_ord long, speaker string, start double, end double")
CHUNK = shape("clip_id string, chunk_ord long, chunk_id string, speaker string, start double, end double, source_segment_count int")
WORD = shape("clip_id string, word_ord long, word string, start double, end double")
EMBEDDING = shape("clip_id string, chunk_id string, embedding doubles")
TRACK = shape("track_id int, embedding doubles", frames=T.ArrayType(shape("frame int, t double, bbox doubles, score double")))
EXPECTATION = shape("id string, chunk_id string, kind string, start double, end double, weight double, role string, roles strings")
GATE = shape("stage string, accepted boolean, critical_flags strings, warnings strings, score double")
STEP = shape("name string, ord int, state string, started_at double, ended_at double, error string")
RUN = shape("run_id string, input_stem string, status string, created_at double, updated_at double", steps=T.ArrayType(STEP))
ACTIVITY = shape("run_id string, ts double, kind string, actor string, target string, before string, after string, message string")
LIVE_EVENT = shape("run_id string, ts double, type string, step string, duration_ms long, message string")
