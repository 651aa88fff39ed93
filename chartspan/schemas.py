"""Schemas of the tables the operators exchange.

Offsets are 0-based, half-open and counted in Unicode code points, which is what
Spark's ``substring`` and ``length`` count.
"""

from pyspark.sql import types as T

_S = T.StringType()
_I = T.IntegerType()

NOTE = T.StructType([
    T.StructField("note_id", _S, False),
    T.StructField("text", _S, False),
    T.StructField("type", _S),
    T.StructField("date", _S),
    T.StructField("source", _S),
    T.StructField("raw_text", _S),
])

ANNOTATION = T.StructType([
    T.StructField("ann_id", _S, False),
    T.StructField("note_id", _S, False),
    T.StructField("start", _I, False),
    T.StructField("end", _I, False),
    T.StructField("text", _S),
    T.StructField("questions", T.ArrayType(_S), False),
    T.StructField("comment", _S),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("source", _S, False),
])

QUESTION = T.StructType([
    T.StructField("question_id", _S, False),
    T.StructField("name", _S),
    T.StructField("color", _S),
    T.StructField("hotkey", _S),
    T.StructField("hint", _S),
])

RULE = T.StructType([
    T.StructField("question_id", _S, False),
    T.StructField("kind", _S, False),
    T.StructField("pattern", _S, False),
    T.StructField("negation", T.BooleanType(), False),
])

MATCH = T.StructType([
    T.StructField("note_id", _S),
    T.StructField("term", _S),
    T.StructField("start", _I),
    T.StructField("end", _I),
    T.StructField("question_id", _S),
])

CHANGE = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("op", _S),
    T.StructField("ann_id", _S),
    T.StructField("before", ANNOTATION),
    T.StructField("after", ANNOTATION),
    T.StructField("ts", T.TimestampType()),
])

# A note as it may arrive in JSON: every spelling of a key the import accepts.
RAW_NOTE = T.StructType([
    T.StructField("id", _S),
    T.StructField("note_id", _S),
    T.StructField("text", _S),
    T.StructField("note_type", _S),
    T.StructField("date", _S),
    T.StructField("source", _S),
    T.StructField("meta", T.StructType([
        T.StructField("type", _S),
        T.StructField("date", _S),
        T.StructField("source", _S),
        T.StructField("rawText", _S),
    ])),
])

# Session bundles keep the camel-case keys they are exchanged with.
SESSION_ANNOTATION = T.StructType([
    T.StructField("id", _S),
    T.StructField("noteId", _S),
    T.StructField("start", _I),
    T.StructField("end", _I),
    T.StructField("text", _S),
    T.StructField("questions", T.ArrayType(_S)),
    T.StructField("comment", _S),
    T.StructField("createdAt", T.LongType()),
    T.StructField("source", _S),
])

SESSION_QUESTION = T.StructType([
    T.StructField("id", _S),
    T.StructField("name", _S),
    T.StructField("color", _S),
    T.StructField("hotkey", _S),
    T.StructField("hint", _S),
])
