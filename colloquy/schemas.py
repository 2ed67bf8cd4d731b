"""Schemas of the tables that cross the engine's border."""

from __future__ import annotations

from pyspark.sql import types as T

# Names that input files carry.
RUN_CONFIG_TYPES = {
    "AI1_TEMPERATURE": "double",
    "AI2_TEMPERATURE": "double",
    "MAX_MESSAGE_PAIRS": "int",
    "MAX_TURNS": "int",
    "INITIAL_QUESTION_ID": "int",
    "DIALOGUE_KEYWORD": "string",
    "USER_PROMPT_ID": "int",
    "OTHERS_ID": "int",
    "PERSONA_ID": "int",
    "TRANSFORM_ID": "int",
    "ASSISTANT_PROMPT_ID": "int",
    "RESPONSE_ID": "int",
    "UPDATE_ID": "int",
    "dialogue": "string",
}
METRICS = ("tone", "approach", "format", "logic")

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

CHAT_EXAMPLE = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("extract_range", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
    ]
)

CATALOG_ITEM = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

# Fixed values: "claude" and "gemma" name the two sides of a pair in stored dialogues.
_content = T.StructType([T.StructField("content", T.StringType())])
_verdict = T.StructType(
    [T.StructField("quantitative", T.StringType()), T.StructField("qualitative", T.StringType())]
)
SCORED_DIALOGUE = T.StructType(
    [
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("question_id", T.LongType()),
                    T.StructField("timestamp", T.StringType()),
                    T.StructField("model_version", T.StringType()),
                    T.StructField("checkpoint", T.StringType()),
                    T.StructField("topic", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "pairs",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("pair_id", T.LongType()),
                        T.StructField("claude", _content),
                        T.StructField("gemma", _content),
                        T.StructField(
                            "evaluation", T.StructType([T.StructField(m, _verdict) for m in METRICS])
                        ),
                    ]
                )
            ),
        ),
    ]
)

RUN_EVENT = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("step", T.LongType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("epoch", T.DoubleType()),
    ]
)

DEVICE_LOG = T.StructType(
    [
        T.StructField(
            "gpu_metrics",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("timestamp", T.StringType()),
                        T.StructField(
                            "metrics",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("device", T.IntegerType()),
                                        T.StructField("vram_used", T.DoubleType()),
                                        T.StructField("utilization", T.DoubleType()),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)
