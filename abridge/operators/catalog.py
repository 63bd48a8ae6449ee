"""Fixed catalogs: styles, baselines, ratios, task settings and metric sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The 13 compression styles and their instructions, in catalog order.
STYLES: list[tuple[str, str]] = [
    ("loc-begin", "Focus on the initial portion of the text."),
    ("loc-mid", "Focus on the middle portion of the text."),
    ("loc-end", "Focus on the latter portion of the text."),
    ("loc-all", "Compress the entire text comprehensively, ensuring all parts are condensed effectively."),
    ("abstractive", "Make it more abstractive, by paraphrasing in your own words or restructuring the original text to convey the same meaning in a more concise form."),
    ("extractive", "Make it more extractive, by selecting the most important phrases or sentences to condense the content."),
    ("readable", "Make sure the compressed text is fluent, grammatically correct, and human-readable."),
    ("unreadable", "Do not make it human-readable. Use abbreviations, symbols to aggressively compress it."),
    ("format-aware", "If the original text has a specific structure or format, maintain the key sentences from the original to preserve this structure or format."),
    ("for_reconstruction", "This is for the reconstruction task."),
    ("for_summarization", "This is for the summarization task."),
    ("for_qa", "This is for the multi-hop QA task."),
    ("for_reasoning", "This is for the reasoning task."),
]
STYLE_NAMES = [s for s, _ in STYLES]

# Compression ratios of the sweeps.
RATIOS = [0.1, 0.25, 0.5]

# Metric names per task.
TASK_METRICS = {
    "reconstruction": ["rouge1", "rouge2", "rougeL", "bertscore"],
    "summarization": ["rouge1", "rouge2", "rougeL", "bertscore"],
    "qa": ["em", "f1"],
    "reasoning": ["em"],
}

# Per task, number of inference demonstrations S and advantage kind.
TASK_SETTINGS = {
    "reconstruction": (1, "min"),
    "summarization": (1, "min"),
    "qa": (2, "min"),
    "reasoning": (3, "mid"),
}

# Rule each style is re-aimed to when no model response exists.
STYLE_RULE = {
    "loc-begin": "prefix",
    "loc-mid": "middle",
    "loc-end": "suffix",
    "loc-all": "stride",
    "extractive": "extractive",
    "readable": "sentences",
    "format-aware": "lines",
    "unreadable": "abbrev",
    # abstractive and for_* run only through model responses; fallback = prefix
}

# Baselines of the sweeps and the rule behind each.
BASELINE_RULE = {
    "selective-context": "prefix",
    "truncation": "prefix",
    "random": "window",
    "selective": "sentences",
}


def styles_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STYLES, "style string, instruction string")
