"""Texts that try to steer an assistant or send data away: levels, findings and stripped texts; and the parts of a skill file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ["critical", "high", "medium", "low"]

#: Pattern and name of every threat by severity, as regular expressions that ignore case (fixed values).
THREATS = {
    "critical": [
        (r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|context)", "ignore_previous_instructions"),
        (r"disregard\s+(all\s+)?(previous|prior|above)", "disregard_instructions"),
        (r"you\s+are\s+now\s+(?!a\s+(?:developer|engineer|assistant|tool))", "persona_hijack_you_are_now"),
        (r"act\s+as\s+(?:if\s+you\s+are\s+)?(?:an?\s+)?(?:evil|malicious|unrestricted|jailbreak|DAN)", "persona_hijack_act_as"),
        (r"your\s+new\s+(instructions?|directives?|rules?|persona)", "new_instructions"),
        (r"forget\s+(everything|all|your|previous)", "forget_instructions"),
        (r"override\s+(your\s+)?(previous\s+)?(instructions?|settings?|rules?)", "override_instructions"),
        (r"\[INST\]|\[/INST\]|<\|im_start\|>|<\|im_end\|>|\[SYSTEM\]", "llm_control_tokens"),
    ],
    "high": [
        (r"<system>.*?</system>", "xml_system_tag"),
        (r"</?(?:system|assistant|human|user|prompt|context|instruction)\s*>", "xml_role_tag"),
        (r"\{\{\s*system\s*\}\}|\{\{\s*prompt\s*\}\}", "template_injection"),
        (r"---\s*system\s*---", "markdown_system_block"),
        (r"#+\s*system\s+prompt", "heading_system_prompt"),
    ],
    "medium": [
        (r"(?:send|post|report|exfiltrate|leak|transmit)\s+(?:this|the|all|memory|data|context|everything)?\s*to\s+(?:external|remote|server|http|url)", "exfiltration_verb"),
        (r"https?://(?!github\.com|docs\.|pypi\.org|arxiv\.org|huggingface\.co)", "suspicious_url"),
        (r"curl\s+[\"\']?https?://", "curl_exfiltration"),
        (r"when\s+(?:this\s+)?(?:note|memory|skill)\s+(?:is\s+)?(?:loaded|read|accessed)", "trigger_on_load"),
        (r"every\s+time\s+(?:you|claude|the\s+ai)", "persistent_trigger"),
        (r"from\s+now\s+on", "from_now_on"),
    ],
    "low": [
        (r"base64[_\s]*(?:decode|encode)", "base64_usage"),
        (r"eval\s*\(", "eval_call"),
        (r"exec\s*\(", "exec_call"),
        (r"\\x[0-9a-fA-F]{2}(?:\\x[0-9a-fA-F]{2}){3,}", "hex_encoded_sequence"),
        (r"new\s+(?:system\s+)?(?:instructions?|rules?|behavior)", "new_behavior"),
        (r"pretend\s+(?:you\s+are|to\s+be)", "pretend_persona"),
    ],
}
#: Tags that are taken out of a text (fixed value).
STRIPPED_TAGS = r"</?(?:system|assistant|human|user|prompt|instruction)\s*>"


def threat_level(text: Column | str) -> Column:
    """critical, high, medium, low or safe; null for a null text. JVM-side; dots cross lines in the high group."""
    text = F.col(text) if isinstance(text, str) else text
    out = F.lit("safe")
    for level in reversed(LEVELS):
        flags = "(?is)" if level == "high" else "(?i)"
        out = F.when(text.rlike(flags + "|".join(f"(?:{p})" for p, _ in THREATS[level])), level).otherwise(out)
    return F.when(text.isNotNull(), out)


def stripped(text: Column | str) -> Column:
    """Role tags replaced by [STRIPPED]."""
    return F.regexp_replace(text, f"(?i){STRIPPED_TAGS}", "[STRIPPED]")


def scan(text: str | None) -> list[tuple[str, str, str, int, str]]:
    """(severity, type, match, position, context) of all findings, in the order of the list."""
    import re

    out = []
    for level, patterns in THREATS.items():
        flags = re.I | re.S if level == "high" else re.I
        for pattern, name in patterns:
            for m in re.finditer(pattern, text or "", flags):
                out.append((level, name, m.group(), m.start(), text[max(0, m.start() - 30) : m.end() + 30].strip()))
    return out


def findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, severity, type, match, position, context``: a row per finding. Only texts that the JVM-side patterns flag go to
    Python."""
    flagged = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(threat_level("text") != "safe")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *r) for k, t in zip(f["key"], f["text"]) for r in scan(t)]
            yield pd.DataFrame(rows, columns=["key", "severity", "type", "match", "position", "context"])

    kind = flagged.schema["key"].dataType.simpleString()
    return flagged.mapInPandas(run, f"key {kind}, severity string, type string, match string, position int, context string").withColumnRenamed("key", key)


def _section(text: Column, heads: str, inline: str, chars: int) -> Column:
    body = F.regexp_extract(text, rf"(?ims)(?:^##?\s*(?:{heads})|{inline}:)\s*[\n:]*(.+?)(?=^##|\z)", 1)
    return F.substring(F.regexp_replace(body, r"^\s+|\s+$", ""), 1, chars)


def skill_parts(text: Column | str, source: Column | str | None = None) -> dict[str, Column]:
    """name, description, when_to_use and tags of a skill file; the name falls back on the source, the description on the
    text's beginning."""
    text = F.col(text) if isinstance(text, str) else text
    heading = F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    fallback = F.lit("unnamed-skill")
    if source is not None:
        file = F.regexp_replace(F.regexp_replace(F.element_at(F.split(source, "/"), -1), r"\.md", ""), r"[^a-zA-Z0-9_-]", "-")
        fallback = F.when(F.length(file) > 0, file).otherwise(fallback)
    described = _section(text, "description", "description", 500)
    listed = F.regexp_extract(text, r"(?im)tags?:\s*(.+)$", 1)
    return {
        "name": F.when(heading != "", heading).otherwise(fallback),
        "description": F.when(described != "", described).otherwise(F.substring(text, 1, 200)),
        "when_to_use": _section(text, "when to use|use when|trigger", "when_to_use", 300),
        "tags": F.filter(F.split(listed, r"[,\s]+"), lambda x: x != ""),
    }


def ingest_skills(files: DataFrame, *, text: str = "text", source: str = "source", today: str, confirmed: Column | None = None) -> DataFrame:
    """Each file with ``status`` (blocked for critical and high ones, else preview, ingested where ``confirmed``), ``level`` and
    the note it becomes: ``content``, ``category``, ``importance``, ``tags``."""
    sure = F.coalesce(confirmed if confirmed is not None else F.lit(False), F.lit(False))
    level, part = threat_level(text), skill_parts(text, source)
    f = files.withColumn("level", level)
    for name, c in part.items():
        f = f.withColumn(f"_{name}", c)
    status = F.when(sure, "ingested").when(F.col("level").isin("critical", "high"), "blocked").otherwise("preview")
    line = lambda label, c: F.when(c != "", F.concat(F.lit(f"\n\n{label}: "), c)).otherwise("")
    scanned = F.when(F.col("level") != "safe", F.concat(F.lit("\n\n[Security scan: "), "level", F.lit(" risk, reviewed]"))).otherwise("")
    content = F.concat(F.lit("SKILL: "), F.col("_name"), line("Purpose", F.col("_description")), line("When to use", F.col("_when_to_use")), line("Tags", F.array_join("_tags", ", ")), line("Source", F.coalesce(F.col(source), F.lit(""))), F.lit(f"\n\nIngested: {today}"), scanned)
    f = f.withColumn("status", status).withColumn("content", F.when(status != "blocked", content))
    return f.select(*files.columns, "level", "status", "content", F.lit("skill").alias("category"), F.lit("low").alias("importance"), F.array_join("_tags", " ").alias("tags"))
