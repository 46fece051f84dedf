"""Session transcripts (JSON lines) as Markdown, with VARIANT for content that is a string or a list of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY_KEYS = ("description", "command", "query", "pattern", "file_path", "path", "prompt")
SUMMARY = 100


#: Markers of injected text, and what a tool without a name is called: fixed values.
CAVEAT, NAMELESS = "<local-command-caveat>", "tool"


def _trim(text):
    """Without the white space of any script around it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _tag(text, name: str):
    return F.get(F.regexp_extract_all(text, F.lit(rf"(?s)<{name}>(.*?)</{name}>"), F.lit(1)), 0)


def _clean(text):
    """What a person said: a command call becomes the command and its arguments; reminders go, and so do dumps of local commands."""
    command, args = _trim(_tag(text, "command-name")), F.coalesce(_trim(_tag(text, "command-args")), F.lit(""))
    called = F.when(command == "", "").when(args == "", command).otherwise(F.concat(command, F.lit(" "), args))
    plain = _trim(F.regexp_replace(text, r"(?s)<system-reminder>.*?</system-reminder>", ""))
    return F.when(command.isNotNull(), called).when(plain.startswith(CAVEAT), "").otherwise(plain)


def sections(lines: DataFrame) -> DataFrame:
    """seq, md of the lines (seq, value) that say something; malformed and meta lines are skipped.

    Content that is one string is what a person said, whatever the line's type; of a list of blocks, a person's texts count, and
    an assistant's texts and tool calls, each call with the first of SUMMARY_KEYS that holds a text, on one line.
    """
    v = lines.select("seq", F.try_parse_json("value").alias("v")).where("v is not null")
    v = v.select("seq", F.expr("try_variant_get(v, '$.type', 'string')").alias("type"), F.expr("coalesce(try_variant_get(v, '$.isMeta', 'boolean'), false)").alias("meta"), F.expr("variant_get(v, '$.message.content', 'variant')").alias("c"))
    v = v.where("type in ('user', 'assistant') and not meta and c is not null").withColumn("is_text", F.expr("schema_of_variant(c) = 'STRING'"))
    v = v.withColumn("blocks", F.expr("case when is_text then null else try_variant_get(c, '$', 'array<variant>') end")).withColumn("by_user", F.expr("is_text or type = 'user'"))
    get = lambda b, k: f"try_variant_get({b}, '$.{k}', 'string')"
    v = v.withColumn("texts", F.expr(f"case when is_text then array(try_variant_get(c, '$', 'string')) else transform(filter(blocks, b -> {get('b', 'type')} = 'text'), b -> {get('b', 'text')}) end"))
    said = F.filter(F.transform("texts", lambda t: F.when(F.col("by_user"), _clean(t)).otherwise(_trim(t))), lambda t: t.isNotNull() & (t != ""))
    # one value a key: the string in one line, or null where it is no string or blank
    line = lambda k: f"nullif(trim(regexp_replace(case when schema_of_variant(variant_get(b, '$.input.{k}', 'variant')) = 'STRING' then {get('b', f'input.{k}')} end, '(?U)\\\\s+', ' ')), '')"
    tried = "coalesce(" + ", ".join(map(line, SUMMARY_KEYS)) + ")"
    name = f"coalesce(nullif({get('b', 'name')}, ''), '{NAMELESS}')"
    cut = lambda x: f"case when length({x}) > {SUMMARY} then concat(left({x}, {SUMMARY}), '…') else {x} end"
    called = f"transform(transform(filter(blocks, b -> {get('b', 'type')} = 'tool_use'), b -> struct({name} as name, {tried} as tried)), b -> concat('- ', b.name, coalesce(concat(': ', {cut('b.tried')}), '')))"
    v = v.withColumn("said", said).withColumn("tools", F.expr(f"case when by_user then array() else coalesce({called}, array()) end"))
    body = F.concat_ws("\n\n", F.when(F.size("said") > 0, F.array_join("said", "\n\n")), F.when(F.size("tools") > 0, F.concat(F.lit("_tools:_\n"), F.array_join("tools", "\n"))))
    title = F.when(F.col("by_user"), "## User\n\n").otherwise("## Assistant\n\n")
    return v.withColumn("body", body).where("body <> ''").select("seq", F.concat(title, "body").alias("md"))


def render(lines: DataFrame) -> DataFrame:
    """md of one transcript (bounded by one session)."""
    return sections(lines).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "md"))), lambda x: x["md"]), "\n\n").alias("md"))
