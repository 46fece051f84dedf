"""Retrieval benchmarks as tables: files, questions, gold files and the scope that a question is judged in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Benchmark:
    """files (path, text), queries (place, qid, text, type), gold (qid, path), scope (qid, path); queries without gold are left out."""

    files: DataFrame
    queries: DataFrame
    gold: DataFrame
    scope: DataFrame

    def sampled(self, stride: int = 1, most: int = 0) -> Benchmark:
        """Every stride-th question, the first most of them, and the files in their scopes."""
        if stride <= 1 and most <= 0:
            return self
        places = [r["place"] for r in self.queries.orderBy("place").select("place").collect()][:: max(1, stride)]
        kept = self.queries.join(self.queries.sparkSession.createDataFrame([(p,) for p in (places[:most] if most > 0 else places)], "place long"), "place", "left_semi")
        scope = self.scope.join(kept.select("qid"), "qid", "left_semi")
        return Benchmark(self.files.join(scope.select("path"), "path", "left_semi"), kept, self.gold.join(kept.select("qid"), "qid", "left_semi"), scope)


def _made(files: DataFrame, queries: DataFrame, gold: DataFrame, scope: DataFrame) -> Benchmark:
    scope = scope.select("qid", "path").distinct()
    gold = gold.select("qid", "path").distinct().join(scope, ["qid", "path"], "left_semi")
    return Benchmark(files.select("path", "text"), queries.select("place", "qid", "text", "type").join(gold.select("qid").distinct(), "qid", "left_semi"), gold, scope)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of one JSON array, numbered in their order: a file of this kind is one partition."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("at", F.monotonically_increasing_id())


def _lines(turns: str, who: str, what: str):
    return f"concat_ws('', transform({turns}, t -> concat(coalesce({who}, ''), ': ', coalesce({what}, ''), '\n')))"


def sessions_of_speakers(spark: SparkSession, path: str) -> Benchmark:
    """Samples of several sessions: a file a session; a question's gold are the sessions of its evidence "D<session>:<turn>".

    Questions of category 5, which have no answer, and those without evidence are left out.
    """
    raw = _read(spark, path, "sample_id string, conversation variant, qa array<struct<question string, evidence array<string>, category string>>")
    raw.createOrReplaceTempView("kb_samples")
    parts = spark.sql("select at, sample_id, conversation, e.key, e.value from kb_samples, lateral variant_explode(conversation) as e where e.key like 'session\\_%' and e.key not like '%\\_date\\_time'")
    parts = parts.withColumn("turns", F.expr("try_variant_get(value, '$', 'array<variant>')")).where("turns is not null").withColumn("number", F.expr("substring(key, 9)"))
    date = F.col("date")
    dates = spark.sql("select at, substring(e.key, 1, length(e.key) - 10) as key, try_variant_get(e.value, '$', 'string') as date from kb_samples, lateral variant_explode(conversation) as e where e.key like 'session\\_%\\_date\\_time'")
    parts = parts.join(dates, ["at", "key"], "left").withColumn("path", F.concat("sample_id", F.lit("/session_"), "number", F.lit(".txt")))
    text = F.concat(F.when(date != "", F.concat(F.lit("DATE: "), date, F.lit("\n"))).otherwise(""), F.expr(_lines("turns", "try_variant_get(t, '$.speaker', 'string')", "try_variant_get(t, '$.text', 'string')")))
    asked = raw.select("at", "sample_id", F.posexplode("qa").alias("i", "q")).where("coalesce(q.category, '') <> '5' and size(q.evidence) > 0")
    asked = asked.select("at", (F.col("at") * (1 << 20) + F.col("i")).alias("place"), F.concat("sample_id", F.lit("-"), "i").alias("qid"), "q.question", "q.category", "q.evidence")
    found = asked.select("at", "qid", F.explode("evidence").alias("e")).where("instr(e, ':') > 0").select("at", "qid", F.expr("substring(substring_index(e, ':', 1), 2)").alias("number"), F.expr("substring(e, 1, 1)").alias("d")).where("d = 'D'")
    gold = found.join(parts.select("at", "number", "path"), ["at", "number"])
    return _made(parts.select("path", text.alias("text")), asked.selectExpr("place", "qid", "question as text", "category as type"), gold, asked.select("at", "qid").join(parts.select("at", "path"), "at"))


def turns_of_conversations(spark: SparkSession, path: str) -> Benchmark:
    """Conversations of numbered turns: a file a turn; a question is judged in its own conversation."""
    raw = _read(spark, path, "conversation_id string, turns array<struct<id int, role string, content string>>, questions array<struct<qid string, type string, question string, evidence_ids array<int>>>")
    name = lambda turn: F.format_string("c%s/t%05d.txt", F.col("conversation_id"), F.col(turn))
    turns = raw.select("at", "conversation_id", F.explode("turns").alias("t")).select("at", "conversation_id", "t.*").withColumn("path", name("id"))
    asked = raw.select("at", "conversation_id", F.posexplode("questions").alias("i", "q")).select((F.col("at") * (1 << 20) + F.col("i")).alias("place"), "at", "conversation_id", "q.*")
    gold = asked.select("qid", "conversation_id", F.explode("evidence_ids").alias("id")).select("qid", name("id").alias("path"))
    files = turns.groupBy("path").agg(F.max_by(F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("content", F.lit(""))), F.struct("at", "id")).alias("text"))
    return _made(files, asked.selectExpr("place", "qid", "question as text", "type"), gold, asked.select("at", "qid").join(turns.select("at", "path"), "at"))


def haystacks_of_sessions(spark: SparkSession, path: str) -> Benchmark:
    """Questions with haystacks of sessions that they share: a file a session, as its first haystack has it; gold are the answer's sessions."""
    raw = _read(spark, path, "question_id string, question_type string, question string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role string, content string>>>, answer_session_ids array<string>")
    name = F.concat(F.lit("sessions/"), "sid", F.lit(".txt"))
    held = raw.select("at", "question_id", "haystack_dates", "haystack_sessions", F.posexplode("haystack_session_ids").alias("i", "sid")).withColumn("path", name)
    body = F.expr(f"concat(if(get(haystack_dates, i) is null, '', concat('DATE: ', get(haystack_dates, i), '\n')), {_lines('get(haystack_sessions, i)', 't.role', 't.content')})")
    files = held.where("i < size(haystack_sessions)").groupBy("path").agg(F.min_by(body, F.struct("at", "i")).alias("text"))
    gold = raw.select(F.col("question_id").alias("qid"), F.explode("answer_session_ids").alias("sid")).select("qid", name.alias("path"))
    return _made(files, raw.selectExpr("at as place", "question_id as qid", "question as text", "question_type as type"), gold, held.select(F.col("question_id").alias("qid"), "path"))


LOADERS = {"locomo": sessions_of_speakers, "beam": turns_of_conversations, "longmemeval": haystacks_of_sessions}
